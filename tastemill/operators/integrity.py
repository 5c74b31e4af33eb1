"""Key checks that a relational schema would enforce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.operators.aggregates import stats_after_delete
from tastemill.operators.upsert import apply_movie_stats


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Rows of ``child`` that point to no row of ``parent``; a null pointer is no orphan."""
    keys = parent.select(F.col(key).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete keys that occur more than once, and how often."""
    complete = df.dropna(subset=list(keys))
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def cascade_delete(parent_ids: DataFrame, fk: str, *children: DataFrame) -> list[DataFrame]:
    """The child tables without the rows that point to deleted parents; ``parent_ids`` has one column, ``id``."""
    gone = parent_ids.select(F.col("id").alias(fk))
    return [child.join(gone, fk, "left_anti").select(*child.columns) for child in children]


def delete_users(
    ids: DataFrame, users: DataFrame, ratings: DataFrame, recommendations: DataFrame, movie: DataFrame, now: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the users of ``ids`` (column ``id``), and with movie statistics of the ratings that stay.

    Movies whose statistics do not change keep their ``updated_at``. A movie that loses its last rating has the count and average 0.
    """
    kept_users, = cascade_delete(ids, "id", users)
    kept_ratings, kept_recommendations = cascade_delete(ids, "userId", ratings, recommendations)
    return kept_users, kept_ratings, kept_recommendations, apply_movie_stats(movie, stats_after_delete(ratings, ids), now)
