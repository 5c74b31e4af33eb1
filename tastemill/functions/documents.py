"""Nested item documents and JSON values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill import fixed
from tastemill.functions.numbers import rescale_vote
from tastemill.functions.text import poster_url
from tastemill.functions.times import release_year


def _joined(names: Column) -> Column:
    return F.nullif(F.array_join(names, "|"), F.lit(""))


def top_cast(credits: Column, shown: int = fixed.CAST_SHOWN) -> Column:
    """Names of the first cast members, null when there are none."""
    return _joined(F.transform(F.slice(credits["cast"], 1, shown), lambda person: person["name"]))


def director(credits: Column) -> Column:
    """The first crew member whose job is directing."""
    directors = F.filter(credits["crew"], lambda person: person["job"] == fixed.DIRECTOR_JOB)
    return F.get(directors, F.lit(0))["name"]


def genre_names(genres: Column) -> Column:
    return _joined(F.transform(genres, lambda genre: genre["name"]))


def flatten_items(docs: DataFrame, poster_base: str = fixed.POSTER_BASE) -> DataFrame:
    """One flat item event per nested document."""
    return docs.select(
        F.col("id").cast("string").alias("tmdbId"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.col("original_title").alias("originalTitle"),
        genre_names(F.col("genres")).alias("genres"),
        release_year(F.col("release_date")).alias("year"),
        director(F.col("credits")).alias("director"),
        top_cast(F.col("credits")).alias("actors"),
        F.col("overview").alias("description"),
        poster_url(F.col("poster_path"), poster_base).alias("posterUrl"),
        rescale_vote(F.col("vote_average")).alias("avgRating"),
        F.coalesce("vote_count", F.lit(0)).alias("ratingCount"),
    )


def to_message(df: DataFrame) -> DataFrame:
    """Each row as a UTF-8 JSON value, the shape a message topic takes."""
    return df.select(F.to_json(F.struct("*")).cast("binary").alias("value"))


def parse_message(df: DataFrame, schema: T.StructType, value: str = "value", arrival: str | None = None) -> DataFrame:
    """Typed columns of a JSON value next to the text itself, kept as ``raw`` for rejects.

    A value that is no JSON object, or a field of another type, gives nulls and never fails the job.
    With ``arrival`` that column of the source is kept as ``arrivedAt``.
    """
    raw = F.col(value).cast("string")
    kept = [F.col(arrival).alias("arrivedAt")] if arrival else []
    parsed = df.select(raw.alias("raw"), F.from_json(raw, schema).alias("data"), *kept)
    return parsed.select("data.*", "raw", *parsed.columns[2:])
