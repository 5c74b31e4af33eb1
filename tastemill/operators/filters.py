"""Filters, validation and column subsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill import fixed
from tastemill.functions.numbers import or_zero
from tastemill.functions.text import contains_folded, genre_list

CARD = ("id", "title", "genres", "year", "posterUrl", "avgRating", "ratingCount")
DETAIL = ("id", "title", "originalTitle", "genres", "year", "director", "actors", "description", "posterUrl",
          "mlMovieId", "imdbId", "tmdbId", "source", "avgRating", "ratingCount", "created_at", "updated_at")


def sample_users(ratings: DataFrame, max_user_id: int) -> DataFrame:
    """Ratings of the users with the lowest ids; the filter reaches the source."""
    return ratings.where(F.col("userId") <= max_user_id)


def before_cutoff(ratings: DataFrame, cutoff: int, version: str) -> DataFrame:
    """Ratings given before an epoch second, marked with the version of the training set."""
    return ratings.where(F.col("timestamp") < cutoff).withColumn("version", F.lit(version))


def ratings_for_user(ratings: DataFrame, user_id: int) -> DataFrame:
    return ratings.where(F.col("userId") == user_id)


def ratings_for_movie(ratings: DataFrame, movie_id: int) -> DataFrame:
    return ratings.where(F.col("movieId") == movie_id)


def recs_for(recs: DataFrame, user_id: int, algorithm: str = fixed.ALGORITHM) -> DataFrame:
    return recs.where((F.col("userId") == user_id) & (F.col("algorithm") == algorithm))


def movie_by_id(movie: DataFrame, movie_id: int) -> DataFrame:
    """One movie, or no row."""
    return movie.where(F.col("id") == movie_id)


def by_source(movie: DataFrame, source: str = fixed.SOURCE_CATALOGUE) -> DataFrame:
    return movie.where(F.col("source") == source)


def search_titles(movie: DataFrame, keyword: str | None) -> DataFrame:
    """Movies whose title contains the keyword, whatever its case and accents; all without a keyword."""
    return movie.where(contains_folded(F.col("title"), keyword)) if keyword else movie


def filter_movies(movie: DataFrame, genre: str | None = None, year: int | None = None) -> DataFrame:
    """Movies of a genre and of a year."""
    found = movie
    if genre:
        found = found.where(F.array_contains(genre_list(F.col("genres")), genre))
    if year is not None:
        found = found.where(F.col("year") == year)
    return found


def _complete(cols: Sequence[str]) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in cols])


def require(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all of ``cols`` present, and the others."""
    return df.where(_complete(cols)), df.where(~_complete(cols))


def with_defaults(df: DataFrame, mapping: dict[str, object]) -> DataFrame:
    """Replace nulls by the default of their column."""
    return df.withColumns({
        name: F.coalesce(name, F.lit(value).cast(df.schema[name].dataType)) for name, value in mapping.items()
    })


def parse_or_reject(df: DataFrame, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose texts all parse as the wanted types, cast; and the rows that do not, as they came."""
    parsed = {name: F.trim(F.col(name)).try_cast(kind) for name, kind in casts.items()}
    good = reduce(and_, [column.isNotNull() for column in parsed.values()])
    return df.where(good).withColumns(parsed), df.where(~good)


def check_ratings(ratings: DataFrame, movies: DataFrame, low: float = fixed.RATING_MIN,
                  high: float = fixed.RATING_MAX) -> DataFrame:
    """Each rating with the ``reason`` it is refused, null for a good one."""
    known = movies.select(F.col("id").alias("movieId"), F.lit(True).alias("known")).dropDuplicates(["movieId"])
    known = known.hint("rebalance")  # an exchange of its own, so that Spark can split a popular movie in the join
    value = F.col("rating").cast("double")
    reason = (
        F.when(F.col("movieId").isNull() | value.isNull(), "missing")
        .when(~value.between(low, high), "out of range")
        .when(F.col("known").isNull(), "unknown movie")
    )
    return ratings.join(known, "movieId", "left").withColumn("reason", reason).select(*ratings.columns, "reason")


def validate_ratings(ratings: DataFrame, movies: DataFrame, low: float = fixed.RATING_MIN,
                     high: float = fixed.RATING_MAX) -> tuple[DataFrame, DataFrame]:
    """Good ratings, and refused ones with their reason."""
    checked = check_ratings(ratings, movies, low, high)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def select_movie_card(movie: DataFrame) -> DataFrame:
    return movie.select(*CARD)


def select_movie_detail(movie: DataFrame) -> DataFrame:
    return movie.select(*DETAIL)


def present(df: DataFrame, ids: Sequence[str] = ("id",), numbers: Sequence[str] = ("avgRating",)) -> DataFrame:
    """Ids as text, decimals as doubles with 0 for a missing one."""
    shown = {name: F.col(name).cast("string") for name in ids}
    shown.update({name: or_zero(F.col(name)) for name in numbers})
    return df.withColumns(shown)
