"""Staging joins, id mapping and the views that put tables together.

The large side is always the fact table and the other side has one row per key. Spark broadcasts
that side when its size allows; otherwise adaptive execution splits the partition of a popular key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill import fixed
from tastemill.functions.numbers import or_zero
from tastemill.functions.text import blank_to_null, clean_genres, name_or_anonymous, reason, split_title_year, strip
from tastemill.operators.upsert import latest_per_key


def own_exchange(dimension: DataFrame) -> DataFrame:
    """A dimension that reaches a join through an exchange of its own.

    An aggregate or join result may already be partitioned by the key; the join then needs no exchange on
    that side, and without one on both sides Spark can not split a popular key.
    """
    return dimension.hint("rebalance")


def stage_links(links: DataFrame, order_by: tuple[str, ...] = ()) -> DataFrame:
    """External ids per movie, blanks as null; of repeated ids the last by ``order_by`` counts."""
    clean = links.withColumns({"imdbId": blank_to_null(F.col("imdbId")), "tmdbId": blank_to_null(F.col("tmdbId"))})
    return latest_per_key(clean, ["movieId"], order_by).select("movieId", "imdbId", "tmdbId")


def stage_movies(movies: DataFrame, links: DataFrame, link_order: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Catalogue rows with title and year apart and the external ids of their links, null where none.

    ``keep`` names further columns of the movies that stay, such as their order of arrival.
    """
    title, year = split_title_year(F.col("title"))
    return movies.join(stage_links(links, link_order), "movieId", "left").select(
        F.col("movieId").cast("bigint").alias("mlMovieId"),
        title.alias("title"),
        strip(F.col("title")).alias("originalTitle"),
        clean_genres(F.col("genres")).alias("genres"),
        year.alias("year"),
        "imdbId",
        "tmdbId",
        F.lit(fixed.SOURCE_CATALOGUE).alias("source"),
        *(movies[name] for name in keep),
    )


def _id_map(table: DataFrame, external: str, internal: str) -> DataFrame:
    return table.where(F.col(external).isNotNull()).select(
        F.col(external).alias(f"external_{internal}"), F.col("id").alias(f"internal_{internal}"))


def map_ids(ratings: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings with internal ids next to the external ones; null where an id is not known."""
    u = _id_map(users, "mlUserId", "userId")
    m = _id_map(movies, "mlMovieId", "movieId")
    return (
        ratings.join(u, F.col("userId") == F.col("external_userId"), "left")
        .join(m, F.col("movieId") == F.col("external_movieId"), "left")
        .drop("external_userId", "external_movieId")
    )


def resolve_ids(ratings: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings with external ids replaced by internal ones; unknown ids drop out."""
    u = _id_map(users, "mlUserId", "userId")
    m = _id_map(movies, "mlMovieId", "movieId")
    joined = ratings.join(u, F.col("userId") == F.col("external_userId")).join(
        m, F.col("movieId") == F.col("external_movieId"))
    rest = [name for name in ratings.columns if name not in ("userId", "movieId")]
    return joined.select(
        F.col("internal_userId").alias("userId"), F.col("internal_movieId").alias("movieId"), *rest)


def unmapped(ratings: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings whose user or movie has no internal id."""
    missing = F.col("internal_userId").isNull() | F.col("internal_movieId").isNull()
    return map_ids(ratings, users, movies).where(missing).select(*ratings.columns)


def resolve_stream_ids(stream: DataFrame, dimension: DataFrame, external: str = "tmdbId") -> DataFrame:
    """Events keyed by an external item id with the internal ``movieId``; unknown items drop out.

    Of several movies with one external id the lowest internal id counts. Works on streams too.
    """
    ids = dimension.where(F.col(external).isNotNull()).groupBy(external).agg(F.min("id").alias("movieId"))
    return stream.join(own_exchange(ids), external, "inner")


def user_ratings_view(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Each rating with the movie it is for, nested."""
    movie = movies.select(
        F.col("id").alias("movieId"),
        F.struct(F.col("id").cast("string").alias("id"), "title", "genres", "year", "posterUrl").alias("movie"))
    return ratings.join(movie, "movieId").select(
        "userId", F.col("movieId"), or_zero(F.col("rating")).alias("rating"), F.col("created_at").alias("createdAt"),
        "movie")


def movie_ratings_view(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """Each rating with the user who gave it, nested; users without a name are anonymous."""
    user = users.select(
        F.col("id").alias("userId"),
        F.struct(F.col("id").cast("string").alias("id"), name_or_anonymous(F.col("userName")).alias("userName"))
        .alias("user"))
    return ratings.join(user, "userId").select(
        "movieId", F.col("userId"), or_zero(F.col("rating")).alias("rating"), F.col("created_at").alias("createdAt"),
        "user")


def user_recs_view(recs: DataFrame, movies: DataFrame, algorithm: str = fixed.ALGORITHM) -> DataFrame:
    """Recommendations of an algorithm with their movie, nested, and the reason shown to the user."""
    movie = movies.select(
        F.col("id").alias("movieId"),
        F.struct(
            F.col("id").cast("string").alias("id"), "title", "genres", "year", "posterUrl",
            or_zero(F.col("avgRating")).alias("avgRating"), "description").alias("movie"))
    return recs.where(F.col("algorithm") == algorithm).join(own_exchange(movie), "movieId").select(
        "userId", "movieId", or_zero(F.col("score")).alias("score"), "rank",
        reason(F.col("algorithm")).alias("reason"), F.col("created_at").alias("updatedAt"), "movie")


def rec_report(users: DataFrame, recs: DataFrame, movies: DataFrame, algorithm: str = fixed.ALGORITHM) -> DataFrame:
    """Account, title, score and rank of every recommendation of an algorithm."""
    return (
        recs.where(F.col("algorithm") == algorithm)
        .join(users.select(F.col("id").alias("userId"), "userAccount"), "userId")
        .join(movies.select(F.col("id").alias("movieId"), "title"), "movieId")
        .select("userId", "userAccount", "title", "score", "rank", "movieId")
    )


def lookup_rating(keys: DataFrame, ratings: DataFrame) -> DataFrame:
    """For each user and movie asked for: whether it is rated, and the rating or 0."""
    given = ratings.select("userId", "movieId", F.col("rating").cast("double").alias("given"))
    return keys.join(given, ["userId", "movieId"], "left").select(
        "userId", "movieId", F.col("given").isNotNull().alias("rated"),
        F.coalesce("given", F.lit(0.0)).alias("rating"))


def rec_status(users: DataFrame, recs: DataFrame, algorithm: str = fixed.ALGORITHM) -> DataFrame:
    """Per user: number of recommendations of an algorithm and whether the list is personal."""
    counts = recs.where(F.col("algorithm") == algorithm).groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce("n", F.lit(0))
    return users.select(F.col("id").alias("userId")).join(counts, "userId", "left").select(
        "userId", total.alias("total"), (total > 0).alias("isPersonalized"))
