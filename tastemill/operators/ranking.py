"""Ranks, sorted pages and top lists. Ties always fall back on the id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill import fixed
from tastemill.functions.text import folded
from tastemill.operators.filters import filter_movies, search_titles, select_movie_card
from tastemill.operators.similar import top_list

ORDERS = {
    "avgRating": lambda: [F.col("avgRating").desc_nulls_last(), F.col("id")],
    "year": lambda: [F.col("year").desc_nulls_last(), F.col("id")],
    "title": lambda: [folded(F.col("title")).asc_nulls_first(), F.col("id")],
}


def rank_recommendations(scored: DataFrame, top_n: int, algorithm: str = fixed.ALGORITHM,
                         now: Column | None = None) -> DataFrame:
    """The ``top_n`` best movies of every user, ranked from 1.

    The bound goes into the window, so Spark drops lower rows before it shuffles and no task gets
    more than ``top_n`` rows per user and input partition.
    """
    best = Window.partitionBy("userId").orderBy(F.col("score").desc(), F.col("movieId"))
    return (
        scored.select("userId", "movieId", "score", F.row_number().over(best).alias("rank"))
        .where(F.col("rank") <= top_n)
        .withColumns({"algorithm": F.lit(algorithm), "created_at": F.current_timestamp() if now is None else now})
    )


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of the rows in this order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(movie: DataFrame, rating: float | None = None, movie_id: int | None = None, size: int = 20) -> DataFrame:
    """The page of best rated movies that follows a movie, given by its average and id; without them the first page.

    The filter drops everything before the page, so a deep page costs no more than the first.
    """
    if rating is not None:
        stars = F.coalesce(F.col("avgRating").cast("double"), F.lit(-1.0))
        movie = movie.where((stars < rating) | ((stars == rating) & (F.col("id") > movie_id)))
    return movie.orderBy(F.col("avgRating").desc_nulls_last(), F.col("id")).limit(size)


def page_info(df: DataFrame, size: int = 20) -> DataFrame:
    """Number of rows and of pages."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).alias("totalPages"))


def movie_order(sort: str = "avgRating") -> list[Column]:
    """Best rated or newest first; any other wish sorts by title."""
    return ORDERS.get(sort, ORDERS["title"])()


def list_movies(movie: DataFrame, keyword: str | None = None, sort: str = "avgRating", page: int = 1,
                page_size: int = 20, genre: str | None = None, year: int | None = None) -> DataFrame:
    """One page of the catalogue as cards."""
    found = filter_movies(search_titles(movie, keyword), genre, year)
    return paginate(select_movie_card(found), movie_order(sort), page, page_size)


def newest_first(id_col: str = "movieId") -> list[Column]:
    return [F.col("createdAt").desc_nulls_last(), F.col(id_col)]


def by_rank() -> list[Column]:
    return [F.col("rank").asc_nulls_first(), F.col("score").desc_nulls_last(), F.col("movieId")]


def top_movies(movie: DataFrame, min_count: int = 100, k: int = 10) -> DataFrame:
    """The best rated movies among those with more than ``min_count`` ratings."""
    return (
        movie.where(F.col("ratingCount") > min_count)
        .orderBy(F.col("avgRating").desc_nulls_last(), F.col("id"))
        .select("id", "title", "avgRating", "ratingCount")
        .limit(k)
    )


def latest_ratings(ratings: DataFrame, k: int = 10, by: str = "created_at") -> DataFrame:
    return ratings.orderBy(F.col(by).desc_nulls_last(), F.col("userId"), F.col("movieId")).limit(k)


def trending(events: DataFrame, window: str = "1 day", k: int = 10) -> DataFrame:
    """The ``k`` movies with the most ratings in each span of event time.

    Counted before ranked, so the window sees one row per movie and span.
    """
    counts = trending_counts(events, window)
    best = Window.partitionBy("start").orderBy(F.col("n").desc(), F.col("movieId"))
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def trending_counts(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Number and mean of ratings per movie and span; also for streams, with a watermark on ``eventTime``."""
    return (
        events.groupBy(F.window("eventTime", window), "movieId")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "movieId", "n")
    )


def trending_closed(events: DataFrame, window: str = "1 day", k: int = 10) -> DataFrame:
    """The ``k`` movies with the most ratings of each span, for a stream in append mode with a watermark on ``eventTime``.

    Counts and lists are both kept until the watermark passes the end of their span; then the list comes once.
    """
    counts = events.groupBy(F.window("eventTime", window), "movieId").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("n", (-F.col("movieId")).alias("lower"))
    best = counts.groupBy("window").agg(F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, k).alias("best"))
    return best.select(F.col("window.start").alias("start"), F.posexplode("best").alias("at", "entry")).select(
        "start", (F.col("at") + 1).alias("place"), (-F.col("entry.lower")).alias("movieId"), F.col("entry.n").alias("n"))


def recs_with_fallback(users: DataFrame, recs: DataFrame, movie: DataFrame, k: int = 8,
                       algorithm: str = fixed.ALGORITHM) -> DataFrame:
    """The first ``k`` recommendations of every user; the ``k`` best rated movies for users without any."""
    own = recs.where((F.col("algorithm") == algorithm) & (F.col("rank") <= k)).select("userId", "movieId", "rank")
    without = users.select(F.col("id").alias("userId")).join(
        recs.where(F.col("algorithm") == algorithm).select("userId"), "userId", "left_anti")
    spread = without.select("userId", F.posexplode(top_list(movie, k)).alias("place", "item")).select(
        "userId", F.col("item.id").alias("movieId"), (F.col("place") + 1).alias("rank"))
    return own.withColumn("isPersonalized", F.lit(True)).unionByName(
        spread.withColumn("isPersonalized", F.lit(False)))
