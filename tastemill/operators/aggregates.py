"""Rating statistics, counts and summaries.

Everything groups with partial aggregates, so a movie or user with a large share of all rows arrives
at its reducer as one small row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tastemill import fixed
from tastemill.functions.numbers import mean_of_tenths, one_place
from tastemill.operators.filters import by_source
from tastemill.operators.joins import own_exchange
from tastemill.operators.upsert import apply_movie_stats


def stat_sums(ratings: DataFrame) -> DataFrame:
    """Sum of ratings in tenths and their number per movie: whole numbers that can be added and taken back."""
    tenths = (F.col("rating").cast("decimal(2,1)") * 10).cast("bigint")
    return ratings.groupBy("movieId").agg(F.sum(tenths).alias("sum10"), F.count("rating").alias("n"))


def finish_stats(sums: DataFrame) -> DataFrame:
    """Average with two places and count, for movies that still have ratings."""
    return sums.where(F.col("n") > 0).select(
        "movieId", mean_of_tenths(F.col("sum10"), F.col("n")).alias("avgRating"), F.col("n").alias("ratingCount"))


def movie_stats(ratings: DataFrame) -> DataFrame:
    """ROUND(AVG(rating), 2) and COUNT(*) per movie."""
    return finish_stats(stat_sums(ratings))


def touched_sums(rating: DataFrame, batch: DataFrame) -> DataFrame:
    """Sums over all ratings of the movies in a batch.

    The join comes after the aggregate, where a popular movie is one row. Spark moves it in front of
    the aggregate by itself when the batch is small enough to be broadcast.
    """
    return stat_sums(rating).join(batch.select("movieId").distinct(), "movieId", "left_semi")


def refresh_stats(rating: DataFrame, movie: DataFrame, batch: DataFrame, now=None) -> DataFrame:
    """Recount the movies touched by a batch from all their ratings; other movies stay unchanged."""
    return apply_movie_stats(movie, finish_stats(touched_sums(rating, batch)), now)


def stat_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the statistics gain when the ratings ``before`` become the ratings ``after``."""
    lost = stat_sums(before).select("movieId", (-F.col("sum10")).alias("sum10"), (-F.col("n")).alias("n"))
    return add_stats(stat_sums(after), lost)


def change_deltas(changes: DataFrame) -> DataFrame:
    """What the statistics gain from changed ratings: ``movieId, old, new``, either null where there is none."""
    old, new = ((F.col(c).cast("decimal(2,1)") * 10).cast("bigint") for c in ("old", "new"))
    zero = F.lit(0).cast("bigint")
    return changes.groupBy("movieId").agg(
        F.sum(F.coalesce(new, zero) - F.coalesce(old, zero)).alias("sum10"),
        F.sum(F.col("new").isNotNull().cast("bigint") - F.col("old").isNotNull().cast("bigint")).alias("n"))


def add_stats(sums: DataFrame, deltas: DataFrame) -> DataFrame:
    return sums.unionByName(deltas).groupBy("movieId").agg(F.sum("sum10").alias("sum10"), F.sum("n").alias("n"))


def stats_after_delete(ratings: DataFrame, parent_ids: DataFrame, fk: str = "userId") -> DataFrame:
    """New statistics of the movies that lose ratings when parents (column ``id``) are deleted; 0 and 0 where none is left.

    One pass over the ratings: kept and lost ones are counted side by side. Ids may repeat; null ids delete nothing.
    """
    gone = own_exchange(parent_ids.select(F.col("id").alias(fk)).distinct().withColumn("gone", F.lit(True)))
    kept = F.col("gone").isNull()
    tenths = (F.col("rating").cast("decimal(2,1)") * 10).cast("bigint")
    sums = ratings.select(fk, "movieId", "rating").join(gone, fk, "left").groupBy("movieId").agg(
        F.coalesce(F.sum(F.when(kept, tenths)), F.lit(0)).alias("sum10"), F.count(F.when(kept, F.col("rating"))).alias("n"),
        F.count("gone").alias("lost"))
    mean = F.when(F.col("n") > 0, mean_of_tenths(F.col("sum10"), F.col("n"))).otherwise(0)
    return sums.where(F.col("lost") > 0).select("movieId", mean.alias("avgRating"), F.col("n").alias("ratingCount"))


def dataset_profile(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of ratings, users and movies, in one pass over the table."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return ratings.agg(
        F.count(F.lit(1)).alias("ratings"), distinct("userId").alias("users"), distinct("movieId").alias("movies"))


def daily_sketches(ratings: DataFrame, precision: int = 14) -> DataFrame:
    """Per day: number of ratings, and sketches of the users and movies in them, which can be united for any span."""
    day = F.timestamp_seconds("timestamp").cast("date")
    return ratings.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("ratings"),
        F.hll_sketch_agg("userId", F.lit(precision)).alias("users"), F.hll_sketch_agg("movieId", F.lit(precision)).alias("movies"))


def united_profile(days: DataFrame, span: Column) -> DataFrame:
    """Ratings, and estimates of users and movies, of every span of days, from the days' sketches alone."""
    return days.groupBy(span.alias("span")).agg(
        F.sum("ratings").alias("ratings"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.hll_sketch_estimate(F.hll_union_agg("movies")).alias("movies"))


def distinct_user_ids(ratings: DataFrame) -> DataFrame:
    """User ids that parse as whole numbers, each once."""
    user = F.col("userId").try_cast("bigint")
    return ratings.select(user.alias("userId")).where(F.col("userId").isNotNull()).distinct()


def count_by_source(movie: DataFrame) -> DataFrame:
    return movie.groupBy("source").agg(F.count(F.lit(1)).alias("movies"))


def source_profile(movie: DataFrame) -> DataFrame:
    """For every source: its movies, how many of them are rated and how often, and how good those are.

    ``mean`` takes every rated movie alike, ``weighted`` every rating; both are null where nothing is rated.
    """
    given = F.coalesce(F.col("ratingCount"), F.lit(0)).cast("bigint")
    rated = given > 0
    stars = F.when(rated, F.col("avgRating").cast("decimal(20,10)"))
    totals = movie.groupBy("source").agg(
        F.count(F.lit(1)).alias("movies"), F.count_if(rated).alias("rated"), F.sum(given).alias("ratings"),
        F.min(stars).alias("least"), F.max(stars).alias("most"), F.sum(stars).alias("stars"), F.sum(stars * given).alias("points"))
    return totals.select(
        "source", "movies", "rated", "ratings",
        F.col("least").cast("double").alias("worst"),
        F.col("most").cast("double").alias("best"),
        F.try_divide(F.col("stars").cast("double"), "rated").alias("mean"),
        F.try_divide(F.col("points").cast("double"), "ratings").alias("weighted"))


def user_stats(users: DataFrame, ratings: DataFrame, recs: DataFrame) -> DataFrame:
    """Per user: number of ratings, number of recommendations, mean rating as text.

    Both sides are counted before they are joined to the users.
    """
    mean = F.round(F.avg(F.col("rating").cast("decimal(20,10)")), 5)
    rated = ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("rated"), mean.alias("mean"))
    advised = recs.groupBy("userId").agg(F.count(F.lit(1)).alias("advised"))
    return (
        users.select(F.col("id").alias("userId"))
        .join(rated, "userId", "left")
        .join(advised, "userId", "left")
        .select(
            "userId",
            F.coalesce("rated", F.lit(0)).alias("ratingsCount"),
            F.coalesce("advised", F.lit(0)).alias("recommendationsCount"),
            one_place(F.nullif(F.col("mean"), F.lit(0).cast("decimal(2,1)"))).alias("avgRating"),
        )
    )


def require_non_empty(df: DataFrame, what: str) -> DataFrame:
    """The same rows, or an error when there are none; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def with_metrics(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """Count rows, and the rows meeting each condition, while another action runs over them."""
    observation = Observation(name)
    extra = [F.count(F.when(condition, 1)).alias(alias) for alias, condition in counts.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *extra), observation


def rows_per_second(rows: int, seconds: float) -> float:
    return rows / seconds if seconds > 0 else 0.0
