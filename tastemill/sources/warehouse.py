"""The canonical tables as views of the star-schema Parquet tables the tests and the bench run on.

Customers are users, parts are movies, an order line is a rating of a part by the customer who
ordered it, and events are the rating stream. Columns are only derived when a query reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill import fixed, schemas
from tastemill.functions.documents import to_message
from tastemill.functions.numbers import half_star
from tastemill.functions.text import account_name, split_title_year
from tastemill.functions.times import clock_epoch
from tastemill.operators.aggregates import movie_stats
from tastemill.operators.ranking import rank_recommendations
from tastemill.operators.upsert import RATING_KEY, apply_movie_stats, latest_per_key
from tastemill.schemas import conform

NOW = "2024-06-01 00:00:00+00:00"
LOADED = "2024-01-01 00:00:00+00:00"
SEQ_STEP = 10  # an order has fewer lines than this


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rating_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every rating ever given, with a sequence number; a user may rate a movie again."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("movieId"),
        (1.0 + 0.5 * ((F.col("l_quantity").cast("int") - 1) % 9)).cast("decimal(2,1)").alias("rating"),
        clock_epoch(F.col("l_shipdate")).alias("timestamp"),
        (F.col("l_orderkey") * SEQ_STEP + F.col("l_linenumber")).alias("seq"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("userId"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        "userId", "movieId", "rating", "timestamp", "seq")


def rating_history(spark: SparkSession, folder: str) -> DataFrame:
    """One rating per user and movie, the last one given, with its sequence number.

    Sequence numbers have at most 14 digits, so time, number and rating fit together into one number.
    """
    log = rating_log(spark, folder)
    last = latest_per_key(log.withColumn("seq", F.col("seq").cast("decimal(14,0)")), RATING_KEY, ["timestamp", "seq"])
    return last.withColumn("seq", F.col("seq").cast("bigint"))


def rating(spark: SparkSession, folder: str) -> DataFrame:
    """The rating table."""
    given = F.timestamp_seconds("timestamp")
    history = rating_history(spark, folder).withColumns({"created_at": given, "updated_at": given})
    return conform(history, schemas.RATING)


def user(spark: SparkSession, folder: str) -> DataFrame:
    """The user table; customers of one segment never gave a name."""
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key.alias("id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("userName"),
        account_name(key).alias("userAccount"),
        F.lit(None).alias("gender"),
        key.alias("mlUserId"),
        F.lit(fixed.SOURCE_CATALOGUE).alias("source"),
        moment(LOADED).alias("created_at"),
        moment(LOADED).alias("updated_at"),
    )
    return conform(rows, schemas.USER)


def original_title(name: Column, size: Column) -> Column:
    """A title that ends in a year, except for the smallest parts."""
    dated = F.concat(name, F.lit(" ("), (size + 1950).cast("string"), F.lit(")"))
    return F.when(size > 2, dated).otherwise(name)


def raw_movies(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the catalogue file."""
    size = F.col("p_size")
    genres = F.concat_ws("|", "p_type", "p_brand")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("movieId"),
        original_title(F.col("p_name"), size).alias("title"),
        F.when(size == 1, fixed.NO_GENRES).otherwise(genres).alias("genres"),
    )


def raw_links(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the link file: nothing for the largest parts, a blank external id for some."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    return table(spark, folder, "part").where(size < 46).select(
        F.col("p_partkey").alias("movieId"),
        F.concat(F.lit("tt"), key).alias("imdbId"),
        F.when(size < 4, "  ").otherwise(F.concat(F.lit("t"), key)).alias("tmdbId"),
    )


def movie(spark: SparkSession, folder: str) -> DataFrame:
    """The movie table before any statistics. Parts of one brand come from the item feed."""
    key, size = F.col("p_partkey"), F.col("p_size")
    named = table(spark, folder, "part").withColumn("full", original_title(F.col("p_name"), size))
    title, year = split_title_year(F.col("full"))
    rows = named.select(
        key.alias("id"),
        title.alias("title"),
        F.col("full").alias("originalTitle"),
        F.when(size > 1, F.concat_ws("|", "p_type", "p_brand")).alias("genres"),
        year.alias("year"),
        F.lit(None).alias("director"),
        F.lit(None).alias("actors"),
        F.col("p_name").alias("description"),
        F.concat(F.lit("/p/"), key.cast("string")).alias("posterUrl"),
        key.alias("mlMovieId"),
        F.concat(F.lit("tt"), key.cast("string")).alias("imdbId"),
        F.when(size < 46, F.concat(F.lit("t"), key.cast("string"))).alias("tmdbId"),
        F.when(F.col("p_brand") == "Brand#2", fixed.SOURCE_FEED).otherwise(fixed.SOURCE_CATALOGUE).alias("source"),
        F.lit(0).alias("avgRating"),
        F.lit(0).alias("ratingCount"),
        moment(LOADED).alias("created_at"),
        moment(LOADED).alias("updated_at"),
    )
    return conform(rows, schemas.MOVIE)


def rated_movie(spark: SparkSession, folder: str) -> DataFrame:
    """The movie table with statistics over all ratings ever given."""
    return apply_movie_stats(movie(spark, folder), movie_stats(rating_log(spark, folder)))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate scores: what a user rated three stars or better, newer ones a little higher."""
    r = rating_history(spark, folder).where(F.col("rating") >= 3)
    return r.select(
        "userId", "movieId", (F.col("rating").cast("double") + F.col("timestamp") / 2_000_000_000.0).alias("score"))


def recommendation(spark: SparkSession, folder: str, top_n: int = 20) -> DataFrame:
    """The recommendation table: five-star candidates, so some users have none."""
    best = scored(spark, folder).where(F.col("score") >= 5)
    return conform(rank_recommendations(best, top_n, now=moment(LOADED)), schemas.RECOMMENDATION)


def feeds(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    """Three overlapping item feeds in order of priority."""
    part = table(spark, folder, "part")
    columns = [F.col("p_partkey").alias("id"), F.col("p_name").alias("title")]
    return [
        ("popular", part.where(F.col("p_size") <= 20).select(*columns)),
        ("top_rated", part.where(F.col("p_retailprice") >= 1000).select(*columns)),
        ("now_playing", part.where(F.col("p_size") >= 40).select(*columns)),
    ]


def item_documents(part: DataFrame) -> DataFrame:
    """Nested item documents, one per part; takes a stream of parts too."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    cast = F.transform(
        F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(F.lit("Actor "), i.cast("string")).alias("name")))
    crew = F.array(
        F.struct(F.concat(F.lit("Writer "), key).alias("name"), F.lit("Writer").alias("job")),
        F.struct(F.concat(F.lit("Boss "), key).alias("name"), F.when(size > 5, "Director").alias("job")),
        F.struct(F.concat(F.lit("Second "), key).alias("name"), F.when(size > 3, "Director").alias("job")),
    )
    genres = F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name")))
    date = F.concat((size + 1950).cast("string"), F.lit("-01-15"))
    docs = part.select(
        F.col("p_partkey").alias("id"),
        F.when(size != 7, F.col("p_name")).alias("title"),
        F.col("p_name").alias("original_title"),
        F.col("p_brand").alias("overview"),
        F.when(size <= 2, "").when(size == 3, "soon").when(size > 4, date).alias("release_date"),
        F.when(size <= 9, "").when(size > 10, F.concat(F.lit("/"), key, F.lit(".jpg"))).alias("poster_path"),
        F.when(size < 50, F.col("p_retailprice") / 320).alias("vote_average"),
        F.when(size < 49, size * 37).alias("vote_count"),
        F.when(size == 48, F.slice(genres, 1, 0)).when(size != 47, genres).alias("genres"),
        F.struct(F.when(size > 6, cast).alias("cast"), crew.alias("crew")).alias("credits"),
    )
    return conform(docs, schemas.ITEM_DOCUMENT)


def rating_events(events: DataFrame) -> DataFrame:
    """The rating stream; takes a stream of events too."""
    return events.select(
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("bigint").alias("movieId"),
        half_star(1 + F.col("value") % 4).alias("rating"),
        clock_epoch(F.col("ts")).alias("timestamp"),
    )


def rating_messages(events: DataFrame) -> DataFrame:
    """The rating stream as message values; errors arrive as text that is no JSON."""
    message = F.to_json(F.struct(*schemas.RATING_EVENT.names))
    shown = rating_events(events.where(F.col("event_type") != "error")).select(message.alias("value"))
    broken = events.where(F.col("event_type") == "error").select(F.concat(F.lit("error "), "event_id").alias("value"))
    return shown.unionByName(broken).select(F.col("value").cast("binary").alias("value"))


def item_messages(flat_items: DataFrame) -> DataFrame:
    return to_message(flat_items)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of them."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def factors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """User and item factors: vectors of the lower and of the upper half of the labels."""
    vectors = table(spark, folder, "embeddings")
    columns = [F.col("vec_id").alias("id"), F.col("embedding").alias("features")]
    return vectors.where(F.col("label") < 5).select(*columns), vectors.where(F.col("label") >= 5).select(*columns)
