"""Queries that run a stream over a table to its end and read what it stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.functions.documents import flatten_items, parse_message, to_message
from tastemill.functions.times import event_time
from tastemill.operators.aggregates import finish_stats
from tastemill.operators.joins import resolve_stream_ids
from tastemill.operators.ranking import trending_closed, trending_counts
from tastemill.plans.catalogue_queries import METADATA_SQL
from tastemill.plans.registry import plain, query
from tastemill.plans.sql import EVENT, MOVIE, STREAM_RATING, stats
from tastemill.session import work_dir
from tastemill.sources import warehouse
from tastemill.sources.files import stream_text
from tastemill.streaming import ingest

EVENT_COLUMNS = schemas.RATING_EVENT.names


@query("parse_json_events", f"""WITH {EVENT}
SELECT CASE WHEN event_type <> 'error' THEN userId END AS userId,
       CASE WHEN event_type <> 'error' THEN movieId END AS movieId,
       CASE WHEN event_type <> 'error' THEN rating END AS rating,
       CASE WHEN event_type <> 'error' THEN timestamp END AS timestamp,
       CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS rejected
FROM event""")
def parse_json_events(spark, folder):
    messages = warehouse.rating_messages(warehouse.table(spark, folder, "events"))
    parsed = parse_message(messages, schemas.RATING_EVENT)
    return parsed.withColumn("rejected", F.when(F.col("userId").isNull(), F.col("raw"))).drop("raw")


@query("message_roundtrip", f"WITH {EVENT} SELECT userId, movieId, rating, timestamp FROM event")
def message_roundtrip(spark, folder):
    events = warehouse.rating_events(warehouse.table(spark, folder, "events"))
    return parse_message(to_message(events), schemas.RATING_EVENT).drop("raw")


def run_ratings(spark, folder, mode="latest", how="delta"):
    """Feed the event table through the rating stream; returns the folder of its tables."""
    base = work_dir(spark, "ratings")
    source = parse_message(
        warehouse.rating_messages(warehouse.stream_table(spark, folder, "events")), schemas.RATING_EVENT)
    writer = ingest.ratings_batch(
        ingest.rating_store(spark, base), ingest.sums_store(spark, base), f"{base}/rejects", how, warehouse.moment(warehouse.NOW))
    checkpoint = ingest.checkpoint_dir(f"{base}/checkpoints", "ratings-ingest")
    ingest.start_ingest(ingest.rating_stream(source, mode), writer, checkpoint, trigger=None).awaitTermination()
    return base


@query("stream_latest_ratings", f"""WITH {STREAM_RATING}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, timestamp FROM stream_rating""")
def stream_latest_ratings(spark, folder):
    base = run_ratings(spark, folder)
    return plain(ingest.rating_store(spark, base).read().select(*EVENT_COLUMNS))


@query("stream_two_checkpoints", f"""WITH {STREAM_RATING}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, timestamp FROM stream_rating""")
def stream_two_checkpoints(spark, folder):
    """Two queries that both count their batches from 0, one after the other over one store, which is compacted in
    between; then each is started again and finds nothing new."""
    base = work_dir(spark, "ratings")
    store = ingest.rating_store(spark, base)
    messages = warehouse.rating_messages(warehouse.stream_table(spark, folder, "events"))
    parsed = parse_message(messages, schemas.RATING_EVENT)
    for part in (0, 1, 0, 1):
        half = parsed.where(F.coalesce(F.pmod("userId", F.lit(2)), F.lit(0)) == part)
        writer = ingest.ratings_batch(store, ingest.sums_store(spark, base), f"{base}/rejects", now=warehouse.moment(warehouse.NOW))
        ingest.start_ingest(ingest.rating_stream(half), writer, ingest.checkpoint_dir(f"{base}/checkpoints", f"half-{part}"),
                            trigger=None).awaitTermination()
        store.compact("compacted")
    return plain(store.read().select(*EVENT_COLUMNS))


@query("stream_rejects", f"WITH {EVENT} SELECT 'error ' || event_id AS raw FROM event WHERE event_type = 'error'")
def stream_rejects(spark, folder):
    return spark.read.text(f"{run_ratings(spark, folder)}/rejects").select(F.col("value").alias("raw"))


@query("stream_dedup_first", f"WITH {EVENT} SELECT DISTINCT userId, movieId FROM event WHERE event_type <> 'error'")
def stream_dedup_first(spark, folder):
    """Which of several rows of a key comes first is open within a batch, so only keys are compared."""
    base = run_ratings(spark, folder, mode="first")
    return ingest.rating_store(spark, base).read().select("userId", "movieId")


@query("stream_dedup_within", f"WITH {EVENT} SELECT DISTINCT userId, movieId FROM event WHERE event_type <> 'error'")
def stream_dedup_within(spark, folder):
    """Repeats within the watermark's delay are dropped, with the state of the keys on disk."""
    with ingest.disk_state(spark):
        base = run_ratings(spark, folder, mode="within")
    return ingest.rating_store(spark, base).read().select("userId", "movieId")


@query("stream_movie_stats", f"WITH {STREAM_RATING}, {stats('s', 'stream_rating')} SELECT * FROM s")
def stream_movie_stats(spark, folder):
    return plain(finish_stats(ingest.sums_store(spark, run_ratings(spark, folder)).read()))


@query("stream_refresh_stats", f"""WITH {STREAM_RATING}, {stats('s', 'stream_rating')}, {MOVIE}
SELECT movie.id, movie.title, COALESCE(s.avgRating, 0.0) AS avgRating,
       CAST(COALESCE(s.ratingCount, 0) AS INTEGER) AS ratingCount
FROM movie LEFT JOIN s ON s.movieId = movie.id""")
def stream_refresh_stats(spark, folder):
    """All ratings of the touched movies counted again, then shown with the movies."""
    base = run_ratings(spark, folder, how="recount")
    movies = ingest.current_movies(warehouse.movie(spark, folder), ingest.sums_store(spark, base).read())
    return plain(movies.select("id", "title", "avgRating", "ratingCount"))


@query("stream_items", METADATA_SQL)
def stream_items(spark, folder):
    """Item documents as a stream of messages, merged into a stored movie table."""
    base = work_dir(spark, "items")
    movies = ingest.movie_store(spark, base)
    movies.write(warehouse.movie(spark, folder), 0)
    items = flatten_items(warehouse.item_documents(warehouse.stream_table(spark, folder, "part")))
    messages = to_message(items.withColumn("tmdbId", F.concat(F.lit("t"), "tmdbId")))
    source = ingest.item_stream(parse_message(messages, schemas.ITEM_EVENT))
    writer = ingest.items_batch(movies, f"{base}/rejects", now=warehouse.moment(warehouse.NOW), ids=ingest.id_store(spark, base))
    checkpoint = ingest.checkpoint_dir(f"{base}/checkpoints", "movies-ingest")
    ingest.start_ingest(source, writer, checkpoint, trigger=None).awaitTermination()
    return plain(movies.read())


LATE_PARTS, LATE_DELAY = 3, 30 * 86400


@query("stream_late_ratings", f"""WITH {EVENT},
parts AS (SELECT *, event_id % {LATE_PARTS} AS part FROM event WHERE event_type <> 'error'),
marks AS (
  SELECT p.part, max(t.timestamp) - {LATE_DELAY} AS mark
  FROM (SELECT DISTINCT part FROM parts) p LEFT JOIN parts t ON t.part < p.part GROUP BY p.part),
told AS (SELECT userId, movieId, rating, timestamp, COALESCE(timestamp < mark, FALSE) AS late FROM parts JOIN marks USING (part)),
kept AS (
  SELECT userId, movieId, CAST(CAST(rating AS DECIMAL(2,1)) AS DOUBLE) AS rating, timestamp, late FROM told WHERE NOT late
  QUALIFY row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC, told.rating DESC) = 1)
SELECT * FROM kept UNION ALL SELECT userId, movieId, rating, timestamp, late FROM told WHERE late""")
def stream_late_ratings(spark, folder):
    """The events arrive in three batches. Those behind the clock are set aside with their text, the others are stored:
    together all events there are, but for ratings given again."""
    base = work_dir(spark, "late")
    ledger = ingest.Ledger(ingest.ingest_counts_store(spark, base, "ratings"), ingest.clock_store(spark, base), LATE_DELAY, f"{base}/late")
    writer = ingest.ratings_batch(ingest.rating_store(spark, base), ingest.sums_store(spark, base), f"{base}/rejects",
                                  now=warehouse.moment(warehouse.NOW), ledger=ledger)
    events = warehouse.table(spark, folder, "events")
    for part in range(LATE_PARTS):  # the stream takes what has arrived since its last run as one batch
        arrived = events.where(F.pmod("event_id", F.lit(LATE_PARTS)) == part)
        warehouse.rating_messages(arrived).select(F.col("value").cast("string")).write.mode("append").text(f"{base}/in")
        parsed = parse_message(stream_text(spark, f"{base}/in"), schemas.RATING_EVENT)
        ingest.start_ingest(ingest.rating_stream(parsed), writer, f"{base}/checkpoint", trigger=None).awaitTermination()
    kept = ingest.rating_store(spark, base).read().select(*EVENT_COLUMNS).withColumn("late", F.lit(False))
    late = parse_message(spark.read.schema("value string").text(f"{base}/late"), schemas.RATING_EVENT).drop("raw")
    return plain(kept).unionByName(late.withColumn("late", F.lit(True)))


@query("stream_both_counts", f"""WITH {EVENT}
SELECT 'ratings' AS stream, count(*) FILTER (event_type <> 'error') AS imported, count(*) FILTER (event_type = 'error') AS rejected,
       CAST(0 AS BIGINT) AS late FROM event
UNION ALL SELECT 'items', count(*) FILTER (p_size <> 9), count(*) FILTER (p_size = 9), 0 FROM part""")
def stream_both_counts(spark, folder):
    """Both streams side by side, one row for each with what became of its messages."""
    base = work_dir(spark, "both")
    ratings = warehouse.rating_messages(warehouse.stream_table(spark, folder, "events"))
    part = warehouse.stream_table(spark, folder, "part")
    items = to_message(flatten_items(warehouse.item_documents(part.where("p_size <> 9"))))
    broken = part.where("p_size = 9").select(F.concat(F.lit("broken "), "p_partkey").cast("binary").alias("value"))
    sources = parse_message(ratings, schemas.RATING_EVENT), parse_message(items.unionByName(broken), schemas.ITEM_EVENT)
    ingest.supervise(ingest.start_all_streams(*sources, base, f"{base}/checkpoints", trigger=None, now=warehouse.moment(warehouse.NOW)))
    return ingest.ingest_totals(spark, base)


@query("stream_resolve_ids", f"""WITH {EVENT}, {MOVIE}
SELECT event.userId, 't' || event.movieId AS tmdbId, event.rating, movie.id AS movieId
FROM event JOIN movie ON movie.tmdbId = 't' || event.movieId""")
def stream_resolve_ids(spark, folder):
    """Rating events joined to the movie table while they stream."""
    base = work_dir(spark, "resolved")
    events = warehouse.rating_events(warehouse.stream_table(spark, folder, "events"))
    named = events.select("userId", F.concat(F.lit("t"), "movieId").alias("tmdbId"), "rating")
    resolved = resolve_stream_ids(named, warehouse.movie(spark, folder)).select("userId", "tmdbId", "rating", "movieId")
    resolved.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(resolved.schema).parquet(f"{base}/out")


@query("stream_trending_closed", f"""WITH {EVENT},
counts AS (SELECT timestamp // 86400 * 86400 AS start, movieId, count(*) AS n FROM event GROUP BY 1, 2)
SELECT start, movieId, n, CAST(row_number() OVER (PARTITION BY start ORDER BY n DESC, movieId) AS INTEGER) AS place
FROM counts WHERE start + 86400 <= (SELECT max(timestamp) FROM event) - 86400 QUALIFY place <= 10""")
def stream_trending_closed(spark, folder):
    """The ten most rated movies of every day that the watermark has passed, each day written once."""
    base = work_dir(spark, "closed")
    events = warehouse.rating_events(warehouse.stream_table(spark, folder, "events"))
    timed = events.withColumn("eventTime", event_time(F.col("timestamp"))).withWatermark("eventTime", "1 day")
    lists = trending_closed(timed)
    lists.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start(f"{base}/out").awaitTermination()
    return plain(spark.read.schema(lists.schema).parquet(f"{base}/out"))


@query("stream_trending", f"""WITH {EVENT}
SELECT timestamp // 86400 * 86400 AS start, movieId, count(*) AS n FROM event GROUP BY 1, 2""")
def stream_trending(spark, folder):
    """Counts per day and movie, kept up to date by the stream: each batch replaces the counts it changed."""
    base = work_dir(spark, "trending")
    events = warehouse.rating_events(warehouse.stream_table(spark, folder, "events"))
    timed = events.withColumn("eventTime", event_time(F.col("timestamp"))).withWatermark("eventTime", "1 day")
    counts = trending_counts(timed)
    table = ingest.counts_store(spark, f"{base}/counts")
    ingest.start_ingest(counts, ingest.counts_batch(table), f"{base}/checkpoint", trigger=None).awaitTermination()
    return plain(table.read())
