"""The rating stream and the item stream.

Both end in ``foreachBatch`` and make one commit to a keyed table per micro-batch, named after the query and
the batch, so a batch that is replayed after a failure changes nothing, and a query with a new checkpoint,
which counts its batches from 0 again, is a writer of its own. Each table has one writer: the
rating stream keeps ratings and their sums, the item stream keeps movies; ``current_movies`` puts the
two together. A batch looks up and writes the rows it touches and no others.

Every batch also commits what it did with its messages: how many it imported, rejected and set aside as late, and the
latest event time it has seen, from which the next batch knows what is late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastemill import schemas
from tastemill.config import StreamConfig
from tastemill.functions.times import epoch_seconds, event_time
from tastemill.operators.aggregates import add_stats, change_deltas, finish_stats, touched_sums
from tastemill.operators.filters import with_defaults
from tastemill.operators.upsert import (
    RATING_KEY,
    RATING_ORDER,
    apply_movie_stats,
    metadata_columns,
    stage_metadata,
    upsert,
    upsert_ratings,
)
from tastemill.sources.store import KeyedTable

# Columns that tell when an item event arrived, as far as a source has them; the later event of an item counts.
ARRIVAL_ORDER = ("eventTime", "partition", "offset", "arrival")
BatchFn = Callable[[DataFrame, int], None]


def rating_store(spark: SparkSession, base: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, f"{base}/rating", schemas.RATING, RATING_KEY, buckets)


def sums_store(spark: SparkSession, base: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, f"{base}/rating_sums", schemas.STAT_SUMS, ["movieId"], buckets)


def movie_store(spark: SparkSession, base: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, f"{base}/movie", schemas.MOVIE, ["tmdbId"], buckets, spread="id")


def clock_store(spark: SparkSession, base: str) -> KeyedTable:
    """The latest event time each stream has seen."""
    return KeyedTable(spark, f"{base}/clock", schemas.INGEST_CLOCK, ["stream"], 1)


def ingest_counts_store(spark: SparkSession, base: str, stream: str) -> KeyedTable:
    """What every batch of a stream did with its messages."""
    return KeyedTable(spark, f"{base}/counts/{stream}", schemas.INGEST_COUNTS, ["stream", "batch"], 1)


def id_store(spark: SparkSession, base: str) -> KeyedTable:
    """The highest id given out so far."""
    return KeyedTable(spark, f"{base}/last_id", schemas.LAST_ID, ["table"], 1)


def checkpoint_dir(base: str, name: str) -> str:
    """Every query has its own folder below the base."""
    return f"{base.rstrip('/')}/{name}"


def with_event_time(df: DataFrame, delay: str = StreamConfig.watermark) -> DataFrame:
    """Event time and watermark from the time stamp of the rating."""
    return df.withColumn("eventTime", event_time(F.col("timestamp"))).withWatermark("eventTime", delay)


def with_arrival_time(df: DataFrame, delay: str = StreamConfig.watermark) -> DataFrame:
    """Arrival time and watermark: what the topic recorded, or else the time of the batch; nothing is late."""
    arrived = F.col("arrivedAt") if "arrivedAt" in df.columns else F.current_timestamp()
    return df.withColumn("eventTime", arrived).withWatermark("eventTime", delay)


def dedup(df: DataFrame, keys: tuple[str, ...] | list[str], mode: str) -> DataFrame:
    """Repeated keys in a stream.

    ``latest`` lets everything through: the batch reduces repeats and the merge keeps the last.
    ``first`` lets only the first row of a key through for as long as the query lives, and its state
    grows with the keys. ``within`` does so within the watermark, with bounded state.
    """
    if mode == "latest":
        return df
    if mode == "first":
        return df.dropDuplicates(list(keys))
    if mode == "within":
        return df.dropDuplicatesWithinWatermark(list(keys))
    raise ValueError(f"unknown dedup mode {mode}")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state on the executors' disks, not in their memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def state_rows(spark: SparkSession, checkpoint: str) -> int:
    """How many keys the stateful operator of a query holds."""
    return spark.read.format("statestore").load(checkpoint).count()


def _usable_rating() -> Column:
    stars = F.col("rating").try_cast("decimal(2,1)")
    return reduce(and_, [c.isNotNull() for c in (F.col("userId"), F.col("movieId"), stars, F.col("timestamp"))])


def _usable_item() -> Column:
    average = F.coalesce("avgRating", F.lit(0.0)).try_cast("decimal(3,2)")
    return F.col("tmdbId").isNotNull() & F.col("title").isNotNull() & average.isNotNull()


def rating_stream(parsed: DataFrame, mode: str = "latest", delay: str = StreamConfig.watermark) -> DataFrame:
    """Parsed rating events ready for the batch writer.

    With a stateful mode only usable events enter the state; rejects then need ``reject_stream``.
    """
    usable = parsed if mode == "latest" else parsed.where(_usable_rating())
    return dedup(with_event_time(usable, delay), RATING_KEY, mode)


def item_stream(parsed: DataFrame, mode: str = "latest", delay: str = StreamConfig.watermark) -> DataFrame:
    usable = parsed if mode == "latest" else parsed.where(_usable_item())
    return dedup(with_arrival_time(usable, delay), ["tmdbId"], mode)


def reject_stream(parsed: DataFrame, kind: str) -> DataFrame:
    """The values of a topic that cannot be used, as text."""
    usable = _usable_rating() if kind == "ratings" else _usable_item()
    return parsed.where(~usable).select("raw")


def query_id(batch: DataFrame) -> str | None:
    """The id of the query that runs a micro-batch; it lives in the checkpoint, so a restart keeps it."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def commit_name(batch: DataFrame, batch_id: int, query: str | None = None) -> str:
    """Query and number of a micro-batch. Outside a stream the caller has to name the query."""
    query = query or query_id(batch)
    if not query:
        raise ValueError("no streaming query runs this batch: give the writer a name")
    return f"{query}-{batch_id}"


def spread(batch: DataFrame) -> DataFrame:
    """A batch dealt out evenly. A source of few files or topic partitions comes as few parts, however much their messages
    take up once they are parsed, and every step that reads the kept batch would do so in as few tasks."""
    return batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _keep_text(rows: DataFrame, folder: str | None, commit: str) -> None:
    if folder:
        rows.select("raw").write.mode("overwrite").text(f"{folder}/batch={commit}")


def late_before(clock: KeyedTable, commit: str, stream: str, delay: int) -> int | None:
    """Events older than this are late: ``delay`` seconds before the latest event of all earlier batches."""
    row = clock.read(before=commit).where(F.col("stream") == stream).first()
    return row["latest"] - delay if row and row["latest"] is not None else None


@dataclass(frozen=True)
class Ledger:
    """Where a stream keeps its counts, its clock and the text of late events; any may be left out.

    ``delay`` is in seconds. Without a clock no event is late.
    """

    counts: KeyedTable | None = None
    clock: KeyedTable | None = None
    delay: int = 600
    late: str | None = None

    def split(self, good: DataFrame, commit: str, stream: str) -> tuple[DataFrame, DataFrame]:
        """Events in time, and late ones. Both come from the batch alone and what earlier commits say, so a replay
        splits it the same way."""
        line = late_before(self.clock, commit, stream, self.delay) if self.clock else None
        seconds = epoch_seconds(F.col("timestamp"))
        return (good, good.limit(0)) if line is None else (good.where(seconds >= line), good.where(seconds < line))

    def close(self, batch: DataFrame, usable: Column, late: DataFrame, commit: str, stream: str) -> None:
        """Commit the counts, then the clock."""
        spark = batch.sparkSession
        if self.counts and not self.counts.committed(commit):
            n = batch.agg(F.count_if(usable).alias("good"), F.count(F.lit(1)).alias("n")).first()
            behind = late.count()
            self.counts.append(spark.createDataFrame(
                [(stream, commit, n["good"] - behind, n["n"] - n["good"], behind)], schemas.INGEST_COUNTS), commit)
        if self.clock and not self.clock.committed(commit):
            latest = batch.where(usable).agg(F.max(epoch_seconds(F.col("timestamp"))).alias("t")).first()["t"]
            earlier = late_before(self.clock, commit, stream, 0)
            seen = [t for t in (latest, earlier) if t is not None]
            self.clock.append(spark.createDataFrame([(stream, max(seen, default=None))], schemas.INGEST_CLOCK), commit)


def ratings_batch(ratings: KeyedTable, sums: KeyedTable, rejects: str | None = None, stats: str = "delta", now: Column | None = None,
                  ledger: Ledger = Ledger(), query: str | None = None) -> BatchFn:
    """Merge a batch of ratings, then bring the sums of the movies it touches up to date.

    ``delta`` adds what the merge changed, from the old and new rating of every touched key.
    ``recount`` sums all ratings of the touched movies again, which reads the whole rating table.
    """
    if stats not in ("delta", "recount"):
        raise ValueError(f"unknown stats mode {stats}")

    def run(batch: DataFrame, batch_id: int) -> None:
        commit = commit_name(batch, batch_id, query)
        batch = spread(batch).persist()
        before = None
        try:
            _keep_text(batch.where(~_usable_rating()), rejects, commit)
            good, late = ledger.split(batch.where(_usable_rating()), commit, "ratings")
            _keep_text(late, ledger.late, commit)
            events = good.select("userId", "movieId", F.col("rating").cast("decimal(2,1)").alias("rating"),
                                 epoch_seconds(F.col("timestamp")).alias("timestamp"))
            if not (ratings.committed(commit) and sums.committed(commit)):
                before = ratings.read(before=commit, of=events).persist()
                after = upsert_ratings(before, events, F.current_timestamp() if now is None else now, keep_newer=True, touch="always")
                ratings.append(after, commit)
                if stats == "delta":
                    changes = after.select(*RATING_KEY, F.col("rating").alias("new")).join(
                        before.select(*RATING_KEY, F.col("rating").alias("old")), list(RATING_KEY), "left")
                    sums.append(add_stats(sums.read(before=commit, of=events), change_deltas(changes)), commit)
                else:
                    sums.merge(touched_sums(ratings.read(), events), commit, ["sum10", "n"])
            ledger.close(batch, _usable_rating(), late, commit, "ratings")
        finally:
            batch.unpersist()
            if before is not None:
                before.unpersist()

    return run


def items_batch(movies: KeyedTable, rejects: str | None = None, overwrite_stats: bool = True, now: Column | None = None,
                ledger: Ledger = Ledger(), ids: KeyedTable | None = None, query: str | None = None) -> BatchFn:
    """Check a batch of item events, fill in defaults and merge them by external id.

    ``ids`` remembers the highest id given out, so only the first batch looks for it in the whole table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        commit = commit_name(batch, batch_id, query)
        batch = spread(batch).persist()
        try:
            _keep_text(batch.where(~_usable_item()), rejects, commit)
            good = batch.where(_usable_item())
            order = [name for name in ARRIVAL_ORDER if name in good.columns]
            events = with_defaults(good, {"avgRating": 0.0, "ratingCount": 0}).select(*schemas.ITEM_EVENT.names, *order)
            if not (movies.committed(commit) and (ids is None or ids.committed(commit))):
                known = ids.read(before=commit).first() if ids else None
                last = known["last"] if known else movies.read(before=commit).agg(F.max("id").alias("id")).first()["id"] or 0
                stored = movies.read(before=commit, of=events)
                staged = stage_metadata(events, stored, F.lit(last).cast("bigint"))
                merged = upsert(stored, staged, movies.keys, metadata_columns(overwrite_stats), order_by=order, touch="always",
                                now=F.current_timestamp() if now is None else now)
                movies.append(merged, commit)
                if ids:
                    new = merged.agg(F.max("id").alias("id")).first()["id"]
                    ids.append(batch.sparkSession.createDataFrame([("movie", max(last, new or 0))], schemas.LAST_ID), commit)
            ledger.close(batch, _usable_item(), batch.limit(0), commit, "items")
        finally:
            batch.unpersist()

    return run


def rejects_batch(folder: str) -> BatchFn:
    """Keep the text of rejected messages, a folder for each batch; a replayed batch writes its folder again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.select("raw").write.mode("overwrite").text(f"{folder}/batch={commit_name(batch, batch_id)}")

    return run


def counts_store(spark: SparkSession, path: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(spark, path, schemas.TREND_COUNTS, ["start", "movieId"], buckets)


def counts_batch(counts: KeyedTable) -> BatchFn:
    """Keep the newest count of every span and movie the batch brings."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            counts.merge(batch, commit_name(batch, batch_id), ["n"])
        finally:
            batch.unpersist()

    return run


def start_ingest(df: DataFrame, fn: BatchFn, checkpoint: str, trigger: str | None = StreamConfig.trigger,
                 name: str | None = None) -> StreamingQuery:
    """Run a stream into a batch writer; without a trigger it takes what is there and stops."""
    writer = df.writeStream.foreachBatch(fn).outputMode("update").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def start_all_streams(rating_source: DataFrame, item_source: DataFrame, base: str, checkpoints: str,
                      cfg: StreamConfig = StreamConfig(), trigger: str | None = StreamConfig.trigger,
                      buckets: int = 8, now: Column | None = None) -> list[StreamingQuery]:
    """Both ingests side by side, from parsed sources; ``supervise`` waits for them.

    In a stateful mode unusable messages do not reach the batches, so two more streams keep them.
    """
    spark = rating_source.sparkSession
    ratings, sums = rating_store(spark, base, buckets), sums_store(spark, base, buckets)
    movies = movie_store(spark, base, buckets)
    started = [
        start_ingest(rating_stream(rating_source, cfg.dedup, cfg.watermark),
                     ratings_batch(ratings, sums, f"{base}/rejects/ratings", now=now,
                                   ledger=Ledger(ingest_counts_store(spark, base, "ratings"))),
                     checkpoint_dir(checkpoints, "ratings-ingest"), trigger),
        start_ingest(item_stream(item_source, cfg.dedup, cfg.watermark),
                     items_batch(movies, f"{base}/rejects/movies", now=now, ids=id_store(spark, base),
                                 ledger=Ledger(ingest_counts_store(spark, base, "items"))),
                     checkpoint_dir(checkpoints, "movies-ingest"), trigger),
    ]
    if cfg.dedup != "latest":
        for source, kind, name in ((rating_source, "ratings", "ratings"), (item_source, "items", "movies")):
            started.append(start_ingest(reject_stream(source, kind), rejects_batch(f"{base}/rejects/{name}"),
                                        checkpoint_dir(checkpoints, f"{name}-rejects"), trigger))
    return started


def supervise(queries: Sequence[StreamingQuery], every: float = 1.0) -> None:
    """Wait until all queries have ended. When one fails the others are stopped and its error is raised."""
    running = list(queries)
    try:
        while running:
            for query in list(running):
                if query.awaitTermination(every / len(running)):
                    running.remove(query)
    finally:
        for query in running:
            query.stop()


def ingest_totals(spark: SparkSession, base: str) -> DataFrame:
    """Per stream: messages imported, rejected and late over all its batches."""
    each = [ingest_counts_store(spark, base, name).read() for name in ("ratings", "items")]
    return each[0].unionByName(each[1]).groupBy("stream").agg(*(F.sum(c).alias(c) for c in ("imported", "rejected", "late")))


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that stateful operators of a query dropped as late, over the progress it remembers."""
    return sum(state.get("numRowsDroppedByWatermark", 0) for progress in query.recentProgress for state in progress["stateOperators"])


def current_movies(movies: DataFrame, sums: DataFrame) -> DataFrame:
    """Movies with the average and count of their own ratings where they have any."""
    return apply_movie_stats(movies, finish_stats(sums))
