"""Streams over small files, one file per micro-batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.functions.documents import parse_message
from tastemill.operators.aggregates import finish_stats, stat_sums
from tastemill.sources import kafka
from tastemill.sources.files import stream_text
from tastemill.streaming import ingest

T0 = 1728600000


def put(folder, name, lines):
    """Add a file to the source folder; files are read in the order of their names' times."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name:04d}.json"
    with open(path, "w", encoding="utf-8") as out:
        out.writelines((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines)
    os.utime(path, (1_000_000 + name, 1_000_000 + name))


def rating(user, movie, stars, seconds):
    return {"userId": user, "movieId": movie, "rating": stars, "timestamp": seconds}


def run(spark, base, mode="latest", stats="delta", delay="10 minutes"):
    parsed = parse_message(stream_text(spark, f"{base}/in", max_files=1), schemas.RATING_EVENT)
    writer = ingest.ratings_batch(ingest.rating_store(spark, base, 2), ingest.sums_store(spark, base, 2),
                                  f"{base}/rejects", stats)
    query = ingest.start_ingest(ingest.rating_stream(parsed, mode, delay), writer,
                                ingest.checkpoint_dir(f"{base}/cp", mode), trigger=None)
    query.awaitTermination()


def stored(spark, base):
    table = ingest.rating_store(spark, base, 2).read()
    return {(r["userId"], r["movieId"]): (float(r["rating"]), r["timestamp"]) for r in table.collect()}


def sums(spark, base):
    return {r["movieId"]: (r["sum10"], r["n"]) for r in ingest.sums_store(spark, base, 2).read().collect()}


RERATED = [[rating(1, 1, 2.0, T0)], [rating(1, 1, 3.0, T0 + 1)], [rating(1, 1, 3.5, T0 + 2), rating(2, 1, 1.0, T0)],
           [rating(1, 1, 5.0, T0 + 3)]]


@pytest.mark.parametrize("mode, last", [("latest", 5.0), ("first", 2.0), ("within", 2.0)])
def test_rating_again(spark, folder, mode, last):
    for place, lines in enumerate(RERATED):
        put(f"{folder}/in", place, lines)
    run(spark, folder, mode)
    assert stored(spark, folder)[(1, 1)][0] == last
    assert sums(spark, folder) == {1: (int(last * 10) + 10, 2)}


@pytest.mark.parametrize("stats", ["delta", "recount"])
def test_restart_and_sums(spark, folder, stats):
    put(f"{folder}/in", 0, RERATED[0])
    run(spark, folder, stats=stats)
    for place, lines in enumerate(RERATED[1:], 1):
        put(f"{folder}/in", place, lines)
    run(spark, folder, stats=stats)
    assert stored(spark, folder) == {(1, 1): (5.0, T0 + 3), (2, 1): (1.0, T0)}
    full = stat_sums(ingest.rating_store(spark, folder, 2).read())
    assert sums(spark, folder) == {r["movieId"]: (r["sum10"], r["n"]) for r in full.collect()}
    before = ingest.rating_store(spark, folder, 2).commits()
    run(spark, folder, stats=stats)
    assert ingest.rating_store(spark, folder, 2).commits() == before


def test_older_rating_arriving_later_is_ignored(spark, folder):
    put(f"{folder}/in", 0, [rating(1, 1, 4.0, T0 + 10)])
    put(f"{folder}/in", 1, [rating(1, 1, 1.0, T0)])
    run(spark, folder)
    assert stored(spark, folder) == {(1, 1): (4.0, T0 + 10)}


def test_replayed_batch_changes_nothing(spark, folder):
    ratings, totals = ingest.rating_store(spark, folder, 2), ingest.sums_store(spark, folder, 2)
    write = ingest.ratings_batch(ratings, totals, query="batch")
    batch = spark.createDataFrame([(1, 1, 4.0, T0, "")], "userId bigint, movieId bigint, rating double, timestamp bigint, raw string")
    write(batch, 0)
    first = (stored(spark, folder), sums(spark, folder))
    write(batch, 0)
    assert (stored(spark, folder), sums(spark, folder)) == first
    # The ratings of batch 1 are stored, then the job dies before the sums are.
    again = batch.withColumn("rating", F.lit(2.0)).withColumn("timestamp", F.lit(T0 + 1).cast("bigint"))
    write(again, 1)
    os.remove(f"{folder}/rating_sums/v=1.batch-1/_SUCCESS")
    os.remove(f"{folder}/rating_sums/v=1.batch-1/._SUCCESS.crc")
    write(again, 1)
    assert sums(spark, folder) == {1: (20, 1)}


def test_unusable_values_are_set_aside(spark, folder):
    bad = ["oops", "{}", json.dumps({"userId": "x", "movieId": 1}), json.dumps(rating(1, 2, 70.0, T0))]
    put(f"{folder}/in", 0, bad + [rating(0, 0, 1.0, T0 * 1000)])
    run(spark, folder)
    assert stored(spark, folder) == {(0, 0): (1.0, T0)}
    kept = [r["value"] for r in spark.read.text(f"{folder}/rejects").collect()]
    assert sorted(kept) == sorted(bad)


def test_late_events(spark, folder):
    hour = T0 + 3600
    put(f"{folder}/in", 0, [rating(1, 1, 1.0, hour)])
    put(f"{folder}/in", 1, [rating(1, 2, 1.0, hour)])
    put(f"{folder}/in", 2, [rating(1, 3, 1.0, T0)])
    put(f"{folder}/in", 3, [rating(1, 4, 1.0, T0 + 2000), rating(1, 5, 1.0, T0 + 3590)])
    run(spark, folder, "first")
    assert sorted(movie for _, movie in stored(spark, folder)) == [1, 2, 5]


def test_reject_stream(spark, folder):
    put(f"{folder}/in", 0, ["junk", rating(1, 1, 3.0, T0)])
    parsed = parse_message(stream_text(spark, f"{folder}/in"), schemas.RATING_EVENT)
    ingest.reject_stream(parsed, "ratings").writeStream.format("text").option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    assert [r[0] for r in spark.read.text(f"{folder}/out").collect()] == ["junk"]


def test_a_batch_outside_a_stream_needs_a_name(spark, folder):
    with pytest.raises(ValueError):
        ingest.ratings_batch(ingest.rating_store(spark, folder), ingest.sums_store(spark, folder))(spark.range(1), 0)


def test_a_batch_writes_the_rows_it_touches(spark, folder):
    put(f"{folder}/in", 0, [rating(u, 1, 3.0, T0) for u in range(500)])
    run(spark, folder)
    ingest.rating_store(spark, folder, 2).compact("whole")
    put(f"{folder}/in", 1, [rating(u, 1, 4.0, T0 + 9) for u in range(490, 520)])
    run(spark, folder)
    last = ingest.rating_store(spark, folder, 2).commits()[-1]
    (name,) = [x for x in os.listdir(f"{folder}/rating") if x.endswith(last)]
    assert spark.read.parquet(f"{folder}/rating/{name}").count() == 30
    assert len(stored(spark, folder)) == 520 and sums(spark, folder) == {1: (490 * 30 + 30 * 40, 520)}


def test_late_rows_are_kept_and_counted(spark, folder):
    """An event more than ten minutes behind the latest of all earlier batches is late; a replay says so again."""
    hour = T0 + 3600
    batches = [[(1, 1, hour), (1, 2, T0)], [(1, 3, T0), (1, 4, hour - 600)], [(1, 5, hour - 601), (1, 6, hour + 9000)], [(1, 7, hour)]]
    ledger = ingest.Ledger(ingest.ingest_counts_store(spark, folder, "ratings"), ingest.clock_store(spark, folder), 600, f"{folder}/late")
    write = ingest.ratings_batch(ingest.rating_store(spark, folder, 2), ingest.sums_store(spark, folder, 2), ledger=ledger, query="q")
    for repeat in (0, 1):
        for k, events in enumerate(batches):
            rows = [(u, m, 3.0, t, f"{m}") for u, m, t in events]
            write(spark.createDataFrame(rows, "userId bigint, movieId bigint, rating double, timestamp bigint, raw string"), k)
        assert sorted(m for _, m in stored(spark, folder)) == [1, 2, 4, 6]
        assert sorted(r.value for r in spark.read.text(f"{folder}/late").collect()) == ["3", "5", "7"]
        counts = ledger.counts.read().agg(F.sum("imported"), F.sum("rejected"), F.sum("late")).first()
        assert tuple(counts) == (4, 0, 3)


def test_a_failing_stream_stops_the_other(spark, folder):
    put(f"{folder}/a", 0, ["x"])
    put(f"{folder}/b", 0, ["y"])

    def fails(batch, batch_id):
        raise RuntimeError("broken sink")

    started = [ingest.start_ingest(stream_text(spark, f"{folder}/{name}"), fn, f"{folder}/cp-{name}", "1 second")
               for name, fn in (("a", lambda batch, batch_id: None), ("b", fails))]
    with pytest.raises(Exception, match="broken sink"):
        ingest.supervise(started)
    assert not any(query.isActive for query in started)


def test_state_falls_when_the_watermark_passes(spark, folder):
    """Keys are forgotten ten minutes after they came, and late rows are counted by the query."""
    put(f"{folder}/in", 0, [rating(u, 1, 3.0, T0) for u in range(40)])
    with ingest.disk_state(spark):
        run(spark, folder, "within")
        full = ingest.state_rows(spark, f"{folder}/cp/within")
        put(f"{folder}/in", 1, [rating(100, 1, 3.0, T0 + 3600)])
        put(f"{folder}/in", 2, [rating(101, 1, 3.0, T0 + 3601)])
        run(spark, folder, "within")
    assert full == 40 and ingest.state_rows(spark, f"{folder}/cp/within") == 2
    assert len(stored(spark, folder)) == 42


def test_unknown_modes(spark):
    with pytest.raises(ValueError):
        ingest.dedup(spark.range(1), ["id"], "other")
    with pytest.raises(ValueError):
        ingest.ratings_batch(None, None, stats="other")


def item(key, title, **more):
    return {"tmdbId": key, "title": title, **more}


def test_items_and_both_streams(spark, folder):
    movies = ingest.movie_store(spark, folder, 2)
    known = spark.createDataFrame([(1, "old", "a", "ML"), (2, "other", None, "ML")],
                                  "id bigint, title string, tmdbId string, source string")
    for name in schemas.MOVIE.names:
        if name not in known.columns:
            known = known.withColumn(name, F.lit(None))
    movies.write(known, 0)
    put(f"{folder}/items", 0, [item("a", "new", avgRating=3.25, ratingCount=7), item(None, "no key"), item("b", None)])
    put(f"{folder}/items", 1, [item("c", "fresh"), item("a", "newer", avgRating=12.0)])
    put(f"{folder}/in", 0, [rating(5, 1, 4.0, T0), "junk"])
    sources = [parse_message(stream_text(spark, f"{folder}/{name}", 1), schema)
               for name, schema in (("in", schemas.RATING_EVENT), ("items", schemas.ITEM_EVENT))]
    ingest.supervise(ingest.start_all_streams(*sources, folder, f"{folder}/cp", trigger=None, buckets=2))
    totals = {r.stream: (r.imported, r.rejected, r.late) for r in ingest.ingest_totals(spark, folder).collect()}
    assert totals == {"ratings": (1, 1, 0), "items": (2, 3, 0)}
    shown = ingest.current_movies(movies.read(), ingest.sums_store(spark, folder, 2).read())
    rows = {r["id"]: (r["title"], r["tmdbId"], r["source"], None if r["avgRating"] is None else float(r["avgRating"]))
            for r in shown.collect()}
    assert rows == {1: ("new", "a", "ML", 4.0), 2: ("other", None, "ML", None), 3: ("fresh", "c", "TMDB", 0.0)}
    assert spark.read.text(f"{folder}/rejects/movies").count() == 3
    assert spark.read.text(f"{folder}/rejects/ratings").count() == 1


def test_arrival_time_comes_from_the_topic(spark):
    df = spark.createDataFrame([("{}", "2024-01-01 00:00:00")], "value string, timestamp string")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    parsed = parse_message(df, schemas.ITEM_EVENT, arrival="timestamp")
    assert ingest.with_arrival_time(parsed).first()["eventTime"] == parsed.first()["arrivedAt"]


def test_sums_and_stats(spark, folder):
    put(f"{folder}/in", 0, [rating(u, 1, 1.5, T0) for u in range(3)])
    run(spark, folder)
    row = finish_stats(ingest.sums_store(spark, folder, 2).read()).first()
    assert (float(row["avgRating"]), row["ratingCount"]) == (1.5, 3)


class Recorder:
    """Stands in for a reader or writer and notes what it is told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def option(self, key, value):
        self.told[key] = value
        return self

    def options(self, **more):
        self.told.update(more)
        return self

    def load(self):
        return self.result


def test_topic_reader_settings(spark):
    class Session:
        readStream = Recorder()

    Session.readStream.result = spark.createDataFrame([("{}", None)], "value string, timestamp timestamp")
    parsed = kafka.read_kafka_json(Session(), "host:1", "ratings", schemas.RATING_EVENT)
    assert parsed.columns == [*schemas.RATING_EVENT.names, "raw", "arrivedAt"]
    assert Session.readStream.told == {
        "format": "kafka", "kafka.bootstrap.servers": "host:1", "subscribe": "ratings", "startingOffsets": "latest"}


def test_the_later_event_of_an_item_counts(spark, folder):
    movies = ingest.movie_store(spark, folder, 2)
    columns = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ITEM_EVENT}
    events = spark.createDataFrame([("t1", "Zulu old", 1), ("t1", "Alpha new", 2), ("t2", "Same", 1), ("t2", "Same", 1)],
                                   "tmdbId string, title string, at int")
    batch = events.select(*(F.col(c) if c in ("tmdbId", "title") else columns[c] for c in columns),
                          F.timestamp_seconds("at").alias("eventTime"), F.lit("").alias("raw"))
    ingest.items_batch(movies, query="batch")(batch, 0)
    assert sorted((r["tmdbId"], r["title"]) for r in movies.read().collect()) == [("t1", "Alpha new"), ("t2", "Same")]


def test_batches_are_kept_in_many_parts(spark, folder, monkeypatch):
    """A batch that comes as one part is not read by one task in every step."""
    kept, spread = [], ingest.spread

    def counted(batch):
        kept.append(spread(batch))
        return kept[-1]

    monkeypatch.setattr(ingest, "spread", counted)
    rows = spark.range(100).select(F.col("id").alias("userId"), F.lit(1).cast("bigint").alias("movieId"), F.lit(3.0).alias("rating"),
                                   F.lit(10).cast("bigint").alias("timestamp"), F.lit("x").alias("raw")).coalesce(1)
    ingest.ratings_batch(ingest.rating_store(spark, folder, 2), ingest.sums_store(spark, folder, 2), query="q")(rows, 0)
    sizes = kept[0].rdd.glom().map(len).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1 and max(sizes) <= 75
    assert ingest.rating_store(spark, folder, 2).read().count() == 100
