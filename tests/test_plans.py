"""What the plans must and must not contain."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from tastemill.operators.aggregates import movie_stats, refresh_stats, stats_after_delete
from tastemill.operators.filters import check_ratings, sample_users
from tastemill.operators.joins import resolve_stream_ids, user_ratings_view, user_recs_view
from tastemill.operators import pages
from tastemill.operators.ranking import rank_recommendations
from tastemill.operators.upsert import changed_values, upsert_ratings
from tastemill.plans.registry import QUERIES
from tastemill.sources import warehouse

FOLDER = "/root/testdata/sf0.001"
# These run jobs while they are built; the pieces they use are covered by the others.
RUNS_JOBS = {"als_rmse", "als_topn", "als_default_shape", "als_topn_shape", "batch_als", "batch_als_shape", "csv_catalogue", "first_load", "item_json", "ingest_summary", "score_topn", "score_topn_unseen", "als_unseen_shape", "als_time_split", "malformed_lines", "deep_pages", "ratings_page_1000",
             "item_cosine", "similar_items", "upsert_catalogue", "upsert_metadata", "upsert_users"}
PLAIN = sorted(n for n in QUERIES if n not in RUNS_JOBS and not n.startswith("stream_"))


@contextlib.contextmanager
def settings(spark, **conf):
    keys = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", PLAIN)
def test_no_pairs_and_no_python(spark, name):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, name
    assert "BroadcastExchange" not in text, f"{name} broadcasts without asking for the size"


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(sample_users(warehouse.rating_log(spark, FOLDER), 50).select("userId", "rating"))
    assert "LessThanOrEqual(o_custkey,50)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_statistics_are_combined_before_the_shuffle(spark):
    text = plan(movie_stats(spark.createDataFrame([(1, 2.0)], "movieId bigint, rating double")))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_ranks_are_cut_before_the_shuffle(spark):
    scored = spark.createDataFrame([(1, 1, 2.0)], "userId bigint, movieId bigint, score double")
    text = plan(rank_recommendations(scored, 5))
    assert text.count("WindowGroupLimit") == 2


def hot_ratings(spark, rows=60_000):
    """A third of all ratings are of one movie."""
    i = F.col("id")
    return spark.range(0, rows, 1, 8).select(
        (i % 5000).alias("userId"),
        F.when(i % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(400))).alias("movieId"),
        (1 + i % 9 * 0.5).cast("decimal(2,1)").alias("rating"),
        F.timestamp_seconds(i).alias("created_at"))


def movies(spark):
    card = {name: F.lit("x") for name in ("title", "genres", "posterUrl")}
    return spark.range(400).withColumns({**card, "year": F.lit(2000)})


SMALL_PARTS = dict(
    spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    spark__sql__adaptive__advisoryPartitionSizeInBytes="20kb", spark__sql__shuffle__partitions="16",
    spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="50kb",
    spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    spark__sql__adaptive__coalescePartitions__enabled="false")


def test_popular_movie_is_split_in_joins(spark):
    with settings(spark, **SMALL_PARTS):
        view = user_ratings_view(hot_ratings(spark), movies(spark)).select("userId", "movieId", "rating")
        text = final_plan(view)
        assert "skew=true" in text
        assert view.count() == 60_000


@pytest.mark.parametrize("view", ["recommendations", "validation", "stream ids"])
def test_popular_movie_is_split_next_to_an_aggregate(spark, folder, view):
    """The dimension is an aggregate over a file, so it is partitioned by the key before the join."""
    movies(spark).withColumns({"id": F.col("id"), "tmdbId": F.concat(F.lit("t"), "id"), "avgRating": F.lit(1.0),
                               "description": F.lit("d")}).write.parquet(f"{folder}/movies")
    hot_ratings(spark).withColumns({"algorithm": F.lit("ALS"), "score": F.lit(1.0), "rank": F.lit(1),
                                    "tmdbId": F.concat(F.lit("t"), "movieId")}).write.parquet(f"{folder}/ratings")
    dimension, facts = spark.read.parquet(f"{folder}/movies"), spark.read.parquet(f"{folder}/ratings")
    with settings(spark, **SMALL_PARTS):
        rest = [c for c in dimension.columns if c != "id"]
        grouped = dimension.groupBy("id").agg(*(F.max(c).alias(c) for c in rest))
        joined = {"recommendations": lambda: user_recs_view(facts, grouped), "validation": lambda: check_ratings(facts, grouped),
                  "stream ids": lambda: resolve_stream_ids(facts.drop("movieId"), dimension)}[view]()
        assert "skew=true" in final_plan(joined)
        assert joined.count() == 60_000


def test_busy_user_is_split_when_users_are_deleted(spark, folder):
    """Ratings are read once, and those of a user with half of them go to several tasks whether the user is deleted or not."""
    hot_ratings(spark).select(F.col("movieId").alias("userId"), F.col("userId").alias("movieId"), "rating").write.parquet(f"{folder}/hot")
    spark.range(0, 400, 3).union(spark.range(0, 400, 3)).write.parquet(f"{folder}/ids")
    ratings, ids = spark.read.parquet(f"{folder}/hot"), spark.read.parquet(f"{folder}/ids")
    with settings(spark, **SMALL_PARTS):
        changed = stats_after_delete(ratings, ids)
        assert plan(changed).count("FileScan") == 2
        assert "skew=true" in final_plan(changed)
        lost = ratings.join(ids, ratings["userId"] == ids["id"], "left_semi").select("movieId").distinct()
        assert changed.count() == lost.count() > 0


@pytest.mark.parametrize("small", [False, True])
def test_a_merge_reads_its_inputs_once(spark, folder, small):
    """The target is scanned once, or once more for its keys alone where a small batch is looked up."""
    rows = hot_ratings(spark, 3000).withColumn("timestamp", F.lit(1).cast("bigint")).dropDuplicates(["userId", "movieId"])
    rows.write.parquet(f"{folder}/target")
    rows.write.parquet(f"{folder}/updates")
    target, updates = spark.read.parquet(f"{folder}/target"), spark.read.parquet(f"{folder}/updates")

    def scans(df):
        with settings(spark, spark__sql__maxMetadataStringLength="2000"):
            lines = [line for line in plan(df).splitlines() if "FileScan" in line]
        return [sum(f"{folder}/{name}" in line for line in lines) for name in ("target", "updates")]

    assert scans(upsert_ratings(target, updates, small_updates=small)) == ([2, 3] if small else [1, 1])
    assert scans(changed_values(target, updates, ["userId", "movieId"], "rating", ["timestamp"])) == [1, 2]


def test_a_deep_page_reads_one_range(spark, folder):
    numbers = spark.range(0, 5000, 1, 8).select((F.col("id") * 7919 % 5000).alias("id"))
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="16"):
        pages.store_pages(numbers, [F.col("id").desc()], folder)
    page = pages.read_page(spark, folder, 100, 20)
    assert [r.id for r in page.orderBy("position").collect()] == list(range(3019, 2999, -1))
    assert "Offset" not in plan(page) and len(spark.read.parquet(f"{folder}/directory").collect()) == 16
    assert re.search(r"PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ = \d+\)\]", plan(page))
    assert pages.read_page(spark, folder, 251, 20).count() == 0


def test_latest_ratings_are_not_sorted(spark):
    for name in ("rating_table", "upsert_ratings"):
        assert "SortAggregate" not in plan(QUERIES[name](spark, FOLDER)), name


def test_refresh_counts_before_it_joins(spark):
    ratings = hot_ratings(spark)
    stale = movies(spark).select("id", F.lit(None).cast("decimal(3,2)").alias("avgRating"),
                                 F.lit(None).cast("int").alias("ratingCount"))
    batch = spark.range(400).select(F.col("id").alias("movieId"))
    with settings(spark, **SMALL_PARTS):
        fresh = refresh_stats(ratings, stale, batch)
        text = plan(fresh)
        # The semi join reads aggregated rows: no shuffle below the partial aggregate of the ratings.
        assert text.index("LeftSemi") < text.index("partial_sum")
        counts = {r["id"]: r["ratingCount"] for r in fresh.collect()}
    full = {r["movieId"]: r["ratingCount"] for r in movie_stats(ratings).collect()}
    assert counts == {i: full.get(i) for i in range(400)}
