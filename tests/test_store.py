"""Versions and buckets of stored tables."""

import os

from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.sources.store import KeyedTable

SCHEMA = "k bigint, v string"


def open_table(spark, folder, buckets=4, spread=None):
    return KeyedTable(spark, folder + "/t", schemas.struct(k=schemas.LONG, v=schemas.TEXT), ["k"], buckets, spread)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def make(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_merge_and_replay(spark, folder):
    table = open_table(spark, folder)
    assert table.read().count() == 0
    table.merge(make(spark, (1, "a"), (2, "b")), 1, ["v"])
    table.merge(make(spark, (2, "c"), (3, "d")), 2, ["v"])
    assert rows(table.read()) == [(1, "a"), (2, "c"), (3, "d")]
    table.merge(make(spark, (1, "never")), 2, ["v"])
    assert rows(table.read()) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(table.read(before=2)) == [(1, "a"), (2, "b")]


def written(spark, folder, commit):
    return spark.read.parquet(f"{folder}/t/{commit}").count()


def test_a_batch_writes_its_own_rows(spark, folder):
    table = open_table(spark, folder, buckets=16)
    table.write(spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("v")), 0)
    update = spark.range(1990, 2020).select(F.col("id").alias("k"), F.lit("y").alias("v"))
    table.merge(update, 1, ["v"])
    assert written(spark, folder, "v=1.1") == 30
    assert table.read().count() == 2020 and table.read().where("v = 'y'").count() == 30
    one = make(spark, (3, "z"))
    files = table.read(of=one).inputFiles()
    assert {name.split("bucket=")[1].split("/")[0] for name in files if "bucket=" in name} == {
        str(r[0]) for r in one.select(table.bucket()).collect()}
    assert rows(table.read(of=one)) == [(3, "x")]
    table.merge(one, 2, ["v"])
    table.compact("whole")
    before = rows(table.read())
    table.merge(make(spark, (3, "again")), 3, ["v"])
    assert written(spark, folder, "v=4.3") == 1
    assert rows(table.read()) == sorted([row for row in before if row[0] != 3] + [(3, "again")], key=repr)


def test_updates_without_a_key_are_kept_apart(spark, folder):
    table = open_table(spark, folder)
    table.merge(make(spark, (None, "a"), (None, "a"), (1, "b")), 0, ["v"])
    table.merge(make(spark, (None, "c"), (1, "d")), 1, ["v"])
    assert rows(table.read()) == [(1, "d"), (None, "a"), (None, "a"), (None, "c")]
    table.compact("whole")
    table.merge(make(spark, (None, "e")), 2, ["v"])
    assert rows(table.read()) == [(1, "d"), (None, "a"), (None, "a"), (None, "c"), (None, "e")]


def test_unfinished_version_is_ignored_and_written_again(spark, folder):
    table = open_table(spark, folder)
    table.merge(make(spark, (1, "a")), 1, ["v"])
    table.merge(make(spark, (1, "half"), (2, "half")), 2, ["v"])
    os.remove(f"{folder}/t/v=1.2/_SUCCESS")
    os.remove(f"{folder}/t/v=1.2/._SUCCESS.crc")
    assert rows(table.read()) == [(1, "a")]
    table.merge(make(spark, (1, "b")), 2, ["v"])
    assert rows(table.read()) == [(1, "b")]


def test_compact_and_expire(spark, folder):
    table = open_table(spark, folder)
    for version in range(4):
        table.merge(make(spark, (version, "a"), (0, f"{version}")), version, ["v"])
    before = rows(table.read())
    table.compact("compacted")
    table.expire(keep=1)
    assert table.commits() == ["0", "1", "2", "3", "compacted"] and rows(table.read()) == before
    assert sorted(os.listdir(f"{folder}/t/v=0.0")) == ["._SUCCESS.crc", "_SUCCESS"]
    assert os.path.exists(f"{folder}/t/s=4.compacted/_SUCCESS")
    table.merge(make(spark, (0, "never")), 3, ["v"])  # replayed after its data is gone
    table.merge(make(spark, (9, "later")), 4, ["v"])
    assert rows(table.read()) == sorted([*before, (9, "later")], key=repr)


def test_writers_with_the_same_batch_numbers(spark, folder):
    table = open_table(spark, folder)
    table.merge(make(spark, (1, "a")), "one-0", ["v"])
    table.merge(make(spark, (2, "b")), "two-0", ["v"])
    table.merge(make(spark, (3, "c")), "one-0", ["v"])
    assert rows(table.read()) == [(1, "a"), (2, "b")]


def test_null_keys_are_spread(spark, folder):
    schema = schemas.struct(k=schemas.TEXT, id=schemas.LONG)
    table = KeyedTable(spark, folder + "/t", schema, ["k"], 8, spread="id")
    table.write(spark.range(100).select(F.lit(None).cast("string").alias("k"), "id"), 0)
    buckets = [name for name in os.listdir(f"{folder}/t/s=0.0") if name.startswith("bucket=")]
    assert len(buckets) == 8 and table.read().count() == 100


def test_empty_update(spark, folder):
    table = open_table(spark, folder)
    table.merge(make(spark, (1, "a")), 1, ["v"])
    table.merge(spark.createDataFrame([], SCHEMA), 2, ["v"])
    assert table.committed(2) and rows(table.read()) == [(1, "a")]
