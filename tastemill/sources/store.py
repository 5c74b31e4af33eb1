"""Keyed tables kept as Parquet, one folder per commit.

    <path>/v=<number>.<name of the commit>/part-*                    rows that the commit sets
    <path>/s=<number>.<name of the commit>/bucket=<hash of key>/part-*  the whole table

A commit has a name that its writer chooses (a stream: query and micro-batch) and the next free number. A merge stores
the rows it changes and nothing else; readers take the last whole table and the last row of each key set since. ``compact``
stores a whole table, in a job of its own beside or between the merges. Spark's ``_SUCCESS`` file makes a commit count; one that was cut
short is written again, and a name that is there already is not written twice. So a replayed micro-batch changes
nothing, while another query, or a new checkpoint, has names of its own and loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.operators.upsert import touched_rows, upsert
from tastemill.schemas import conform

COMMITTED = "_SUCCESS"
ROWS, WHOLE = "v", "s"


class KeyedTable:
    """A table with a unique key, numbered commits and one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 8,
                 spread: str | None = None):
        """``buckets`` parts of a whole table can be read by themselves; ``spread`` names a column that deals out the
        rows whose key is null."""
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        self.spread = spread
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._fs_path(folder)
        return [status.getPath().getName() for status in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _all(self) -> list[tuple[int, str, str]]:
        """Number, name and kind of all commits, complete or not, in order; one listing."""
        found = []
        for folder in self._names(self.path):
            kind, _, rest = folder.partition("=")
            number, _, name = rest.partition(".")
            if kind in (ROWS, WHOLE):
                found.append((int(number), name, kind))
        return sorted(found)

    def _folder(self, number: int, name: str, kind: str) -> str:
        return f"{self.path}/{kind}={number}.{name}"

    def _done(self, commit: tuple[int, str, str]) -> bool:
        return self._fs.exists(self._fs_path(f"{self._folder(*commit)}/{COMMITTED}"))

    def commits(self) -> list[str]:
        """Names of complete commits, the oldest first."""
        return [commit[1] for commit in self._all() if self._done(commit)]

    def committed(self, name: str | int) -> bool:
        return any(self._done(commit) for commit in self._all() if commit[1] == str(name))

    def bucket(self, keyed: bool = False) -> Column:
        """The bucket of a row; ``keyed`` for rows that have whole keys and perhaps no column to spread by."""
        keys = self.keys
        if self.spread:
            other = F.lit(None) if keyed else F.col(self.spread)
            keys = [F.coalesce(F.col(key).cast("string"), other.cast("string")) for key in keys]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _current(self, before: str | int | None) -> tuple[str | None, list[tuple[int, str, str]]]:
        """Folder of the last whole table, and the commits since."""
        known = self._all()
        end = next((number for number, name, _ in known if name == str(before)), None) if before is not None else None
        since: list[tuple[int, str, str]] = []
        for commit in reversed(known):
            if (end is not None and commit[0] >= end) or not self._done(commit):
                continue
            if commit[2] == WHOLE:
                return self._folder(*commit), since[::-1]
            since.append(commit)
        return None, since[::-1]

    def _parquet(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, before: str | int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The table now, or as it was before a commit; ``of`` takes only the rows with the keys of some updates, out of the
        buckets these fall into."""
        whole, since = self._current(before)
        names = self._names(whole) if whole else []
        if whole and of is not None:
            wanted = {f"bucket={row[0]}" for row in of.dropna(subset=self.keys).select(self.bucket(True).alias("b")).distinct().collect()}  # at most all buckets
            names = [name for name in names if name in wanted]
        stored = self._parquet([f"{whole}/{name}" for name in names if name.startswith("bucket=")], self.schema)
        if of is not None:
            stored = touched_rows(stored, of, self.keys)
        if not since:
            return stored
        numbered = T.StructType([*self.schema, T.StructField("commit_number", T.LongType())])
        changed = self._parquet([self._folder(*commit) for commit in since], numbered)
        if of is not None:
            changed = touched_rows(changed, of, self.keys)
        keyed = reduce(and_, [F.col(key).isNotNull() for key in self.keys])
        rest = [name for name in self.schema.names if name not in self.keys]
        last = changed.where(keyed).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "commit_number").alias("last")).select(
            *self.keys, "last.*").select(*self.schema.names)
        kept = stored.join(changed.where(keyed).select(*self.keys).distinct(), self.keys, "left_anti").select(*self.schema.names)
        return kept.unionByName(last).unionByName(changed.where(~keyed).select(*self.schema.names))

    def _write(self, df: DataFrame, name: str, kind: str) -> None:
        known = self._all()
        number = next((number for number, other, _ in known if other == name), known[-1][0] + 1 if known else 0)
        rows = conform(df, self.schema)
        if kind == ROWS:
            rows.withColumn("commit_number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(self._folder(number, name, kind))
        else:
            # Rebalancing gathers each bucket and splits it again where it is large.
            rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                self._folder(number, name, kind))

    def write(self, df: DataFrame, commit: str | int) -> None:
        """Store the whole table as a commit unless it is complete already."""
        if not self.committed(commit):
            self._write(df, str(commit), WHOLE)

    def append(self, rows: DataFrame, commit: str | int) -> None:
        """Store rows that replace those of their keys, unless the commit is complete already."""
        if not self.committed(commit):
            self._write(rows, str(commit), ROWS)

    def merge(self, updates: DataFrame, commit: str | int, update_cols: Sequence[str], **how) -> None:
        """Insert or update by key; only rows with a key of the updates are looked up and written."""
        if not self.committed(commit):
            self.append(upsert(self.read(before=commit, of=updates), updates, self.keys, update_cols, **how), commit)

    def compact(self, commit: str) -> None:
        """Store the whole table, for quicker reading."""
        self.write(self.read(before=commit), commit)

    def expire(self, keep: int = 2) -> None:
        """Delete the data no reader needs any more, but for the last ``keep`` commits; names stay known."""
        whole, since = self._current(None)
        needed = {whole, *(self._folder(*commit) for commit in since)}
        for commit in [commit for commit in self._all() if self._done(commit)][:-keep]:
            folder = self._folder(*commit)
            if folder not in needed:
                for name in self._names(folder):
                    if not name.endswith((COMMITTED, f"{COMMITTED}.crc")):
                        self._fs.delete(self._fs_path(f"{folder}/{name}"), True)
