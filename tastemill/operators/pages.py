"""Pages of a long sorted list without an offset.

The list is stored once in ranges of its order, with a directory of how many rows each range has. A page is found in the
directory and read from the one or two ranges it lies in, whatever its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators.numbering import ROW_BITS


def store_pages(df: DataFrame, order: Sequence[Column], path: str) -> None:
    """Store the rows in this order, which has to be total, and the directory of its ranges."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumns({"range": F.spark_partition_id(), "place": place}).write.partitionBy("range").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, page: int, size: int = 20) -> DataFrame:
    """The rows of a page, numbered from 1, with ``position`` in the whole list from 0."""
    low, high, before, wanted = (page - 1) * size, page * size, 0, {}
    for row in spark.read.parquet(f"{path}/directory").orderBy("range").collect():  # a row for each range
        if before < high and before + row["n"] > low:
            wanted[row["range"]] = before
        before += row["n"]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("range").isin(list(wanted)))
    first = F.coalesce(*[F.when(F.col("range") == k, F.lit(n)) for k, n in wanted.items()], F.lit(0)).cast("bigint")
    numbered = rows.withColumn("position", first + F.col("place"))
    return numbered.where((F.col("position") >= low) & (F.col("position") < high)).drop("range", "place")
