"""Gapless numbering of a large table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import enable_checkpoints

ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition in the low 33 bits


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... by ``key``, which has to be unique.

    Range partitions are numbered on their own and shifted by the sizes of those before them. The
    partitions are checkpointed, so sizes and numbers belong together even if an executor is lost.
    """
    enable_checkpoints(df.sparkSession)
    ranged = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    numbered = ranged.withColumn("row_mark", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("row_mark", ROW_BITS)
    rows = numbered.withColumn("part", part).withColumn(
        "place", F.col("row_mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    sizes = rows.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so neither the window nor the broadcast grows with the data.
    shifts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    return rows.join(F.broadcast(shifts), "part").select(
        *df.columns, (F.col("place") + F.col("shift")).alias(name))
