"""Partitioned read of a table or query over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastemill.config import JdbcConfig

RATING_QUERY = "SELECT userId, movieId, rating FROM rating"


def read_jdbc_partitioned(spark: SparkSession, url: str, cfg: JdbcConfig, query: str = RATING_QUERY,
                          options: dict[str, str] | None = None) -> DataFrame:
    """Read ``query`` in ``cfg.partitions`` ranges of ``cfg.column``.

    The bounds only set the strides: rows outside them come with the first or last range. A filter
    on the result is pushed into the query by Spark, so the query itself needs none.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", f"({query}) AS ranged")
        .option("partitionColumn", cfg.column)
        .option("lowerBound", cfg.lower)
        .option("upperBound", cfg.upper)
        .option("numPartitions", cfg.partitions)
        .option("fetchsize", cfg.fetchsize)
        .options(**(options or {}))
        .load()
    )
