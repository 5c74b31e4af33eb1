"""Message topics. The connector jar comes with the cluster; tests feed the same columns from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tastemill.functions.documents import parse_message, to_message

# Delivery settings of the sink: wait for all replicas, try three times.
SINK_OPTIONS = {"kafka.acks": "all", "kafka.retries": "3"}


def read_kafka_json(spark: SparkSession, servers: str, topic: str, schema: T.StructType,
                    starting: str = "latest") -> DataFrame:
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return parse_message(source, schema, arrival="timestamp")


def write_kafka_json(df: DataFrame, servers: str, topic: str) -> None:
    to_message(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic).options(**SINK_OPTIONS).save()


def stream_kafka_json(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return (
        to_message(df).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .options(**SINK_OPTIONS)
        .option("checkpointLocation", checkpoint)
        .start()
    )
