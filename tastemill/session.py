"""Session set-up and the shared working folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tastemill", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    Joins on popular movies or busy users lean on adaptive skew splitting, so it is switched on
    here even when it costs one more exchange downstream.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder of its own,
    which is remembered in the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tastemill.local.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tastemill-")
        spark.conf.set("tastemill.local.dir", configured)
    return configured.rstrip("/")


def enable_checkpoints(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` and ALS lineage cuts use the shared folder."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it learns of them when the driver collects
    its garbage, which a driver that only waits for its executors seldom does."""
    gc.collect()  # plans that Python still names are kept
    with contextlib.suppress(Py4JJavaError):  # so are those of events that listeners have not been told of, if it takes them long
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a new folder below the shared one, so that the shuffles which made them can go."""
    place = work_dir(df.sparkSession, name)
    df.write.parquet(place)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(place)
