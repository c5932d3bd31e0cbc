"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MIN_BUCKETS = 16


def local_session(cpus: int | str = 8, app: str = "shiftlens") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _local_folder() -> str:
    return "file:" + tempfile.mkdtemp(prefix="shiftlens-")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/shiftlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached plan this survives lost executors, and the file sizes give
    the optimizer a checked size when it chooses a join strategy.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """Power of two that follows the shuffle width, for order-preserving buckets."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = MIN_BUCKETS
    while buckets < 2 * width:
        buckets *= 2
    return buckets
