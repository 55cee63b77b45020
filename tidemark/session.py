"""Session helpers: local sessions for tests and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tidemark", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)  # made above, by this process only
    return _LOCAL_FOLDERS[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Spread rows over all cores, in ``least`` partitions or more, ahead of a step that expands each of them many times.

    A small file is one partition, and adaptive execution would merge a plain repartition
    back into one by its size before the expansion.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):
        parts = min(parts, spark.sparkContext.defaultParallelism)
    return df.repartition(max(parts, least), *keys)


#: Rows that one task of a pass over a classifier's rows takes at least.
PASS_ROWS = 100_000


def for_passes(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in as many partitions as thousands of short passes over them are worth: all cores only for many rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    needed = -(-n // PASS_ROWS)
    return df.repartition(max(1, needed if needed <= cores else cores * -(-needed // (cores * 8))))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Evaluate fitted statistics once: written to the shared folder, whatever their size.

    Later plans see the size of the files and broadcast them only if they are small.
    """
    return materialize(df, "pinned")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs follow on an expensive result: the written table
    survives the loss of executors, unlike a cached or locally checkpointed one.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
