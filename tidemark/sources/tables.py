"""Readers and writers.  Every reader takes a declared or stored schema; nothing is inferred."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import path_exists, scratch_path


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def file_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(latest modification time, total length) over a file or all files below a folder."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop_path, True)
    latest, total = 0, 0
    while files.hasNext():
        status = files.next()
        latest, total = max(latest, status.getModificationTime()), total + status.getLen()
    return latest, total


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, base: str, name: str, inputs: Sequence[str],
           build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A derived table, written once per application and rebuilt when an input file changes."""
    stamp = (spark.sparkContext.applicationId, base, name,
             *[file_stamp(spark, f"{base}/{t}.parquet") for t in inputs])
    path = _STORED.get(stamp)
    if path is None or not path_exists(spark, path):
        path = scratch_path(spark, name)
        build(spark, base).write.parquet(path)
        _STORED[stamp] = path
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """CSV scan with NaN and blanks as NULL; without a schema every column is text.

    ``columns`` prunes the scan.  A missing file is an error, as for any Spark read.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Dataset not found at {path}")
    reader = spark.read.option("header", "true").option("nullValue", "").option("nanValue", "NaN")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if schema is not None:
        df = nan_to_null(df)
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """SQL NULL is the only missing value inside the engine."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
        for c in df.columns
    ])


def resolve_data_dir(spark: SparkSession, candidates: Sequence[str], env: str = "CHURN_DATA_DIR") -> str:
    """First existing folder of: the environment variable, then the candidates."""
    options = [p for p in [os.environ.get(env), *candidates] if p]
    return next((p for p in options if path_exists(spark, p)), options[-1])


def first_available(spark: SparkSession, sources: Sequence[tuple[str, str]],
                    prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ordered source selection: of (format, path) candidates the first one that exists, reads and can be prepared.

    A candidate is read up to its first row, so that one that is there but broken is passed over; ``prepare`` may
    refuse one by raising.  If none is left, the error names each candidate and what was wrong with it.
    """
    wrong: list[str] = []
    for fmt, path in sources:
        if not path_exists(spark, path):
            wrong.append(f"{path}: not there")
            continue
        try:
            df = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
            df = df if prepare is None else prepare(df)
            df.limit(1).collect()
            return df
        except (PySparkException, Py4JJavaError, ValueError) as error:
            wrong.append(f"{path}: {str(error).splitlines()[0]}")
    raise FileNotFoundError("no source can be used: " + "; ".join(wrong))


def write_splits(df: DataFrame, path: str, by: Sequence[str] = ("industry", "split"),
                 fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write rows partitioned by industry and split; the label stays in its row."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)


def read_split(spark: SparkSession, path: str, industry: str | None = None, split: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Read splits back; both filters prune partitions before any file is opened."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if industry is not None:
        df = df.where(F.col("industry") == industry)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def augmented(base: DataFrame, *increments: DataFrame) -> DataFrame:
    """Base rows plus all increments, matched by column name; absent columns are NULL."""
    out = base
    for inc in increments:
        out = out.unionByName(inc, allowMissingColumns=True)
    return out


def sample_head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (a top-k, never a full sort)."""
    return df.orderBy(*order).limit(n)


def file_catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per file below ``path``: name, path, kind, row count and size in KB.

    The count needs no column values, so the scan reads file footers only.
    """
    df = spark.read.parquet(path)
    return (
        df.groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_size").alias("bytes"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("name", "path", F.lit(kind).alias("kind"), "rows",
                F.round(F.col("bytes") / 1024, 1).alias("size_kb"))
    )


def export_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Decision report sink: one record per scored row."""
    df.write.mode("errorifexists").format(fmt).option("header", "true").save(path)


def record_frame(spark: SparkSession, payload: str, schema: T.StructType) -> DataFrame:
    """One JSON record as a one-row table, for the same operators a batch goes through."""
    raw = spark.range(1).select(F.from_json(F.lit(payload), schema).alias("r"))
    return raw.select("r.*")
