"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize as written

#: Ranges an exact distributed rank counts rows by; its one-task prefix sum reads at most this many rows a group.
RANK_BUCKETS = 1024

__all__ = ["RANK_BUCKETS", "boxed", "bytes_of", "discard", "materialize", "ranked", "slices", "small_batches", "table", "unboxed"]


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the files of a written intermediate that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, group: str, order: list[str], name: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add ``name``: a gapless rank from 0 within ``group`` (never null), whatever a group's size.

    Rows go to hash buckets of their order columns; bucket counts are summed up to offsets
    (at most ``buckets`` rows a group), and only the rows of one bucket of one group are numbered
    together.  The rank follows (bucket, order columns); equal rows are numbered in any order.
    """
    slot = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (slot.join(offsets, [group, "_bucket"])
            .withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
            .drop("_bucket", "_before"))


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a Python worker remembers from task to task: one thing at a time, so that memories do not add up."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    _KEPT.clear()


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``SLICE_BYTES`` instead of ten thousand rows, for the jobs that run inside."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, with batches of texts kept small."""
    with small_batches(df.sparkSession):
        return written(df, name)


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one struct ``doc`` beside named keys, so that no column of theirs can clash; ``unboxed`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[k.alias(n) for n, k in keys.items()])


def unboxed(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc.*")


#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4_000_000


def slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE_BYTES`` of a text column, a longer text by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(a, b - a)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
