"""Arriving files: stateless scoring and incremental augmentation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bridge import FeatureBridge
from tidemark.operators.scoring import decisions
from tidemark.operators.serving import ServingState, score_with
from tidemark.session import materialize, scratch_path


def arriving(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
             files_per_batch: int = 64) -> DataFrame:
    """A stream of the files landing in ``path``; the schema is declared, never inferred."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("header", "true").format(fmt).load(path)


def score_arriving(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Score everything that has arrived through the batch projection; exactly-once file sink."""
    spark = stream.sparkSession
    scored = score(stream)
    job = (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


def append_arriving(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Append prepared rows per micro-batch; a replayed batch replaces its own partition."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    job = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.parquet(out)


CORRUPT = "_corrupt_record"


def arriving_csv(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream of CSV files with a declared schema; a line that does not fit it keeps its text in ``_corrupt_record``."""
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(declared).option("maxFilesPerTrigger", files_per_batch).option("header", "true")
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path).select(
        "*", F.col("_metadata.file_path").alias("_file"))


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def decide_arriving(stream: DataFrame, state: ServingState, uploaded: Sequence[str], out: str, quarantine: str, checkpoint: str,
                    key: str = "customer_id") -> None:
    """Score arriving CSV rows by a saved state, as a batch would: sets, evidence from the references, and the what-if.

    A micro-batch is written into a partition of its own below ``out``, its unreadable lines below ``quarantine``; a
    replayed batch replaces both.  ``uploaded`` are the columns that the decisions carry along.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch, "arrived")
        bad = F.col(CORRUPT).isNotNull()
        rows.where(bad).select(F.col(CORRUPT).alias("line"), F.col("_file").alias("file")).write.mode("overwrite").parquet(
            f"{quarantine}/batch_id={batch_id}")
        # the batch's columns are known: only the state's industry is looked at, and nothing is fitted
        _, scored = score_with(state, rows.where(~bad).drop(CORRUPT, "_file"), key=key)
        kept = FeatureBridge(state.industry).mapping(rows.drop(CORRUPT, "_file"))
        decisions(scored, [F.col(kept[c]).alias(c) for c in uploaded]).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(stream, write, checkpoint)


def first_labels(stream: DataFrame, key: str, by: Sequence[str], out: str, checkpoint: str, keep: str = "30 days") -> DataFrame:
    """Append the first row of each ``key`` and count them by group; later copies change nothing.

    The keys met are Spark's keyed state; a key is forgotten once files are ``keep`` younger than its own.  Rows go to
    ``out``/rows, what each micro-batch adds to the counts to ``out``/counts, each batch into a partition that a replay
    replaces.  Which of several copies within one micro-batch comes first is open.  Returns the counts.
    """
    spark = stream.sparkSession
    fresh = stream.select("*", F.col("_metadata.file_modification_time").alias("_arrived")).withWatermark("_arrived", keep) \
        .dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.drop("_arrived").write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        rows = spark.read.parquet(f"{out}/rows/batch_id={batch_id}")
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")

    _run(fresh, write, checkpoint)
    return spark.read.parquet(f"{out}/counts").groupBy(*by).agg(F.sum("n").alias("n"))


def running_counts(stream: DataFrame, by: Sequence[str], checkpoint: str | None = None) -> DataFrame:
    """Running row counts of a small fixed set of groups, as of the last micro-batch."""
    spark = stream.sparkSession
    name = f"counts_{uuid.uuid4().hex}"
    job = (stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete")
           .format("memory").queryName(name)
           .option("checkpointLocation", checkpoint or scratch_path(spark, "counts-checkpoint"))
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.table(name)
