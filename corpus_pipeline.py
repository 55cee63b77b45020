"""A training corpus from raw documents, in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import corpus_queries as Q

STAGES = [
    ("quality classifier", Q.keep_good),
    ("simhash near-dedup", Q.drop_near_duplicates),
    ("secret scans", Q.redact_secrets),
    ("mixing sources", Q.mix_sources),
    ("best-fit packing", Q.pack_sequences),
]

#: Several stages can't be said in SQL; tests check them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    from tidemark.session import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
