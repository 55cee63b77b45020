"""The registered queries and the pipeline over the smallest tables."""

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.cases import awkward, empty
from tidemark.llm.corpus_queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, rows_of


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)


def test_queries_with_sql(spark, base):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, base)
        res = con.execute(sql)
        columns = [d[0] for d in res.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


def test_stages_in_order(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    from tidemark.session import materialize

    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, base), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    good, distinct, scanned, mixed = counts[1:]
    assert counts[0] > good > distinct == scanned <= mixed
    assert corpus_pipeline.run(spark, base).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_with_awkward_rows(spark, base):
    for make in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, make(spark), base)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == make(spark).columns
            out.collect()
