"""A sample of registered queries against their oracles; tools/check_oracle.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SAMPLE = ["customer_360", "industry_kpis", "feature_medians", "kfold_assign", "clean_features", "conformal_coverage",
          "knn_join", "what_if", "score_batch", "stream_score_batch", "augment_counts", "risk_set_table"]


@pytest.fixture(scope="module")
def con(base):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, base, con, name):
    df = entry.queries()[name](spark, base)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())
    assert sorted(df.columns) == sorted(columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
