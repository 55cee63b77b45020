"""Quality rules: every base statistic has a part in the verdict."""

import random

from tests.llm.cases import documents
from tidemark.llm import rules


def test_lines_digits_and_single_words_are_rejected(spark):
    base, rng = "/root/testdata/sf0.01", random.Random(6)
    pick = lambda n: [f"word{rng.randrange(4000)}" for _ in range(n)]
    planted = {
        -1: "\n".join(" ".join(pick(8)) if k % 2 else "read more" for k in range(120)),
        -2: "\n".join(" ".join(str(rng.randrange(10**6, 10**9)) for _ in range(12)) for _ in range(30)),
        -3: " ".join(w for p in pick(200) for w in ("again", p)),
    }
    docs = documents(spark, base).select("doc_id", "text").union(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, spark.read.parquet(f"{base}/labels.parquet")).where("doc_id < 0").collect()}
    assert not any(got[k]["base_failed"] or got[k]["kept"] for k in planted)
