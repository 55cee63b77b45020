"""The pipeline's near-duplicate stage goes by the fingerprints of op5 as well as by similar shingle sets."""

from tidemark.llm import minhash, simhash
from tidemark.llm.corpus_queries import SHINGLE_WORDS, drop_near_duplicates

WORDS = [f"w{k}" for k in range(400)]
FIRST, SECOND = (" ".join(WORDS[:3] * 100 + WORDS[k:k + 20]) for k in (20, 60))


def test_fingerprints_and_similar_sets_connect_a_group(spark, base):
    a, b = (simhash.fingerprint(t.encode(), SHINGLE_WORDS) & (1 << 64) - 1 for t in (FIRST, SECOND))
    assert (a ^ b).bit_count() <= 2 and not minhash.similar(*(minhash.shingles(t.encode()) for t in (FIRST, SECOND)), 0.8)
    third = SECOND + " tail"  # similar to the second, and so in the first one's group
    rows = [(5, FIRST), (7, SECOND), (8, third), (9, " ".join(WORDS[100:200])), (None, SECOND)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in minhash.one_of_each_similar(docs).collect()} == {5, 7, 9}
    assert {r["doc_id"] for r in drop_near_duplicates(spark, docs, base).collect()} == {5, 9}
