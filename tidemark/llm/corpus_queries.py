"""The corpus operators over the given tables: one query each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bytebpe, collocations, hardneg, lmscore, minhash, mixing, packing, rans, rules, secrets, sharding, simhash, topk,
    weaklabel)
from tidemark.llm.common import materialize, table

CONTEXT = 1024
SHINGLE_WORDS = 3


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), CONTEXT)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "tokens", "epoch", "block", "position", "weight")


def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i])) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, frequencies = rans.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return rans.digest(spark, path, frequencies)


def isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _collocation_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lengths = "\nUNION ALL ".join(
        f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS phrase FROM w"
        for n in range(1, 6))
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS ({lengths}),
f AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, ws, size, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
             (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ws[1:size - 1], ' ') AS phrase, f FROM f WHERE size > 2
      UNION ALL SELECT lang, array_to_string(ws[2:], ' '), f FROM f WHERE size > 2),
z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.f >= 100 * b.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardneg.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, r.vec_id, q.label = r.label AS same,
             CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i])) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weaklabel.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints within 2 bits (those of ``op5``) or similar shingle sets connect."""
    found = materialize(simhash.near_duplicates(docs, SHINGLE_WORDS).select("key", "root").distinct(), "united")
    return minhash.one_of_each_similar(docs, united=found)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), CONTEXT)


QUERIES = {
    "op1_label_sharding": label_sharding, "op2_best_fit_packing": best_fit_packing, "op3_quality_classifier": quality_classifier,
    "op4_temperature_mixing": temperature_mixing, "op5_simhash_near_duplicates": simhash_near_duplicates, "op6_exact_top_k": exact_top_k,
    "op7_token_files": token_files, "op8_isolation_rules": isolation_rules, "op9_owned_secrets": owned_secrets,
    "op10_backoff_scores": backoff_scores, "op11_phrase_collocations": phrase_collocations,
    "op12_hard_negatives": hard_negative_mining, "op13_byte_level_bpe": byte_level_bpe,
}
ORACLES = {"op6_exact_top_k": TOP_K_SQL.strip(), "op11_phrase_collocations": _collocation_sql().strip(),
           "op12_hard_negatives": HARD_NEGATIVE_SQL.strip()}
