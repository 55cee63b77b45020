"""Sharding, mixing and packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import awkward, documents, empty, lower
from tidemark.llm import mixing, packing, sharding
from tidemark.llm.corpus_queries import tokenizer_file


def check_shards(docs, found, shards):
    rows = found.collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r[0]].append(r[1])
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(shards)]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, 1 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, ts in texts.items() for t in ts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    return rows


@pytest.mark.parametrize("make", [awkward, empty])
def test_shards_of_awkward_rows(spark, make):
    docs = make(spark)
    check_shards(docs, sharding.shard_documents(docs, shards=3), 3)


def test_equal_texts_share_a_shard(spark, base):
    docs = documents(spark, base)
    rows = check_shards(docs, sharding.shard_documents(docs, shards=8), 8)
    text = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) == 0


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    docs = spark.createDataFrame([(i, "copy" if i < 600 else f"text {i // 2}" if i < 700 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    rows = check_shards(docs, sharding.shard_documents(docs, shards=5), 5)
    shards = Counter(r["shard"] for r in rows if r["doc_id"] < 600)
    assert len(shards) <= 4  # three shards hold it; one more where pieces do not fit exactly
    pairs = defaultdict(set)
    for r in rows:
        if 600 <= r["doc_id"] < 700:
            pairs[r["doc_id"] // 2].add(r["shard"])
    assert sum(len(v) > 1 for v in pairs.values()) <= 5


@pytest.mark.parametrize("make", [awkward, documents])
def test_mixture(spark, base, make):
    docs = make(spark, base) if make is documents else make(spark)
    from tests.llm.cases import WORDS

    rows = mixing.mix(docs, repeats=1.5, block_tokens=500).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r["source"]] += len(WORDS.findall(r["text"] or "")) + 1
    given = Counter()
    for r in rows:
        given[r["source"]] += r["tokens"]
    weight = {r["source"]: r["weight"] for r in rows}
    assert set(given) == set(tokens) and abs(sum(weight.values()) - 1) < 1e-9
    longest = max(r["tokens"] for r in rows)
    least = max(tokens[s] / weight[s] for s in tokens)
    for s in tokens:
        quota = weight[s] * least
        assert quota <= given[s] + 1 and given[s] <= quota + longest * docs.count()
        assert quota / tokens[s] <= 1.5 * (1 + 1e-5)
    seen = Counter((r["doc_id"], r["source"]) for r in rows if r["epoch"] == 0)
    assert seen == Counter((r["doc_id"], r["source"]) for r in docs.collect())  # every row is taken at least once
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["block"]].append(r["position"])
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values())


def test_exponent_meets_entropy_and_repetition(spark):
    sources = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "source string, share double")
    share = np.array([0.7, 0.2, 0.1])

    def entropy(a):
        w = share ** a / (share ** a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.exponent(sources, entropy=1.0)
    assert abs(entropy(a) - 1.0) < 1e-5
    a = mixing.exponent(sources, repeats=2.0)
    r = share ** (a - 1)
    assert abs(r.max() / r.min() - 2.0) < 1e-4
    assert mixing.exponent(sources, entropy=5.0) == 0.0 or entropy(mixing.exponent(sources, entropy=5.0)) <= 5.0


def test_mixture_of_nothing_and_budget(spark, base):
    assert mixing.mix(empty(spark)).count() == 0
    docs = documents(spark, base)
    rows = mixing.mix(docs, budget=5000, block_tokens=1000)
    assert 5000 <= rows.agg({"tokens": "sum"}).first()[0]
    longest = rows.agg({"tokens": "max"}).first()[0]
    total = rows.agg({"tokens": "sum"}).first()[0]
    assert 5000 <= total < 5000 + longest
    blocks = rows.groupBy("block").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest")).collect()
    assert sorted(r["block"] for r in blocks) == list(range(len(blocks)))
    assert all(r["n"] < 1000 + r["longest"] for r in blocks)


@pytest.mark.parametrize("budget", [300, 2500, None])
def test_a_stream_in_order_of_time(spark, budget):
    """Against the same stream made by hand: sources give documents at the pace of their weights."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 7 % 13)), "abc"[min(i % 7, 2)]) for i in range(120)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, budget=budget, block_tokens=100).collect()
    weight = {r["source"]: r["weight"] for r in rows}
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(r["text"].split()) + 1
    wanted = budget or max(size[s] / weight[s] for s in size)
    key = {(r["doc_id"], e): r["h"] for e in range(9) for r in docs.select(
        "doc_id", F.xxhash64(F.lit(11), F.lit(e), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    text = {r["doc_id"]: r for r in docs.collect()}
    order = []
    for s in size:
        at = 0
        for e in range(9):
            for i in sorted((i for i in text if text[i]["source"] == s), key=lambda i: key[i, e]):
                order.append((at / weight[s], i, e, len(text[i]["text"].split()) + 1, s))
                at += order[-1][3]
    quota = {s: -(-weight[s] * wanted // 1) if budget else max(round(weight[s] * wanted), size[s]) for s in size}
    total, want = 0, set()
    for t, i, e, n, s in sorted(order):
        if t * weight[s] < quota[s] - 1e-9 and (budget is None or total < budget):
            want.add((i, e))
            total += n
    assert {(r["doc_id"], r["epoch"]) for r in rows} == want


def test_mixed_documents_keep_columns_and_repeat_rows(spark):
    docs = awkward(spark)
    found = mixing.mixed_documents(docs, repeats=3.0)
    assert found.columns == docs.columns
    rows = Counter(tuple(r) for r in found.collect())
    assert set(rows) == {tuple(r) for r in docs.collect()}


def pieces_of(text, encode, limit):
    ids = encode(text or "") + [2]
    out, start = [], 0
    for k, n in enumerate(packing.cut(len(ids), limit)):
        out.append((k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
        start += n
    return out


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_packing(spark, base, make):
    docs = make(spark, base) if make is documents else make(spark)
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 1024, with_ids=True)
    got = rows.collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want.update((r[0], *p) for p in pieces_of(r[1], lambda t: library.encode(t, add_special_tokens=False).ids, 1024))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    if make is documents:
        assert len(by) <= -(-total // 1024) + 3
    assert sum(r["n_tokens"] for r in packing.sequences(rows).collect()) == total


def least_sequences(histogram, limit):
    """No packing has fewer: pieces too long to share a sequence, and the volume of the others beyond the room beside them."""
    def bound(short):
        alone = sum(n for k, n in histogram.items() if k > limit - short)
        half = {k: n for k, n in histogram.items() if limit / 2 < k <= limit - short}
        rest = sum(k * n for k, n in histogram.items() if short <= k <= limit / 2)
        beside = sum(n * (limit - k) for k, n in half.items())
        return alone + sum(half.values()) + max(0, -(-(rest - beside) // limit))

    return max(bound(short) for short in range(limit // 2 + 1))


def test_packing_is_near_the_bound(spark, base):
    docs = documents(spark, base.replace("sf0.001", "sf0.01"))
    rows = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 1024)
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    least = least_sequences(histogram, 1024)
    assert least <= rows.select("sequence_id").distinct().count() <= 1.003 * least


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(40):
        limit = int(rng.integers(4, 60))
        histogram = {int(x): int(rng.integers(1, 30)) for x in rng.integers(1, limit + 1, 12)}
        plan = packing.plan(histogram, limit)
        used = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= limit
            for x in pattern:
                used[x] += times
        assert used == Counter(histogram)
        best = sum(t for _, t in packing.best_fit(np.array([histogram.get(k, 0) for k in range(limit + 1)]), limit))
        assert least_sequences(histogram, limit) <= sum(t for _, t in plan) <= min(best, 1.05 * least_sequences(histogram, limit) + 2)


def test_lower_is_ascii_only():
    assert lower("ÀB") == "Àb"
