"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, materialize, slices
from tidemark.llm.features import SHARES, rows_of

TREES = 200
#: Rows a tree is grown from; all trees take ``TREES * TREE_ROWS`` rows at most, those with the smallest hashes.
TREE_ROWS = 64
#: Trees over all statistics; as many columns dilute a tree, there are more of them.
WIDE_TREES = 400
#: The statistics that are split on, the first ``NARROW`` of them by a forest of their own as well.
SPLIT_ON = tuple(SHARES.index(x) for x in ("symbols", "repeats", "upper", "marks", "dup_lines", "digits", "top_word", "distinct"))
NARROW = 4
#: Ranges of scores by which labelled rows are counted.
RANGES = 2000
MIN_WORDS = 50
#: Share of good labelled rows that the method may reject at most.
LOSS = 0.005

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counts, shares = rows_of(bytes_of(batch.column(1)))
            flat = pa.array(shares[:, SPLIT_ON].reshape(-1))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * len(SPLIT_ON)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), x],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, STATS)


def mean_depth(n: int) -> float:
    """Expected depth of an unsuccessful search among ``n`` keys."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays: split column (-1 at a leaf), split value, first child, path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.column, self.value, self.child, self.depth = [], [], [], []
        self.roots = []
        self.size = min(size, len(rows))
        rows = rows[rng.permutation(len(rows))]
        for t in range(trees if len(rows) else 0):
            take = np.arange(t * self.size, (t + 1) * self.size) % len(rows)
            self.roots.append(self._grow(rows[take], rng))
        self.column, self.child = np.array(self.column, np.int64), np.array(self.child, np.int64)
        self.value, self.depth = np.array(self.value), np.array(self.depth)

    def _node(self) -> int:
        for store, empty in ((self.column, -1), (self.value, 0.0), (self.child, -1), (self.depth, 0.0)):
            store.append(empty)
        return len(self.column) - 1

    def _grow(self, rows: np.ndarray, rng) -> int:
        limit = math.ceil(math.log2(max(2, self.size)))
        root = self._node()
        open_nodes = [(root, rows, 0)]
        while open_nodes:
            node, own, level = open_nodes.pop()
            low, high = own.min(0), own.max(0)
            varied = np.flatnonzero(high > low)
            if level >= limit or len(own) <= 1 or not len(varied):
                self.depth[node] = level + mean_depth(len(own))
                continue
            c = int(rng.choice(varied))
            cut = float(rng.uniform(low[c], high[c]))
            self.column[node], self.value[node] = c, cut
            a, b = self._node(), self._node()
            self.child[node] = a
            below = own[:, c] <= cut
            open_nodes += [(a, own[below], level + 1), (b, own[~below], level + 1)]
        return root

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1: the shorter the mean path, the higher."""
        if not self.roots or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                c = self.column[at]
                inner = np.flatnonzero(c >= 0)
                if not len(inner):
                    break
                right = rows[inner, c[inner]] > self.value[at[inner]]
                at[inner] = self.child[at[inner]] + right
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / max(mean_depth(self.size), 1e-9))


class Forests:
    """A forest over the first ``NARROW`` columns and one over all; a row is as odd as the forest says that finds it odder."""

    def __init__(self, rows: np.ndarray):
        self.narrow, self.wide = Forest(rows[:, :NARROW]), Forest(rows, WIDE_TREES)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.narrow.scores(rows[:, :NARROW]), self.wide.scores(rows))


def threshold(counts: dict[tuple[int, int], int], ranges: int, loss: float) -> float:
    """The least score to reject from: most bad rows beyond it, less the share of good ones, which is ``loss`` at most.

    ``counts`` has the labelled rows by (range of scores, quality).  Without bad labelled rows nothing is rejected.
    """
    good, bad = np.zeros(ranges + 1), np.zeros(ranges + 1)
    for (r, quality), n in counts.items():
        (good if quality else bad)[r] += n
    if not bad.sum():
        return math.inf
    above = lambda x: np.cumsum(x[::-1])[::-1] / max(1.0, x.sum())
    lost, caught = above(good), above(bad)
    gain = np.where(lost <= loss, caught - lost, -1.0)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return best / ranges if gain[best] > 0 else math.inf


def calibrated(scored: DataFrame, labels: DataFrame, loss: float, ranges: int = RANGES) -> float:
    """The threshold for ``doc_id, score`` from all labelled rows; a document with differing labels is a bad one."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = scored.join(known, "doc_id").groupBy(
        F.floor(F.col("score") * ranges).cast("int").alias("r"), F.col("quality").cast("int").alias("q")).agg(
        F.count(F.lit(1)).alias("n")).collect()
    return threshold({(min(ranges, r["r"]), r["q"]): r["n"] for r in found}, ranges, loss)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  loss: float = LOSS) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, anomaly (the forests' score).

    A null or empty text has no words and fails the base rules; repeated rows are judged alike; a
    column of ``docs`` other than id and text plays no part; without labels only the base rules reject.
    """
    stats = materialize(rule_statistics(docs, id_col, text_col).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "rules")
    # twice as many as wanted by a range of hashes, so that no task sends more than its part
    share = min(1.0, 2 * TREES * TREE_ROWS / max(1, stats.count()))
    drawn = stats.where("n_words > 0").select("x", F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 40)).alias("h"))
    sample = drawn.where(F.col("h") < int(share * (1 << 40))).orderBy("h").limit(TREES * TREE_ROWS).collect()
    forest = Forests(np.array([r[0] for r in sample], np.float64).reshape(len(sample), len(SPLIT_ON)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SPLIT_ON))
            columns = [*batch.columns[:-1], pa.array(forest.scores(rows), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "anomaly"])

    plain = [c for c in stats.columns if c != "x"]
    kinds = ", ".join(f"{c} {t}" for c, t in stats.dtypes if c != "x")
    scored = materialize(stats.select(*plain, "x").mapInArrow(run, f"{kinds}, anomaly double"), "anomalies")
    least = calibrated(scored.where("not base_failed").select("doc_id", F.col("anomaly").alias("score")), labels, loss)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(least)))
