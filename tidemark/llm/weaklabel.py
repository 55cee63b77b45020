"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Their votes are counted by pattern over
the whole corpus (at most ``3 ** labellers`` patterns), and expectation-maximisation over the patterns
estimates how each labeller votes on good and on bad documents.  The posteriors of the patterns label a
bounded sample that trains a linear scorer on hashed features, which then judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bytes_of, kept, materialize, slices
from tidemark.llm.features import SHARES, rows_of
from tidemark.llm.rules import calibrated

#: Labellers: statistic, bad from, good up to (a pair the other way round is bad below); between them no vote.
LABELLERS = (
    ("symbols", 0.08, 0.005), ("repeats", 0.5, 0.1), ("dup_lines", 0.4, 0.05), ("upper", 0.5, 0.2),
    ("marks", 0.2, 0.1), ("top_word", 0.25, 0.12), ("digits", 0.2, 0.05), ("distinct", 0.35, 0.9),
)
BUCKETS = 1 << 13
#: Documents that the scorer is fitted on, at most.
FIT_ROWS = 8_000
ROUNDS = 200
#: Share of good labelled rows that the scorer may reject at most.
LOSS = 0.005
#: Bytes of a word that are looked at as one; a longer one counts as several, so that none of its bytes is unseen.
PIECE = 64
#: Words whose features a Python worker keeps.
CACHE_WORDS = 200_000


def votes(shares: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A pattern per document: a base-3 digit per labeller, 0 none, 1 good, 2 bad; a text without words gets bad from all."""
    out = np.zeros(len(shares), np.int64)
    for name, bad, good in LABELLERS:
        x = shares[:, SHARES.index(name)]
        low = bad < good
        vote = np.where((x <= bad) if low else (x >= bad), 2, np.where((x >= good) if low else (x <= good), 1, 0))
        out = out * 3 + np.where(n_words == 0, 2, vote)
    return out


def estimate(patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = ROUNDS) -> dict[int, float]:
    """P(bad) of each pattern by expectation-maximisation over class-conditional votes."""
    if not patterns:
        return {}
    keys = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[k] for k in keys.tolist()], np.float64)
    digit = keys[:, None] // 3 ** np.arange(labellers - 1, -1, -1) % 3
    one = (digit[:, :, None] == np.arange(3)).astype(np.float64)
    bad = np.where((digit == 2).any(1), 0.9, 0.05)
    for _ in range(rounds):
        classes = np.stack([1 - bad, bad]) * n
        prior = (classes.sum(1) + 1) / (n.sum() + 2)
        rate = (np.einsum("cp,plv->clv", classes, one) + 0.01) / (classes.sum(1)[:, None, None] + 0.03)
        logs = np.einsum("plv,clv->cp", one, np.log(rate)) + np.log(prior)[:, None]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return dict(zip(keys.tolist(), bad.tolist()))


def shape(word: bytes) -> bytes:
    """Runs of small letters, capitals, other letters and digits as one character each; marks stand for themselves."""
    out, last = bytearray(), 0
    for c in word:
        k = 97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 101 if c >= 128 else c
        if k != last:
            out.append(k)
        last = k
    return bytes(out)


class Hasher:
    """Hashed features of a text: shares of word shapes and endings, and of words equal to the word before."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def buckets(self, word: bytes) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest
        return h(b"s" + shape(word)) % BUCKETS, h(b"e" + word[-4:]) % BUCKETS

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if max(map(len, words)) > PIECE:
            words = [w[k:k + PIECE] for w in words for k in range(0, len(w), PIECE)]
        if len(self.code) > CACHE_WORDS:
            self.__init__()
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(codes < 0).tolist():
            if words[i] not in self.code:
                self.code[words[i]] = len(self.pairs)
                self.pairs.append(self.buckets(words[i]))
            codes[i] = self.code[words[i]]
        own, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(at)
        both = np.array([self.pairs[c] for c in own.tolist()], np.int64)
        total = np.bincount(both[:, 0], weights=counts, minlength=BUCKETS) + np.bincount(both[:, 1], weights=counts, minlength=BUCKETS)
        total[xxhash.xxh64_intdigest(b"again") % BUCKETS] += 4 * int((codes[1:] == codes[:-1]).sum())
        seen = np.flatnonzero(total)
        return seen, np.sqrt(total[seen] / len(words))


def vote_table(docs: DataFrame, fit_rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pattern, and for the rows of the fitting sample the features: hash, buckets, values."""
    n = docs.count()
    chosen = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) < int(min(1.0, fit_rows / max(1, n)) * (1 << 40))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = bytes_of(batch.column(1))
            counts, shares = rows_of(texts)
            hasher = kept("hashed words", Hasher)
            found = [hasher.features(t) if c else None for t, c in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(votes(shares, counts[:, 0])), batch.column(3),
                pa.array([f and f[0].astype("<i4").tobytes() for f in found], pa.binary()),
                pa.array([f and f[1].astype("<f4").tobytes() for f in found], pa.binary())],
                names=["doc_id", "pattern", "hash", "buckets", "shares"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), chosen, F.xxhash64(id_col, text_col)).mapInArrow(
        run, "doc_id long, pattern long, hash long, buckets binary, shares binary")


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic regression on soft labels, classes weighted evenly."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    sizes = np.array([len(b) for b, _ in rows])
    column = np.concatenate([b for b, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    of = np.repeat(np.arange(len(rows)), sizes)
    mass = np.where(bad > 0.5, 0.5 / max(1.0, bad.sum()), 0.5 / max(1.0, (1 - bad).sum()))
    squares = np.full(BUCKETS + 1, 1e-12)
    for _ in range(rounds):
        z = np.bincount(of, weights=value * weights[column], minlength=len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - bad) * mass
        slope = np.append(np.bincount(column, weights=value * error[of], minlength=BUCKETS), error.sum()) + 1e-5 * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def fitted(docs: DataFrame, labels: DataFrame | None, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
           text_col: str = "text") -> np.ndarray:
    """The scorer's weights, from the votes on all documents."""
    table = materialize(vote_table(docs, fit_rows, id_col, text_col), "votes")
    patterns = {r[0]: r[1] for r in table.groupBy("pattern").agg(F.count(F.lit(1))).collect()}
    posterior = estimate(patterns)
    sample = table.where(F.col("buckets").isNotNull()).select("pattern", "hash", "buckets", "shares").orderBy("hash").limit(fit_rows).collect()
    rows = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in sample]
    return fit_scorer(rows, np.array([posterior[r["pattern"]] for r in sample]))


def badness(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    out = np.ones(len(texts))
    hasher = kept("hashed words", Hasher)
    for i, t in enumerate(texts):
        b, v = hasher.features(t)
        if len(b):
            out[i] = 1 / (1 + np.exp(-np.clip(float(weights[b] @ v) + weights[-1], -40, 40)))
    return out


def classify(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text",
             fit_rows: int = FIT_ROWS, loss: float = LOSS) -> DataFrame:
    """doc_id, score (of being bad, 0 to 1), kept: every document, judged by the linear scorer.

    ``labels`` (doc_id, quality) set the threshold only; without any, it is 0.5.  Texts without words
    (null, empty, blank) score 1 and are rejected; repeated rows are judged alike.
    """
    weights = fitted(docs, labels, fit_rows, id_col, text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(badness(weights, bytes_of(batch.column(1))))], names=["doc_id", "score"])

    scored = materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, score double"), "scores")
    return scored.withColumn("kept", F.col("score") < F.lit(limit_of(scored, labels, loss)))


def limit_of(scored: DataFrame, labels: DataFrame | None, loss: float) -> float:
    found = calibrated(scored, labels, loss) if labels is not None else float("inf")
    return min(found, 0.999999) if found != float("inf") else 0.5


def kept_documents(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text",
                   fit_rows: int = FIT_ROWS, loss: float = LOSS) -> DataFrame:
    """The documents that the scorer does not reject, with all their columns."""
    weights = fitted(docs, labels, fit_rows, id_col, text_col)
    names = docs.columns
    at, spare = names.index(text_col), "_".join([*names, "score"])  # longer than any column's name

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            scores = pa.array(badness(weights, bytes_of(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, spare])

    # every document is scored once and written with its score, which the threshold then reads
    scored = materialize(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(spare, T.DoubleType())])), "scored")
    limit = limit_of(scored.select(F.col(id_col).cast("long").alias("doc_id"), F.col(spare).alias("score")), labels, loss)
    return scored.where(F.col(spare) < F.lit(limit)).select(*names)
