"""Language-model scores by a weighted backoff automaton over counted n-grams.

Model.  p1(w) = (c(w) + 1) / (N + V + 1); for longer contexts h, with s(h) the context without its
first word, p(w | h) = (c(hw) + MU * p(w | s(h))) / (c(h) + MU).  As an automaton: a state for each
context with c(h) > 0, an arc for each n-gram with c(hw) > 0, and a failure arc of weight
log10(MU / (c(h) + MU)) to s(h).  Every row of probabilities sums to one.

Scale.  No model is broadcast and none is pruned.  Documents are coded into blocks of a bounded number
of tokens; a block states its distinct n-grams with its own counts to the parts of a partitioning
by n-gram (so that a frequent one is one number per block), each part sums them up and answers every
block with the totals of what it has stated; a block then holds the part of the automaton that its
documents walk through.  N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, materialize, slices

#: Weight of the lower order against the counts of a context.
MU = 4.0
#: Tokens after which a block is closed; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 19
#: Bytes of text for each part of the partitioning by n-gram.
PART_BYTES = 8_000_000
END = b"\n"
FOLD, RESIDUE = 7, 2


def held_out(doc) -> bool:
    """Not for training; a null id counts as empty text."""
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLD == RESIDUE


def squeeze(values: np.ndarray) -> bytes:
    """Compressed with the bytes of equal weight together."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def loosen(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


BLOCK = "block long, docs binary, known binary, trains binary, lengths binary, words binary, codes binary"


def code_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as blocks: ids, token counts, the hashes of the block's words, and each token's number among them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        known: dict[bytes, int] = {END: 0}
        size = 0

        def close() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            row = {"block": number, "docs": squeeze(np.array([i or 0 for i in ids], np.int64)),
                   "known": squeeze(np.array([i is not None for i in ids], np.uint8)),
                   "trains": squeeze(np.array([not held_out(i) for i in ids], np.uint8)),
                   "lengths": squeeze(np.array(lengths, np.int64)),
                   "words": words.tobytes(), "codes": squeeze(np.concatenate(codes))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("block", pa.int64()), *[(c, pa.binary()) for c in ("docs", "known", "trains", "lengths", "words", "codes")]]))

        for batch in slices(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                words = text.lower().split()
                if ids and size + len(words) + 1 > BLOCK_TOKENS:
                    yield close()
                    number, size, known = number + 1, 0, {END: 0}
                    ids, lengths, codes = [], [], []
                words.append(END)
                own = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                for i in np.flatnonzero(own < 0).tolist():
                    own[i] = known.setdefault(words[i], len(known))
                ids.append(doc)
                lengths.append(len(words))
                codes.append(own)
                size += len(words)
        if ids:
            yield close()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, BLOCK)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """The n-grams of a block by token: ``keys[k]`` names the one of order ``k + 1`` that ends there."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, order: int):
        hashes = words[codes]
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        with np.errstate(over="ignore"):
            key = mixed(hashes)
            self.keys, self.valid = [key | np.uint64(1)], [np.ones(len(codes), bool)]
            for k in range(1, order):
                longer = np.zeros_like(key)
                longer[1:] = mixed(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + np.uint64(k))
                key = longer
                self.keys.append(key & ~np.uint64(1))
                self.valid.append(place >= k)
        # odd keys are words, even ones longer n-grams
        self.distinct, self.at = np.unique(np.concatenate([x[v] for x, v in zip(self.keys, self.valid)]), return_inverse=True)

    def weights(self, trains: np.ndarray) -> np.ndarray:
        flags = np.concatenate([trains[v] for v in self.valid])
        return np.bincount(self.at, weights=flags, minlength=len(self.distinct)).astype(np.int64)

    def by_order(self) -> list[np.ndarray]:
        """For every order the index in ``distinct`` by token, -1 where the document has not so many words yet."""
        out, at = [], 0
        for v in self.valid:
            index = np.full(len(v), -1, np.int64)
            n = int(v.sum())
            index[v] = self.at[at:at + n]
            at += n
            out.append(index)
        return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = loosen(row["lengths"], "int64")
    return (np.frombuffer(row["words"], np.uint64), loosen(row["codes"], "int32"), lengths,
            np.repeat(loosen(row["trains"], "uint8"), lengths))


def statements(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Each block's distinct n-grams and its counts of them, a row for every part: part, block, keys, counts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes, lengths, trains = opened(row)
                grams = Grams(words, codes, lengths, order)
                counts = grams.weights(trains).astype(np.uint32)
                cuts = np.searchsorted(part_of(grams.distinct, parts), np.arange(parts + 1)).tolist()
                full = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _, _ in full], pa.int32()), pa.array([row["block"]] * len(full), pa.int64()),
                    pa.array([squeeze(np.diff(grams.distinct[a:b], prepend=np.uint64(0))) for _, a, b in full], pa.binary()),
                    pa.array([squeeze(counts[a:b]) for _, a, b in full], pa.binary())],
                    names=["part", "block", "keys", "counts"])

    return blocks.select("block", "trains", "lengths", "words", "codes").mapInArrow(
        run, "part int, block long, keys binary, counts binary")


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's totals for each block that asked; its training tokens and distinct words stand with block -1."""
    keys = [np.cumsum(loosen(x, "uint64"), dtype=np.uint64) for x in pdf["keys"]]
    counts = np.concatenate([loosen(x, "uint32") for x in pdf["counts"]])
    ends = np.cumsum([len(k) for k in keys]).tolist()
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    words = totals[(distinct & np.uint64(1)) == 1]
    out = [(int(b), int(p), squeeze(totals[at[a:e]]), 0, 0)
           for b, p, a, e in zip(pdf["block"], pdf["part"], [0, *ends], ends)]
    out.append((-1, int(pdf["part"].iloc[0]), b"", int(words.sum()), int((words > 0).sum())))
    return pd.DataFrame(out, columns=["block", "part", "totals", "tokens", "words"])


class BackoffAutomaton:
    """The states and arcs that one block's documents meet.

    State 0 is the root, state ``d + 1`` the counted n-gram ``d`` as a context.  Each counted n-gram (and, at the root,
    each word) is an arc: from the state of its words but the last, over the last word, to the longest counted context that its
    words end in.  A failure arc leads from a state to the one without its first word.
    """

    def __init__(self, index: list[np.ndarray], codes: np.ndarray, words: int, totals: np.ndarray, train_tokens: int,
                 train_words: int, mu: float = MU):
        n, self.words = len(totals), max(1, words)
        self.base = np.log10((totals + 1) / (train_tokens + train_words + 1))  # of the n-grams of one word
        chance = np.zeros(n)
        target, failure = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        keys, arcs = [], []
        for k, own in enumerate(index):
            there = np.flatnonzero(own >= 0)
            d, first = np.unique(own[there], return_index=True)
            at = there[first]
            if k == 0:
                chance[d] = 10.0 ** self.base[d]
                root = np.zeros(self.words, np.int64)
                root[codes[at]] = d
                self.root = root.tolist()
            else:
                shorter, context = index[k - 1][at], index[k - 1][at - 1]
                chance[d] = (totals[d] + mu * chance[shorter]) / (totals[context] + mu)
                target[d] = target[shorter]
                failure[d + 1] = target[shorter]
                counted = totals[d] > 0
                keys.append((context[counted] + 1) * self.words + codes[at[counted]])
                arcs.append(d[counted])
            if k + 1 < len(index):
                state = d[totals[d] > 0]
                target[state] = state + 1
        self.arcs = dict(zip(np.concatenate(keys).tolist(), np.concatenate(arcs).tolist())) if keys else {}
        self.weight, self.target, self.failure = np.log10(chance).tolist(), target.tolist(), failure.tolist()
        self.lent = np.append(0.0, np.log10(mu / (totals + mu))).tolist()

    def traverse(self, codes: np.ndarray, lengths: np.ndarray) -> list[float]:
        """log10 probability of each document: one walk from left to right that carries the state."""
        arcs, root, words = self.arcs.get, self.root, self.words
        weight, target, failure, lent = self.weight, self.target, self.failure, self.lent
        out, at = [], 0
        codes = codes.tolist()
        for n in lengths.tolist():
            state, total = 0, 0.0
            for w in codes[at:at + n]:
                while state and (arc := arcs(state * words + w)) is None:
                    total += lent[state]
                    state = failure[state]
                if not state:
                    arc = root[w]  # the root has an arc for every word
                total += weight[arc]
                state = target[arc]
            out.append(total)
            at += n
        return out


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def score_documents(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents outside the held-out fold, score all of them.

    A null or empty text is the end token only.  Repeated rows are counted and scored one by one.  Where
    no document trains (or the table is empty), every token has the probability of an unknown word.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    blocks = materialize(code_blocks(docs, id_col, text_col), "lm-blocks")
    answers = materialize(
        statements(blocks, order, parts).groupBy("part").applyInPandas(
            answer, "block long, part int, totals binary, tokens long, words long"), "lm-answers")
    known = answers.where("block = -1").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, words = known[0] or 0, known[1] or 0

    def score(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in block.to_dict("records"):
            codes_of = opened(row)
            lengths = codes_of[2]
            grams = Grams(codes_of[0], codes_of[1], lengths, order)
            totals = np.concatenate([loosen(x, "int64") for x in own.sort_values("part")["totals"]])
            index = grams.by_order()
            automaton = BackoffAutomaton(index, codes_of[1].astype(np.int64), len(codes_of[0]), totals, tokens, words)
            base = automaton.base[index[0]]
            starts = np.cumsum(lengths) - lengths
            ids, there = loosen(row["docs"], "int64"), loosen(row["known"], "uint8")
            found.append(pd.DataFrame({
                "doc_id": pd.array([i if k else None for i, k in zip(ids.tolist(), there.tolist())], "Int64"),
                "held_out": loosen(row["trains"], "uint8") == 0, "n_tokens": lengths,
                "n_known": np.add.reduceat((totals[index[0]] > 0).astype(np.int64), starts), "train_tokens": tokens,
                "base_score": np.add.reduceat(base, starts), "score": automaton.traverse(codes_of[1], lengths)}))
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    told = answers.where("block >= 0").select("block", "part", "totals")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(score, SCORES)
