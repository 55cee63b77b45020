"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Lengths are at most the sequence length ``limit``, so all pieces fall into ``limit`` classes, and
their histogram (at most ``limit`` rows whatever the corpus) is all that planning needs:

1. from the longest class down, the gap a piece leaves is looked up among single lengths, sums of
   two and sums of three lengths; combinations that fill it exactly are consumed as often as the
   availability counts allow;
2. what is left is placed best-fit by decreasing length, whole runs of equal sequences at a time.

The plan is a list of patterns (lengths of one sequence, how many such sequences).  Pieces are
numbered within their length class by a distributed rank and look their place up in the plan.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, materialize, ranked, slices
from tidemark.llm.tokens import load

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, limit: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: pieces of ``limit``, the first one may be shorter."""
    if n <= limit:
        return [n]
    head = n % limit
    return [head] * (head > 0) + [limit] * (n // limit)


def token_pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit integers."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for batch in slices(batches, 1):
            ids, counts = encoder.encode(bytes_of(batch.column(1)))
            out: list[tuple] = []
            at = 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                raw = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4").tobytes()
                at += n
                start = 0
                for k, length in enumerate(cut(n + 1, limit)):
                    own = raw[4 * start:4 * (start + length)]
                    out.append((doc, k, start, length, zlib.crc32(own), *([own] if with_ids else [])))
                    start += length
            if out:
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names[:len(out[0])])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, PIECES + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; every piece of the histogram is used once.

    Exact fills may spend short pieces that the rest would have needed, so the histogram is planned with fills of up
    to three, two and one pieces, for all pieces or only for long ones, and the plan with the fewest sequences is kept.
    """
    least = -(-sum(k * n for k, n in histogram.items()) // limit)
    found: list[tuple[tuple[int, ...], int]] | None = None
    fewest = 0
    for most in (3, 2, 1, 0):
        for shortest in (1, limit // 2 + 1, limit * 3 // 4 + 1) if most else (1,):
            own = _plan(histogram, limit, most, shortest)
            n = sum(times for _, times in own)
            if found is None or n < fewest:
                found, fewest = own, n
            if fewest == least:
                return found
    return found or []


def _plan(histogram: dict[int, int], limit: int, most: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose exact fills take up to ``most`` pieces beside one of at least ``shortest``."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = int(min(left[x] // k for x, k in need.items()))
        if times > 0:
            for x, k in need.items():
                left[x] -= k * times
            done.append((lengths, times))

    use(limit)
    for a in range(limit - 1, shortest - 1, -1):
        gap = limit - a
        if most and left[a] and gap <= a:
            use(a, gap)
        if most > 1 and left[a]:
            low = np.arange(max(1, gap - a), gap // 2 + 1)
            for b in low[(left[low] > 0) & (left[gap - low] > 0)].tolist() if len(low) else []:
                use(a, gap - b, b)
                if not left[a]:
                    break
        if most > 2 and left[a]:
            some = np.flatnonzero(left[:min(a, gap) + 1])
            for b in some[::-1].tolist():
                rest = gap - b
                if rest < 2:
                    continue
                c = np.arange((rest + 1) // 2, min(b, rest - 1) + 1)
                for x in c[(left[c] > 0) & (left[rest - c] > 0)].tolist() if len(c) else []:
                    use(a, b, x, rest - x)
                    if not left[a]:
                        break
                if not left[a]:
                    break
    return done + best_fit(left, limit)


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length over runs of equal sequences."""
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(limit, 0, -1):
        n = int(left[length])
        gaps = [g for g in by_gap if g >= length]
        heapq.heapify(gaps)
        while n and gaps:
            gap = heapq.heappop(gaps)
            runs = by_gap.pop(gap, [])
            while n and runs:
                pattern, count = runs.pop()
                deep = min(gap // length, n)  # so many of this length fit into one of them
                times = min(count, n // deep)
                if count > times:
                    runs.append((pattern, count - times))
                n -= deep * times
                by_gap.setdefault(gap - deep * length, []).append((pattern + (length,) * deep, times))
                if gap - deep * length >= length:
                    heapq.heappush(gaps, gap - deep * length)
            if runs:
                by_gap.setdefault(gap, []).extend(runs)
        if n:
            deep = limit // length
            if n >= deep:
                by_gap.setdefault(limit - deep * length, []).append(((length,) * deep, n // deep))
            if n % deep:
                by_gap.setdefault(limit - n % deep * length, []).append(((length,) * (n % deep), 1))
    return [x for runs in by_gap.values() for x in runs]


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan by length class: ranks ``lo`` to ``hi`` go ``each`` to a sequence from ``first`` on, at ``base``."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in patterns:
        base = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            lo = used.get(length, 0)
            used[length] = lo + each * times
            rows.append((length, lo, used[length], each, first, base))
            base += each * length
        first += times
    return rows


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces.

    Empty input gives an empty result; equal pieces take different places.  The broadcast table is
    the plan, whose rows depend on ``limit`` and not on the corpus.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    rows = layout(plan(histogram, limit))
    schema = "_length long, _lo long, _hi long, _each long, _first long, _base long"
    places = spark.createDataFrame(rows, schema)
    numbered = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], "_rank")
    met = numbered.join(F.broadcast(places), (F.col("length") == F.col("_length"))
                        & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    within = F.col("_rank") - F.col("_lo")
    return met.select(
        *pieces.columns,
        (F.col("_first") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + within % F.col("_each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents.

    A null or empty text is one piece holding the end id only; rows without id or with repeated ids
    are packed like any other; other columns are ignored.  Returns doc_id, piece, start, length,
    ids_crc32[, ids], sequence_id, offset.
    """
    pieces = materialize(token_pieces(docs, tokenizer, limit, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, limit)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (a packing made ``with_ids``): sequence_id, n_tokens, ids binary."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_p")).select(
        "sequence_id", "n_tokens",
        F.aggregate("_p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
