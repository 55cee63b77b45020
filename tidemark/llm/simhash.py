"""SimHash near-duplicates: a segment-popcount embedding joined on a grid, then verified exactly.

A fingerprint's 64 bits are cut into 16 segments, and the numbers of set bits of the segments are its
point in a lattice.  The Manhattan distance of two points is at most the Hamming distance of the
fingerprints, so points further apart than the limit of 2 need no look.  Two points within 2 of each
other share a lattice cell within 1 of both: every fingerprint is put into its own cell and its (at
most 32) neighbours, and fingerprints that meet in a cell are compared exactly.

Equal fingerprints are one node.  A cell of two is compared in place, a cell of up to ``CELL`` by one
task that emits a spanning forest of its links.  The fingerprints of larger cells are linked through
the words at distance 1: fingerprints that share one are within 2, and those within 2 share one, at
most 65 fingerprints share one, and no pair is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, bytes_of, materialize, slices, unboxed
from tidemark.llm.graph import components

SEED = 42
#: Hashes whose bits are counted at a time.
STEP = 1 << 16
#: Fingerprints of a cell that one task compares with each other.
CELL = 256


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a text as a signed 64-bit integer; zero for a text without words."""
    own = text.lower().split()
    if not own:
        return 0
    if len(own) < words:
        shingles = iter([b" ".join(own)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(own[k:] for k in range(words))))
        n = len(own) - words + 1
    counts = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for start in range(0, n, STEP):
        h = np.fromiter(hashes, "<u8", min(STEP, n - start))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, key (a hash of the text): one row per document."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [fingerprint(t, words) for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)],
                                             names=["doc_id", "fp", "key"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(
        run, "doc_id long, fp long, key long")


def point(fp: Column) -> Column:
    """The 16 segment counts as the hexadecimal digits of one number."""
    def counts(half: Column) -> Column:
        two = half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))
        return two.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(two, 2).bitwiseAND(F.lit(0x33333333))

    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(counts(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(counts(low))


def cells(at: Column) -> Column:
    """The cells within distance 1 of a point: its own, and one more or one less in a segment."""
    found = [at]
    for k in range(16):
        digit = F.shiftrightunsigned(at, 4 * k).bitwiseAND(F.lit(15))
        found.append(F.when(digit < 4, at + F.lit(1 << 4 * k)))
        found.append(F.when(digit > 0, at - F.lit(1 << 4 * k)))
    return F.array_compact(F.array(*found))


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 2


def forest(batches) -> Iterator[pa.RecordBatch]:
    """Links from each fingerprint of a cell to the smallest one reachable within the cell."""
    for batch in batches:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for own in batch.column(0).to_pylist():
            fps = np.sort(np.array(own, np.int64))
            close = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 2
            label = np.arange(len(fps))
            while True:
                low = np.where(close, label[None, :], len(fps)).min(1)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            moved = label != np.arange(len(fps))
            left.append(fps[moved])
            right.append(fps[label[moved]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within 2 bits."""
    met = fps.select("fp", F.explode(cells(point(F.col("fp")))).alias("cell"))
    shared = materialize(met.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                         .where("n > 1"), "cells")
    pairs = shared.where((F.col("n") == 2) & near(F.col("a"), F.col("b"))).select("a", "b")
    crowded = materialize(met.join(shared.where("n > 2").select("cell", "n"), "cell"), "crowded-cells")
    some = crowded.where(F.col("n") <= CELL).groupBy("cell").agg(F.collect_list("fp").alias("fps")) \
        .select("fps").mapInArrow(forest, "a long, b long")
    many = crowded.where(F.col("n") > CELL).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    stars = many.select("fp", F.explode(around).alias("word")).groupBy("word").agg(
        F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1) \
        .select(F.explode("fps").alias("a"), "b").where("a <> b")
    return pairs.union(some).union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed), component_id: the smallest doc_id reachable over links of 2 or fewer bits; key, root.

    Null, empty and blank texts have fingerprint zero and link like any other; repeated rows have
    equal fingerprints; rows without id count as copies but never name a component, and a component
    of such rows only has a null one.
    """
    own = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    heads = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    roots = materialize(components(links(heads.select("fp")), "a", "b"), "roots")
    named = roots.join(heads, roots["node"] == heads["fp"]).groupBy("root").agg(F.min("head").alias("_component"))
    linked = materialize(roots.join(named, "root").select(F.col("node").alias("fp"), "root", "_component"), "linked")
    of = heads.join(linked, "fp", "left").select("fp", F.coalesce("_component", "head").alias("component_id"),
                                                 F.coalesce("root", "fp").alias("root"))
    return own.join(of, "fp").select("doc_id", "fp", "component_id", "key", "root")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each near-duplicate group: the one with the smallest id.

    Of a group's rows that share the smallest id one stays; rows without id are no one's copy and stay.
    """
    found = near_duplicates(docs, words, id_col, text_col)
    stay = found.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("key").alias("key")) \
        .select("doc_id", "key").distinct()
    keyed = boxed(docs, doc_id=F.col(id_col).cast("long"), key=F.xxhash64(text_col))
    one = keyed.join(stay, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return unboxed(one).unionByName(docs.where(F.col(id_col).isNull()))
