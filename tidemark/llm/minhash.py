"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, exact sets decide.

Documents with one set of shingles are one node.  Each node has ``BANDS`` bands of ``ROWS`` minima, and nodes
that share a band meet: two of similarity s do so with probability ``1 - (1 - s ** ROWS) ** BANDS``, 0.9996 at
0.8.  A cell of up to ``CELL`` nodes emits all its pairs whose sizes allow the similarity; in a larger one each
node is paired with the cell's first node in the order of the band, so that pairs grow with the rows and not
with the square of a group, and a group has a different first node in each band.  The nodes of such crowded cells
also meet at their rare shingles: all that can be similar and are not connected yet (``crowd_pairs``).  Every pair is
checked on the whole sets of shingles before it links two nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, bytes_of, materialize, slices, unboxed
from tidemark.llm.graph import components

SEED = 42
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Nodes of a cell of which all pairs are formed.
CELL = 32
#: Nodes of a shingle on either side of a tile.
TILE = 1024
#: Shingles whose minima are taken at a time.
STEP = 1 << 13

_RNG = np.random.default_rng(SEED)
_MASKS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order; a shorter text is one shingle, a blank one none."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, "<u8")
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), SEED)], "<u8")
    found = (xxhash.xxh64_intdigest(b" ".join(own[k:k + words]), SEED) for k in range(len(own) - words + 1))
    return np.unique(np.fromiter(found, "<u8", len(own) - words + 1))


def bands(own: np.ndarray) -> np.ndarray:
    """A signed 64-bit cell for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), STEP):
        part = own[start:start + STEP]
        np.minimum(least, ((part[None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.astype("<u8").reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (a hash of the text), node (a hash of its set of shingles), n (its size), cells: one row per document."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [shingles(t, words) for t in bytes_of(batch.column(1))]
            cells = [bands(x) for x in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([set_key(x) for x in found], pa.int64()),
                pa.array([len(x) for x in found], pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                names=["doc_id", "key", "node", "n", "cells"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(
        run, "doc_id long, key long, node long, n long, cells array<long>")


def _wide(x: Column | str, y: Column | str, least: float) -> Column:
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9


def group_pairs(groups: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of each group's ``own`` nodes, a short list of (node, n), whose sizes allow the similarity."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for own in batch.column(0).to_pylist():
                node, n = np.array([x["node"] for x in own], np.int64), np.array([x["n"] for x in own], np.int64)
                i, j = np.nonzero((node[:, None] < node[None, :]) & (
                    np.minimum(n[:, None], n[None, :]) >= least * np.maximum(n[:, None], n[None, :]) - 1e-9))
                left.append(node[i])
                right.append(node[j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return groups.select("own").mapInArrow(run, "a long, b long")


def meetings(met: DataFrame, key: str, order: Column, least: float, name: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded rows) of the nodes (``key``, node, n) that meet under a key.

    Up to ``CELL`` of them form all their pairs; of more, each is paired with the first one in ``order``.
    """
    first = F.min(F.struct(order.alias("h"), "node", "n")).alias("first")
    shared = materialize(met.groupBy(key).agg(F.count(F.lit(1)).alias("m"), first).where("m > 1"), f"{name}-keys")
    there = materialize(met.join(shared, key).select(key, "m", "node", "n", F.col("first.node").alias("to"),
                                                     F.col("first.n").alias("to_n")), f"{name}-met")
    crowded = there.where(F.col("m") > CELL)
    stars = crowded.where((F.col("node") != F.col("to")) & _wide("n", "to_n", least)).select(
        F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))
    some = there.where(F.col("m") <= CELL).groupBy(key).agg(F.collect_list(F.struct("node", "n")).alias("own"))
    return group_pairs(some, least).union(stars).distinct(), crowded


def candidates(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowd): nodes that share a cell and whose sizes allow the similarity, and the nodes of crowded cells."""
    met = nodes.where("n > 0").select("node", "n", F.explode("cells").alias("cell"))
    # the first node of a cell in an order that differs from cell to cell
    pairs, crowded = meetings(met, "cell", F.xxhash64("node", "cell"), least, "minhash")
    return materialize(pairs, "minhash-pairs"), materialize(crowded.select("node").distinct(), "crowd")


def crowd_pairs(sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a crowd's nodes (node, own): with the pairs that ``roots`` (node, root) connect, all that can be ``least`` similar.

    Texts that share a long passage fill cells without being near copies.  Two sets of similarity ``least`` share one of
    the rarest ``n - ceil(least * n) + 1`` shingles of each, in any one order of shingles; in that of their frequency
    in the crowd these are the ones that the passage is not made of.  At the first one that both have, no more can be common
    than the shingles of either from there on, ``left``.  Each shingle's nodes are paired wherever that is enough for the
    sizes of the two, however many they are: those outside the list's largest group of connected nodes with all that
    ``roots`` doesn't connect them to, in tiles of at most about ``TILE`` a side.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, "<u8").view(np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in own], np.int64)
            node = np.repeat(batch.column(0).to_numpy(), sizes)
            all_of = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(sizes, sizes)), pa.array(all_of)], names=["node", "n", "shingle"])

    each = sets.select("node", "own").mapInArrow(run, "node long, n long, shingle long")
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"))
    ranked = each.join(common, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("m", "shingle"))).alias("own"))
    size = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    rare = ranked.select("node", "n", F.posexplode(F.slice("own", F.lit(1), size.cast("int"))).alias("at", "s")).where("s.m > 1").select(
        "node", "n", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("at")).alias("left"))
    met = materialize(rare.join(roots, "node", "left").select("shingle", "node", "n", "left", F.coalesce("root", "node").alias("root")), "crowd-met")
    # the smaller one of a similar pair has enough left for another of its own size
    enough = F.max(F.col("left") * F.lit(1 + least) >= 2 * F.lit(least) * F.col("n") - F.lit(1e-9)).alias("enough")
    groups = met.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("m"), enough)
    lists = groups.groupBy("shingle").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("groups"),
                                          F.max("enough").alias("enough")).where("groups > 1 and enough")
    parts = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    placed = met.join(lists.select("shingle", F.col("main.root").alias("main"), parts(F.col("m") - F.col("main.m")).alias("rows"),
                                   parts(F.col("m")).alias("columns")), "shingle").withColumn("other", F.col("root") != F.col("main"))
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    fields = ["node", "n", "left", "root", "other"]
    sides = placed.where("other").select("shingle", part(F.col("rows")).alias("row"), every(F.col("columns")).alias("column"), F.lit(True).alias("first"), *fields) \
        .union(placed.select("shingle", every(F.col("rows")).alias("row"), part(F.col("columns")).alias("column"), F.lit(False).alias("first"), *fields))
    tiles = sides.groupBy("shingle", "row", "column").agg(F.collect_list(F.struct("first", *fields)).alias("own")).select("own")
    return tiles.mapInArrow(lambda batches: _tile_pairs(batches, least), "a long, b long").distinct()


def _tile_pairs(batches, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of each tile: its ``first`` rows with the rest, each pair of ``other`` rows once."""
    for batch in batches:
        lists, a, b = batch.column(0), [], []
        bounds = lists.offsets.to_numpy()
        cells = lists.values
        first, node, n, left, root, other = [cells.field(k).to_numpy(zero_copy_only=False) for k in range(6)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            i, j = lo + np.flatnonzero(first[lo:hi]), lo + np.flatnonzero(~first[lo:hi])
            both = np.minimum(left[i][:, None], left[j][None, :])
            found = both * (1 + least) >= least * (n[i][:, None] + n[j][None, :]) - 1e-9
            found &= root[i][:, None] != root[j][None, :]
            found &= ~other[j][None, :] | (node[i][:, None] < node[j][None, :])
            x, y = np.nonzero(found)
            a.append(np.minimum(node[i[x]], node[j[y]]))
            b.append(np.maximum(node[i[x]], node[j[y]]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets (node, own) are at least so similar."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda k: [np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()]
            keep = pa.array([similar(x, y, least) for x, y in zip(read(2), read(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    side = lambda k: sets.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, own: DataFrame, words: int, least: float, text_col: str) -> DataFrame:
    """Links (a, b) between the nodes of ``own``, of similarity ``least`` or more."""
    nodes = own.groupBy("node").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.first("cells").alias("cells"))
    pairs, crowd = candidates(nodes, least)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd).distinct()
    # one text of each node that has a candidate
    texts = own.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node", "left_semi")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [shingles(t, words).tobytes() for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "own"])

    of = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).join(texts, "key") \
        .groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(of.mapInArrow(run, "node long, own binary"), "minhash-sets")
    near = materialize(checked(pairs, sets, least), "minhash-links")
    # the crowd's own links tell which of its pairs need no look
    within = near.join(crowd.select(F.col("node").alias("a")), "a", "left_semi").join(crowd.select(F.col("node").alias("b")), "b", "left_semi")
    roots = components(within, "a", "b")
    more = materialize(crowd_pairs(sets.join(crowd, "node", "left_semi"), roots, least), "crowd-pairs")
    return near.union(materialize(checked(more, sets, least), "crowd-links"))


def one_of_each_similar(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY, id_col: str = "doc_id",
                        text_col: str = "text", united: DataFrame | None = None) -> DataFrame:
    """The documents with one row of each group of near copies: the one with the smallest id.

    Texts link from a similarity of ``least`` on, and a group is what links connect; texts without words are one
    group.  Of a group's rows that share the smallest id one stays.  Rows without id go where their group has a
    named document; of a group without any, one row stays, that of the smallest hash.

    ``united`` (key, root), key being the hash of a text, links texts of one root besides.
    """
    own = materialize(sketches(docs, words, id_col, text_col), "sketches")
    found = links(docs, own, words, least, text_col)
    if united is not None:
        met = materialize(own.select("node", "key").distinct().join(united.select("key", "root").distinct(), "key")
                          .select("root", "node").distinct(), "united-nodes")
        star = met.join(met.groupBy("root").agg(F.min("node").alias("b")), "root").where("node <> b")
        found = found.union(star.select(F.col("node").alias("a"), "b"))
    roots = components(found, "a", "b")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    heads = own.groupBy("node").agg(F.min(order).alias("head"))
    stay = heads.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("head").alias("head")) \
        .select(F.col("head.doc_id").alias("_id"), F.col("head.key").alias("_key"))
    keyed = boxed(docs, doc_id=F.col(id_col).cast("long"), key=F.xxhash64(text_col))
    one: Column = keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed["key"] == stay["_key"])
    return unboxed(keyed.join(stay, one, "left_semi").dropDuplicates(["doc_id", "key"]))
