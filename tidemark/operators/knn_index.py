"""A partitioned index for nearest neighbours in many dimensions.

* Centres are fitted by k-means on a bounded sample of each group's references (``SAMPLE_ROWS``).
* Every reference goes to the list of its nearest centre, with a sketch: the signs of ``SKETCH_BITS`` random
  projections.  The lists are a table that can be saved and read.
* A query probes lists in the order of their centres' distance until the lists before it hold a given share of the
  group's references.  Of what it meets there, rows whose sketch differs in at most ``reach`` bits are ranked exactly.
* Share and reach are measured: for a bounded sample of queries all lists are searched exactly, and where the true
  neighbours lie, and how their sketches differ, gives the recall of every setting at once.

A share of 1 with all bits allowed makes the join exact; it then goes only to lists whose box reaches as near as the
neighbours in the query's own list.  Otherwise a query is one row with a bit for each list that it probes, and sent once to
each slab, a run of lists of about a block's rows, and there compared tile by tile.  Centres meet rows by group and chunk in a shuffle; nothing
is broadcast, and lists of any size are cut into tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import kd, knn
from tidemark.session import materialize

#: References of a group that its centres are fitted on, and queries of a group that a share is measured by.
SAMPLE_ROWS = 65_536
SAMPLE_QUERIES = 512
MAX_LISTS = 4_096
ROUNDS = 10
#: Rows of a group that meet its centres in one task.
CHUNK_ROWS = 32_768
#: The same where a row meets all lists, or leaves once for each that it goes to.
ROUTED_ROWS = 4_096
#: Bits of a sketch, a multiple of 64.
SKETCH_BITS = 256
#: Share of the sample's neighbours that the probed lists hold, and whose sketches are near enough.
SAMPLE_RECALL = 0.97


@dataclass
class Index:
    """``centres`` (grp, list, centre, n, total, share, reach) and ``rows`` (grp, rid, vec, code, list), both written tables."""

    centres: DataFrame
    rows: DataFrame

    def save(self, path: str) -> None:
        self.centres.write.parquet(f"{path}/centres")
        self.rows.repartition("grp", "list").sortWithinPartitions("grp", "list").write.parquet(f"{path}/rows")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/rows"))


def complete(vec: Column) -> Column:
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def _share_of(key: str) -> Column:
    """A number from 0 to 1 by the hash of a row's key, the same in every run."""
    return F.pmod(F.xxhash64("grp", F.col(key), F.lit(17)), F.lit(1 << 31)) / F.lit(float(1 << 31))


def _no_rows(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def sketches(x: np.ndarray, centres: np.ndarray) -> list[np.ndarray]:
    """Signs of random projections of rows, seen from the middle of their group's centres, as 64-bit numbers."""
    lines = np.random.default_rng(29).normal(size=(x.shape[1], SKETCH_BITS))
    return list(np.packbits((x - centres.mean(axis=0)) @ lines > 0, axis=1).view(np.int64))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each sketch of one side differs from each of the other."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, knn.BLOCK // len(centres))
    return np.concatenate([_squares(x[i:i + step], centres).argmin(axis=1) for i in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's steps from the first ``k`` different rows; an empty centre moves to the row farthest from its own."""
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        of = _nearest_centre(x, centres)
        count = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-((x - centres[of]) ** 2).sum(axis=1), kind="stable")[:len(empty)]
            centres[empty[:len(far)]] = x[far]
    return centres


def fit_centres(refs: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(grp, list, centre): about the root of a group's rows as many lists, or ``lists``."""
    sizes = refs.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    wanted = F.lit(lists) if lists else F.least(F.lit(MAX_LISTS), F.ceil(F.sqrt("total")))
    sample = refs.join(sizes, "grp").where(_share_of("rid") <= F.lit(float(sample_rows)) / F.col("total")).select(
        "grp", "rid", "vec", wanted.cast("int").alias("lists"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        x = knn._stack(rows.vec)
        x = x[np.random.default_rng(17).permutation(len(x))]
        centres = k_means(x, int(rows.lists.iloc[0]))
        return pd.DataFrame({"grp": rows.grp.iloc[0], "list": np.arange(len(centres), dtype=np.int32),
                             "centre": pd.Series(list(centres), dtype=object)})

    return sample.groupBy("grp").applyInPandas(fit, "grp string, list int, centre array<double>")


def _meet(rows: DataFrame, centres: DataFrame, key: str, run, schema: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows in chunks against all centres of their group: ``run(rows, centres)``."""
    chunks = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)).cast("int").alias("chunks"))
    left = rows.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64(key, F.lit(5)), F.col("chunks")).cast("int")).drop("chunks")
    right = centres.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns])
    return left.groupBy("grp", "chunk").cogroup(right.groupBy("c_grp", "c_chunk")).applyInPandas(run, schema)


def build(refs: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index every reference ``(grp, rid, vec)`` with a complete vector; all of a group have one length."""
    refs = refs.select("grp", "rid", "vec").where(complete(F.col("vec")))
    centres = materialize(fit_centres(refs, lists, sample_rows), "index-centres")

    def assign(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return _no_rows("grp", "rid", "vec", "code", "list")
        x, c = knn._stack(rows.vec), knn._stack(own.c_centre)
        return rows[["grp", "rid", "vec"]].assign(code=sketches(x, c), list=own.c_list.to_numpy()[_nearest_centre(x, c)])

    schema = f"grp string, rid {knn._kind(refs, 'rid')}, vec array<double>, code array<long>, list int"
    rows = materialize(_meet(refs, centres, "rid", assign, schema), "index-rows")
    held = rows.groupBy("grp", "list").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("grp"))
    sized = centres.join(held, ["grp", "list"], "left").withColumn("n", F.coalesce("n", F.lit(0))).select(
        "grp", "list", "centre", "n", total.alias("total"), F.lit(1.0).alias("share"), F.lit(SKETCH_BITS).alias("reach"))
    return Index(materialize(sized, "index-lists"), rows)


def route(index: Index, queries: DataFrame, k: int, everything: bool = False) -> DataFrame:
    """(grp, qid, vec, code, reach, slabs, probed, met, before): a row for each query.

    ``probed`` has a bit for each list, ``slabs`` are those of the probed lists and ``met`` is the number of references in
    these.  With ``everything`` all lists are probed, and ``before`` has for each the references in lists nearer than it.
    """
    names = ["grp", "qid", "vec", "code", "reach", "slabs", "probed", "met", "before"]

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return _no_rows(*names)
        own = own.sort_values("c_list")
        centres, n, slab = knn._stack(own.c_centre), own.c_n.to_numpy(), own.c_slab.to_numpy()
        total, share, reach = float(own.c_total.iloc[0]), float(own.c_share.iloc[0]), int(own.c_reach.iloc[0])
        # slabs are runs of lists
        first = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])
        out = []
        for piece in knn._pieces(rows, len(centres)):
            x = knn._stack(piece.vec)
            order = np.argsort(_squares(x, centres), axis=1, kind="stable")
            met = np.cumsum(n[order], axis=1) - n[order]
            before = np.empty_like(met)
            np.put_along_axis(before, order, met, axis=1)
            probed = (n > 0) & (everything | (before <= share * total) | (before < k))
            row, at = np.nonzero(np.logical_or.reduceat(probed, first, axis=1))
            slabs = np.split(slab[first][at], np.searchsorted(row, np.arange(1, len(piece))))
            packed = np.packbits(probed, axis=1, bitorder="little")
            out.append(piece.assign(
                code=sketches(x, centres), reach=SKETCH_BITS if everything else reach, met=probed @ n,
                slabs=pd.Series(slabs, dtype=object).to_numpy(), probed=[bits.tobytes() for bits in packed],
                before=list(before) if everything else None)[names])
        return pd.concat(out)

    asked = queries.select("grp", "qid", "vec").where(complete(F.col("vec")))
    kind = knn._kind(queries, "qid")
    return _meet(asked, _slabs(index), "qid", run, f"grp string, qid {kind}, vec array<double>, code array<long>, reach int, "
                 "slabs array<int>, probed binary, met long, before array<long>", ROUTED_ROWS)


def _slabs(index: Index) -> DataFrame:
    """The centres with the slab of their list: lists in order, a new slab after the references of each block of ``knn.TILE_ROWS`` rows."""
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("list")) - F.col("n")
    return index.centres.withColumn("slab", F.floor(before / (knn.BLOCK_TILES * knn.TILE_ROWS)).cast("int"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    lists = column.combine_chunks()
    if len(pc.unique(pc.list_value_length(lists))) > 1:
        raise ValueError("all vectors of a group must have the same length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _numbers(qid: pa.ChunkedArray, rid: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids are."""
    code, _ = pd.factorize(np.array([*qid.to_pylist(), *rid.to_pylist()], object), use_na_sentinel=False)
    return code[:len(qid)], code[len(qid):]


def _best_of_block(left: pa.Table, right: pa.Table, k: int, exclude_self: bool, tile_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query rows, reference rows, distances, pairs compared) of one block: exact distances where sketches are near enough.

    References ascend by id and are taken ``tile_rows`` at a time, in the order of their lists.  Of the pairs of a tile whose
    sketches are near enough a matrix product tells which can be among the ``k`` nearest of the tile.
    """
    q, r = _matrix(left["vec"]), _matrix(right["vec"])
    a, b = (_matrix(x["code"]).astype(np.int64, copy=False).view(np.uint64) for x in (left, right))
    reach, list_of = left["reach"].to_numpy(), right["list"].to_numpy()
    packed = np.frombuffer(b"".join(left["probed"].to_pylist()), np.uint8).reshape(len(q), -1)
    qid, rid = _numbers(left["qid"], right["rid"]) if exclude_self else (None, None)
    by_list = np.argsort(list_of, kind="stable")
    tiles = [np.sort(by_list[lo:lo + tile_rows]) for lo in range(0, len(by_list), tile_rows)]
    best, compared = [], 0
    for top in range(0, len(q), tile_rows):
        bits = np.unpackbits(packed[top:top + tile_rows], axis=1, bitorder="little").view(bool)
        found = []
        for tile in tiles:
            rows = top + np.flatnonzero(bits[:, np.unique(list_of[tile])].any(axis=1))
            middle = r[tile].mean(axis=0)
            rm = r[tile] - middle
            norms = (rm * rm).sum(axis=1)
            step = max(1, knn.BLOCK // len(tile))
            for lo in range(0, len(rows), step):
                here = rows[lo:lo + step]
                near = bits[here - top][:, list_of[tile]]
                if reach[here].min() < SKETCH_BITS:
                    near &= _apart(a[here], b[tile]) <= reach[here, None]
                if exclude_self:
                    near &= qid[here, None] != rid[None, tile]
                compared += int(np.count_nonzero(near))
                if len(tile) > k:
                    qm = q[here] - middle
                    own_norms = (qm * qm).sum(axis=1)
                    wrong = kd.slack(q.shape[1], own_norms + norms.max())
                    squares = qm @ rm.T
                    squares *= -2.0
                    squares += norms
                    squares += own_norms[:, None]
                    squares[~near] = np.inf
                    kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
                    near &= squares <= (kd.reach(np.maximum(kth, 0.0) + wrong) + wrong)[:, None]
                row, col = np.nonzero(near)
                row, col = here[row], tile[col]
                found.append(kd.first_of_each(row, col, kd.quantised(kd.pair_squares(q[row], r[col])), k))
        if found:
            best.append(kd.first_of_each(*(np.concatenate(x) for x in zip(*found)), k))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return (*(np.concatenate(x) for x in zip(none, *best)), compared)


def _ranked(index: Index, routed: DataFrame, k: int, exclude_self: bool, tile_rows: int) -> DataFrame:
    """(grp, qid, rid, dist) of what routed (written) queries meet in their lists, at most ``k`` a block and query.

    A query is sent once to each slab and block of its references.  A block of up to about ``knn.BLOCK_TILES * tile_rows`` rows a
    side also says how many pairs it compared: a row without ids, with the number in ``dist``.  Few blocks are cut further on
    the queries' side, so that all cores have some.
    """
    block_rows = knn.BLOCK_TILES * tile_rows
    # rows are dealt out by their place in the files, as ids may repeat
    place = F.monotonically_increasing_id().alias("__n")
    rows = index.rows.select("*", place).join(F.broadcast(_slabs(index).select("grp", "list", "slab")), ["grp", "list"])
    sent = routed.select("grp", "qid", "vec", "code", "reach", "probed", "slabs", place).withColumn("slab", F.explode("slabs")).drop("slabs")
    sizes = materialize(rows.groupBy("grp", "slab").agg(F.count(F.lit(1)).alias("n")).join(
        sent.groupBy("grp", "slab").agg(F.count(F.lit(1)).alias("v")), ["grp", "slab"]), "index-plan")
    q_parts, r_parts = (F.ceil(F.col(c) / block_rows) for c in ("v", "n"))
    blocks = sizes.agg(F.sum(q_parts * r_parts)).first()[0] or 1
    finer = max(1, -(-4 * routed.sparkSession.sparkContext.defaultParallelism // int(blocks)))
    parts = sizes.select("grp", "slab", r_parts.cast("int").alias("r_parts"), F.greatest(
        q_parts, F.least(q_parts * finer, F.ceil(F.col("v") / kd.LEAF))).cast("int").alias("q_parts"))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(parts, ["grp", "slab"]).withColumn(own, F.pmod(F.xxhash64("__n"), F.col(f"{own[0]}_parts")).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other[0]}_parts") - 1))).drop("r_parts", "q_parts", "__n")

    q_side, r_side = cut(sent, "qp", "rp"), cut(rows, "rp", "qp")
    names = ["grp", "slab", "rp", "qp"]

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        row = col = np.zeros(0, np.int64)
        dist, compared = np.zeros(0), []
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, [("rid", "ascending")]))
            row, col, dist, n = _best_of_block(left, right, k, exclude_self, tile_rows)
            compared = [n]
        of = lambda column, at: pa.concat_arrays([column.take(pa.array(at)).combine_chunks(), pa.nulls(len(compared), column.type)])
        return pa.table({"grp": pa.repeat(left["grp"][0], len(row) + len(compared)) if left.num_rows else pa.array([], pa.string()),
                         "qid": of(left["qid"], row), "rid": of(right["rid"], col), "dist": pa.array(np.append(dist, compared))})

    schema = f"grp string, qid {knn._kind(routed, 'qid')}, rid {knn._kind(index.rows, 'rid')}, dist double"
    return q_side.groupBy(*names).cogroup(r_side.groupBy(*names)).applyInArrow(match, schema)


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("grp", "qid").orderBy("dist", "rid")
    return hits.where(F.col("rid").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = catalog.NEIGHBOURS, exclude_self: bool = False,
           tile_rows: int = knn.TILE_ROWS) -> DataFrame:
    """(grp, qid, rid, dist, rank) from ``(grp, qid, vec)``: the nearest of what the probed lists hold.

    Queries of a group without references, and those without a complete vector, have no rows.
    """
    if index.centres.where((F.col("share") < 1) | (F.col("reach") < SKETCH_BITS)).isEmpty():
        return _searched(index, queries, k, exclude_self, tile_rows)
    routed = materialize(route(index, queries, k + int(exclude_self)), "index-routed")
    return _first(_ranked(index, routed, k, exclude_self, tile_rows), k)


def _searched(index: Index, queries: DataFrame, k: int, exclude_self: bool, tile_rows: int) -> DataFrame:
    """The exact search: lists are the cells of the exact join, and boxes say which of them a query needs."""
    kept = knn.first_copies(index.rows.select("grp", "rid", "vec", "list"), k, exclude_self)
    placed = materialize(kept.withColumnRenamed("list", "cell"), "index-kept")
    dims = placed.agg(F.max(F.size("vec"))).first()[0]
    boxes = knn.cell_boxes(placed, int(dims or 1), "cell").join(
        placed.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")), ["grp", "cell"])
    boxes = materialize(boxes.withColumnRenamed("cell", "list"), "index-boxes")
    centres = index.centres.select("grp", "list", "centre").join(boxes, ["grp", "list"])
    kinds = f"grp string, qid {knn._kind(queries, 'qid')}, vec array<double>"

    def assign(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return _no_rows("grp", "qid", "vec", "cell")
        own = own.sort_values("c_list")
        return rows[["grp", "qid", "vec"]].assign(
            cell=own.c_list.to_numpy()[_nearest_centre(knn._stack(rows.vec), knn._stack(own.c_centre))])

    def reached(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return _no_rows("grp", "qid", "vec", "limit", "cell")
        low, high, lists, n = knn._stack(own.c_low), knn._stack(own.c_high), own.c_list.to_numpy(), own.c_n.to_numpy()
        out = []
        for piece in knn._pieces(rows, len(own)):
            x, limit = knn._stack(piece.vec), piece.limit.to_numpy().copy()
            squares, far = np.zeros((len(x), len(own))), np.zeros((len(x), len(own)))
            for i in range(x.shape[1]):
                below, above = low[None, :, i] - x[:, i, None], x[:, i, None] - high[None, :, i]
                gap, span = np.maximum(np.maximum(below, above), 0.0), np.maximum(-below, -above)
                squares += gap * gap
                far += span * span
            short = np.flatnonzero(np.isinf(limit))
            if len(short) and not exclude_self and n.sum() >= k:  # own list too short: the boxes that hold k rows for sure
                order = np.argsort(far[short], axis=1)
                enough = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
                limit[short] = kd.reach(far[short, order[np.arange(len(short)), enough]])
            row, at = np.nonzero(squares <= limit[:, None])
            out.append(piece.iloc[row].assign(cell=lists[at])[["grp", "qid", "vec", "limit", "cell"]])
        return pd.concat(out)

    asked = _meet(queries.select("grp", "qid", "vec").where(complete(F.col("vec"))), centres, "qid", assign, f"{kinds}, cell int")
    return knn.cell_join(asked, placed, lambda bounds: _meet(
        bounds, centres, "qid", reached, f"{kinds}, limit double, cell int", ROUTED_ROWS), k, exclude_self, tile_rows)


def calibrate(index: Index, queries: DataFrame, k: int = catalog.NEIGHBOURS, exclude_self: bool = False,
              recall: float = SAMPLE_RECALL, sample_queries: int = SAMPLE_QUERIES, tile_rows: int = knn.TILE_ROWS) -> Index:
    """The index with each group's share and reach set to the least that hold ``recall`` of a sample's neighbours each.

    Groups without a sampled query keep their settings.
    """
    sizes = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("asked"))
    sample = queries.join(sizes, "grp").where(_share_of("qid") <= F.lit(float(sample_queries)) / F.col("asked")).select("grp", "qid", "vec")
    routed = materialize(route(index, sample, k, everything=True), "index-probes")
    exact = _first(_ranked(index, routed, k, exclude_self, tile_rows), k)
    found = exact.select("grp", "qid", "rid").join(
        index.rows.select("grp", "rid", "list", F.col("code").alias("there")), ["grp", "rid"])
    # lists are numbered from 0 in their group
    needed = found.join(routed.select("grp", "qid", "code", "before"), ["grp", "qid"]).withColumn("before", F.get("before", F.col("list"))).withColumn(
        "apart", F.aggregate(F.zip_with("code", "there", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x))
    totals = index.centres.groupBy("grp").agg(F.first("total").alias("all"))
    settings = needed.join(totals, "grp").groupBy("grp").agg(
        F.percentile_approx(F.col("before") / F.col("all"), F.lit(recall), F.lit(10_000)).alias("found"),
        F.percentile_approx("apart", F.lit(recall), F.lit(10_000)).alias("bits"))
    centres = index.centres.join(settings, "grp", "left").withColumns(
        {"share": F.coalesce("found", "share"), "reach": F.coalesce("bits", "reach").cast("int")})
    return Index(materialize(centres.select("grp", "list", "centre", "n", "total", "share", "reach"), "index-lists"), index.rows)


def recall(index: Index, queries: DataFrame, exact: DataFrame, k: int = catalog.NEIGHBOURS, exclude_self: bool = False) -> DataFrame:
    """(grp, queries, refs, met, compared, recall): the search measured against exact neighbours (grp, qid, rid) of the queries.

    ``met`` are the pairs of queries and references of their probed lists, ``compared`` those of them whose distance was taken.
    """
    routed = materialize(route(index, queries, k + int(exclude_self)), "index-routed")
    hits = materialize(_ranked(index, routed, k, exclude_self, knn.TILE_ROWS), "index-hits")
    found = _first(hits, k).select("grp", "qid", "rid", F.lit(1).alias("hit"))
    measured = exact.select("grp", "qid", "rid").join(found, ["grp", "qid", "rid"], "left").groupBy("grp").agg(
        F.countDistinct("qid").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    compared = hits.where(F.col("rid").isNull()).groupBy("grp").agg(F.sum("dist").cast("long").alias("compared"))
    met = routed.groupBy("grp").agg(F.sum("met").alias("met"))
    refs = index.centres.groupBy("grp").agg(F.first("total").alias("refs"))
    return measured.join(met, "grp").join(refs, "grp").join(compared, "grp").select("grp", "queries", "refs", "met", "compared", "recall")
