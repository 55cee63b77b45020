"""Exact nearest-neighbour join and what follows from it.

Distances are quantised to 1e-6 and ties go to the smaller reference id, so results do not
depend on partitioning or summation order.

* Of references with one vector only the first ids can be among the nearest; the others are left out first.
* References that provably fit (``rows x features`` below ``broadcast_values``) are broadcast as a k-d tree
  (``kd.py``) that every query batch is searched in, in tasks of equal size whatever files the queries come from.
* Larger references are cut into the cells of a k-d tree over a sample.  A query's own cell gives a distance
  that its neighbours lie within, and only cells whose box reaches into this ball are visited.
  Cells are split into tiles of bounded size on both sides; a tile emits at most k rows per
  query, never its pairs.
* Where the boxes leave more than half of all pairs (many dimensions), cells are left aside: blocks of several tiles of
  either side are compared, so that rows are sent to fewer places and a block emits at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import similarity_pct, stable_round
from tidemark.operators.kd import (  # noqa: F401
    BLOCK, LEAF, QUANTUM, Tree, box_visits, distances, first_of_each, pair_squares, quantised, reach,
)
from tidemark.session import materialize, spread

BROADCAST_VALUES = 4_000_000
TILE_ROWS = 8_192
#: Cells of larger references, and rows of the sample that each is cut from.
MAX_CELLS = 2_048
CELL_SAMPLE = 32
#: Tiles that a block of either side holds, and which part of the queries tells how many pairs the boxes leave.
BLOCK_TILES = 8
ROUTED_PART = 16


def vectors(df: DataFrame, key: str, features: Sequence[str], by: str | None, label: str = "id") -> DataFrame:
    """(grp, id, vec) from scaled feature columns."""
    grp = F.col(by).cast("string") if by else F.lit("")
    vec = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(grp.alias("grp"), F.col(key).alias(label), vec.alias("vec"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _stack(vec: pd.Series) -> np.ndarray:
    return np.stack(vec.to_numpy()).astype(float, copy=False)


def _pieces(part: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Slices whose rows times ``width`` stay within a block of memory."""
    step = max(1, BLOCK // max(1, width))
    for lo in range(0, len(part), step):
        yield part.iloc[lo:lo + step]


def nearest(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int, exclude_self: bool,
            limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, reference id, distance) of the k nearest; ``rid`` ascending."""
    row, col, dist = Tree(rid, r, k + int(exclude_self)).nearest(qid, q, k, exclude_self, limit)
    return qid[row], rid[col], dist


def first_copies(refs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The references that can be anyone's neighbours: finite vectors, of equal ones the first by id.

    Ranks are limited before the shuffle, so one vector of any number of rows is no large group.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    same = Window.partitionBy("grp", "vec").orderBy("rid")
    place = F.dense_rank().over(same) if exclude_self else F.row_number().over(same)
    return refs.where(F.col("grp").isNotNull() & F.col("vec").isNotNull() & finite).withColumn("__place", place).where(
        F.col("__place") <= k + int(exclude_self)).drop("__place")


def _by_group(df: DataFrame, *names: str) -> dict[str, tuple[np.ndarray, ...]]:
    """Columns and vectors of a small table as arrays: {grp: (*names, vec)}."""
    rows = df.toArrow().combine_chunks()
    out = {}
    for g, at in pd.Series(rows["grp"].to_pandas()).groupby(rows["grp"].to_pandas()).indices.items():
        part = rows.take(at)
        vec = part["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        out[g] = (*(part[c].to_pandas().to_numpy() for c in names), vec.reshape(len(at), -1))
    return out


def knn_join(queries: DataFrame, refs: DataFrame, k: int = catalog.NEIGHBOURS, exclude_self: bool = False,
             broadcast_values: int = BROADCAST_VALUES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(grp, qid, rid, dist, rank) from ``(grp, qid, vec)`` and ``(grp, rid, vec)``."""
    refs = materialize(first_copies(refs.select("grp", "rid", "vec"), k, exclude_self), "knn-kept")
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if size.n == 0:
        return queries.limit(0).select("grp", "qid", F.lit(None).cast(_kind(refs, "rid")).alias("rid"),
                                       F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    if size.n * size.d <= broadcast_values:
        return _broadcast_join(queries, refs, k, exclude_self)
    return _tiled_join(queries, refs, k, exclude_self, size.n, size.d, broadcast_values, tile_rows)


def _broadcast_join(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    # size checked by the caller
    groups = {g: Tree(rid, r, k + int(exclude_self)) for g, (rid, r) in _by_group(refs.orderBy("grp", "rid"), "rid").items()}
    shared = queries.sparkSession.sparkContext.broadcast(groups)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                if g not in shared.value:
                    continue
                tree, qid = shared.value[g], part.qid.to_numpy()
                row, col, dist = tree.nearest(qid, _stack(part.vec), k, exclude_self)
                # a row's rank counts its own neighbours, whatever rows share its id and wherever they lie
                yield pd.DataFrame({"grp": g, "qid": qid[row], "rid": tree.rid[col], "dist": dist,
                                    "rank": (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)})

    return spread(queries.select("grp", "qid", "vec")).mapInPandas(
        rank, f"grp string, qid {_kind(queries, 'qid')}, rid {_kind(refs, 'rid')}, dist double, rank int")


def _tiled_join(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool, n: int, dims: int,
                broadcast_values: int, tile_rows: int) -> DataFrame:
    spark = refs.sparkSession
    wanted = CELL_SAMPLE * int(min(MAX_CELLS, max(16, -(-n // tile_rows)), max(16, broadcast_values // dims)))
    token = F.pmod(F.xxhash64("grp", "rid"), F.lit(2 ** 31)) / F.lit(float(2 ** 31))
    first = Window.partitionBy("grp").orderBy("__t", "rid")
    picked = refs.withColumn("__t", token).where(F.col("__t") < min(1.0, wanted / n)).withColumn(
        "__r", F.row_number().over(first)).where(F.col("__r") <= wanted).select("grp", "vec")
    trees = {g: Tree(np.arange(len(x)), x, 1, CELL_SAMPLE) for g, (x,) in _by_group(picked).items()}
    shared = spark.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                yield part.assign(cell=shared.value[g].home(_stack(part.vec)).astype(np.int32) if g in shared.value else np.int32(-1))

    placed = materialize(refs.select("grp", "rid", "vec").mapInPandas(
        assign, f"grp string, rid {_kind(refs, 'rid')}, vec array<double>, cell int"), "knn-refs")
    asked = spread(queries.select("grp", "qid", "vec")).mapInPandas(
        assign, f"grp string, qid {_kind(queries, 'qid')}, vec array<double>, cell int")
    # One row per cell: bounded by their number.
    boxes = _by_group(cell_boxes(placed, dims, "cell").select("grp", "cell", F.concat("low", "high").alias("vec")), "cell")
    limits = {}
    for g, (cell, box) in boxes.items():
        levels = trees[g].levels if g in trees else 0
        low, high = (np.full((2 << levels, box.shape[1] // 2), f) for f in (np.inf, -np.inf))
        at = np.maximum(cell, 0) + (1 << levels)
        low[at], high[at] = np.split(box, 2, axis=1)
        for i in range((1 << levels) - 1, 0, -1):
            low[i], high[i] = np.minimum(low[2 * i], low[2 * i + 1]), np.maximum(high[2 * i], high[2 * i + 1])
        limits[g] = low, high, levels, int(min(0, cell.min()))
    reached = spark.sparkContext.broadcast(limits)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                if g not in reached.value:
                    continue
                low, high, levels, base = reached.value[g]
                for piece in _pieces(part, low.size):
                    row, cell = box_visits(_stack(piece.vec), piece.limit.to_numpy(), low, high, levels)
                    yield piece.iloc[row].assign(cell=(cell + base).astype(np.int32))[["grp", "qid", "vec", "limit", "cell"]]

    return cell_join(asked, placed, lambda bounds: bounds.mapInPandas(
        route, f"grp string, qid {_kind(queries, 'qid')}, vec array<double>, limit double, cell int"), k, exclude_self, tile_rows,
        blocks=True)


def cell_boxes(placed: DataFrame, dims: int, cell: str) -> DataFrame:
    """(grp, cell, low, high): the box that the references of each cell lie in."""
    side = lambda f: F.filter(F.array(*[f(F.get("vec", F.lit(i))) for i in range(dims)]), lambda x: x.isNotNull())
    return placed.groupBy("grp", cell).agg(side(F.min).alias("low"), side(F.max).alias("high"))


def cell_join(asked: DataFrame, placed: DataFrame, route, k: int, exclude_self: bool, tile_rows: int, blocks: bool = False) -> DataFrame:
    """(grp, qid, rid, dist, rank) of queries (grp, qid, vec, cell) and references (grp, rid, vec, cell), written.

    ``cell`` is a query's own; ``route`` takes (grp, qid, vec, limit), limits being squares of a distance that the
    neighbours lie within, to (grp, qid, vec, limit, cell): all cells that reach there.  With ``blocks`` all pairs are
    compared in larger blocks where cells leave most of them.
    """
    kinds = f"grp string, qid {_kind(asked, 'qid')}"
    counts = placed.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))

    def tiles(queries: DataFrame, one: bool) -> tuple[DataFrame, DataFrame]:
        """Both sides cut into tiles; of the references' parts all, or the first."""
        visits = queries.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("v"))
        plan = materialize(counts.join(visits, ["grp", "cell"], "right").select(
            "grp", "cell", F.coalesce(F.ceil(F.col("n") / tile_rows), F.lit(1)).cast("int").alias("r_parts"),
            F.ceil(F.col("v") / tile_rows).cast("int").alias("q_parts")), "knn-plan")
        r_part = F.pmod(F.xxhash64("rid"), F.col("r_parts")).cast("int").alias("rp")
        q_part = F.pmod(F.xxhash64("qid"), F.col("q_parts")).cast("int").alias("qp")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        r = placed.join(plan, ["grp", "cell"]).select("grp", "cell", "rid", "vec", r_part, every("q_parts").alias("qp"))
        if one:
            q = queries.join(plan, ["grp", "cell"]).select("grp", "cell", "qid", "vec", F.lit(0).alias("rp"), q_part)
            return q, r.where("rp = 0")
        return queries.join(plan, ["grp", "cell"]).select(
            "grp", "cell", "qid", "vec", "limit", every("r_parts").alias("rp"), q_part), r

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"grp": [], "qid": [], "vec": [], "limit": []}, dtype=object)
        limit = np.full(len(left), np.inf)
        if len(right):
            right = right.sort_values("rid")
            tree = Tree(right.rid.to_numpy(), _stack(right.vec), k + int(exclude_self))
            row, _, dist = tree.nearest(left.qid.to_numpy(), _stack(left.vec), k, exclude_self)
            full = np.flatnonzero(np.bincount(row, minlength=len(left)) >= k)
            limit[full] = reach(dist[np.searchsorted(row, full, side="right") - 1] ** 2)
        return left[["grp", "qid", "vec"]].assign(limit=limit)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"grp": [], "qid": [], "rid": [], "dist": []})
        right = right.sort_values("rid")
        qid, rid, dist = nearest(left.qid.to_numpy(), _stack(left.vec), right.rid.to_numpy(), _stack(right.vec),
                                 k, exclude_self, left.limit.to_numpy())
        return pd.DataFrame({"grp": left.grp.iloc[0], "qid": qid, "rid": rid, "dist": dist})

    keys = ["grp", "cell", "rp", "qp"]
    asked = materialize(asked.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), "knn-asked")
    q_side, r_side = tiles(asked, True)
    bounds = materialize(q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInPandas(
        bound, f"{kinds}, vec array<double>, limit double"), "knn-bounds")
    if blocks and visited_share(bounds, route, counts) > 0.5:
        found = block_join(bounds, placed, k, exclude_self, BLOCK_TILES * tile_rows)
    else:
        q_side, r_side = tiles(materialize(route(bounds), "knn-queries"), False)
        found = q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInPandas(
            match, f"{kinds}, rid {_kind(placed, 'rid')}, dist double")
    w = Window.partitionBy("grp", "qid").orderBy("dist", "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visited_share(bounds: DataFrame, route, counts: DataFrame) -> float:
    """The share of all pairs that lie in cells which queries are routed to, by a part of the queries."""
    some = bounds.where(F.pmod(F.xxhash64("grp", "qid", "vec"), F.lit(ROUTED_PART)) == 0)
    met = route(some).groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("v")).join(counts, ["grp", "cell"]).agg(F.sum(F.col("n") * F.col("v")))
    every = some.groupBy("grp").agg(F.count(F.lit(1)).alias("v")).join(
        counts.groupBy("grp").agg(F.sum("n").alias("n")), "grp").agg(F.sum(F.col("n") * F.col("v")))
    every = every.first()[0]
    return (met.first()[0] or 0) / every if every else 0.0


def block_join(asked: DataFrame, placed: DataFrame, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """(grp, qid, rid, dist) of written queries (grp, qid, vec, limit) and references (grp, rid, vec): all pairs of a group.

    Both sides are dealt into blocks of ``block_rows`` at most about; every pair of blocks is one group of rows, and few
    blocks are cut further on the queries' side, so that all cores have some.
    """
    q_parts, r_parts = (F.ceil(F.col(c) / block_rows) for c in ("v", "n"))
    sizes = materialize(placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(
        asked.groupBy("grp").agg(F.count(F.lit(1)).alias("v")), "grp"), "knn-blocks")
    pairs = sizes.agg(F.sum(q_parts * r_parts)).first()[0] or 1
    finer = max(1, -(-4 * asked.sparkSession.sparkContext.defaultParallelism // int(pairs)))
    plan = sizes.select("grp", r_parts.cast("int").alias("r_parts"), F.greatest(
        q_parts, F.least(q_parts * finer, F.ceil(F.col("v") / LEAF))).cast("int").alias("q_parts"))
    # rows are dealt out by their place in the files, as ids and vectors may repeat
    dealt = lambda parts: F.pmod(F.xxhash64(F.col("__n")), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    def side(df: DataFrame, *names: str) -> DataFrame:
        return df.select("grp", *names).withColumn("__n", F.monotonically_increasing_id()).join(F.broadcast(plan), "grp")

    q_side = side(asked, "qid", "vec", "limit").select("grp", "qid", "vec", "limit", dealt("q_parts").alias("qp"), every("r_parts").alias("rp"))
    r_side = side(placed, "rid", "vec").select("grp", "rid", "vec", every("q_parts").alias("qp"), dealt("r_parts").alias("rp"))

    def values(rows: pa.Table) -> np.ndarray:
        return rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def ids(rows: pa.Table, name: str) -> np.ndarray:
        out = np.empty(rows.num_rows, object)
        out[:] = rows[name].to_pylist()
        return out

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        row = col = np.zeros(0, np.int64)
        dist = np.zeros(0)
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, [("rid", "ascending")]))
            tree = Tree(ids(right, "rid"), values(right), k + int(exclude_self))
            row, col, dist = tree.nearest(ids(left, "qid"), values(left), k, exclude_self, left["limit"].to_numpy())
        return pa.table({"grp": left["grp"].take(pa.array(row)), "qid": left["qid"].take(pa.array(row)),
                         "rid": right["rid"].take(pa.array(col)), "dist": pa.array(dist)})

    keys = ["grp", "qp", "rp"]
    return q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInArrow(
        match, f"grp string, qid {_kind(asked, 'qid')}, rid {_kind(placed, 'rid')}, dist double")


# ---------------------------------------------------------------------------
# Approximate join: bucketed random projections with exact re-ranking
# ---------------------------------------------------------------------------
LSH_TABLES, LSH_PROJECTIONS, LSH_WIDTH = 24, 3, 4.0
#: Calibrated widths: queries of a group that they are measured on, their recall there, and how often a width is narrowed at most.
LSH_SAMPLE, LSH_TARGET, LSH_STEPS = 512, 0.95, 24


def _lines(dims: int, tables: int, projections: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Projections of each hash table and their shifts in widths."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, projections, dims)), rng.uniform(0, 1, size=(tables, projections))


def _buckets(df: DataFrame, key: str, dims: int, width: float | dict[str, float], tables: int, projections: int) -> DataFrame:
    """(grp, key, vec, cell): a row per hash table, the cell naming table and bucket; ``width`` may be each group's own."""
    lines, shifts = _lines(dims, tables, projections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in _pieces(batch, tables * dims):
                x = _stack(piece.vec)
                own = piece.grp.map(width).fillna(LSH_WIDTH).to_numpy()[:, None] if isinstance(width, dict) else width
                for t in range(tables):
                    at = np.floor((x @ lines[t].T) / own + shifts[t]).astype(np.int64)
                    yield piece.assign(cell=[f"{t}:" + ":".join(map(str, row)) for row in at.tolist()])

    return spread(df.select("grp", key, "vec")).mapInPandas(run, f"grp string, {key} {_kind(df, key)}, vec array<double>, cell string")


def lsh_widths(exact: DataFrame, queries: DataFrame, refs: DataFrame, tables: int = LSH_TABLES,
               projections: int = LSH_PROJECTIONS) -> dict[str, float]:
    """The narrowest width of each group, ``LSH_WIDTH`` at most, that finds the neighbours of a bounded sample of its queries.

    The nearer neighbours are, the narrower buckets may be: buckets then hold few rows however many there are in all.
    """
    first = Window.partitionBy("grp").orderBy(F.xxhash64("qid"))
    picked = queries.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= LSH_SAMPLE).select(
        "grp", "qid", F.col("vec").alias("a"))
    pairs = exact.join(picked, ["grp", "qid"]).join(refs.select("grp", "rid", F.col("vec").alias("b")), ["grp", "rid"])
    gaps = _by_group(pairs.select("grp", F.concat("a", "b").alias("vec")))
    out = {}
    for g, (both,) in gaps.items():
        a, b = np.split(both, 2, axis=1)
        lines, shifts = _lines(a.shape[1], tables, projections)
        a, b = (np.einsum("nd,tpd->ntp", x, lines) for x in (a, b))
        out[g] = LSH_WIDTH
        for i in range(1, LSH_STEPS + 1):
            width = LSH_WIDTH * 0.75 ** i
            if (np.floor(a / width + shifts) == np.floor(b / width + shifts)).all(axis=2).any(axis=1).mean() < LSH_TARGET:
                break
            out[g] = width
    return out


def _lsh_refs(refs: DataFrame, k: int) -> DataFrame:
    """References without later copies of a vector; all rows of an id stay, as repeats are dropped from the hits."""
    return materialize(first_copies(refs.select("grp", "rid", "vec"), k, True), "lsh-kept")


def _lsh_sides(queries, refs, width, tables, projections, tile_rows):
    size = refs.agg(F.max(F.size("vec")).alias("d")).first()
    dims = int(size.d or 1)
    q = materialize(_buckets(queries, "qid", dims, width, tables, projections), "lsh-queries")
    r = materialize(_buckets(refs, "rid", dims, width, tables, projections), "lsh-refs")
    plan = r.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).join(
        q.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("v")), ["grp", "cell"])
    return q, r, materialize(plan, "lsh-plan")


def _packs(plan: DataFrame, tile_rows: int) -> int:
    """Groups that the tiles of a written plan (grp, cell, n, v) go to, of about four tiles' rows each at any size."""
    q_parts, r_parts = F.ceil(F.col("v") / tile_rows), F.ceil(F.col("n") / tile_rows)
    rows = plan.agg(F.sum(F.col("n") * q_parts + F.col("v") * r_parts)).first()[0]
    return max(256, -(-int(rows or 0) // (4 * tile_rows)))


def _packed(q: DataFrame, r: DataFrame, plan: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into tiles, with the pack that a tile goes to."""
    packs = _packs(plan, tile_rows)
    plan = plan.select("grp", "cell", F.ceil(F.col("n") / tile_rows).cast("int").alias("r_parts"),
                       F.ceil(F.col("v") / tile_rows).cast("int").alias("q_parts"))

    def tiles(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str, key: str) -> DataFrame:
        return df.join(plan, ["grp", "cell"]).select(
            "grp", "cell", key, "vec", F.pmod(F.xxhash64(key), F.col(own_parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)).alias(other))

    # buckets are grouped into fewer, larger groups of rows, so that a group is worth a call
    spread = F.pmod(F.xxhash64("grp", "cell", "rp", "qp"), F.lit(packs)).cast("int")
    q_side = tiles(q, "qp", "q_parts", "rp", "r_parts", "qid").withColumn("pack", spread)
    r_side = tiles(r, "rp", "r_parts", "qp", "q_parts", "rid").withColumn("pack", spread)
    return q_side, r_side


def _tile_hits(left: pd.DataFrame, right: pd.DataFrame, tile: np.ndarray, start: np.ndarray, n: np.ndarray,
               k: int, exclude_self: bool) -> Iterator[dict]:
    """Hits of queries in their tiles, rows ``start`` to ``start + n`` of ``right``: many small tiles at once, large ones by tree."""
    grp, qid, rid = left.grp.to_numpy(), left.qid.to_numpy(), right.rid.to_numpy()
    q, r = _stack(left.vec), _stack(right.vec)
    small = np.flatnonzero((n > 0) & (n <= LEAF) & np.isfinite(q).all(axis=1))
    pairs = np.cumsum(n[small])
    ends = np.searchsorted(pairs, np.arange(1, -(-int(pairs[-1]) // (BLOCK // q.shape[1])) + 1) * (BLOCK // q.shape[1])) if len(small) else []
    for rows in np.split(small, ends):
        row = np.repeat(rows, n[rows])
        col = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows]) + start[row]
        if exclude_self:
            other = qid[row] != rid[col]
            row, col = row[other], col[other]
        with np.errstate(over="ignore", invalid="ignore"):
            d = quantised(pair_squares(q[row], r[col]))
        near = np.isfinite(d)
        row, col, d = first_of_each(row[near], col[near], d[near], k)
        yield {"grp": grp[row], "qid": qid[row], "rid": rid[col], "dist": d}
    large = np.flatnonzero(n > LEAF)
    large = large[np.argsort(tile[large], kind="stable")]
    for rows in np.split(large, np.flatnonzero(np.diff(tile[large])) + 1) if len(large) else ():
        part = slice(start[rows[0]], start[rows[0]] + n[rows[0]])
        found, other, d = nearest(qid[rows], q[rows], rid[part], r[part], k, exclude_self)
        yield {"grp": grp[rows[0]], "qid": found, "rid": other, "dist": d}


def knn_join_lsh(queries: DataFrame, refs: DataFrame, k: int = catalog.NEIGHBOURS, exclude_self: bool = False,
                 width: float = LSH_WIDTH, tables: int = LSH_TABLES, projections: int = LSH_PROJECTIONS,
                 tile_rows: int = TILE_ROWS, sides=None) -> DataFrame:
    """(grp, qid, rid, dist, rank), approximate: neighbours that share a bucket of any table, exactly ranked.

    ``width`` is in units of the (scaled) vectors.  Buckets of any size are cut into tiles of
    ``tile_rows`` on both sides, and a tile emits at most ``k`` rows per query, never its pairs.  A query
    that shares no bucket with a reference has no rows.
    """
    q, r, plan = sides or _lsh_sides(queries, _lsh_refs(refs, k), width, tables, projections, tile_rows)
    q_side, r_side = _packed(q, r, plan, tile_rows)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"grp": [], "qid": [], "rid": [], "dist": []})]
        if len(left) and len(right):
            names = ["grp", "cell", "rp", "qp"]
            tile = pd.concat([left[names], right[names]]).groupby(names, sort=False).ngroup().to_numpy()
            order = np.lexsort((pd.factorize(right.rid, sort=True)[0], tile[len(left):]))
            right, own = right.iloc[order], tile[len(left):][order]
            start, end = (np.searchsorted(own, tile[:len(left)], side) for side in ("left", "right"))
            found += [pd.DataFrame(f) for f in _tile_hits(left, right, tile[:len(left)], start, end - start, k, exclude_self)]
        return pd.concat([f for f in found if len(f)] or found)

    # all hits of a query meet once, to lose repeats and to be ranked
    hits = q_side.groupBy("pack").cogroup(r_side.groupBy("pack")).applyInPandas(
        match, f"grp string, qid {_kind(q, 'qid')}, rid {_kind(r, 'rid')}, dist double").repartition("grp", "qid").distinct()
    w = Window.partitionBy("grp", "qid").orderBy("dist", "rid")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lsh_recall(queries: DataFrame, refs: DataFrame, k: int = catalog.NEIGHBOURS, exclude_self: bool = False, **how) -> DataFrame:
    """(grp, queries, recall, compared, all_pairs): the hashed join measured against the exact one.

    Where no ``width`` is given, each group has its own (``lsh_widths``).
    """
    exact = materialize(knn_join(queries, refs, k, exclude_self), "knn-exact")
    settings = {"tables": LSH_TABLES, "projections": LSH_PROJECTIONS, "tile_rows": TILE_ROWS} | how
    if "width" not in settings:
        settings["width"] = lsh_widths(exact, queries, refs, settings["tables"], settings["projections"])
    sides = _lsh_sides(queries, _lsh_refs(refs, k), **settings)
    found = knn_join_lsh(queries, refs, k, exclude_self, sides=sides, **settings).select("grp", "qid", "rid", F.lit(1).alias("hit"))
    recall = exact.join(found, ["grp", "qid", "rid"], "left").groupBy("grp").agg(
        (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    pairs = sides[2].groupBy("grp").agg(F.sum(F.col("n") * F.col("v")).alias("compared"))
    n = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("queries")).join(
        refs.groupBy("grp").agg(F.count(F.lit(1)).alias("refs")), "grp")
    return n.join(recall, "grp").join(pairs, "grp", "left").select(
        "grp", "queries", "recall", F.coalesce("compared", F.lit(0)).alias("compared"), (F.col("queries") * F.col("refs")).alias("all_pairs"))


def summarise(neighbours: DataFrame, payload: DataFrame, evidence: Sequence[Column]) -> DataFrame:
    """(grp, qid, p_retrieval, avg_similarity, sources) per query.

    ``payload`` has one row per reference ``(rid, churned, ...)``; ``evidence`` are the struct
    fields shown for the nearest rows.  The vote runs over all neighbours, similarity and
    evidence over the nearest three.
    """
    near = F.col("rank") <= catalog.EVIDENCE_ROWS
    shown = F.struct(F.col("rank"), stable_round(similarity_pct(F.col("dist")), 1).alias("similarity"), *evidence)
    return neighbours.join(payload, "rid").groupBy("grp", "qid").agg(
        F.avg("churned").alias("p_retrieval"),
        F.avg(F.when(near, similarity_pct(F.col("dist")))).alias("avg_similarity"),
        F.sort_array(F.collect_list(F.when(near, shown))).alias("sources"),
    )


def out_of_distribution(avg_similarity: Column) -> Column:
    return F.coalesce(avg_similarity, F.lit(100.0)) < catalog.OOD_SIMILARITY


def drift_audit(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, n, ood_rows, ood_pct) from rows with ``avg_similarity``."""
    ood = out_of_distribution(F.col("avg_similarity"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ood, 1)).alias("ood_rows")
    ).withColumn("ood_pct", stable_round(F.col("ood_rows") * 100 / F.col("n"), 1))
