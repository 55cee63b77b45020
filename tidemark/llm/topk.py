"""Exact top-k search by tiled matrix products.

Rows are dealt into shards, and each shard into tiles.  A query tile is multiplied with the row tiles
of a shard one after another; each product keeps its ``k`` best per query, and the lists of tiles,
then of groups of shards, are merged until one list per query is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

ROW_TILE = 4096
QUERY_TILE = 1024
SHARD_ROWS = 16_384
#: Queries that meet a shard in one task; more of them meet it in several.
QUERY_CHUNK = 32_768
#: Lists merged at a time.
FAN_IN = 32
#: Products up to this size are whole numbers in double precision.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(x: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double: whole numbers, as doubles, which hold them whatever their size."""
    def one(v: Column) -> Column:
        y = v.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)  # larger ones are whole already

    return F.transform(x, one)


def usable(x: Column) -> Column:
    """Not null, and every component a finite number."""
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(ok, F.lit(False))


def exact_scores(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with one vector, exact; those beyond 64 bits become the nearest 64-bit number."""
    if not len(rows):
        return np.zeros(0, np.int64)
    bound = float(np.abs(one).max(initial=0)) * one.size
    large = np.abs(rows).max(axis=1, initial=0) * bound >= EXACT
    out = np.zeros(len(rows), np.int64)
    out[~large] = (rows[~large] @ one).astype(np.int64)
    if large.any():
        own = [int(x) for x in one.tolist()]
        for i in np.flatnonzero(large).tolist():
            out[i] = min(MOST, max(LEAST, sum(int(x) * y for x, y in zip(rows[i].tolist(), own))))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact: in doubles where they hold every partial sum, else as ``exact_scores``."""
    most_a, most_b = (np.abs(x).max(axis=1, initial=0) for x in (a, b))
    dims = max(1, a.shape[1])
    with np.errstate(over="ignore"):
        bound = float(most_a.max(initial=0)) * float(most_b.max(initial=0)) * dims
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    fits = (EXACT / dims) ** 0.5 / 2
    few_a, few_b = most_a <= fits, most_b <= fits
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(few_a, few_b)] = (a[few_a] @ b[few_b].T).astype(np.int64)
    for i in np.flatnonzero(~few_a).tolist():
        out[i] = exact_scores(b, a[i])
    for j in np.flatnonzero(~few_b).tolist():
        out[few_a, j] = exact_scores(a[few_a], b[j])
    return out


def best(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int):
    """The ``k`` best rows of one tile for each query, without the query's own row; ties to the smaller id."""
    score = product(queries, rows)
    own = query_ids[:, None] == row_ids[None, :]
    score[own] = np.iinfo(np.int64).min
    low = max(0, len(row_ids) - k)
    cut = np.partition(score, low, axis=1)[:, low]
    q, r = np.nonzero((score >= cut[:, None]) & ~own)
    order = np.lexsort((row_ids[r], ~score[q, r], q))  # ~x falls as x rises, over all 64 bits
    q, r = q[order], r[order]
    first = np.searchsorted(q, np.arange(len(query_ids)))
    top = np.arange(len(q)) - first[q] < k
    return query_ids[q[top]], row_ids[r[top]], score[q[top], r[top]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows of each query row.

    Vectors that are null or hold a null or non-finite component take no part; vectors are compared
    with those of their own length; rows without id take no part; of rows with equal id none is a
    candidate for the other; a query with no candidate has no rows.  An empty vector scores 0.  A score
    beyond 64 bits is the nearest 64-bit number, and such scores tie.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), F.col(vector_col).alias("v")) \
        .where(F.col("id").isNotNull() & usable(F.col("v")))
    own = materialize(own.select("id", "is_query", whole(F.col("v"), scale).alias("v"), F.size("v").alias("dims")), "vectors")
    n = own.count()
    shards = max(1, -(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // ROW_TILE))
    chunks = max(1, -(-own.where("is_query").count() // QUERY_CHUNK))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = own.select(F.col("id").alias("row"), F.col("v").alias("at"), F.col("dims").alias("row_dims"),
                      part(shards).alias("row_shard"), every(chunks).alias("row_chunk"))
    # the stated query set goes to every shard in blocks
    asked = own.where("is_query").select("id", "v", "dims", part(chunks).alias("chunk"), every(shards).alias("shard"))

    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(shard):
            number = int(shard["row_shard"].iloc[0])
            a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (queries["v"], shard["at"]))
            qi, ri = queries["id"].to_numpy(), shard["row"].to_numpy()
            for i in range(0, len(a), QUERY_TILE):
                tiles = [best(qi[i:i + QUERY_TILE], a[i:i + QUERY_TILE], ri[j:j + ROW_TILE], b[j:j + ROW_TILE], k)
                         for j in range(0, len(b), ROW_TILE)]
                q, r, s = (np.concatenate(x) for x in zip(*tiles))
                order = np.lexsort((r, ~s, q))
                q, r, s = q[order], r[order], s[order]
                top = np.arange(len(q)) - np.searchsorted(q, q) < k
                found.append(pd.DataFrame({"query_id": q[top], "vec_id": r[top], "score": s[top], "shard": number}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []})

    lists = asked.groupBy("shard", "chunk", "dims").cogroup(rows.groupBy("row_shard", "row_chunk", "row_dims")).applyInPandas(
        run, "query_id long, vec_id long, score long, shard int")
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        w = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
