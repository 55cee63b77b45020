"""Connected components of links, without gathering any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of a link; the root is the component's smallest node.

    Alternates two star operations until no link changes: a node's larger neighbours are hung under
    its smallest neighbour, then its smaller ones are.  The number of links never grows, and the
    rounds grow with the logarithm of the longest path.  A hub's links meet only in a join on the
    hub (which adaptive execution splits) and in a minimum (summed up before the shuffle).
    """
    pair = lambda df: df.where("u > v").distinct()
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    state = materialize(pair(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    before = _signature(state)
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = state.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = materialize(pair(larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
                                 .union(state.join(least, "u").where("m = v").select("u", "v"))), "links")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = materialize(pair(large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                                 .union(smallest.select("u", F.col("m").alias("v")))), "links")
        after = _signature(small)
        discard(state)
        discard(large)
        state = small
        if after == before:
            break
        before = after
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
