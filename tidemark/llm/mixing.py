"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its share of the tokens to the power of an exponent between 0 (all alike) and 1
(as they are), normalised.  The exponent is found by section: each pass evaluates a grid over the
interval left and keeps the section that holds the target, so a pass is one small aggregate however
many sources there are.  The weights are realised as one stream that all sources give their documents
to, each in one permutation after another (epochs) and at the pace of its weight; the stream is cut into
blocks with a budget of tokens each, and a block's documents are permuted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, materialize, unboxed

#: Grid points of a pass and passes: the exponent is exact to ``(1 / (GRID - 1)) ** PASSES``.
GRID = 33
PASSES = 4
#: Documents that a range of places holds on average; sums go by range first.
RANGE_ROWS = 1024
BLOCK_TOKENS = 1 << 20
#: Largest number of times that a document may be repeated.
MAX_REPEATS = 2.0


def words_of(text: Column) -> Column:
    """Words of a text (runs of characters other than ASCII white space) and one for its end."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long") + 1


def _measures(sources: DataFrame, grid: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy in nats, most repetitions when the largest source is seen once) of each grid point.

    Two aggregates keyed by the grid point; ``share`` is above 0 for every source.
    """
    each = sources.select("share", F.explode(F.array(*map(F.lit, grid))).alias("a")).withColumn(
        "w", F.pow("share", "a"))
    found = each.groupBy("a").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"),
        F.max(F.col("w") / F.col("share")).alias("most"), F.min(F.col("w") / F.col("share")).alias("least"))
    return sorted((r["a"], math.log(r["z"]) - r["wl"] / r["z"], r["most"] / r["least"]) for r in found.collect())


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = MAX_REPEATS) -> float:
    """The exponent for a target entropy (nats), or the smallest one that keeps to a limit of repetitions.

    Entropy and repetitions both fall as the exponent rises, so either has one crossing; a target out
    of reach gives the end of the interval that is nearest to it.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        found = _measures(sources, grid)
        if not found:
            return 1.0
        ok = [(h <= entropy if entropy is not None else m <= repeats * (1 + 1e-12)) for _, h, m in found]
        at = next((i for i, x in enumerate(ok) if x), len(found) - 1)
        low, high = found[max(0, at - 1)][0], found[at][0]
    return high


def mixture_weights(docs: DataFrame, source_col: str, entropy: float | None, repeats: float | None,
                    budget: int | None) -> tuple[DataFrame, float]:
    """(source, size, n, share, weight, quota), and the tokens that the mixture is made for: for a table with a ``tokens`` column.

    The quota is the source's weight in those tokens.  Without a budget they are the least with which every source
    is seen whole at least once.
    """
    sizes = materialize(docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shared = sizes.withColumn("share", F.col("size") / F.lit(float(max(1, total))))
    alpha = exponent(shared, entropy, repeats)
    raw = shared.withColumn("w", F.pow("share", F.lit(alpha)))
    z, least = raw.agg(F.sum("w"), F.max(F.col("size") / F.col("w"))).first()
    weighted = raw.withColumn("weight", F.col("w") / F.lit(z or 1.0))
    quota = F.col("w") * F.lit(least or 0.0) if budget is None else F.col("weight") * F.lit(float(budget))
    whole = F.ceil(quota).cast("long") if budget is not None else F.greatest(F.round(quota).cast("long"), F.col("size"))
    tokens = float(budget) if budget is not None else (least or 0.0) * (z or 1.0)
    return materialize(weighted.select("source", "size", "n", "share", "weight", whole.alias("quota")), "source-weights"), tokens


def _before(totals: DataFrame, key: str, n: str) -> DataFrame:
    """(key, before): the sum of ``n`` over all smaller whole numbers ``key``, by groups of ``RANGE_ROWS`` of them."""
    grouped = totals.select(key, n, F.floor(F.col(key) / RANGE_ROWS).alias("_g"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_g").agg(F.sum(n).alias("_n")).select(
        "_g", F.coalesce(F.sum("_n").over(upto(Window.orderBy("_g"))), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum(n).over(upto(Window.partitionBy("_g").orderBy(key))), F.lit(0))
    return grouped.join(groups, "_g").select(key, (F.col("_b") + own).alias("before"))


def mix(docs: DataFrame, source_col: str = "source", entropy: float | None = None, repeats: float | None = MAX_REPEATS,
        budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """One row for each time a document is taken: doc_id, source, tokens, epoch, block, position, weight, text_key.

    A document's tokens are its words and an end.  A source's documents follow each other in permutations (epochs),
    and a document's time is the tokens its source gave before, divided by the source's weight.  In the order of
    time all sources give to one stream: with a budget, every document that begins before the stream holds it, so
    the mixture has the budget and less than a document more; without one, what begins before a source's quota.
    A block takes the documents that begin in its ``block_tokens`` of the stream, so it holds those and less than its
    longest document more; blocks are numbered from 0 without gaps.

    A null source is a source of its own; null and empty texts have one token; an empty table gives an empty mixture.
    Rows alike in id and text stand at one place of the stream, so they are taken together and count as one document
    for these bounds.  ``position`` runs gapless from 0 in each block.
    """
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit("="), F.col(source_col).cast("string")).alias("s"),
        words_of(F.col(text_col)).alias("tokens"), F.xxhash64(text_col).alias("text_key")).withColumn(
        "s", F.coalesce("s", F.lit("null"))), "mix-rows")
    weights, wanted = mixture_weights(rows, "s", entropy, repeats, budget)
    held = rows.join(weights.withColumnRenamed("source", "s"), "s")
    last = F.greatest(F.ceil(F.col("quota") / F.col("size")) - 1, F.lit(0)).cast("int")
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    taken = held.where("quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "h", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"), F.col("text_key"))).withColumn(
        "range", F.floor(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * ranges).cast("long"))
    taken = materialize(taken.select("doc_id", "s", "tokens", "text_key", "epoch", "h", "range", "size", "weight", "quota"), "taken")
    before = Window.partitionBy("s", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = taken.groupBy("s", "epoch", "range").agg(F.sum("tokens").alias("n")).select(
        "s", "epoch", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # rows of one hash (repeated rows) stand at one place, so that an epoch takes all of them or none
    upto = Window.partitionBy("s", "epoch", "range").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("s", "epoch", "range", "h")
    placed = taken.join(offsets, ["s", "epoch", "range"]).withColumn(
        "at", F.col("epoch") * F.col("size") + F.col("before") + F.sum("tokens").over(upto) - F.sum("tokens").over(alike))
    count = weights.where("quota > 0").agg(F.sum(F.col("n") * (last + 1))).first()[0] or 0
    times = max(1, -(-int(count) // RANGE_ROWS))
    span = F.lit(times / max(wanted, 1.0))
    placed = materialize(placed.where(F.col("at") < F.col("quota")).withColumn("t", F.col("at") / F.col("weight")).withColumn(
        "range", F.least(F.floor(F.col("t") * span).cast("long"), F.lit(times - 1)))
        .select("doc_id", "s", "tokens", "text_key", "epoch", "h", "weight", "t", "range"), "placed")
    ahead = _before(placed.groupBy("range").agg(F.sum("tokens").alias("n")), "range", "n")
    order = Window.partitionBy("range").orderBy("t", "h", "s", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("range", "t", "h", "s", "doc_id")
    stream = placed.join(ahead, "range").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))) \
        .withColumn("at", F.min("at").over(same))
    if budget is not None:
        stream = stream.where(F.col("at") < F.lit(budget))
    stream = materialize(stream.withColumn("raw", F.floor(F.col("at") / F.lit(block_tokens)))
                         .select("doc_id", "s", "tokens", "text_key", "epoch", "h", "weight", "raw"), "stream")
    # a document longer than a block leaves numbers that nothing begins in: count the others
    blocks = _before(stream.select("raw").distinct().withColumn("one", F.lit(1)), "raw", "one").withColumnRenamed("before", "block")
    inside = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.col("block"), F.col("h")), "doc_id", "s", "epoch")
    return stream.join(blocks, "raw").select(
        "doc_id", F.when(F.col("s") != "null", F.expr("substring(s, 2)")).alias("source"), "tokens", "epoch", "block",
        (F.row_number().over(inside) - 1).cast("long").alias("position"), "weight", "text_key")


def mixed_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents as often as the mixture takes them, with their own columns only."""
    times = mix(docs, source_col, id_col=id_col, text_col=text_col, **how).groupBy(
        F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_key").alias("text")).agg(
        (F.max("epoch") + 1).alias("times"))
    own = boxed(docs, doc_id=F.col(id_col).cast("long"), source=F.col(source_col).cast("string"), text_key=F.xxhash64(text_col))
    same = (F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of"))
            & (F.col("text_key") == F.col("text")))
    return unboxed(own.join(times, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))))
