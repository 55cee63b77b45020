"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link key are neighbours.  All start in a shard by hash; in every round each
group of neighbours is drawn to the shard where most of it lies and moves there as far as the shard's
quota lets it; a last step makes the shards' sizes equal with the documents that have no neighbours.

Documents of one group that started in one shard always move alike, so the rounds work on cells
(group, piece, starting shard) instead of documents.  Groups are cut into pieces of about
``1 / PIECES`` of all rows: at most ``PIECES`` groups are large enough to be cut, which bounds the
table of their numbers of pieces that is broadcast, and no join meets more rows of a key than a piece
has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, ranked

PIECES = 512
#: Moves into a shard are admitted by this many ranges of a hash.
RANGES = 1024
ROUNDS = 24


def choose(shard: Column, values: list[int]) -> Column:
    """The value for a shard, as an expression."""
    return reduce(lambda e, sv: F.when(shard == sv[0], F.lit(sv[1])).otherwise(e), enumerate(values), F.lit(0).cast("long"))


def shares(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def admitted(wishes: list[tuple[int, int, int]], loads: list[int], quotas: list[int]) -> dict[int, int]:
    """For each shard the ranges below which moves into it are admitted.

    ``wishes``: (target, range, rows).  A shard takes what fits below its quota.  Documents without
    neighbours do not count towards it, as they are placed last; where all documents have neighbours,
    only what others have left makes room.
    """
    room = [max(0, q - load) for q, load in zip(quotas, loads)]
    out = {}
    for shard, free in enumerate(room):
        taken, upto = 0, 0
        for r, rows in sorted((r, rows) for t, r, rows in wishes if t == shard):
            if taken + rows > free:
                break
            taken, upto = taken + rows, r + 1
        out[shard] = upto
    return out


def propagate(cells: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Rounds of label propagation over cells (hub, piece, start, rows, shard), until nothing moves."""
    shards = len(quotas)
    full: set[int] = set()  # shards too full for even one more range
    for _ in range(rounds):
        loads = [0] * shards
        for shard, rows in cells.groupBy("shard").agg(F.sum("rows")).collect():
            loads[shard] = rows
        open_shards = [s for s in range(shards) if loads[s] < quotas[s] and s not in full]
        votes = cells.groupBy("hub", "shard").agg(F.sum("rows").alias("votes"))
        # a shard without room draws nobody
        drawing = votes.where(F.col("shard").isin(open_shards)) if open_shards else votes.limit(0)
        best = drawing.groupBy("hub").agg(
            F.max(F.struct("votes", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("b")).select(
            "hub", F.col("b.shard").alias("target"), F.col("b.votes").alias("gain"))
        own = votes.select("hub", "shard", F.col("votes").alias("own"))
        wish = cells.join(best, "hub", "left").join(own, ["hub", "shard"]).withColumn(
            "wants", F.coalesce(F.col("target") != F.col("shard"), F.lit(False)) & (
                (F.col("gain") > F.col("own")) | ((F.col("gain") == F.col("own")) & (
                    F.xxhash64("hub", "target") > F.xxhash64("hub", "shard"))))).withColumn(
            "range", F.pmod(F.xxhash64("hub", "piece"), F.lit(RANGES)).cast("int"))
        wish = materialize(wish.select("hub", "piece", "start", "rows", "shard", "target", "wants", "range"), "wishes")
        asked = wish.where("wants").groupBy("target", "range").agg(F.sum("rows").alias("rows")).collect()
        if not asked:
            discard(wish)
            break
        upto = admitted([(r["target"], r["range"], r["rows"]) for r in asked], loads, quotas)
        moves = F.col("wants") & (F.col("range") < choose(F.col("target"), [upto[s] for s in range(shards)]))
        moved = materialize(wish.select("hub", "piece", "start", "rows", F.when(moves, F.col("target")).otherwise(
            F.col("shard")).alias("shard")), "cells")
        discard(wish)
        discard(cells)
        cells = moved
        full |= {r["target"] for r in asked if not upto[r["target"]]}
    return cells


def shard_documents(docs: DataFrame, link: Column | None = None, shards: int = 8, rounds: int = ROUNDS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law ``rows``.

    Rows of a shard differ from those of another by one at most.  ``link``: rows with equal values are
    neighbours, null has none; by default equal texts are.  ``size`` is the text's UTF-8 bytes and one
    more; a null text has size 1, the checksum of no bytes and no neighbours, an empty one is a text
    like any other.  Repeated rows, also with equal ids, are placed one by one; a group larger than a
    shard fills the shards it is drawn to and goes on in others.
    """
    text = F.col(text_col)
    link = F.sha2(text, 256) if link is None else link
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), link.cast("string").alias("hub")), "rows")
    n = rows.count()
    quotas = shares(n, shards)
    large = materialize(rows.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) & (F.col("n") * PIECES > n)).select("hub", F.ceil(F.col("n") * PIECES / n).cast("int").alias("pieces")), "large-groups")
    mix = F.xxhash64("doc_id", "text_crc32", "size")
    rows = rows.join(F.broadcast(large), "hub", "left").select(
        "doc_id", "size", "text_crc32", "hub", F.coalesce(F.pmod(mix, F.col("pieces")), F.lit(0)).cast("int").alias("piece"),
        F.pmod(F.xxhash64(mix, F.lit(1)), F.lit(shards)).cast("int").alias("start"))
    cells = rows.where("hub is not null").groupBy("hub", "piece", "start").agg(F.count(F.lit(1)).alias("rows"))
    cells = materialize(cells, "cells")
    groups = cells.groupBy("hub").agg(F.sum("rows").alias("n")).where("n > 1").select("hub")
    linked = materialize(cells.join(groups, "hub", "left_semi").withColumn("shard", F.col("start")), "cells")
    linked = propagate(linked, quotas, rounds)

    placed = rows.join(linked.select("hub", "piece", "start", "shard"), ["hub", "piece", "start"], "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("hub", F.lit("")).alias("hub"), F.coalesce("shard", F.lit(-1)).alias("want"))
    placed = materialize(placed, "placed")
    wanted = {r[0]: r[1] for r in placed.groupBy("want").agg(F.count(F.lit(1))).collect()}
    kept = [min(wanted.get(s, 0), quotas[s]) for s in range(shards)]
    numbered = ranked(placed, "want", ["hub", "doc_id", "text_crc32", "size"], "rank")
    # rows beyond a quota and rows without neighbours fill the free places in order
    before, over = [], wanted.get(-1, 0)
    for s in range(shards):
        before.append(over - kept[s])
        over += wanted.get(s, 0) - kept[s]
    want, rank = F.col("want"), F.col("rank")
    stays = (want >= 0) & (rank < choose(want, kept))
    place = F.when(want < 0, rank).otherwise(rank + choose(want, before))
    shard, slot, lower = F.lit(shards - 1), rank, 0
    for s in range(shards):
        upper = lower + quotas[s] - kept[s]
        mine = (F.col("place") >= lower) & (F.col("place") < upper)
        shard = F.when(mine, F.lit(s)).otherwise(shard)
        slot = F.when(mine, F.col("place") - lower + kept[s]).otherwise(slot)
        lower = upper
    out = numbered.withColumn("stays", stays).withColumn("place", F.when(~stays, place))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(F.col("stays"), want).otherwise(shard).cast("int").alias("shard"),
        F.when(F.col("stays"), rank).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
