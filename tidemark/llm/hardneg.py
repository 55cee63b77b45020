"""Hard negatives by pruning of lengths and coordinates (after LEMP).

An anchor's positives are its best rows of the same label; its negatives are the best rows of other labels
whose score lies in a band given by the positive's.  Rows are dealt into shards.  A shard's rows go into buckets
by length; a bucket holds its directions and, for each coordinate, the order of its values.  For an anchor,
the least score that still counts becomes a least cosine for the bucket:

* above 1 the bucket is passed over, and with it all shorter ones of the shard;
* otherwise the angle between anchor and row bounds the row's value at each of the anchor's focus coordinates
  (its largest ones): the feasible ranges, found by bisection, are intersected, and only rows in all of
  them are multiplied out exactly.

The least score rises while buckets go by, as an anchor's lists fill.  Anchors go to shards in blocks, and
the shards' lists are merged group by group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.topk import LEAST, MOST, exact_scores, usable, whole

SHARD_ROWS = 16_384
BUCKET_ROWS = 2048
#: Anchors that meet a shard in one task.
ANCHOR_CHUNK = 4096
FOCUS = 4
FAN_IN = 32
#: Slack of a feasible range against rounding.
SLACK = 1e-6


def lengths(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and direction of each row; the direction of a null vector is null."""
    top = np.abs(v).max(axis=1, initial=0)
    scaled = v / np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt((scaled ** 2).sum(axis=1))
    with np.errstate(over="ignore"):
        return top * norm, scaled / np.where(norm > 0, norm, 1)[:, None]


class Bucket:
    """Rows of similar length: vectors, directions, and for each coordinate its values in order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, size: np.ndarray, direction: np.ndarray):
        self.ids, self.labels, self.v, self.direction = ids, labels, v, direction
        self.longest = float(size.max())
        self.shortest = float(size.min())
        self.order = np.argsort(direction, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(direction, self.order, axis=0)

    def least_cosine(self, least: int, length: float) -> float:
        """The cosine that a row of the bucket needs to score ``least`` with an anchor of this length, at the least."""
        if least <= LEAST + 1:
            return -1.0
        of = length * (self.longest if least > 0 else self.shortest)
        if of == 0:
            return 2.0 if least > 0 else -1.0
        return max(-1.0, least / of) if np.isfinite(of) else -1.0

    def candidates(self, cosine: float, direction: np.ndarray, focus: np.ndarray) -> np.ndarray:
        """Rows whose values at the focus coordinates lie in the feasible ranges."""
        beta = np.arccos(min(1.0, cosine))
        alpha = np.arccos(np.clip(direction[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, alpha + beta)) - SLACK
        high = np.cos(np.maximum(0.0, alpha - beta)) + SLACK
        spans = [(int(np.searchsorted(self.sorted[:, f], a)), int(np.searchsorted(self.sorted[:, f], b, "right")), k)
                 for k, (f, a, b) in enumerate(zip(focus.tolist(), low.tolist(), high.tolist()))]
        a, b, k = min(spans, key=lambda s: s[1] - s[0])
        rows = self.order[a:b, focus[k]]
        for j, f in enumerate(focus.tolist()):
            if j != k and len(rows):
                x = self.direction[rows, f]
                rows = rows[(x >= low[j]) & (x <= high[j])]
        return rows


def buckets_of(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, bucket_rows: int) -> list[Bucket]:
    """A shard's buckets from the longest rows to the shortest."""
    size, direction = lengths(v)
    order = np.argsort(-size, kind="stable")
    return [Bucket(*(x[own] for x in (ids, labels, v, size, direction)))
            for own in (order[i:i + bucket_rows] for i in range(0, len(order), bucket_rows))]


class Best:
    """The best ``k`` of the rows met with a score from ``low`` to ``high``; ties to the smaller id."""

    def __init__(self, k: int, low: int = LEAST, high: int = MOST):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The least score that a row still needs."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) >= self.k else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= self.least) & (scores <= self.high)
        if ok.any():
            ids, scores = np.append(self.ids, ids[ok]), np.append(self.scores, scores[ok])
            order = np.lexsort((ids, ~scores))[:self.k]  # ~x falls as x rises, over all 64 bits
            self.ids, self.scores = ids[order], scores[order]


def search(buckets: list[Bucket], anchor_id: int, label: int, v: np.ndarray, same: bool, lists: list[Best]) -> tuple[int, int]:
    """Offer an anchor's rows of the same label, or of others, to its lists; returns rows multiplied out and rows there."""
    size, direction = lengths(v[None, :])
    length, direction = float(size[0]), direction[0]
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
    seen = total = 0
    for bucket in buckets:
        total += len(bucket.ids)
        least = min(one.least for one in lists)
        cosine = bucket.least_cosine(least, length)
        if cosine > 1 + SLACK:
            continue
        rows = bucket.candidates(cosine, direction, focus) if cosine > -1 else np.arange(len(bucket.ids))
        seen += len(rows)
        ok = (bucket.labels[rows] == label) == same
        if same:
            ok &= bucket.ids[rows] != anchor_id
        rows = rows[ok]
        scores = exact_scores(bucket.v[rows], v)
        for one in lists:
            one.add(bucket.ids[rows], scores)
    return seen, total


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score between ``low`` and ``high`` per cent of the positive's."""
    return -(-low * positive // 100), high * positive // 100


def _part(n: int | Column) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n) if isinstance(n, int) else n).cast("int")


def _every(n: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))


def _best(lists: DataFrame, by: list[str], order: list[Column], k: int, shards: int) -> DataFrame:
    """The first ``k`` of each group: groups of shards first, then all."""
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        w = Window.partitionBy(*by, "shard").orderBy(*order)
        lists = lists.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    rows = rows.select(*[F.col(c).alias(f"row_{c}") for c in rows.columns])
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*[f"row_{c}" for c in keys])).applyInPandas(run, schema)


def _buckets(shard: pd.DataFrame, bucket_rows: int) -> list[Bucket]:
    return buckets_of(shard["row_id"].to_numpy(np.int64), shard["row_label"].to_numpy(np.int64),
                      np.stack(shard["row_v"].to_numpy()).astype(np.float64), bucket_rows)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   shard_rows: int = SHARD_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score, anchor_key.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors meet those
    of their own length.  Of rows with one id none is a positive of the other; anchors alike in id, label and vector are
    one, and others of one id are told apart by ``anchor_key``.  Scores beyond 64 bits are the nearest 64-bit number and
    tie.  An anchor without positives, or a positive whose band holds no row, has no rows; a negative positive score
    leaves an empty band.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                         is_anchor.alias("is_anchor"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    own = materialize(own.select("id", "label", "is_anchor", whole(F.col("v"), scale).alias("v"), F.size("v").alias("dims"))
                      .withColumn("key", F.xxhash64("id", "label", "v")), "vectors")
    n = own.count()
    asked = own.where("is_anchor").select("key", "id", "label", "v", "dims").dropDuplicates(["key"])
    spread = max(1, min(spark.sparkContext.defaultParallelism, n // bucket_rows))

    # positives: an anchor meets the shards of its own label
    pieces = own.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("pieces"),
                                      F.ceil(F.sum(F.col("is_anchor").cast("int")) / F.lit(ANCHOR_CHUNK)).cast("int").alias("chunks"))
    chunks = F.greatest(F.coalesce(F.col("chunks"), F.lit(1)), F.lit(1))
    rows = own.join(pieces, "label").select("id", "label", "v", "dims", _part(F.col("pieces")).alias("shard"), chunks.alias("of")) \
        .withColumn("chunk", _every(F.col("of")))
    blocks = asked.join(pieces, "label").select("key", "id", "label", "v", "dims", "pieces", F.pmod("key", chunks).cast("int").alias("chunk")) \
        .withColumn("shard", _every(F.col("pieces")))

    def find_positives(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(shard):
            own = _buckets(shard, bucket_rows)
            number = int(shard["row_shard"].iloc[0])
            for key, id_, label, v in zip(block["key"], block["id"], block["label"], block["v"]):
                best = Best(positives)
                search(own, id_, label, np.asarray(v, np.float64), True, [best])
                out += [(key, i, s, number) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
        return pd.DataFrame(out, columns=["key", "positive_id", "positive_score", "shard"])

    found = _meet(blocks, rows, ["label", "dims", "shard", "chunk"], find_positives, "key long, positive_id long, positive_score long, shard int")
    most = own.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    top = _best(found, ["key"], [F.desc("positive_score"), F.col("positive_id")], positives, -(-most // shard_rows))
    listed = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    asked = materialize(asked.join(listed, "key"), "anchors")

    # negatives: an anchor with its positives meets all shards
    shards = max(1, -(-n // shard_rows), spread)
    chunks = max(1, -(-asked.count() // ANCHOR_CHUNK))
    rows = own.select("id", "label", "v", "dims", _part(shards).alias("shard"), _every(chunks).alias("chunk"))
    blocks = asked.withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("int")).withColumn("shard", _every(shards))

    def find_negatives(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(shard):
            own = _buckets(shard, bucket_rows)
            number = int(shard["row_shard"].iloc[0])
            for key, id_, label, v, listed in zip(block["key"], block["id"], block["label"], block["v"], block["positives"]):
                wanted = [(p["rank"], p["positive_id"], p["positive_score"], *band(p["positive_score"], low, high)) for p in listed]
                wanted = [(*p, Best(negatives, a, b)) for *p, a, b in wanted if a <= b]
                if not wanted:
                    continue
                search(own, id_, label, np.asarray(v, np.float64), False, [p[-1] for p in wanted])
                out += [(key, id_, rank, positive, score, i, s, number)
                        for rank, positive, score, best in wanted for i, s in zip(best.ids.tolist(), best.scores.tolist())]
        return pd.DataFrame(out, columns=["anchor_key", "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id",
                                          "negative_score", "shard"])

    lists = _meet(blocks, rows, ["dims", "shard", "chunk"], find_negatives,
                  "anchor_key long, anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long, shard int")
    best = _best(lists, ["anchor_key", "positive_rank"], [F.desc("negative_score"), F.col("negative_id")], negatives, shards)
    return best.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score", "anchor_key")
