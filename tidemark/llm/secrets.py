"""Secret scans with corpus-wide ownership frequency.

Every whole text is scanned once for candidate credentials.  Each candidate value is hashed, and over
the corpus its distinct repositories and distinct owners are counted.  A repository is a document (copies of one
text are one), unless a column names it; the owner is its source.  A value that many owners publish, or that one
owner's documents repeat again and again, is a widely copied example; one that stays within few documents of its
owner and looks random is a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, materialize, slices, unboxed

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The kinds that ownership decides on: longer runs of the characters credentials are written in, private
#: keys, and passwords inside addresses.
BLOB = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END [A-Z ]*PRIVATE KEY-----")
URL = re.compile(r"(?<=[a-z0-9+.-])://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/@]{6,})@")
KINDS = ("assign", "access", "hex", "blob", "pem", "url")
BASE = KINDS[:3]

#: A value of at most so many owners, and in at most so many repositories, is owner-specific.
LIVE_OWNERS = 2
LIVE_REPOSITORIES = 8
#: A value with more than this share of all spans is met by broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 1024
#: Bits of entropy per character that a random-looking value has at least.
RANDOM_BITS = 2.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Digits together with letters, in a mixture that words do not have."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= RANDOM_BITS


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start and then kind; positions in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        if "://" in text:
            found += [("url", m.start(1), m.end(1), m.group(1)) for m in URL.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    starts = sorted(a for _, a, _, _ in found)
    reach = list(accumulate((b for _, _, b, _ in sorted(found, key=lambda x: x[1])), max))  # the farthest end so far
    for m in BLOB.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the blob ends
        if not (before and reach[before - 1] > m.start()) and looks_random(m.group()):
            found.append(("blob", m.start(), m.end(), m.group()))
    if "-----BEGIN" in text:
        found += [("pem", m.start(), m.end(), m.group()) for m in PEM.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])
FOUND = ("row long, doc_id long, repository string, owner string, key long, "
         "spans array<struct<kind: string, start: bigint, end: bigint, value: string, random: boolean>>")


def candidates(docs: DataFrame, repository_col: str | None, owner_col: str, id_col: str, text_col: str) -> DataFrame:
    """Each document with its candidates; values are kept as digests."""
    repository = F.xxhash64(text_col) if repository_col is None else F.col(repository_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 4):
            spans = [[{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)}
                      for k, a, b, v in scan(text or "")] for text in batch.column(4).to_pylist()]
            rows = pa.array(range(row, row + len(spans)), pa.int64())
            row += len(spans)
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:4], pa.array(spans, pa.list_(SPAN))],
                                             names=["row", "doc_id", "repository", "owner", "key", "spans"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), repository.cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"), F.xxhash64(text_col).alias("key"),
        F.col(text_col).alias("text")).mapInArrow(run, FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories, documents: distinct counts by two steps, so that no value meets in one task."""
    each = found.select("repository", "owner", F.explode("spans.value").alias("value"))
    places = each.groupBy("value", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy("value").agg(F.count_distinct("owner").alias("owners"),
                                       F.count_distinct("repository").alias("repositories"), F.sum("n").alias("documents"))


def with_ownership(spans: DataFrame, values: DataFrame) -> DataFrame:
    """Spans with the counts of their value.

    Values in a share of all spans are broadcast, at most ``1 / HOT_SHARE`` of them; the others meet in a shuffle.
    """
    total = values.agg(F.sum("documents")).first()[0] or 0
    hot = F.col("documents") > F.lit(total * HOT_SHARE)
    met = spans.join(F.broadcast(values.where(hot)), "value", "left")
    rare = met.where(F.col("documents").isNull()).select(*spans.columns).join(values.where(~hot), "value")
    return met.where(F.col("documents").isNotNull()).unionByName(rare)


def find_secrets(docs: DataFrame, repository_col: str | None = None, owner_col: str = "source",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), spans: kind, start, end, value, owners, repositories, live.

    A span is live if its value looks random, has at most ``LIVE_OWNERS`` owners and at most
    ``LIVE_REPOSITORIES`` repositories.  The three base kinds are always reported; the others only if
    live.  A null or empty text has no spans; a null owner or repository counts for none; repeated
    rows are reported alike.
    """
    found = materialize(candidates(docs, repository_col, owner_col, id_col, text_col), "candidates")
    values = materialize(ownership(found), "ownership")
    some = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    judged = with_ownership(some, values).withColumn(
        "live", F.col("random") & (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES))
    kept = judged.where(F.col("kind").isin(*BASE) | F.col("live"))
    kinds = F.array(*map(F.lit, KINDS))
    span = F.struct("start", F.array_position(kinds, F.col("kind")).alias("order"), "end", "kind", "value", "owners",
                    "repositories", "live")
    grouped = materialize(kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans")), "spans")
    return found.select("row", "doc_id", "key").join(grouped, "row", "left").select(
        "doc_id", "key", F.coalesce("spans", F.array()).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", repository_col: str | None = None, owner_col: str = "source",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the values of live spans replaced by ``mark``; widely copied examples stay.

    Spans that overlap are replaced as one.  Columns and rows stay as they are, a null text too.
    """
    live = find_secrets(docs, repository_col, owner_col, id_col, text_col).select(
        "doc_id", "key", F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"))).alias("_spans")).where(F.size("_spans") > 0).distinct()
    live = materialize(live.select(F.col("doc_id").alias("id"), F.col("key").alias("text"), "_spans"), "live-spans")
    own = boxed(docs, doc_id=F.col(id_col).cast("long"), key=F.xxhash64(text_col))
    held = own.join(live, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text")), "left")
    schema = docs.schema
    names = docs.columns
    at = names.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    texts[i] = blanked(texts[i], [(s["start"], s["end"]) for s in spans], mark)
            columns = batch.columns[:len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spare = "_".join([*names, "spans"])  # longer than any column's name
    fields = [F.col("doc").getField(c).alias(c) for c in names]
    marked = held.where(F.col("_spans").isNotNull()).select(*fields, F.col("_spans").alias(spare)).mapInArrow(run, schema)
    return unboxed(held.where(F.col("_spans").isNull())).unionByName(marked)


def blanked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, last = [], 0
    for start, end in sorted(spans):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def report(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))
