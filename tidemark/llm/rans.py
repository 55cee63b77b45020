"""Token ids in binary files: a static range asymmetric numeral system with interleaved lanes.

File layout.  A file is a folder's part; its rows are blocks in ascending document order.  One table of
frequencies, scaled to ``2 ** BITS``, serves all blocks.  A block is independent of the others:

    magic "TMR1", crc32 of all that follows,
    head: lanes, steps, tokens, documents, checkpoint interval, words,
    document lengths (unsigned 32-bit), document ids (signed 64-bit, with a byte that says if null),
    checkpoints: for every ``interval`` steps the position in the words and the state of all lanes,
    words: unsigned 32-bit, in reading order.

Token ``i`` belongs to lane ``i % lanes`` and step ``i // lanes``, so all lanes advance together as
vectors.  A decoder may start at any checkpoint, which lets several of them share a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, materialize, slices, small_batches
from tidemark.llm.tokens import load, unload
from tidemark.session import scratch_path

BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"TMR1"
HEAD = struct.Struct("<IIQIII")
LANES = 4096
#: Tokens after which a block is closed; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 64
FILE_BYTES = 64_000_000


def scaled_frequencies(counts: dict[int, int]) -> np.ndarray:
    """Counts scaled to a sum of ``2 ** BITS``, at least one for every id that occurs."""
    if not counts:
        return np.zeros(0, np.uint32)
    size = max(counts) + 1
    raw = np.zeros(size, np.float64)
    raw[list(counts)] = list(counts.values())
    room = (1 << BITS) - int((raw > 0).sum())
    if room < 0:
        raise ValueError(f"more than {1 << BITS} different ids")
    out = np.where(raw > 0, 1 + np.floor(raw / raw.sum() * room), 0).astype(np.int64)
    out[int(out.argmax())] += (1 << BITS) - int(out.sum())
    return out.astype(np.uint32)


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lengths: np.ndarray, docs: list[int | None]) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // CHECKPOINT_STEPS))
        steps = -(-n // lanes) if n else 0
        state = np.full(lanes, LOW, np.uint64)
        chunks: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        bound = np.uint64(63 - BITS)
        for step in range(steps - 1, -1, -1):
            own = ids[step * lanes:(step + 1) * lanes]
            f, c = self.freq[own], self.cum[own]
            x = state[:len(own)]
            full = x >= f << bound
            if full.any():
                chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(chunks[-1])
                x = np.where(full, x >> np.uint64(32), x)
            whole = x // f
            state[:len(own)] = (whole << np.uint64(BITS)) + (x - whole * f) + c
            if step % CHECKPOINT_STEPS == 0:
                marks.append((written, state.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        marks = [(written - at, s) for at, s in marks[::-1]]
        known = np.array([d is not None for d in docs], np.uint8)
        names = np.array([d or 0 for d in docs], "<i8")
        body = b"".join([
            HEAD.pack(lanes, steps, n, len(docs), CHECKPOINT_STEPS, len(words)),
            lengths.astype("<u4").tobytes(), names.tobytes(), known.tobytes(),
            np.array([at for at, _ in marks], "<u8").tobytes(),
            *(s.astype("<u8").tobytes() for _, s in marks), words.tobytes()])
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
        """Ids, document lengths and document ids of a block, after its checksum."""
        lanes, steps, n, lengths, docs, marks, words = self.parts(block)
        ids = np.empty(n, np.uint32)
        for k in range(len(marks)):
            lo, hi = k * CHECKPOINT_STEPS, min(steps, (k + 1) * CHECKPOINT_STEPS)
            self.decode_from(marks[k], words, lanes, lo, hi, n, ids)
        return ids, lengths, docs

    @staticmethod
    def parts(block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of this format")
        if zlib.crc32(memoryview(block)[8:]) != struct.unpack_from("<I", block, 4)[0]:
            raise ValueError("a block's checksum does not match")
        lanes, steps, n, count, interval, n_words = HEAD.unpack_from(block, 8)
        at = 8 + HEAD.size

        def take(kind: str, size: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, size, at)
            at += out.nbytes
            return out

        lengths = take("<u4", count).astype(np.int64)
        names, known = take("<i8", count).tolist(), take("u1", count).tolist()
        docs = [x if k else None for x, k in zip(names, known)]
        n_marks = -(-steps // interval) if steps else 0
        places = take("<u8", n_marks).tolist()
        marks = [(p, take("<u8", lanes).astype(np.uint64)) for p in places]
        return lanes, steps, n, lengths, docs, marks, take("<u4", n_words)

    def decode_from(self, mark, words: np.ndarray, lanes: int, lo: int, hi: int, n: int, ids: np.ndarray) -> None:
        """Decode steps ``lo`` to ``hi`` into ``ids`` from a checkpoint at step ``lo``."""
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        at, state = mark[0], mark[1].copy()
        mask = np.uint64((1 << BITS) - 1)
        for step in range(lo, hi):
            own = min(lanes, n - step * lanes)
            x = state[:own]
            slot = x & mask
            s = self.symbol[slot]
            ids[step * lanes:step * lanes + own] = s
            x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.cum[s]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << np.uint64(32)) | words[at:at + len(need)]
                at += len(need)
            state[:own] = x


TOKENS = "doc_id long, n long, ids binary"
BLOCKS = "file int, block int, first_doc long, n_docs long, n_tokens long, payload binary"


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of whole texts as little-endian unsigned 16-bit integers, or 32-bit ones for larger vocabularies."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        kind = "<u2" if encoder.library.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in slices(batches, 1):
            ids, counts = encoder.encode(bytes_of(batch.column(1)))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(kind)
            at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).tolist()
            raw = ids.tobytes()
            w = ids.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts + 1, pa.int64()),
                 pa.array([raw[w * a:w * b] for a, b in zip(at, at[1:])], pa.binary())],
                names=["doc_id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, TOKENS)


def ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs: summed per task first, then by id; the result is as long as the vocabulary."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        unload()
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = [ids_of(raw, n) for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            own = np.bincount(np.concatenate(ids), minlength=len(total))
            own[:len(total)] += total
            total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    found = tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    with small_batches(tokens.sparkSession):
        return {r[0]: r[1] for r in found.collect()}


def write_blocks(tokens: DataFrame, frequencies: np.ndarray, path: str) -> None:
    """Write the files in ascending document order (rows without id first)."""
    spark = tokens.sparkSession

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unload()
        coder, file, block = Coder(frequencies), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.int64)
            payload = coder.encode(np.concatenate(held), lengths, docs)
            return pa.RecordBatch.from_pydict(
                {"file": [file], "block": [block], "first_doc": [docs[0]], "n_docs": [len(docs)],
                 "n_tokens": [size], "payload": [payload]},
                schema=pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and size + n > BLOCK_TOKENS:
                    yield close()
                    docs, held, size, block = [], [], 0, block + 1
                docs.append(doc)
                held.append(ids_of(raw, n))
                size += n
        if held:
            yield close()

    total = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES), min(spark.sparkContext.defaultParallelism * 2, total // 2_000_000))
    spread = tokens.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(int(files), "doc_id", "_tie")
    with small_batches(spark):
        spread.sortWithinPartitions("doc_id", "_tie").select("doc_id", "n", "ids").mapInArrow(run, BLOCKS).write.parquet(path)


def read_blocks(spark, path: str, frequencies: np.ndarray) -> DataFrame:
    """Documents of the files: doc_id, ids (little-endian unsigned 32-bit), file, block, position of its first id there."""
    return _decoded(spark, path, frequencies, True)


def _decoded(spark, path: str, frequencies: np.ndarray, with_ids: bool) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        unload()
        coder = Coder(frequencies)
        for batch in batches:
            for file, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, lengths, docs = coder.decode(payload)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                own = [raw[4 * a:4 * b] for a, b in zip(at, at[1:])]
                columns = [pa.array(docs, pa.int64()), pa.array([file] * len(docs), pa.int32()),
                           pa.array([block] * len(docs), pa.int32()), pa.array(at[:-1], pa.int64()),
                           pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "file", "block", "position", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in own], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, file int, block int, position long, n_tokens long, ids_crc32 long"
    return spark.read.parquet(path).select("file", "block", "payload").mapInArrow(
        run, schema + (", ids binary" if with_ids else ""))


def block_starts(spark, path: str) -> DataFrame:
    """Ids before each block: summed by file first, then within a file."""
    blocks = spark.read.parquet(path).select("file", "block", "n_tokens")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select(
        "file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(files, "file").select(
        "file", "block", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("_start"))


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[str, np.ndarray]:
    """Write all texts as token files below ``path`` (default: the shared folder); returns it and the table.

    Null and empty texts hold the end id only; rows without id come first; repeated ids are kept, in
    order of a hash of their ids; an empty table gives files without blocks.
    """
    tokens = materialize(token_table(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    frequencies = scaled_frequencies(id_counts(tokens))
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_blocks(tokens, frequencies, path)
    return path, frequencies


def digest(spark, path: str, frequencies: np.ndarray) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return materialize(_decoded(spark, path, frequencies, False), "token-digest").join(block_starts(spark, path), ["file", "block"]).select(
        "doc_id", (F.col("_start") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
