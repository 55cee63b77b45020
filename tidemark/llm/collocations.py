"""Phrase collocations, counted by HAT-tries whose subtrees are spilled as sorted runs.

1. ``code_blocks`` reads every text once and writes blocks of word numbers with the words they stand for.
2. ``word_table`` sums words over all blocks; a word's id is a 64-bit hash, drawn anew with another seed
   should a frequent word share its id with any other word.
3. ``frequent_pairs`` sums the pairs of frequent words by a short hash: a block tells the hashes it has as a sorted run
   of small differences, and the runs of a range of hashes are merged.
4. ``phrase_counts`` counts phrases whose pairs all may be frequent.  A task inserts its blocks into a trie of word
   ids, shallow above and ending in hash containers that burst into a level more when they grow.  A full trie gives
   whole subtrees away as sorted runs, dealt into slots by the hash of a phrase's first two words; the runs of a slot
   are merged, a slot of many entries in several pieces, so that no task holds more than ``MERGE_ENTRIES`` and those of
   the last run.
5. ``collocations`` scores the frequent phrases by joins.

A phrase can be frequent only if all its words and pairs are.  Frequent words, and then the hashes of pairs, are
known to tasks by a filter of bits: it never has more than ``FILTER_BITS``, whatever the corpus, and what it lets
through in error is counted exactly and falls at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, repeat
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, discard, materialize, slices, small_batches
from tidemark.llm.lmscore import loosen, squeeze
from tidemark.session import pin

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Words after which a block is closed, and bytes of a text that are split into words at a time.
BLOCK_WORDS = 1 << 20
TEXT_STEP = 1 << 20
#: Entries of a trie that make it spill, and of a container that make it burst.
TRIE_ENTRIES = 500_000
BURST = 4096
#: Words of the corpus for each slot of prefixes, and entries that are merged at a time.
SLOT_WORDS = 1 << 21
MERGE_ENTRIES = 1_000_000
#: Size limit of a filter (32 MB), and bits for each entry below it.
FILTER_BITS = 1 << 28
ENTRY_BITS = 16
#: Copies of a count that candidates with the same part look up.
SALTS = 8

BREAK = b"\xff"  # no byte of UTF-8


def _fold() -> bytes:
    own = bytearray(range(256))
    own[0x09] = 0x20
    for c in range(ord("A"), ord("Z") + 1):
        own[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        own[c] = BREAK[0]
    return bytes(own)


FOLD = _fold()


def words_in(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with ``BREAK`` between pieces and at the end, some at a time, cut between pieces."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(BREAK, at + TEXT_STEP)
        end = len(folded) if end < 0 else end
        yield [*folded[at:end].replace(BREAK, b" \xff ").split(), BREAK]
        at = end


class Block:
    """Word numbers of one language; number 0 is the break between pieces."""

    def __init__(self):
        self.code: dict[bytes, int] = {BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def extend(self, words: list[bytes]) -> None:
        code = self.code
        own = np.fromiter(map(code.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(own < 0).tolist()
        if missed:
            fresh = [w for w in dict.fromkeys([words[i] for i in missed])]
            code.update(zip(fresh, range(len(code), len(code) + len(fresh))))
            own[missed] = [code[words[i]] for i in missed]
        self.parts.append(own.astype(np.uint32))
        self.size += len(own)


BLOCKS = "lang string, words binary, counts binary, ids binary"


def code_blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Whole texts as blocks: a language's words, how often each occurs, and the word numbers in order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, Block] = {}
        held = 0

        def close(lang: str) -> pa.RecordBatch:
            block = open_blocks.pop(lang)
            ids = np.concatenate(block.parts)
            counts = np.bincount(ids, minlength=len(block.code))[1:].astype("<u4")
            words = b" ".join(list(block.code)[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([words], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                 pa.array([squeeze(ids)], pa.binary())], names=["lang", "words", "counts", "ids"])

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                for words in words_in(text):
                    block = open_blocks.setdefault(lang, Block())
                    block.extend(words)
                    held += len(words)
                    if block.size >= BLOCK_WORDS:
                        held -= block.size
                        yield close(lang)
                    elif held >= 2 * BLOCK_WORDS:  # many languages
                        held = 0
                        for one in list(open_blocks):
                            yield close(one)
        for lang in list(open_blocks):
            yield close(lang)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col)).mapInArrow(run, BLOCKS)


def word_id(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def word_table(blocks: DataFrame, seed: int) -> DataFrame:
    """lang, id, word, n: how often each word occurs in all blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, counts in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2))):
                own = words.split(b" ") if words else []
                ids = np.fromiter((word_id(w, seed) for w in own), np.uint64, len(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(ids), pa.array(own, pa.binary()).cast(pa.string()),
                     pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], names=["lang", "id", "word", "n"])

    rows = blocks.select("lang", "words", "counts").mapInArrow(run, "lang string, id long, word string, n long")
    return rows.groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))


def shared_ids(words: DataFrame, min_count: int) -> DataFrame:
    """Ids of several words of a language that occur often enough together to matter."""
    return words.groupBy("lang", "id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).where(
        (F.col("words") > 1) & (F.col("n") >= min_count))


def mixed(columns: np.ndarray, lang: str) -> np.ndarray:
    """One 64-bit number for the ids in each row of a matrix, of a language."""
    out = np.full(len(columns), xxhash.xxh64_intdigest(lang), np.uint64)
    for j in range(columns.shape[1]):
        out = (out ^ columns[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """A Bloom filter of phrases with two bits each."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.bits = cells, np.uint64(len(cells) * 64)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([keys % np.uint64(bits), (keys >> np.uint64(32) ^ keys << np.uint64(17)) % np.uint64(bits)])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, int(self.bits))
        hit = (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return (hit[:len(keys)] & hit[len(keys):]).astype(bool)


def word_keys(words: DataFrame) -> DataFrame:
    """key: what a filter knows a word (lang, id) by."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in batch.to_pandas().groupby("lang")["id"]:
                key = mixed(own.to_numpy(np.int64).view(np.uint64)[:, None], lang)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return words.select("lang", "id").mapInArrow(run, "key long")


def filter_of(keys: DataFrame) -> Filter:
    """A filter that knows all rows of a table of keys; tasks send the driver at most ``FILTER_BITS`` in all."""
    n = keys.count()
    bits = 1 << 12
    while bits < min(FILTER_BITS, n * ENTRY_BITS):
        bits *= 2

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Filter.places(batch.column(0).to_numpy().view(np.uint64), bits)
            cells, of = np.unique(at >> np.uint64(6), return_inverse=True)
            masks = np.zeros(len(cells), np.uint64)
            np.bitwise_or.at(masks, of, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(masks.view(np.int64))], names=["cell", "mask"])

    found = keys.select("key").mapInArrow(run, "cell int, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    cells = np.zeros(bits // 64, np.uint64)
    cells[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Filter(cells)


class Coded:
    """A block opened: word numbers in order, the id of each number, and which numbers a filter knows."""

    def __init__(self, lang: str, words: bytes, ids: bytes, seed: int, known: Filter):
        own = words.split(b" ") if words else []
        names = np.fromiter((word_id(w, seed) for w in own), np.uint64, len(own))
        self.lang, self.names = lang, np.append(np.uint64(0), names)
        self.known = np.append(False, known.has(mixed(names[:, None], lang)))
        self.ids = loosen(ids, "<u4").astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs of known words begin, and a number for each pair."""
        at = np.flatnonzero(self.known[self.ids[:-1]] & self.known[self.ids[1:]])
        return at, self.ids[at] * len(self.names) + self.ids[at + 1]


def opened(batches, seed: int, known: Filter) -> Iterator[Coded]:
    for batch in batches:
        for lang, words, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield Coded(lang, words, ids, seed, known)


def pair_runs(blocks: DataFrame, seed: int, known: Filter, bits: int, slots: int) -> DataFrame:
    """slot, keys, counts: each block's pairs of known words by the first ``bits`` bits of their hash, in ascending order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in opened(batches, seed, known):
            _, code = block.pairs()
            distinct, counts = np.unique(code, return_counts=True)
            names = block.names[np.stack([distinct // len(block.names), distinct % len(block.names)], axis=1)]
            key = mixed(names, block.lang) >> np.uint64(64 - bits)
            order = np.argsort(key, kind="stable")
            key, counts = key[order], np.minimum(counts[order], 0xFFFF).astype("<u2")
            cuts = np.searchsorted((key * np.uint64(slots)) >> np.uint64(bits), np.arange(slots + 1)).tolist()
            full = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in full], pa.int32()),
                 pa.array([squeeze(np.diff(key[a:b], prepend=np.uint64(0))) for _, a, b in full], pa.binary()),
                 pa.array([squeeze(counts[a:b]) for _, a, b in full], pa.binary())], names=["slot", "keys", "counts"])

    return blocks.select("lang", "words", "ids").mapInArrow(run, "slot int, keys binary, counts binary")


def frequent_pairs(runs: DataFrame, min_count: int) -> DataFrame:
    """key: the hashes whose pairs occur ``min_count`` times between them."""
    least = min(min_count, 0xFFFF)  # a block's count stops there, which is frequent enough for any threshold up to it

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(loosen(x, "<u8"), dtype=np.uint64) for x in own["keys"]])
        counts = np.concatenate([loosen(x, "<u2") for x in own["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(keys[order]) > 0))
        often = np.add.reduceat(counts[order], starts) >= least
        return pd.DataFrame({"key": keys[order][starts][often].view(np.int64)})

    return runs.groupBy("slot").applyInPandas(merge, "key long")


WORD = 8  # bytes of a word id in a key


class Branch:
    """A trie node over the next word."""

    __slots__ = ("children",)

    def __init__(self):
        self.children: dict[bytes, Branch | dict[bytes, int]] = {}


class HatTrie:
    """Counts of phrases by first word; below that containers (hash tables of what follows) and branches.

    A container of more than ``burst`` entries becomes a branch with a container for each next word, if
    what follows there may be longer than a word.
    """

    def __init__(self, burst: int):
        self.burst = burst
        self.root: dict[bytes, Branch | dict[bytes, int]] = {}
        self.held: dict[bytes, int] = {}  # entries below each first word
        self.size = 0

    def insert(self, words: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct phrases of one length, those with a first word next to each other."""
        width = WORD * words.shape[1]
        raw = words.astype(">u8").tobytes()
        cuts = [0, *(np.flatnonzero(words[1:, 0] != words[:-1, 0]) + 1).tolist(), len(words)]
        counts = counts.tolist()
        for a, b in zip(cuts, cuts[1:]):
            head = raw[a * width:a * width + WORD]
            keys = [raw[i + WORD:i + width] for i in range(a * width, b * width, width)]
            fresh = self._put(self.root, head, keys, counts[a:b])
            self.held[head] = self.held.get(head, 0) + fresh
            self.size += fresh

    def _put(self, parent: dict, head: bytes, keys: list[bytes], counts: list[int]) -> int:
        node = parent.get(head)
        if node is None:
            node = parent[head] = {}
        if isinstance(node, Branch):
            fresh, at = 0, 0
            for word, same in groupby(keys, lambda k: k[:WORD]):
                n = sum(1 for _ in same)
                fresh += self._put(node.children, word, [k[WORD:] for k in keys[at:at + n]], counts[at:at + n])
                at += n
            return fresh
        before = len(node)
        if len(set(keys)) == len(keys):
            node.update(zip(keys, map(add, map(node.get, keys, repeat(0)), counts)))
        else:
            for k, c in zip(keys, counts):
                node[k] = node.get(k, 0) + c
        fresh = len(node) - before
        if len(node) > self.burst and max(map(len, node)) > WORD:
            parent[head] = branch = Branch()
            for k, c in node.items():
                branch.children.setdefault(k[:WORD], {})[k[WORD:]] = c
        return fresh

    def subtree(self, head: bytes) -> Iterator[tuple[bytes, int]]:
        """Take a first word's subtree out: its phrases and counts."""
        def walk(prefix: bytes, node) -> Iterator[tuple[bytes, int]]:
            if isinstance(node, Branch):
                for word, child in node.children.items():
                    yield from walk(prefix + word, child)
            else:
                for k, c in node.items():
                    yield prefix + k, c

        self.size -= self.held.pop(head)
        return walk(head, self.root.pop(head))

    def largest(self, entries: int) -> list[bytes]:
        """First words of the largest subtrees that hold so many entries between them."""
        heads, total = [], 0
        for head in sorted(self.held, key=self.held.get, reverse=True):
            if total >= entries:
                break
            heads.append(head)
            total += self.held[head]
        return heads


RUNS = "lang string, slot int, length int, entries long, keys binary, counts binary"
RUN_NAMES = ["lang", "slot", "length", "entries", "keys", "counts"]


def runs_of(lang: str, entries: list[tuple[bytes, int]], slots: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of some phrases, one for each slot and length."""
    entries.sort(key=lambda e: len(e[0]))
    for size, same in groupby(entries, lambda e: len(e[0])):
        own = list(same)
        n = size // WORD
        keys = np.frombuffer(b"".join([k for k, _ in own]), ">u8").reshape(-1, n).astype(np.uint64)
        counts = np.fromiter((c for _, c in own), np.int64, len(own))
        slot = (mixed(keys[:, :2], lang) >> np.uint64(40)) % np.uint64(slots)
        order = np.lexsort((*[keys[:, j] for j in range(n - 1, -1, -1)], slot))
        keys, counts, slot = keys[order], counts[order], slot[order].astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
        rows = [(lang, int(slot[a]), n, b - a, keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
            names=RUN_NAMES)


def phrases_in(block: Coded, pairs: Filter, bits: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct phrases of a block by length, with their counts: those whose pairs all may be frequent."""
    at, code = block.pairs()
    for n in range(2, longest + 1):
        distinct, first, of, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        phrases = block.names[block.ids[at[first][:, None] + np.arange(n)]]
        if n == 2:
            good = pairs.has(mixed(phrases, block.lang) >> np.uint64(64 - bits))
            phrases, counts = phrases[good], counts[good]
            here = good[of]
            at, of = at[here], of[here]
            follows = np.zeros(len(block.ids) + 1, bool)
            follows[at] = True
        if not len(phrases):
            return
        yield phrases, counts
        on = follows[at + n - 1]  # the last two of the longer phrase are a pair as well
        at, of = at[on], of[on]
        if n < longest:
            code = of * len(block.names) + block.ids[at + n]


def phrase_runs(blocks: DataFrame, seed: int, words: Filter, pairs: Filter, bits: int, longest: int, slots: int,
                trie_entries: int, burst: int) -> DataFrame:
    """Sorted runs of all phrases, as the tasks' tries spill them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}

        def spill(lang: str, entries: int) -> Iterator[pa.RecordBatch]:
            trie = tries[lang]
            out = [e for head in trie.largest(entries) for e in trie.subtree(head)]
            if not trie.size:
                del tries[lang]
            yield from runs_of(lang, out, slots)

        for block in opened(batches, seed, words):
            lang = block.lang
            for phrases, counts in phrases_in(block, pairs, bits, longest):
                for a in range(0, len(phrases), trie_entries):  # a trie never holds more than twice its entries
                    tries.setdefault(lang, HatTrie(burst)).insert(phrases[a:a + trie_entries], counts[a:a + trie_entries])
                    while sum(t.size for t in tries.values()) > trie_entries:
                        yield from spill(max(tries, key=lambda k: tries[k].size), trie_entries // 2)
        for lang in list(tries):
            yield from spill(lang, tries[lang].size)

    return blocks.select("lang", "words", "ids").mapInArrow(run, RUNS)


def merged(runs: DataFrame, min_count: int, merge_entries: int) -> DataFrame:
    """lang, words, f: the frequent phrases of written runs, merged slot by slot."""
    totals = pin(runs.groupBy("lang", "slot", "length").agg(F.sum("entries").alias("total")))
    pieces = F.ceil(F.col("total") / F.lit(merge_entries)).cast("int")
    held = runs.join(totals.select("lang", "slot", "length", pieces.alias("pieces")), ["lang", "slot", "length"])

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, slot, n, parts, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if parts == 1:
                    out.append((lang, slot, n, 0, keys, counts))
                    continue
                own, c = np.frombuffer(keys, np.uint64).reshape(-1, n), np.frombuffer(counts, np.int64)
                piece = mixed(own, lang) % np.uint64(parts)
                out += [(lang, slot, n, k, own[piece == k].tobytes(), c[piece == k].tobytes()) for k in range(parts)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["lang", "slot", "length", "piece", "keys", "counts"])

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        lang, n = own["lang"].iloc[0], int(own["length"].iloc[0])
        keys = np.frombuffer(b"".join(own["keys"]), np.uint64).reshape(-1, n)
        counts = np.frombuffer(b"".join(own["counts"]), np.int64)
        order = np.lexsort([keys[:, j] for j in range(n - 1, -1, -1)])
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        total = np.add.reduceat(counts, starts) if len(starts) else counts
        often = total >= min_count
        words = keys[starts][often].view(np.int64)
        return pd.DataFrame({"lang": pd.Series([lang] * len(words), dtype=object), "words": pd.Series(list(words), dtype=object), "f": total[often]})

    dealt = held.select("lang", "slot", "length", "pieces", "keys", "counts").mapInArrow(
        deal, "lang string, slot int, length int, piece int, keys binary, counts binary")
    return dealt.groupBy("lang", "slot", "length", "piece").applyInPandas(merge, "lang string, words array<long>, f long")


def phrase_counts(blocks: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, trie_entries: int = TRIE_ENTRIES,
                  burst: int = BURST, merge_entries: int = MERGE_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, id, word, n of all words; lang, words (ids), f of frequent phrases of two and more words."""
    for seed in range(64):
        words = materialize(word_table(blocks, seed), "words")
        if shared_ids(words, min_count).isEmpty():
            break
        discard(words)
    else:
        raise RuntimeError("no seed keeps the frequent words apart")
    total = words.agg(F.sum("n")).first()[0] or 0
    slots = 16
    while slots * SLOT_WORDS < total:
        slots *= 2
    bits = min(44, max(28, int(total).bit_length() + 4))
    known = filter_of(word_keys(words.where(F.col("n") >= min_count)))
    with small_batches(blocks.sparkSession):
        runs = materialize(pair_runs(blocks, seed, known, bits, slots), "pair-runs")
        keys = materialize(frequent_pairs(runs, min_count), "frequent-pairs")
        discard(runs)
        runs = materialize(phrase_runs(blocks, seed, known, filter_of(keys), bits, longest, slots, trie_entries, burst), "phrase-runs")
        phrases = materialize(merged(runs, min_count, merge_entries), "phrases")
        discard(runs)
    return words, phrases


def salted(df: DataFrame, by: Column) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def scores(words: DataFrame, phrases: DataFrame, min_count: int) -> DataFrame:
    """lang, words, a, k, l, r, n, score: each phrase with its lowest-scoring cut."""
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = phrases.unionByName(words.where(F.col("n") >= min_count).select("lang", F.array("id").alias("words"), F.col("n").alias("f")))
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "words", F.col("f").alias("a"), "k", F.slice("words", F.lit(1), F.col("k")).alias("first"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cut = salted(cut, F.col("words"))
    for part, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(copies.withColumnRenamed("words", part).withColumnRenamed("f", name), ["lang", "salt", part])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.join(totals, "lang").withColumn("above", big("a") * (F.lit(1000).cast("decimal(4,0)") * big("n"))).withColumn(
        "below", big("l") * big("r")).withColumn("score", F.expr("above div below"))
    best = cut.groupBy("lang", "words").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "a", "n", "best.*")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, absorb: int = 100,
                 lang_col: str = "lang", text_col: str = "text", **limits) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k: the best phrases of each language.

    Candidates are phrases of 2 to ``longest`` words that occur ``min_count`` times; one is dropped when a longer
    candidate that holds it occurs ``absorb`` per cent as often (if any such is, one of a single word more is).
    Null and empty texts have no words; a null language is ``und``; repeated rows count each time; an empty table
    gives no rows; other columns are ignored.  Ties of score go by count, then by the phrase's bytes.
    """
    blocks = materialize(code_blocks(docs, lang_col, text_col), "word-blocks")
    words, phrases = phrase_counts(blocks, min_count, longest, **limits)
    discard(blocks)
    part = lambda at: F.slice("words", F.lit(at), F.size("words") - 1)
    inner = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array(part(1), part(2))).alias("words"), "f") \
        .groupBy("lang", "words").agg(F.max("f").alias("cover"))
    kept = scores(words, phrases, min_count).join(inner, ["lang", "words"], "left").where(
        F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * absorb)).drop("cover")
    order = [F.desc("score"), F.desc("a")]
    near = materialize(kept.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= top).drop("_r"), "collocations")
    spelt = near.select("lang", "words", F.posexplode("words").alias("at", "id")).join(
        words.select("lang", "id", "word"), ["lang", "id"]).groupBy("lang", "words").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = near.join(spelt, ["lang", "words"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
