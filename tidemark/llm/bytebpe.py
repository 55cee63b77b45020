"""Byte-level BPE: pre-tokens found by scans over transition functions, merged once each, decoded from any place.

A text's code points become symbols: their class (letter, number, white space, other), and for spaces and
apostrophes what follows.  A symbol is a function from states to states of a small automaton; the functions
form a finite monoid, whose products stand in one table.  Blocks of symbols are multiplied at once, column by
column; the products of whole blocks are scanned in a logarithmic number of steps, and each block's prefixes
applied to the state it is entered with.  A state and a symbol tell if a pre-token begins.

The slices between beginnings are merged by the ranks of a vocabulary, each distinct one once while a worker
remembers it.  A document keeps marks (ids before, bytes before), so that a span of its text is decoded from the
nearest mark on.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, kept, materialize, slices, small_batches

LETTER, NUMBER, OTHER, ATTACHED, LONE, WHITE, SHORT, LONG, END = range(9)
#: Code points of the classes, before what follows them is looked at: a space is ATTACHED, other white space LONE.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Letters and numbers that Unicode 16.0 added, for a Python with older tables.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: Symbols multiplied column by column in a block, and at a time.
BLOCK = 256
STEP_BYTES = 2_000_000
#: Distinct pre-tokens remembered by a worker in each of two generations, and the longest that is remembered.
CACHE_PIECES = 400_000
CACHED_BYTES = 64
#: Pre-tokens longer than this are merged with a heap.
HEAP_BYTES = 96
MARK_IDS = 1024


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, name in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            out[a:b + 1] = name
    out[list(SPACES)] = LONE
    out[0x20] = ATTACHED
    return out


# States: what the code points since the last beginning are.
DONE, LETTERS, NUMBERS, OTHERS, SPACE, WHITES, ONE_MORE, TWO_MORE = range(8)
STATES = 8


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(state, symbol) -> next state, and whether a pre-token begins with the symbol."""
    fresh = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, ATTACHED: SPACE, LONE: DONE, WHITE: WHITES,
             SHORT: ONE_MORE, LONG: TWO_MORE, END: DONE}
    step = np.array([[fresh[s] for s in range(9)]] * STATES, np.uint8)
    begins = np.ones((STATES, 9), bool)
    goes_on = {(LETTERS, LETTER): LETTERS, (NUMBERS, NUMBER): NUMBERS, (WHITES, WHITE): WHITES,
               (SPACE, LETTER): LETTERS, (SPACE, NUMBER): NUMBERS, (ONE_MORE, LETTER): DONE, (TWO_MORE, LETTER): ONE_MORE}
    for state in (OTHERS, SPACE):  # an apostrophe inside a run of signs is one of them
        for symbol in (OTHER, SHORT, LONG):
            goes_on[state, symbol] = OTHERS
    for (state, symbol), to in goes_on.items():
        step[state, symbol], begins[state, symbol] = to, False
    return step, begins


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(product of two functions, state after a function from a state, function of a symbol); function 0 is the identity."""
    step, _ = transitions()
    known: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
    own = [tuple(step[:, s].tolist()) for s in range(9)]
    for f in own:
        known.setdefault(f, len(known))
    grown = 0
    while grown < len(known):  # every product is one by a symbol's function after another
        f = list(known)[grown]
        for g in own:
            known.setdefault(tuple(g[x] for x in f), len(known))
        grown += 1
    table = list(known)
    product = np.array([[known[tuple(g[x] for x in f)] for g in table] for f in table], np.uint16)
    return product, np.array(table, np.uint8), np.array([known[f] for f in own], np.uint16)


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, from products of their functions."""
    product, applied, function = monoid()
    size = product.shape[0]
    flat = product.ravel()
    n = len(symbols)
    rows = -(-n // BLOCK)
    own = np.zeros(rows * BLOCK, np.uint16)
    own[:n] = function[symbols]
    columns = np.ascontiguousarray(own.reshape(rows, BLOCK).T)
    before = np.zeros((BLOCK, rows), np.uint16)
    total = columns[0].copy()
    for j in range(1, BLOCK):
        before[j] = total
        total = flat[total.astype(np.int32) * size + columns[j]]
    reach = 1
    while reach < rows:  # products of 2, 4, 8 ... blocks up to each
        total = np.concatenate([total[:reach], flat[total[:-reach].astype(np.int32) * size + total[reach:]]])
        reach *= 2
    entered = np.concatenate([[DONE], applied[total[:-1], DONE]]).astype(np.int32)
    return applied.ravel()[before.astype(np.int32) * STATES + entered].T.ravel()[:n]


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``ends`` are the places of separators between texts, the last place among them."""
    out = classes()[points]
    out[ends] = END
    white = (out == ATTACHED) | (out == LONE)
    blocked = white | (out == END)
    runs_on = np.append(blocked[1:], True)  # white space that more of it or the end of the text follows
    out[white & runs_on] = WHITE
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = ahead[quotes + 1], ahead[quotes + 2]
        out[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        two = np.zeros(len(quotes), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        out[quotes[two]] = LONG
    return out


def pre_tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All pre-tokens in order, and how many each text has."""
    joined = b"\0".join(texts) + b"\0"
    points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    start = np.cumsum(sizes) - sizes  # a code point's first byte
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]) - 1)
    symbols = symbols_of(points, ends)
    _, begins = transitions()
    first = np.flatnonzero(begins.ravel()[states_before(symbols).astype(np.int32) * 9 + symbols])
    marked = np.insert(np.frombuffer(joined, np.uint8), start[first], 0xFF).tobytes()  # a byte that UTF-8 has not
    pieces = marked.split(b"\xff")[1:]
    at = np.searchsorted(first, ends)  # the separators' own
    counts = np.diff(at, prepend=-1) - 1
    for i in at.tolist()[::-1]:
        del pieces[i]
    return pieces, counts


def cuts(text: bytes, size: int = STEP_BYTES) -> list[int]:
    """Places to cut a long text at: before a space between ASCII letters, where a pre-token always begins."""
    out, at, window = [0], size, 1 << 16
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    while at < len(text):
        near = np.frombuffer(text[at - 1:at + window], np.uint8)
        if len(near) < 3:
            break
        hit = np.flatnonzero(letter[near[:-2]] & (near[1:-1] == 0x20) & letter[near[2:]])
        if len(hit):
            out.append(at + int(hit[0]))
            at = out[-1] + size
        else:
            at += window - 1
    return [*out, len(text)]


class RankTokenizer:
    """A vocabulary of byte strings by rank, with the ids of pre-tokens met lately."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        self.width = int(self.kind[2])
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t))
                     if t[:i] in ranks and t[i:] in ranks}
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.length = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.decimal = [str(i) for i in range(len(self.token))]
        self.lately: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equal ones."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > HEAP_BYTES:
            return self._merge_long(piece)
        none, get = 1 << 62, self.pair.get
        ids = [self.single[b] for b in piece]
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i:i + 2] = [least]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], least), none)
            if i < len(ranks):
                ranks[i] = get((least, ids[i + 1]), none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for pre-tokens of any length."""
        get = self.pair.get
        ids = [self.single[b] for b in piece]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != rank:
                continue  # one side has been merged since
            ids[i], ids[j] = rank, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := left[i]) >= 0 and (r := get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def _learn(self, piece: bytes) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = np.array(self.merge(piece), self.kind).tobytes()
        if len(piece) <= CACHED_BYTES:
            if len(self.lately) >= CACHE_PIECES:  # those not met since are forgotten
                self.before, self.lately = self.lately, {}
            self.lately[piece] = found
        return found

    def _encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text its ids, and the ids and bytes of its pre-tokens."""
        pieces, counts = pre_tokens(texts)
        found = list(map(self.lately.get, pieces))
        if None in found:
            lately, learn = self.lately, self._learn
            for i, f in enumerate(found):
                if f is None:
                    piece = pieces[i]
                    found[i] = lately.get(piece) or learn(piece)
                    lately = self.lately
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(at.tolist(), at[1:].tolist()):
            yield b"".join(found[a:b]), sizes[a:b] // self.width, lengths[a:b]

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids and its marks: ids before and bytes before, at a pre-token's beginning."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
                size += len(texts[end])
                end += 1
            if end == at + 1 and len(texts[at]) > STEP_BYTES:
                ends = cuts(texts[at])
                parts = [next(self._encode([texts[at][a:b]])) for a, b in zip(ends, ends[1:])]
                yield self._marked(*[b"".join(x) if isinstance(x[0], bytes) else np.concatenate(x) for x in zip(*parts)])
            else:
                for part in self._encode(texts[at:end]):
                    yield self._marked(*part)
            at = end

    @staticmethod
    def _marked(ids: bytes, sizes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
        n, b = np.cumsum(sizes), np.cumsum(lengths)
        place = np.flatnonzero(np.diff(n // MARK_IDS, prepend=0) > 0)
        place = place[place < len(n) - 1]
        return ids, np.stack([n[place], b[place]], axis=1).astype("<u8").tobytes()

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind)

    def decode(self, data: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, self.ids(data).tolist()))

    def decode_span(self, data: bytes, marks: bytes, start: int, length: int) -> bytes:
        """``length`` bytes of the text from byte ``start`` on, decoded from the nearest mark before them."""
        ids = self.ids(data)
        known = np.frombuffer(marks, "<u8").reshape(-1, 2).astype(np.int64)
        i = int(np.searchsorted(known[:, 1], start, "right")) - 1
        first, at = known[i].tolist() if i >= 0 else (0, 0)
        j = int(np.searchsorted(known[:, 1], start + length))
        last = int(known[j, 0]) if j < len(known) else len(ids)
        return self.decode(ids[first:last].tobytes())[start - at:start - at + length]


def load(path: str) -> RankTokenizer:
    return kept(f"ranks {path}", lambda: RankTokenizer(path))


ENCODED = "doc_id long, n_tokens long, ids binary, marks binary"


def utf8(text: bytes) -> bytes:
    """The text itself, or with replacement characters where it is no UTF-8."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 16-bit, or 32-bit for larger vocabularies), marks (64-bit pairs).

    A null or empty text has no ids; rows without id and rows with repeated ids are encoded like any other; other
    columns are ignored; bytes that are no UTF-8 become replacement characters; an empty table gives no rows.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks)
        for batch in slices(batches, 1):
            ids, marks = zip(*encoder.encode([utf8(t) for t in bytes_of(batch.column(1))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // encoder.width for x in ids], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "n_tokens", "ids", "marks"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, text (binary) of encoded documents."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        decoder = load(ranks)
        for batch in batches:
            texts = [decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digest(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of a written table of encoded documents."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        decoder = load(ranks)
        for batch in batches:
            ids = batch.column(2).to_pylist()
            listed = [",".join(map(decoder.decimal.__getitem__, decoder.ids(x).tolist())).encode() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
                 pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode into a written table and give the digest of what is read back and decoded."""
    encoded = materialize(encode_documents(docs, ranks, id_col, text_col), "bpe-ids")
    with small_batches(docs.sparkSession):
        return materialize(digest(encoded, ranks), "bpe-digest")
