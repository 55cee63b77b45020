"""Public tokenizers over Arrow batches, with the ids of repeated words kept between batches.

A text's ids are the ids of its pre-tokens one after another, so a text may be cut wherever the
pre-tokenizer is sure to cut.  Two kinds of files are cut finer than whole texts:

* white space dropped (``word_bpe_49k.json``): at ASCII white space;
* byte level with leading spaces (``byte_bpe_50k.json``): before a single space and around a single
  line feed that stand between other characters.  A text with any other white space is encoded whole.

Every distinct piece is encoded once by the tokenizers library; strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

import json
import string
from itertools import chain, repeat

import numpy as np

from tidemark.llm.common import forget_kept, kept

#: Distinct pieces kept by a Python worker before those met once are forgotten, and learned in one call.
CACHE_PIECES = 600_000
LEARN_PIECES = 20_000
#: Bytes of text whose pieces are held at a time.
STEP_BYTES = 2_000_000


#: A run of these after letters is a pre-token of its own (an apostrophe may begin a contraction).
SIGNS = string.punctuation.replace("'", "")


def _byte_chars() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


def load(path: str) -> "PieceTokenizer":
    """The worker's tokenizer for a file; its memory of pieces outlives a task."""
    return kept(f"tokenizer {path}", lambda: PieceTokenizer(path))


def unload() -> None:
    """Give the memory of pieces back: for tasks that do not encode, in workers that have."""
    forget_kept()


class PieceTokenizer:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
                and not spec.get("normalizer"):
            self.kind = "spaced"
        elif pre.get("type") == "Sequence" and (split := pre["pretokenizers"][0]).get("behavior") == "Removed" \
                and split.get("invert") and '"Lowercase"' in json.dumps(spec.get("normalizer")) and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
            self.kind = "dropped"
        self.code: dict[bytes, int] = {}
        self.start, self.count, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.bad = np.zeros(0, np.uint32), np.zeros(0, bool)

    def forget(self) -> None:
        """Keep the pieces met most often, at most half of what fits; those met once go."""
        least = 2
        while (self.met >= least).sum() > CACHE_PIECES // 2:
            least *= 2
        keep = np.flatnonzero(self.met >= least)
        place = np.full(len(self.met), -1, np.int64)
        place[keep] = np.arange(len(keep))
        self.code = {p: at for p, c in self.code.items() if (at := int(place[c])) >= 0}
        n = self.count[keep]
        first = np.cumsum(n) - n
        self.pool = self.pool[np.repeat(self.start[keep] - first, n) + np.arange(int(n.sum()))]
        self.start, self.count, self.bad, self.met = first, n, self.bad[keep], np.zeros(len(keep), np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many belong to each text."""
        ids, counts, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
                size += len(texts[end])
                end += 1
            a, b = self._step(texts[at:end])
            ids.append(a)
            counts.append(b)
            at = end
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32),
                np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32)
                for e in self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def _step(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            found = self._whole(texts)
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        if len(self.code) > CACHE_PIECES:
            self.forget()
        odd: dict[int, np.ndarray] = {}
        pieces: list = []
        lengths = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.kind == "dropped":
                own = t.lower().split()  # the files of this kind lower-case anyway
            elif any(x in t for x in (b"  ", b"\n\n", b" \n", b"\n ", b"\0")):
                odd[i] = np.zeros(0, np.uint32)
                own = []
            else:
                own = t.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")
            lengths[i] = len(own)
            pieces += own
        codes = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(codes < 0)
        if len(missed):
            self._learn(list(dict.fromkeys(pieces[i] for i in missed.tolist())))
            codes[missed] = [self.code[pieces[i]] for i in missed.tolist()]
        self.met += np.bincount(codes, minlength=len(self.met))
        of = np.repeat(np.arange(len(texts)), lengths)
        for i in np.unique(of[self.bad[codes]]).tolist():
            odd[i] = np.zeros(0, np.uint32)
        n = self.count[codes]
        if odd:
            n = np.where(np.isin(of, list(odd)), 0, n)
        total = int(n.sum())
        first = np.cumsum(n) - n
        ids = self.pool[np.repeat(self.start[codes] - first, n) + np.arange(total)]
        counts = np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)
        if odd:
            at = np.cumsum(counts) - counts
            for i, found in zip(odd, self._whole([texts[i] for i in odd])):
                odd[i] = found
            cuts, parts = sorted(odd), []
            last = 0
            for i in cuts:
                parts += [ids[last:at[i]], odd[i]]
                last = at[i]
                counts[i] = len(odd[i])
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces not met before.

        A piece that, normalised, is one run of letters is one pre-token and goes straight to the library's model, once
        for all pieces with that run; the signs after it are a pre-token of their own.  The others are encoded as
        sequences of their own, thousands in one call of the library.
        """
        texts = [p.decode() for p in new]
        normal, lead = texts, [""] * len(texts)
        if self.kind == "spaced":
            lead = [" " if t[:1] == " " else "" for t in texts]
            normal = [t[len(a):] for t, a in zip(texts, lead)]
        elif self.library.normalizer is not None:
            normal = self.library.normalizer.normalize_str(" ".join(texts)).split(" ")
            if len(normal) != len(texts):  # white space inside a piece
                normal = [self.library.normalizer.normalize_str(t) for t in texts]
        found: list = [None] * len(new)
        stems: dict[str, list[int]] = {}
        tails: dict[str, list[int]] = {}
        model, rest, bad = self.library.model.tokenize, [], np.zeros(len(new), bool)
        for i, (t, before) in enumerate(zip(normal, lead)):
            stem = t.rstrip(SIGNS)
            if stem.isalpha():
                ids = stems.get(before + stem)
                if ids is None:
                    ids = stems[before + stem] = [x.id for x in model((before + stem).encode().decode("latin-1").translate(BYTE_CHARS))]
                if len(stem) < len(t):
                    signs = t[len(stem):]
                    if signs not in tails:
                        tails[signs] = self.library.encode(signs, add_special_tokens=False).ids
                    ids = ids + tails[signs]
                found[i] = ids
            elif self.kind == "spaced" and texts[i] not in ("", "\n") and t.split() != [t]:
                # other white space inside a piece may belong to a run that the cuts have split: its text is encoded whole
                bad[i], found[i] = True, []
            else:
                rest.append(i)
        for k in range(0, len(rest), LEARN_PIECES):
            some = rest[k:k + LEARN_PIECES]
            own = self.library.encode([texts[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            ids = own.ids
            ends = np.cumsum(np.bincount(np.array(own.word_ids, np.int64), minlength=len(some))).tolist()
            for i, a, b in zip(some, [0, *ends], ends):
                found[i] = ids[a:b]
        n = np.fromiter(map(len, found), np.int64, len(found))
        base, first = len(self.start), len(self.pool)
        self.code.update(zip(new, range(base, base + len(new))))
        self.start = np.concatenate([self.start, first + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.bad = np.concatenate([self.bad, bad])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))])
