"""Statistics of whole texts for the quality operators, taken in one pass by Arrow batches.

Words are runs of characters other than the six ASCII white-space characters.
"""

from __future__ import annotations

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Shares of a text by rule, each between 0 and 1 but for the last three.
SHARES = ("symbols", "repeats", "dup_lines", "upper", "digits", "marks", "top_word", "distinct", "word_length", "log_words", "line_words")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = codes[:n]
    for k in range(1, width):
        _, key = np.unique(key * len(number) + codes[k:k + n], return_inverse=True)
    often = (np.bincount(key) >= 2)[key]
    if not often.any():
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(raw: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and ``SHARES`` of a text."""
    text = raw.decode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup, repeats = duplicate_lines(raw), repeated_words(words)
    if not n:
        return (0, chars, symbols, dup, repeats), [0.0] * len(SHARES)
    lines = raw.count(b"\n") + 1
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(codes, minlength=256)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    letters = max(1, chars - marks - int(kinds[48:58].sum()))
    upper = int(kinds[65:91].sum())
    shares = [symbols / chars, repeats / n, dup / lines, min(1.0, upper / letters), float(kinds[48:58].sum()) / chars, marks / chars,
              max(counts.values()) / n, len(counts) / n ** 0.8, chars / n, float(np.log1p(n)), float(np.log1p(n / lines))]
    return (n, chars, symbols, dup, repeats), shares


def rows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(t) for t in texts]
    return (np.array([a for a, _ in found], np.int64).reshape(len(found), 5),
            np.array([b for _, b in found], np.float64).reshape(len(found), len(SHARES)))


__all__ = ["SHARES", "SYMBOLS", "rows_of", "statistics"]
