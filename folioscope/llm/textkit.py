"""Words, lines and 64-bit hashes of many texts at once, with numpy over their joined UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. The hash of a byte range comes from prefix
sums of a polynomial in an odd base modulo 2**64 over random values for the bytes, so any range
costs two lookups; a finaliser then mixes it. A-Z count as a-z unless asked otherwise.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, random_words

IS_WORD = np.ones(256, np.uint8)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = 0
EXACT = random_words(256, 11)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD1342543DE82EF95 | 1

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base % 2**64, np.uint64)
        factors[0] = 1
        held = _powers[base] = np.cumprod(factors, dtype=np.uint64)
        if size > 1 << 23:  # of one very long text: not kept
            del _powers[base]
    return held[:n]


class RangeHash:
    """Hashes of ranges [begin, end) of a row of values."""

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 2**64), len(values) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mix64(raw + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Texts:
    """Texts joined by newlines, with the places of their words and lines."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        data = ("\n".join(texts) + "\n").encode()
        self.bytes = np.frombuffer(data, np.uint8)
        # Ends of texts: their newlines, found by their lengths.
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        turns = np.diff(IS_WORD[self.bytes].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.word_begin, self.word_end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        #: Words before each text, and of all.
        self.word_at = np.append(np.searchsorted(self.word_begin, self.begins), len(self.word_begin))

    def word_hashes(self, fold: bool = True) -> np.ndarray:
        return RangeHash((FOLDED if fold else EXACT)[self.bytes], BASE)(self.word_begin, self.word_end)

    def words_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def lines(self) -> None:
        """Sets line_begin, line_end (bytes), line_word (words before each line, and of all), line_at (lines before each text, and of all)."""
        self.line_end = np.flatnonzero(self.bytes == 10)
        self.line_begin = np.concatenate([[0], self.line_end[:-1] + 1]) if len(self.line_end) else self.line_end
        self.line_word = np.append(np.searchsorted(self.word_begin, self.line_begin), len(self.word_begin))
        self.line_at = np.append(np.searchsorted(self.line_begin, self.begins), len(self.line_begin))

    def shingles(self, words: int = 5) -> list[np.ndarray]:
        """The sorted distinct hashes of each text's runs of words; a shorter text is one run; without words none."""
        h = self.word_hashes()
        ranged = RangeHash(h, WORD_BASE)
        counts = np.diff(self.word_at)
        n_runs = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        at = np.cumsum(n_runs) - n_runs
        begin = np.repeat(self.word_at[:-1], n_runs) + np.arange(int(n_runs.sum())) - np.repeat(at, n_runs)
        all_runs = ranged(begin, begin + np.repeat(np.minimum(counts, words), n_runs))
        return [np.unique(all_runs[a : a + m]) for a, m in zip(at.tolist(), n_runs.tolist(), strict=True)]


def sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[k] : at[k + 1]]."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def earlier_equal(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where an earlier place has the same group and value."""
    if not len(value):
        return np.zeros(0, bool)
    key = mix64(value ^ mix64(group.astype(np.uint64) + np.uint64(77)))
    order = np.argsort(key, kind="stable")
    repeated = np.zeros(len(value), bool)
    repeated[order[1:]] = key[order[1:]] == key[order[:-1]]
    return repeated


def any_equal(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where another place has the same group and value."""
    if not len(value):
        return np.zeros(0, bool)
    key = mix64(value ^ mix64(group.astype(np.uint64) + np.uint64(77)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(len(value), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return found
