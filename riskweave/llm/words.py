"""Words of many texts at once: positions and 64-bit hashes from the UTF-8 bytes, without a Python object per word.

A word's hash is a polynomial in random byte values modulo 2**64 (prefix sums give any stretch by one subtraction),
finished by a mixing step. Equal words have equal hashes in every task; with 64 bits, unequal words that meet in one
comparison differ for all practical sizes, and callers that need more take two seeds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from riskweave.llm.tables import text_buffer

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

BLANKS = np.zeros(256, dtype=bool)  # the bytes between words: space, tab to carriage return
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, dtype=bool)  # all ASCII but letters and digits
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Word i is bytes start[i]:end[i] of data; row r has words bounds[r]:bounds[r+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finish: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _bytes_to_numbers(seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 101).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def split_words(column: pa.Array, blanks: np.ndarray = BLANKS, lower: bool = False, seed: int = 0) -> Words:
    """Words of every row; ``blanks`` says which bytes separate, ``lower`` maps A-Z first."""
    data, offsets = text_buffer(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~blanks[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    size = (n // (1 << 20) + 1) << 20  # few sizes, so the cached powers are reused
    up, down = _powers(size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_bytes_to_numbers(seed)[data] * up[:n], out=sums[1:])
    return Words(data, start, end, bounds, mix((sums[end] - sums[start]) * down[start]))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i (rows aren't looked at: use only starts that stay inside one row)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def shingle_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word shingles that lie inside one row, and their rows."""
    counts = np.maximum(0, np.diff(bounds) - k + 1)
    rows = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][rows] + inside, rows


def join_words(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words of all rows one space apart: text, begin and end of each word, and the rows' word bounds."""
    start, end, bounds = words.start, words.end, words.bounds
    if keep is not None:
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        start, end = start[keep], end[keep]
    size = end - start
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    to = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    joined[to] = words.data[to + np.repeat(start - begin, size)]
    return joined.tobytes(), begin, begin + size, bounds
