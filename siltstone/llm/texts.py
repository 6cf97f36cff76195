"""Words and their hashes for whole Arrow columns at once, in numpy.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which for UTF-8
equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The letters and numbers up to U+017F, as ranges of a pattern; texts of these, of other
#: printable characters up to there and of \t \n \r alone are plain: composed, lower-cased
#: and split alike by every version of the Unicode tables.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
PLAIN = re.compile("[\\x20-\\x7e\\t\\n\\r\\xa1-\\xac\\xae-ſ]*")
#: Text bytes that one step handles; a longer text is a step of its own.
STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64)
_MULT = np.random.default_rng(20250102).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, STEP + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP, "right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of each word and, for each text and one more, the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased first if asked."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[LOWER[data] if lower else data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MULT[63])


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = np.full(size, int(_MULT[(salt + 31) % 64]) * n & (1 << 64) - 1, np.uint64)
    for k in range(n):
        out += mix(hashes[k : k + size] + _MULT[(salt + k) % 64]) * _MULT[(salt + 2 * k + 7) % 64] if salt else hashes[k : k + size] * _MULT[k]
    return mix(out)


def starts_of(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """A mask over count grams: true where a gram of n words lies within one text."""
    ok = np.ones(max(count, 0), bool)
    for edge in first[1:-1]:
        ok[max(0, edge - n + 1) : edge] = False
    return ok
