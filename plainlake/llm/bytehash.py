"""Vectorised hashes of words, shingles and byte windows over whole Arrow columns of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed for ever: what these give is compared across tasks and runs. Odd numbers have an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
FOLD = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE**i and its inverse for i below the longest run met so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, factor in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, factor & (2**64 - 1), np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """P with (P[j] - P[i]) * INVERSE**i a hash of data[i:j]."""
    up, _ = Powers.get(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=out[1:])
    return out


def spans(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = Powers.get(len(p))
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(column, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `most` bytes; a longer text is a run of its
    own. Null texts have no bytes."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and the offsets of each text's words in them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    p = prefix(_LOWER[data] if lower else data)
    return spans(p, starts, ends), np.searchsorted(starts, offsets)


def shingles(word: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles of one text, sorted; fewer words than `size` are one shingle; no word, none."""
    n = len(word)
    if n == 0:
        return word
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h + word[i : n - k + 1 + i] * FOLD[i % len(FOLD)]
        h = h ^ (h >> np.uint64(29))
    return np.unique(mix(h))
