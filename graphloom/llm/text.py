"""Vectorised words, word hashes and shingles over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those six are single bytes in
UTF-8, so bytes and code points give the same words. Null text counts as empty. Work goes in slices
of about ``SLICE`` bytes, so temporaries stay small however many rows an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64 bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BY_PLACE = seeded(1 << 12, 7)


def _multipliers(n: int) -> np.ndarray:
    global _BY_PLACE
    if n > len(_BY_PLACE):
        _BY_PLACE = seeded(1 << n.bit_length(), 7)
    return _BY_PLACE


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole rows [a, b) of about limit bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in raw, and the first word's number of each row (n+1)."""
    space = _SPACE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    marks = np.flatnonzero(edge)
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kept = ~space[marks[:-1]]
    starts, ends = marks[:-1][kept], marks[1:][kept]
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every word; with lower, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    step = 1 << 17
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        n = e - s
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        b = raw[place + np.repeat(s, n)]
        b = (_LOWER[b] if lower else b).astype(np.uint64)
        b += np.uint64(1)
        b *= _multipliers(int(n.max(initial=1)))[place]
        out[i : i + step] = np.add.reduceat(b, first) + n.astype(np.uint64)
    return mix(out)


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start word) of each window of size words that lies in one row; first: n+1 word numbers."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m, n = seeded(size, seed), len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : n + j] * m[j]
    last = np.repeat(first[1:], np.diff(first))[:n]  # the row's end for each start
    at = np.flatnonzero(np.arange(n) + size <= last)
    return mix(total[at]), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and n+1 offsets.

    Rows of 1 to size-1 words have their whole sequence as the one shingle; rows without a word none.
    """
    starts, ends, first = words(raw, offsets)
    h = word_hashes(raw, starts, ends, True)
    grams, at = windows(h, first, size)
    n = np.diff(first)
    row = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        m = seeded(size, 23)
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            whole[has] += h[first[short[has]] + j] * m[j]
        grams = np.concatenate([grams, mix(whole + n[short].astype(np.uint64))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    ends = np.searchsorted(row, np.arange(len(n)), "right").tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        grams[a:b].sort()
    if len(grams):
        new = np.empty(len(grams), bool)
        new[0] = True
        np.logical_or(grams[1:] != grams[:-1], row[1:] != row[:-1], out=new[1:])
        grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(n) + 1), "left")


class Types:
    """Distinct words by hash, each with its number in order of arrival."""

    def __init__(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: sorted, distinct. (their numbers, which of them are new); new ones are added."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        out = np.empty(len(keys), np.int64)
        out[~new] = self.number[at[~new]]
        out[new] = np.arange(len(self.keys), len(self.keys) + int(new.sum()))
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.number = np.insert(self.number, at[new], out[new])
        return out, new
