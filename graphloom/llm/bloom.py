"""Once-seen and twice-seen Bloom filters that are built apart in each task and merged block by block.

A hash sets its k slots in the once filter; a slot that is there already also goes to the twice
filter. Merging two tasks' filters keeps that meaning: twice = twice1 | twice2 | (once1 & once2).
An item that occurs at least twice therefore always finds all its slots in the twice filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .text import mix

BLOCK = 1 << 15  # bytes of a filter in one row
#: Exponent bounds of a filter's bits. 2^29 bits are 64 MB, the most that is ever broadcast. Past
#: that, a filter that fills up makes more items suspect; what follows stays exact, and shuffles more.
LEAST_BITS, MOST_BITS = 18, 29
_SCHEMA = "block int, once binary, twice binary"


def slots(hashes: np.ndarray, bits: int, k: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [(hashes if j == 0 else mix(hashes + np.uint64(0x632BE59BD9B4E019 * j & (1 << 64) - 1))) >> shift for j in range(k)]


def _mark(at: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    at = np.sort(at)
    new = np.empty(len(at), bool)
    new[:1] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    again, at = at[~new], at[new]
    byte, bit = (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
    again = np.concatenate([again, at[(once[byte] & bit) > 0]])
    np.bitwise_or.at(once, byte, bit)
    np.bitwise_or.at(twice, (again >> np.uint64(3)).astype(np.int64), np.left_shift(1, (again & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    block, once, twice = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])


def twice_seen(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, k: int) -> Broadcast:
    """The twice-seen filter of all hashes, broadcast as bytes.

    hashes gives arrays of 64-bit hashes for a batch of df; a hash counts once for each time it is given.
    """
    size = min(BLOCK, 1 << bits - 3)

    def partial(batches):
        once, twice = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for h in hashes(batch):
                for at in slots(h, bits, k):
                    _mark(at, once, twice)
        found = []
        for i in range(0, len(once), size):
            if once[i : i + size].any():
                found.append((i // size, zlib.compress(once[i : i + size].tobytes(), 1), zlib.compress(twice[i : i + size].tobytes(), 1)))
            if len(found) == 256:
                yield _rows(found)
                found = []
        if found:
            yield _rows(found)

    def merged(batches):
        block, once, twice = None, None, None
        for batch in batches:
            for b, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8).copy() for x in (o, t))
                if b != block:
                    if block is not None and twice.any():
                        yield _rows([(block, b"", zlib.compress(twice.tobytes(), 1))])
                    block, once, twice = b, o, t
                else:
                    twice |= t | (once & o)
                    once |= o
        if block is not None and twice.any():
            yield _rows([(block, b"", zlib.compress(twice.tobytes(), 1))])

    parts = df.mapInArrow(partial, _SCHEMA)
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, _SCHEMA).select("block", "twice")
    out = np.zeros(1 << bits - 3, np.uint8)
    for row in blocks.toLocalIterator():  # 64 MB at most in all, see MOST_BITS
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def might_repeat(twice: bytes, hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """For each hash, whether it may occur twice or more; False is certain."""
    table = np.frombuffer(twice, np.uint8)
    found = np.ones(len(hashes), bool)
    for at in slots(hashes, bits, k):
        found &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


MOST_COUNTER_BITS = 25  # 2^25 one-byte classes are 32 MB


def count_classes(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """For each of 2^bits slots, the bit length of the number of hashes that fall there, as one byte.

    Class 0 or 1 makes a hash unique for certain; else the class is at least that of its true count.
    """
    size = min(BLOCK, 1 << bits)

    def partial(batches):
        n = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for h in hashes(batch):
                np.add.at(n, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        found = []
        for i in range(0, len(n), size):
            if n[i : i + size].any():
                found.append((i // size, zlib.compress(np.minimum(n[i : i + size], 65535).astype(np.uint16).tobytes(), 1), b""))
            if len(found) == 256:
                yield _rows(found)
                found = []
        if found:
            yield _rows(found)

    def packed(block, total):
        return _rows([(block, zlib.compress(np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8).tobytes(), 1), b"")])

    def merged(batches):
        block, total = None, None
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(x), np.uint16)
                if b != block:
                    if block is not None:
                        yield packed(block, total)
                    block, total = b, np.zeros(len(x), np.uint64)
                total += x
        if block is not None:
            yield packed(block, total)

    parts = df.mapInArrow(partial, _SCHEMA)
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, _SCHEMA).select("block", "once")
    out = np.zeros(1 << bits, np.uint8)
    for row in blocks.toLocalIterator():  # 32 MB at most in all
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(zlib.decompress(row.once), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())
