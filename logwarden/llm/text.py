"""Arrow text columns as byte arrays: words, word hashes and hash mixing, all vectorised.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Word hashes are 64-bit values of the
UTF-8 bytes: a table value per byte, weighted by powers of an odd number modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_powers.get("up", ()))
    if have < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for key, base in (("up", _ODD), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row stands alone and stays whole."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and for each row the index of its first word (n + 1 values)."""
    base = int(offsets[0])
    seg = data[base : int(offsets[-1])]
    rel = offsets - base
    solid = SOLID[seg]
    edge = np.zeros(len(seg) + 1, bool)
    edge[rel] = True
    before = np.zeros(len(seg), bool)
    before[1:] = solid[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(seg), bool)
    after[:-1] = solid[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts + base, ends + base, np.searchsorted(starts, rel)


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of each row, and for each row the index of its first word (n + 1 values)."""
    hashes, firsts, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1]
        base = int(part[0])
        seg = data[base : int(part[-1])]
        starts, ends, first = word_bounds(data, part)
        up, down = _power_tables(len(seg))
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * up[: len(seg)], out=sums[1:])
        starts, ends = starts - base, ends - base
        h = (sums[ends] - sums[starts]) * down[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64) * _ODD))
        firsts.append(first[1:] + total)
        total += len(h)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(firsts)


def text_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
