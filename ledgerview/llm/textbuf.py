"""Text columns as byte arrays: slices of bounded size, word bounds and word hashes without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def strings(column) -> pa.Array:
    """A string column without nulls (null: empty), in one piece."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield lo, hi
        lo = hi


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    filled = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = ~filled[:-1]
        after[:-1] = ~filled[1:]
    starts = np.flatnonzero(filled & (before | edge[:-1]))
    ends = np.flatnonzero(filled & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one space after each word in place of any white space."""
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = data[keep]
    out[_SPACE[out]] = 32
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(items: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs items[first:last], equal for equal runs."""
    power, inverse = _power(len(items) + 1)
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * power[: len(items)], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


#: Each bit of an octet as a counter of its own octet, the first bit in the last octet.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None], axis=2, bitorder="little").reshape(256, 8).copy().view(np.uint64)[:, 0]


def majority(values: np.ndarray, owner_first: np.ndarray) -> np.ndarray:
    """For each run owner_first[k]:owner_first[k + 1] of 64-bit values the bits set in over half of them; empty runs: 0.

    Eight counters share a word, so that a run is summed by eight additions a value; longer runs go in parts of 255.
    """
    size = np.diff(owner_first)
    parts = -(-size // 255)
    part_owner = np.repeat(np.arange(len(size)), parts)
    starts = owner_first[:-1][part_owner] + 255 * (np.arange(len(part_owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    out = np.zeros(len(size), np.uint64)
    if not len(starts):
        return out
    filled = np.flatnonzero(parts)
    head = np.cumsum(parts[filled]) - parts[filled]
    octets = np.ascontiguousarray(values)[:, None].view(np.uint8)
    for k in range(8):
        counts = np.add.reduceat(_SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
        if len(counts) > len(filled):
            counts = np.add.reduceat(counts.astype(np.int64), head, axis=0)
        bits = np.packbits(2 * counts.astype(np.int64) > size[filled, None], axis=1, bitorder="little")[:, 0]
        out[filled] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out
