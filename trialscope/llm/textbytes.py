"""Vectorised views of text columns inside Arrow tasks: bytes, words, rolling hashes.

All functions take NumPy arrays of one bounded slice of a task's rows, so their memory follows the slice
size and not the partition. A *word* is a run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
#: values hashed at once
BLOCK = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def _random_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64)


#: two independent polynomial hash lanes modulo 2**64: byte values, odd base and its inverse
LANES = tuple((_random_table(seed), base, pow(base, -1, 1 << 64))
              for seed, base in ((11, 0x9E3779B97F4A7C15), (23, 0xD1342543DE82EF95)))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base; up to two blocks of them are kept for the next call."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 2 * BLOCK), base, dtype=np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 2 * BLOCK:
            _POWERS[base] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads the polynomial's strong high bits over the word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def hash_slices(values: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for ascending starts, one block of values at a time.

    ``values`` are bytes or 64-bit items; equal slices hash alike wherever they stand.
    """
    table, base, inverse = LANES[lane]
    out = np.empty(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):
        at = int(start[first])
        last = int(np.searchsorted(start, at + BLOCK, "left"))
        stop = int(end[first:last].max())
        block = values[at:stop]
        block = table[block] if block.dtype == np.uint8 else block
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(block * powers(base, len(block)), out=sums[1:])
        s, e = start[first:last] - at, end[first:last] - at
        out[first:last] = mix((sums[e] - sums[s]) * powers(inverse, len(sums))[s])
        first = last
    return out


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    buf = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


class Words:
    """Words of consecutive texts: byte ``start``/``end``, ``doc`` of each, per-text word offsets ``off``."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.text_off = buf, off
        n = len(buf)
        inside = ~SPACE[buf]
        first = np.zeros(n + 1, dtype=bool)
        first[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.off = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.off))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lane: int = 0, lower: bool = False) -> np.ndarray:
        return hash_slices(LOWER[self.buf] if lower else self.buf, self.start, self.end, lane)

    def windows(self, size: int) -> np.ndarray:
        """Indexes of the words that begin a window of ``size`` words within one text."""
        at = np.arange(max(0, len(self) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at


    def flat(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the words kept, those of a text parted by one space; where each begins and ends in them."""
        start, doc = self.start[keep], self.doc[keep]
        size = self.end[keep] - start
        gap = np.zeros(len(start), dtype=np.int64)
        gap[1:] = doc[1:] == doc[:-1]
        total = np.cumsum(size + gap)
        read = np.cumsum(size) - size
        out = np.full(total[-1] if len(total) else 0, 0x20, dtype=np.uint8)
        step = np.arange(size.sum())
        out[step + np.repeat(total - size - read, size)] = self.buf[step + np.repeat(start - read, size)]
        return out, total - size, total

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Per text, the words kept, joined by one space."""
        out, _, end = self.flat(keep)
        off = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(keep)))[self.off]].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(out)).cast(pa.string())


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask of the n positions that windows [s, s + size) cover; starts ascend."""
    return between(starts, np.minimum(starts + size, n), n)


def between(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n positions within any [start, end); starts and ends both ascend."""
    step = np.zeros(n + 1, dtype=np.int8)
    if len(starts):
        fresh = np.concatenate(([True], starts[1:] > ends[:-1]))  # merged, so that each edge counts once
        step[starts[fresh]] = 1
        step[ends[np.concatenate((fresh[1:], [True]))]] = -1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]
