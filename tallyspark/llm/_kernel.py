"""Byte-level numpy kernels over Arrow string columns.

Texts of a batch are handled as one flat UTF-8 array with offsets, in slices of
bounded size, so the cost per word is a few vector operations and the memory does
not depend on the size of a partition. A text is never cut: one that is longer
than a slice forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
HASH_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240611).integers(0, 1 << 64, 256, dtype=U64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    x = x + U64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tidy(f):
    """A function over batches that gives freed memory back at its end: Python workers are reused, and idle ones count too."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


class Texts:
    """Consecutive texts as flat bytes; null texts count as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every word `[^\\x20\\x09-\\x0D]+`."""
        return spans(~_SPACE[self.data], self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of ascending byte spans that don't overlap; lower: with A-Z as a-z.

        Works through `HASH_BYTES` at a time, so the memory of a very long text is that of its words."""
        table, out = (_TABLE[_LOWER] if lower else _TABLE), np.zeros(len(starts), U64)
        for lo in range(0, len(self.data), HASH_BYTES):
            hi = min(len(self.data), lo + HASH_BYTES)
            up, down = _power(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(table[self.data[lo:hi]] * up[: hi - lo], dtype=U64, out=sums[1:])
            first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
            a, b = np.maximum(starts[first:last] - lo, 0), np.minimum(ends[first:last], hi) - lo
            part = (sums[b] - sums[a]) * down[a]
            if len(part) and starts[first] < lo:  # goes on from the bytes before
                part[:1] *= U64(pow(_BASE, int(lo - starts[first]), 1 << 64))
            out[first:last] += part
        return mix(out + (ends - starts).astype(U64))

    def code_points(self) -> np.ndarray:
        """For every byte and the end, the code points before it."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a text's bounds."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts in slices of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count or not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(len(column), max(lo + 1, hi))
        yield Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def shingles(words: np.ndarray, text_of: np.ndarray, texts: int, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of `size` words; whole: a shorter text with words is one run."""
    n, m = len(words), size - 1
    if n > m:
        keep = text_of[m:] == text_of[: n - m]
        out = np.zeros(n - m, U64)
        for j in range(size):
            out = mix(out * U64(0x5851F42D4C957F2D) + words[j : n - m + j])
        out, at = out[keep], np.flatnonzero(keep)
    else:
        out, at = np.zeros(0, U64), np.zeros(0, np.int64)
    of = text_of[at]
    if whole:
        count = np.bincount(text_of, minlength=texts)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            first = np.searchsorted(text_of, short)
            ones = np.empty(len(short), U64)
            for k, (lo, c) in enumerate(zip(first, count[short])):
                h = np.full(1, c, U64)
                for w in words[lo : lo + c]:
                    h = mix(h * U64(0x2545F4914F6CDD1D) + w, 7)
                ones[k] = h[0]
            of, at, out = np.concatenate([of, short]), np.concatenate([at, first]), np.concatenate([out, ones])
            order = np.argsort(of, kind="stable")
            of, at, out = of[order], at[order], out[order]
    return out, of, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[k], starts[k]+1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    out = np.arange(ends[-1], dtype=np.int64)
    return out + np.repeat(starts - ends + lengths, lengths)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: int):
    """Consecutive rows with the same first `keys` columns, of batches sorted by them."""
    held, now = [], None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(cut[:-1], cut[1:]):
            key = tuple(c[lo].item() for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)
