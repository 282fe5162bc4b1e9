"""Hashes of many spans of a byte buffer at once, and ragged gathers, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` of BASE and of its inverse."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; it depends on the span's bytes and length alone."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[stops] - sums[starts]) * down[starts]
    return mix(raw ^ mix((stops - starts).astype(np.uint64)))


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - sizes), sizes)
    return values[shift + np.arange(total)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, NULL as empty, and the n + 1 offsets into them."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    filled = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(filled):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and n + 1 byte offsets."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.binary())


def small_batches(batches: Iterable[pa.RecordBatch], text: int, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            held = sums[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sums, held + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of rows that are equal in ``keys`` begin."""
    columns = [table.column(c).to_numpy() for c in keys]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in columns])
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 10_000) -> Iterator[pa.Table]:
    """Tables of complete groups, from batches sorted by ``keys``: about ``least`` rows or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        end = int(group_starts(table, keys)[-1])
        if end:
            yield table.slice(0, end)
        held, size = table.slice(end).to_batches(), table.num_rows - end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Lookup:
    """Integer keys to integers over numpy arrays: open addressing, -1 for unknown keys."""

    def __init__(self, entries: dict[int, int]):
        bits = max(4, (2 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(entries.keys(), np.int64, len(entries))
        values = np.fromiter(entries.values(), np.int64, len(entries))
        at = self._home(keys)
        while len(keys):
            empty = self.keys[at] < 0
            self.keys[at[empty]], self.values[at[empty]] = keys[empty], values[empty]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out.reshape(shape)
