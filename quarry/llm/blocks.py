"""Word splitting and hashing over whole Arrow batches, in numpy.

The bytes of many documents are handled at once: no Python loop runs per word or per byte. Words are
runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses these bytes inside a character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            t, have = np.ones(1, np.uint64), 1
            while have < size:
                t = np.concatenate([t, t * _U(pow(base, have, 1 << 64))])
                have *= 2
            _powers[k] = t
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Workers live on: what a batch took, in Arrow and in numpy, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words:
    """The words of a run of documents: byte ranges, hashes and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        mark = np.zeros(n + 1, bool)
        mark[offsets] = True
        solid = ~_BLANK[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | mark[:-1]))
        self.end = np.flatnonzero(solid & (~after | mark[1:])) + 1
        self.data, self.offsets = data, offsets
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:n], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, size: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start (word number) and hash of every window of so many words within one document; of: other hashes of the words."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        have, width = self.hash if of is None else of, 1
        done, at = None, 0
        rest = size
        while True:
            if rest & 1:
                part = have[at : at + n]
                done = part.copy() if done is None else mix64(done * _U(0xC2B2AE3D27D4EB4F) + part)
                at += width
            rest >>= 1
            if not rest:
                break
            have = mix64(have[:-width] * _U(0x9FB21C651E98DF25) + have[width:])
            width *= 2
        ok = np.ones(n, bool)
        for back in range(1, size):  # no window may span the first word of a later document
            at_first = self.first[(self.first >= back) & (self.first - back < n)] - back
            ok[at_first] = False
        inner = np.flatnonzero(ok)
        return inner, done[inner]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most limit bytes of text (one row at least), with their bytes and offsets."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    del data, offsets
    give_back()


def blob_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
