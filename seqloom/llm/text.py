"""Vectorised text kernel: word bounds and 64-bit hashes over the buffers of Arrow string columns.

Words are runs of bytes that a table marks. All separators used here are ASCII, so bounds found on
UTF-8 bytes are those found on code points. Hashes are polynomials modulo 2**64 over a random value
per byte, finished by a mixer; two given strings share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that memory does not follow the size of an Arrow batch.
PIECE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GRAM = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes outside the inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: The word classes of the contracts, as complements.
NON_SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """The words of some texts. Text i has words offsets[i]:offsets[i+1]; bytes are as in ``data``."""

    __slots__ = ("data", "bounds", "starts", "ends", "offsets", "_prefix")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        inside = table[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[1:], before[0] = inside[:-1], False
            after[:-1], after[-1] = inside[1:], False
            first = bounds[:-1][bounds[:-1] < len(data)]
            before[first] = False
            after[first[first > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, bounds)
        self._prefix = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def spans_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans."""
        forward, back = _power(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * forward[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * back[starts])

    def hashes(self) -> np.ndarray:
        return self.spans_hash(self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of n words begin (none crosses a text's end), and their hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _GRAM[k]
    fits = np.ones(len(hashes) + 1, bool)
    for k in range(n - 1):
        at = offsets[1:] - 1 - k
        fits[at[at >= 0]] = False
        # a text of fewer words than n loses all of its positions, some of them twice
    starts = np.flatnonzero(fits[: len(total)])
    return starts, mix(total[starts] + np.uint64(n))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``limit`` bytes of ``column``, but a whole text at least."""
    for batch in batches:
        _, bounds = column_bytes(batch.column(batch.schema.get_field_index(column)))
        low, rows = 0, batch.num_rows
        while low < rows:
            high = int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1
            high = min(max(high, low + 1), rows)
            yield batch.slice(low, high - low)
            low = high
    give_back()


def give_back() -> None:
    """Return memory that a task has left behind to the system; Python workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed long."""
    return pa.array(x.view(np.int64))
