"""Word and hash kernels on Arrow string columns, used inside tasks.

A column is handled in slices of a few megabytes, so a task's memory does not
depend on the size of its batch. A word is `[^\\x20\\x09-\\x0D]+`; the separators
are ASCII, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
SLICE_VALUES = 250_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
INVERSE = np.uint64(pow(int(PRIME), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((PRIME, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of consecutive documents: byte spans, and each document's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(documents) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def strings(column: pa.Array) -> pa.Array:
    """The column with 64-bit offsets, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column made by `strings`."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of about `limit` bytes; a longer text is a piece of its own."""
    _, offsets = raw(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def list_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_VALUES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, values, first value of each row) pieces of about `limit` list values as unsigned integers."""
    offsets = batch.column(column).offsets.to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        piece = batch.slice(at, to - at)
        values = piece.column(column).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        yield piece, values, offsets[at : to + 1] - offsets[at]
        at = to


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    inside = ~SEPARATOR[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    begin[heads] = inside[heads]
    finish[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` consecutive words from each position that has as many after it in the array."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * PRIME + hashes[j : j + n]
    return mix(out + np.uint64(size))


def gram_starts(words: Words, size: int) -> np.ndarray:
    """Positions from which a whole gram lies in one document."""
    last = np.repeat(words.first[1:], words.counts)
    at = np.arange(len(last))
    return at[at + size <= last]


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each document id."""
    return (mix(ids.astype(np.int64).view(np.uint64) + PRIME) % np.uint64(buckets)).astype(np.int32)
