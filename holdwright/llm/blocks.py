"""Rows that carry arrays: hash entries by range, texts and marks by bucket.

A row per (task slice, range) moves thousands of hashes at once, so a shuffle of
all word positions costs little more than its bytes. Ids beside the hashes are
stored as offsets from the slice's smallest id when they fit 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdwright.llm.kernels import bucket_of

RANGE_BITS = 12
ENTRY, MARK, TEXT = 0, 1, 2
SCHEMA = "part int, kind int, base long, ids binary, keys binary"
NAMES = ["part", "kind", "base", "ids", "keys"]
SLICE_ENTRIES = 1_000_000


def batch(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


def pack_ids(ids: np.ndarray) -> tuple[int, bytes]:
    if not len(ids):
        return 0, b""
    base = int(ids.min())
    return (base, (ids - base).astype(np.uint32).tobytes()) if int(ids.max()) - base < 2**32 else (0, ids.astype(np.int64).tobytes())


def unpack_ids(base: int, body: bytes, count: int) -> np.ndarray:
    wide = len(body) == 8 * count
    return np.frombuffer(body, np.int64 if wide else np.uint32).astype(np.int64) + (0 if wide else base)


def entries(hashes: np.ndarray, ids: np.ndarray, width: int = 8) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Rows of (hash, id) entries by range of the hash; `width` 4 keeps the hash's middle bits only."""
    if not len(hashes):
        return
    part = (hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    hashes, ids, part = hashes[order], ids[order], part[order]
    if width == 4:
        hashes = (hashes >> np.uint64(64 - RANGE_BITS - 32)).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
        base, packed = pack_ids(ids[a:b])
        yield int(part[a]), ENTRY, base, packed, hashes[a:b].tobytes()


def marks(buckets: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Rows of 64-bit marks for the documents' buckets."""
    order = np.argsort(buckets, kind="stable")
    buckets, keys = buckets[order], keys[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    if len(keys):
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            yield int(buckets[a]), MARK, 0, b"", keys[a:b].tobytes()


def row_packs(rows: DataFrame, buckets: int, key: str) -> DataFrame:
    """All rows as compressed packs, one per (task slice, bucket); rows with a null key are left out."""
    place = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            body = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = body.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            part = bucket_of(ids, buckets)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            out = []
            for at in np.split(order, cuts):
                sink = pa.BufferOutputStream()
                chunk = body.take(pa.array(at))
                with pa.ipc.new_stream(sink, chunk.schema) as stream:
                    stream.write_batch(chunk)
                out.append((int(part[at[0]]), TEXT, 0, ids[at].tobytes(), squeeze.compress(sink.getvalue().to_pybytes())))
            return batch(out)

        for b in batches:
            step = max(1, int(len(b) * 8_000_000 / max(1, b.nbytes)))
            for at in range(0, len(b), step):
                held.append(b.slice(at, step))
                size += int(held[-1].nbytes)
                if size >= 16_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.where(F.col(key).isNotNull()).mapInArrow(run, SCHEMA)


def open_pack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.decompress(body, max_output_size=2**31 - 1)) as source:
        return source.read_next_batch()


def by_range(rows: DataFrame, reduce: Callable, width: int = 8) -> DataFrame:
    """Bring the entries of each range together and hand them to `reduce(range, hashes, ids)`.

    Ranges are even shares of the hash space; a value that fills one has been
    thinned to one entry per task slice before. Other rows pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hashes, ids = None, [], []

        def finish():
            return list(reduce(part, np.concatenate(hashes), np.concatenate(ids))) if hashes else []

        for b in batches:
            passed = b.filter(pa.array(b.column(1).to_numpy() != ENTRY))
            if len(passed):
                yield passed
            for row in b.filter(pa.array(b.column(1).to_numpy() == ENTRY)).to_pylist():
                if row["part"] != part:
                    if out := finish():
                        yield batch(out)
                    part, hashes, ids = row["part"], [], []
                hashes.append(np.frombuffer(row["keys"], np.uint64 if width == 8 else np.uint32))
                ids.append(unpack_ids(row["base"], row["ids"], len(hashes[-1])))
        if out := finish():
            yield batch(out)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, SCHEMA)


def by_bucket(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Bring each bucket's marks and rows together: `work(sorted marks, ids, rows)` yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys = None, []
        known = np.zeros(0, np.uint64)
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != part:
                    part, keys, known = row["part"], [], None
                if row["kind"] == MARK:
                    keys.append(np.frombuffer(row["keys"], np.uint64))
                    continue
                if known is None:
                    known = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                yield from work(known, np.frombuffer(row["ids"], np.int64), open_pack(row["keys"]))

    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, schema)


def by_bucket_packed(rows: DataFrame, values: Callable, packed: Callable, schema: str, most: int) -> DataFrame:
    """Like `by_bucket`, for work that sends entries on: `values(sorted marks, ids, rows)` yields (hashes, ids) arrays,
    which are held over packs and buckets until there are `most`, and go out as the rows `packed(hashes, ids)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, known = None, [], None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != part:
                    part, keys, known = row["part"], [], None
                if row["kind"] == MARK:
                    keys.append(np.frombuffer(row["keys"], np.uint64))
                    continue
                if known is None:
                    known = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                for found in values(known, np.frombuffer(row["ids"], np.int64), open_pack(row["keys"])):
                    held.append(found)
                    size += len(found[0])
                    if size >= most:
                        yield batch(list(packed(*map(np.concatenate, zip(*held)))))
                        held, size = [], 0
        if held:
            yield batch(list(packed(*map(np.concatenate, zip(*held)))))

    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, schema)


def holds(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are among the sorted known ones."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
