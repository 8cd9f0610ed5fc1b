"""Substring dedup by window hashes, in place of a relative Lempel-Ziv parse.

A word goes when a window of 13 words around it occurs in a document with a smaller id. That
is decided by a join of window hashes in blocks (ranges of the hash space): first of sampled anchors, the least
5-gram of each window's words, which cuts the work to passages that occur
elsewhere; then of the window hashes around shared anchors, each with the smallest
document that has it. No document is factored against a reference: there is no longest match and no
position in a reference. Runs of repeated windows are put together from the flags afterwards.

Two equal windows have equal least anchors, so the sampling loses none.

Null text has no words. Rows that share a doc_id are parsed each by itself: they are
no reference for each other. Extra columns are ignored; rows with a null doc_id
have no place in the order and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdwright.llm import blocks
from holdwright.llm.kernels import PRIME, Words, bucket_of, gram_starts, grams, mix, slices, strings, words_of
from holdwright.llm.tables import text_buckets

ANCHOR_WORDS = 5


def mark(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One key for (hash, document)."""
    return mix(hashes ^ mix(ids.astype(np.int64).view(np.uint64) * PRIME + np.uint64(1)))


def window_anchors(word_hashes: np.ndarray, window: int) -> np.ndarray:
    """Least anchor hash of the window at each position that has one in the array."""
    size = min(ANCHOR_WORDS, window)
    values = grams(word_hashes, size)
    span = window - size + 1
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = values, 1
    while done < span:  # doubling: the minimum over `done` neighbours
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out[:n]


def split_local(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, id) entries sorted so that each hash starts with its smallest id; `head` marks these."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
    hashes, ids = hashes[fresh], ids[fresh]
    head = np.ones(len(hashes), bool)
    head[1:] = hashes[1:] != hashes[:-1]
    return hashes, ids, head


def _anchor_rows(hashes: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple]:
    """An anchor with several documents here is known to be shared: they are told at once, and one entry goes on."""
    hashes, ids, head = split_local(hashes, ids)
    several = ~head
    several[:-1] |= ~head[1:]
    yield from blocks.marks(bucket_of(ids[several], buckets), mark(hashes[several], ids[several]))
    yield from blocks.entries(hashes[head], ids[head])


def _window_rows(hashes: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A window seen in a smaller document here is a repeat; only the smallest document goes on."""
    hashes, ids, head = split_local(hashes, ids)
    yield from blocks.marks(bucket_of(ids[~head], buckets), mark(hashes[~head], ids[~head]))
    yield from blocks.entries(hashes[head], ids[head])


def parse(known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of the documents as (first word, end) positions.

    `known[i]` says whether the reference has the window that starts at word i.
    From the first such word a factor takes every next window that the reference
    knows. The windows across its end have been asked as well, so the next factor
    may begin inside it; no window crosses two documents, so no factor does.
    """
    edges = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) + window - 1


def covered(firsts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a factor."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def kept_bytes(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of each document joined by one space, one after the other, and each document's end."""
    owner = words.document()
    kept = np.flatnonzero(keep)
    joined = np.zeros(len(kept), bool)
    joined[:-1] = owner[kept][1:] == owner[kept][:-1]
    steps = np.zeros(len(words.data) + 1, np.int8)
    steps[words.starts[kept]] += 1
    steps[words.ends[kept]] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    gaps = words.ends[kept[joined]]  # the separator after a kept word
    inside[gaps] = True
    data = words.data.copy()
    data[gaps] = 0x20
    lengths = np.zeros(len(words.first) - 1, np.int64)
    np.add.at(lengths, owner[kept], words.ends[kept] - words.starts[kept] + joined)
    return data[inside].tobytes(), np.cumsum(lengths)


def repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Marks of every (window, document) that an earlier document has too, by bucket; and the number of buckets."""
    buckets = text_buckets(docs, text)
    most = blocks.SLICE_ENTRIES

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, piece in slices(strings(b.column(1))):
                words = words_of(piece)
                least = window_anchors(words.hashes(), window)
                starts = gram_starts(words, window)
                owner, values = words.document()[starts], least[starts]
                changed = np.ones(len(values), bool)
                changed[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                held.append((values[changed], ids[at + owner[changed]]))
                size += int(changed.sum())
                if size >= most:
                    yield blocks.batch(list(_anchor_rows(*map(np.concatenate, zip(*held)), buckets)))
                    held, size = [], 0
        if held:
            yield blocks.batch(list(_anchor_rows(*map(np.concatenate, zip(*held)), buckets)))

    def shared_anchors(part: int, hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        hashes, ids, head = split_local(hashes, ids)
        several = ~head
        several[:-1] |= ~head[1:]
        return blocks.marks(bucket_of(ids[several], buckets), mark(hashes[several], ids[several]))

    def windows(known: np.ndarray, ids: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, piece in slices(strings(rows.column(1))):
            words = words_of(piece)
            hashes = words.hashes()
            starts = gram_starts(words, window)
            owner = ids[at + words.document()[starts]]
            near = blocks.holds(known, mark(window_anchors(hashes, window)[starts], owner)) if len(starts) else np.zeros(0, bool)
            if near.any():
                yield grams(hashes, window)[starts[near]], owner[near]

    def earlier(part: int, hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        hashes, ids, head = split_local(hashes, ids)
        return blocks.marks(bucket_of(ids[~head], buckets), mark(hashes[~head], ids[~head]))

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    shared = blocks.by_range(source.mapInArrow(anchors, blocks.SCHEMA), shared_anchors)
    packed = lambda hashes, ids: _window_rows(hashes, ids, buckets)
    around = blocks.by_bucket_packed(shared.unionByName(blocks.row_packs(source, buckets, "key")), windows, packed, blocks.SCHEMA, most)
    return blocks.by_range(around, earlier), buckets


def dedup(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", output: str = "digests") -> DataFrame:
    """Remove repeated passages of `window` words and more.

    `output="texts"` returns (key, n_words, n_removed, kept text, removed spans);
    `"digests"` returns (key, n_words, n_removed, kept_sha256). A span is
    (first word, end) and covers whole windows.
    """
    full = output == "texts"
    found, buckets = repeats(docs, window, key, text)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")

    def cut(known: np.ndarray, ids: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, piece in slices(strings(rows.column(1))):
            words = words_of(piece)
            owner = words.document()
            hit = np.zeros(len(owner), bool)
            starts = gram_starts(words, window)
            if len(known) and len(starts):
                hit[starts] = blocks.holds(known, mark(grams(words.hashes(), window)[starts], ids[at + owner[starts]]))
            firsts, ends = parse(hit, window)
            gone = covered(firsts, ends, len(owner))
            body, to = kept_bytes(words, ~gone)
            kept = [body[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]
            columns = [pa.array(ids[at : at + len(piece)]), pa.array(words.counts, pa.int64()), pa.array(np.bincount(owner[gone], minlength=len(piece)), pa.int64())]
            if full:
                columns += [pa.array([k.decode() for k in kept]), _spans(gone, words)]
            else:
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_removed", *(["kept", "spans"] if full else ["kept_sha256"])])

    tail = "kept string, spans array<struct<first: bigint, end: bigint>>" if full else "kept_sha256 string"
    return blocks.by_bucket(found.unionByName(blocks.row_packs(source, buckets, "key")), cut, f"`{key}` bigint, n_words bigint, n_removed bigint, {tail}")


def _spans(gone: np.ndarray, words: Words) -> pa.Array:
    rows = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        firsts, ends = parse(gone[a:b], 1)
        rows.append([{"first": f, "end": e} for f, e in zip(firsts.tolist(), ends.tolist())])
    return pa.array(rows, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
