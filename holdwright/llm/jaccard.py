"""N-gram Jaccard self-join on a token-group matrix.

A document's set holds its distinct 5-word shingles (lower-cased A-Z); with fewer
words the whole sequence is the one shingle, and a document without words has an
empty set and no links. Two documents link when the Jaccard similarity reaches the threshold.

1. Equal sets are one class; one document stands for it.
2. A document whose shingles hardly occur elsewhere links with nothing. Of each set the lowest
   shingles by hash are looked at (a prefix); two linked sets must share a known part of it
   (see `prefix_rule`), so classes with fewer shared prefix shingles are done.
3. The rest is partitioned into groups of similar documents: classes with an equal least
   shingle under one of several hash orders are compared with one of theirs, and
   connected groups of verified links form the rows of the matrix.
4. The matrix holds each group's union of shingles. A group whose union shares
   too few shingles with all others to hold the overlap that its smallest
   document needs stays closed.
5. Documents of open groups ask the matrix: a rarest-first prefix names the groups
   to ask, the overlap of document and union bounds the similarity with every member, and only
   members of groups that pass are compared.

No step loses a link between different groups, and documents of one group need no
further link, so the components are exact. Null text counts as empty. Rows with equal
doc_id are one vertex; rows with a null doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.llm import blocks
from holdwright.llm.components import components
from holdwright.llm.kernels import PRIME, bucket_of, grams, list_slices, mix, slices, strings, words_of
from holdwright.llm.tables import noted, removed, stored, text_buckets
from holdwright.operators.skew import skewed_lookup

ORDERS = 8
MOST_NUMBERS = 4_000
NONE = -1


def shingle_sets(piece: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the first of each text."""
    words = words_of(piece, lower=True)
    hashes = words.hashes()
    counts = words.counts
    whole = grams(hashes, size)
    owner = words.document()
    at = np.arange(len(owner))
    at = at[at + size <= np.repeat(words.first[1:], counts)]
    values, of = [whole[at]], [owner[at]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        values.append(grams(hashes[words.first[d] : words.first[d + 1]], int(counts[d])))
        of.append(np.array([d]))
    value, of = np.concatenate(values), np.concatenate(of)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(len(piece) + 1))


def class_keys(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    out = []
    for seed in (1, 2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(seed * int(PRIME) % 2**64)), dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_rule(percent: int) -> tuple[float, float]:
    """(share of a set to look at, share of the set that a linked one must have in common there).

    Sets of n and m that link have at least a = t / (1 + t) of n + m in common, with
    t n <= m <= n / t. Looking at a share f leaves n - f n out, so at least a (n + m) - (1 - f) n of the
    common ones are in the prefix of n, and likewise for m; the common ones lowest by hash are in both.
    """
    t = percent / 100
    f = min(1.0, 1.5 * (1 - t))
    a = t / (1 + t)
    sizes = (t, 1 / t)
    return f, min(min(a * (1 + m) - (1 - f), a * (1 + m) - (1 - f) * m) for m in sizes)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")


def summaries(source: DataFrame, size: int) -> DataFrame:
    """(id, n, class key 1, class key 2) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, piece in slices(strings(b.column(1))):
                values, first = shingle_sets(piece, size)
                c1, c2 = class_keys(values, first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), pa.array(np.diff(first)), pa.array(c1), pa.array(c2)], names=["id", "n", "c1", "c2"])

    return source.mapInArrow(run, "id bigint, n bigint, c1 bigint, c2 bigint")


def told(ids: np.ndarray, times: np.ndarray, parts: int) -> Iterator[tuple]:
    """Packed (id, times) rows, one for each part of the ids."""
    part = bucket_of(ids, parts)
    order = np.argsort(part, kind="stable")
    if len(order):
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            yield int(part[at[0]]), blocks.MARK, 0, ids[at].tobytes(), times[at].astype(np.int64).tobytes()


def shared_counts(source: DataFrame, size: int, share: float, parts: int) -> DataFrame:
    """(id, shared): prefix shingles that another class has in its prefix as well.

    A class sends its shingles once per task. Shingles that several classes of one
    slice have are told at once, and one entry without an owner goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size_now = [], 0

        def flush():
            hashes, ids = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(hashes, kind="stable")
            hashes, ids = hashes[order], ids[order]
            head = np.ones(len(hashes), bool)
            head[1:] = hashes[1:] != hashes[:-1]
            several = ~head
            several[:-1] |= ~head[1:]
            rows = []
            if several.any():
                who, times = np.unique(ids[several], return_counts=True)
                rows.extend(told(who, times, parts))
            ids = np.where(several, NONE, ids)
            return blocks.batch([*rows, *blocks.entries(hashes[head], ids[head], width=4)])

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, piece in slices(strings(b.column(1))):
                values, first = shingle_sets(piece, size)
                counts = np.diff(first)
                classes = class_keys(values, first)[0]
                new = np.zeros(len(piece), bool)
                for d, c in enumerate(classes.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[d] = True
                take = np.where(new, np.ceil(counts * share).astype(np.int64), 0)
                owner = np.repeat(np.arange(len(piece)), counts)
                inside = np.arange(len(values)) - np.repeat(first[:-1], counts) < take[owner]
                held.append((values[inside], keys[at + owner[inside]]))
                size_now += int(inside.sum())
                if size_now >= blocks.SLICE_ENTRIES:
                    yield flush()
                    held, size_now = [], 0
        if size_now:
            yield flush()

    def reduce(part: int, hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        same = hashes[1:] == hashes[:-1]
        several = np.zeros(len(hashes), bool)
        several[1:] |= same
        several[:-1] |= same
        owners = ids[several]
        if len(owners := owners[owners != NONE]):
            yield from told(*np.unique(owners, return_counts=True), parts)

    return _counted(blocks.by_range(source.mapInArrow(run, blocks.SCHEMA), reduce, width=4))


def _counted(rows: DataFrame) -> DataFrame:
    """(id, shared): the sums of the packed (id, times) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            ids = np.concatenate([who, np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64)])
            times = np.concatenate([sums, np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64)])
            who, back = np.unique(ids, return_inverse=True)
            sums = np.bincount(back, times, len(who)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(sums)], names=["id", "shared"])

    return rows.repartition("part").mapInArrow(run, "id bigint, shared bigint")


def sets_of(source: DataFrame, wanted: DataFrame, size: int, buckets: int) -> DataFrame:
    """(id, n, tokens) of the wanted documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield blocks.batch(list(blocks.marks(bucket_of(ids, buckets), mix(ids.view(np.uint64)))))

    def work(known: np.ndarray, ids: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = blocks.holds(known, mix(ids.view(np.uint64)))
        texts = strings(rows.column(1)).filter(pa.array(asked))
        ids = ids[asked]
        for at, piece in slices(texts):
            values, first = shingle_sets(piece, size)
            tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(piece)]), pa.array(np.diff(first)), tokens], names=["id", "n", "tokens"])

    asks = wanted.select("id").mapInArrow(ask, blocks.SCHEMA)
    return blocks.by_bucket(asks.unionByName(blocks.row_packs(source, buckets, "id")), work, "id bigint, n bigint, tokens array<bigint>")


def _linked(percent: int) -> Column:
    common = F.size(F.array_intersect("tokens", "other_tokens"))
    return F.lit(100) * common >= F.lit(percent) * (F.col("n") + F.col("other_n") - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (id, other) pairs whose sets link."""
    others = sets.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("tokens").alias("other_tokens"))
    fits = (F.lit(100) * F.least("n", "other_n")) >= F.lit(percent) * F.greatest("n", "other_n")
    return pairs.join(sets, "id").join(others, "other").where(fits & _linked(percent)).select("id", "other")


def least_shingles(sets: DataFrame) -> DataFrame:
    """(id, keys): the least shingle of each set under every hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, tokens, first in list_slices(b, 1):
                keys = np.stack([np.minimum.reduceat(mix(tokens ^ np.uint64(j * int(PRIME) % 2**64)), first[:-1]) for j in range(ORDERS)], 1)
                column = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), ORDERS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), column], names=["id", "keys"])

    return sets.select("id", "tokens").mapInArrow(run, "id bigint, keys array<bigint>")


def similar_groups(sets: DataFrame, central: DataFrame, percent: int) -> DataFrame:
    """(id, group) of every set: connected stars of verified links.

    `central` has the share of a set that other classes have too. The document with the
    largest share stands in the middle: of a family of edited copies that is the one with the
    fewest edits, which links with whatever links at all. Equal ones take turns by order.
    """
    keyed = least_shingles(sets).join(central, "id").select("id", "central", F.posexplode("keys").alias("order", "key"))
    middle = F.max_by("id", F.struct("central", F.xxhash64("order", "id"))).alias("other")
    pivots = keyed.groupBy("order", "key").agg(middle, F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("least", "last")
    pairs = skewed_lookup(keyed, pivots, ["order", "key"], ["id"]).where("other is not null and other <> id").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    links = stored(verified(pairs, sets, percent))
    groups = components(links, "id", "other")
    return sets.select("id").distinct().join(groups, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("component", "id").alias("group"))


def open_groups(labelled: DataFrame, percent: int, parts: int) -> DataFrame:
    """Groups whose union shares enough shingles with other groups to hold a link of their smallest set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            hashes, groups = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((groups, hashes))
            hashes, groups = hashes[order], groups[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (groups[1:] != groups[:-1])
            return blocks.batch(list(blocks.entries(hashes[fresh], groups[fresh])))

        for b in batches:
            for piece, tokens, first in list_slices(b, 1):
                held.append((tokens, np.repeat(piece.column(0).to_numpy(zero_copy_only=False), np.diff(first))))
                size += len(tokens)
                if size >= blocks.SLICE_ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def reduce(part: int, hashes: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((groups, hashes))
        hashes, groups = hashes[order], groups[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (groups[1:] != groups[:-1])
        hashes, groups = hashes[fresh], groups[fresh]
        same = hashes[1:] == hashes[:-1]
        several = np.zeros(len(hashes), bool)
        several[1:] |= same
        several[:-1] |= same
        if several.any():
            who, times = np.unique(groups[several], return_counts=True)
            yield from told(who, times, parts)

    shared = _counted(blocks.by_range(labelled.select("group", "tokens").mapInArrow(run, blocks.SCHEMA), reduce))
    needs = labelled.groupBy("group").agg(F.min("n").alias("least"))
    return shared.join(needs, F.col("id") == F.col("group")).where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("least")).select("group")


def may_hold(fits: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The (id, asked) pairs whose union may hold the overlap that the document needs.

    A pair is one row with the document's shingles as 32-bit numbers, not a row for each shingle. What is missing from the union is
    counted by distinct numbers, so shingles with equal numbers only make the bound higher, and no pair is lost. A union of
    more than MOST_NUMBERS shingles is no row: it is asked shingle by shingle.
    """
    union = stored(shared.select("token", F.col("group").alias("asked")).distinct())
    sizes = union.groupBy("asked").agg(F.count("*").alias("numbers_of_union"))
    sized = stored(fits.join(sizes, "asked"))
    is_small = F.col("numbers_of_union") <= MOST_NUMBERS
    short = F.hash("token")
    own = shared.groupBy("id").agg(F.count("*").alias("known"), F.collect_set(short).alias("numbers"))
    whole = union.join(sizes.where(is_small).select("asked"), "asked").groupBy("asked").agg(F.collect_set(short).alias("union"))
    met = sized.where(is_small).select("asked", "id", "n").join(own, "id").join(whole, "asked")
    missing = F.size(F.array_except("numbers", "union"))
    small = met.where(F.lit(100) * (F.col("known") - missing) >= F.lit(percent) * F.col("n")).select("id", "asked")
    asks = sized.where(~is_small).select("id", "asked", "n").join(shared.select("id", "token"), "id")
    overlap = asks.join(union, ["token", "asked"]).groupBy("id", "asked", "n").agg(F.count("*").alias("common"))
    return small.unionByName(overlap.where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("n")).select("id", "asked"))


def links_between(opened: DataFrame, percent: int) -> DataFrame:
    """Verified links between documents of different open groups; `opened` has (id, group, n, tokens)."""
    spark, scratch = opened.sparkSession, []
    with noted(scratch):
        tokens = stored(opened.select("id", "group", "n", F.explode("tokens").alias("token")))
        across = tokens.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("df")).where("a < b").select("token", "df")
        across = stored(across)
    shared = stored(skewed_lookup(tokens, across, ["token"], ["id"]).where("df is not null"))
    removed(spark, scratch)
    enough = shared.groupBy("id", "n").agg(F.count("*").alias("known")).where(F.lit(100) * F.col("known") >= F.lit(percent) * F.col("n"))
    need = F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
    # shingles of no other group come first in the order and match nothing
    room = F.col("n") - need + 1 - (F.col("n") - F.col("known"))
    ranked = shared.join(enough.select("id", "known"), "id").groupBy("id", "group", "n", "known").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    prefix = ranked.select("id", "group", "n", "known", F.explode(F.slice("order", F.lit(1), room.cast("int"))).alias("t"))
    prefix = stored(prefix.select("id", "group", "n", "known", F.col("t.token").alias("token")))
    least = opened.groupBy(F.col("group").alias("asked")).agg(F.min("n").alias("least"))
    matrix = prefix.select("token", F.col("group").alias("asked")).distinct().join(least, "asked")
    # what a document shares with other groups must hold the overlap that the group's smallest possible partner needs
    smallest = F.greatest(F.col("least").cast("double"), F.col("n") * (percent / 100))
    holds = F.col("known") * (100 + percent) + 1e-6 >= F.lit(percent) * (F.col("n") + smallest)
    fits = stored(prefix.join(matrix, "token").where((F.col("group") != F.col("asked")) & holds).select("id", "asked", "n").distinct())
    removed(spark, [])
    asking = stored(may_hold(fits, shared, percent))
    removed(spark, [])
    members = opened.select(F.col("group").alias("asked"), F.col("id").alias("other"))
    pairs = asking.join(members, "asked").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    return verified(pairs, opened.select("id", "n", "tokens"), percent)


def link_components(docs: DataFrame, percent: int = 75, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every document; the component is its smallest reachable key."""
    source = _documents(docs, key, text)
    share, least = prefix_rule(percent)
    about = stored(summaries(source, size))
    buckets = text_buckets(docs, text)
    parts = max(16, buckets // 4)
    counted = shared_counts(source, size, share, parts)
    classes = stored(about.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep")))
    keep = skewed_lookup(about.where("n > 0"), counted.select(F.col("id").alias("id"), "shared"), ["id"], ["id"]).where(F.col("shared") >= F.greatest(F.lit(1.0), F.floor(F.col("n") * least + 1e-6)))
    shares = keep.groupBy("c1", "c2").agg(F.max(F.col("shared") / F.col("n")).alias("central"))
    wanted = stored(shares.join(classes, ["c1", "c2"]).groupBy(F.col("rep").alias("id")).agg(F.max("central").alias("central")))
    # what only one step reads goes behind it, so that texts, sets and candidate pairs never lie on the disks together
    spark, scratch = docs.sparkSession, []
    removed(spark, [])
    with noted(scratch):
        sets = stored(sets_of(source, wanted, size, buckets))
    removed(spark, [])
    groups = stored(similar_groups(sets, wanted, percent))
    removed(spark, [])
    with noted(scratch):
        labelled = sets.join(groups, "id")
        opened = stored(labelled.join(open_groups(labelled, percent, parts), "group", "left_semi"))
        removed(spark, [])
        links = None if opened.isEmpty() else links_between(opened, percent)
    between = None if links is None else stored(links)
    removed(spark, scratch)
    label = groups.select(F.col("id").alias("rep"), F.col("group").alias("component"))
    if between is not None and not between.isEmpty():
        of = groups.select("id", "group")
        other = of.select(F.col("id").alias("other"), F.col("group").alias("other_group"))
        joined = components(between.join(of, "id").join(other, "other"), "group", "other_group").select(F.col("vertex").alias("component"), F.col("component").alias("whole"))
        label = label.join(joined, "component", "left").select("rep", F.coalesce("whole", "component").alias("component"))
    found = stored(classes.join(label, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")))
    out = skewed_lookup(about, found, ["c1", "c2"], ["id"])
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key is the smallest of their component, all columns as they were; rows with a null key are in no component and stay."""
    drop = stored(link_components(docs, percent, size, key, text).where(F.col(key) != F.col("component_id")).select(F.col(key).cast("long").alias("id")).distinct())
    buckets = text_buckets(docs, text)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield blocks.batch(list(blocks.marks(bucket_of(ids, buckets), mix(ids.view(np.uint64)))))

    def work(known: np.ndarray, ids: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield rows.filter(pa.array(~blocks.holds(known, mix(ids.view(np.uint64)))))

    marks = drop.mapInArrow(ask, blocks.SCHEMA)
    left = blocks.by_bucket(marks.unionByName(blocks.row_packs(docs, buckets, key)), work, docs.schema)
    return left.unionByName(docs.where(F.col(key).isNull()))
