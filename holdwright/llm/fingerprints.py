"""Document fingerprints: SimHash votes, and block tables that find all within a radius.

Every word votes with its 64-bit hash: a set bit counts the word's weight for it. Bit
j and bit j + 32 are counted in the two halves of one long, so a fingerprint takes
32 plain sums; a weight never exceeds the word's bytes, so a half cannot overflow. A bit is set
when more than half of all weight voted for it. Words of up to three letters weigh
1, longer ones their letters up to 15, so that function words do not decide.

Two fingerprints within radius r agree on at least b - r of b blocks. One table for
each choice of b - r blocks, keyed by their bits, therefore meets every such pair.
b grows with the number of fingerprints, so that a key stays rare.

Null text counts as empty; texts without words have the fingerprint zero, and equal
texts have equal fingerprints. Rows that share a doc_id are ordered by text; rows
with a null doc_id have no place in the order and are left out. All of it is column
expressions, joins and sums.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdwright.llm.tables import stored

BITS = 64
HALVES = (1 << 32) + 1
LOW = (1 << 32) - 1
ROWS_PER_BLOCK = 512
SEPARATORS = "[\\x20\\x09-\\x0D]+"


def vote_sums(word: Column) -> tuple[list[Column], list[Column]]:
    """Aggregates over the words of a text (32 double counters and the whole weight), and the columns they read."""
    h = F.xxhash64(word)
    size = F.length(word)
    weight = F.when(size <= 3, F.lit(1).cast("long")).otherwise(F.least(size, F.lit(15)).cast("long"))
    weight = F.when(word == "", F.lit(0).cast("long")).otherwise(weight)
    return [
        *[F.sum(F.shiftrightunsigned(F.col("h"), j).bitwiseAND(F.lit(HALVES)) * F.col("weight")).alias(f"votes_{j}") for j in range(32)],
        F.sum("weight").alias("weights"),
    ], [h.alias("h"), weight.alias("weight")]


def decide() -> Column:
    """Fingerprint as a long from the sums."""
    out = F.lit(0).cast("long")
    for j in range(32):
        votes = F.col(f"votes_{j}")
        for count, bit in ((votes.bitwiseAND(F.lit(LOW)), j), (F.shiftrightunsigned(votes, 32), j + 32)):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(count * 2 > F.col("weights"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprint(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, value) for every row; the keys must tell the rows apart."""
    sums, columns = vote_sums(F.col("word"))
    words = texts.select(*keys, F.explode(F.split(text, SEPARATORS)).alias("word")).select(*keys, *columns)
    return words.groupBy(*keys).agg(*sums).select(*keys, decide().alias("value"))


def shown(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in descending key order with their place and the text of the next row (the first one's after the last).

    Places are (block, number) with blocks of consecutive keys, so no task orders more
    than a block; only one row per block, without text, is ordered globally.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).where("id is not null")
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    step = max(1.0, ((high or 0) - (low or 0) + 1) * ROWS_PER_BLOCK / max(1, n))
    place = F.floor((F.lit(high or 0) - F.col("id")) / F.lit(step)).cast("long")
    inside = Window.partitionBy("block").orderBy(F.desc("id"), F.desc("body"))
    numbered = rows.withColumn("block", place).select("*", F.row_number().over(inside).alias("number"), F.lead("body").over(inside).alias("following"))
    blocks = rows.groupBy(place.alias("block")).agg(F.max("id").alias("first_id"))
    order = Window.orderBy("block")
    heads = blocks.select("block", F.coalesce(F.lead("block").over(order), F.lit(0).cast("long")).alias("next_block"))
    first_ids = blocks.select(F.col("block").alias("next_block"), F.col("first_id").alias("id"))
    first_texts = rows.join(first_ids, "id").groupBy("next_block").agg(F.max("body").alias("next_head"))
    joined = numbered.join(heads.join(first_texts, "next_block"), "block")
    last = F.col("following").isNull()
    return joined.select(
        "id", "block", "number", "body",
        F.when(last, F.col("next_head")).otherwise(F.col("following")).alias("next_body"),
        F.when(last, F.col("next_block")).otherwise(F.col("block")).alias("next_block"),
        F.when(last, F.lit(1)).otherwise(F.col("number") + 1).alias("next_number"),
    )


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses.

    The edited form keeps the first half; the other floor(n / 2) code points are
    replaced by the first as many of the next document.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, key, text).withColumn("n_chars", F.length("body").cast("long"))
    kept = F.substring("body", F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumn("edited", F.concat(kept, F.substring("next_body", F.lit(1), half)))
    about = ["id", "block", "number", "next_block", "next_number", "n_chars"]
    both = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("body").alias("t")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("t"))))
    texts = rows.select(*about, F.sha2("edited", 256).alias("edited_sha256"), both.alias("f")).select(*about, "edited_sha256", "f.form", "f.t")
    values = fingerprint(texts, [*about, "edited_sha256", "form"], "t")
    flat = stored(values)
    own = flat.where("form = 0").select(*about, F.col("value").alias("own"))
    edited = flat.where("form = 1").select("block", "number", "edited_sha256", F.col("value").alias("changed"))
    following = own.select(F.col("block").alias("next_block"), F.col("number").alias("next_number"), F.col("own").alias("next_own"))
    out = own.join(edited, ["block", "number"]).join(following, ["next_block", "next_number"])
    return out.select(
        F.col("id").alias(key),
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.col("own").alias("value"),
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of all choices of blocks - radius blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in signed]


def blocks_for(count: int, radius: int) -> int:
    """Fewest blocks whose keys are expected to hold at most a few of `count` values."""
    blocks = radius + 1
    while blocks < 4 * radius and count > 4 * 2.0 ** (BITS * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, value: str = "value") -> DataFrame:
    """(query value, found value, distance) for all distinct values within the radius, the same value included."""
    asked = queries.select(F.col(value).alias("asked")).where("asked is not null").distinct()
    there = index.select(F.col(value).alias("found")).where("found is not null").distinct()
    masks = block_masks(radius, blocks_for(there.count(), radius))

    def keyed(side: DataFrame, column: str) -> DataFrame:
        keys = F.posexplode(F.array(*[F.col(column).bitwiseAND(F.lit(m).cast("long")) for m in masks]))
        return side.select(column, keys.alias("table", "key"))

    distance = F.bit_count(F.col("asked").bitwiseXOR(F.col("found")))
    pairs = keyed(asked, "asked").join(keyed(there, "found"), ["table", "key"]).where(distance <= radius)
    return pairs.select("asked", "found", distance.alias("distance")).distinct()


def near_counts(marked: DataFrame, queries: Column, radius: int = 3) -> DataFrame:
    """The rows with `n_near`: for each query row the number of other rows whose fingerprint lies within the radius."""
    own = stored(marked)
    sizes = own.groupBy(F.col("value").alias("found")).agg(F.count("*").alias("rows"))
    pairs = within_radius(own.where(queries), own, radius)
    found = pairs.join(sizes, "found").groupBy(F.col("asked").alias("value")).agg((F.sum("rows") - 1).alias("near_rows"))
    out = own.join(found, "value", "left")
    return out.withColumn("n_near", F.when(queries, F.col("near_rows"))).drop("value", "near_rows")
