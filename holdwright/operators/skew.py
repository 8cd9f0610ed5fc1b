"""Group operators that stay parallel when one key holds a third of all rows.

A plain window sorts a whole group in one task. The operators here work on
blocks of a group, reduce each block to one summary row, order only the
summaries, and hand the result back to the rows of the block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdwright.session import written_once

NO_MATCH = "\u0000"
ROWS_PER_TASK = 500_000


def dealt(count: int, keys: Sequence[str], *tables: DataFrame, rows_per_task: int | None = None) -> tuple[DataFrame, ...]:
    """Tables dealt by the same keys to as many tasks as `count` rows need, so that a task's memory does not grow with the input.

    The planner's own exchanges are merged again up to a number of compressed bytes, which may be many rows. Where
    the rows need no more tasks than there are cores, the tables are left to the planner.
    """
    tasks = -(-count // (rows_per_task or ROWS_PER_TASK))
    if tasks <= tables[0].sparkSession.sparkContext.defaultParallelism:
        return tables
    return tuple(t.repartition(tasks, *keys) for t in tables)


def join_key(keys: Sequence[str], spread: Sequence[str] | None = None) -> Column:
    """One string key for several columns.

    With `spread`, rows that have a NULL key get distinct keys that match
    nothing, so they do not all meet in one partition.
    """
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    if spread is None:
        return F.when(complete, key)
    filler = F.concat(F.lit(NO_MATCH), F.pmod(F.xxhash64(*spread), F.lit(100_000)).cast("string"))
    return F.when(complete, key).otherwise(filler)


def skewed_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key, safe when one key dominates.

    Both sides meet on a derived key, so each has an exchange of its own right
    below the join. That is the shape in which adaptive execution splits an
    oversized partition of the row side, or broadcasts the table if its
    measured size allows.
    """
    left = rows.withColumn("lookup_key", join_key(keys, spread))
    right = table.withColumn("table_key", join_key(keys)).drop(*keys).where(F.col("table_key").isNotNull())
    return left.join(right, F.col("lookup_key") == F.col("table_key"), "left").drop("lookup_key", "table_key")


def join_in_blocks(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two tables that may both hold many rows of a key, in tasks of bounded output.

    Planned exchanges go by the bytes that come in, and a few MB may stand for many times as many pairs; so the pairs are
    counted first. Those of a frequent key are made in blocks of its larger side, each against all rows of the smaller one.
    """
    rows, table = written_once(rows), written_once(table)
    n, m = (t.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for t, c in ((rows, "n"), (table, "m")))
    sizes = written_once(n.join(m, list(keys)).select(*keys, (F.col("n") * F.col("m")).alias("pairs"), (F.col("n") >= F.col("m")).alias("by_rows")))
    tasks = -(-(sizes.agg(F.sum("pairs")).first()[0] or 0) // ROWS_PER_TASK)
    if tasks <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows.join(table, list(keys))
    blocks = sizes.where(F.col("pairs") > ROWS_PER_TASK).select(*keys, "by_rows", F.ceil(F.col("pairs") / ROWS_PER_TASK).cast("int").alias("blocks"))

    def placed(side: DataFrame, is_cut: Column) -> DataFrame:
        cut = F.array(F.pmod(F.xxhash64(*[c for c in side.columns if c not in keys]), F.col("blocks")).cast("int"))
        places = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(is_cut, cut).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        return side.join(blocks, list(keys), "left").select(*side.columns, F.explode(places).alias("key_block")).repartition(tasks, *keys, "key_block")

    return placed(rows, F.col("by_rows")).join(placed(table, ~F.col("by_rows")), [*keys, "key_block"]).drop("key_block")


def with_range_blocks(df: DataFrame, by: str, rows_per_block: int, name: str) -> DataFrame:
    """Rows numbered by ranges of a column that hold about equal shares of the rows.

    The ranges come from the sample that Spark takes for a range partitioning, so uneven values (small numbers beside
    64-bit hashes) still give even blocks; equal values share a block. The numbers are written with the rows, since a sample taken
    again may cut elsewhere.
    """
    df = written_once(df)
    blocks = max(1, -(-df.count() // rows_per_block))
    return written_once(df.repartitionByRange(blocks, by).withColumn(name, F.spark_partition_id()))


def ordered_positions(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: str | None = None
) -> DataFrame:
    """Row number in each group, and the values of the neighbouring rows.

    `block` must never decrease along `order`. Adds `position`, and with
    `value` also `previous` and `following`.
    """
    blocked = df.withColumn("block", block)
    local = Window.partitionBy(*keys, "block").orderBy(*order)
    out = blocked.withColumn("local_position", F.row_number().over(local))
    place = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("block_rows")]
    if value:
        out = out.withColumn("local_previous", F.lag(value).over(local)).withColumn("local_following", F.lead(value).over(local))
        aggs += [F.min_by(value, place).alias("first_value"), F.max_by(value, place).alias("last_value")]
    blocks = blocked.groupBy(*keys, "block").agg(*aggs)
    chain = Window.partitionBy(*keys).orderBy("block")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("block_rows").over(before), F.lit(0)))
    if value:
        blocks = blocks.withColumn("carry_in", F.lag("last_value").over(chain)).withColumn("carry_out", F.lead("first_value").over(chain))
    carried = ["offset", *(["carry_in", "carry_out"] if value else [])]
    right = blocks.select(*[F.col(k).alias(f"right_{k}") for k in (*keys, "block")], *carried)
    on = F.lit(True)
    for k in (*keys, "block"):
        on = on & out[k].eqNullSafe(right[f"right_{k}"])
    out = out.join(right, on, "inner").withColumn("position", F.col("offset") + F.col("local_position"))
    if value:
        out = out.withColumn("previous", F.coalesce("local_previous", "carry_in"))
        out = out.withColumn("following", F.coalesce("local_following", "carry_out"))
    drop = ["block", "local_position", "local_previous", "local_following", *carried, *[f"right_{k}" for k in (*keys, "block")]]
    return out.drop(*drop)


def fill_forward(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], columns: Sequence[str], suffix: str = "_filled"
) -> DataFrame:
    """Latest non-null value of each column at or before every row of its group."""
    blocked = df.withColumn("block", block)
    local = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked
    for c in columns:
        out = out.withColumn(f"{c}{suffix}", F.last(c, ignorenulls=True).over(local))
    place = F.struct(*order)
    blocks = blocked.groupBy(*keys, "block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"{c}_last") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    right = blocks.select(
        *[F.col(k).alias(f"right_{k}") for k in (*keys, "block")],
        *[F.last(f"{c}_last", ignorenulls=True).over(before).alias(f"{c}_carry") for c in columns],
    )
    on = F.lit(True)
    for k in (*keys, "block"):
        on = on & out[k].eqNullSafe(right[f"right_{k}"])
    out = out.join(right, on, "inner")
    for c in columns:
        out = out.withColumn(f"{c}{suffix}", F.coalesce(f"{c}{suffix}", f"{c}_carry"))
    return out.drop("block", *[f"{c}_carry" for c in columns], *[f"right_{k}" for k in (*keys, "block")])


def held_state(
    df: DataFrame, keys: Sequence[str], block: Column | str, order: Sequence[str], events: Mapping[str, Column], one_block: bool = False,
    seen: Mapping[str, tuple[str, Column, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """State in force at every row, one column for each kind of event.

    An event is a struct with the field `v`: it sets the state to v (NULL resets it), and the state holds
    until the next one; rows that are no event have NULL. What the rows of a block do to the state before
    them is a function of a simple kind, a constant or the identity, so a block is summarised by
    its last event of each kind; these functions are composed over the summaries of a group alone,
    and the state each block begins with goes back to its rows. `block` must never decrease along `order`;
    key columns must not be NULL. A block named as the column `scan_block` stays, so that rows dealt by it need not move for the next scan.
    Where every group is `one_block`, nothing is carried, so the rows are made and read once.

    `seen` adds flags, as (state, condition on a row, test of the state's value): whether a row so far fulfilled both. Rows
    before the first event of their block are told by the state that the block begins with.
    """
    seen = seen or {}
    kinds = {name: f"event_{name}" for name in events}
    stays = isinstance(block, str)
    blocked = (df if stays else df.withColumn("scan_block", block)).withColumns({kinds[n]: e for n, e in events.items()})
    local = Window.partitionBy(*keys, "scan_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = blocked.withColumns({c: F.last(c, ignorenulls=True).over(local) for c in kinds.values()})
    known = {n: F.col(kinds[s]).isNotNull() for n, (s, _, _) in seen.items()}
    yes = lambda c: F.coalesce(c, F.lit(False))
    sure = {f"sure_{n}": known[n] & yes(row & test(F.col(kinds[s])["v"])) for n, (s, row, test) in seen.items()}
    open_ = {f"open_{n}": ~known[n] & yes(row) for n, (_, row, _) in seen.items()}
    within = within.withColumns(sure | open_) if seen else within
    place = F.struct(*order)
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in kinds.values()] if not one_block else []
    ends = within.groupBy(*keys, "scan_block").agg(*lasts, *[F.max(c).alias(c) for c in (*sure, *open_)]) if lasts else None
    within = within.withColumns({c: F.max(c).over(local) for c in (*sure, *open_)}) if seen else within
    if one_block:
        state = within.withColumns({n: F.col(c)["v"] for n, c in kinds.items()}).withColumns({n: F.col(f"sure_{n}") for n in seen})
        return state.drop(*([] if stays else ["scan_block"]), *kinds.values(), *sure, *open_)
    before = Window.partitionBy(*keys).orderBy("scan_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({f"carried_{c}": F.last(c, ignorenulls=True).over(before) for c in kinds.values()})
    begins = lambda n: yes(seen[n][2](F.col(f"carried_{kinds[seen[n][0]]}")["v"]))
    told = [F.coalesce(F.max(F.col(f"sure_{n}") | (F.col(f"open_{n}") & begins(n))).over(before), F.lit(False)).alias(f"carried_seen_{n}") for n in seen]
    carried = carried.select(*keys, "scan_block", *[f"carried_{c}" for c in kinds.values()], *told)
    joined = within.join(carried, [*keys, "scan_block"], "left")
    joined = joined.withColumns({n: F.col(f"carried_seen_{n}") | F.col(f"sure_{n}") | (F.col(f"open_{n}") & begins(n)) for n in seen}) if seen else joined
    state = joined.withColumns({n: F.coalesce(c, f"carried_{c}")["v"] for n, c in kinds.items()}).drop(*sure, *open_, *[f"carried_seen_{n}" for n in seen])
    return state.drop(*([] if stays else ["scan_block"]), *kinds.values(), *[f"carried_{c}" for c in kinds.values()])
