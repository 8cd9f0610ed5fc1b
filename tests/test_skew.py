"""Group operators against brute force, with one key holding most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from holdwright.operators import skew
from holdwright.operators.merge_views import merge_duplicate_views
from holdwright.operators.paging import page, page_of_each, top_of_each
from holdwright.operators.skew import fill_forward, held_state, ordered_positions, skewed_lookup
from holdwright.operators.versions import version_chain


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 17}", i, rng.choice([None, None, f"v{i}"])) for i in range(900)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, pos int, val string")


def test_positions_and_neighbours(skewed):
    rows, df = skewed
    got = {(r.key, r.pos): (r.position, r.previous, r.following) for r in ordered_positions(df, ["key"], F.floor(F.col("pos") / 50), ["pos"], value="pos").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        order = sorted(r[1] for r in rows if r[0] == key)
        for i, p in enumerate(order):
            want[(key, p)] = (i + 1, order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None)
    assert got == want


def test_fill_forward(skewed):
    rows, df = skewed
    got = {(r.key, r.pos): r.val_filled for r in fill_forward(df, ["key"], F.floor(F.col("pos") / 50), ["pos"], ["val"]).collect()}
    for key in {r[0] for r in rows}:
        last = None
        for _, p, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            last = v if v is not None else last
            assert got[(key, p)] == last


def test_lookup_keeps_rows_with_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "key string, id int")
    table = spark.createDataFrame([("a", 10), (None, 99)], "key string, found int")
    got = {r.id: r.found for r in skewed_lookup(rows, table, ["key"], ["id"]).collect()}
    assert got == {1: 10, 2: 10, 3: None, 4: None}


def test_hot_key_is_split_at_run_time(spark):
    """The lookup has the shape adaptive execution can split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        rows = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
        table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        out = skewed_lookup(rows, table, ["key"], ["id"])
        assert out.agg(F.sum("n")).first()[0] == (n // 3) ** 2 + (n - n // 3)
        out.write.format("noop").mode("overwrite").save()
        collected = out.select("load", "n")
        collected.collect()
        assert "skew=true" in collected._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_top_and_pages(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(7)], "key string, n int")
    assert sorted((r.key, r.n) for r in top_of_each(df, ["key"], [F.desc("n")], 2).collect()) == [("a", 5), ("a", 6), ("b", 5), ("b", 6)]
    assert sorted((r.key, r.n) for r in page_of_each(df, ["key"], [F.asc("n")], 2, 3).collect()) == [(k, n) for k in "ab" for n in (3, 4, 5)]
    assert [r.n for r in page(df.where("key = 'a'"), [F.asc("n")], 3, 3).collect()] == [6]
    plan = top_of_each(df, ["key"], [F.desc("n")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle
    with pytest.raises(ValueError):
        page(df, [F.asc("n")], 0, 3)


def test_one_current_version_per_slice(spark):
    rows = [(i, "f", "o", "2025-12-31", "l", f"2026-0{1 + i % 5}-01") for i in range(12)]
    df = spark.createDataFrame(rows, "source_file_id int, fund_code string, option_code string, reporting_period string, layout_key string, received_on string")
    out = version_chain(df, ["received_on", "source_file_id"], F.substring("received_on", 6, 2)).orderBy("version_number").collect()
    assert [r.version_number for r in out] == list(range(1, 13))
    assert [r.is_current for r in out] == [False] * 11 + [True]
    assert [r.supersedes_file_id for r in out][1:] == [r.source_file_id for r in out][:-1]


def test_two_precise_rows_are_not_merged(spark):
    rows = [("g", 1, "precise", None), ("g", 2, "precise", None), ("g", 3, "metadata", "x"), ("h", 4, "precise", None), ("h", 5, "metadata", None), ("h", 6, "metadata", "y")]
    df = spark.createDataFrame(rows, "k string, row int, view_role string, attr string")
    got = sorted((r.row, r.attr, r.is_merged) for r in merge_duplicate_views(df, ["k"], "row", ["attr"]).collect())
    assert got == [(1, None, False), (2, None, False), (3, "x", False), (4, "y", True)]


def test_state_held_over_blocks_with_resets(spark):
    """Sets, resets and silent stretches against a loop, with blocks of a few rows."""
    rng = random.Random(8)
    rows, want = [], {}
    for path in ("a", "b", "c"):
        state = {"x": None, "y": None}
        for n in range(1, 400):
            mark = rng.choice(["set", "reset", "y", "", "", "", "", ""]) if path != "c" else ""
            if mark == "set":
                state = {"x": f"{path}{n}", "y": None}
            elif mark == "reset":
                state["x"] = None
            elif mark == "y":
                state["y"] = n
            rows.append((path, n, mark))
            want[path, n] = (state["x"], state["y"])
    df = spark.createDataFrame(rows, "path string, n int, mark string").repartition(4)
    mark = F.col("mark")
    nothing = F.struct(F.lit(None).cast("string").alias("v"))
    x = F.when(mark == "set", F.struct(F.concat("path", F.col("n").cast("string")).alias("v"))).when(mark == "reset", nothing)
    y = F.when(mark == "y", F.struct(F.col("n").alias("v"))).when(mark == "set", F.struct(F.lit(None).cast("int").alias("v")))
    for size in (7, 1_000):
        got = held_state(df, ["path"], F.floor(F.col("n") / size), ["n"], {"x": x, "y": y})
        assert got.columns == ["path", "n", "mark", "x", "y"]
        assert {(r.path, r.n): (r.x, r.y) for r in got.collect()} == want


def test_blocks_of_uneven_numbers_are_even(spark):
    """Small ids beside one far away: positions are right and no block holds most rows."""
    from holdwright.operators.skew import ordered_positions, with_range_blocks

    ids = [*range(3_000), 2**60, -(2**40)]
    rows = spark.createDataFrame([("hot" if i % 3 else "other", i) for i in ids], "name string, id bigint").repartition(4)
    blocked = with_range_blocks(rows, "id", 300, "part")
    sizes = {r.part: r["count"] for r in blocked.groupBy("part").count().collect()}
    assert len(sizes) >= 9 and max(sizes.values()) < 700
    got = {(r.name, r.id): r.position for r in ordered_positions(blocked, ["name"], F.col("part"), ["id"]).collect()}
    want = {(k, i): n for k in ("hot", "other") for n, i in enumerate(sorted(i for i in ids if ("hot" if i % 3 else "other") == k), 1)}
    assert got == want
    assert with_range_blocks(rows.where("false"), "id", 300, "part").count() == 0


def test_pairs_of_frequent_keys_are_made_in_blocks(spark, monkeypatch):
    """Either side may hold the many rows of a key; every pair comes once, and no task makes most of them."""
    rows = spark.range(1500).selectExpr("CASE WHEN id < 600 THEN 'a' WHEN id < 605 THEN 'b' ELSE concat('c', id) END AS k", "id AS r")
    table = spark.range(1500).selectExpr("CASE WHEN id < 5 THEN 'a' WHEN id < 605 THEN 'b' ELSE concat('c', id) END AS k", "id AS t")
    table = table.unionByName(table.where("t >= 605").withColumn("t", F.col("t") + 10_000))
    plain = rows.join(table, "k")
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    even = skew.join_in_blocks(rows, table, ["k"])
    assert even.count() == plain.count() == 600 * 5 * 2 + 895 * 2
    assert plain.exceptAll(even).isEmpty() and even.exceptAll(plain).isEmpty()
    assert even.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10_000)
    few = skew.join_in_blocks(rows, table, ["k"])
    assert plain.exceptAll(few).isEmpty() and few.exceptAll(plain).isEmpty()
