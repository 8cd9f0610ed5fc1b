"""The registered queries and read models as a whole."""

from __future__ import annotations

import pathlib

import __spark_entry__ as entry
from pyspark.sql import functions as F

from holdwright.plans import read_models as rm
from holdwright.plans.binding import DriverTables
from holdwright.sources.layouts.blocks import MULTI, scope_examples
from holdwright.sources.files import records, tokenise
from tests import layout_files as lf


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {q for q in set(queries) - set(sql) if q != "pipeline" and not q.startswith("op")} == set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "fund_code" and df.count() > 0


def test_buckets_add_up_to_rows(spark, tiny):
    corpus = DriverTables(spark, tiny).corpus
    explorer = rm.entity_explorer(corpus)
    states = ["fully_disclosed_count", "value_only_count", "ownership_only_count", "name_only_count"]
    assert explorer.where(F.col("row_count") != sum((F.col(c) for c in states[1:]), F.col(states[0]))).count() == 0
    mix = rm.asset_mix(corpus)
    assert mix.where("precise_rows > observation_count").count() == 0


def test_entity_detail_agrees_with_slices(spark, tiny):
    corpus = DriverTables(spark, tiny).corpus
    slices = rm.entity_slices(corpus, ["fund_code"]).groupBy("entity_id").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "entity_id").limit(2).collect()
    for row in slices:
        assert rm.entity_detail(corpus, row.entity_id).count() == row.n


def test_records_match_the_standard_reader(spark):
    bodies = [b"", b"a,b\n\n\"x\ny\",\"q\"\"q\"\n", "\u00e9,\u3000".encode(), b"\xff\n" * 9_000]
    files = spark.createDataFrame([(str(i), bytearray(b), "replace") for i, b in enumerate(bodies)], "path string, content binary, decoding string")
    got = {}
    for r in tokenise(files, carried=["path"]).orderBy("path", "row_number").collect():
        got.setdefault(r.path, []).append((r.row_number, list(r.cells), r.replaced))
    assert got.pop("0") == [(0, [], 0)]
    for i, body in enumerate(bodies[1:], 1):
        assert got[str(i)] == [(r["row_number"], r["cells"], r["replaced"]) for r in records(body, "replace")]


def test_scope_examples(spark):
    files = spark.createDataFrame([("f", bytearray(lf.blocks_multi()), "fallback")], "path string, content binary, decoding string")
    rows = scope_examples(tokenise(files, carried=["path"]), MULTI).collect()
    assert [(r.scope_raw, r.times_set, r.first_row) for r in rows] == [("Held directly or by associated entity or by PSTs", 2, 17)]


def test_no_query_reads_a_subset_or_collects():
    """Nothing in the package samples, localises or collects data."""
    for path in pathlib.Path(rm.__file__).parents[1].rglob("*.py"):
        source = path.read_text()
        for word in (".collect()", "toPandas", "localCheckpoint", "crossJoin", ".sample("):
            assert word not in source, f"{word} in {path}"
