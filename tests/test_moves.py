"""How often rows move: counted in plans, on the small test tables."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from holdwright.operators import skew
from holdwright.plans import ingest, registered_governance, registered_ingest, registered_layouts, registered_loads, resolver
from holdwright.plans.binding import EXPIRY_CUTOFF, DriverTables
from holdwright.sources import files as sources


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("layout_variant", 1), ("layout_section", 4), ("layout_blocks_single", 10)])
def test_layout_records_move_before_they_are_written_out(spark, tiny, name, most):
    """One move of line items; the rest are summaries of blocks."""
    assert exchanges(registered_layouts.QUERIES[name](spark, tiny)) <= most


def test_blocks_given_with_records_and_own_blocks_give_the_same_rows(spark, tiny):
    items = registered_layouts._items(spark, tiny, F.concat(F.lit("m"), (F.col("ord") % 2).cast("string")))
    first = F.col("pos") == 1
    records = registered_layouts._written(items, "blocks5_multi", [
        F.when(first, F.array(F.lit("INVESTMENT OPTION NAME"), F.concat(F.lit("Opt "), F.col("o")), *[F.lit("")] * 3)), F.when(first, F.array(F.lit("TABLE 1"), *[F.lit("")] * 4)),
        F.array("part", F.lit(""), F.lit(""), F.lit("1"), F.lit("2")),
    ], many_orders=True)
    numbered = records.withColumn("want", F.row_number().over(Window.partitionBy("path").orderBy("row_number")))
    assert numbered.where("want <> row_number").isEmpty() and records.select("path", "scan_block").distinct().count() > 2
    shown = lambda r: ingest.typed_rows_of(r, ["blocks5_multi"]).select("path", "row_number", "source_option_name", "raw_name", "kind")
    given, own = shown(records), shown(records.drop("scan_block"))
    assert given.exceptAll(own).isEmpty() and own.exceptAll(given).isEmpty()
    assert given.where("kind = 'holding' AND source_option_name IS NULL").isEmpty()


def test_flat_records_move_once(spark, tiny):
    assert exchanges(registered_ingest.flat_layout_rows(spark, tiny)) <= 1
    assert exchanges(registered_ingest.flat_file_issues(spark, tiny)) <= 1


def test_issue_rows_do_not_repeat_the_parses(spark, tiny):
    """The plan of the issues is about as long as that of the typed rows."""
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    typed = ingest.typed_rows_of(registered_ingest._records(spark, tiny), ["flat11"])
    assert size(ingest.row_issues(typed)) < 2 * size(typed.select("path", "row_number", "issues"))


def test_linked_holdings_take_no_part_in_the_lookups(spark, tiny):
    """They carry no evidence, and none of them is lost."""
    corpus = DriverTables(spark, tiny).corpus
    rows = resolver.resolve(corpus, F.lit(EXPIRY_CUTOFF).cast("date"))
    linked = rows.where("outcome = 'prelinked'").agg(F.count("*").alias("n"), F.count("override_id").alias("o"), F.count("id_entity").alias("i"), F.count("any_entity").alias("a")).first()
    assert linked.n == corpus.observations.where("entity_id IS NOT NULL").count() and (linked.o, linked.i, linked.a) == (0, 0, 0)


def test_tasks_of_the_star_join_hold_bounded_rows(spark, tiny, monkeypatch):
    """Enough rows are dealt to tasks by their number, and none is lost or changed."""
    keep = ["source_file_id", "holding_key", "raw_name", "is_current", "option_code"]
    plain = DriverTables(spark, tiny).observations.select(*keep)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 200)
    even = DriverTables(spark, tiny).observations.select(*keep)
    assert plain.exceptAll(even).isEmpty() and even.exceptAll(plain).isEmpty()
    sizes = even.groupBy(F.spark_partition_id()).count().agg(F.count("*").alias("tasks"), F.max("count").alias("most")).first()
    assert sizes.tasks >= 25 and sizes.most < 400


def test_records_of_small_files_share_batches(spark, monkeypatch):
    """A task hands over batches by the number of records, not one for each file, and rows stay with their file."""
    files = spark.range(3000, numPartitions=1).select(
        F.col("id").cast("string").alias("path"), F.encode(F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit('"a\n'), F.col("id").cast("string"), F.lit('",b\n\nc'))), "utf-8").alias("content"),
        F.lit("replace").alias("decoding"),
    )
    tables = sources.tokenise(files, carried=["path"])
    made = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    sources.tokenise(files, carried=["path"])
    batch = pa.table({"path": [str(i) for i in range(3000)], "content": [b"x\ny"] * 3000, "decoding": ["replace"] * 3000}).to_batches()
    assert len(list(made[0](iter(batch)))) == 2
    rows = tables.groupBy("path").agg(F.max("row_number").alias("last"), F.max(F.get("cells", 0)).alias("text")).collect()
    assert len(rows) == 3000
    for r in rows:
        assert (r.last, r.text) == ((0, None) if int(r.path) % 3 == 0 else (3, "c"))
    assert {r.cells[0] for r in tables.where("row_number = 1").select("cells").collect()} == {f"a\n{i}" for i in range(3000) if i % 3}


@pytest.mark.parametrize("name", ["duplicate_view_merge", "duplicate_view_events"])
def test_duplicate_views_read_the_star_join_once(spark, tiny, name):
    """Groups and rows both read the written views, not the tables."""
    files = registered_governance.QUERIES[name](spark, tiny).inputFiles()
    assert files and not [f for f in files if tiny in f]


def test_both_asset_runs_read_one_written_star_join(spark, tiny, monkeypatch):
    read, run = [], registered_loads.Assets.run
    monkeypatch.setattr(registered_loads.Assets, "run", lambda self, corpus, number: read.append(corpus.observations.inputFiles()) or run(self, corpus, number))
    registered_loads.QUERIES["asset_outcomes"](spark, tiny)
    assert len(read) == 2 and read[0] and set(read[0]) == set(read[1])
    assert not [f for f in read[0] if tiny in f]
