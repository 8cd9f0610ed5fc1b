"""Registered queries of the ingest path: layout rows, issues, profiles, records, arrivals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdwright.plans import ingest
from holdwright.plans.binding import DriverTables
from holdwright.plans.oracle_base import with_ctes
from holdwright.plans.registered_layouts import ITEMS_PER_TASK
from holdwright.session import checkpoint_dir
from holdwright.sources.files import tokenise
from holdwright.sources.layouts.flat import HEADER_11
from holdwright.sources.store import Store
from holdwright.streaming.arrivals import append_once

CLASSES = ["Cash", "Listed Equity", "Unlisted Property", "Unlisted Equity", "Fixed Income", "Derivatives by Kind", "Cash Total"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as a numbered record of the eleven-column layout, one file per order.

    Line items are dealt by file before their cells are written, so that narrow rows move, and once.
    """
    li = DriverTables(spark, sf).table("lineitem")
    tasks = max(1, -(-li.count() // ITEMS_PER_TASK))
    li = li.withColumn("path", F.col("l_orderkey").cast("string")).drop("l_orderkey").repartition(tasks, "path")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    n = F.col("l_linenumber")
    managed = F.when(F.col("l_returnflag") == "A", "Internally Managed").when(F.col("l_returnflag") == "R", " externally managed").otherwise("")
    cells = F.array(
        F.when(F.col("l_quantity") == 50, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")),
        F.concat(F.lit("Option "), F.col("l_suppkey").cast("string")),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), n),
        managed,
        F.concat(F.lit(" Part "), F.col("l_partkey").cast("string")),
        text(F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("bigint"))),
        text(F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice").cast("decimal(20,2)"))),
        text(F.col("l_tax").cast("decimal(4,2)")),
        F.coalesce(F.concat(F.when(F.col("l_discount") <= 0.02, (F.col("l_discount").cast("decimal(4,2)") * 100).cast("decimal(6,1)").cast("string")), F.lit("%")), F.lit("")),
        F.lit("AUD"),
        F.when(F.col("l_quantity") > 40, F.concat(F.lit("AU"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"))).otherwise(""),
    )
    tie = F.concat_ws("-", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(n, tie))
    return li.withColumn("row_number", place + 1).select(
        "path", F.lit("flat11").alias("layout_key"), F.lit("harbour").alias("fund_code"), F.lit("").alias("source_url"),
        F.lit(None).cast("date").alias("registered_period"), F.lit("").alias("first_line_digest"), "row_number", cells.alias("cells"), F.lit(0).alias("replaced"), F.lit("utf-8").alias("encoding"),
    )


def flat_layout_rows(spark: SparkSession, sf: str) -> DataFrame:
    typed = ingest.typed_rows_of(_records(spark, sf), ["flat11"])
    return typed.select(
        "path", F.col("row_number").cast("bigint").alias("row_number"), "kind", "reporting_period", "source_option_code", "source_subclass_raw", "asset_class_code", "is_aggregate", "raw_name",
        "value_aud", "ownership_pct", "units", "weighting_pct", "identifier_type", F.when(F.col("asset_class_code").isNotNull(), F.col("disclosure_completeness")).alias("disclosure_completeness"),
        F.concat_ws(",", "parse_warning_flags").alias("flags"), F.concat_ws(",", F.transform("issues", lambda i: i["kind"])).alias("issues"),
    )


def flat_file_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest issue of every file."""
    typed = ingest.typed_rows_of(_records(spark, sf), ["flat11"])
    first = ingest.earliest_issues(ingest.row_issues(typed))
    return first.select("path", F.col("first_issue.kind").alias("kind"), F.col("first_issue.row_number").cast("bigint").alias("row_number"), "issue_count")


def flat_file_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Structural profile and schema fingerprint of every file."""
    profiles = ingest.file_profiles(ingest.typed_rows_of(_records(spark, sf), ["flat11"]))
    return profiles.select(
        "path", "schema_fingerprint", F.concat_ws("|", "observed_asset_classes").alias("asset_classes"), F.concat_ws("|", "observed_internal_external").alias("internal_external"),
        F.col("total_rows_read").cast("bigint").alias("total_rows_read"), "total_rows_holding", "skipped_posture_rows",
    )


def csv_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV files with quotes, commas, line breaks and blank records, and read back."""
    li = DriverTables(spark, sf).table("lineitem")
    quoted = F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(', ""'), F.col("l_linestatus"), F.lit('""\nend"'))
    line = F.concat_ws(",", F.col("l_partkey").cast("string"), quoted, F.lit(""), F.col("l_quantity").cast("bigint").cast("string"))
    line = F.concat(line, F.when(F.col("l_linenumber") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("\r\n")))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    files = li.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "")
    out = tokenise(files.select("path", F.to_binary(body, F.lit("utf-8")).alias("content"), F.lit("replace").alias("decoding")), carried=["path"])
    cells = F.array_sort(F.collect_list(F.struct("row_number", F.array_join("cells", "|").alias("cells"))))
    text = F.array_join(F.transform(cells, lambda r: r["cells"]), ";")
    return out.groupBy("path").agg(
        F.max("row_number").cast("bigint").alias("record_count"), F.sum(F.size("cells")).alias("cell_count"), F.count_if(F.size("cells") == 0).alias("blank_records"), F.sha2(text, 256).alias("cells_digest")
    )


def arrivals_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as arriving rows, each delivered twice and stored once."""
    root = f"{checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    store = Store(spark, root)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    sink = append_once(store, "events", ["event_id"])
    query = stream.writeStream.foreachBatch(lambda rows, batch: sink(rows.unionByName(rows), batch)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = store.facts("events", schema)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("user_id").alias("user_count"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("value_total"))


QUERIES = {
    "flat_layout_rows": flat_layout_rows,
    "flat_file_issues": flat_file_issues,
    "flat_file_profiles": flat_file_profiles,
    "csv_records": csv_records,
    "arrivals_stream": arrivals_stream,
}

_LABEL = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES, 1)) + " END"
ROWS = f"""
f0 AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) AS path, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat_ws('-', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d'))) AS row_number,
    CASE WHEN l_linenumber = 6 THEN 'posture' ELSE 'holding' END AS kind, {_LABEL} AS label, CASE l_returnflag WHEN 'A' THEN 'Internally Managed' WHEN 'R' THEN 'externally managed' ELSE '' END AS style,
    l_linenumber IN (1, 2, 7) AND l_returnflag <> 'N' OR l_linenumber IN (3, 4) AND l_returnflag = 'N' AS unknown, l_tax < 0.07 AS v, l_discount <= 0.02 AS o, l_quantity = 50 AS bad_date
  FROM lineitem),
f AS (SELECT *, kind = 'holding' AND unknown AS is_unknown, kind = 'holding' AND bad_date AS is_bad FROM f0)"""
SQL = {
    "csv_records": """SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) + count(*) FILTER (l_linenumber % 2 = 0) AS record_count, 4 * count(*) AS cell_count, count(*) FILTER (l_linenumber % 2 = 0) AS blank_records,
  sha256(string_agg(concat(CAST(l_partkey AS VARCHAR), '|', l_returnflag, ', "', l_linestatus, '"', chr(10), 'end||', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN ';' ELSE '' END), ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity)) AS cells_digest
FROM lineitem GROUP BY 1""",
    "flat_layout_rows": with_ctes(ROWS, query="""SELECT path, row_number, kind, CASE WHEN kind = 'holding' AND NOT bad_date THEN CAST(l_shipdate AS DATE) END AS reporting_period, CASE WHEN kind = 'holding' THEN 'Option ' || CAST(l_suppkey AS VARCHAR) END AS source_option_code,
  CASE WHEN kind = 'holding' THEN nullif(style, '') END AS source_subclass_raw,
  CASE WHEN kind = 'holding' AND NOT unknown THEN CASE l_linenumber WHEN 1 THEN 'cash' WHEN 2 THEN 'listed_equity' WHEN 3 THEN 'unlisted_property' WHEN 4 THEN 'unlisted_equity' WHEN 5 THEN 'fixed_income' ELSE 'cash' END END AS asset_class_code,
  CASE WHEN kind = 'holding' THEN l_linenumber = 7 AND NOT unknown END AS is_aggregate, CASE WHEN kind = 'holding' AND (l_linenumber <> 7 OR unknown) THEN 'Part ' || CAST(l_partkey AS VARCHAR) END AS raw_name,
  CASE WHEN kind = 'holding' AND v THEN CAST(l_extendedprice AS DECIMAL(24,9)) END AS value_aud, CASE WHEN kind = 'holding' AND o THEN CAST(l_discount AS DECIMAL(18,9)) END AS ownership_pct,
  CASE WHEN kind = 'holding' AND l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(30,12)) END AS units, CASE WHEN kind = 'holding' THEN CAST(l_tax AS DECIMAL(18,9)) END AS weighting_pct,
  CASE WHEN kind = 'holding' AND l_quantity > 40 THEN 'ISIN' END AS identifier_type,
  CASE WHEN kind = 'holding' AND NOT unknown THEN CASE WHEN l_linenumber = 7 THEN 'aggregate_total' WHEN v AND (o OR l_quantity > 40 OR l_linestatus = 'O') THEN 'fully_disclosed' WHEN v THEN 'value_only' WHEN o THEN 'ownership_only' ELSE 'name_only' END END AS disclosure_completeness,
  CASE WHEN kind = 'holding' THEN concat_ws(',', CASE WHEN NOT v THEN 'weighting_without_value' END, CASE WHEN l_discount = 0 THEN 'zero_ownership_pct' END) ELSE '' END AS flags,
  concat_ws(',', CASE WHEN is_unknown THEN 'unknown_asset_class' END, CASE WHEN is_bad THEN 'invalid_date' END) AS issues FROM f"""),
    "flat_file_issues": with_ctes(ROWS, query="""SELECT path, arg_min(CASE WHEN is_unknown THEN 'unknown_asset_class' ELSE 'invalid_date' END, row_number) AS kind, min(row_number) AS row_number, CAST(sum(is_unknown::INT + is_bad::INT) AS BIGINT) AS issue_count
FROM f WHERE is_unknown OR is_bad GROUP BY 1"""),
    "flat_file_profiles": with_ctes(ROWS, query="""SELECT path, sha256('{"header":[' || '""" + ",".join(f'"{h}"' for h in HEADER_11) + """' || '],"asset_classes":' || CAST(to_json(labels) AS VARCHAR) || ',"internal_external_values":' || CAST(to_json(styles) AS VARCHAR) || '}') AS schema_fingerprint,
  array_to_string(labels, '|') AS asset_classes, array_to_string(styles, '|') AS internal_external, total_rows_read, total_rows_holding, skipped_posture_rows
FROM (SELECT path, list_sort(list(DISTINCT label)) AS labels, coalesce(list_sort(list(DISTINCT style) FILTER (style <> '')), []) AS styles, max(row_number) AS total_rows_read, count(*) FILTER (kind = 'holding') AS total_rows_holding, count(*) FILTER (kind = 'posture') AS skipped_posture_rows FROM f GROUP BY 1)"""),
    "arrivals_stream": """SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS user_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS value_total FROM (SELECT DISTINCT event_id, user_id, event_type, value FROM events) GROUP BY 1""",
}
