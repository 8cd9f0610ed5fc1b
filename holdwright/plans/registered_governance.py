"""Registered queries of loading, versions and governance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.functions.identifiers import json_digest
from holdwright.functions.numbers import half_year_end
from holdwright.functions.text import clean, lookup, normalise_name
from holdwright.operators import governance, reconcile, versions
from holdwright.operators.merge_views import ambiguous_groups, merge_duplicate_views, names_across_classes, view_role
from holdwright.operators.paging import top_of_each
from holdwright.operators.skew import fill_forward
from holdwright.plans.binding import CLASS_OF_TYPE, DriverTables
from holdwright.plans.corpus import with_status
from holdwright.plans.oracle_base import FILES, LINES, OBS, half, norm, with_ctes
from holdwright.session import written_once

LAYOUTS = ["automobile", "building", "furniture", "household", "machinery"]


def version_chain(spark: SparkSession, sf: str) -> DataFrame:
    files = DriverTables(spark, sf).registered.where(F.col("ingest_status") == "loaded")
    block = F.month("received_on")  # a slice spans one half-year, so months never go back
    out = versions.version_chain(files, ["received_on", "source_file_id"], block)
    return out.select("source_file_id", "version_number", "supersedes_file_id", "is_current")


def register_files(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals from 1998 on against the current versions stored before."""
    files = DriverTables(spark, sf).source_files.withColumn("checksum", F.sha2(F.concat_ws("|", "option_code", F.floor("declared_total").cast("string")), 256))
    early = F.col("received_on") < F.lit("1998-01-01").cast("date")
    fresh = versions.new_files(files.where(~early), files.where(early))
    return fresh.select("fund_code", "layout_key", "checksum")


def dimension_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Period and option rows that files from 1998 on add."""
    files = DriverTables(spark, sf).registered
    early = F.col("received_on") < F.lit("1998-01-01").cast("date")
    periods = versions.missing_rows(versions.period_rows(files.where(~early)), files.where(early), ["reporting_period"])
    options = versions.missing_rows(files.where(~early).select("fund_code", "option_code", "option_name"), files.where(early), ["fund_code", "option_code"])
    nothing = F.lit(None)
    return periods.select(F.lit("period").alias("kind"), F.col("label").alias("code"), "disclosure_due", nothing.cast("string").alias("name")).unionByName(
        options.select(F.lit("option").alias("kind"), F.col("option_code").alias("code"), nothing.cast("date").alias("disclosure_due"), F.col("option_name").alias("name"))
    )


def _cells(df: DataFrame) -> DataFrame:
    """Line items as raw cells, without the line number: re-issued lines repeat a hash."""
    text = lambda c: F.col(c).cast("string")
    cells = F.array(text("l_partkey"), F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_quantity").cast("bigint").cast("string"))
    return df.select(F.col("l_orderkey").alias("source_file_id"), F.col("l_linenumber").alias("source_row_number"), cells.alias("cells"))


def row_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cells(DriverTables(spark, sf).table("lineitem"))
    return rows.select("source_file_id", F.col("source_row_number").cast("bigint").alias("source_row_number"), json_digest(F.col("cells")).alias("source_row_hash"))


def idempotent_load(spark: SparkSession, sf: str) -> DataFrame:
    """A second load of everything after the returned lines were loaded already."""
    li = DriverTables(spark, sf).table("lineitem")
    staged = _cells(li).withColumn("source_row_hash", json_digest(F.col("cells")))
    stored = _cells(li.where(F.col("l_returnflag") == "R")).withColumn("source_row_hash", json_digest(F.col("cells")))
    return versions.load_counts(staged, stored)


def load_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the same second load appends: the first line of each hash survives."""
    li = DriverTables(spark, sf).table("lineitem")
    staged = _cells(li).withColumn("source_row_hash", json_digest(F.col("cells")))
    stored = _cells(li.where(F.col("l_returnflag") == "R")).withColumn("source_row_hash", json_digest(F.col("cells")))
    out = versions.rows_to_append(staged, stored)
    return out.select("source_file_id", "source_row_hash", F.col("source_row_number").cast("bigint").alias("source_row_number"))


def _taxonomy(t: DriverTables) -> DataFrame:
    """Approved taxonomy of each layout: one row per class, subclass and aggregate flag.

    Deliberate gaps: `machinery` lacks infrastructure rows without a subclass,
    `building` files fund vehicles under another class, `household` expects
    property rows to be value-only.
    """
    kinds = t.table("part").select(F.col("p_type").alias("source_asset_class_raw")).distinct()
    rows = kinds.withColumn("mapping_version_id", F.explode(F.array(*[F.lit(k) for k in LAYOUTS])))
    rows = rows.withColumn("source_filter_raw", F.explode(F.array(F.lit("Internally Managed"), F.lit("Externally Managed"), F.lit(None).cast("string"))))
    rows = rows.withColumn("is_aggregate_default", F.explode(F.array(F.lit(True), F.lit(False))))
    cls, version = F.col("source_asset_class_raw"), F.col("mapping_version_id")
    gap = (version == "machinery") & (cls == "SMALL") & F.col("source_filter_raw").isNull()
    code = F.when((version == "building") & (cls == "PROMO"), F.lit("alternatives")).otherwise(lookup(CLASS_OF_TYPE, cls))
    state = F.when(F.col("is_aggregate_default"), "aggregate_total").when((version == "household") & (cls == "LARGE"), "value_only")
    return rows.where(~gap).select(
        "mapping_version_id", "source_asset_class_raw", "source_filter_raw", F.lit(None).cast("string").alias("source_section_raw"), "is_aggregate_default",
        code.alias("canonical_asset_class_code"), state.alias("disclosure_completeness_default"),
    )


def _rows_for_taxonomy(observations: DataFrame) -> DataFrame:
    return observations.select(
        "source_file_id", "holding_key", "source_row_number", F.col("layout_key").alias("mapping_version_id"), "source_asset_class_raw", "source_subclass_raw",
        F.lit(None).cast("string").alias("source_section_raw"), "is_aggregate", "asset_class_code", "disclosure_completeness",
    )


def taxonomy_validate(spark: SparkSession, sf: str) -> DataFrame:
    t = DriverTables(spark, sf)
    issues = governance.taxonomy_issues(_rows_for_taxonomy(t.observations), _taxonomy(t))
    out = governance.reported_issues(issues, "source_file_id", [F.asc("source_row_number"), F.asc("holding_key")])
    return out.select("source_file_id", F.col("rank").cast("bigint").alias("rank"), "holding_key", "reason", "expected", "actual")


def _profiles(observations: DataFrame) -> DataFrame:
    """Sorted label sets of each file; their size is bounded by the label lists."""
    rows = observations.groupBy("source_file_id", "layout_key").agg(
        F.array_sort(F.collect_set("source_asset_class_raw")).alias("observed_asset_classes"),
        F.array_sort(F.collect_set("source_subclass_raw")).alias("observed_internal_external"),
        F.bool_or("is_aggregate").alias("has_total"),
    )
    return rows.withColumn("observed_option_names", F.when(F.col("has_total"), F.array(F.lit("Total"))).otherwise(F.array().cast("array<string>"))).drop("has_total")


def _versions(t: DriverTables) -> DataFrame:
    """Four approved versions of every layout, in seed order."""
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def version(n: int, classes, styles, options):
        return F.struct(
            F.lit(n).alias("seed_position"), arr(classes).alias("expected_asset_classes"), arr(styles).alias("expected_internal_external"),
            (F.lit(None).cast("array<string>") if options is None else arr(options)).alias("expected_option_names"),
        )

    both = ["Externally Managed", "Internally Managed"]
    approved = F.array(version(0, kinds, both, None), version(1, ["STANDARD"], ["Internally Managed"], None), version(2, ["ECONOMY", "LARGE"], both, ["Total"]), version(3, ["MEDIUM"], [], []))
    layouts = t.table("customer").select(F.lower("c_mktsegment").alias("layout_key")).distinct()
    out = layouts.select("layout_key", F.inline(approved))
    return out.withColumn("mapping_version_id", F.concat_ws("-", "layout_key", F.col("seed_position").cast("string")))


COMPARE = {"always": ["asset_classes", "internal_external"], "optional": ["option_names"], "fingerprint": False}


def drift_compare(spark: SparkSession, sf: str) -> DataFrame:
    t = DriverTables(spark, sf)
    near = governance.nearest_version(governance.mapping_candidates(_profiles(t.observations), _versions(t), **COMPARE))
    return near.select("source_file_id", "mapping_version_id", F.concat_ws(",", "drift").alias("drift"), F.col("drift_score").cast("bigint").alias("drift_score"))


def mapping_decision(spark: SparkSession, sf: str) -> DataFrame:
    """First clean version or best near miss of every file."""
    t = DriverTables(spark, sf)
    taxonomy = _taxonomy(t).withColumnRenamed("mapping_version_id", "layout_key").join(_versions(t).select("layout_key", "mapping_version_id"), "layout_key")
    seen = written_once(t.observations.select("source_file_id", "layout_key", "holding_key", "source_row_number", "source_asset_class_raw", "source_subclass_raw", "is_aggregate", "asset_class_code", "disclosure_completeness"))
    rows = _rows_for_taxonomy(seen).drop("mapping_version_id")
    out = governance.enforce(_profiles(seen), _versions(t), rows, taxonomy, **COMPARE)
    return out.select("source_file_id", "mapping_version_id", "score", "review_reason", "ingest_status")


def review_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Differences and mismatching rows of every file that waits for review."""
    t = DriverTables(spark, sf)
    taxonomy = _taxonomy(t).withColumnRenamed("mapping_version_id", "layout_key").join(_versions(t).select("layout_key", "mapping_version_id"), "layout_key")
    seen = written_once(t.observations.select("source_file_id", "layout_key", "holding_key", "source_row_number", "source_asset_class_raw", "source_subclass_raw", "is_aggregate", "asset_class_code", "disclosure_completeness"))
    rows = _rows_for_taxonomy(seen).drop("mapping_version_id")
    decided = written_once(governance.enforce(_profiles(seen), _versions(t), rows, taxonomy, **COMPARE))
    out = governance.review_details(decided, _versions(t), rows, taxonomy, ["source_row_number", "holding_key"], **COMPARE)
    return out.withColumn("position", F.col("position").cast("bigint")).withColumn("source_row_number", F.col("source_row_number").cast("bigint"))


def review_status(spark: SparkSession, sf: str) -> DataFrame:
    """Review items of unloaded files after the decisions their priority stands for."""
    t = DriverTables(spark, sf)
    waiting = t.table("orders").where(F.col("o_orderstatus") == "P")
    items = waiting.select(F.col("o_orderkey").alias("item_id"), F.lit("open").alias("status"), F.when(F.col("o_totalprice") >= 1000, F.lit("print")).alias("schema_fingerprint"))
    action = lookup({"1-URGENT": "resolve", "2-HIGH": "reject", "3-MEDIUM": "approve"}, F.col("o_orderpriority"))
    decisions = waiting.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select(
        F.col("o_orderkey").alias("item_id"), action.alias("action"), F.concat(F.lit(" m-"), F.col("o_custkey").cast("string")).alias("mapping_version_id"),
        F.lit("reviewer").alias("approved_by"), F.col("o_orderdate").cast("date").alias("decided_at"),
    )
    return governance.apply_review_decisions(items, decisions).select("item_id", "new_status", "approved_version")


def review_queue_open(spark: SparkSession, sf: str) -> DataFrame:
    """Open review items with their file and fund."""
    t = DriverTables(spark, sf)
    items = t.table("orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("source_file_id"), F.when(F.col("o_orderpriority") == "5-LOW", "resolved").otherwise("open").alias("status"))
    files = t.registered.select("source_file_id", "fund_code", "fund_name", "received_on")
    return with_status(items, "open").join(files, "source_file_id", "left")


FILING = ["fund_code", "option_code", "reporting_period"]
VIEW_GROUP = [*FILING, "source_asset_class_raw", "name_key"]


def _views(t: DriverTables) -> DataFrame:
    """Filings of a fund, option and period read as one file with duplicate views; written, since groups and rows both read them."""
    rows = t.observations.where(F.col("has_name"))
    key = F.when(F.col("source_subclass_raw").isNotNull(), F.lower("source_subclass_raw")).otherwise(F.lit("all assets"))
    views = rows.select(
        *FILING, "source_asset_class_raw", "holding_key", "value_aud", "ownership_pct", "classification_raw", "value_band_raw", normalise_name(F.col("raw_name")).alias("name_key"),
        view_role(key, F.col("value_aud"), F.col("ownership_pct")).alias("view_role"),
    )
    return written_once(views)


def duplicate_view_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _views(DriverTables(spark, sf))
    out = merge_duplicate_views(rows, VIEW_GROUP, "holding_key", ["classification_raw", "value_band_raw"])
    return out.select("holding_key", "view_role", "is_merged", "classification_raw", "value_band_raw", "precise_rows", "metadata_rows", F.when(F.col("is_merged"), F.col("first_metadata_row")).alias("first_metadata_row"))


def duplicate_view_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _views(DriverTables(spark, sf))
    none = F.lit(None).cast("string")
    several = ambiguous_groups(rows, VIEW_GROUP).select(*VIEW_GROUP, "group_rows", "reason")
    across = names_across_classes(rows, [*FILING, "name_key"], "source_asset_class_raw", "value_aud").select(*FILING, none.alias("source_asset_class_raw"), "name_key", "group_rows", "reason")
    return several.unionByName(across)


def fill_forward_state(spark: SparkSession, sf: str) -> DataFrame:
    """Latest user turn, and its text, at every turn of a conversation."""
    turns = DriverTables(spark, sf).table("conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("user_turn"), F.when(F.col("role") == "user", F.sha2("text", 256)).alias("user_text")
    )
    out = fill_forward(turns, ["conv_id"], F.floor(F.col("turn") / 10_000), ["turn"], ["user_turn", "user_text"])
    return out.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("user_turn_filled").cast("bigint").alias("user_turn"), F.col("user_text_filled").alias("user_text"))


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """First twenty non-blank lines of every document."""
    docs = DriverTables(spark, sf).table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    kept = top_of_each(docs.where(clean(F.col("line")) != ""), ["doc_id"], [F.asc("line_number")], 20)
    return kept.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), F.col("line_number").cast("bigint").alias("line_number"), F.sha2("line", 256).alias("line_hash"))


def period_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Rows dated outside the period their file is registered for, per file."""
    t = DriverTables(spark, sf)
    rows = t.lines.select("source_file_id", half_year_end(F.col("row_date")).alias("row_period"))
    files = t.registered.select("source_file_id", "reporting_period")
    return rows.join(files, "source_file_id").groupBy("source_file_id").agg(
        F.count_if(F.col("row_period") != F.col("reporting_period")).alias("rows_off_period"), F.count_distinct("row_period").alias("row_periods"), F.count(F.lit(1)).alias("row_count")
    )


def _manifest(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    files = t.registered.where(F.col("ingest_status") == "loaded")
    manifest = files.select("source_file_id", "fund_code", (F.floor("declared_total") % 8).cast("bigint").alias("expected_rows"))
    observed = t.lines.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("observed_rows"))
    return manifest, observed


def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest, observed = _manifest(DriverTables(spark, sf))
    return reconcile.reconcile_files(manifest, observed, ["source_file_id"])


def manifest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    manifest, observed = _manifest(DriverTables(spark, sf))
    listed = reconcile.reconcile_files(manifest, observed, ["source_file_id"]).where(F.col("fund_code").isNotNull())
    return reconcile.reconcile_funds(listed, tolerance=500)


QUERIES = {
    "version_chain": version_chain,
    "register_files": register_files,
    "dimension_seed": dimension_seed,
    "row_hash": row_hash,
    "idempotent_load": idempotent_load,
    "load_rows": load_rows,
    "taxonomy_validate": taxonomy_validate,
    "drift_compare": drift_compare,
    "mapping_decision": mapping_decision,
    "review_detail": review_detail,
    "review_status": review_status,
    "review_queue_open": review_queue_open,
    "duplicate_view_merge": duplicate_view_merge,
    "duplicate_view_events": duplicate_view_events,
    "fill_forward_state": fill_forward_state,
    "sample_rows": sample_rows,
    "period_consistency": period_consistency,
    "manifest_files": manifest_files,
    "manifest_reconcile": manifest_reconcile,
}


# --- SQL ---------------------------------------------------------------------

CELLS = """
cells AS (SELECT l_orderkey AS source_file_id, l_linenumber AS source_row_number, l_returnflag,
  sha256('["' || CAST(l_partkey AS VARCHAR) || '","' || l_returnflag || '","' || l_linestatus || '","' || strftime(l_shipdate, '%Y-%m-%d') || '","' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '"]') AS source_row_hash FROM lineitem)"""

_CODE = "CASE t WHEN 'STANDARD' THEN 'listed_equity' WHEN 'MEDIUM' THEN 'unlisted_equity' WHEN 'ECONOMY' THEN 'fixed_income' WHEN 'SMALL' THEN 'unlisted_infrastructure' WHEN 'LARGE' THEN 'unlisted_property' WHEN 'PROMO' THEN 'private_debt' END"
TAX = f"""
tax AS (SELECT v, t, f, a, CASE WHEN v = 'building' AND t = 'PROMO' THEN 'alternatives' ELSE {_CODE} END AS code, CASE WHEN a THEN 'aggregate_total' WHEN v = 'household' AND t = 'LARGE' THEN 'value_only' END AS state
  FROM (SELECT DISTINCT p_type AS t FROM part), (VALUES ('automobile'), ('building'), ('furniture'), ('household'), ('machinery')) x(v), (VALUES ('Internally Managed'), ('Externally Managed'), (NULL)) y(f), (VALUES (true), (false)) z(a)
  WHERE NOT (v = 'machinery' AND t = 'SMALL' AND f IS NULL))"""
ISSUES = """
joined AS (SELECT o.*, tax.code, tax.state, tax.v IS NOT NULL AS known FROM obs o LEFT JOIN tax ON o.layout_key = v AND source_asset_class_raw = t AND source_subclass_raw IS NOT DISTINCT FROM f AND is_aggregate = a),
issues AS (
  SELECT source_file_id, source_row_number, holding_key, layout_key, 0 AS p, 'missing_mapping' AS reason, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM joined WHERE NOT known
  UNION ALL SELECT source_file_id, source_row_number, holding_key, layout_key, 1, 'canonical_asset_class_mismatch', code, asset_class_code FROM joined WHERE known AND code <> asset_class_code
  UNION ALL SELECT source_file_id, source_row_number, holding_key, layout_key, 2, 'disclosure_completeness_mismatch', state, disclosure_completeness FROM joined WHERE known AND state <> disclosure_completeness)"""
PROFILES = """
profiles AS (SELECT source_file_id, layout_key, list_sort(list(DISTINCT source_asset_class_raw)) AS classes, coalesce(list_sort(list(DISTINCT source_subclass_raw) FILTER (source_subclass_raw IS NOT NULL)), []) AS styles, bool_or(is_aggregate) AS has_total FROM obs GROUP BY 1, 2),
vers AS (SELECT * FROM (VALUES (0, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], ['Externally Managed', 'Internally Managed'], NULL), (1, ['STANDARD'], ['Internally Managed'], NULL),
  (2, ['ECONOMY', 'LARGE'], ['Externally Managed', 'Internally Managed'], true), (3, ['MEDIUM'], [], false)) x(n, classes, styles, total)),
cand AS (SELECT p.source_file_id, p.layout_key, n, concat_ws(',', CASE WHEN p.classes <> v.classes THEN 'asset_classes' END, CASE WHEN p.styles <> v.styles THEN 'internal_external' END, CASE WHEN v.total IS NOT NULL AND p.has_total <> v.total THEN 'option_names' END) AS drift,
  3 * (CASE WHEN p.classes <> v.classes THEN 1 ELSE 0 END + CASE WHEN p.styles <> v.styles THEN 1 ELSE 0 END + CASE WHEN v.total IS NOT NULL AND p.has_total <> v.total THEN 1 ELSE 0 END) AS drift_score FROM profiles p, vers v)"""
DECIDED = """
dec AS (
  SELECT source_file_id, layout_key || '-' || CAST(n AS VARCHAR) AS mapping_version_id, n, stage FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY stage, score, n) AS rn FROM (
    SELECT *, CASE stage WHEN 2 THEN drift_score WHEN 1 THEN 1 + mismatches ELSE 0 END AS score FROM (
      SELECT c.*, CASE WHEN drift_score > 0 THEN 2 WHEN coalesce(k, 0) > 0 THEN 1 ELSE 0 END AS stage, coalesce(k, 0) AS mismatches FROM cand c LEFT JOIN (SELECT source_file_id, count(*) AS k FROM issues GROUP BY 1) USING (source_file_id)))) WHERE rn = 1)"""
VIEWS = """
views AS (
  SELECT fund_code, option_code, reporting_period, source_asset_class_raw, holding_key, value_aud, ownership_pct, classification_raw, value_band_raw, NORM AS name_key,
    CASE WHEN source_subclass_raw IS NOT NULL AND (value_aud IS NOT NULL OR ownership_pct IS NOT NULL) THEN 'precise' WHEN source_subclass_raw IS NULL AND value_aud IS NULL THEN 'metadata' ELSE 'other' END AS view_role
  FROM obs WHERE has_name)""".replace("NORM", norm("raw_name"))
VIEW_BY = "fund_code, option_code, reporting_period, source_asset_class_raw, name_key"
MANIFEST = """
man AS (SELECT source_file_id, fund_code, CAST(floor(declared_total) AS BIGINT) % 8 AS expected_rows FROM files0 WHERE ingest_status = 'loaded'),
got AS (SELECT source_file_id, count(*) AS observed_rows FROM lines GROUP BY 1),
both_sides AS (SELECT coalesce(man.source_file_id, got.source_file_id) AS source_file_id, fund_code, expected_rows, observed_rows,
  CASE WHEN got.source_file_id IS NULL THEN 'missing' WHEN man.source_file_id IS NULL THEN 'unlisted' WHEN expected_rows <> observed_rows THEN 'row_count' ELSE 'ok' END AS status FROM man FULL JOIN got ON man.source_file_id = got.source_file_id)"""

SQL = {
    "version_chain": with_ctes(FILES, query="""SELECT source_file_id, row_number() OVER w AS version_number, lag(source_file_id) OVER w AS supersedes_file_id, lead(source_file_id) OVER w IS NULL AS is_current
FROM files0 WHERE ingest_status = 'loaded' WINDOW w AS (PARTITION BY fund_code, option_code, reporting_period, layout_key ORDER BY received_on, source_file_id)"""),
    "register_files": with_ctes(FILES, query="""SELECT DISTINCT fund_code, layout_key, checksum FROM (SELECT *, sha256(option_code || '|' || CAST(CAST(floor(declared_total) AS BIGINT) AS VARCHAR)) AS checksum FROM files) f WHERE received_on >= DATE '1998-01-01'
  AND NOT EXISTS (SELECT 1 FROM files s WHERE s.received_on < DATE '1998-01-01' AND s.is_current AND s.option_code = f.option_code AND floor(s.declared_total) = floor(f.declared_total))"""),
    "dimension_seed": with_ctes(FILES, query="""SELECT 'period' AS kind, strftime(reporting_period, '%Y-%m-%d') AS code, CAST(reporting_period + INTERVAL 90 DAY AS DATE) AS disclosure_due, CAST(NULL AS VARCHAR) AS name
  FROM (SELECT DISTINCT reporting_period FROM files0 WHERE received_on >= DATE '1998-01-01') WHERE reporting_period NOT IN (SELECT reporting_period FROM files0 WHERE received_on < DATE '1998-01-01')
UNION ALL SELECT DISTINCT 'option', option_code, CAST(NULL AS DATE), option_name FROM files0 WHERE received_on >= DATE '1998-01-01' AND option_code NOT IN (SELECT option_code FROM files0 WHERE received_on < DATE '1998-01-01')"""),
    "row_hash": with_ctes(CELLS, query="SELECT source_file_id, CAST(source_row_number AS BIGINT) AS source_row_number, source_row_hash FROM cells"),
    "idempotent_load": with_ctes(CELLS, query="""SELECT source_file_id, CAST(sum(copies) AS BIGINT) AS rows_staged, count(*) FILTER (NOT known) AS rows_inserted, CAST(sum(copies) AS BIGINT) - count(*) FILTER (NOT known) AS rows_skipped_existing
FROM (SELECT source_file_id, source_row_hash, count(*) AS copies, bool_or(l_returnflag = 'R') AS known FROM cells GROUP BY 1, 2) GROUP BY 1"""),
    "load_rows": with_ctes(CELLS, query="""SELECT source_file_id, source_row_hash, CAST(min(source_row_number) AS BIGINT) AS source_row_number FROM cells GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'R')"""),
    "taxonomy_validate": with_ctes(FILES, LINES, OBS, TAX, ISSUES, query="""SELECT * FROM (SELECT source_file_id, row_number() OVER (PARTITION BY source_file_id ORDER BY source_row_number, holding_key, p) AS rank, holding_key, reason, expected, actual FROM issues) WHERE rank <= 10"""),
    "drift_compare": with_ctes(FILES, LINES, OBS, PROFILES, query="""SELECT source_file_id, layout_key || '-' || CAST(n AS VARCHAR) AS mapping_version_id, drift, CAST(drift_score AS BIGINT) AS drift_score
FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY drift_score, n) AS rn FROM cand) WHERE rn = 1"""),
    "mapping_decision": with_ctes(FILES, LINES, OBS, TAX, ISSUES, PROFILES, query="""SELECT source_file_id, layout_key || '-' || CAST(n AS VARCHAR) AS mapping_version_id, CAST(score AS BIGINT) AS score, CASE stage WHEN 1 THEN 'unapproved_taxonomy_mapping' WHEN 2 THEN 'schema_drift' END AS review_reason,
  CASE WHEN stage = 0 THEN 'loaded' ELSE 'review_required' END AS ingest_status
FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY stage, score, n) AS rn FROM (SELECT *, CASE stage WHEN 2 THEN drift_score WHEN 1 THEN 1 + mismatches ELSE 0 END AS score
  FROM (SELECT c.*, CASE WHEN drift_score > 0 THEN 2 WHEN coalesce(k, 0) > 0 THEN 1 ELSE 0 END AS stage, coalesce(k, 0) AS mismatches FROM cand c LEFT JOIN (SELECT source_file_id, count(*) AS k FROM issues GROUP BY 1) USING (source_file_id)))) WHERE rn = 1"""),
    "review_detail": with_ctes(FILES, LINES, OBS, TAX, ISSUES, PROFILES, DECIDED, query="""SELECT source_file_id, mapping_version_id, 'schema_drift' AS review_reason, row_number() OVER (PARTITION BY source_file_id ORDER BY k) AS position, property, expected, actual, CAST(NULL AS BIGINT) AS source_row_number
FROM (SELECT d.source_file_id, d.mapping_version_id, unnest([{'k': 1, 'property': 'asset_classes', 'expected': array_to_string(v.classes, '|'), 'actual': array_to_string(p.classes, '|'), 'differs': p.classes <> v.classes},
    {'k': 2, 'property': 'internal_external', 'expected': array_to_string(v.styles, '|'), 'actual': array_to_string(p.styles, '|'), 'differs': p.styles <> v.styles},
    {'k': 3, 'property': 'option_names', 'expected': CASE WHEN v.total THEN 'Total' ELSE '' END, 'actual': CASE WHEN p.has_total THEN 'Total' ELSE '' END, 'differs': v.total IS NOT NULL AND p.has_total <> v.total}], recursive := true)
  FROM dec d JOIN profiles p USING (source_file_id) JOIN vers v USING (n) WHERE stage = 2) WHERE differs
UNION ALL SELECT source_file_id, mapping_version_id, 'unapproved_taxonomy_mapping', rank, reason, expected, actual, CAST(source_row_number AS BIGINT) FROM (
  SELECT i.*, d.mapping_version_id, row_number() OVER (PARTITION BY i.source_file_id ORDER BY source_row_number, holding_key, p) AS rank FROM issues i JOIN dec d USING (source_file_id) WHERE stage = 1) WHERE rank <= 10"""),
    "review_status": """WITH i AS (SELECT o_orderkey AS item_id, o_custkey, o_orderpriority AS pr, o_totalprice >= 1000 AS printed, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS turn FROM orders WHERE o_orderstatus = 'P')
SELECT item_id, CASE WHEN pr = '1-URGENT' THEN 'resolved' WHEN pr = '2-HIGH' THEN 'rejected' WHEN pr = '3-MEDIUM' AND turn = 1 AND printed THEN 'resolved' ELSE 'open' END AS new_status,
  CASE WHEN pr = '3-MEDIUM' AND turn = 1 AND printed THEN 'm-' || CAST(o_custkey AS VARCHAR) END AS approved_version FROM i""",
    "review_queue_open": with_ctes(FILES, query="SELECT o_orderkey AS source_file_id, 'open' AS status, fund_code, fund_name, received_on FROM orders JOIN files0 ON o_orderkey = source_file_id WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'"),
    "duplicate_view_merge": with_ctes(FILES, LINES, OBS, VIEWS, query=f"""SELECT holding_key, view_role, m AND view_role = 'precise' AS is_merged, CASE WHEN m AND view_role = 'precise' THEN coalesce(classification_raw, mc) ELSE classification_raw END AS classification_raw,
  CASE WHEN m AND view_role = 'precise' THEN coalesce(value_band_raw, mb) ELSE value_band_raw END AS value_band_raw, precise_rows, metadata_rows, CASE WHEN m AND view_role = 'precise' THEN first_row END AS first_metadata_row
FROM (SELECT v.*, g.* EXCLUDE ({VIEW_BY}), precise_rows = 1 AND metadata_rows > 0 AS m FROM views v JOIN (
    SELECT {VIEW_BY}, count(*) FILTER (view_role = 'precise') AS precise_rows, count(*) FILTER (view_role = 'metadata') AS metadata_rows, min(holding_key) FILTER (view_role = 'metadata') AS first_row,
      arg_min(classification_raw, holding_key) FILTER (view_role = 'metadata' AND classification_raw IS NOT NULL) AS mc, arg_min(value_band_raw, holding_key) FILTER (view_role = 'metadata' AND value_band_raw IS NOT NULL) AS mb FROM views GROUP BY ALL) g USING ({VIEW_BY}))
WHERE NOT (m AND view_role = 'metadata')"""),
    "duplicate_view_events": with_ctes(FILES, LINES, OBS, VIEWS, query=f"""SELECT {VIEW_BY}, count(*) AS group_rows, 'multiple_precise_rows_within_group' AS reason FROM views GROUP BY ALL HAVING count(*) FILTER (view_role = 'precise') > 1
UNION ALL SELECT fund_code, option_code, reporting_period, NULL, name_key, count(*), 'same_name_value_rows_across_asset_classes' FROM views WHERE value_aud IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_asset_class_raw) > 1"""),
    "fill_forward_state": """SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS BIGINT) AS user_turn, last_value(CASE WHEN role = 'user' THEN sha256(text) END IGNORE NULLS) OVER w AS user_text
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "sample_rows": """SELECT * FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS rank, line_number, sha256(line) AS line_hash
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_number FROM documents) WHERE NOT regexp_full_match(line, '\\s*')) WHERE rank <= 20""",
    "period_consistency": with_ctes(FILES, LINES, query=f"""SELECT source_file_id, count(*) FILTER (rp <> reporting_period) AS rows_off_period, count(DISTINCT rp) AS row_periods, count(*) AS row_count
FROM (SELECT source_file_id, {half('row_date')} AS rp FROM lines) JOIN files0 USING (source_file_id) GROUP BY 1"""),
    "manifest_files": with_ctes(FILES, LINES, MANIFEST, query="SELECT * FROM both_sides"),
    "manifest_reconcile": with_ctes(FILES, LINES, MANIFEST, query="""SELECT *, abs(expected_rows - observed_rows) AS row_delta, abs(expected_rows - observed_rows) <= 500 AS is_within_tolerance FROM (
  SELECT fund_code, count(expected_rows) AS expected_files, count(observed_rows) AS observed_files, CAST(coalesce(sum(expected_rows), 0) AS BIGINT) AS expected_rows, CAST(coalesce(sum(observed_rows), 0) AS BIGINT) AS observed_rows, count(*) FILTER (status <> 'ok') AS files_off
  FROM both_sides WHERE fund_code IS NOT NULL GROUP BY 1)"""),
}
