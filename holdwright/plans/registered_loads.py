"""Registered queries of gated loads and matched assets, with their SQL."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.functions.identifiers import json_digest
from holdwright.operators import reconcile, versions
from holdwright.plans.assets import Assets
from holdwright.plans.binding import DriverTables
from holdwright.plans.corpus import Corpus, current_named
from holdwright.plans.oracle_base import ENTITIES, FILES, LINES, OBS, norm, with_ctes
from holdwright.plans.registered_governance import CELLS, _cells
from holdwright.plans.registered_links import FIRST_BATCH_END, _early
from holdwright.plans.registered_resolution import NEW_ID
from holdwright.session import checkpoint_dir, written_once
from holdwright.sources.store import Store
from holdwright.vocab import GEO


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{checkpoint_dir(spark)}/loads-{uuid.uuid4().hex}")


# --- loads by manifest ---------------------------------------------------------


def _staged(t: DriverTables) -> DataFrame:
    return _cells(t.table("lineitem")).withColumn("source_row_hash", json_digest(F.col("cells")))


def _gated(t: DriverTables) -> DataFrame:
    """Files of a landing against a manifest in which some are left out, listed twice, or listed with other counts and versions."""
    ident = F.col("source_file_id")
    counted = t.lines.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("lines"))
    files = t.registered.join(counted, "source_file_id", "left").fillna(0, ["lines"]).select("option_code", "source_file_id", "layout_key", "ingest_status", "lines")
    copies = F.when(ident % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    manifest = files.where(ident % 89 != 0).select(
        "option_code", "source_file_id", (F.col("lines") + F.when(ident % 83 == 0, 1).otherwise(0)).alias("expected_rows"), F.concat(F.lit("v-"), "layout_key").alias("expected_version"), F.explode(copies).alias("copy")
    )
    landed = files.where(ident % 73 != 0).select(
        "option_code", "source_file_id", "ingest_status", F.when(F.col("ingest_status") == "loaded", F.col("lines")).otherwise(0).alias("observed_rows"),
        F.when(ident % 79 == 0, F.lit("v-old")).otherwise(F.concat(F.lit("v-"), "layout_key")).alias("observed_version"),
    )
    return reconcile.gated_files(manifest, landed, ["option_code", "source_file_id"])


def manifest_gate_files(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(DriverTables(spark, sf))


def manifest_load(spark: SparkSession, sf: str) -> DataFrame:
    """Options as batches: those the gate lets through are stored; what it found, and the rows readers see."""
    t = DriverTables(spark, sf)
    files = written_once(_gated(t))
    number = F.col("option_code").cast("bigint")
    declared = files.where(F.col("expected_rows").isNotNull()).groupBy("option_code").agg(
        F.count(F.lit(1)).alias("expected_source_file_count"), (F.sum("expected_rows") + F.when(F.first("option_code").cast("bigint") % 10 == 0, 3).otherwise(0)).alias("expected_row_count")
    ).where(number % 11 != 0).withColumn("row_count_tolerance", F.lit(2).cast("bigint"))
    batches = written_once(reconcile.gated_batches(files, declared, ["option_code"]))
    allowed = files.join(batches.where("is_published").select("option_code"), "option_code", "left_semi").select("source_file_id", "option_code")
    rows = _store(spark).write("holdings", versions.rows_to_append(_staged(t).drop("cells")).join(allowed, "source_file_id"), 1)
    stored = rows.groupBy("option_code").agg(F.count(F.lit(1)).alias("rows_published"), F.count_distinct("source_file_id").alias("files_published"))
    return batches.join(stored, "option_code", "left").fillna(0, ["rows_published", "files_published"])


# --- matched assets ------------------------------------------------------------


def _placed(spark: SparkSession, sf: str) -> Corpus:
    """The corpus with addresses and coordinates, some of them missing, half, out of range or at odds; some entities unknown or of another type."""
    corpus, part, q = DriverTables(spark, sf).corpus, F.col("part_id"), F.col("quantity")
    odd = F.col("source_row_number") % 2
    lat = (part * 7) % 186 - 93 + F.when(part % 17 == 0, odd).otherwise(0)
    rows = corpus.observations.withColumns(
        {
            "address_raw": F.when(part % 3 == 0, F.lit(None).cast("string")).when(part % 5 == 0, F.concat(F.lit("Pier "), odd.cast("string"))).otherwise("  Pier  1 "),
            "location_raw": F.when(part % 2 == 0, F.lit("Harbour")),
            "geo_lat": F.when(~q.isin(13, 14), lat.cast(GEO)),
            "geo_lng": F.when(~q.isin(14, 15), ((part * 13) % 362 - 181).cast(GEO)),
        }
    )
    known = corpus.entities.where(F.col("entity_id") % 8 != 0).withColumn("entity_type", F.when(F.col("entity_id") % 10 == 0, "company").otherwise(F.col("entity_type")))
    return dataclasses.replace(corpus, observations=rows, entities=known)


#: What the runs need of a holding.
SEEN = ["holding_key", "raw_name", "asset_class_code", "address_raw", "location_raw", "geo_lat", "geo_lng", "reporting_period", "is_current", "ingest_status", "is_aggregate", "has_name"]


def _two_runs(spark: SparkSession, sf: str) -> tuple[Corpus, Assets, DataFrame]:
    """Both runs read one written copy of what they need of the current rows, so the star join is made once for them."""
    corpus, state = _placed(spark, sf), Assets(_store(spark))
    seen = dataclasses.replace(corpus, observations=written_once(current_named(corpus).select(*SEEN)))
    state.run(_early(seen), 1)
    later = dataclasses.replace(seen, entities=state.entities(corpus.entities))
    return corpus, state, state.run(later, 2)[0]


def asset_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What a run over all holdings does with each, after one over the earlier periods."""
    return _two_runs(spark, sf)[2].select("holding_key", "name_key", "place_key", "outcome", "asset_entity_id")


def asset_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Assets that both runs made or adopted."""
    return _two_runs(spark, sf)[1].assets.rows().withColumn("run", F.col("run").cast("bigint"))


def matched_asset_list(spark: SparkSession, sf: str) -> DataFrame:
    """Matched holdings with coordinates."""
    corpus, state, _ = _two_runs(spark, sf)
    keep = ["asset_entity_id", "asset_name", "entity_type", "holding_key", "fund_code", "option_code", "option_name", "reporting_period", "asset_class_code", "disclosure_completeness", "ownership_pct",
            "address_raw", "location_raw", "geo_lat", "geo_lng", "confidence_score", "relationship_source", "source_file_id"]
    return state.matched(corpus).select(*keep)


QUERIES = {
    "manifest_gate_files": manifest_gate_files,
    "manifest_load": manifest_load,
    "asset_outcomes": asset_outcomes,
    "asset_entities": asset_entities,
    "matched_asset_list": matched_asset_list,
}


# --- SQL -----------------------------------------------------------------------

GATE = """
counted AS (SELECT f.option_code, f.source_file_id, layout_key, ingest_status, count(l.source_file_id) AS lines FROM files0 f LEFT JOIN lines l USING (source_file_id) GROUP BY ALL),
gated AS (
  SELECT option_code, source_file_id, CASE WHEN listed THEN lines + CASE WHEN source_file_id % 83 = 0 THEN 1 ELSE 0 END END AS expected_rows, CASE WHEN listed THEN 'v-' || layout_key END AS expected_version,
    CASE WHEN landed THEN CASE WHEN ingest_status = 'loaded' THEN lines ELSE 0 END END AS observed_rows,
    CASE WHEN landed THEN CASE WHEN source_file_id % 79 = 0 THEN 'v-old' ELSE 'v-' || layout_key END END AS observed_version,
    CASE WHEN listed AND source_file_id % 97 = 0 THEN 'listed_twice' WHEN landed AND ingest_status <> 'loaded' THEN 'rejected' WHEN NOT landed THEN 'missing' WHEN NOT listed THEN 'unlisted'
      WHEN source_file_id % 83 = 0 THEN 'row_count' WHEN source_file_id % 79 = 0 THEN 'mapping_version' ELSE 'ok' END AS status
  FROM (SELECT *, source_file_id % 89 <> 0 AS listed, source_file_id % 73 <> 0 AS landed FROM counted) WHERE listed OR landed)"""

_PAIR = "format('{:.8f}', CAST({c} AS DOUBLE))"
PLACED = f"""
ents AS (SELECT entity_id, CASE WHEN entity_id % 10 = 0 THEN 'company' ELSE entity_type END AS entity_type, canonical_name FROM entities WHERE entity_id % 8 <> 0),
given AS (SELECT {norm('canonical_name')} AS name_key, count(*) AS n, min(entity_id) AS id, min(entity_type) AS t FROM ents GROUP BY 1),
geo AS (
  SELECT *, CASE WHEN part_id % 3 = 0 THEN NULL WHEN part_id % 5 = 0 THEN 'Pier ' || CAST(source_row_number % 2 AS VARCHAR) ELSE '  Pier  1 ' END AS address_raw, CASE WHEN part_id % 2 = 0 THEN 'Harbour' END AS location_raw,
    CASE WHEN quantity NOT IN (13, 14) THEN CAST((part_id * 7) % 186 - 93 + CASE WHEN part_id % 17 = 0 THEN source_row_number % 2 ELSE 0 END AS DECIMAL(12,8)) END AS geo_lat,
    CASE WHEN quantity NOT IN (14, 15) THEN CAST((part_id * 13) % 362 - 181 AS DECIMAL(12,8)) END AS geo_lng
  FROM named WHERE asset_class_code IN ('unlisted_property', 'unlisted_infrastructure')),
ar AS (
  SELECT *, nullif({norm('raw_name')}, '') AS name_key, CASE asset_class_code WHEN 'unlisted_property' THEN 'property_asset' ELSE 'infrastructure_asset' END AS kind,
    coalesce({norm('address_raw')}, {norm('location_raw')}, {_PAIR.replace('{c}', 'geo_lat')} || ',' || {_PAIR.replace('{c}', 'geo_lng')}) AS place_key,
    CASE WHEN {norm('raw_name')} = '' THEN 'no_name' WHEN geo_lat IS NULL AND geo_lng IS NULL THEN 'no_coordinates' WHEN geo_lat IS NULL OR geo_lng IS NULL THEN 'half_a_pair'
      WHEN abs(geo_lat) > 90 OR abs(geo_lng) > 180 THEN 'out_of_range' END AS problem
  FROM geo)"""


def _keys(run: int, rows: str, known: str) -> str:
    return f"""
k{run} AS (
  SELECT k.*, CASE WHEN {known} THEN 'known' WHEN kinds > 1 THEN 'conflicting_types' WHEN pairs > 1 THEN 'conflicting_coordinates' WHEN n > 1 THEN 'several_entities' WHEN t <> kind THEN 'other_type'
      WHEN n IS NOT NULL AND places > 1 THEN 'several_places' WHEN n IS NOT NULL THEN 'adopted' ELSE 'created' END AS status, id
  FROM (SELECT *, count(*) OVER (PARTITION BY name_key) AS places FROM (
    SELECT name_key, place_key, count(DISTINCT CAST(geo_lat AS VARCHAR) || ',' || CAST(geo_lng AS VARCHAR)) AS pairs, count(DISTINCT kind) AS kinds, min(kind) AS kind, min(geo_lat) AS geo_lat, min(geo_lng) AS geo_lng,
      arg_min(raw_name, holding_key) AS canonical_name FROM ar WHERE problem IS NULL AND {rows} GROUP BY 1, 2)) k LEFT JOIN given USING (name_key)),
new{run} AS (SELECT name_key, place_key, kind, canonical_name, geo_lat, geo_lng, status, CASE status WHEN 'adopted' THEN id ELSE {NEW_ID.format(kind='asset', key="name_key || '|' || place_key")} END AS entity_id, CAST({run} AS BIGINT) AS run
  FROM k{run} WHERE status IN ('adopted', 'created'))"""


EARLY = f"reporting_period <= DATE '{FIRST_BATCH_END}'"
ASSETS = (
    _keys(1, EARLY, "false"),
    _keys(2, "true", "EXISTS (SELECT 1 FROM new1 WHERE new1.name_key = k.name_key AND new1.place_key = k.place_key)"),
    f"""
assets AS (SELECT * FROM new1 UNION ALL SELECT * FROM new2),
outcome AS (
  SELECT ar.*, a.entity_id AS asset, a.canonical_name, CASE WHEN problem IS NOT NULL THEN problem WHEN a.entity_id IS NULL THEN k2.status WHEN ar.geo_lat <> a.geo_lat OR ar.geo_lng <> a.geo_lng THEN 'other_coordinates'
    WHEN a.run = 1 AND {EARLY} THEN 'present' ELSE 'linked' END AS outcome
  FROM ar LEFT JOIN assets a USING (name_key, place_key) LEFT JOIN k2 USING (name_key, place_key))""",
)
ALL = (FILES, LINES, OBS, ENTITIES, PLACED, *ASSETS)

SQL = {
    "manifest_gate_files": with_ctes(FILES, LINES, GATE, query="SELECT * FROM gated"),
    "manifest_load": with_ctes(FILES, LINES, CELLS, GATE, """
declared AS (SELECT option_code, count(*) AS expected_source_file_count, CAST(sum(expected_rows) + CASE WHEN CAST(option_code AS BIGINT) % 10 = 0 THEN 3 ELSE 0 END AS BIGINT) AS expected_row_count, CAST(2 AS BIGINT) AS row_count_tolerance
  FROM gated WHERE expected_rows IS NOT NULL AND CAST(option_code AS BIGINT) % 11 <> 0 GROUP BY 1),
rolled AS (SELECT option_code, count(*) FILTER (status <> 'ok') AS files_off, count(*) FILTER (status = 'ok') AS files_ok, CAST(coalesce(sum(observed_rows), 0) AS BIGINT) AS rows_staged FROM gated GROUP BY 1),
told AS (SELECT *, abs(rows_staged - expected_row_count) AS row_delta, coalesce(files_off = 0 AND files_ok = expected_source_file_count AND abs(rows_staged - expected_row_count) <= row_count_tolerance, false) AS is_published
  FROM declared FULL JOIN rolled USING (option_code)),
held AS (SELECT option_code, count(DISTINCT source_row_hash || '|' || CAST(source_file_id AS VARCHAR)) AS rows_published, count(DISTINCT source_file_id) AS files_published
  FROM gated JOIN told USING (option_code) JOIN cells USING (source_file_id) WHERE is_published GROUP BY 1)""", query="""
SELECT told.*, coalesce(rows_published, 0) AS rows_published, coalesce(files_published, 0) AS files_published FROM told LEFT JOIN held USING (option_code)"""),
    "asset_outcomes": with_ctes(*ALL, query="SELECT holding_key, name_key, place_key, outcome, asset AS asset_entity_id FROM outcome"),
    "asset_entities": with_ctes(*ALL, query="SELECT name_key, place_key, entity_id, kind AS entity_type, canonical_name, 'seeded' AS confidence_tier, geo_lat, geo_lng, status AS origin, run FROM assets"),
    "matched_asset_list": with_ctes(*ALL, query="""
SELECT o.asset AS asset_entity_id, n.asset_name, n.entity_type, holding_key, fund_code, option_code, option_name, reporting_period, asset_class_code, disclosure_completeness, ownership_pct, address_raw, location_raw, geo_lat, geo_lng,
  CAST(1 AS DECIMAL(6,5)) AS confidence_score, 'asset_coordinates' AS relationship_source, source_file_id
FROM outcome o JOIN (SELECT entity_id, min(canonical_name) AS asset_name, min(kind) AS entity_type FROM assets GROUP BY 1) n ON o.asset = n.entity_id WHERE outcome IN ('linked', 'present')"""),
}
