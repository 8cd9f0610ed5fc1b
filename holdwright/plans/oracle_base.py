"""Shared SQL views for checking the queries with another engine."""

from __future__ import annotations

NAME = "concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))"


def norm(c: str) -> str:
    return rf"replace(replace(lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"


def half(d: str) -> str:
    return f"CASE WHEN month({d}) <= 6 THEN make_date(year({d}), 6, 30) ELSE make_date(year({d}), 12, 31) END"


FILES = f"""
files0 AS (
  SELECT o_orderkey AS source_file_id, n_name AS fund_code, 'Fund ' || CAST(n_nationkey AS VARCHAR) AS fund_name,
         CAST(c_custkey AS VARCHAR) AS option_code, c_name AS option_name, lower(c_mktsegment) AS layout_key,
         {half('o_orderdate')} AS reporting_period, CAST(o_orderdate AS DATE) AS received_on,
         CASE WHEN o_orderstatus = 'P' THEN 'review_required' ELSE 'loaded' END AS ingest_status,
         CAST(o_totalprice AS DECIMAL(24,9)) AS declared_total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
files AS (
  SELECT *, ingest_status <> 'loaded' OR row_number() OVER (
      PARTITION BY option_code, reporting_period, ingest_status ORDER BY received_on DESC, source_file_id DESC) = 1 AS is_current
  FROM files0)"""

LINES = """
lines AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS holding_key,
    l_orderkey AS source_file_id, l_linenumber AS source_row_number, l_partkey AS part_id, CAST(l_shipdate AS DATE) AS row_date,
    l_linenumber <> 7 AS has_name, l_linenumber = 7 AS is_aggregate,
    CASE WHEN l_tax < 0.07 THEN CAST(l_extendedprice AS DECIMAL(24,9)) END AS value_aud,
    CASE WHEN l_discount <= 0.02 THEN CAST(l_discount AS DECIMAL(18,9)) END AS ownership_pct,
    CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(30,12)) END AS units,
    CASE l_returnflag WHEN 'A' THEN 'Internally Managed' WHEN 'R' THEN 'Externally Managed' END AS source_subclass_raw,
    CASE WHEN l_quantity > 40 THEN CASE WHEN l_linenumber % 2 = 1 THEN 'ISIN' ELSE 'ABN' END END AS identifier_type,
    CASE WHEN l_quantity > 40 THEN CASE WHEN l_linenumber % 2 = 1 THEN 'AU' || pk
      ELSE '0' || substr(pk, 1, 1) || ' ' || substr(pk, 2, 3) || ' ' || substr(pk, 5, 3) || ' ' || substr(pk, 8, 3) END END AS identifier_value,
    CASE WHEN l_tax >= 0.07 AND l_discount >= 0.08 THEN 'Band 1' END AS value_band_raw,
    CASE WHEN l_linenumber = 7 THEN 'aggregate_total'
      WHEN l_tax < 0.07 AND (l_discount <= 0.02 OR l_quantity > 40 OR l_linestatus = 'O') THEN 'fully_disclosed'
      WHEN l_tax < 0.07 THEN 'value_only' WHEN l_discount <= 0.02 THEN 'ownership_only' ELSE 'name_only' END AS disclosure_completeness,
    CASE WHEN l_quantity <= 25 THEN l_partkey * 2 WHEN l_quantity <= 30 THEN l_suppkey * 2 + 1 END AS entity_id,
    CASE WHEN l_returnflag = 'R' THEN l_suppkey * 2 + 1 END AS manager_entity_id,
    CASE WHEN l_returnflag = 'A' AND l_discount >= 0.07 THEN l_partkey * 2 END AS issuer_entity_id,
    CASE WHEN l_linenumber = 1 AND l_discount >= 0.09 THEN l_partkey * 2 END AS issuer_bridge_id,
    CASE WHEN l_quantity < 5 THEN 'Fund Manager' WHEN l_quantity < 20 THEN 'Grade ' || l_linestatus END AS classification_raw,
    l_quantity AS quantity
  FROM (SELECT *, lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS pk FROM lineitem))"""

OBS = f"""
obs AS (
  SELECT lines.*, files.* EXCLUDE (source_file_id, declared_total),
    CASE WHEN is_aggregate THEN NULL WHEN source_row_number % 3 = 0 THEN upper({NAME})
      WHEN source_row_number % 3 = 1 THEN '  ' || replace({NAME}, ' ', '  ') || ' ' ELSE {NAME} END AS raw_name,
    p_type AS source_asset_class_raw,
    CASE p_type WHEN 'STANDARD' THEN 'listed_equity' WHEN 'MEDIUM' THEN 'unlisted_equity' WHEN 'ECONOMY' THEN 'fixed_income'
      WHEN 'SMALL' THEN 'unlisted_infrastructure' WHEN 'LARGE' THEN 'unlisted_property' WHEN 'PROMO' THEN 'private_debt' END AS asset_class_code
  FROM lines JOIN files USING (source_file_id) LEFT JOIN part ON part_id = p_partkey
  WHERE ingest_status = 'loaded'),
cur AS (SELECT * FROM obs WHERE is_current AND ingest_status = 'loaded' AND NOT is_aggregate),
named AS (SELECT * FROM cur WHERE has_name)"""

LATEST = """
periods AS (SELECT DISTINCT fund_code, reporting_period FROM named),
latest AS (SELECT fund_code, max(reporting_period) AS latest_period FROM periods GROUP BY 1)"""

KIND_OF_TYPE = "CASE p_type WHEN 'SMALL' THEN 'infrastructure_asset' WHEN 'LARGE' THEN 'property_asset' WHEN 'PROMO' THEN 'fund_vehicle' ELSE 'company' END"

ENTITIES = f"""
entities AS (
  SELECT p_partkey * 2 AS entity_id, {KIND_OF_TYPE} AS entity_type, {NAME} AS canonical_name,
    lpad(CAST(p_partkey - CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR), 11, '0') AS abn,
    CASE WHEN p_size <= 10 THEN 'seeded' WHEN p_size <= 20 THEN 'high' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 40 THEN 'low' END AS confidence_tier
  FROM part
  UNION ALL
  SELECT s_suppkey * 2 + 1, 'manager', s_name, NULL, CASE WHEN s_nationkey < 10 THEN 'seeded' WHEN s_nationkey < 15 THEN 'high' END FROM supplier),
aliases AS (
  SELECT entity_id, alias, is_preferred, {norm('alias')} AS alias_normalized FROM (
    SELECT p_partkey * 2 AS entity_id, concat_ws(' ', p_name, p_brand) AS alias, true AS is_preferred FROM part
    UNION ALL SELECT p_partkey * 2, upper({NAME}), false FROM part
    UNION ALL SELECT s_suppkey * 2 + 1, replace(s_name, '#', ' No '), true FROM supplier)),
enames AS (
  SELECT DISTINCT entity_id, entity_type, name_key FROM (
    SELECT entity_id, entity_type, {norm('canonical_name')} AS name_key FROM entities
    UNION ALL SELECT a.entity_id, e.entity_type, alias_normalized FROM aliases a JOIN entities e ON a.entity_id = e.entity_id)
  WHERE name_key <> '')"""

OVERRIDES = f"""
ov0 AS (
  SELECT p_partkey AS override_id, {norm(NAME)} AS name_key,
    CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'NATION_' || CAST(p_size - 36 AS VARCHAR) END AS fund_code,
    CASE WHEN p_type IN ('SMALL', 'PROMO', 'STANDARD') THEN p_type END AS asset_class_scope,
    CASE WHEN p_size IN (40, 45, 50) THEN {KIND_OF_TYPE} END AS entity_type_scope,
    CASE p_size % 4 WHEN 0 THEN 'force_match' WHEN 1 THEN 'force_no_match' WHEN 2 THEN 'force_new_entity' ELSE 'redirect_to_parent' END AS action,
    CASE WHEN p_size % 4 IN (0, 3) THEN p_partkey * 2 END AS matched_entity_id,
    CASE WHEN p_size >= 48 THEN DATE '1999-12-31' END AS expires_at, p_size
  FROM part WHERE p_size > 35),
overrides AS (
  SELECT * EXCLUDE (p_size) FROM ov0
  UNION ALL SELECT -override_id, name_key, NULL, asset_class_scope, entity_type_scope, action, matched_entity_id, expires_at FROM ov0 WHERE p_size > 43)"""


def with_ctes(*ctes: str, query: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + query
