"""SQL of every registered query that SQL can express."""

from __future__ import annotations

from holdwright.plans import registered_functions, registered_governance, registered_ingest, registered_layouts, registered_links, registered_loads, registered_resolution
from holdwright.plans.oracle_base import ENTITIES, FILES, LATEST, LINES, OBS, norm, with_ctes

BASE = (FILES, LINES, OBS)
NORM_RAW = norm("raw_name")
T = "DECIMAL(38,9)"
RANK = "CASE disclosure_completeness WHEN 'fully_disclosed' THEN 0 WHEN 'value_only' THEN 1 WHEN 'ownership_only' THEN 2 WHEN 'name_only' THEN 3 WHEN 'aggregate_total' THEN 4 ELSE 999 END"


def base(query: str, *more: str) -> str:
    return with_ctes(*BASE, *more, query=query)


def total(c: str, alias: str) -> str:
    return f"CAST(coalesce(sum({c}), 0) AS {T}) AS {alias}"


ROLE = "(SELECT * FROM (SELECT unnest(list_distinct([{ids}])) AS owner, n.* FROM {src} n) WHERE owner IS NOT NULL)"
LINKS4 = "entity_id, manager_entity_id, issuer_entity_id, issuer_bridge_id"


def exploded(ids: str, src: str = "named") -> str:
    return ROLE.format(ids=ids, src=src)


EXPLORER = """SELECT owner AS entity_id, entity_type, canonical_name AS entity_name, count(DISTINCT fund_code) AS fund_count,
  count(DISTINCT option_code) AS option_count, CAST(count(*) AS BIGINT) AS row_count, {tot}, CAST(count(ownership_pct) AS BIGINT) AS ownership_count,
  CAST(sum(CASE WHEN disclosure_completeness = 'fully_disclosed' THEN 1 ELSE 0 END) AS BIGINT) AS fully_disclosed_count,
  CAST(sum(CASE WHEN disclosure_completeness = 'value_only' THEN 1 ELSE 0 END) AS BIGINT) AS value_only_count,
  CAST(sum(CASE WHEN disclosure_completeness = 'ownership_only' THEN 1 ELSE 0 END) AS BIGINT) AS ownership_only_count,
  CAST(sum(CASE WHEN disclosure_completeness = 'name_only' THEN 1 ELSE 0 END) AS BIGINT) AS name_only_count,
  {full}, {part}
FROM {rows} x JOIN entities e ON e.entity_id = x.owner {where} GROUP BY 1, 2, 3"""


def explorer(where: str = "") -> str:
    return EXPLORER.format(
        tot=total("value_aud", "total_value_aud"),
        full=total("CASE WHEN disclosure_completeness = 'fully_disclosed' THEN value_aud END", "fully_disclosed_value"),
        part=total("CASE WHEN disclosure_completeness = 'value_only' THEN value_aud END", "value_only_value"),
        rows=exploded("entity_id, manager_entity_id, issuer_entity_id", "cur"),
        where=where,
    )


def slices(dims: str, links: str = LINKS4) -> str:
    """Every (entity, holding) pair by link or by name, once."""
    ids = [c.strip() for c in links.split(",")]
    linked = " OR ".join(f"coalesce(n.{c} = e.entity_id, false)" for c in ids)
    return f"""pairs AS (
  SELECT owner AS entity_id, holding_key, {dims} FROM {exploded(links)}
  UNION
  SELECT e.entity_id, n.holding_key, {', '.join('n.' + d.strip() for d in dims.split(','))} FROM named n JOIN enames e ON {norm('n.raw_name')} = e.name_key
  WHERE NOT ({linked}))"""


FUND_KIND = """CASE WHEN ownership_pct IS NOT NULL OR disclosure_completeness = 'fully_disclosed' THEN 'direct_holding'
  WHEN coalesce(entity_type = 'manager', false) THEN 'manager_rollup'
  WHEN coalesce(contains(lower(classification_raw), 'manager'), false) THEN 'manager_rollup'
  WHEN disclosure_completeness = 'value_only' AND coalesce(lower(source_subclass_raw) = 'externally managed', false) THEN 'manager_rollup'
  ELSE 'unknown' END"""
TIER = """CASE confidence_tier WHEN 'seeded' THEN 'Reviewed' WHEN 'high' THEN 'High Confidence' WHEN 'medium' THEN 'Medium Confidence'
  WHEN 'low' THEN 'Low Confidence' ELSE 'Linked' END"""
OWNER_ROWS = f"""mo AS (
  SELECT owner AS owner_id, canonical_name, confidence_tier, x.*, same_m OR (same_e AND kind = 'manager_rollup') AS is_manager_role, same_e AS is_direct, same_i OR same_b AS is_issuer
  FROM (SELECT o.*, coalesce(manager_entity_id = owner, false) AS same_m, coalesce(entity_id = owner, false) AS same_e,
      coalesce(issuer_entity_id = owner, false) AS same_i, coalesce(issuer_bridge_id = owner, false) AS same_b,
      CASE WHEN coalesce(manager_entity_id = owner, false) THEN 'manager_rollup' WHEN coalesce(issuer_entity_id = owner, false) THEN 'direct_holding'
        WHEN ownership_pct IS NOT NULL OR disclosure_completeness = 'fully_disclosed' THEN 'direct_holding'
        WHEN coalesce(lower(source_subclass_raw) = 'externally managed', false) THEN 'manager_rollup'
        WHEN coalesce(contains(lower(classification_raw), 'manager'), false) THEN 'manager_rollup' ELSE 'unknown' END AS kind
    FROM {exploded(LINKS4)} o) x JOIN entities e ON e.entity_id = owner AND e.entity_type = '{{kind}}')"""
MANAGER_ROWS = OWNER_ROWS.format(kind="manager")


def owner_rows(kind: str, role: str) -> str:
    return base(f"""SELECT owner_id, holding_key, kind AS observation_kind, {role} AS is_manager_role, is_direct, is_issuer, CASE WHEN {role} THEN 'manager' WHEN is_direct THEN 'direct' ELSE 'issuer' END AS first_role,
  value_aud IS NULL AND ownership_pct IS NULL AS is_non_precise, value_band_raw IS NOT NULL AS is_value_band,
  CASE WHEN is_direct THEN {TIER} WHEN k.name_key IS NOT NULL AND raw_name <> canonical_name THEN 'Observed Alias' WHEN k.name_key IS NOT NULL THEN 'Linked' ELSE 'Unresolved' END AS confidence_label
FROM mo LEFT JOIN enames k ON k.entity_id = owner_id AND k.name_key = {norm('raw_name')}""", ENTITIES, OWNER_ROWS.format(kind=kind))


SUBJECTS = """subjects AS (
  SELECT 'fund' AS kind, fund_name AS title, CAST(NULL AS BIGINT) AS entity_id, fund_code, 'fund_code' AS matched_on, fund_code AS candidate, 0 AS place, 240 AS priority FROM (SELECT DISTINCT fund_code, fund_name FROM files)
  UNION ALL SELECT 'fund', fund_name, NULL, fund_code, 'fund_name', fund_name, 1, 180 FROM (SELECT DISTINCT fund_code, fund_name FROM files)
  UNION ALL SELECT entity_type, canonical_name, entity_id, NULL, 'canonical_name', canonical_name, 0, 200 FROM entities WHERE entity_type IN ('company', 'manager')
  UNION ALL SELECT entity_type, canonical_name, e.entity_id, NULL, 'alias', alias, CASE WHEN is_preferred THEN 1 ELSE 2 END, 160
    FROM entities e JOIN aliases a ON e.entity_id = a.entity_id WHERE entity_type IN ('company', 'manager')),
matches AS (
  SELECT kind, title, entity_id, fund_code, score, matched_on, candidate AS matched_value FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, title, entity_id, fund_code ORDER BY score DESC, place, candidate) AS rn FROM (
      SELECT *, priority + CASE WHEN {n} = '{q}' THEN 400 WHEN {f} = '{q}' THEN 380 WHEN starts_with({n}, '{q}') THEN 300
        WHEN starts_with({f}, '{q}') THEN 280 WHEN contains({n}, '{q}') THEN 200 WHEN contains({f}, '{q}') THEN 180 END AS score FROM subjects)
    WHERE score IS NOT NULL) WHERE rn = 1)"""
SUBJECTS = SUBJECTS.format(n=norm("candidate"), f="lower(trim(candidate))", q="large r")


def note(c: str) -> str:
    return f"""CASE WHEN lag({c}) OVER w IS NULL THEN 'No prior loaded period yet' WHEN {c} > lag({c}) OVER w THEN 'Up ' || CAST({c} - lag({c}) OVER w AS VARCHAR) || ' vs prior'
  WHEN {c} < lag({c}) OVER w THEN 'Down ' || CAST(lag({c}) OVER w - {c} AS VARCHAR) || ' vs prior' ELSE 'Flat vs prior' END"""


READ_MODELS = {
    "asset_mix_by_disclosure": base(
        f"""SELECT fund_code, option_code, reporting_period, asset_class_code, disclosure_completeness, count(*) AS observation_count,
  count(value_aud) AS precise_rows, {total('value_aud', 'value_total')}, CAST({RANK} AS BIGINT) AS state_rank
FROM named JOIN latest USING (fund_code) WHERE reporting_period = latest_period GROUP BY 1, 2, 3, 4, 5""", LATEST),
    "file_list_counts": base("""SELECT source_file_id, fund_code, fund_name, layout_key, ingest_status, reporting_period, received_on, is_current, coalesce(n, 0) AS rows_loaded
FROM files LEFT JOIN (SELECT source_file_id, count(*) AS n FROM obs GROUP BY 1) USING (source_file_id)"""),
    "file_profile": base("""SELECT source_file_id, 'completeness' AS facet, disclosure_completeness AS facet_value, count(*) AS row_count FROM obs GROUP BY ALL
UNION ALL SELECT source_file_id, 'asset_class', asset_class_code, count(*) FROM obs GROUP BY ALL"""),
    "file_page": base("""SELECT * FROM (SELECT source_file_id, CAST(source_row_number AS BIGINT) AS source_row_number, holding_key, disclosure_completeness, value_aud, ownership_pct,
  row_number() OVER (PARTITION BY source_file_id ORDER BY source_row_number, holding_key) AS position,
  count(*) OVER (PARTITION BY source_file_id) AS total_rows, CAST(greatest(1, ceil(count(*) OVER (PARTITION BY source_file_id) / 3.0)) AS BIGINT) AS total_pages FROM obs)
WHERE position BETWEEN 4 AND 6"""),
    "corpus_stats": base("""SELECT (SELECT count(DISTINCT fund_code) FROM files WHERE is_current AND ingest_status = 'loaded') AS funds_loaded,
  (SELECT count(*) FROM files WHERE is_current AND ingest_status = 'loaded') AS source_files_loaded,
  (SELECT count(*) FROM obs WHERE is_current) AS holding_rows_loaded,
  (SELECT count(DISTINCT c.entity_id) FROM cur c JOIN entities e USING (entity_id) WHERE entity_type = 'company' AND confidence_tier = 'seeded') AS reviewed_companies,
  (SELECT count(DISTINCT c.entity_id) FROM cur c JOIN entities e USING (entity_id) WHERE entity_type = 'manager' AND confidence_tier = 'seeded') AS reviewed_managers""", ENTITIES),
    "period_counts_trend": base(f"""SELECT reporting_period, fund_count, company_count, manager_count, {note('fund_count')} AS fund_note, {note('company_count')} AS company_note, {note('manager_count')} AS manager_note
FROM (SELECT reporting_period, count(DISTINCT fund_code) AS fund_count FROM files WHERE is_current AND ingest_status = 'loaded' GROUP BY 1)
JOIN (SELECT reporting_period, count(DISTINCT CASE WHEN entity_type = 'company' THEN c.entity_id END) AS company_count, count(DISTINCT CASE WHEN entity_type = 'manager' THEN c.entity_id END) AS manager_count
  FROM cur c JOIN entities e USING (entity_id) GROUP BY 1) USING (reporting_period) WINDOW w AS (ORDER BY reporting_period)""", ENTITIES),
    "latest_prior_period": base("""SELECT fund_code, max(CASE WHEN r = 1 THEN reporting_period END) AS latest_period, max(CASE WHEN r = 2 THEN reporting_period END) AS prior_period
FROM (SELECT *, dense_rank() OVER (PARTITION BY fund_code ORDER BY reporting_period DESC) AS r FROM periods) GROUP BY 1""", LATEST),
    "fund_top10_buckets": base(f"""SELECT * FROM (SELECT fund_code, option_code, bucket, observation_kind, holding_key, raw_name, value_aud, ownership_pct, confidence_label,
  row_number() OVER (PARTITION BY fund_code, option_code, bucket ORDER BY value_aud IS NULL, coalesce(value_aud, 0) DESC, ownership_pct IS NULL, coalesce(ownership_pct, 0) DESC, lower(raw_name), holding_key) AS rank
FROM (SELECT *, unnest([CASE WHEN private AND observation_kind = 'direct_holding' THEN 'top_direct_private' END, CASE WHEN observation_kind = 'manager_rollup' THEN 'manager_level' END,
    CASE WHEN private AND observation_kind = 'unknown' THEN 'named_private' END, CASE WHEN private AND observation_kind = 'unknown' AND value_band_raw IS NOT NULL THEN 'value_band' END,
    CASE WHEN private AND observation_kind = 'unknown' AND value_band_raw IS NULL THEN 'other_named_private' END]) AS bucket
  FROM (SELECT n.*, asset_class_code IN ('private_debt', 'unlisted_equity', 'unlisted_infrastructure', 'unlisted_property') AS private, {FUND_KIND} AS observation_kind,
      CASE WHEN entity_type IS NULL THEN 'Unresolved' ELSE {TIER} END AS confidence_label
    FROM named n JOIN latest l ON n.fund_code = l.fund_code AND reporting_period = latest_period LEFT JOIN entities e ON n.entity_id = e.entity_id)) WHERE bucket IS NOT NULL) WHERE rank <= 10""", LATEST, ENTITIES),
    "entity_explorer": base(explorer(), ENTITIES),
    "entity_explorer_page": base(f"SELECT * FROM ({explorer()}) ORDER BY fund_count DESC, lower(entity_name), entity_id LIMIT 50 OFFSET 50", ENTITIES),
    "entity_explorer_filtered": base(explorer("WHERE entity_type = 'company' AND disclosure_completeness IN ('fully_disclosed', 'value_only') AND fund_code IN ('NATION_1', 'NATION_2') AND asset_class_code IN ('listed_equity', 'fixed_income')"), ENTITIES),
    "explorer_facets": base("""SELECT DISTINCT 'fund' AS facet, fund_code AS facet_value, fund_name || ' (' || fund_code || ')' AS label FROM files WHERE is_current AND ingest_status = 'loaded'
UNION ALL SELECT DISTINCT 'asset_class', asset_class_code, CASE asset_class_code WHEN 'listed_equity' THEN 'Listed Equity' WHEN 'unlisted_equity' THEN 'Unlisted Equity' WHEN 'fixed_income' THEN 'Fixed Income'
  WHEN 'unlisted_infrastructure' THEN 'Unlisted Infrastructure' WHEN 'unlisted_property' THEN 'Unlisted Property' WHEN 'private_debt' THEN 'Private Debt' END FROM cur"""),
    "entity_fund_period_counts": base("SELECT entity_id, fund_code, fund_name, reporting_period, count(*) AS observation_count FROM pairs GROUP BY 1, 2, 3, 4", ENTITIES, slices("fund_code, fund_name, reporting_period", "entity_id")),
    "company_period_history": base("""SELECT entity_id, reporting_period, count(*) AS observation_count, count(DISTINCT fund_code) AS fund_count, count(DISTINCT (fund_code, option_code)) AS holder_slices
FROM pairs JOIN entities USING (entity_id) WHERE entity_type = 'company' GROUP BY 1, 2""", ENTITIES, slices("reporting_period, fund_code, option_code")),
    "disclosure_summary": base(f"""SELECT entity_id, disclosure_completeness, count(*) AS observation_count, CASE disclosure_completeness WHEN 'fully_disclosed' THEN 'Direct' WHEN 'value_only' THEN 'Value only'
  WHEN 'ownership_only' THEN 'Ownership only' WHEN 'name_only' THEN 'Name only' ELSE 'Section total' END AS label, CAST({RANK} AS BIGINT) AS state_rank FROM pairs GROUP BY 1, 2""", ENTITIES, slices("disclosure_completeness")),
    "manager_observations": owner_rows("manager", "is_manager_role"),
    "company_observations": owner_rows("company", "same_m"),
    "manager_role_groups": base(f"""SELECT owner_id AS entity_id, fund_code, option_code, CAST(count(*) AS BIGINT) AS row_count, {total('value_aud', 'value_total')}, CASE WHEN grouping(option_code) = 1 THEN 'fund' ELSE 'option' END AS level
FROM mo WHERE is_manager_role GROUP BY GROUPING SETS ((owner_id, fund_code), (owner_id, fund_code, option_code))""", ENTITIES, MANAGER_ROWS),
    "role_classes": base(f"""SELECT entity_id, CAST(count(*) AS BIGINT) AS observation_count, count(DISTINCT fund_code) AS fund_count, bool_or(m) AS has_manager_role, bool_or(i) AS has_issuer_role, bool_or(o) AS has_ownership_role,
  CAST(CAST(bool_or(m) AS INT) + CAST(bool_or(d) AS INT) + CAST(bool_or(i) AS INT) AS BIGINT) AS active_role_groups, count(DISTINCT CASE WHEN m THEN fund_code END) AS manager_fund_count,
  count(DISTINCT CASE WHEN m THEN (fund_code, option_code) END) AS manager_option_count, {total('CASE WHEN m THEN value_aud END', 'manager_value_total')}
FROM (SELECT owner_id AS entity_id, fund_code, option_code, value_aud, is_manager_role AS m, is_issuer AS i, is_direct AS d, is_direct AND (kind = 'direct_holding' OR ownership_pct IS NOT NULL) AS o FROM mo
  UNION ALL SELECT e.entity_id, fund_code, option_code, value_aud, false, false, true, ownership_pct IS NOT NULL OR disclosure_completeness = 'fully_disclosed'
    FROM named n JOIN enames e ON {norm('n.raw_name')} = e.name_key AND e.entity_type = 'manager'
    WHERE NOT (coalesce(n.entity_id = e.entity_id, false) OR coalesce(n.manager_entity_id = e.entity_id, false) OR coalesce(n.issuer_entity_id = e.entity_id, false) OR coalesce(n.issuer_bridge_id = e.entity_id, false)))
GROUP BY 1""", ENTITIES, MANAGER_ROWS),
    "name_sets": base("""SELECT entity_id, name, CAST(min(place) AS BIGINT) AS place FROM (SELECT entity_id, canonical_name AS name, 0 AS place FROM entities
  UNION ALL SELECT entity_id, alias, CASE WHEN is_preferred THEN 1 ELSE 2 END FROM aliases UNION ALL SELECT entity_id, raw_name, 3 FROM named WHERE entity_id IS NOT NULL) GROUP BY 1, 2""", ENTITIES),
    "observations_by_name": base("""SELECT lower(raw_name) AS lookup_name, count(*) AS observation_count, max(reporting_period) AS latest_period, count(DISTINCT raw_name) AS spellings,
  CAST(count(*) FILTER (disclosure_completeness = 'fully_disclosed') AS BIGINT) AS fully_disclosed_count, CAST(count(*) FILTER (disclosure_completeness = 'value_only') AS BIGINT) AS value_only_count,
  CAST(count(*) FILTER (disclosure_completeness = 'ownership_only') AS BIGINT) AS ownership_only_count, CAST(count(*) FILTER (disclosure_completeness = 'name_only') AS BIGINT) AS name_only_count
FROM obs WHERE has_name AND NOT is_aggregate GROUP BY 1"""),
    "cross_layout_by_entity": base("SELECT entity_id, count(*) AS observation_count, count(DISTINCT fund_code) AS fund_count, count(DISTINCT layout_key) AS layout_count FROM pairs GROUP BY 1", ENTITIES, slices("fund_code, layout_key", "entity_id")),
    "one_hop_edges": """WITH e AS (SELECT DISTINCT l_suppkey * 2 + 1 AS a, l_partkey * 2 AS b FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')
SELECT a AS entity_id, b AS other_id, 'manages' AS relationship_type, 'from' AS side FROM e UNION ALL SELECT b, a, 'manages', 'to' FROM e""",
    "issuer_semi": base("SELECT holding_key, fund_code, asset_class_code, value_aud FROM named WHERE issuer_bridge_id IS NOT NULL"),
    "matched_assets": base("""SELECT part_id * 2 AS asset_entity_id, holding_key, CAST(1 AS DECIMAL(6,5)) AS confidence_score, fund_code, option_code, reporting_period, asset_class_code, disclosure_completeness, ownership_pct, canonical_name AS asset_name, entity_type
FROM named n JOIN entities e ON e.entity_id = part_id * 2 WHERE source_row_number = 2 AND quantity = 50""", ENTITIES),
    "search_ranked": base("""SELECT kind, title, entity_id, fund_code, CAST(score AS BIGINT) AS score, matched_on, matched_value FROM matches
ORDER BY score DESC, CASE kind WHEN 'fund' THEN 0 WHEN 'company' THEN 1 ELSE 2 END, lower(title), lower(matched_value), entity_id NULLS FIRST LIMIT 20""", ENTITIES, SUBJECTS),
    "search_facets": base("SELECT kind, count(*) AS result_count FROM matches GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM matches", ENTITIES, SUBJECTS),
}


def all_sql() -> dict[str, str]:
    return {**READ_MODELS, **registered_resolution.SQL, **registered_links.SQL, **registered_loads.SQL, **registered_layouts.SQL, **registered_governance.SQL, **registered_functions.SQL, **registered_ingest.SQL}
