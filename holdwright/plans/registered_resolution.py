"""Registered queries of the resolver, its queue and reference data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.functions.text import normalise_name
from holdwright.operators import seeds
from holdwright.plans import resolver
from holdwright.plans.binding import EXPIRY_CUTOFF, DriverTables
from holdwright.plans.corpus import current_named
from holdwright.plans.oracle_base import ENTITIES, FILES, LINES, OBS, OVERRIDES, norm, with_ctes
from holdwright.plans.read_models import resolution_queue
from holdwright.session import written_alone

def _now():
    return F.lit(EXPIRY_CUTOFF).cast("date")


def abn_match(spark: SparkSession, sf: str) -> DataFrame:
    return _identifier_match(spark, sf, "ABN")


def security_match(spark: SparkSession, sf: str) -> DataFrame:
    return _identifier_match(spark, sf, "ISIN")


def _identifier_match(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    corpus = DriverTables(spark, sf).corpus
    rows = resolver.keyed_holdings(corpus.observations).where(F.col("id_kind") == kind)
    found = resolver.skewed_lookup(rows, resolver.identifier_candidates(corpus), ["id_kind", "id_value"], ["holding_key"])
    hits = F.coalesce("id_candidates", F.lit(0))
    outcome = F.when(hits == 1, "linked").when(hits > 1, "ambiguous").otherwise("unresolved")
    return found.select("holding_key", "id_value", hits.alias("candidates"), outcome.alias("outcome"), F.when(hits == 1, F.col("id_entity")).alias("entity_id"))


def exact_name_match(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).corpus
    rows = resolver.keyed_holdings(corpus.observations).where(F.col("name_key").isNotNull())
    found = resolver.skewed_lookup(rows, resolver.name_candidates(resolver.name_members(corpus)), ["name_key"], ["holding_key"])
    scope = F.coalesce("scope", F.lit("any"))
    hits = F.coalesce(F.when(scope == "manager", F.col("name_manager")).when(scope == "company", F.col("name_company")).otherwise(F.col("name_all")), F.lit(0))
    entity = F.when(scope == "manager", F.col("manager_entity")).when(scope == "company", F.col("company_entity")).otherwise(F.col("any_entity"))
    return found.select("holding_key", scope.alias("scope"), hits.alias("candidates"), (F.coalesce("name_all", F.lit(0)) - hits).alias("rejected"), F.when(hits == 1, entity).alias("entity_id"))


def override_pick(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).late_corpus
    # what an override is picked by, of the holdings whose name has one
    rows = resolver.keyed_holdings(corpus.observations).select("holding_key", *resolver.SCOPE_KEYS)
    keyed = written_alone(spark, lambda: rows.join(resolver.overridden_names(corpus, _now()), "name_key", "left_semi"))
    picked = resolver.with_override(keyed, resolver.picked_overrides(keyed, corpus, _now()), how="inner")
    clear = ~F.col("override_conflict")
    return picked.select("holding_key", F.col("specificity").cast("bigint").alias("specificity"), F.col("ties").alias("ties"), F.when(clear, F.col("override_id")).alias("override_id"),
                         F.when(clear, F.col("action")).alias("action"), "override_conflict")


def resolution_links(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).late_corpus
    return resolver.resolve(corpus, _now()).select("holding_key", "outcome", "resolved_entity", "queue_score")


def resolution_summary(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).late_corpus
    return resolver.run_summary(resolver.resolve(corpus, _now()))


def queue_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return resolver.item_candidate_rows(DriverTables(spark, sf).corpus)


def queue_items(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).late_corpus
    return resolver.queue_items(resolver.resolve(corpus, _now())).select("holding_key", "group_kind", "group_key", "group_scope", "candidate_count", "top_candidate_score", "status")


def queue_list(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).late_corpus
    items = written_alone(spark, lambda: resolver.queue_items(resolver.resolve(corpus, _now())))
    return resolution_queue(corpus, items).drop("source_file_id", "identifier_type", "identifier_value")


def first_candidates(items: DataFrame, corpus) -> DataFrame:
    """Queue items with the least candidate of their group, whatever kind of evidence it is."""
    least = resolver.group_members(corpus).groupBy("group_kind", "group_key", "group_scope").agg(F.min("entity_id").alias("first_entity"))
    least = least.select(F.col("group_kind").alias("f_kind"), F.col("group_key").alias("f_key"), F.col("group_scope").alias("f_scope"), "first_entity")
    on = (F.col("group_kind") == F.col("f_kind")) & (F.col("group_key") == F.col("f_key")) & F.col("group_scope").eqNullSafe(F.col("f_scope"))
    return items.join(least, on, "left").drop("f_kind", "f_key", "f_scope")


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Decisions on items of every kind, chosen by asset class."""
    corpus = DriverTables(spark, sf).late_corpus
    items = written_alone(spark, lambda: resolver.queue_items(resolver.resolve(corpus, _now())))
    action = F.when(F.col("asset_class").isin("STANDARD", "MEDIUM"), "accept").when(F.col("asset_class") == "ECONOMY", "reject").when(F.col("asset_class") == "PROMO", "create_new")
    decisions = first_candidates(items.where(F.col("asset_class").isin("STANDARD", "MEDIUM", "ECONOMY", "PROMO")), corpus).select(
        "holding_key", action.alias("action"), F.when(F.col("asset_class") == "STANDARD", F.col("first_entity")).when(F.col("asset_class") == "MEDIUM", F.lit(-1)).cast("bigint").alias("chosen_entity_id"),
        F.lit("reviewer").alias("resolved_by"), F.when(F.col("fund_code") == "NATION_1", "  checked ").alias("notes"), F.lit("2000-02-01").cast("date").alias("decided_at"),
    )
    return resolver.apply_queue_decisions(items, decisions, resolver.group_members(corpus))


def queue_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)[0].select("holding_key", "action", "is_valid", "new_status", "linked_entity", "reason")


def queue_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)[1].select("name_key", "fund_code", "asset_class_scope", "entity_type_scope", "action", "matched_entity_id", "created_by", "reason")


def _reference(t: DriverTables) -> DataFrame:
    """Reviewed records of the suppliers; those of nation 20 and up claim another type."""
    return t.table("supplier").select(
        F.when(F.col("s_suppkey") % 10 == 9, F.concat("s_name", F.lit(" Holdings"))).otherwise(F.col("s_name")).alias("canonical_name"),
        F.when(F.col("s_nationkey") >= 20, "company").otherwise("manager").alias("entity_type"),
        F.lpad(F.col("s_suppkey").cast("string"), 11, "0").alias("abn"),
        F.lit("seeded").alias("confidence_tier"),
    )


def seed_fill_or_conflict(spark: SparkSession, sf: str) -> DataFrame:
    t = DriverTables(spark, sf)
    return seeds.compared_columns(t.entities, _reference(t), ["abn", "confidence_tier"])


def seed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    t = DriverTables(spark, sf)
    return seeds.upsert_entities(t.entities, _reference(t), ["abn", "confidence_tier"])


def seed_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Disclosed spellings of linked entities that are no alias yet."""
    corpus = DriverTables(spark, sf).corpus
    wanted = current_named(corpus).where(F.col("entity_id").isNotNull()).select("entity_id", F.col("raw_name").alias("alias"))
    return seeds.new_aliases(corpus.aliases, wanted).withColumn("alias_normalized", normalise_name(F.col("alias")))


def relationship_derive(spark: SparkSession, sf: str) -> DataFrame:
    corpus = DriverTables(spark, sf).corpus
    names = corpus.entities.select("entity_id", normalise_name(F.col("canonical_name")).alias("entity_key"))
    rows = current_named(corpus).where((F.col("disclosure_completeness") == "value_only") & (F.col("asset_class_code") == "fixed_income"))
    rows = rows.join(names, "entity_id").where(normalise_name(F.col("raw_name")) == F.col("entity_key"))
    return seeds.derive_unique_relations(rows, ["entity_id", "fund_code"], corpus.holding_relations, "issuer")


def target_check(spark: SparkSession, sf: str) -> DataFrame:
    """Largest lines of every file against the shape they were reviewed with."""
    t = DriverTables(spark, sf)
    rows = current_named(t.corpus).select("holding_key", "source_file_id", "source_row_number", "asset_class_code", "disclosure_completeness", "value_aud")
    big = t.table("lineitem").where(F.col("l_quantity") == 50).select(F.col("l_orderkey").alias("source_file_id"), F.col("l_linenumber").alias("source_row_number"), "l_linestatus").distinct()
    targets = big.groupBy("source_file_id", "source_row_number").agg(
        F.when(F.max("l_linestatus") == "O", "fully_disclosed").otherwise("value_only").alias("disclosure_completeness")
    )
    out = seeds.check_targets(rows, targets, ["source_file_id", "source_row_number"], ["disclosure_completeness"], ["value_aud"])
    return out.select("source_file_id", F.col("source_row_number").cast("bigint").alias("source_row_number"), F.coalesce("found_rows", F.lit(0)).alias("found_rows"), "holding_key", "status", "changed_fields")


QUERIES = {
    "abn_match": abn_match,
    "security_match": security_match,
    "exact_name_match": exact_name_match,
    "override_pick": override_pick,
    "resolution_links": resolution_links,
    "resolution_summary": resolution_summary,
    "queue_candidates": queue_candidates,
    "queue_items": queue_items,
    "queue_list": queue_list,
    "queue_actions": queue_actions,
    "queue_overrides": queue_overrides,
    "seed_fill_or_conflict": seed_fill_or_conflict,
    "seed_upsert": seed_upsert,
    "seed_aliases": seed_aliases,
    "relationship_derive": relationship_derive,
    "target_check": target_check,
}


# --- SQL ---------------------------------------------------------------------

SQL_ID = """
idm AS (
  SELECT DISTINCT * FROM (SELECT 'ABN' AS id_kind, regexp_replace(abn, '[^0-9]', '', 'g') AS id_value, entity_id FROM entities WHERE length(regexp_replace(abn, '[^0-9]', '', 'g')) = 11
    UNION ALL SELECT 'ISIN', upper(replace('au ' || lpad(CAST(p_partkey AS VARCHAR), 10, '0'), ' ', '')), p_partkey * 2 FROM part WHERE p_size > 10
    UNION ALL SELECT 'ISIN', upper(replace('au ' || lpad(CAST(p_partkey + 1 AS VARCHAR), 10, '0'), ' ', '')), p_partkey * 2 FROM part WHERE p_size > 45)),
idc AS (SELECT id_kind, id_value, count(*) AS n, min(entity_id) AS e FROM idm GROUP BY 1, 2)"""

SQL_H = f"""
h AS (
  SELECT holding_key, entity_id AS stored_entity, raw_name, nullif({norm('raw_name')}, '') AS name_key, fund_code, source_asset_class_raw AS asset_class,
    CASE WHEN manager_entity_id IS NOT NULL THEN 'manager' WHEN issuer_entity_id IS NOT NULL THEN 'company' WHEN ownership_pct IS NOT NULL THEN NULL
      WHEN lower(source_subclass_raw) = 'externally managed' THEN 'manager' WHEN lower(source_subclass_raw) = 'internally managed' THEN 'company'
      WHEN list_contains(string_split(lower(classification_raw), ' '), 'manager') THEN 'manager' END AS scope,
    identifier_type AS id_kind, CASE WHEN identifier_type = 'ABN' THEN replace(identifier_value, ' ', '') ELSE upper(replace(identifier_value, ' ', '')) END AS id_value
  FROM obs)"""

SQL_NC = """
nc AS (
  SELECT name_key, count(*) AS n_all, count(*) FILTER (entity_type = 'manager') AS n_manager, count(*) FILTER (entity_type = 'company') AS n_company, min(entity_id) AS e_all,
    min(entity_id) FILTER (entity_type = 'manager') AS e_manager, min(entity_id) FILTER (entity_type = 'company') AS e_company FROM {src} GROUP BY 1)"""

SQL_PICK = f"""
scored AS (
  SELECT h.holding_key, o.*, (o.fund_code IS NOT NULL)::INT + (o.asset_class_scope IS NOT NULL)::INT
      + (o.entity_type_scope IS NOT NULL AND (coalesce(o.entity_type_scope = h.scope, false) OR o.matched_entity_id IS NOT NULL))::INT AS specificity,
    coalesce(e.entity_type <> o.entity_type_scope, false) AS type_conflict
  FROM h JOIN overrides o ON h.name_key = o.name_key LEFT JOIN entities e ON e.entity_id = o.matched_entity_id
  WHERE (o.fund_code IS NULL OR o.fund_code = h.fund_code) AND (o.asset_class_scope IS NULL OR o.asset_class_scope = h.asset_class)
    AND (o.entity_type_scope IS NULL OR h.scope IS NULL OR o.entity_type_scope = h.scope) AND NOT coalesce(o.expires_at <= DATE '{EXPIRY_CUTOFF}', false)),
top AS (SELECT holding_key, max(specificity) AS specificity FROM scored GROUP BY 1),
pick AS (
  SELECT s.holding_key, s.specificity, count(*) AS ties, arg_min(override_id, override_id) AS override_id, arg_min(action, override_id) AS action, min(matched_entity_id) AS target_entity,
    max(entity_type_scope) AS new_type, count(*) > 1 OR bool_or(type_conflict) AS override_conflict
  FROM scored s JOIN top USING (holding_key, specificity) GROUP BY 1, 2)"""

NEW_ID = "CAST('0x' || substr(sha256(concat_ws('|', '{kind}', CAST({key} AS VARCHAR))), 1, 15) AS BIGINT)"

SQL_STAGE = f"""
st AS (
  SELECT h.*, stored_entity IS NOT NULL AS prelinked, coalesce(idc.n, 0) AS id_hits, idc.e AS id_entity, p.override_id, p.action, p.target_entity, p.new_type, coalesce(p.override_conflict, false) AS override_conflict
  FROM h LEFT JOIN idc ON h.id_kind = idc.id_kind AND h.id_value = idc.id_value LEFT JOIN pick p ON h.holding_key = p.holding_key),
made AS (
  SELECT override_id, {NEW_ID.format(kind='override', key='override_id')} AS entity_id, coalesce(min(new_type), 'company') AS entity_type, {norm('arg_min(raw_name, holding_key)')} AS name_key
  FROM st WHERE NOT prelinked AND id_hits <> 1 AND NOT override_conflict AND action = 'force_new_entity' AND target_entity IS NULL GROUP BY 1),
allnames AS (SELECT entity_id, entity_type, name_key FROM enames UNION SELECT entity_id, entity_type, name_key FROM made)"""

SQL_RES = f"""
res AS (
  SELECT *, CASE WHEN outcome = 'prelinked' THEN stored_entity WHEN outcome IN ('abn', 'identifier') THEN id_entity WHEN outcome IN ('force_match', 'redirect_to_parent') THEN target_entity
      WHEN outcome = 'force_new_entity' THEN coalesce(target_entity, {NEW_ID.format(kind='override', key='override_id')}) WHEN outcome = 'exact_name' THEN scoped_entity END AS resolved_entity
  FROM (SELECT *, CASE WHEN prelinked THEN 'prelinked' WHEN id_hits = 1 AND id_kind = 'ABN' THEN 'abn' WHEN id_hits = 1 THEN 'identifier' WHEN override_conflict THEN 'override_conflict'
        WHEN override_id IS NOT NULL THEN action WHEN id_hits > 1 AND id_kind = 'ABN' THEN 'ambiguous_abn' WHEN id_hits > 1 THEN 'ambiguous_identifier'
        WHEN scoped = 1 THEN 'exact_name' WHEN scoped > 1 THEN 'ambiguous_name' ELSE 'unresolved' END AS outcome
    FROM (SELECT st.*, coalesce(CASE scope WHEN 'manager' THEN n_manager WHEN 'company' THEN n_company ELSE n_all END, 0) AS scoped, coalesce(n_all, 0) AS n_all,
        CASE scope WHEN 'manager' THEN e_manager WHEN 'company' THEN e_company ELSE e_all END AS scoped_entity FROM st LEFT JOIN nc USING (name_key))))"""

BASE = (FILES, LINES, OBS, ENTITIES, SQL_H)
FULL = (*BASE, OVERRIDES, SQL_ID, SQL_PICK, SQL_STAGE, SQL_NC.format(src="allnames"), SQL_RES)


def _id_sql(kind: str) -> str:
    return with_ctes(*BASE, SQL_ID, query=f"""SELECT holding_key, h.id_value, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome, CASE WHEN n = 1 THEN e END AS entity_id
FROM h LEFT JOIN idc ON h.id_kind = idc.id_kind AND h.id_value = idc.id_value WHERE h.id_kind = '{kind}'""")


ITEMS = """
items AS (
  SELECT holding_key, CASE WHEN outcome = 'ambiguous_name' THEN 'NAME' ELSE id_kind END AS group_kind, CASE WHEN outcome = 'ambiguous_name' THEN name_key ELSE id_value END AS group_key,
    CASE WHEN outcome = 'ambiguous_name' THEN scope END AS group_scope, CASE WHEN outcome = 'ambiguous_name' THEN scoped ELSE id_hits END AS candidate_count,
    CAST(CASE WHEN outcome = 'ambiguous_name' THEN 0.97 ELSE 1 END AS DECIMAL(6,5)) AS top_candidate_score, 'open' AS status, raw_name, fund_code, asset_class, scope, name_key
  FROM res WHERE starts_with(outcome, 'ambiguous'))"""
DONE = f"""
gm AS (SELECT 'NAME' AS k, name_key AS v, s AS sc, entity_id FROM enames, (VALUES (NULL), ('manager'), ('company')) t(s) WHERE s IS NULL OR s = entity_type UNION ALL SELECT id_kind, id_value, NULL, entity_id FROM idm),
gf AS (SELECT k, v, sc, min(entity_id) AS e FROM gm GROUP BY ALL),
done AS (
  SELECT *, CASE WHEN NOT is_valid THEN 'open' WHEN action = 'accept' THEN 'accepted' WHEN action = 'reject' THEN 'rejected' ELSE 'created_new' END AS new_status,
    CASE WHEN is_valid AND action = 'accept' THEN chosen WHEN is_valid AND action = 'create_new' THEN {NEW_ID.format(kind='queue', key='holding_key')} END AS linked_entity,
    'Entity resolution queue item ' || holding_key || ' action ' || action || '.' || CASE WHEN fund_code = 'NATION_1' THEN ' Notes: checked' ELSE '' END AS reason
  FROM (SELECT i.*, CASE WHEN asset_class IN ('STANDARD', 'MEDIUM') THEN 'accept' WHEN asset_class = 'ECONOMY' THEN 'reject' ELSE 'create_new' END AS action,
      CASE WHEN asset_class = 'STANDARD' THEN gf.e WHEN asset_class = 'MEDIUM' THEN -1 END AS chosen,
      coalesce(trim(name_key), '') <> '' AND asset_class <> 'MEDIUM' AND (asset_class <> 'STANDARD' OR gf.e IS NOT NULL) AS is_valid
    FROM items i LEFT JOIN gf ON k = group_kind AND v = group_key AND sc IS NOT DISTINCT FROM group_scope WHERE asset_class IN ('STANDARD', 'MEDIUM', 'ECONOMY', 'PROMO')))"""
REF = """
ref AS (SELECT CASE WHEN s_suppkey % 10 = 9 THEN s_name || ' Holdings' ELSE s_name END AS canonical_name, CASE WHEN s_nationkey >= 20 THEN 'company' ELSE 'manager' END AS entity_type,
  lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS abn, 'seeded' AS confidence_tier FROM supplier)"""

SQL = {
    "abn_match": _id_sql("ABN"),
    "security_match": _id_sql("ISIN"),
    "exact_name_match": with_ctes(*BASE, SQL_NC.format(src="enames"), query="""SELECT holding_key, coalesce(scope, 'any') AS scope, hits AS candidates, coalesce(n_all, 0) - hits AS rejected, CASE WHEN hits = 1 THEN CASE scope WHEN 'manager' THEN e_manager WHEN 'company' THEN e_company ELSE e_all END END AS entity_id
FROM (SELECT *, coalesce(CASE scope WHEN 'manager' THEN n_manager WHEN 'company' THEN n_company ELSE n_all END, 0) AS hits FROM h LEFT JOIN nc USING (name_key) WHERE name_key IS NOT NULL)"""),
    "override_pick": with_ctes(*BASE, OVERRIDES, SQL_PICK, query="""SELECT holding_key, CAST(specificity AS BIGINT) AS specificity, ties, CASE WHEN NOT override_conflict THEN override_id END AS override_id, CASE WHEN NOT override_conflict THEN action END AS action, override_conflict FROM pick"""),
    "resolution_links": with_ctes(*FULL, query="""SELECT holding_key, outcome, resolved_entity, CAST(CASE WHEN outcome = 'ambiguous_name' THEN 0.97 WHEN starts_with(outcome, 'ambiguous') THEN 1 END AS DECIMAL(6,5)) AS queue_score FROM res"""),
    "resolution_summary": with_ctes(*FULL, query="""SELECT count(*) AS holdings_scanned, count(*) FILTER (outcome = 'prelinked') AS holdings_skipped_prelinked, count(*) FILTER (outcome = 'abn') AS abn_matches,
  count(*) FILTER (outcome = 'identifier') AS security_identifier_matches, count(*) FILTER (NOT prelinked AND id_kind = 'ABN' AND id_hits = 0) AS unresolved_abn,
  count(*) FILTER (NOT prelinked AND id_kind = 'ISIN' AND id_hits = 0) AS unresolved_security_identifier, count(*) FILTER (NOT prelinked AND id_kind = 'ABN' AND id_hits > 1) AS ambiguous_abn,
  count(*) FILTER (NOT prelinked AND id_kind = 'ISIN' AND id_hits > 1) AS ambiguous_security_identifier, count(*) FILTER (outcome = 'force_match') AS force_match_applications,
  count(*) FILTER (outcome = 'force_no_match') AS force_no_match_suppressions, count(DISTINCT CASE WHEN outcome = 'force_new_entity' THEN override_id END) AS force_new_entity_creations,
  count(*) FILTER (outcome = 'redirect_to_parent') AS redirect_to_parent_applications, count(*) FILTER (outcome = 'exact_name') AS exact_name_auto_links,
  count(*) FILTER (outcome = 'ambiguous_name') AS exact_name_ambiguities_queued,
  CAST(coalesce(sum(CASE WHEN outcome IN ('exact_name', 'ambiguous_name', 'unresolved') THEN n_all - scoped END), 0) AS BIGINT) AS exact_name_candidates_rejected,
  count(*) FILTER (resolved_entity IS NULL) AS unresolved_rows_remaining, count(*) FILTER (resolved_entity IS NULL AND name_key IS NOT NULL) AS unresolved_named_rows FROM res"""),
    "queue_candidates": with_ctes(ENTITIES, SQL_ID, query="""SELECT group_kind, group_key, group_scope, row_number() OVER (PARTITION BY group_kind, group_key, group_scope ORDER BY m.entity_id) AS position, m.entity_id, m.entity_type, canonical_name, abn, group_rows
FROM (SELECT *, count(*) OVER (PARTITION BY group_kind, group_key, group_scope) AS group_rows FROM (
  SELECT 'NAME' AS group_kind, name_key AS group_key, s AS group_scope, entity_id, entity_type FROM enames, (VALUES (NULL), ('manager'), ('company')) t(s) WHERE s IS NULL OR s = entity_type
  UNION ALL SELECT id_kind, id_value, NULL, entity_id, entity_type FROM idm LEFT JOIN entities USING (entity_id))) m LEFT JOIN (SELECT entity_id, canonical_name, abn FROM entities) e USING (entity_id) WHERE group_rows > 1"""),
    "queue_items": with_ctes(*FULL, ITEMS, query="SELECT holding_key, group_kind, group_key, group_scope, candidate_count, top_candidate_score, status FROM items"),
    "queue_list": with_ctes(*FULL, ITEMS, query="""SELECT i.holding_key, group_kind, group_key, candidate_count, top_candidate_score, i.status, o.raw_name, o.fund_code, o.fund_name, o.option_name, o.reporting_period FROM items i JOIN obs o USING (holding_key)"""),
    "queue_actions": with_ctes(*FULL, ITEMS, DONE, query="SELECT holding_key, action, is_valid, new_status, linked_entity, reason FROM done"),
    "queue_overrides": with_ctes(*FULL, ITEMS, DONE, query="""SELECT name_key, fund_code, asset_class AS asset_class_scope, scope AS entity_type_scope, arg_max(CASE action WHEN 'accept' THEN 'force_match' WHEN 'reject' THEN 'force_no_match' ELSE 'force_new_entity' END, holding_key) AS action,
  CAST(arg_max_null(linked_entity, holding_key) AS BIGINT) AS matched_entity_id, 'reviewer' AS created_by, arg_max(reason, holding_key) AS reason FROM done WHERE is_valid GROUP BY 1, 2, 3, 4"""),
    "seed_fill_or_conflict": with_ctes(ENTITIES, REF, query="""SELECT entity_id, canonical_name, column_name, existing, expected, CASE WHEN entity_id IS NULL THEN 'created' WHEN other_type THEN 'conflict' WHEN existing IS NULL THEN 'filled' WHEN existing = expected THEN 'kept' ELSE 'conflict' END AS outcome
FROM (SELECT e.entity_id, r.canonical_name, coalesce(e.entity_type <> r.entity_type, false) AS other_type, 'abn' AS column_name, e.abn AS existing, r.abn AS expected FROM ref r LEFT JOIN entities e ON e.canonical_name = r.canonical_name
  UNION ALL SELECT e.entity_id, r.canonical_name, coalesce(e.entity_type <> r.entity_type, false), 'confidence_tier', e.confidence_tier, r.confidence_tier FROM ref r LEFT JOIN entities e ON e.canonical_name = r.canonical_name)"""),
    "seed_upsert": with_ctes(ENTITIES, REF, query=f"""SELECT e.entity_id, e.entity_type, e.canonical_name, CASE WHEN clash THEN e.abn ELSE coalesce(e.abn, r_abn) END AS abn, CASE WHEN clash THEN e.confidence_tier ELSE coalesce(e.confidence_tier, r_tier) END AS confidence_tier
FROM (SELECT e.*, r.abn AS r_abn, r.confidence_tier AS r_tier, coalesce(e.abn <> r.abn, false) OR coalesce(e.confidence_tier <> r.confidence_tier, false) AS clash
  FROM entities e LEFT JOIN ref r ON e.canonical_name = r.canonical_name AND e.entity_type = r.entity_type) e
UNION ALL SELECT {NEW_ID.format(kind='entity', key='canonical_name')}, entity_type, canonical_name, abn, confidence_tier FROM ref WHERE canonical_name NOT IN (SELECT canonical_name FROM entities)"""),
    "seed_aliases": with_ctes(FILES, LINES, OBS, ENTITIES, query=f"""SELECT DISTINCT entity_id, raw_name AS alias, {norm('raw_name')} AS alias_normalized FROM named n WHERE entity_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = n.entity_id AND a.alias = n.raw_name)"""),
    "relationship_derive": with_ctes(FILES, LINES, OBS, ENTITIES, query=f"""SELECT f.entity_id, fund_code, f.fitting_rows, f.holding_key, CASE WHEN fitting_rows > 1 THEN 'not_unique' WHEN l.issuer_bridge_id IS NULL THEN 'linked' WHEN l.issuer_bridge_id = f.entity_id THEN 'present' ELSE 'conflict' END AS status
FROM (SELECT n.entity_id, fund_code, count(*) AS fitting_rows, min(holding_key) AS holding_key FROM named n JOIN entities e ON n.entity_id = e.entity_id AND {norm('n.raw_name')} = {norm('e.canonical_name')}
  WHERE disclosure_completeness = 'value_only' AND asset_class_code = 'fixed_income' GROUP BY 1, 2) f JOIN lines l ON f.holding_key = l.holding_key"""),
    "target_check": with_ctes(FILES, LINES, OBS, query="""SELECT source_file_id, CAST(source_row_number AS BIGINT) AS source_row_number, coalesce(n, 0) AS found_rows, holding_key,
  CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN state <> want OR value_aud IS NULL THEN 'changed' ELSE 'ok' END AS status,
  CASE WHEN n = 1 THEN concat_ws(',', CASE WHEN state <> want THEN 'disclosure_completeness' END, CASE WHEN value_aud IS NULL THEN 'value_aud' END) ELSE '' END AS changed_fields
FROM (SELECT l_orderkey AS source_file_id, l_linenumber AS source_row_number, CASE WHEN max(l_linestatus) = 'O' THEN 'fully_disclosed' ELSE 'value_only' END AS want FROM lineitem WHERE l_quantity = 50 GROUP BY 1, 2)
LEFT JOIN (SELECT source_file_id, source_row_number, count(*) AS n, min(holding_key) AS holding_key, arg_min(disclosure_completeness, holding_key) AS state, arg_min_null(value_aud, holding_key) AS value_aud FROM named GROUP BY 1, 2) USING (source_file_id, source_row_number)"""),
}
