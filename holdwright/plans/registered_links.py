"""Registered queries of the stored resolution: links, created entities, overrides and queue, with their SQL."""

from __future__ import annotations

import dataclasses
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.plans import links, resolver
from holdwright.plans.binding import EXPIRY_CUTOFF, DriverTables
from holdwright.plans.corpus import Corpus
from holdwright.plans.oracle_base import ENTITIES, FILES, LINES, OBS, OVERRIDES, with_ctes
from holdwright.plans.registered_resolution import FULL, ITEMS, NEW_ID, SQL_H, SQL_ID, SQL_NC, SQL_PICK, SQL_RES, SQL_STAGE, first_candidates
from holdwright.session import checkpoint_dir, written_once
from holdwright.sources.keyed import keyed
from holdwright.sources.store import Store

FIRST_BATCH_END = "1997-12-31"


def _now():
    return F.lit(EXPIRY_CUTOFF).cast("date")


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{checkpoint_dir(spark)}/resolution-{uuid.uuid4().hex}")


def _early(corpus: Corpus) -> Corpus:
    return dataclasses.replace(corpus, observations=corpus.observations.where(F.col("reporting_period") <= F.lit(FIRST_BATCH_END).cast("date")))


def holding_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links after a run over the earlier periods and one over all: the second adds to the first."""
    corpus, state = DriverTables(spark, sf).late_corpus, links.Resolution(_store(spark))
    state.run(_early(corpus), _now(), 1)
    state.run(corpus, _now(), 2)
    return state.links.rows()


ROUNDS = [{"STANDARD": "accept", "MEDIUM": "accept", "ECONOMY": "reject", "PROMO": "create_new"}, {"STANDARD": "accept", "MEDIUM": "accept", "ECONOMY": "create_new", "PROMO": "reject"}]
DECIDED = ["2000-02-01", "2000-03-01"]


def _decisions(items: DataFrame, corpus: Corpus, number: int) -> DataFrame:
    """Decisions of a round by asset class; those on MEDIUM name no candidate."""
    actions = ROUNDS[number]
    chosen = F.when(F.col("asset_class") == "STANDARD", F.col("first_entity")).when(F.col("asset_class") == "MEDIUM", F.lit(-1))
    rows = first_candidates(items.where(F.col("asset_class").isin(*actions)), corpus)
    action = F.element_at(F.create_map(*[F.lit(x) for pair in actions.items() for x in pair]), F.col("asset_class"))
    return rows.select(
        "holding_key", action.alias("action"), chosen.cast("bigint").alias("chosen_entity_id"), F.lit(f"reviewer {number + 1}").alias("resolved_by"), F.lit(None).cast("string").alias("notes"),
        F.lit(DECIDED[number]).cast("timestamp").alias("decided_at"),
    )


def _two_rounds(spark: SparkSession, sf: str) -> links.Resolution:
    """One run over all holdings, decisions on the earlier periods' items, then on the others."""
    corpus, state = DriverTables(spark, sf).late_corpus, links.Resolution(_store(spark))
    state.run(corpus, _now(), 1)
    open_items = written_once(state.queue.rows(), "zstd")
    early = written_once(open_items.select("holding_key").join(_early(corpus).observations.select("holding_key"), "holding_key", "left_semi"))
    state.decide(corpus, _decisions(open_items.join(early, "holding_key", "left_semi"), corpus, 0), 2)
    state.decide(corpus, _decisions(open_items.join(early, "holding_key", "left_anti"), corpus, 1), 3)
    return state


def override_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides that the decisions of two rounds left; the later one on a scope stands."""
    return _two_rounds(spark, sf).overrides.rows()


def created_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that overrides and decisions created, with the number of their spellings."""
    state = _two_rounds(spark, sf)
    spellings = state.aliases.rows().groupBy("entity_id").agg(F.count(F.lit(1)).alias("alias_count"))
    return state.created.rows().join(spellings, "entity_id", "left").select("entity_id", "entity_type", "canonical_name", "origin", "origin_key", "holding_key", F.col("run").cast("bigint").alias("run"), "alias_count")


def queue_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Queue after a run, on top of an older queue of the earlier periods that is partly decided."""
    corpus = DriverTables(spark, sf).late_corpus
    found = written_once(resolver.queue_items(resolver.resolve(corpus, _now())))
    table = keyed(_store(spark), "queue", links.schema_of(links.QUEUE), ["holding_key", "item_no"])
    early = found.join(_early(corpus).observations.select("holding_key"), "holding_key", "left_semi")
    closed = F.col("asset_class") == "STANDARD"
    older = early.withColumn("item_no", F.lit(1)).withColumn("candidate_count", F.lit(0).cast("bigint")).withColumn("notes", F.lit("older")).withColumn("resolved_by", F.when(closed, F.lit("reviewer")))
    older = older.withColumn("status", F.when(closed, "accepted").otherwise("open")).withColumn("decided_at", F.when(closed, F.lit(DECIDED[0]).cast("timestamp")))
    table.merge(older)
    table.merge(links.next_queue(table.rows(), found))
    return table.rows().select("holding_key", F.col("item_no").cast("bigint").alias("item_no"), "group_kind", "group_key", "candidate_count", "status", "resolved_by", "notes")


QUERIES = {"holding_links": holding_links, "override_upsert": override_upsert, "created_entities": created_entities, "queue_upsert": queue_upsert}


# --- SQL ---------------------------------------------------------------------


def _renamed(cte: str, run: int, *names: str) -> str:
    """The CTEs of a resolver run under the names of run `run`."""
    own = ("h", "scored", "top", "pick", "st", "made", "allnames", "nc", "res", *names)
    return re.sub(rf"\b({'|'.join(own)})\b", rf"\g<1>{run}", cte)


def _run(run: int, *names: str) -> list[str]:
    return [_renamed(c, run, *names) for c in (SQL_PICK, SQL_STAGE, SQL_NC.format(src="allnames"), SQL_RES)]


def _link(run: int) -> str:
    return f"""
link{run} AS (SELECT holding_key, resolved_entity AS entity_id, outcome, CASE WHEN outcome IN ('force_match', 'force_no_match', 'force_new_entity', 'redirect_to_parent') THEN override_id END AS override_id
  FROM res{run} WHERE outcome <> 'prelinked' AND (resolved_entity IS NOT NULL OR outcome = 'force_no_match'))"""


H1 = _renamed(SQL_H.replace("FROM obs", f"FROM obs WHERE reporting_period <= DATE '{FIRST_BATCH_END}'"), 1)
H2 = _renamed(SQL_H.replace("FROM obs", "FROM (SELECT obs.* REPLACE (coalesce(obs.entity_id, link1.entity_id) AS entity_id) FROM obs LEFT JOIN link1 USING (holding_key))"), 2)
STATE = """
entities2 AS (SELECT entity_id, entity_type FROM entities UNION ALL SELECT entity_id, entity_type FROM made1),
enames2 AS (SELECT * FROM enames UNION SELECT entity_id, entity_type, name_key FROM made1),
overrides2 AS (SELECT o.* REPLACE (coalesce(o.matched_entity_id, m.entity_id) AS matched_entity_id) FROM overrides o LEFT JOIN made1 m USING (override_id))"""

_ACTIONS = [" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in r.items()) for r in ROUNDS]
TWO_ROUNDS = f"""
gm AS (SELECT 'NAME' AS k, name_key AS v, s AS sc, entity_id FROM enames, (VALUES (NULL), ('manager'), ('company')) t(s) WHERE s IS NULL OR s = entity_type UNION ALL SELECT id_kind, id_value, NULL, entity_id FROM idm),
gf AS (SELECT k, v, sc, min(entity_id) AS e FROM gm GROUP BY ALL),
ruled AS (
  SELECT *, CASE WHEN early THEN 0 ELSE 1 END AS round, CASE WHEN early THEN CASE asset_class {_ACTIONS[0]} END ELSE CASE asset_class {_ACTIONS[1]} END END AS action
  FROM (SELECT i.*, o.reporting_period <= DATE '{FIRST_BATCH_END}' AS early, gf.e FROM items i JOIN obs o USING (holding_key)
    LEFT JOIN gf ON k = group_kind AND v = group_key AND sc IS NOT DISTINCT FROM group_scope WHERE i.asset_class IN ('STANDARD', 'MEDIUM', 'ECONOMY', 'PROMO'))),
done AS (
  SELECT *, CASE action WHEN 'accept' THEN e WHEN 'create_new' THEN {NEW_ID.format(kind='queue', key='holding_key')} END AS linked FROM ruled
  WHERE coalesce(trim(name_key), '') <> '' AND asset_class <> 'MEDIUM' AND (action <> 'accept' OR e IS NOT NULL))"""
ONE_RUN = (*FULL, ITEMS, TWO_ROUNDS)

SQL = {
    "holding_links": with_ctes(FILES, LINES, OBS, ENTITIES, OVERRIDES, SQL_ID, H1, *_run(1), _link(1), H2, STATE, *_run(2, "overrides", "entities", "enames"), _link(2), query="""
SELECT holding_key, CASE WHEN b.outcome IS NULL THEN a.entity_id ELSE b.entity_id END AS entity_id, coalesce(b.outcome, a.outcome) AS outcome, CASE WHEN b.outcome IS NULL THEN a.override_id ELSE b.override_id END AS override_id,
  CAST(CASE WHEN b.outcome IS NULL OR a.outcome = b.outcome AND a.entity_id IS NOT DISTINCT FROM b.entity_id THEN 1 ELSE 2 END AS INTEGER) AS run
FROM link1 a FULL JOIN link2 b USING (holding_key)"""),
    "override_upsert": with_ctes(*ONE_RUN, query=f"""
SELECT coalesce(o.override_id, {NEW_ID.format(kind='scope', key="to_json({'name_key': d.name_key, 'fund_code': d.fund_code, 'asset_class_scope': d.asset_class, 'entity_type_scope': d.scope})")}) AS override_id,
  d.name_key, d.fund_code, d.asset_class AS asset_class_scope, d.scope AS entity_type_scope, CASE d.action WHEN 'accept' THEN 'force_match' WHEN 'reject' THEN 'force_no_match' ELSE 'force_new_entity' END AS action,
  d.linked AS matched_entity_id, CAST(NULL AS DATE) AS expires_at, 'reviewer ' || CAST(round + 1 AS VARCHAR) AS created_by, 'Entity resolution queue item ' || d.holding_key || ' action ' || d.action || '.' AS reason,
  CASE round WHEN 0 THEN TIMESTAMP '{DECIDED[0]}' ELSE TIMESTAMP '{DECIDED[1]}' END AS decided_at
FROM (SELECT *, row_number() OVER (PARTITION BY name_key, fund_code, asset_class, scope ORDER BY round DESC, holding_key DESC) AS n FROM done) d
LEFT JOIN overrides o ON o.name_key = d.name_key AND o.fund_code = d.fund_code AND o.asset_class_scope IS NOT DISTINCT FROM d.asset_class AND o.entity_type_scope IS NOT DISTINCT FROM d.scope WHERE n = 1"""),
    "created_entities": with_ctes(*ONE_RUN, query=f"""
SELECT m.entity_id, m.entity_type, a.canonical_name, 'override' AS origin, CAST(m.override_id AS VARCHAR) AS origin_key, a.holding_key, CAST(1 AS BIGINT) AS run, a.alias_count
FROM made m JOIN (SELECT override_id, min(holding_key) AS holding_key, arg_min(raw_name, holding_key) AS canonical_name, count(DISTINCT raw_name) AS alias_count FROM res WHERE outcome = 'force_new_entity' GROUP BY 1) a USING (override_id)
UNION ALL SELECT linked, 'company', raw_name, 'queue', holding_key, holding_key, CAST(2 + round AS BIGINT), 1 FROM done WHERE action = 'create_new'"""),
    "queue_upsert": with_ctes(*FULL, ITEMS, query=f"""
SELECT holding_key, CAST(item_no AS BIGINT) AS item_no, group_kind, group_key, CASE WHEN old THEN 0 ELSE candidate_count END AS candidate_count, CASE WHEN old THEN 'accepted' ELSE 'open' END AS status,
  CASE WHEN old THEN 'reviewer' END AS resolved_by, CASE WHEN old THEN 'older' END AS notes
FROM (SELECT i.*, unnest(CASE WHEN closed THEN [1, 2] ELSE [1] END) AS item_no, item_no = 1 AND closed AS old
  FROM (SELECT i.*, i.asset_class = 'STANDARD' AND reporting_period <= DATE '{FIRST_BATCH_END}' AS closed FROM items i JOIN obs USING (holding_key)) i)"""),
}
