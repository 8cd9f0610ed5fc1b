"""Resolver runs that keep what they find: links, created entities, their aliases, overrides and the queue.

A run reads the stored state, resolves what is not linked yet, and merges only what changed. Running
it again changes nothing, since linked holdings are skipped and every other outcome is the same row.
Queue decisions go the same way: the first one on an open item counts, closes it, links its
holding, creates an entity where asked, and leaves an override for the scope of the holding; a later
decision on the same scope replaces that override.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions.identifiers import stable_id
from holdwright.functions.text import normalise_name
from holdwright.operators.skew import skewed_lookup
from holdwright.plans import resolver
from holdwright.plans.corpus import Corpus
from holdwright.session import freed, scratch, written_alone, written_once
from holdwright.sources.keyed import KeyedTable, Merge, keyed
from holdwright.sources.store import Store

LINKS = "holding_key string, entity_id bigint, outcome string, override_id bigint, run int"
CREATED = "entity_id bigint, entity_type string, canonical_name string, abn string, confidence_tier string, origin string, origin_key string, holding_key string, run int"
ALIASES = "entity_id bigint, alias string, alias_normalized string, is_preferred boolean, run int"
OVERRIDES = "override_id bigint, name_key string, fund_code string, asset_class_scope string, entity_type_scope string, action string, matched_entity_id bigint, expires_at date, created_by string, reason string, decided_at timestamp"
TARGETS = "override_id bigint, matched_entity_id bigint"
QUEUE = "holding_key string, item_no int, group_kind string, group_key string, group_scope string, candidate_count bigint, top_candidate_score decimal(6,5), raw_name string, fund_code string, asset_class string, scope string, name_key string, status string, resolved_by string, notes string, decided_at timestamp"
#: What a run needs of a resolved holding: of all, and of those that had no link.
COUNTED = ["prelinked", "outcome", "resolved_entity", "override_applies", "id_hits", "id_kind", "id_given", "name_hits", "name_rejected"]
EVIDENCE = ["name_key", "raw_name", "fund_code", "asset_class", "scope", "id_value", "override_id", "action", "target_entity", "new_entity_type", "queue_score"]
SCOPE = ["name_key", "fund_code", "asset_class_scope", "entity_type_scope"]


def schema_of(ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


# --- pure steps ----------------------------------------------------------------


def next_queue(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Queue rows that a run's items write: the open item of a holding again, or its next one.

    An open item gets the new candidates and score and loses its notes; closed items stay as they are.
    """
    of_holding = stored.groupBy("holding_key").agg(F.max("item_no").alias("last_no"), F.max(F.when(F.col("status") == "open", F.col("item_no"))).alias("open_no"))
    placed = found.join(of_holding, "holding_key", "left")
    number = F.coalesce("open_no", F.coalesce("last_no", F.lit(0)) + 1).cast("int")
    items = placed.withColumn("item_no", number).withColumn("status", F.lit("open"))
    for name, kind in (("resolved_by", "string"), ("notes", "string"), ("decided_at", "timestamp")):
        items = items.withColumn(name, F.lit(None).cast(kind))
    return items.select(*schema_of(QUEUE).names)


def closed_items(done: DataFrame) -> DataFrame:
    """Rows of decided queue items."""
    return done.where("is_valid").withColumn("status", F.col("new_status")).select(*schema_of(QUEUE).names)


def upsert_overrides(stored: DataFrame, decided: DataFrame) -> DataFrame:
    """Overrides after queue decisions, with what became of each row.

    change: kept, replaced (same id, new action, target, reason and author; no end date), inserted, or
    conflict for a decision whose scope has several stored overrides: these stay and the decision is
    reported. A decision older than the stored one changes nothing.
    """
    scope = F.to_json(F.struct(*SCOPE), {"ignoreNullFields": "false"})
    held = stored.withColumn("scope_text", scope)
    ruled = decided.withColumn("scope_text", scope).drop(*SCOPE)
    ruled = ruled.select("scope_text", *[F.col(c).alias(f"d_{c}") for c in ("action", "matched_entity_id", "created_by", "reason", "decided_at")])
    of_scope = held.groupBy("scope_text").agg(F.count(F.lit(1)).alias("rows_of_scope"))
    both = held.join(of_scope, "scope_text").join(ruled, "scope_text", "left")
    newer = F.col("d_action").isNotNull() & (F.col("decided_at").isNull() | (F.col("d_decided_at") >= F.col("decided_at")))
    replaced = newer & (F.col("rows_of_scope") == 1)
    pick = lambda c: F.when(replaced, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)
    change = F.when(replaced, F.lit("replaced")).otherwise(F.lit("kept")).alias("change")
    after = both.select("override_id", *SCOPE, pick("action"), pick("matched_entity_id"), F.when(~replaced, F.col("expires_at")).alias("expires_at"), pick("created_by"), pick("reason"), pick("decided_at"), change)
    fresh = decided.withColumn("scope_text", scope).join(of_scope, "scope_text", "left").where(F.col("rows_of_scope").isNull() | (F.col("rows_of_scope") > 1))
    fresh = fresh.select(
        stable_id(F.lit("scope"), F.col("scope_text")).alias("override_id"), *SCOPE, "action", "matched_entity_id", F.lit(None).cast("date").alias("expires_at"), "created_by", "reason", "decided_at",
        F.when(F.col("rows_of_scope").isNull(), "inserted").otherwise("conflict").alias("change"),
    )
    return after.unionByName(fresh)


def created_by_overrides(resolved: DataFrame, run: int) -> DataFrame:
    """Entities that force-new overrides without a target made, one per override."""
    made = resolver.created_entities(resolved)
    first = resolved.where(F.col("override_applies") & (F.col("action") == "force_new_entity")).groupBy("override_id").agg(F.min("holding_key").alias("holding_key"))
    return made.join(first, "override_id").select(
        "entity_id", "entity_type", "canonical_name", F.lit(None).cast("string").alias("abn"), F.lit(None).cast("string").alias("confidence_tier"),
        F.lit("override").alias("origin"), F.col("override_id").cast("string").alias("origin_key"), "holding_key", F.lit(run).alias("run"),
    )


def created_by_decisions(done: DataFrame, run: int) -> DataFrame:
    """Entities that create-new decisions made, one per queue item."""
    return done.where(F.col("is_valid") & (F.col("action") == "create_new")).select(
        F.col("linked_entity").alias("entity_id"), F.lit("company").alias("entity_type"), F.col("raw_name").alias("canonical_name"), F.lit(None).cast("string").alias("abn"),
        F.lit(None).cast("string").alias("confidence_tier"), F.lit("queue").alias("origin"), F.col("holding_key").alias("origin_key"), "holding_key", F.lit(run).alias("run"),
    )


def alias_rows(names: DataFrame, run: int) -> DataFrame:
    """Alias rows of (entity_id, alias); every spelling once per entity."""
    rows = names.where(F.col("alias").isNotNull()).select("entity_id", "alias").distinct()
    return rows.select("entity_id", "alias", normalise_name(F.col("alias")).alias("alias_normalized"), F.lit(True).alias("is_preferred"), F.lit(run).alias("run"))


# --- stored state ----------------------------------------------------------------


class Resolution:
    """The resolver's tables in a store."""

    def __init__(self, store: Store, buckets: int = 16):
        table = lambda name, ddl, *keys: keyed(store, f"resolution/{name}", schema_of(ddl), keys, buckets)
        self.links: KeyedTable = table("links", LINKS, "holding_key")
        self.created: KeyedTable = table("created", CREATED, "entity_id")
        self.aliases: KeyedTable = table("aliases", ALIASES, "entity_id", "alias")
        self.overrides: KeyedTable = table("overrides", OVERRIDES, "override_id")
        self.targets: KeyedTable = table("targets", TARGETS, "override_id")
        self.queue: KeyedTable = table("queue", QUEUE, "holding_key", "item_no")

    def tables(self) -> dict[str, KeyedTable]:
        return {n: t for n, t in vars(self).items() if isinstance(t, KeyedTable)}

    def corpus(self, base: Corpus) -> Corpus:
        """The corpus with everything that earlier runs and decisions found."""
        link = self.links.rows().where(F.col("entity_id").isNotNull()).select("holding_key", F.col("entity_id").alias("kept_entity"))
        seen = base.observations
        if self.links.snapshots():  # only holdings without a link of their own ask for a kept one
            asking = skewed_lookup(seen.where(F.col("entity_id").isNull()), link, ["holding_key"], ["holding_key"])
            asking = asking.withColumn("entity_id", F.col("kept_entity")).select(*seen.columns)
            seen = seen.where(F.col("entity_id").isNotNull()).unionByName(asking)
        made = self.created.rows().select(*base.entities.columns)
        spelled = self.aliases.rows().select(*base.aliases.columns)
        return dataclasses.replace(
            base, observations=seen, entities=base.entities.unionByName(made), aliases=base.aliases.unionByName(spelled), overrides=self.all_overrides(base),
        )

    def all_overrides(self, base: Corpus) -> DataFrame:
        """Given overrides, as decisions have changed them, with the entities made for them as targets."""
        own = self.overrides.rows()
        given = base.overrides.join(own.select("override_id"), "override_id", "left_anti")
        target = self.targets.rows().select("override_id", F.col("matched_entity_id").alias("made_entity"))
        both = given.unionByName(own.select(*[c for c in own.columns if c in given.columns]), allowMissingColumns=True).join(target, "override_id", "left")
        return both.withColumn("matched_entity_id", F.coalesce("matched_entity_id", "made_entity")).drop("made_entity")

    def run(self, base: Corpus, now: Column, run: int) -> tuple[DataFrame, dict[str, Merge]]:
        """Resolve the holdings of `base` that have no link yet; the run's counters, and what it wrote."""
        spark = base.observations.sparkSession
        with scratch(spark):
            summary, wrote = self._run(self.corpus(base), now, run)
            counters = spark.createDataFrame([summary.first()], summary.schema)
        return counters, wrote

    def _run(self, corpus: Corpus, now: Column, run: int) -> tuple[DataFrame, dict[str, Merge]]:
        open_ = ~F.col("prelinked")
        # a linked holding is only counted, so its texts are not written
        columns = ["holding_key", *COUNTED, *[F.when(open_, F.col(c)).alias(c) for c in EVIDENCE]]
        resolved = written_alone(corpus.observations.sparkSession, lambda: resolver.resolve(corpus, now).select(*columns))
        fresh = resolved.where(~F.col("prelinked") & (F.col("resolved_entity").isNotNull() | (F.col("outcome") == "force_no_match")))
        known = self.links.rows().select("holding_key", F.col("outcome").alias("o"), F.col("entity_id").alias("e"), F.col("run").alias("first_run"))
        ruled = F.when(F.col("outcome").isin(*vocab.OVERRIDE_ACTIONS), F.col("override_id"))
        link = fresh.select("holding_key", F.col("resolved_entity").alias("entity_id"), "outcome", ruled.alias("override_id")).join(known, "holding_key", "left")
        same = F.coalesce(F.col("o") == F.col("outcome"), F.lit(False)) & F.col("e").eqNullSafe(F.col("entity_id"))
        link = link.withColumn("run", F.when(same, F.col("first_run")).otherwise(F.lit(run)))
        made = written_once(created_by_overrides(resolved, run))
        of_override = resolved.where(F.col("outcome") == "force_new_entity").select(F.col("resolved_entity").alias("entity_id"), F.col("raw_name").alias("alias"))
        new_alias = alias_rows(of_override, run).join(self.aliases.rows().select("entity_id", "alias"), ["entity_id", "alias"], "left_anti")
        items = next_queue(self.queue.rows(), resolver.queue_items(resolved))
        wrote = {
            "created": self.created.merge(made),
            "targets": self.targets.merge(made.select(F.col("origin_key").cast("bigint").alias("override_id"), F.col("entity_id").alias("matched_entity_id"))),
            "aliases": self.aliases.merge(new_alias),
            "queue": self.queue.merge(items),
            "links": self.links.merge(link),
        }
        return resolver.run_summary(resolved), wrote

    def decide(self, base: Corpus, decisions: DataFrame, run: int) -> tuple[DataFrame, dict[str, Merge]]:
        """Apply queue decisions; every decided item, and what was written."""
        corpus = self.corpus(base)
        items = self.queue.rows().where("status = 'open'").drop("resolved_by", "notes", "decided_at")
        done, overrides = resolver.apply_queue_decisions(items, decisions, resolver.group_members(corpus))
        done = written_once(done)
        decided = overrides.withColumn("decided_at", F.col("decided_at").cast("timestamp"))
        after = upsert_overrides(_full(self.all_overrides(base)), decided)
        made = created_by_decisions(done, run)
        link = done.where(F.col("linked_entity").isNotNull()).select("holding_key", F.col("linked_entity").alias("entity_id"), F.col("new_status").alias("outcome"), F.lit(None).cast("bigint").alias("override_id"), F.lit(run).alias("run"))
        wrote = {
            "overrides": self.overrides.merge(after.where(F.col("change").isin("replaced", "inserted")).drop("change")),
            "created": self.created.merge(made),
            "aliases": self.aliases.merge(alias_rows(made.select("entity_id", F.col("canonical_name").alias("alias")), run)),
            "links": self.links.merge(link),
            "queue": self.queue.merge(closed_items(done)),
        }
        freed(done.sparkSession)
        return done, wrote


def _full(overrides: DataFrame) -> DataFrame:
    """Override rows with all columns, those not given as NULL."""
    wide = schema_of(OVERRIDES)
    return overrides.select(*[(F.col(f.name) if f.name in overrides.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wide.fields])
