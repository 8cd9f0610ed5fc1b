"""Deterministic entity resolution of all holdings in one pass.

Order of evidence per holding: existing link, business number, registry
identifier, stored override, exact normalised name; ambiguity is queued.
Candidate sets are never gathered: a key carries only how many entities share
it and the one entity when there is exactly one. Members of an ambiguous key
are rows of `candidate_rows`, those of any queue item rows of `item_candidate_rows`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions import rules
from holdwright.functions.identifiers import business_number, registry_type, registry_value, stable_id
from holdwright.functions.text import normalise_name
from holdwright.operators.skew import ordered_positions, skewed_lookup, with_range_blocks
from holdwright.plans.corpus import Corpus, entity_names
from holdwright.session import written_once


MEMBERS_PER_BLOCK = 10_000

# --- candidates --------------------------------------------------------------


def identifier_members(corpus: Corpus) -> DataFrame:
    """(id_kind, id_value, entity) of business numbers and registry identifiers."""
    abn = corpus.entities.select(F.lit(vocab.ABN_TYPE).alias("id_kind"), business_number(F.col("abn")).alias("id_value"), "entity_id")
    kind = registry_type(F.col("identifier_type"))
    listed = corpus.identifiers.select(kind.alias("id_kind"), registry_value(kind, F.col("identifier_value")).alias("id_value"), "entity_id")
    listed = listed.where(F.col("id_kind").isin(*vocab.REGISTRY_TYPES))
    return abn.unionByName(listed).where(F.col("id_value").isNotNull()).distinct()


def identifier_candidates(corpus: Corpus) -> DataFrame:
    return identifier_members(corpus).groupBy("id_kind", "id_value").agg(
        F.count(F.lit(1)).alias("id_candidates"), F.min("entity_id").alias("id_entity")
    )


def name_members(corpus: Corpus, created: DataFrame | None = None) -> DataFrame:
    """(name_key, entity, type) over canonical names, aliases and new entities."""
    names = entity_names(corpus)
    return names if created is None else names.unionByName(created.select("entity_id", "entity_type", "name_key")).distinct()


def name_candidates(members: DataFrame) -> DataFrame:
    """Candidates of each name, in total and for the two scopes a holding may have."""
    typed = lambda t: F.col("entity_type") == t
    return members.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("name_all"),
        F.count_if(typed("manager")).alias("name_manager"),
        F.count_if(typed("company")).alias("name_company"),
        F.min("entity_id").alias("any_entity"),
        F.min(F.when(typed("manager"), F.col("entity_id"))).alias("manager_entity"),
        F.min(F.when(typed("company"), F.col("entity_id"))).alias("company_entity"),
    )


# --- holdings with their keys ------------------------------------------------


def keyed_holdings(observations: DataFrame) -> DataFrame:
    """What the resolver needs of a holding."""
    kind = registry_type(F.col("identifier_type"))
    scope = rules.holding_scope(
        F.col("manager_entity_id"), F.col("issuer_entity_id"), F.col("ownership_pct"), F.col("source_subclass_raw"), F.col("classification_raw")
    )
    name = normalise_name(F.col("raw_name"))
    return observations.select(
        "holding_key",
        F.col("entity_id").alias("stored_entity"),
        F.when(name != "", name).alias("name_key"),
        "raw_name",
        "fund_code",
        F.col("source_asset_class_raw").alias("asset_class"),
        scope.alias("scope"),
        F.when(kind.isin(vocab.ABN_TYPE, *vocab.REGISTRY_TYPES), kind).alias("id_kind"),
        registry_value(kind, F.col("identifier_value")).alias("id_value"),
        (F.coalesce(F.col("identifier_value"), F.lit("")) != "").alias("id_given"),
    )


# --- overrides ---------------------------------------------------------------

SCOPE_KEYS = ["name_key", "fund_code", "asset_class", "scope"]


def _lattice_key(name: Column, fund: Column, asset_class: Column, kind: Column, untyped: Column) -> Column:
    """One text for a point of the lattice; NULL stands for a wildcard."""
    point = F.struct(name.alias("n"), fund.alias("f"), asset_class.alias("c"), kind.alias("t"), untyped.alias("u"))
    return F.to_json(point, {"ignoreNullFields": "false"})


def override_lattice(corpus: Corpus, now: Column) -> DataFrame:
    """Live overrides at the points of the wildcard lattice, the most specific of each point.

    An override stands at the point of its own fund, class and type, wildcards where it has none. A holding
    of no type takes overrides of any type, so each override also stands at a point for these.
    """
    target_type = corpus.entities.select(F.col("entity_id").alias("matched_entity_id"), F.col("entity_type").alias("target_type"))
    live = corpus.overrides.where(~rules.expired(F.col("expires_at"), now)).join(target_type, "matched_entity_id", "left")
    given = lambda c: F.col(c).isNotNull()
    points = lambda typed: given("fund_code").cast("int") + given("asset_class_scope").cast("int") + typed.cast("int")
    kind = F.col("entity_type_scope")
    places = F.explode(F.array(
        F.struct(kind.alias("t"), F.lit(False).alias("u"), points(given("entity_type_scope")).alias("specificity")),
        F.struct(F.lit(None).cast("string").alias("t"), F.lit(True).alias("u"), points(given("entity_type_scope") & given("matched_entity_id")).alias("specificity")),
    ))
    placed = live.select("*", places.alias("at"))
    keyed = placed.withColumn("point", _lattice_key(F.col("name_key"), F.col("fund_code"), F.col("asset_class_scope"), F.col("at.t"), F.col("at.u")))
    counted = keyed.groupBy("point", F.col("at.specificity").alias("specificity")).agg(
        F.count(F.lit(1)).alias("ties"),
        F.min("override_id").alias("override_id"),
        F.min_by("action", "override_id").alias("action"),
        F.min_by("matched_entity_id", "override_id").alias("target_entity"),
        F.min_by("entity_type_scope", "override_id").alias("new_entity_type"),
        F.bool_or(F.col("target_type") != kind).alias("type_conflict"),
    )
    best = F.max_by(F.struct("specificity", "ties", "override_id", "action", "target_entity", "new_entity_type", "type_conflict"), "specificity").alias("best")
    return counted.groupBy("point").agg(best).select("point", "best.*")


def lattice_points(scopes: DataFrame) -> DataFrame:
    """The points of the lattice that each scope may fit, eight at most."""
    nothing = F.lit(None).cast("string")
    either = lambda c: F.array_distinct(F.array(F.col(c), nothing))
    wide = scopes.withColumn("f", F.explode(either("fund_code"))).withColumn("c", F.explode(either("asset_class"))).withColumn("t", F.explode(either("scope")))
    return wide.withColumn("point", _lattice_key(F.col("name_key"), F.col("f"), F.col("c"), F.col("t"), F.col("scope").isNull())).drop("f", "c", "t")


def overridden_names(corpus: Corpus, now: Column) -> DataFrame:
    """Names that have a live override."""
    return corpus.overrides.where(~rules.expired(F.col("expires_at"), now)).select("name_key").distinct()


def picked_overrides(holdings: DataFrame, corpus: Corpus, now: Column) -> DataFrame:
    """The override for each distinct (name, fund, class, scope) of the holdings.

    Holdings are reduced to their distinct scopes. A scope asks the eight points of the
    lattice it may fit, by equality, so the join gives at most eight rows for a scope however many
    overrides share its name. Several equally specific overrides are a conflict.
    """
    scopes = holdings.where(F.col("name_key").isNotNull()).select(*SCOPE_KEYS).distinct()
    scopes = scopes.join(overridden_names(corpus, now), "name_key", "left_semi")
    fits = lattice_points(scopes).join(override_lattice(corpus, now), "point")
    ranked = fits.groupBy(*SCOPE_KEYS, "specificity").agg(
        F.sum("ties").alias("ties"),
        F.min("override_id").alias("override_id"),
        F.min_by("action", "override_id").alias("action"),
        F.min_by("target_entity", "override_id").alias("target_entity"),
        F.min_by("new_entity_type", "override_id").alias("new_entity_type"),
        F.bool_or("type_conflict").alias("type_conflict"),
    )
    best = F.max_by(F.struct("override_id", "action", "target_entity", "new_entity_type", "ties", "type_conflict", "specificity"), "specificity")
    return ranked.groupBy(*SCOPE_KEYS).agg(best.alias("best")).select(*SCOPE_KEYS, "best.*")


def with_override(holdings: DataFrame, picks: DataFrame, how: str = "left") -> DataFrame:
    """Holdings with the override picked for their scope; `inner` keeps only those with one."""
    nullable = lambda c: F.coalesce(F.col(c), F.lit("\u0000"))
    keyed = {k: f"k_{k}" for k in SCOPE_KEYS}
    left, right = holdings, picks
    for k, alias in keyed.items():
        left = left.withColumn(alias, F.col(k) if k == "name_key" else nullable(k))
        right = right.withColumn(alias, F.col(k) if k == "name_key" else nullable(k))
    right = right.drop(*SCOPE_KEYS)
    if how == "left":
        joined = skewed_lookup(left, right, list(keyed.values()), ["holding_key"]).drop(*keyed.values())
    else:
        joined = left.join(right, list(keyed.values())).drop(*keyed.values())
    needs_target = F.col("action").isin("force_match", "redirect_to_parent") & F.col("target_entity").isNull()
    conflict = F.col("override_id").isNotNull() & ((F.col("ties") > 1) | F.coalesce("type_conflict", F.lit(False)) | needs_target)
    return joined.withColumn("override_conflict", F.coalesce(conflict, F.lit(False)))


def created_entities(candidates: DataFrame) -> DataFrame:
    """One new entity per force-new override that applied and has no target yet."""
    applied = candidates.where(F.col("override_applies") & (F.col("action") == "force_new_entity") & F.col("target_entity").isNull())
    made = applied.groupBy("override_id").agg(
        F.min_by("raw_name", "holding_key").alias("canonical_name"), F.min("new_entity_type").alias("entity_type")
    )
    return made.select(
        stable_id(F.lit("override"), F.col("override_id")).alias("entity_id"),
        F.coalesce("entity_type", F.lit("company")).alias("entity_type"),
        "canonical_name",
        normalise_name(F.col("canonical_name")).alias("name_key"),
        "override_id",
    )


# --- the cascade -------------------------------------------------------------


def first_stage(rows: DataFrame, picks: DataFrame, corpus: Corpus, force_rerun: bool = False, how: str = "left") -> DataFrame:
    """Override and identifier evidence of keyed holdings."""
    rows = with_override(rows, picks, how)
    rows = rows.withColumn("prelinked", F.lit(False) if force_rerun else F.col("stored_entity").isNotNull())
    rows = skewed_lookup(rows, identifier_candidates(corpus), ["id_kind", "id_value"], ["holding_key"])
    hits = F.coalesce("id_candidates", F.lit(0))
    rows = rows.withColumn("id_hits", hits).withColumn("id_matched", ~F.col("prelinked") & (hits == 1))
    applies = ~F.col("prelinked") & ~F.col("id_matched") & F.col("override_id").isNotNull() & ~F.col("override_conflict")
    return rows.withColumn("override_applies", applies)


def resolve(
    corpus: Corpus, now: Column, observations: DataFrame | None = None, force_rerun: bool = False, clear_stale: bool = False,
    keep: Callable[[DataFrame], DataFrame] = partial(written_once, compression="zstd"),
) -> DataFrame:
    """Outcome and entity of every holding.

    Overrides act first and names second, so an entity created by an override
    is a name candidate for every holding whatever the row order. The keyed
    holdings and the picked overrides are read several times; `keep` decides
    how they are held (by default as written tables). Holdings that have a link ask nothing, so they take no part
    in the lookups (unless all are run again) and carry no evidence of their own.
    """
    keyed = keep(keyed_holdings(corpus.observations if observations is None else observations))
    asking = keyed if force_rerun else keyed.where(F.col("stored_entity").isNull())
    picks = keep(picked_overrides(asking, corpus, now))
    creating = picks.where((F.col("action") == "force_new_entity") & F.col("target_entity").isNull())
    created = created_entities(first_stage(asking, creating, corpus, force_rerun, how="inner"))
    rows = first_stage(asking, picks, corpus, force_rerun)
    names = name_candidates(name_members(corpus, created))
    rows = skewed_lookup(rows, names, ["name_key"], ["holding_key"])
    if not force_rerun:
        nothing = {"prelinked": F.lit(True), "override_conflict": F.lit(False), "id_hits": F.lit(0).cast("bigint"), "id_matched": F.lit(False), "override_applies": F.lit(False)}
        rows = rows.unionByName(keyed.where(F.col("stored_entity").isNotNull()).withColumns(nothing), allowMissingColumns=True)
    scoped = F.when(F.col("scope") == "manager", F.col("name_manager")).when(F.col("scope") == "company", F.col("name_company")).otherwise(F.col("name_all"))
    scoped_entity = F.when(F.col("scope") == "manager", F.col("manager_entity")).when(F.col("scope") == "company", F.col("company_entity")).otherwise(F.col("any_entity"))
    is_abn = F.col("id_kind") == vocab.ABN_TYPE
    asks_name = ~F.col("prelinked") & ~F.col("id_matched") & ~F.col("override_applies") & ~F.col("override_conflict") & (F.col("id_hits") <= 1)
    rows = rows.withColumn("name_hits", F.when(asks_name, F.coalesce(scoped, F.lit(0))).otherwise(F.lit(0)))
    rows = rows.withColumn("name_rejected", F.when(asks_name, F.coalesce(F.col("name_all") - scoped, F.lit(0))).otherwise(F.lit(0)))
    outcome = (
        F.when(F.col("prelinked"), "prelinked")
        .when(F.col("id_matched") & is_abn, "abn")
        .when(F.col("id_matched"), "identifier")
        .when(F.col("override_conflict"), "override_conflict")
        .when(F.col("override_applies"), F.col("action"))
        .when((F.col("id_hits") > 1) & is_abn, "ambiguous_abn")
        .when(F.col("id_hits") > 1, "ambiguous_identifier")
        .when(F.col("name_hits") == 1, "exact_name")
        .when(F.col("name_hits") > 1, "ambiguous_name")
        .otherwise("unresolved")
    )
    rows = rows.withColumn("outcome", outcome)
    new_id = stable_id(F.lit("override"), F.col("override_id"))
    found = (
        F.when(F.col("outcome") == "prelinked", F.col("stored_entity"))
        .when(F.col("outcome").isin("abn", "identifier"), F.col("id_entity"))
        .when(F.col("outcome") == "force_no_match", F.lit(None).cast("bigint"))
        .when(F.col("outcome").isin("force_match", "redirect_to_parent"), F.col("target_entity"))
        .when(F.col("outcome") == "force_new_entity", F.coalesce("target_entity", new_id))
        .when(F.col("outcome") == "exact_name", scoped_entity)
    )
    if force_rerun and not clear_stale:
        found = F.when(F.col("outcome") == "force_no_match", found).otherwise(F.coalesce(found, F.col("stored_entity")))
    rows = rows.withColumn("resolved_entity", found)
    score = F.when(F.col("outcome").isin("ambiguous_abn", "ambiguous_identifier"), vocab.IDENTIFIER_SCORE).when(F.col("outcome") == "ambiguous_name", vocab.NAME_SCORE)
    return rows.withColumn("queue_score", score.cast("decimal(6,5)"))


def run_summary(resolved: DataFrame) -> DataFrame:
    """The run's counters in one row."""
    is_abn = F.col("id_kind") == vocab.ABN_TYPE
    listed = F.col("id_kind").isin(*vocab.REGISTRY_TYPES)
    asked = ~F.col("prelinked") & F.col("id_kind").isNotNull() & F.col("id_given")
    by = lambda o: F.count_if(F.col("outcome") == o)
    made = F.when((F.col("outcome") == "force_new_entity") & F.col("target_entity").isNull(), F.col("override_id"))
    return resolved.agg(
        F.count(F.lit(1)).alias("holdings_scanned"),
        by("prelinked").alias("holdings_skipped_prelinked"),
        by("abn").alias("abn_matches"),
        by("identifier").alias("security_identifier_matches"),
        F.count_if(asked & is_abn & (F.col("id_hits") == 0)).alias("unresolved_abn"),
        F.count_if(asked & listed & (F.col("id_hits") == 0)).alias("unresolved_security_identifier"),
        F.count_if(asked & is_abn & (F.col("id_hits") > 1)).alias("ambiguous_abn"),
        F.count_if(asked & listed & (F.col("id_hits") > 1)).alias("ambiguous_security_identifier"),
        by("force_match").alias("force_match_applications"),
        by("force_no_match").alias("force_no_match_suppressions"),
        F.count_distinct(made).alias("force_new_entity_creations"),
        by("redirect_to_parent").alias("redirect_to_parent_applications"),
        by("exact_name").alias("exact_name_auto_links"),
        by("ambiguous_name").alias("exact_name_ambiguities_queued"),
        F.coalesce(F.sum("name_rejected"), F.lit(0)).cast("bigint").alias("exact_name_candidates_rejected"),
        F.count_if(F.col("resolved_entity").isNull()).alias("unresolved_rows_remaining"),
        F.count_if(F.col("resolved_entity").isNull() & F.col("name_key").isNotNull()).alias("unresolved_named_rows"),
    )


# --- review queue ------------------------------------------------------------


def queue_items(resolved: DataFrame) -> DataFrame:
    """Open items: one per ambiguous holding, pointing at its candidate group."""
    ambiguous = resolved.where(F.col("outcome").startswith("ambiguous"))
    by_name = F.col("outcome") == "ambiguous_name"
    return ambiguous.select(
        "holding_key",
        F.when(by_name, F.lit("NAME")).otherwise(F.col("id_kind")).alias("group_kind"),
        F.when(by_name, F.col("name_key")).otherwise(F.col("id_value")).alias("group_key"),
        F.when(by_name, F.col("scope")).alias("group_scope"),
        F.when(by_name, F.col("name_hits")).otherwise(F.col("id_hits")).alias("candidate_count"),
        F.col("queue_score").alias("top_candidate_score"),
        "raw_name", "fund_code", "asset_class", "scope", "name_key",
        F.lit("open").alias("status"),
    )


def upsert_queue(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Open items of the new run replace the open item of the same holding."""
    keep = stored.join(found.select("holding_key"), "holding_key", "left_anti").unionByName(
        stored.where(F.col("status") != "open").join(found.select("holding_key"), "holding_key", "left_semi")
    )
    return keep.unionByName(found.select(*stored.columns))


def group_members(corpus: Corpus, created: DataFrame | None = None) -> DataFrame:
    """(group_kind, group_key, group_scope, entity, type) of all groups that a queue item may point at.

    A name has a group for each scope of a holding: all its entities, and those of the scope's type.
    """
    types = corpus.entities.select("entity_id", "entity_type")
    listed = identifier_members(corpus).join(types, "entity_id", "left")
    identified = listed.select(F.col("id_kind").alias("group_kind"), F.col("id_value").alias("group_key"), F.lit(None).cast("string").alias("group_scope"), "entity_id", "entity_type")
    scopes = F.explode(F.array(F.lit(None).cast("string"), F.lit("manager"), F.lit("company")))
    named = name_members(corpus, created).withColumn("group_scope", scopes).where(F.col("group_scope").isNull() | (F.col("group_scope") == F.col("entity_type")))
    return identified.unionByName(named.select(F.lit("NAME").alias("group_kind"), F.col("name_key").alias("group_key"), "group_scope", "entity_id", "entity_type"))


def _group() -> Column:
    return F.concat_ws("\u0001", "group_kind", F.coalesce("group_scope", F.lit("")), "group_key")


def _ambiguous(corpus: Corpus, members: DataFrame, key: str) -> DataFrame:
    """Members of every key with several, in entity order, whatever range the ids span."""
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("group_rows"))
    shared = skewed_lookup(members, counts, [key], ["entity_id"]).where(F.col("group_rows") > 1)
    shared = with_range_blocks(shared, "entity_id", MEMBERS_PER_BLOCK, "id_range")
    placed = ordered_positions(shared, [key], F.col("id_range"), ["entity_id"]).drop("id_range")
    names = corpus.entities.select("entity_id", "canonical_name", "abn")
    return placed.join(names, "entity_id", "left")


def candidate_rows(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    """Members of every ambiguous name, in entity order."""
    members = name_members(corpus) if members is None else members
    return _ambiguous(corpus, members, "name_key").select("name_key", "position", "entity_id", "entity_type", "canonical_name", "abn", "group_rows")


def item_candidate_rows(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    """Members of every ambiguous group, identifiers included, keyed as queue items are."""
    members = group_members(corpus) if members is None else members
    placed = _ambiguous(corpus, members.withColumn("group", _group()), "group")
    return placed.select("group_kind", "group_key", "group_scope", "position", "entity_id", "entity_type", "canonical_name", "abn", "group_rows")


def apply_queue_decisions(items: DataFrame, decisions: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve queue items and derive the persistent overrides.

    decisions: holding_key, action (accept | reject | create_new),
    chosen_entity_id, resolved_by, notes, decided_at. The first decision on an
    open item counts. An accept must name one of the candidates of the item's group
    (`members`: those of group_members, with every created entity), and an
    item without a name takes no decision: its override would stand for every
    nameless row of the fund.
    """
    first = decisions.groupBy("holding_key").agg(
        F.min_by(F.struct("action", "chosen_entity_id", "resolved_by", "notes", "decided_at"), "decided_at").alias("d")
    )
    picked = items.join(first, "holding_key").select("*", "d.*").drop("d")
    known = members.select(_group().alias("m_group"), F.col("entity_id").alias("m_entity"), F.lit(True).alias("is_candidate")).distinct()
    on = (_group() == F.col("m_group")) & (F.col("chosen_entity_id") == F.col("m_entity"))
    picked = picked.join(known, on, "left")
    valid = (
        F.when((F.col("status") != "open") | (F.coalesce(F.trim("name_key"), F.lit("")) == ""), F.lit(False))
        .when(F.col("action") == "accept", F.coalesce("is_candidate", F.lit(False)))
        .when(F.col("action") == "create_new", F.col("raw_name").isNotNull())
        .otherwise(F.col("action") == "reject")
    )
    picked = picked.withColumn("is_valid", valid)
    status = F.when(~F.col("is_valid"), F.col("status")).when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").otherwise("created_new")
    new_id = stable_id(F.lit("queue"), F.col("holding_key"))
    linked = F.when(F.col("is_valid") & (F.col("action") == "accept"), F.col("chosen_entity_id")).when(F.col("is_valid") & (F.col("action") == "create_new"), new_id)
    reason = F.concat(F.lit("Entity resolution queue item "), F.col("holding_key"), F.lit(" action "), F.col("action"), F.lit("."))
    note = F.trim("notes")
    reason = F.when(F.coalesce(note, F.lit("")) == "", reason).otherwise(F.concat(reason, F.lit(" Notes: "), note))
    override_action = F.when(F.col("action") == "accept", "force_match").when(F.col("action") == "reject", "force_no_match").otherwise("force_new_entity")
    done = picked.withColumn("new_status", status).withColumn("linked_entity", linked).withColumn("reason", reason).withColumn("override_action", override_action)
    overrides = (
        done.where("is_valid")
        .groupBy("name_key", "fund_code", "asset_class", "scope")
        .agg(F.max_by(F.struct("override_action", "linked_entity", "resolved_by", "reason", "decided_at"), F.struct("decided_at", "holding_key")).alias("o"))
        .select("name_key", "fund_code", F.col("asset_class").alias("asset_class_scope"), F.col("scope").alias("entity_type_scope"),
                F.col("o.override_action").alias("action"), F.col("o.linked_entity").alias("matched_entity_id"), F.col("o.resolved_by").alias("created_by"), F.col("o.reason").alias("reason"), F.col("o.decided_at").alias("decided_at"))
    )
    return done, overrides
