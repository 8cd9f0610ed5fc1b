"""Resolver precedence, queue, overrides and reference data on small worked cases."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from holdwright.operators import governance, reconcile, seeds
from holdwright.plans import resolver
from holdwright.plans.binding import DriverTables
from holdwright.plans.corpus import Corpus
from holdwright.plans.read_models import entity_slices, name_in_corpus, search, search_facets

OBS = "holding_key string, raw_name string, fund_code string, source_asset_class_raw string, source_subclass_raw string, classification_raw string, ownership_pct decimal(18,9), identifier_type string, identifier_value string, entity_id bigint, manager_entity_id bigint, issuer_entity_id bigint"


def holding(key, name=None, fund="f1", cls="Cash", subclass=None, classification=None, owned=None, kind=None, value=None, entity=None, manager=None, issuer=None):
    return (key, name, fund, cls, subclass, classification, owned, kind, value, entity, manager, issuer)


@pytest.fixture(scope="module")
def corpus(spark):
    entities = [
        (1, "company", "Quay Bank", "11 222 333 444", "seeded"),
        (2, "company", "Reef Bond", "55666777888", None),
        (3, "company", "Reef Bond Two", "55 666 777 888", None),
        (4, "manager", "Osprey", None, "high"),
        (5, "company", "Osprey", None, None),
        (6, "manager", "Tern", None, None),
        (7, "company", "Gull  Tower", None, None),
        (8, "company", "Alias Home", None, None),
    ]
    aliases = [(8, "gull tower", True, "gull tower"), (6, "Tern Partners", True, "tern partners")]
    identifiers = [(1, "ISIN", "AU0000QUAY01"), (2, "isin", "au shared 1"), (3, "ISIN", "AUSHARED1"), (4, "SEDOL", "B0OSPRY"), (6, "ASX", "TRN AU")]
    overrides = [
        (1, "plover", None, None, None, "force_match", 1, None),
        (2, "plover", "f1", None, None, "force_match", 2, None),
        (3, "plover", "f1", "Equity", None, "force_no_match", None, None),
        (4, "stork", None, None, None, "force_match", 1, None),
        (5, "stork", None, None, None, "force_match", 2, None),
        (6, "heron", None, None, None, "force_new_entity", None, None),
        (7, "egret", None, None, None, "force_match", 1, "1999-01-01"),
        (8, "reef bond", None, None, None, "redirect_to_parent", 3, None),
        (9, "kite", None, None, "manager", "force_match", 4, None),
    ]
    e = spark.createDataFrame(entities, "entity_id bigint, entity_type string, canonical_name string, abn string, confidence_tier string")
    a = spark.createDataFrame(aliases, "entity_id bigint, alias string, is_preferred boolean, alias_normalized string")
    i = spark.createDataFrame(identifiers, "entity_id bigint, identifier_type string, identifier_value string")
    o = spark.createDataFrame(overrides, "override_id bigint, name_key string, fund_code string, asset_class_scope string, entity_type_scope string, action string, matched_entity_id bigint, expires_at string").withColumn("expires_at", F.to_date("expires_at"))
    return Corpus(None, None, e, a, i, o, None, None)


def outcomes(spark, corpus, rows, **kw):
    df = spark.createDataFrame(rows, OBS)
    got = resolver.resolve(corpus, F.lit("2026-01-01").cast("date"), observations=df, **kw)
    return {r.holding_key: (r.outcome, r.resolved_entity) for r in got.collect()}


def test_order_of_evidence(spark, corpus):
    rows = [
        holding("prelinked", "Quay Bank", entity=7),
        holding("abn", "Reef Bond", kind="abn", value="11222333444"),
        holding("abn_two", "No One", kind="ABN", value="55 666 777 888"),
        holding("abn_bad", "Quay Bank", kind="ABN", value="123"),
        holding("isin", "x", kind="Isin", value="au0000 quay01"),
        holding("isin_two", "Osprey", kind="ISIN", value="AUSHARED1"),
        holding("isin_two_override", "Reef  Bond", kind="ISIN", value="AUSHARED1"),
        holding("asx_suffix", "x", kind="ASX_CODE", value="TRN  AU"),
        holding("sedol", "x", kind="SEDOL", value="B0OSPRY"),
        holding("name", " quay  BANK"),
        holding("name_alias", "TERN partners"),
        holding("name_two", "Osprey"),
        holding("name_scoped", "Osprey", subclass="Externally Managed"),
        holding("name_owned", "Osprey", subclass="Externally Managed", owned=None, classification=None, issuer=9),
        holding("name_three", "GULL TOWER"),
        holding("nothing", "Nobody"),
        holding("unnamed"),
    ]
    got = outcomes(spark, corpus, rows)
    assert got == {
        "prelinked": ("prelinked", 7),
        "abn": ("abn", 1),
        "abn_two": ("ambiguous_abn", None),
        "abn_bad": ("exact_name", 1),
        "isin": ("identifier", 1),
        "isin_two": ("ambiguous_identifier", None),
        "isin_two_override": ("redirect_to_parent", 3),
        "asx_suffix": ("identifier", 6),
        "sedol": ("unresolved", None),
        "name": ("exact_name", 1),
        "name_alias": ("exact_name", 6),
        "name_two": ("ambiguous_name", None),
        "name_scoped": ("exact_name", 4),
        "name_owned": ("exact_name", 5),
        "name_three": ("ambiguous_name", None),
        "nothing": ("unresolved", None),
        "unnamed": ("unresolved", None),
    }


def test_overrides(spark, corpus):
    rows = [
        holding("any_fund", "Plover", fund="f2"),
        holding("one_fund", "plover", fund="f1"),
        holding("fund_and_class", "PLOVER", fund="f1", cls="Equity"),
        holding("tie", "Stork"),
        holding("new_a", "Heron", fund="f9"),
        holding("new_b", "heron"),
        holding("expired", "Egret"),
        holding("typed", "Kite", subclass="Internally Managed"),
        holding("typed_ok", "Kite", subclass="Externally Managed"),
    ]
    got = outcomes(spark, corpus, rows)
    made = got["new_a"][1]
    assert got["any_fund"] == ("force_match", 1) and got["one_fund"] == ("force_match", 2) and got["fund_and_class"] == ("force_no_match", None)
    assert got["tie"] == ("override_conflict", None)
    assert made is not None and got["new_b"] == ("force_new_entity", made)
    assert got["expired"] == ("unresolved", None)
    assert got["typed"] == ("unresolved", None) and got["typed_ok"] == ("force_match", 4)


def test_new_entity_is_a_name_for_other_rows(spark, corpus):
    # the same name with an ambiguous identifier takes the override too; a longer name does not match
    got = outcomes(spark, corpus, [holding("a", "Heron"), holding("b", "Heron Ltd")])
    assert got["a"][0] == "force_new_entity" and got["b"] == ("unresolved", None)


def test_second_run_changes_nothing(spark, tiny):
    corpus = DriverTables(spark, tiny).corpus
    now = F.lit("2000-01-01").cast("date")
    first = resolver.resolve(corpus, now).select("holding_key", "resolved_entity").persist()
    linked = corpus.observations.drop("entity_id").join(first.withColumnRenamed("resolved_entity", "entity_id"), "holding_key")
    again = resolver.resolve(dataclasses.replace(corpus, observations=linked), now)
    moved = again.join(first.select("holding_key", F.col("resolved_entity").alias("before")), "holding_key").where(~F.col("before").eqNullSafe(F.col("resolved_entity")))
    assert moved.count() == 0
    assert again.where("resolved_entity IS NOT NULL AND outcome <> 'prelinked'").count() == 0
    first.unpersist()


def test_rerun_with_links(spark, corpus):
    rows = [holding("moved", "Quay Bank", entity=7), holding("lost", "Nobody", entity=7)]
    assert outcomes(spark, corpus, rows, force_rerun=True) == {"moved": ("exact_name", 1), "lost": ("unresolved", 7)}
    assert outcomes(spark, corpus, rows, force_rerun=True, clear_stale=True)["lost"] == ("unresolved", None)


def test_queue_upsert(spark):
    schema = "holding_key string, candidate_count bigint, status string"
    stored = spark.createDataFrame([("a", 2, "open"), ("a", 5, "rejected"), ("b", 3, "open")], schema)
    found = spark.createDataFrame([("a", 4, "open"), ("c", 2, "open")], schema)
    got = sorted(tuple(r) for r in resolver.upsert_queue(stored, found).collect())
    assert got == [("a", 4, "open"), ("a", 5, "rejected"), ("b", 3, "open"), ("c", 2, "open")]


def test_queue_items_of_any_kind_have_candidates(spark, corpus):
    """Items of names in a scope, business numbers and registry identifiers point at members, and an accept is checked against them."""
    rows = [holding("abn", "Nobody", kind="ABN", value="55 666 777 888"), holding("isin", "No One", kind="ISIN", value="AU SHARED1"), holding("name", "Osprey"), holding("other", "Someone", kind="ABN", value="55666777888")]
    resolved = resolver.resolve(dataclasses.replace(corpus, observations=spark.createDataFrame(rows, OBS)), F.lit("2000-01-01").cast("date"))
    items = resolver.queue_items(resolved).persist()
    assert {(r.holding_key, r.group_kind, r.candidate_count) for r in items.collect()} == {("abn", "ABN", 2), ("isin", "ISIN", 2), ("name", "NAME", 2), ("other", "ABN", 2)}
    listed = resolver.item_candidate_rows(corpus).collect()
    for item in items.collect():
        own = [r for r in listed if (r.group_kind, r.group_key, r.group_scope) == (item.group_kind, item.group_key, item.group_scope)]
        assert sorted((r.position, r.entity_id) for r in own) == ([(1, 4), (2, 5)] if item.group_kind == "NAME" else [(1, 2), (2, 3)])
        assert {r.group_rows for r in own} == {item.candidate_count}
    assert {(r.group_key, r.group_scope, r.entity_id) for r in listed if r.group_scope} == {("gull tower", "company", 7), ("gull tower", "company", 8)}
    decisions = spark.createDataFrame(
        [("abn", "accept", 3), ("isin", "accept", 2), ("name", "accept", 5), ("other", "accept", 4)], "holding_key string, action string, chosen_entity_id bigint"
    ).selectExpr("*", "'me' AS resolved_by", "CAST(NULL AS string) AS notes", "DATE'2000-01-01' AS decided_at")
    done, overrides = resolver.apply_queue_decisions(items, decisions, resolver.group_members(corpus))
    assert {(r.holding_key, r.is_valid, r.linked_entity) for r in done.collect()} == {("abn", True, 3), ("isin", True, 2), ("name", True, 5), ("other", False, None)}
    assert {(r.name_key, r.matched_entity_id) for r in overrides.collect()} == {("nobody", 3), ("no one", 2), ("osprey", 5)}
    items.unpersist()


def test_slices_add_up(spark, tiny):
    """A row counts once per entity, whatever the number of links."""
    corpus = DriverTables(spark, tiny).corpus
    total = entity_slices(corpus, ["fund_code"], links=["entity_id"]).agg(F.sum("rows")).first()[0]
    rows = corpus.observations.where("is_current AND has_name").select("holding_key", "entity_id", resolver.normalise_name(F.col("raw_name")).alias("n"))
    pairs = rows.select("holding_key", "entity_id").where("entity_id IS NOT NULL")
    named = rows.join(resolver.name_members(corpus).select("name_key", F.col("entity_id").alias("e")), F.col("n") == F.col("name_key")).select("holding_key", F.col("e").alias("entity_id"))
    assert total == pairs.union(named).distinct().count()


def test_search(spark, tiny):
    corpus = DriverTables(spark, tiny).corpus
    code = corpus.source_files.select("fund_code").first()[0]
    top = search(corpus, f" {code.lower()} ", limit=1).first()
    assert (top.kind, top.fund_code, top.score, top.matched_on) == ("fund", code, 640, "fund_code")
    assert search(corpus, "supplier", kind="manager").where("kind <> 'manager'").count() == 0
    assert search_facets(corpus, "zzz").collect()[0].asDict() == {"kind": "all", "result_count": 0}
    with pytest.raises(ValueError):
        search(corpus, "  ")
    assert name_in_corpus(corpus, "ring") and not name_in_corpus(corpus, "zzz") and not name_in_corpus(corpus, " ")


def test_seed_upsert(spark, corpus):
    reference = spark.createDataFrame(
        [("Quay Bank", "company", "11222333444", "seeded"), ("Tern", "manager", "99999999999", "high"), ("Osprey", "manager", None, "low"), ("Brand New", "company", "1", "seeded")],
        "canonical_name string, entity_type string, abn string, confidence_tier string",
    )
    cells = {(r.canonical_name, r.column_name, r.entity_id): r.outcome for r in seeds.compared_columns(corpus.entities, reference, ["abn", "confidence_tier"]).collect()}
    assert cells[("Quay Bank", "abn", 1)] == "kept" and cells[("Tern", "abn", 6)] == "filled"
    assert cells[("Osprey", "confidence_tier", 4)] == "conflict" and cells[("Osprey", "confidence_tier", 5)] == "conflict"
    assert cells[("Brand New", "abn", None)] == "created"
    after = {r.canonical_name + r.entity_type: r for r in seeds.upsert_entities(corpus.entities, reference, ["abn", "confidence_tier"]).collect()}
    assert after["Ternmanager"].abn == "99999999999" and after["Ospreymanager"].confidence_tier == "high"
    assert after["Brand Newcompany"].entity_id > 0 and len(after) == 9
    forced = seeds.upsert_entities(corpus.entities, reference, ["confidence_tier"], overwrite=True).where("entity_id = 4").first()
    assert forced.confidence_tier == "low"


def test_review_decisions(spark):
    items = spark.createDataFrame([(i, "open", None if i == 4 else "fp") for i in range(1, 7)], "item_id int, status string, schema_fingerprint string")
    decisions = spark.createDataFrame(
        [(1, "resolve", None, "r", 1), (1, "reject", None, "r", 2), (2, "approve", " v1 ", "r", 3), (3, "approve", "v1", "r", 4), (4, "approve", "v2", "r", 1), (5, "approve", "v3", " ", 1)],
        "item_id int, action string, mapping_version_id string, approved_by string, decided_at int",
    )
    taxonomy = spark.createDataFrame(
        [("v1", "Cash", None, None, False), ("v3", "Cash", None, None, False), ("v3", "Cash", None, None, False)],
        "mapping_version_id string, source_asset_class_raw string, source_filter_raw string, source_section_raw string, is_aggregate_default boolean",
    )
    got = {r.item_id: (r.new_status, r.approved_version) for r in governance.apply_review_decisions(items, decisions, taxonomy=taxonomy).collect()}
    assert got == {1: ("resolved", None), 2: ("resolved", "v1"), 3: ("open", None), 4: ("open", None), 5: ("open", None), 6: ("open", None)}


def test_manifest(spark):
    manifest = spark.createDataFrame([("a", "f", 3, "v1"), ("b", "f", 2, "v1"), ("c", "g", 1, None)], "file string, fund_code string, expected_rows bigint, expected_version string")
    loaded = spark.createDataFrame([("a", 3, "v1"), ("b", 1, "v1"), ("c", 1, "v9"), ("d", 1, None)], "file string, observed_rows bigint, observed_version string")
    files = reconcile.reconcile_files(manifest, loaded, ["file"])
    assert {r.file: r.status for r in files.collect()} == {"a": "ok", "b": "row_count", "c": "mapping_version", "d": "unlisted"}
    funds = {r.fund_code: (r.row_delta, r.is_within_tolerance) for r in reconcile.reconcile_funds(files.where("fund_code IS NOT NULL"), 0).collect()}
    assert funds == {"f": (1, False), "g": (0, True)}
    declared = spark.createDataFrame([("f", 2, 5), ("g", 2, 1)], "fund_code string, expected_source_file_count bigint, expected_row_count bigint")
    assert [r.fund_code for r in reconcile.manifest_problems(declared, manifest).collect()] == ["g"]
