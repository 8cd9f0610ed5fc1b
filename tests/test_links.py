"""Keyed tables, and resolver runs that keep what they find."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from holdwright.plans import ingest, links
from holdwright.plans import read_models as rm
from holdwright.plans.corpus import Corpus
from holdwright.sources.files import read_files
from holdwright.sources.keyed import KeyedTable
from holdwright.sources.layouts import LAYOUTS
from holdwright.sources.store import Store
from tests import layout_files as lf

SCHEMA = "name string, kind string, n int, told string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "keyed"), links.schema_of(SCHEMA), ["name", "kind"], buckets=4)


def held(table, snapshot=None):
    return sorted((tuple(r) for r in table.rows(snapshot).collect()), key=str)


def test_merges_change_only_what_differs(spark, table):
    rows = [(f"k{i}", None if i % 3 == 0 else "x", i, "a") for i in range(40)]
    first = table.merge(spark.createDataFrame(rows, SCHEMA))
    assert first.snapshot == 1 and first.written == [0, 1, 2, 3] and held(table) == sorted(rows, key=str)
    again = table.merge(spark.createDataFrame(rows, SCHEMA))
    assert again.snapshot == 1 and again.written == [] and table.snapshots() == [1]
    one = table.merge(spark.createDataFrame([("k3", None, 3, "b"), ("k4", "x", 4, "a")], SCHEMA))
    assert len(one.read) <= 2 and len(one.written) == 1 and one.snapshot == 2
    assert ("k3", None, 3, "b") in held(table) and len(held(table)) == 40
    assert ("k3", None, 3, "a") in held(table, 1), "an older snapshot reads as it was"
    new = table.merge(spark.createDataFrame([("k99", None, 1, "z"), ("k99", None, 2, "y")], SCHEMA), latest=["n"])
    assert len(new.written) == 1 and ("k99", None, 2, "y") in held(table) and len(held(table)) == 41
    assert table.merge(spark.createDataFrame([], SCHEMA)).written == []


def test_a_second_publisher_fails_and_nothing_is_half_seen(spark, table):
    table.merge(spark.createDataFrame([("a", "x", 1, "a")], SCHEMA))
    before = held(table)
    with pytest.raises(RuntimeError):
        table._publish({}, 1)
    assert held(table) == before and table.snapshots() == [1]


def test_expired_snapshots_leave_no_folder(spark, table, tmp_path):
    for k in range(4):
        table.merge(spark.createDataFrame([("a", "x", k, "a"), ("b", "x", 0, "a"), ("c", "y", 0, "a")], SCHEMA))
    table.expire(keep=1)
    assert table.snapshots() == [4]
    assert held(table) == [("a", "x", 3, "a"), ("b", "x", 0, "a"), ("c", "y", 0, "a")]
    named = {f.split("/")[1] for f in table._folders().values()}
    assert {p.name for p in (tmp_path / "keyed" / "data").iterdir()} == named
    assert [p.name for p in (tmp_path / "keyed" / "staged").iterdir()] == []


@pytest.fixture(scope="module")
def base(spark):
    entities = [(1, "company", "Kelp Foods", None, None), (2, "company", "Gull Tower", None, None), (3, "company", "Reef Bank", None, None), (4, "company", "Reef  bank", None, None)]
    identifiers = [(1, "ISIN", "AU000000KLP1")]
    overrides = [(70, "quay bank", None, None, None, "force_new_entity", None, None), (71, "plover credit", "harbour", None, None, "force_no_match", None, None)]
    return Corpus(
        observations=None, source_files=None,
        entities=spark.createDataFrame(entities, "entity_id bigint, entity_type string, canonical_name string, abn string, confidence_tier string"),
        aliases=spark.createDataFrame([], "entity_id bigint, alias string, is_preferred boolean, alias_normalized string"),
        identifiers=spark.createDataFrame(identifiers, "entity_id bigint, identifier_type string, identifier_value string"),
        overrides=spark.createDataFrame(overrides, "override_id bigint, name_key string, fund_code string, asset_class_scope string, entity_type_scope string, action string, matched_entity_id bigint, expires_at date"),
        holding_relations=None, entity_relations=None,
    )


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    lf.put(root, "flat11", "harbour", lf.NONE, "flat.csv", lf.flat_11())
    typed = ingest.typed_rows_of(ingest.records_of(read_files(spark, str(root))), ["flat11"])
    nothing = ingest.derived_mapping(spark, LAYOUTS["flat11"], "v", ingest.file_profiles(typed), typed)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest.load_batch(store, read_files(spark, str(root)), nothing[0].limit(0), nothing[1].limit(0), batch=1)
    return store


def linked(store):
    return {(r.raw_name, r.entity_id) for r in ingest.stored_observations(store).where("raw_name is not null").collect()}


def now():
    return F.lit("2025-01-01").cast("date")


def test_from_bytes_to_company_view(spark, store, base):
    counters, wrote = ingest.resolve_stored(store, base, now(), 1)
    assert wrote["links"].written and wrote["created"].written
    c = counters.first()
    assert (c.security_identifier_matches, c.exact_name_auto_links, c.force_new_entity_creations, c.exact_name_ambiguities_queued) == (1, 1, 1, 1)
    state = links.Resolution(store)
    made = state.created.rows().collect()
    assert [(r.canonical_name, r.entity_type, r.origin, r.origin_key) for r in made] == [("Quay Bank", "company", "override", "70")]
    assert [(r.entity_id, r.alias_normalized) for r in state.aliases.rows().collect()] == [(made[0].entity_id, "quay bank")]
    assert linked(store) == {("Kelp Foods", 1), ("Gull Tower", 2), ("Quay Bank", made[0].entity_id), ("Reef Bank", None), ("Osprey Partners", None), ("Plover Credit", None)}
    corpus = state.corpus(spark_corpus(base, store))
    seen = rm.owner_observations(corpus, "company").groupBy("owner_id").count().collect()
    assert {r.owner_id for r in seen} == {1, 2, made[0].entity_id}
    # the entity stands as target of its override from now on
    assert {(r.override_id, r.matched_entity_id) for r in state.all_overrides(base).collect()} == {(70, made[0].entity_id), (71, None)}


def spark_corpus(base, store):
    import dataclasses

    return dataclasses.replace(base, observations=ingest.stored_observations(store))


def test_a_second_run_writes_no_bucket(store, base):
    before = links.Resolution(store).links.snapshots()
    counters, wrote = ingest.resolve_stored(store, base, now(), 2)
    assert {n: m.written for n, m in wrote.items()} == {n: [] for n in wrote}
    assert links.Resolution(store).links.snapshots() == before
    assert counters.first().holdings_skipped_prelinked == 3
    assert {r.run for r in links.Resolution(store).links.rows().collect()} == {1}


def decision(spark, key, action, entity, at):
    return spark.createDataFrame([(key, action, entity, "me", "  why ", at)], "holding_key string, action string, chosen_entity_id bigint, resolved_by string, notes string, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))


def test_decisions_link_and_replace_overrides(spark, store, base):
    state = links.Resolution(store)
    item = state.queue.rows().where("status = 'open'").first()
    assert (item.group_kind, item.group_key, item.candidate_count, item.item_no) == ("NAME", "reef bank", 2, 1)
    corpus = spark_corpus(base, store)
    done, _ = state.decide(corpus, decision(spark, item.holding_key, "accept", 2, "2025-02-01"), 3)
    assert not done.first().is_valid and ("Reef Bank", None) in linked(store), "2 is no candidate"
    done, _ = state.decide(corpus, decision(spark, item.holding_key, "accept", 4, "2025-02-01"), 3)
    assert done.first().is_valid and ("Reef Bank", 4) in linked(store)
    own = state.overrides.rows().collect()
    assert [(r.name_key, r.fund_code, r.asset_class_scope, r.action, r.matched_entity_id, r.created_by) for r in own] == [("reef bank", "harbour", "Cash", "force_match", 4, "me")]
    assert own[0].reason.endswith("action accept. Notes: why")
    closed = state.queue.rows().first()
    assert (closed.status, closed.resolved_by, closed.notes, closed.item_no) == ("accepted", "me", "  why ", 1)
    _, again = state.decide(corpus, decision(spark, item.holding_key, "reject", None, "2025-03-01"), 4)
    assert all(not m.written for m in again.values()), "a closed item takes no decision"
    # the item opens again under its next number; the second decision replaces the first one's override
    state.queue.merge(links.next_queue(state.queue.rows(), spark.createDataFrame([item], links.schema_of(links.QUEUE)).select(*[c for c in links.schema_of(links.QUEUE).names if c not in ("item_no", "resolved_by", "notes", "decided_at")])))
    assert sorted((r.item_no, r.status) for r in state.queue.rows().collect()) == [(1, "accepted"), (2, "open")]
    state.decide(corpus, decision(spark, item.holding_key, "create_new", None, "2025-04-01"), 5)
    later = state.overrides.rows().collect()
    made = state.created.rows().where("origin = 'queue'").collect()
    assert [(r.override_id, r.action, r.matched_entity_id) for r in later] == [(own[0].override_id, "force_new_entity", made[0].entity_id)]
    assert ("Reef Bank", made[0].entity_id) in linked(store) and made[0].entity_type == "company"


def test_upsert_keeps_older_and_reports_conflicts(spark):
    stored = spark.createDataFrame(
        [(1, "a", "f", "c", None, "force_match", 9, None, "x", "r", "2025-02-01"), (2, "b", "f", None, None, "force_match", 9, None, "x", "r", None), (3, "b", "f", None, None, "force_no_match", None, None, "x", "r", None)],
        links.OVERRIDES.replace("decided_at timestamp", "decided_at string").replace("expires_at date", "expires_at string"),
    ).withColumn("decided_at", F.col("decided_at").cast("timestamp")).withColumn("expires_at", F.col("expires_at").cast("date"))
    decided = spark.createDataFrame(
        [("a", "f", "c", None, "force_no_match", None, "me", "n", "2025-01-01"), ("b", "f", None, None, "force_match", 5, "me", "n", "2025-03-01"), ("a", "f", None, None, "force_match", 5, "me", "n", "2025-03-01")],
        "name_key string, fund_code string, asset_class_scope string, entity_type_scope string, action string, matched_entity_id bigint, created_by string, reason string, decided_at string",
    ).withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    got = {(r.name_key, r.asset_class_scope, r.action, r.matched_entity_id, r.change) for r in links.upsert_overrides(stored, decided).collect()}
    assert got == {("a", "c", "force_match", 9, "kept"), ("b", None, "force_match", 9, "kept"), ("b", None, "force_no_match", None, "kept"), ("b", None, "force_match", 5, "conflict"), ("a", None, "force_match", 5, "inserted")}
