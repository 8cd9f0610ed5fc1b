"""Batches through governance, versions and the store."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from holdwright.operators import governance
from holdwright.plans import ingest
from holdwright.plans.corpus import Corpus
from holdwright.plans.read_models import asset_mix, cross_layout_by_name
from holdwright.sources.files import read_files
from holdwright.sources.layouts import LAYOUTS
from holdwright.sources.store import Store
from holdwright.streaming.arrivals import ingest_stream
from tests import layout_files as lf


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    lf.landing(root)
    return root


@pytest.fixture(scope="module")
def approved(spark, landing):
    """Mapping versions that approve what the fixture files show."""
    records = ingest.records_of(read_files(spark, str(landing))).persist()
    typed = ingest.typed_rows_of(records).persist()
    profiles = ingest.file_profiles(typed).persist()
    versions = taxonomy = None
    for key, layout in LAYOUTS.items():
        if not layout.needs_mapping:
            continue
        v, t = ingest.derived_mapping(spark, layout, f"v-{key}", profiles.where(F.col("layout_key") == key), typed.where(F.col("layout_key") == key))
        versions = v if versions is None else versions.unionByName(v)
        taxonomy = t if taxonomy is None else taxonomy.unionByName(t)
    return spark.createDataFrame(versions.collect(), versions.schema), spark.createDataFrame(taxonomy.collect(), taxonomy.schema)


@pytest.fixture(scope="module")
def loaded(spark, landing, approved, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest.load_batch(store, read_files(spark, str(landing)), *approved, batch=1)
    return store


def files_of(store):
    return store.snapshot("source_files", ingest.schema_of(ingest.SOURCE_FILES))


def holdings_of(store):
    return store.facts("holdings", ingest.schema_of(ingest.HOLDINGS))


def test_every_layout_loads(loaded):
    got = {r.layout_key: (r.ingest_status, r.version_number, r.is_current) for r in files_of(loaded).collect()}
    detail = loaded.facts("review_queue", ingest.schema_of(ingest.REVIEW)).select("layout_key", "review_reason", "detail").collect()
    assert got == {k: ("loaded", 1, True) for k in LAYOUTS}, detail
    rows = Counter(r.layout_key for r in holdings_of(loaded).collect())
    # identical rows collapse when the hash covers cells only
    assert rows == {"flat11": 7, "flat16_banded": 5, "flat16_totals": 4, "shared24": 6, "shared24_variant": 5, "schedule14": 9, "section14": 6, "blocks5_multi": 12, "blocks5_single": 5}


def test_dimensions(loaded):
    periods = loaded.facts("periods", ingest.schema_of(ingest.PERIODS)).collect()
    got = sorted((str(p.reporting_period), str(p.disclosure_due), p.label) for p in periods)
    assert got == [("2024-06-30", "2024-09-28", "2024-06-30"), ("2025-12-31", "2026-03-31", "2025-12-31")]
    assert loaded.facts("options", ingest.schema_of(ingest.OPTIONS)).count() == 10
    assert loaded.facts("asset_classes", ingest.schema_of(ingest.CLASSES)).count() == 12


def test_review_events(loaded):
    events = Counter(r.review_reason for r in loaded.facts("review_queue", ingest.schema_of(ingest.REVIEW)).collect())
    # both duplicate-view reasons, and no identity event: option names confirm the declared funds
    assert events == {"ambiguous_duplicate_group": 2}


def test_second_load_adds_nothing(spark, loaded, landing, approved):
    ingest.load_batch(loaded, read_files(spark, str(landing)), *approved, batch=2)
    assert holdings_of(loaded).count() == 59
    assert files_of(loaded).count() == 9


def test_same_batch_again_changes_nothing(spark, loaded, landing, approved):
    ingest.load_batch(loaded, read_files(spark, str(landing)), *approved, batch=2)
    assert holdings_of(loaded).count() == 59 and loaded.batches("holdings") == [1, 2]


def test_restatement_bad_file_and_drift(spark, loaded, landing, approved, tmp_path):
    d, o = "30/06/2024", "Slow Harbour"
    lf.put(tmp_path, "flat11", "harbour", lf.NONE, "restated.csv", lf.flat_11([[d, o, "Cash", "", "Quay Bank", "", "9", "", "", "AUD", ""]]))
    lf.put(tmp_path, "flat11", "harbour", lf.NONE, "broken.csv", lf.flat_11([[d, "Low Harbour", "Cash", "", "Quay Bank", "", "oops", "", "", "AUD", ""]]))
    lf.put(tmp_path, "blocks5_single", "high", "2025-12-31", "scope.csv", lf.blocks_single("Held directly by friends"))
    lf.put(tmp_path, "section14", "reef", "2025-06-30", "late.csv", lf.section_14().replace("QUAY BANK", "QUAY CO"))
    lf.put(tmp_path, "schedule14", "tide", "2025-12-31", "IFB-Drift.csv", lf.schedule_14().replace("LISTED ALTERNATIVES", "UNLISTED ALTERNATIVES"))
    ingest.load_batch(loaded, read_files(spark, str(tmp_path)), *approved, batch=3)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files_of(loaded).collect()}
    assert rows["restated.csv"].version_number == 2 and rows["restated.csv"].is_current
    assert not rows["flat.csv"].is_current and rows["restated.csv"].supersedes_file_id == rows["flat.csv"].source_file_id
    assert rows["broken.csv"].ingest_status == "review_required"
    review = {(r.path.rsplit("/", 1)[1], r.review_reason): r for r in loaded.facts("review_queue", ingest.schema_of(ingest.REVIEW)).collect()}
    assert review[("broken.csv", "adapter_parse_failure")].detail.startswith("invalid_number")
    assert len(review[("broken.csv", "adapter_parse_failure")].sample_rows) == 2
    assert review[("scope.csv", "unapproved_scope_modifier")].detail == "Held directly by friends"
    assert review[("late.csv", "adapter_parse_failure")].detail.startswith("period_mismatch")
    assert review[("IFB-Drift.csv", "schema_drift")].detail == "schema_fingerprint,asset_classes"
    details: dict = {}
    named = {v.source_file_id: k[0] for k, v in review.items()}
    for r in loaded.facts("review_details", ingest.schema_of(governance.DETAIL)).collect():
        details.setdefault(named[r.source_file_id], []).append((r.review_reason, r.property, r.expected, r.actual, r.source_row_number))
    drift = sorted(details["IFB-Drift.csv"], key=str)
    assert [(d[0], d[1]) for d in drift] == [("schema_drift", "asset_classes"), ("schema_drift", "schema_fingerprint")]
    assert "LISTED ALTERNATIVES" in drift[0][2].split("|") and "UNLISTED ALTERNATIVES" in drift[0][3].split("|") and drift[1][2] != drift[1][3]
    assert details["broken.csv"][0][:2] == ("adapter_parse_failure", "invalid_number") and details["broken.csv"][0][4] == 2
    assert details["late.csv"][0][:2] == ("adapter_parse_failure", "period_mismatch") and details["late.csv"][0][4] is None
    held = Counter(r.path.rsplit("/", 1)[1] for r in holdings_of(loaded).select("path").collect())
    assert "broken.csv" not in held and "late.csv" not in held and held["restated.csv"] == 1 and held["scope.csv"] == 5


def test_read_models_over_stored_tables(spark, loaded):
    observations = ingest.stored_observations(loaded)
    empty = spark.createDataFrame([], "entity_id bigint, entity_type string, canonical_name string, abn string, confidence_tier string")
    files = files_of(loaded)
    corpus = Corpus(observations, files, empty, None, None, None, None, None)
    seen = cross_layout_by_name(corpus, " gull   TOWER ").select("layout_key").distinct().count()
    assert seen == 6
    mix = asset_mix(corpus)
    assert mix.agg(F.sum("observation_count")).first()[0] == observations.where("is_current AND has_name AND NOT is_aggregate").count()


def test_one_path_with_changing_content(spark, approved, tmp_path):
    """New content under an old name supersedes it; old content that comes back is current again, once."""
    store = Store(spark, str(tmp_path / "store"))
    d, o = "30/06/2024", "Slow Harbour"
    bodies = [lf.flat_11([[d, o, "Cash", "", "Quay Bank", "", value, "", "", "AUD", ""] for value in values]) for values in (["5", "6", "5"], ["7"], ["5", "6", "5"])]
    for batch, body in enumerate(bodies, 1):
        path = lf.put(tmp_path / "landing", "flat11", "harbour", lf.NONE, "same.csv", body)
        os.utime(path, (1_700_000_000 + batch * 60,) * 2)
        ingest.load_batch(store, read_files(spark, str(tmp_path / "landing")), *approved, batch=batch)
        ingest.load_batch(store, read_files(spark, str(tmp_path / "landing")), *approved, batch=batch)
    files = sorted(files_of(store).collect(), key=lambda r: r.version_number)
    assert [(r.version_number, r.is_current) for r in files] == [(1, False), (2, False), (3, True)]
    assert len({r.source_file_id for r in files}) == 3 and files[2].supersedes_file_id == files[1].source_file_id
    rows = ingest.stored_observations(store).where("is_current").select("value_aud", "source_row_number").collect()
    assert sorted((int(r.value_aud), r.source_row_number) for r in rows) == [(5, 2), (6, 3)]
    assert holdings_of(store).count() == 5


def test_stream_loads_the_same(spark, landing, approved, loaded, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    query = ingest_stream(store, str(landing), *approved, progress=str(tmp_path / "progress"), files_per_batch=5)
    query.awaitTermination(600)
    assert query.exception() is None
    assert holdings_of(store).count() == 59
    assert files_of(store).count() == 9 and len(store.batches("holdings")) == 2
