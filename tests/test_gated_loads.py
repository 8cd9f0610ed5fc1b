"""Loads by manifest, and assets with coordinates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from holdwright.operators import assets, reconcile
from holdwright.plans import ingest
from holdwright.plans.assets import Assets
from holdwright.plans.corpus import Corpus
from holdwright.sources.files import read_files
from holdwright.sources.layouts import LAYOUTS
from holdwright.sources.store import Store
from tests import layout_files as lf

MANIFEST = "file_name string, layout_key string, fund_code string, registered_period date, source_url string, expected_rows bigint, expected_version string"
DECLARED = "fund_code string, expected_source_file_count bigint, expected_row_count bigint, row_count_tolerance bigint"
D, O = "30/06/2024", "Slow Harbour"


def flat(*values, option=O, bad=False):
    return lf.flat_11([[D, option, "Cash", "", "Quay Bank", "", "oops" if bad else v, "", "", "AUD", ""] for v in values])


@pytest.fixture(scope="module")
def mapping(spark, tmp_path_factory):
    """No mapping versions, in the shape of derived ones; `flat11` needs none."""
    root = tmp_path_factory.mktemp("shape")
    lf.put(root, "flat11", "harbour", lf.NONE, "shape.csv", flat("1"))
    typed = ingest.typed_rows_of(ingest.records_of(read_files(spark, str(root))))
    version, taxonomy = ingest.derived_mapping(spark, LAYOUTS["section14"], "v", ingest.file_profiles(typed), typed)
    return spark.createDataFrame([], version.schema), spark.createDataFrame([], taxonomy.schema)


def load(spark, store, root, mapping, batch, rows, declared):
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(str(root))
    manifest = spark.createDataFrame([(n, "flat11", f, None, None, e, None) for n, f, e in rows], MANIFEST)
    return ingest.load_listed(store, plain, manifest, spark.createDataFrame(declared, DECLARED), *mapping, batch)


def visible(store):
    return store.facts("holdings", ingest.schema_of(ingest.HOLDINGS)).count(), store.snapshot("source_files", ingest.schema_of(ingest.SOURCE_FILES)).count()


def test_a_batch_is_published_whole_or_not_at_all(spark, mapping, tmp_path):
    root, store = tmp_path / "landing", Store(spark, str(tmp_path / "store"))
    bodies = {
        "x/a.csv": flat("1", "2", "2"), "x/b.csv": flat("3", option="Low Harbour"), "x/c.csv": flat("4", "5"), "x/stray.csv": flat("9"), "x/broken.csv": flat("1", bad=True), "x/twice.csv": flat("1"), "y/twice.csv": flat("2"),
    }
    for name, body in bodies.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    listed = [("a.csv", "harbour", 3), ("b.csv", "harbour", 2), ("c.csv", "reef", 2)]
    totals = [("harbour", 2, 4, 0), ("reef", 1, 2, 0)]
    off = [("broken.csv", "tide", 0), ("twice.csv", "tide", 1), ("gone.csv", "tide", 1)]
    out = load(spark, store, root, mapping, 1, listed + off, [*totals, ("tide", 3, 2, 9)])
    assert {(r.file_name, r.status) for r in out["files"].collect()} == {
        ("a.csv", "ok"), ("b.csv", "row_count"), ("c.csv", "ok"), ("broken.csv", "rejected"), ("twice.csv", "landed_twice"), ("gone.csv", "missing")
    }
    assert {(r.fund_code, r.is_published) for r in out["gate"].collect()} == {("harbour", False), ("reef", True), ("tide", False)}
    assert visible(store) == (0, 0), "nothing of the batch is seen, the sound fund included"

    listed[1] = ("b.csv", "harbour", 1)
    out = load(spark, store, root, mapping, 2, listed, totals)
    assert {r.status for r in out["files"].collect()} == {"ok"} and visible(store) == (5, 3), "equal rows count for the gate and fall together after it"
    held = store.facts("holdings", ingest.schema_of(ingest.HOLDINGS)).select("path").distinct().collect()
    assert not any("stray" in r.path for r in held)

    # files already loaded count with what they gave; a total that is one off is within its tolerance
    out = load(spark, store, root, mapping, 3, listed, [("harbour", 2, 5, 1), ("reef", 1, 2, 0)])
    assert {(r.fund_code, r.rows_staged, r.is_published) for r in out["gate"].collect()} == {("harbour", 4, True), ("reef", 2, True)} and visible(store) == (5, 3)

    ingest.expire_parsed(store)
    assert store.batches("records") == [3] and store.batches("staged") == [3] and store.batches("holdings") == [2, 3] and visible(store) == (5, 3)


def test_gate_of_batches(spark):
    manifest = spark.createDataFrame([("f", "a", 1, "v"), ("f", "a", 1, "v"), ("g", "b", 2, "v"), ("g", "c", None, "v"), ("h", "d", 1, "v")], "fund_code string, file string, expected_rows bigint, expected_version string")
    landed = spark.createDataFrame(
        [("f", "a", "loaded", 1, "v"), ("g", "b", "loaded", 2, "w"), ("g", "c", "loaded", 1, "v"), ("g", "x", "loaded", 1, "v"), ("h", "d", "loaded", 1, "v")],
        "fund_code string, file string, ingest_status string, observed_rows bigint, observed_version string",
    )
    files = reconcile.gated_files(manifest, landed, ["fund_code", "file"])
    assert {r.file: r.status for r in files.collect()} == {"a": "listed_twice", "b": "mapping_version", "c": "row_count", "x": "unlisted", "d": "ok"}
    declared = spark.createDataFrame([("f", 1, 1, 0), ("h", 1, 2, 1), ("none", 0, 0, 0), ("gone", 1, 1, 5)], DECLARED)
    got = {r.fund_code: r.is_published for r in reconcile.gated_batches(files, declared, ["fund_code"]).collect()}
    assert not reconcile.gated_batches(files, spark.createDataFrame([("h", 1, 3, 1)], DECLARED), ["fund_code"]).where("fund_code = 'h'").first().is_published
    assert got == {"f": False, "g": False, "h": True, "none": True, "gone": False}, "a fund that declares nothing and lists nothing is in order"


# --- assets ----------------------------------------------------------------------

ROWS = "holding_key string, raw_name string, asset_class_code string, address_raw string, location_raw string, geo_lat decimal(12,8), geo_lng decimal(12,8)"
ENTITY = "entity_id bigint, entity_type string, canonical_name string, abn string, confidence_tier string"
PROPERTY, PLANT = "unlisted_property", "unlisted_infrastructure"


def corpus_of(spark, rows, entities):
    from decimal import Decimal

    rows = [(*r[:5], *[None if c is None else Decimal(c) for c in r[5:]]) for r in rows]
    seen = spark.createDataFrame(rows, ROWS)
    for c in ("fund_code", "fund_name", "option_code", "option_name", "source_asset_class_raw", "source_subclass_raw", "disclosure_completeness", "value_band_raw", "classification_raw"):
        seen = seen.withColumn(c, F.lit(None).cast("string"))
    seen = seen.withColumns({"is_current": F.lit(True), "ingest_status": F.lit("loaded"), "is_aggregate": F.lit(False), "has_name": F.lit(True), "ownership_pct": F.lit(None).cast("decimal(18,9)")})
    seen = seen.withColumns({"reporting_period": F.lit("2025-12-31").cast("date"), "source_file_id": F.lit(1), "source_row_number": F.lit(1), "entity_id": F.lit(None).cast("bigint")})
    return Corpus(seen, None, spark.createDataFrame(entities, ENTITY), None, None, None, None, None)


FIRST = [
    ("h1", "Quay Tower", PROPERTY, "1 Quay St", None, "-33.5", "151"),
    ("h2", " QUAY  tower", PROPERTY, "1  quay st", "Reef", "-33.5", "151"),
    ("h3", "Quay Tower", PROPERTY, None, "Far Town", "10", "20"),
    ("h4", "Half", PROPERTY, "x", None, "1", None),
    ("h5", "None", PROPERTY, "x", None, None, None),
    ("h6", "Out", PROPERTY, "x", None, "91", "0"),
    ("h7", "Clash", PLANT, "y", None, "1", "1"),
    ("h8", "Clash", PLANT, "y", None, "1", "2"),
    ("h9", "Known Plant", PLANT, None, None, "0", "0"),
    ("h10", "Wrong Type", PROPERTY, "z", None, "5", "5"),
    ("h11", "Many", PLANT, "z", None, "5", "5"),
    ("h12", "Both", PLANT, "z", None, "5", "5"),
    ("h13", "Both", PROPERTY, "z", None, "5", "5"),
    ("h14", "  ", PROPERTY, "z", None, "5", "5"),
    ("h15", "Split", PLANT, "p", None, "5", "5"),
    ("h16", "Split", PLANT, "q", None, "6", "6"),
    ("h17", "Shares", "listed_equity", "q", None, "6", "6"),
    ("h18", "Edge", PROPERTY, "e", None, "-90", "180"),
]
KNOWN = [(1, "infrastructure_asset", "Known Plant", None, None), (2, "company", "Wrong Type", None, None), (3, "infrastructure_asset", "Many", None, None), (4, "infrastructure_asset", "many ", None, None),
         (5, "infrastructure_asset", "Split", None, None)]


def test_assets_are_made_once_and_kept(spark, tmp_path):
    corpus, state = corpus_of(spark, FIRST, KNOWN), Assets(Store(spark, str(tmp_path)), buckets=4)
    done, wrote = state.run(corpus, 1)
    got = {r.holding_key: r.outcome for r in done.collect()}
    linked = {f"h{n}": "linked" for n in (1, 2, 3, 9, 18)}
    assert got == linked | {
        "h4": "half_a_pair", "h5": "no_coordinates", "h6": "out_of_range", "h7": "conflicting_coordinates", "h8": "conflicting_coordinates", "h10": "other_type", "h11": "several_entities",
        "h12": "conflicting_types", "h13": "conflicting_types", "h14": "no_name", "h15": "several_places", "h16": "several_places",
    }
    made = {(r.canonical_name, r.place_key): (r.entity_id, r.origin) for r in state.assets.rows().collect()}
    assert made[("Known Plant", "0.00000000,0.00000000")] == (1, "adopted") and len(made) == 4
    assert len({e for e, _ in made.values()}) == 4, "one name at two places is two assets"
    corpus = corpus_of(spark, FIRST, KNOWN)
    later = Corpus(corpus.observations, None, state.entities(corpus.entities), None, None, None, None, None)
    again, wrote = state.run(later, 2)
    assert wrote["assets"].written == [] and wrote["links"].written == []
    assert {r.holding_key: r.outcome for r in again.collect()} == got | {k: "present" for k in linked}


def test_later_rows_do_not_move_an_asset(spark, tmp_path):
    state = Assets(Store(spark, str(tmp_path)), buckets=4)
    state.run(corpus_of(spark, FIRST[:1], []), 1)
    rows = [("h1", "Quay Tower", PROPERTY, "elsewhere", None, "3", "3"), ("h20", "Quay Tower", PROPERTY, "1 quay st", None, "-33.5", "152"), ("h21", "Quay Tower", PROPERTY, "1 quay st", None, "-33.5", "151")]
    corpus = corpus_of(spark, rows, [])
    done, _ = state.run(Corpus(corpus.observations, None, state.entities(corpus.entities), None, None, None, None, None), 2)
    assert {r.holding_key: r.outcome for r in done.collect()} == {"h1": "other_asset", "h20": "other_coordinates", "h21": "linked"}
    shown = {r.holding_key: (r.asset_name, float(r.geo_lat), float(r.geo_lng)) for r in state.matched(corpus).collect()}
    assert shown["h21"] == ("Quay Tower", -33.5, 151.0)


def test_no_rows_no_assets(spark, tmp_path):
    state = Assets(Store(spark, str(tmp_path)), buckets=4)
    done, wrote = state.run(corpus_of(spark, FIRST[16:17], []), 1)
    assert done.count() == 0 and wrote["assets"].written == [] and state.matched(corpus_of(spark, FIRST, [])).count() == 0


def test_a_hot_asset_is_one_row_a_task(spark):
    """A name with most rows reduces before the shuffle."""
    rows = spark.range(40_000).select(F.concat(F.lit("h"), "id").alias("holding_key"), F.when(F.col("id") % 3 > 0, "Hot").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("raw_name"),
                                      F.lit(PLANT).alias("asset_class_code"), F.lit("a").alias("address_raw"), F.lit(None).cast("string").alias("location_raw"), F.lit(1).cast("decimal(12,8)").alias("geo_lat"), F.lit(2).cast("decimal(12,8)").alias("geo_lng"))
    keys = assets.new_assets(assets.asset_rows(rows), spark.createDataFrame([], "name_key string, place_key string, entity_id bigint, origin string"), spark.createDataFrame([], ENTITY))
    assert {r.name_key: r.row_count for r in keys.where("row_count > 1").collect()} == {"hot": 26_666} and keys.count() == 13_335
