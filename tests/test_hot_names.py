"""Overrides and name matches where one name has thousands of rows, links, overrides or entities."""

from __future__ import annotations

import dataclasses
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from holdwright.plans import read_models as rm
from holdwright.plans import resolver
from holdwright.plans.corpus import Corpus

FUNDS, CLASSES, TYPES = ["f1", "f2", None], ["Cash", "Equity", None], ["manager", "company", None]
NOW = "2025-01-01"
THREE = ["entity_id", "manager_entity_id", "issuer_entity_id"]


@pytest.fixture(scope="module")
def overrides():
    rng = random.Random(6)
    rows = []
    for k in range(3_000):
        name = "hot" if k % 3 else f"name {k % 50}"
        target = rng.choice([None, 1, 2])
        rows.append((k, name, rng.choice(FUNDS), rng.choice(CLASSES), rng.choice(TYPES), rng.choice(["force_match", "force_no_match"]), target, rng.choice([None, None, "2024-01-01", "2026-01-01"])))
    return rows + [(9_000, "rare", "f1", "Cash", "manager", "force_match", 1, None), (9_001, "rare", None, None, None, "force_no_match", None, None)]


def corpus_of(spark, overrides):
    entities = spark.createDataFrame([(1, "company"), (2, "manager")], "entity_id bigint, entity_type string")
    table = spark.createDataFrame(overrides, "override_id bigint, name_key string, fund_code string, asset_class_scope string, entity_type_scope string, action string, matched_entity_id bigint, expires_at string")
    return Corpus(None, None, entities, None, None, table.withColumn("expires_at", F.col("expires_at").cast("date")), None, None)


def best_by_force(overrides, name, fund, cls, scope):
    fits = []
    for k, o_name, o_fund, o_cls, o_type, action, target, expires in overrides:
        if o_name != name or (expires and expires <= NOW) or (o_fund and o_fund != fund) or (o_cls and o_cls != cls) or (o_type and scope and o_type != scope):
            continue
        points = (o_fund is not None) + (o_cls is not None) + (o_type is not None and (o_type == scope or target is not None))
        fits.append((points, k, action, target, o_type))
    if not fits:
        return None
    top = [f for f in fits if f[0] == max(f[0] for f in fits)]
    first = min(top, key=lambda f: f[1])
    clash = any(f[3] is not None and f[4] is not None and {1: "company", 2: "manager"}[f[3]] != f[4] for f in top)
    return first[1], first[2], len(top), first[0], clash


def test_lattice_picks_the_most_specific(spark, overrides):
    corpus = corpus_of(spark, overrides)
    names = ["hot", "rare", "nobody", *(f"name {k}" for k in range(50))]
    scopes = [(n, f, c, s) for n in names for f in [*FUNDS, "f3"] for c in [*CLASSES, "Other"] for s in TYPES]
    df = spark.createDataFrame(scopes * 3, "name_key string, fund_code string, asset_class string, scope string").repartition(4)
    now = F.lit(NOW).cast("date")
    got = {(r.name_key, r.fund_code, r.asset_class, r.scope): (r.override_id, r.action, r.ties, r.specificity, bool(r.type_conflict)) for r in resolver.picked_overrides(df, corpus, now).collect()}
    want = {s: best_by_force(overrides, *s) for s in scopes}
    assert got == {s: w for s, w in want.items() if w}
    # one row a point, eight points a scope: the join cannot give more than eight rows for a scope
    lattice = resolver.override_lattice(corpus, now)
    assert lattice.count() == lattice.select("point").distinct().count() < 60 * 18 * 4
    assert resolver.lattice_points(df.distinct()).groupBy("name_key", "fund_code", "asset_class", "scope").count().agg(F.max("count")).first()[0] == 8


@pytest.fixture(scope="module")
def shared_name(spark):
    """A hot name of 40 entities whose rows have hundreds of different links, and links under other names."""
    rng = random.Random(12)
    entities = [(k, rng.choice(["company", "manager"]), "Hot" if k < 40 else f"Own {k}") for k in range(300)]
    aliases = [(k, "hot", "hot") for k in range(35, 60)] + [(k, f"also {k}", f"also {k}") for k in range(300)]
    rows = []
    for k in range(4_000):
        name = rng.choice(["Hot", " HOT ", "hot", "Hot", f"Own {rng.randrange(300)}", f"Also {rng.randrange(300)}", "Nobody"])
        link = lambda: rng.choice([None, rng.randrange(300)])
        rows.append((f"h{k}", name, rng.choice(["f1", "f2"]), rng.choice(["o1", "o2", "o3"]), link(), link(), link(), rng.choice(["2024-06-30", "2024-12-31"])))
    observations = spark.createDataFrame(rows, "holding_key string, raw_name string, fund_code string, option_code string, entity_id bigint, manager_entity_id bigint, issuer_entity_id bigint, reporting_period string")
    observations = observations.selectExpr("*", "true AS is_current", "'loaded' AS ingest_status", "false AS is_aggregate", "true AS has_name")
    corpus = Corpus(
        observations, None, spark.createDataFrame(entities, "entity_id bigint, entity_type string, canonical_name string"),
        spark.createDataFrame([(k, a, n, True) for k, a, n in aliases], "entity_id bigint, alias string, alias_normalized string, is_preferred boolean"), None, None, None, None,
    )
    names = {k: {n.lower()} | {a for e, a, _ in aliases if e == k} for k, _, n in entities}
    return corpus, rows, names, {k: t for k, t, _ in entities}


@pytest.mark.parametrize("links, kind", [(THREE, None), (["entity_id"], None), (THREE, "company")])
def test_slices_of_a_hot_name(shared_name, links, kind):
    corpus, rows, names, types = shared_name
    place = {"entity_id": 4, "manager_entity_id": 5, "issuer_entity_id": 6}
    every, alone = Counter(), Counter()
    for r in rows:
        linked, name = {r[place[c]] for c in links} - {None}, r[1].strip().lower()
        for e in names:
            if kind in (None, types[e]):
                every[e, r[2], r[7]] += e in linked or name in names[e]
                alone[e, r[2], r[7]] += e not in linked and name in names[e]
    got = rm.entity_slices(corpus, ["fund_code", "reporting_period"], links, kind).groupBy("entity_id", "fund_code", "reporting_period").agg(F.sum("rows").alias("n")).collect()
    assert {(r.entity_id, r.fund_code, r.reporting_period): r.n for r in got} == {k: v for k, v in every.items() if v}
    found = rm.name_only_slices(corpus.observations, corpus, ["fund_code", "reporting_period"], links, kind).collect()
    assert {(r.entity_id, r.fund_code, r.reporting_period): r.rows for r in found} == {k: v for k, v in alone.items() if v}


def test_what_meets_the_entities_does_not_grow_with_rows_or_links(shared_name):
    corpus, *_ = shared_name
    twice = dataclasses.replace(corpus, observations=corpus.observations.unionByName(corpus.observations.withColumn("entity_id", F.col("entity_id") + 7)))
    keyed = lambda c: c.observations.withColumn("name_key", F.lower(F.trim("raw_name")))
    sizes = [rm._named_counts(keyed(c), ["fund_code"]).where("name_key = 'hot'").count() for c in (corpus, twice)]
    assert sizes == [2, 2]
