"""The nearest of ten thousand mapping versions, against comparing every file with every version."""

from __future__ import annotations

import random

import pytest

from holdwright.operators import governance

ALWAYS, OPTIONAL = ["asset_classes", "internal_external", "filters"], ["option_codes", "option_names"]
COMPARE = {"always": ALWAYS, "optional": OPTIONAL}
PROFILE = "source_file_id bigint, layout_key string, schema_fingerprint string, " + ", ".join(f"observed_{p} array<string>" for p in (*ALWAYS, *OPTIONAL))
VERSION = "mapping_version_id string, layout_key string, seed_position int, expected_fingerprint string, " + ", ".join(f"expected_{p} array<string>" for p in (*ALWAYS, *OPTIONAL))


def value(rng, wide):
    return rng.choice([None, [], ["a"], ["a", "b"], *([f"v{rng.randrange(40)}"] for _ in range(4))]) if wide else rng.choice([["a"], ["b"], None])


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(21)
    versions = [(f"m{k}", f"l{k % 3}", k // 3, rng.choice([None, f"print {rng.randrange(60)}"]), *(value(rng, True) for _ in ALWAYS), *(rng.choice([None, None, value(rng, True)]) for _ in OPTIONAL)) for k in range(10_000)]
    # several versions fit the same file
    versions += [(f"same{k}", "l0", 20_000 + k, None, ["a"], ["b"], None, None, None) for k in range(3)]
    shows = [(f"l{rng.randrange(4)}", f"print {rng.randrange(80)}", *(value(rng, True) for _ in (*ALWAYS, *OPTIONAL))) for _ in range(50)] + [("l0", "print x", ["a"], ["b"], None, ["c"], None)]
    shows += [(v[1], v[3] or "print y", *v[4:7], *(o if o is not None else ["z"] for o in v[7:])) for v in rng.sample(versions, 15)]
    return versions, [(k, *rng.choice(shows)) for k in range(400)] + [(1_000 + k, *s) for k, s in enumerate(shows)]


def drift(profile, version):
    out = ["schema_fingerprint"] if version[3] is not None and version[3] != profile[2] else []
    out += [p for p, seen, wanted in zip(ALWAYS, profile[3:6], version[4:7]) if seen != wanted]
    return out + [p for p, seen, wanted in zip(OPTIONAL, profile[6:], version[7:]) if wanted is not None and seen != wanted]


def test_candidates_among_ten_thousand_versions(spark, tables):
    versions, profiles = tables
    profile_table = spark.createDataFrame(profiles, PROFILE).repartition(4)
    version_table = spark.createDataFrame(versions, VERSION).repartition(4)
    found = governance.mapping_candidates(profile_table, version_table, **COMPARE)
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r.source_file_id, set()).add((r.mapping_version_id, tuple(r.drift), r.drift_score))
    by_show: dict[str, set] = {}
    want = {}
    for p in profiles:
        if (show := str(p[1:])) not in by_show:
            judged = [(len(drift(p, v)), v[2], v[0], tuple(drift(p, v))) for v in versions if v[1] == p[1]]
            clean = [j for j in judged if not j[0]]
            by_show[show] = {(j[2], j[3], 3 * j[0]) for j in (clean or ([min(judged)] if judged else []))}
        want[p[0]] = by_show[show]
    assert got == {k: v for k, v in want.items() if v}
    assert any(len(v) > 1 for v in want.values()) and any(s for v in want.values() for *_, s in v) and any(not v for v in want.values())


def test_files_that_show_the_same_are_one_class(spark, tables):
    _, profiles = tables
    classes = governance.profile_classes(spark.createDataFrame(profiles, PROFILE), **COMPARE)
    assert classes.select("profile_class").distinct().count() == len({str(p[1:]) for p in profiles}) < 70
    assert governance.mapping_candidates(spark.createDataFrame([], PROFILE), spark.createDataFrame([], VERSION), **COMPARE).count() == 0
