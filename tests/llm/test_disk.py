"""What operators leave on the disks while they go on, and the two ways to ask a union of shingles."""

from __future__ import annotations

import os
import random

import pytest

from holdwright.llm import jaccard, lines
from holdwright.session import checkpoint_dir


def written(spark) -> set[str]:
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {f"{folder}/{name}" for name in os.listdir(folder) if name.startswith("table-")}


def columns(spark, places: set[str]) -> set[str]:
    return {c for place in places for c in spark.read.parquet(f"file://{place}").columns}


@pytest.mark.parametrize("most", [0, 4_000])
def test_unions_asked_as_rows_or_by_shingle(spark, monkeypatch, most):
    """A chain of near copies whose ends are far apart is one component either way, and no table of sets or shingles stays."""
    monkeypatch.setattr(jaccard, "ORDERS", 1)
    monkeypatch.setattr(jaccard, "MOST_NUMBERS", most)
    rng = random.Random(3)
    rows, now = [], [f"w{rng.randrange(10**6)}" for _ in range(100)]
    for k in range(24):
        now[(k * 7) % 100] = f"new{k}"
        rows.append((k, " ".join(now)))
    rows += [(100 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for k in range(3)]
    before = written(spark)
    got = {r.doc_id: r.component_id for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 100 else i for i, _ in rows}
    assert not {"tokens", "token"} & columns(spark, written(spark) - before)


def test_lines_leave_no_places(spark):
    """Texts and places of lines go when the groups are known; a repeated and a near line go, whatever part they meet in."""
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))
    texts = [line(n) for n in (6, 12, 24, 40, 80, 160)]
    rows = [(1, "\n".join(texts)), (2, "\n".join(t[:-1] + "x" for t in texts)), (3, texts[3] + "\n" + line(30))]
    before = written(spark)
    got = {r.doc_id: r.removed for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 1, 2, 3, 4, 5], 3: [0]}
    assert not {"norm", "bucket"} & columns(spark, written(spark) - before)


def test_letters_lose_no_pair_and_spare_most_texts(spark, monkeypatch):
    """Pairs that edits or other scripts keep similar pass the letters, pairs of other words do not; parts give what the whole gives."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäß0ж"
    texts, wanted = [], set()
    for size in (1, 9, 30, 80, 300, 2_000):
        for _ in range(4):
            a = [rng.choice(letters) for _ in range(size)]
            b = list(a)
            for _ in range(int(size * 0.1)):
                b[rng.randrange(len(b))] = rng.choice(letters)
            wanted.add((2 * len(wanted), 2 * len(wanted) + 1))
            texts += ["".join(a), "".join(b)]
    norms = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "cls long, norm string, size int").cache()
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))], "cls long, other long")
    left = lines.with_near_letters(pairs, lines.class_letters(norms), 0.9).cache()
    got = {(r.cls, r.other) for r in left.collect()}
    assert wanted <= got and len(got) < 4 * len(wanted)
    moved = []
    whole = lines.verified
    monkeypatch.setattr(lines, "verified", lambda some, *rest: moved.append(some.count()) or whole(some, *rest))
    found = {(r.cls, r.other) for r in lines.verified_in_parts(left, norms, 0.9, 1_000).collect()}
    assert found == {(r.cls, r.other) for r in whole(left, norms, 0.9).collect()} and wanted <= found
    assert len(moved) > 5 and sum(moved) == len(got)


def test_a_bucket_exchange_serves_both_its_readers(spark):
    """Places are made and dealt once: the count of a bucket reads the exchange that the join back reads."""
    classes = spark.createDataFrame([(k, k % 5, f"{'ab' * 40}{k % 5}") for k in range(40)], "cls long, value long, norm string")
    texts = classes.selectExpr("cls", "norm", "length(norm) as size")
    plans = []
    stored = lines.stored
    lines.stored = lambda df, *rest: plans.append(df) or stored(df, *rest)
    try:
        parts = list(lines.busy_buckets(classes.select("cls", "value"), texts, 3, 0.9))
    finally:
        lines.stored = stored
    assert parts[0].count() > 0
    for df in plans[:1]:
        df.collect()
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
