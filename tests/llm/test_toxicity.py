"""The string kernel against plain sums, and the classifier on held-out labelled texts."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from holdwright.llm import toxicity

INSULTS = ["gormless", "blatherskite", "muppet", "numpty"]


def plain_kernel(u: str, t: str) -> float:
    """Sum over all letter triples of both within the span, each weighed by the stretches they take."""

    def triples(x):
        return [(tuple(x[i] for i in at), at[2] - at[0] + 1) for at in itertools.combinations(range(len(x)), 3) if at[2] - at[0] < toxicity.SPAN]

    return sum(toxicity.DECAY ** (a + b) for x, a in triples(u) for y, b in triples(t) if x == y)


def test_kernel_is_the_sum_over_triples():
    rng = random.Random(4)
    marks = ["muppet", "aaaa", "numptynu", "xyzé"]
    units = ["", "m", "mup", "mxuppet", "aaaaaaa", "numptynumpty", "xyzé", "ézyx", *("".join(rng.choice("mupetaxyné") for _ in range(rng.randint(1, 24))) for _ in range(200))]
    got = toxicity.Kernel(marks).of(units)
    own = [plain_kernel(m, m) for m in marks]
    want = [[min(1.5, plain_kernel(u, m) / o) ** toxicity.POWER for m, o in zip(marks, own)] for u in units]
    assert np.allclose(got, want, atol=1e-4)
    long = "q" * 300 + "muppet" + "q" * 300
    assert toxicity.Kernel(marks).of([long, "numpty"])[0, 0] == pytest.approx(1.0, abs=1e-5)


def sentence(rng: random.Random, insult: str | None) -> str:
    w = ["".join(rng.choice(["ba", "lo", "ri", "ten", "mo", "pu", "get", "less"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 12))]
    if insult:
        w.insert(rng.randrange(len(w) + 1), insult)
    return " ".join(w)


def texts(n: int, seed: int) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        bad = rng.random() < 0.25
        body = [sentence(rng, rng.choice(INSULTS) if bad and rng.random() < 0.5 else None) for _ in range(rng.randint(4, 10))]
        if bad:
            body.append(sentence(rng, rng.choice(INSULTS)))
        out.append((k, ". ".join(body) + ".", int(bad)))
    return out


@pytest.fixture(scope="module")
def rows():
    return texts(900, 1)


def test_scores_on_the_held_out_fold(spark, rows):
    hard = [(-1, None), (-2, ""), (-3, " \n "), (-4, "1234 ### !!"), (None, rows[0][1]), (0, rows[0][1]), (-5, "ten ba. " * 30_000)]
    docs = spark.createDataFrame([(i, t, "k", 1.0, 0) for i, t, _ in rows] + [(*h, "k", 1.0, 0) for h in hard], "doc_id long, text string, key string, score double, label int").repartition(4)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(-1, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(hard)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    assert {r.held_out for r in got if r.doc_id in (-1, None)} == {zlib.crc32(b"-1") % 4 == 2, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    right = sum(a == b for a, b in held) / len(held)
    assert len(held) > 150 and right > 0.97
    same = {r.score for r in got if r.doc_id in (0, None)}
    assert len(same) == 1 and len({r.score for r in got if r.doc_id in (-1, -2, -3, -4)}) == 1
    assert all(not r.predicted for r in got if r.doc_id is not None and r.doc_id < 0)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_gaps_and_inserted_letters(rows):
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), (675, 225))
    rng = random.Random(9)
    clean = [". ".join(sentence(rng, None) for _ in range(4)) for _ in range(40)]
    assert (model.score(clean) < 0.3).mean() > 0.95
    for word in ("muppet", "MUPPET!", "m u p p e t", "m.u.p.p.e.t", "mup*pet", "muppeet", "nummpty", "gormmless", "g-o-r-m-l-e-s-s", "blather_skite", "blatherrskite"):
        told = model.score([t + ". " + sentence(rng, word) for t in clean])
        assert (told >= 0.3).mean() > 0.9, (word, np.median(told))


def test_one_label_gives_its_share(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, labels).collect()} == {1 / 4 if zlib.crc32(b"1") % 4 != 2 and zlib.crc32(b"3") % 4 != 2 else 1 / 3}


def test_a_text_longer_than_a_step(monkeypatch, rows):
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), (675, 225))
    some = [t for _, t, _ in rows[:30]] + [" ".join(t for _, t, _ in rows[:40])]
    whole = model.score(some)
    monkeypatch.setattr(toxicity, "TOKENS_AT_ONCE", 20)
    monkeypatch.setattr(toxicity, "UNIT_STORE", 50)
    assert np.allclose(model.score(some), whole)
