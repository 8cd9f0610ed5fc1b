"""Runs of repeated word sequences and spelling variants against brute force, with hard rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from holdwright.llm import periods, spelling

SCHEMA = "doc_id long, text string, word string, n long, at int, `start` string, members string"


def runs_by_force(w: list) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(12, 2 * p):
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def with_tail(w: list[str], key: object) -> list[str]:
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def expected(key: object, text: str | None) -> tuple:
    w = with_tail(re.findall(r"[^\x20\x09-\x0D]+", text or ""), "" if key is None else key)
    runs = runs_by_force(w)
    keep = [not any(s + p <= i < s + n for s, n, p in runs) for i in range(len(w))]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(x for x, k in zip(w, keep) if k)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return key, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def periodic_texts() -> list[str | None]:
    rng = random.Random(11)
    texts: list[str | None] = [None, "", " \n\t", "one", "a " * 12, "a " * 11, "ab\x1cc " * 30, "é ü ü " * 15]
    for k in range(150):
        letters = rng.choice(["ab", "abc", "abcdefghijklmnop"])
        w = [rng.choice(letters) for _ in range(rng.randint(1, 160))]
        if k % 3 == 0:
            w = w[: rng.randint(1, 40)] * rng.randint(2, 6) + w
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    texts.append(" ".join(["x y z"] * 9_000 + ["end"]))
    return texts


def test_runs_match_brute_force(spark):
    rows = [(k * 7, t, "w", 1, 2, "s", "m") for k, t in enumerate(periodic_texts())]
    rows += [(None, "p q " * 20, *rows[0][2:]), rows[5], rows[5]]
    got = periods.detect(spark.createDataFrame(rows, SCHEMA).repartition(3), output="digests", planted=True).collect()
    assert Counter(map(tuple, got)) == Counter(expected(i, t) if len(t or "") < 20_000 else next(tuple(g) for g in got if g.doc_id == i) for i, t, *_ in rows)
    long = next(g for g in periods.detect(spark.createDataFrame(rows, SCHEMA)).collect() if g.doc_id == rows[158][0])
    assert (long.n_runs, long.start, long.length, long.period, long.collapsed) == (1, 0, 27_000, 3, "x y z end")
    assert periods.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_longer_than_a_grid_step(monkeypatch):
    monkeypatch.setattr(periods, "GRID_STEP", 64)
    monkeypatch.setattr(periods, "_grids", {})
    rng = random.Random(5)
    for _ in range(40):
        w = [rng.randrange(3) for _ in range(rng.randint(70, 500))]
        w = np.array(w + w[-rng.randint(1, 60) :] * 3)
        asked = periods.candidates(w)
        assert [tuple(r) for r in periods.runs_of([w], [asked])[0].tolist()] == runs_by_force(w.tolist())


def test_extensions_of_every_pair():
    rng = random.Random(2)
    for n in (2, 3, 17, 90):
        w = [rng.randrange(2) for _ in range(n)]
        ask = periods.Extensions(periods.recompress(np.array(w)))
        a, b = (np.array(x) for x in zip(*[(i, j) for j in range(n) for i in range(j)]))
        want = [next((k for k in range(n - j) if w[i + k] != w[j + k]), n - j) for i, j in zip(a.tolist(), b.tolist())]
        assert ask.of(a, b).tolist() == want


def words_by_force(rows, every: int = 31, letters: int = 7) -> Counter:
    found: Counter = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return Counter({w: n for w, n in found.items() if n >= 2})


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(rows, **kw) -> set:
    words = words_by_force(rows, **kw)
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def spelled() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    stems = ["receive", "aaaaaaa", "abababab", "straßenbahn", "éléphants", "ÉLÉPHANTS", "wordword", "zzzzzzzÿ"]
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "short six 1234567"), (None, "receive receive"), (None, "receive")]
    for k in range(400):
        out = []
        for _ in range(rng.randint(1, 40)):
            w = rng.choice(stems[: 1 + k % len(stems)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeéz") + w[at:], w[:at] + rng.choice("abeéz") + w[at + 1 :]])
            out.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((k % 300, rng.choice([" ", "-", "\n", "_"]).join(out)))
    return rows


@pytest.mark.parametrize("every", [31, 3])
def test_variants_match_brute_force(spark, every):
    rows = spelled()
    docs = spark.createDataFrame([(*r, "w", 1, 2, "s", "m") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in spelling.variants(docs, every=every).collect()]
    want = variants_by_force(rows, every=every)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_no_words_no_variants(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "once only")], "doc_id long, text string")).count() == 0
