"""Operators on documents against brute-force versions, with hard rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdwright.llm import bpe, contamination, fingerprints, jaccard, lines, quality, substrings, surrogates

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id long, value string, part string, `group` string"


def phrase(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, empty, null and one-word texts, odd spaces, a long text."""
    rng = random.Random(7)
    base = [phrase(rng, rng.randint(30, 120)) for _ in range(12)]
    passage = phrase(rng, 40)
    texts: list[str | None] = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2] + " tail", "start " + base[2]]
    for k in range(6):
        w = base[3].split()
        w[k * 3 % len(w)] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [phrase(rng, 10) + " " + passage + "\n" + phrase(rng, 20) for _ in range(5)]
    texts += [None, "", "   \n\t", "one", "one", "two words", " ", "a\x1cb c", phrase(rng, 3000), base[4][: len(base[4]) // 2] + "\n" + base[5]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * order[k] + 1, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i % 3, "x", "y", "z") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}


def closure(pairs, nodes) -> dict:
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_jaccard_components(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    sets = {i: shingles(t) for i, t in corpus()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = closure(links, sets)
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    assert jaccard.link_components(empty).count() == 0
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i in sets if least[i] == i}


def test_documents_without_a_key_stay(spark):
    """A null doc_id is in no group, so its rows go through this stage and the ones behind it."""
    rng = random.Random(5)
    a, b = phrase(rng, 40), phrase(rng, 50)
    rows = [(1, a), (2, a), (3, b), (None, a), (None, None), (None, a)]
    left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert Counter(map(tuple, left.collect())) == Counter([(1, a), (3, b), (None, a), (None, a), (None, None)])
    clean = contamination.decontaminate(left, spark.createDataFrame([(1, phrase(rng, 30))], "item_id long, text string"))
    assert clean.count() == 5
    assert bpe.encode(clean, public_tokenizers.path("word_bpe_49k.json")).count() == 5


def test_groups_that_no_star_joins(spark):
    """A chain of near copies whose ends are far apart, and documents made of other documents' passages."""
    rng = random.Random(3)
    w = phrase(rng, 100).split()
    rows, now = [], list(w)
    for k in range(30):
        now[(k * 7) % 100] = f"new{k}"
        rows.append((k, " ".join(now)))
    parts = [phrase(rng, 30) for _ in range(6)]
    rows += [(100 + a * 10 + b, parts[a] + " " + parts[b]) for a in range(6) for b in range(6) if a != b]
    got = {r.doc_id: r.component_id for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == closure(links, sets)


def test_open_groups_find_missed_links(spark, monkeypatch):
    """Without any star the matrix alone finds every link."""
    monkeypatch.setattr(jaccard, "ORDERS", 1)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == closure(links, sets)


def test_prefix_rule_is_a_lower_bound():
    share, least = jaccard.prefix_rule(75)
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(10_000), n))
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 4))):
            b.symmetric_difference_update({rng.choice(sorted(b)) if b and rng.random() < 0.5 else rng.randint(0, 10_000)})
        if b and 100 * len(a & b) >= 75 * len(a | b):
            cut = lambda s: set(sorted(s)[: int(np.ceil(len(s) * share))])
            common = len(cut(a) & cut(b))
            assert all(common >= max(1, int(len(s) * least + 1e-6)) for s in (a, b))


def test_substring_dedup(docs, empty):
    rows = corpus()
    first: dict[tuple, int] = {}
    for i, t in sorted(rows):
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substrings.dedup(docs).collect()}
    texts = {r.doc_id: r for r in substrings.dedup(docs, output="texts").collect()}
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert texts[i].kept == kept and sum(s.end - s.first for s in texts[i].spans) == len(gone)
    assert sum(r.n_removed > 0 for r in got.values()) > 8
    assert substrings.dedup(empty).count() == 0


def test_fingerprints(docs, empty):
    rows = sorted(corpus(), key=lambda r: -r[0])
    marked = fingerprints.edited_fingerprints(docs)
    got = {r.doc_id: r for r in fingerprints.near_counts(marked, F.col("doc_id") % 2 == 0).collect()}
    value = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for k, (i, t) in enumerate(rows):
        own, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        near = 1 - bin(value[i] ^ int(r.edited_fingerprint, 16)).count("1") / 64
        assert r.near_edited == near and r.near_next == 1 - bin(value[i] ^ value[rows[(k + 1) % len(rows)][0]]).count("1") / 64
        if i % 2 == 0:
            assert r.n_near == sum(bin(value[i] ^ v).count("1") <= 3 for v in value.values()) - 1
        else:
            assert r.n_near is None
    same = defaultdict(set)
    for i, t in rows:
        same[t or ""].add(value[i])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.near_counts(fingerprints.edited_fingerprints(empty), F.col("doc_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("radius,blocks", [(2, 3), (3, 4), (3, 6), (1, 5)])
def test_block_tables_meet_every_pair(radius, blocks):
    masks = [m & (2**64 - 1) for m in fingerprints.block_masks(radius, blocks)]
    rng = random.Random(radius)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_bpe_equals_the_library(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode(docs, path, output="ids").collect()}
    digests = {r.doc_id: r for r in bpe.encode(docs, path).collect()}
    for i, t in corpus():
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].decoded == library.decode(want, skip_special_tokens=False)
        assert (digests[i].n_tokens, digests[i].ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
    assert bpe.encode(empty, path).count() == 0


def test_bpe_on_odd_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Vocabulary(path)
    rng = random.Random(5)
    letters = "abcthein'<|>endoftextσΣéèß1٢ \t\n.,!-_日本́İ\x1c\x85🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a<|endoftext|>b <|startoftext|>", "x" * 500, "ﬁ ſ K Å"]
    for text, ids in zip(texts, own.encode_texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_contamination(spark, docs, empty):
    rng = random.Random(11)
    items = [(k, phrase(rng, 12) + "\n" + phrase(rng, 25)) for k in range(30)] + [(90, None), (91, ""), (92, phrase(rng, 80))]
    rows = corpus()[:20] + [(1000 + k, phrase(rng, 50 * k) + " " + "".join(c.upper() if c.isascii() else c for c in items[k][1].replace("\n", " ")) + " " + phrase(rng, 60)) for k in range(10)]
    rows += [(2000, items[3][1].split("\n")[0]), (2001, " ".join(items[32][1].split()[:60])), (2002, items[4][1] + " " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in contamination.matches(source, bench).collect()}
    want = set()
    for d, t in rows:
        for k, x in items:
            parts = [shingles(p) for p in (x or "").strip().split("\n", 1)]
            total = sum(map(len, parts))
            own = shingles(t)
            if total and sum(len(p & own) for p in parts) / total >= 0.6 and all(p & own for p in parts if len(p) > 1):
                want.add((d, k))
    assert got == want and {(1000 + k, k) for k in range(10)} <= got and (2000, 3) not in got
    clean = {r.doc_id for r in contamination.decontaminate(source, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}
    assert contamination.matches(empty, bench).count() == 0
    assert contamination.matches(source, bench.where("item_id < 0")).count() == 0
    assert contamination.decontaminate(docs, bench).columns == docs.columns


def test_block_bounds_lose_nothing(monkeypatch):
    """Retrieval equals scoring every passage against every segment."""
    import pyarrow as pa

    from holdwright.llm.kernels import strings, words_of

    rng = random.Random(2)
    vocabulary = [phrase(rng, 1) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(3, 70))) for k in range(60)]
    pieces = [contamination.segments_of(contamination._hashes(t)) for _, t in items]
    flat = [s for p in pieces for s in p]
    df = Counter(int(t) for s in flat for t in np.unique(s).view(np.int64))
    index = contamination.build(items, df, len(flat), float(np.mean([len(s) for s in flat])), 0.6)
    matcher = contamination.Matcher(index, 0.6)
    texts = [say(rng.randint(0, 200)) for _ in range(40)] + [say(20) + " " + t for _, t in items[:10]]
    words = words_of(strings(pa.array(texts)), lower=True)
    hashes = words.hashes()
    got = {(d, i): s for d, i, s in matcher.retrieve(words, hashes)}
    want: dict = {}
    for d in range(len(texts)):
        own = hashes[words.first[d] : words.first[d + 1]]
        for a in range(0, max(1, -(-len(own) // 32) - 1) * 32, 32):
            have = np.isin(index.terms, own[a : a + 64])
            score = np.zeros(len(index.item_of))
            for t in np.flatnonzero(have):
                at = slice(index.first[t], index.first[t + 1])
                score[index.segment[at]] += index.impact[at]
            for s in np.flatnonzero(score >= 1 - 1e-9):
                k = (d, int(index.item_of[s]))
                want[k] = max(want.get(k, 0), score[s])
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quality_model(spark, empty):
    rng = random.Random(4)
    rows = [(k, phrase(rng, 40) if k % 3 else " ".join(w + "!!" for w in phrase(rng, 40).upper().split())) for k in range(600)] + [(9001, None), (9002, ""), (9003, "x" * 200_000)]
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(9001, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(source, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [k for k in range(600) if got[k].held_out]
    assert 60 < len(held) < 180 and sum(got[k].predicted == int(k % 3 > 0) for k in held) >= 0.98 * len(held)
    assert got[9001].score == got[9002].score
    kept = quality.keep_good(source, labels)
    assert kept.columns == source.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(source, labels.where("doc_id < 0")).collect()} == {0.5}


def test_pairs_of_features_are_learnt():
    """An exclusive or has no main effects; only a pair table can hold it."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) != (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=30, pair_rounds=60)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert model.pairs[0][:2] == (2, 0)


def test_lines(spark, docs, empty):
    rng = random.Random(6)
    long = [phrase(rng, 120) for _ in range(4)]
    rows = [(k, "\n".join([phrase(rng, 8), "Shared  line, here!", long[k % 4], ""])) for k in range(8)]
    for k in range(8, 40):
        w = long[0].split()
        w[(k * 5) % 120] = f"e{k}"
        rows.append((k, "shared line here\n" + " ".join(w) + "\n---"))
    rows += [(50, None), (51, ""), (52, "...\n..."), (53, long[1].upper())]
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    values = {(r.id, r.line): r.value & (2**64 - 1) for r in lines.line_values(source).collect()}
    places = defaultdict(list)
    for i, t in sorted(rows):
        for n, line in enumerate((t or "").split("\n")):
            if w := re.findall(r"[^\W_]+", line.lower()):
                places[" ".join(w)].append((i, n))
    names = list(places)
    pairs = []
    for x, a in enumerate(names):
        for y in range(x):
            b = names[y]
            room = int(max(len(a), len(b)) * 0.1 + 1e-9)
            if bin(values[places[a][0]] ^ values[places[b][0]]).count("1") <= 3 and distance(a, b) <= room:
                pairs.append((x, y))
    assert len(pairs) > 50
    least, groups = closure(pairs, range(len(names))), defaultdict(list)
    for x, a in enumerate(names):
        groups[least[x]] += places[a]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    got = {r.doc_id: r for r in lines.removed_lines(source).collect()}
    for i, t in rows:
        assert got[i].n_lines == len((t or "").split("\n")) and got[i].removed == sorted(n for d, n in gone if d == i)
    left = {r.doc_id: r.text for r in lines.dedup(source).collect()}
    for i, t in rows:
        assert left[i] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone))
    assert lines.removed_lines(empty).count() == 0 and lines.dedup(docs).columns == docs.columns


def test_short_fuzzy_lines_by_edit_similarity_alone(spark):
    """Lines of 8 to 300 characters with a few edits; what links is told by edit similarity, not by any hash."""
    rng = random.Random(12)
    lines_of = [phrase(rng, n).replace("ß", "s")[:size].strip() for n, size in [(3, 12), (4, 19), (6, 25), (9, 40), (12, 55), (14, 62), (30, 110), (45, 160), (80, 300)] for _ in range(3)]
    lines_of += ["abcdeab" * 9, "é" * 5 + "abcd" * 20]
    texts = list(lines_of)
    for line in lines_of:
        for edits in (1, max(1, len(line) // 30), max(1, len(line) // 20)):
            new = list(line)
            for at in rng.sample(range(len(new)), edits):
                new[at] = rng.choice(["x", "xy", ""])
            texts.append("".join(new))
        texts.append(line.replace(line.split()[-1], "xyz"))
    rows = [(k, f"{t}\n...") for k, t in enumerate(texts)]
    names = [" ".join(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    near = lambda a, b: distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)
    least = closure([(x, y) for x in range(len(names)) for y in range(x) if abs(len(names[x]) - len(names[y])) < 31 and near(names[x], names[y])], range(len(names)))
    got = {r.doc_id: r.n_removed for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: int(least[k] < k) for k in range(len(names))} and sum(got.values()) > 70


@pytest.mark.parametrize("similarity", [0.9, 0.8])
def test_pieces_meet_every_short_pair(similarity):
    """Any text within the allowed edits of a short one shares a piece with it."""
    by_size = defaultdict(list)
    for size, start, n, code in lines.piece_places(similarity):
        by_size[size].append((start, n, code))
    keys = lambda t: {(code, t[start - 1 : start - 1 + n]) for start, n, code in by_size[len(t)]}
    rng = random.Random(9)
    for _ in range(4000):
        a = b = "".join(rng.choice("ab") for _ in range(rng.randint(5, lines.short_limit(similarity))))
        for _ in range(lines.allowed(len(a), similarity)):
            at = rng.randrange(len(b))
            b = b[:at] + rng.choice(["", "c", "cc", "c" + b[at]]) + b[at + 1 :]
        longer = max(len(a), len(b))
        if a != b and longer <= lines.short_limit(similarity) and distance(a, b) <= lines.allowed(longer, similarity):
            assert keys(a) & keys(b), (a, b)


def test_line_values_of_long_lines(spark):
    """A line of several chunks votes as a whole, and repeated rows change nothing."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(50)}" for _ in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:40_000])), (3, "a b"), (3, "a b")]
    got = {r.id: r for r in lines.line_values(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {*words, "a", "b"}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for i, text in rows:
        own = text.split()
        want = sum(1 << b for b in range(64) if 2 * sum((hashes[w] >> b) & 1 for w in own) > len(own))
        assert got[i].value & (2**64 - 1) == want and got[i].words == len(own)


def test_line_of_one_repeated_word(spark):
    """Every word of a chunk votes for the same bits, among them the topmost of each lane."""
    rows = [(1, "junk " * 70_000), (2, ("junk " * 32_768).strip()), (3, "w " * 16_384), (4, "other")]
    source = spark.createDataFrame([*rows, (5, "junk " * 70_000)], "doc_id long, text string")
    names = [f"w{k}" for k in range(64)]
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in ["junk", "w", "other", *names]], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r.id: (r.value, r.words) for r in lines.line_values(source).collect()}
    assert got == {1: (hashes["junk"], 70_000), 2: (hashes["junk"], 32_768), 3: (hashes["w"], 16_384), 4: (hashes["other"], 1), 5: (hashes["junk"], 70_000)}
    top = next(w for w in names if hashes[w] < 0)
    full = spark.createDataFrame([(1, f"{top} " * 70_000)], "doc_id long, text string")
    assert lines.line_values(full).first().value == hashes[top]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def test_surrogates(spark, docs, empty):
    rows = [
        (1, "Call Mr. John Smith at +1 (640) 555-0953 or 640-555-0953. Mail John.Smith@Example.com, JOHN.SMITH@EXAMPLE.COM; Frau Anna Weber and Frau Weber."),
        (2, "card 4040549990366437, again 4040-5499-9036-6437; ip 76.133.12.197 token 6a4589e4112292221d28c7e47303eee3 in SMITH"),
        (3, None), (4, ""), (5, "г-н Иван Петров, г-жа Петрова; κυρία Μαρία Παππά"), (6, "Ms Smith wrote 3.14159 on 2024-01-02, version 1.2.3.4.5"), (6, "Ms Smith wrote 3.14159 on 2024-01-02, version 1.2.3.4.5"),
    ]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(surrogates.replace(source, "k").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r.text for r in out}
    assert len(out) == len(rows) and got[3] is None and got[4] == ""
    for secret in ("John Smith", "555-0953", "ohn.Smith@", "SMITH@", "Anna", "Weber", "4040", "76.133.12.197", "6a4589", "Иван", "Петров", "Παππά"):
        assert secret not in " ".join(t or "" for t in got.values())
    first, second = re.search(r"card (\d{16}), again ([\d-]+)", got[2]).groups()
    assert second == "-".join(first[k : k + 4] for k in range(0, 16, 4))
    smith = re.search(r"Mr\. (\w+) (\w+) at", got[1]).group(2)
    assert f"Ms {smith} wrote 3.14159 on 2024-01-02, version 1.2.3.4.5" == got[6]
    mails = re.findall(r"[\w.]+@[\w.]+\w", got[1])
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].endswith(".com")
    woman, family, again = re.search(r"Frau (\w+) (\w+) and Frau (\w+)\.", got[1]).groups()
    assert family == again and woman[-2:] in {"ra", "ia", "na", "sa"}
    assert re.fullmatch(r"г-н [А-Я][а-я]+ [А-Я][а-я]+, г-жа [А-Я][а-я]+; κυρία [Α-Ω][α-ωά-ώ]+ [Α-Ω][α-ωά-ώ]+", got[5])
    assert surrogates.replace(source, "k").subtract(surrogates.replace(source, "other").where("doc_id in (1, 2)")).count() > 0
    assert surrogates.replace(empty, "k").count() == 0 and surrogates.replace(docs, "k").columns == [*docs.columns, "n_entities"]


def test_surrogates_stay_distinct(spark):
    """A small space of addresses and many names: collisions must be resolved."""
    units = spark.createDataFrame([("ssn", f"{k:09d}") for k in range(300)] + [("surname", f"name{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(600)], "kind string, canonical string")
    out = surrogates.assign(units, "k").collect()
    assert len(out) == 900 and len({(r.kind, r.surrogate.lower()) for r in out}) == 900
    assert not {r.surrogate.lower() for r in out} & {r.canonical for r in out}
