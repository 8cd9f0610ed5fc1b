"""Inputs that broke an operator once: shared ids, clashing column names, very long words and domains."""

from __future__ import annotations

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdwright.llm import bpe, lines, substrings, surrogates, warc


def test_pages_that_share_an_id_keep_their_payloads(spark):
    rows = [(1, "u", "A"), (1, "u", "B"), (2, "u", "A"), (3, "u", "B"), (3, "u", "C")]
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digests string, kind int").repartition(2)
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(warc.archive_pages(pages)).collect())
    digest = {t: warc.payload_digest(t.encode()) for t in "ABC"}
    assert got == sorted([(1, digest["A"], "revisit", 2), (1, digest["B"], "revisit", 3), (2, digest["A"], "response", None), (3, digest["B"], "response", None), (3, digest["C"], "response", None)], key=str)


def test_unique_lines_of_a_shared_id_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    same, first, second, third = (" ".join(word() for _ in range(20)) for _ in range(4))
    rows = [(1, f"{first}\n{same}"), (2, f"{same}\n{second}"), (2, f"{third}\n{same}"), (2, f"{same}\n{second}")]
    docs = spark.createDataFrame([(*r, i, f"r{i}", 1) for i, r in enumerate(rows)], "doc_id long, text string, removed int, removal_id string, body int").repartition(3)
    out = {r.removed: r.text for r in lines.dedup(docs).collect()}
    assert lines.dedup(docs).columns == docs.columns
    assert out == {0: f"{first}\n{same}", 1: second, 2: third, 3: second}


def test_surrogates_with_clashing_columns(spark):
    rows = [(1, "Write to Anna Weber, anna@weber.example", "a", 2, [3], 7), (2, None, "b", 1, [4], 8), (3, "nothing", "c", 0, [5], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, matches int, parts array<int>, n_entities int")
    out = {r.doc_id: r for r in surrogates.replace(docs, "k").collect()}
    assert set(surrogates.replace(docs, "k").columns) == set(docs.columns)
    assert [(out[k].row, out[k].matches, out[k].parts, out[k].n_entities) for k in (1, 2, 3)] == [("a", 2, [3], 2), ("b", 1, [4], 0), ("c", 0, [5], 0)]
    assert "weber" not in out[1].text.lower() and out[3].text == "nothing" and out[2].text is None


def test_a_domain_of_many_labels(spark):
    long = "joe@" + ".".join(["ab"] * 20_000)
    docs = spark.createDataFrame([(1, f"see {long} now"), (2, "joe@ab.cd. And"), (3, "x@y.z-1.co, a@b")], "doc_id long, text string")
    out = {r.doc_id: r for r in surrogates.replace(docs, "k").collect()}
    assert [out[k].n_entities for k in (1, 2, 3)] == [1, 1, 1]
    assert len(out[1].text) == len(long) + 8 and "joe@" not in out[1].text and out[2].text.endswith(". And") and out[3].text.endswith(", a@b")


@pytest.fixture(scope="module")
def book():
    return bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_long_words_as_the_library(book):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    words = ["a" * 3_000, "ab" * 2_000, "".join(rng.choice("etaoinshrdlu") for _ in range(5_000)), "the" * 900 + "é" * 50, "x" * 65, "aaab" * 17]
    for w in words:
        assert book.merge_long(book.units(w)) == library.encode(w, add_special_tokens=False).ids
        assert book.encode_words([w])[w] == book.merge_long(book.units(w))
    short = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [book.merge_long(book.units(w)) for w in short] == book.merge([book.units(w) for w in short])


def test_a_word_of_a_million_letters_takes_seconds(book):
    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(1_000_000))
    start = time.process_time()
    ids = book.encode_words([word])[word]
    assert time.process_time() - start < 60
    assert "".join(book.tokens[i] for i in ids) == word + bpe.WORD_END


def test_entries_held_over_packs_give_the_same(spark, monkeypatch):
    """Substring dedup does not depend on how many entries travel in a row."""
    rng = random.Random(4)
    phrase = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(3)) for _ in range(n))
    passages = [phrase(20) for _ in range(5)]
    rows = [(k, phrase(rng.randint(0, 40)) + " " + rng.choice(passages) + " " + phrase(5)) for k in range(120)] + [(3, passages[0]), (200, None), (None, passages[0])]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, part int, keys binary").repartition(4)
    whole = sorted(map(tuple, substrings.dedup(docs).collect()))
    monkeypatch.setattr(substrings.blocks, "SLICE_ENTRIES", 7)
    assert sorted(map(tuple, substrings.dedup(docs).collect())) == whole and any(r[2] for r in whole)
