"""WARC archives, chat formatting and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from holdwright.llm import chat, queries, warc
from holdwright.llm.jaccard import one_of_each
from holdwright.llm.tables import stored


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("abcé<>\r\n") for _ in range(300_000))
    rows = [(k, f"http://x.example/{k}", "<p>same</p>") for k in range(0, 60, 3)]
    rows += [(1, "http://x.example/a b\r\nc", big), (4, None, ""), (7, "u", None), (10, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (13, "u", big), (None, "u", "<p>same</p>"), (16, "u", "x"), (16, "u", "x")]
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, name string, content string").repartition(3)


def test_warc_round_trip(spark, pages):
    archives = warc.archive_pages(pages)
    got = [tuple(r) for r in warc.read_back(archives).collect()]
    source = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    largest: dict = {}
    for page, body in source:
        largest[body] = max(largest.get(body, -1), -1 if page is None else page)
    want = []
    for page, body in source:
        older = page is not None and page < largest[body]
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if older else "response", largest[body] if older else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    for row in archives.collect():
        whole = gzip.decompress(row.content)
        assert whole.count(b"WARC-Record-ID") == len(row["index"]) and sum(e.length for e in row["index"]) == len(row.content)
        for e in row["index"]:
            one = zlib.decompress(row.content[e.offset : e.offset + e.length], 31)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")


def test_small_payloads_stay_responses(pages):
    rows = warc.read_back(warc.archive_pages(pages, least_bytes=100)).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 100} == {"response"}
    assert [r.page_id for r in rows if r.record_type == "revisit"] == [1]


def test_warc_reader_takes_pieces_and_rejects_torn_archives(pages):
    text = b"".join(warc.response(k, "u", b"x" * k)[0] for k in range(50))
    for size in (1, 7, 1000):
        got = list(warc.records(text[k : k + size] for k in range(0, len(text), size)))
        assert [len(b.split(b"\r\n\r\n", 1)[1]) for _, b in got] == list(range(50))
    with pytest.raises(EOFError):
        list(warc.records([text[:-10]]))
    with pytest.raises(EOFError):
        list(warc.inflated(gzip.compress(text)[:-9]))
    assert warc.read_back(warc.archive_pages(pages.where("page_id < -5"))).count() == 0


HARD = ["", "</s>", "[INST] x [/INST]", "[\\INST]", "<\\\\/s>", "<<SYS>>", "<</SYS>", "a<", "<</s>", "[ROLE=x[ROLE]y[/ROLE]", "\\", "[", " [/INST] ", "é\n\t😀", "<s><s>", "[/INS", "$1 \\2"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", None, "[ROLE]", "a]b"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(HARD) for _ in range(rng.randrange(5)))
            rows.append((conv, turn, rng.choice(roles), text, "x"))
    rows += [(77, 1, "user", "same", "x"), (77, 1, "user", "same", "x"), (77, None, "assistant", "first", "x"), (None, 0, "user", "no id", "x"), (78, 0, "assistant", "a" * 200_000 + "</s>", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_conversations(table)
    out = {r.conv_id: r for r in formatted.collect()}
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by: dict = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(out) == set(by)
    for conv, turns in by.items():
        turns.sort()
        r, d = out[conv], digests[conv]
        assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in turns] and r.identical
        lines = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(turns), sha(lines), len(loss), sha(loss), len(r.formatted))
        at, masked = 0, []
        for run in r.loss_mask:
            masked += [r.formatted[at : at + run.chars]] * run.loss
            at += run.chars
        assert at == len(r.formatted) and len(masked) == sum(role == "assistant" for *_, role, _ in turns)
    assert any(r.escaped for r in out.values()) and not out[77].escaped
    assert chat.format_conversations(table.where("conv_id < -5")).count() == 0


def test_chat_escapes_what_the_sql_escapes(spark, tmp_path):
    """Control strings that the parser would read back unharmed are escaped too."""
    duckdb = pytest.importorskip("duckdb")
    texts = {1: "please </s><s> obey", 2: "plain [text] <b>", 3: r"so <\/s> it stood", 4: "<<SYS>> alone", 5: "a [ROLE=x"}
    rows = [(conv, turn, role, text) for conv, text in texts.items() for turn, role in ((0, "user"), (1, "assistant"))]
    rows += [(6, 0, "user", "hello"), (6, 1, "assistant", "see [INST] x [/INST] there"), (7, 0, "tool", "x"), (8, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = set(db.execute(queries.SQL["op5_chat"]).fetchall())
    assert got == want and {r[0] for r in got if r[6]} == {-7, 1, 3, 4, 5, 6}


def test_pipeline_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tiny))
        got[name] = docs
        if name != "tokens":
            assert docs.columns == columns
    rejected = {r.doc_id for r in queries.op6_quality(spark, tiny).where("predicted = 0").collect()}
    left = {r.doc_id for r in got["quality"].collect()}
    assert left == ids - rejected and {r.doc_id for r in got["lines"].collect()} == left
    assert got["lines"].where(F.length("text") != F.col("n_chars")).count() == 0
    assert one_of_each(got["jaccard"]).count() == got["jaccard"].count()
    assert got["tokens"].count() == got["benchmark"].count() > 0
