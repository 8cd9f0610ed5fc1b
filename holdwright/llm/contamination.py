"""Benchmark decontamination: BM25 over test items, pruned by block maxima, then overlap checks.

The test items are the index, cut into segments of at most `SEGMENT` words; every
passage of every training document is a query. A passage retrieves each segment
whose BM25 score is at least `share` of the score the segment gives itself. Three
bounds come before a full score, none of which can lose a hit:

* per segment only its rarest terms are essential: without them the rest cannot
  reach the threshold. A passage whose essential terms, each at its best segment,
  stay below the bar is left;
* the same sum per block of segments, with the block's maximum for each term;
* full scores only in the blocks that remain.

A document then counts as contaminated by an item when it has at least `overlap` of the
5-word grams of question and answer together, and some of each (the question is the
item's first line, the answer the rest; a part of fewer words is one gram).

Passages overlap by half, so every stretch of `SEGMENT` words lies whole in one.
Items go to the tasks in shards of at most `SHARD_BYTES` of text; a larger benchmark
takes several passes, with statistics of the whole. Items without words are
ignored, null text counts as empty, and an empty table on either side gives no
match. Repeated documents match each by itself; items with the same id are one
item each per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdwright.llm.kernels import Words, grams, slices, strings, words_of

SEGMENT, BLOCK, GRAM = 32, 16, 5
SHARD_BYTES = 8_000_000
K1, B = 1.2, 0.75


@dataclass
class Index:
    """Postings over segments, with impacts as shares of the segment's threshold."""

    terms: np.ndarray  # sorted term hashes
    first: np.ndarray  # postings of a term
    segment: np.ndarray
    impact: np.ndarray
    essential_best: np.ndarray  # per term
    block_first: np.ndarray
    block: np.ndarray
    block_best: np.ndarray
    item_of: np.ndarray  # per segment
    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, question grams, answer grams


def _hashes(text: str) -> np.ndarray:
    return words_of(strings(pa.array([text])), lower=True).hashes()


def gram_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct grams; fewer words make one gram, none make none."""
    return np.unique(grams(hashes, min(GRAM, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def segments_of(hashes: np.ndarray) -> list[np.ndarray]:
    """Even pieces of at most SEGMENT words."""
    return np.array_split(hashes, -(-len(hashes) // SEGMENT)) if len(hashes) else []


def document_frequencies(items: DataFrame, text: str) -> tuple[DataFrame, int, float]:
    """Items with their segments' statistics over the whole benchmark: number of segments and mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s.view(np.int64)[np.unique(s, return_index=True)[1]], len(s)) for t in b.column(0).to_pylist() for s in segments_of(_hashes(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.list_(pa.int64())), pa.array([n for _, n in out], pa.int64())], names=["terms", "words"])

    pieces = items.select(text).mapInArrow(run, "terms array<bigint>, words bigint")
    n, mean = pieces.agg(F.count("*"), F.avg("words")).first()
    return pieces.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), n, mean or 1.0


def build(rows: list[tuple[int, str]], df: dict[int, int], n: int, mean: float, share: float) -> Index | None:
    items, owner, postings = [], [], []
    for item, text in rows:
        parts = (text or "").strip().split("\n", 1)
        whole = _hashes(text or "")
        if not len(whole):
            continue
        question, answer = _hashes(parts[0]), _hashes(parts[1] if len(parts) > 1 else "")
        for piece in segments_of(whole):
            terms, tf = np.unique(piece, return_counts=True)
            freq = np.array([df[int(t)] for t in terms.view(np.int64)], float)
            idf = np.log(1 + (n - freq + 0.5) / (freq + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(piece) / mean))
            need = share * impact.sum()
            rare_first = np.lexsort((terms, freq))
            rest = impact.sum() - np.cumsum(impact[rare_first])
            essential = np.zeros(len(terms), bool)
            essential[rare_first[: int(np.argmax(rest <= need / 2)) + 1]] = True
            left = need - impact[~essential].sum()
            postings.append((terms, np.full(len(terms), len(owner)), impact / need, np.where(essential, impact / left, 0.0)))
            owner.append(len(items))
        items.append((item, gram_set(question), gram_set(answer)))
    if not items:
        return None
    terms, segment, impact, bar = (np.concatenate(x) for x in zip(*postings))
    order = np.lexsort((segment, terms))
    terms, segment, impact, bar = terms[order], segment[order], impact[order], bar[order]
    distinct, first = np.unique(terms, return_index=True)
    key = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (segment[1:] // BLOCK != segment[:-1] // BLOCK)]))
    return Index(
        distinct,
        np.append(first, len(terms)),
        segment,
        impact,
        np.maximum.reduceat(bar, first),
        np.append(np.searchsorted(terms[key], distinct), len(key)),
        segment[key] // BLOCK,
        np.maximum.reduceat(impact, key),
        np.array(owner),
        items,
    )


class Matcher:
    def __init__(self, index: Index, overlap: float) -> None:
        self.index, self.overlap = index, overlap
        self.low_bits = np.zeros(1 << 20, bool)
        self.low_bits[index.terms & np.uint64((1 << 20) - 1)] = True

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each word in the index, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.low_bits[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.index.terms, hashes[maybe]), len(self.index.terms) - 1)
        out[maybe] = np.where(self.index.terms[at] == hashes[maybe], at, -1)
        return out

    @staticmethod
    def expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, posting) for every posting of each row's term."""
        counts = first[terms + 1] - first[terms]
        row = np.repeat(np.arange(len(terms)), counts)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[terms], counts)

    @staticmethod
    def sums(a: np.ndarray, b: np.ndarray, values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of values by (a, b), for sums of at least `least`."""
        order = np.lexsort((b, a))
        a, b, values = a[order], b[order], values[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        total = np.add.reduceat(values, at) if len(at) else np.zeros(0)
        good = total >= least - 1e-9
        return a[at][good], b[at][good], total[good]

    def retrieve(self, words: Words, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, item, best score as a share of the segment's threshold)."""
        x = self.index
        ids = self.term_ids(hashes)
        bar = np.where(ids >= 0, x.essential_best[ids], 0.0)
        totals = np.concatenate([[0.0], np.cumsum(bar)])
        counts = words.counts
        per_doc = np.maximum(1, -(-counts // SEGMENT) - 1) * (counts > 0)
        document = np.repeat(np.arange(len(counts)), per_doc)
        begin = words.first[document] + SEGMENT * (np.arange(len(document)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
        end = np.minimum(begin + 2 * SEGMENT, words.first[document + 1])
        passing = np.flatnonzero(totals[end] - totals[begin] >= 1 - 1e-6)
        if not len(passing):
            return []
        begin, end, document = begin[passing], end[passing], document[passing]
        size = end - begin
        passage = np.repeat(np.arange(len(passing)), size)
        term = ids[np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
        pairs = np.unique(passage[term >= 0] * len(x.terms) + term[term >= 0])
        passage, term = pairs // len(x.terms), pairs % len(x.terms)
        row, at = self.expand(x.block_first, term)
        p, block, _ = self.sums(passage[row], x.block[at], x.block_best[at], 1.0)
        if not len(p):
            return []
        blocks = int(x.block.max()) + 1
        opened = p * blocks + block
        some = np.isin(passage, p)
        passage, term = passage[some], term[some]
        row, at = self.expand(x.first, term)
        inside = np.isin(passage[row] * blocks + x.segment[at] // BLOCK, opened)
        p, segment, score = self.sums(passage[row][inside], x.segment[at][inside], x.impact[at][inside], 1.0)
        best: dict[tuple[int, int], float] = {}
        for d, i, s in zip(document[p].tolist(), x.item_of[segment].tolist(), score.tolist()):
            best[d, i] = max(s, best.get((d, i), 0.0))
        return [(d, i, s) for (d, i), s in sorted(best.items())]

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item id, score, question overlap, answer overlap) of each contamination."""
        out = []
        for start, piece in slices(texts):
            words = words_of(piece, lower=True)
            hashes = words.hashes()
            of, own = -1, None
            for d, i, score in self.retrieve(words, hashes):
                item, question, answer = self.index.items[i]
                mine = hashes[words.first[d] : words.first[d + 1]]
                if d != of:
                    of, own = d, np.sort(grams(mine, GRAM))
                shares = [self._share(g, own, mine) for g in (question, answer)]
                known = [(s, len(g)) for s, g in zip(shares, (question, answer)) if len(g)]
                together = sum(s * n for s, n in known) / sum(n for _, n in known)
                if together >= self.overlap and all(s > 0 for s, n in known if n > 1):
                    out.append((start + d, item, score, shares[0], shares[1]))
        return out

    @staticmethod
    def _share(part: np.ndarray, own: np.ndarray, words: np.ndarray) -> float:
        if not len(part):
            return 0.0
        found = int(np.isin(part, own).sum())
        if len(part) == 1 and not found:  # may be a gram of fewer words
            found = int(any(part[0] in grams(words, k) for k in range(1, GRAM)))
        return found / len(part)


def _matchers(items: DataFrame, item_id: str, text: str, share: float, overlap: float) -> list[Matcher]:
    """One matcher for each shard of the items."""
    source = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    frequencies, n, mean = document_frequencies(source, "text")
    out = []
    for shard in range(shards):
        mine = source.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        rows = [(r.item, r.text) for r in mine.distinct().orderBy("item", "text").toLocalIterator()]
        if shards == 1:
            df = {r.term: r.df for r in frequencies.toLocalIterator()}
        else:
            wanted = spark_terms(mine)
            df = {r.term: r.df for r in frequencies.join(wanted, "term", "left_semi").toLocalIterator()}
        index = build(rows, df, n, mean, share)
        if index is not None:
            out.append(Matcher(index, overlap))
    return out


def spark_terms(items: DataFrame) -> DataFrame:
    """Distinct terms of some items."""
    return document_frequencies(items, "text")[0].select("term")


def matches(
    docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.6, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of every contaminated document; the score is in thresholds."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_id}` bigint, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    found = spark.createDataFrame([], schema)
    for matcher in _matchers(items, item_id, item_text, share, overlap):
        shipped = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = shipped.value.find(strings(b.column(1)))
                if hits:
                    row, item, score, question, answer = zip(*hits)
                    columns = [b.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(score), pa.array(question), pa.array(answer)]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, item_id, "score", "question_overlap", "answer_overlap"])

        found = found.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.6, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no item contaminates, all columns as they were."""
    kept = docs
    place = docs.columns.index(text)
    for matcher in _matchers(items, item_id, item_text, share, overlap):
        shipped = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[h[0] for h in shipped.value.find(strings(b.column(place)))]] = False
                yield b.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
