"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has one lookup table over its bins. Training goes round the features,
each time fitting one shallow tree to the current gradients and adding it to that
feature's table with a small step; then the strongest pairs get tables of their own
in the same way. Scoring adds the table cells of a document's bins.

Features come from the text alone. The whole corpus is described and scored; the
fit itself uses at most `max_rows` labelled rows, those with the least hash of the
key. Null text counts as empty; the empty text has all-zero features and gets a score
like any other. Rows with equal keys are scored each by itself. Labels that are
null are ignored; without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.llm.kernels import PRIME, gram_starts, grams, mix, slices, strings, words_of
from holdwright.llm.tables import stored

FEATURES = ["chars", "words", "word_bytes", "upper", "lower", "digit", "space", "line", "stop", "exclaim", "bar", "symbol", "other_punct", "wide", "distinct", "repeated", "long_words", "line_words"]
UPPER, LOWER, DIGIT, SPACE, LINE, STOP, EXCLAIM, BAR, SYMBOL, PUNCT, WIDE, TAIL = range(12)
CLASSES = np.full(256, PUNCT, np.int64)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[192:], CLASSES[128:192] = UPPER, LOWER, DIGIT, WIDE, TAIL
for characters, kind in ((b" \t\r\v\f", SPACE), (b"\n", LINE), (b".,;:?'\"", STOP), (b"!", EXCLAIM), (b"|", BAR), (b"#$%&*@^~<>{}[]\\", SYMBOL)):
    CLASSES[list(characters)] = kind


def describe(piece: pa.Array) -> np.ndarray:
    """Feature matrix of a few texts."""
    words = words_of(piece)
    n = len(piece)
    lengths = np.array(pa.compute.binary_length(piece).to_numpy(zero_copy_only=False), np.int64)
    kinds = np.bincount(np.repeat(np.arange(n), lengths) * 12 + CLASSES[words.data], minlength=12 * n).reshape(n, 12)
    chars = lengths - kinds[:, TAIL]
    per_char = kinds / np.maximum(chars, 1)[:, None]
    counts = words.counts
    sizes = words.ends - words.starts
    owner = words.document()
    hashes = words.hashes()

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        keys = mix(values ^ (of.astype(np.uint64) * PRIME))
        first = np.unique(keys, return_index=True)[1]
        return np.bincount(of[first], minlength=n)

    starts = gram_starts(words, 3)
    triples = np.bincount(owner[starts], minlength=n)
    repeated = 1 - distinct(grams(hashes, 3)[starts], owner[starts]) / np.maximum(triples, 1) if len(starts) else np.zeros(n)
    per_word = np.maximum(counts, 1)
    columns = [
        np.log1p(chars), np.log1p(counts), np.bincount(owner, sizes, n) / per_word,
        *[per_char[:, k] for k in (UPPER, LOWER, DIGIT, SPACE, LINE, STOP, EXCLAIM, BAR, SYMBOL, PUNCT, WIDE)],
        distinct(hashes, owner) / per_word, np.where(triples > 0, repeated, 0.0), np.bincount(owner, sizes > 14, n) / per_word, np.log1p(counts / (1 + kinds[:, LINE])),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Model:
    """Sum of lookup tables on the log-odds scale."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1) if edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        fine, rough = self.binned(self.edges, x), self.binned(self.coarse, x)
        for k, table in enumerate(self.tables):
            total += table[fine[:, k]]
        for a, b, table in self.pairs:
            total += table[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Step function over the bins from at most `leaves` leaves, each split the best one left."""
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(bounds) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = _gain(cg[cuts] - cg[a], ch[cuts] - ch[a]) + _gain(cg[b] - cg[cuts], ch[b] - ch[cuts]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(cuts[k])))
        if best[1] < 0:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best cut of one axis, then of the other on each side; values over the grid, and the gain."""
    best = (np.zeros_like(g), 0.0)
    whole = float(_gain(g.sum(), h.sum()))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            out, gain = np.zeros_like(gg), -whole
            for part in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[part].sum(0), hh[part].sum(0)
                step = _tree(sg, sh, 2)
                out[part] = step
                for value in np.unique(step):
                    same = step == value
                    gain += float(_gain(sg[same].sum(), sh[same].sum()))
            if gain > best[1]:
                best = (out.T if flip else out, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, step: float = 0.1, bins: int = 32, pair_bins: int = 6, n_pairs: int = 4, pair_rounds: int = 15) -> Model:
    """Cyclic boosting of the main tables, then of the strongest pairs."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    model.coarse = [_edges(x[:, k], pair_bins) for k in range(x.shape[1])]
    fine, rough = Model.binned(model.edges, x), Model.binned(model.coarse, x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slopes()
                change = step * _tree(np.bincount(fine[:, k], g, len(table)), np.bincount(fine[:, k], h, len(table)), 3)
                table += change
                total += change[fine[:, k]]
    for k, table in enumerate(model.tables):  # centred, so that the intercept carries the mean
        mean = float(table[fine[:, k]].mean())
        table -= mean
        model.intercept += mean

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return np.bincount(rough[:, a] * shape[1] + rough[:, b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in ranked[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            change = step * _pair_tree(grid(a, b, g), grid(a, b, h))[0]
            table += change
            total += change[rough[:, a], rough[:, b]]
    return model


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, piece in slices(strings(b.column(1))):
                x = describe(piece)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), values], names=[key, "features"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, features array<float>")


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(described: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = 20_000) -> Model:
    """Fit on labelled rows outside the held-out fold, at most `max_rows` of them."""
    known = labels.select(key, F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    rows = described.join(known, key).orderBy(F.xxhash64(key), key, "label").limit(max_rows).select("features", "label")
    batch = rows.toArrow()
    x = np.array(batch.column("features").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array(batch.column("label").to_pylist(), float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """(key, held_out, score, predicted) of every document."""
    described = stored(features(docs, key, text))
    shipped = docs.sparkSession.sparkContext.broadcast(train(described, labels, key, label, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shipped.value.score(x), pa.float64())], names=[key, "score"])

    scored = described.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """The documents whose score reaches the threshold, all columns as they were."""
    model = train(stored(features(docs, key, text)), labels, key, label, max_rows)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [shipped.value.score(describe(p)) >= threshold for _, p in slices(strings(b.column(place)))]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
