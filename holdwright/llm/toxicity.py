"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

A text is read as sentences (ended by . ! ? before a space, or by a line break), a sentence as units: the
letters of each word, and runs of three and more single letters put together, so that separators written into
a word, or a word spelled out, change nothing. The kernel of two units sums over all letter triples that both have
in order within `SPAN` letters, each weighed by `DECAY` to the power of the stretch it takes in either; letters put in between or left out
lower it and do not end it. Units longer than `WINDOW` letters are read through overlapping windows.

Landmarks are strings that tell labelled toxic texts best (word beginnings that occur in most toxic texts
not told yet and in few others), and some frequent units of clean texts. A unit's kernel values with the
landmarks, of unit length each, times the inverse root of the landmarks' own kernel matrix, are its Nyström features; a sentence takes the greatest
value of its units for each landmark. A linear machine with squared hinge loss is trained on labelled sentences: those of clean texts against
the sentences of toxic texts that the machine of the round before finds on its toxic side, or their best one. A logistic
curve over the greatest decision of a text, the sum and the share of those above `LEAN`, and the number of its sentences gives the score.

Only text goes into a score. Labels are read outside the held-out fold; at most `max_rows` labelled texts of each label, those
with the least hash of the key and with at most `fit_chars` characters, fit the model, weighed back to their number.
Every whole text is scored. Null text counts as empty; texts without letters have zero features and a score like
any other. Rows are scored each by itself, repeated ones too; a null key is in no fold's labels. Null labels are ignored; with
one label only, the score is its smoothed share. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.llm.kernels import slices, strings

DECAY = 0.8
SPAN = 6
POWER = 3
WINDOW = 24
MARK_LETTERS = (4, 8)
SPELLED = 3
SENTENCE = re.compile(r"(?<=[.!?])\s+|[\n\r]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
LEAN = -0.9
TIMES = 4
UNIT_STORE = 150_000
TOKENS_AT_ONCE = 100_000


def _triples() -> list[tuple[int, int]]:
    """Distances of the second and third letter from the first."""
    return [(b, c) for c in range(2, SPAN) for b in range(1, c)]


class Kernel:
    """The kernel with a fixed set of marks, as a sum over the letter triples that some mark has."""

    def __init__(self, marks: list[str]):
        letters = sorted(set("".join(marks)))
        self.letters = np.array([ord(x) for x in letters], np.uint32)
        self.size = len(letters) + 1
        self.marks = marks
        found: dict[tuple[int, int, int], np.ndarray] = {}
        for k, mark in enumerate(marks):
            at = [1 + letters.index(x) for x in mark]
            for b, c in _triples():
                for i in range(len(at) - c):
                    found.setdefault((at[i], at[i + b], at[i + c]), np.zeros(len(marks), np.float32))[k] += DECAY ** (c + 1)
        self.row = np.zeros(self.size**3, np.int32)  # 0: no mark has the triple
        for n, (x, y, z) in enumerate(found, 1):
            self.row[(x * self.size + y) * self.size + z] = n
        table = np.stack([np.zeros(len(marks), np.float32), *found.values()])
        self.table, self.own = table, np.ones(len(marks), np.float32)
        plain = self.pieces(marks)  # of the marks with each other
        self.own = np.diag(plain).copy()
        self.table = table / self.own
        self.among = (plain / np.sqrt(np.outer(self.own, self.own))).astype(float) ** POWER

    def pieces(self, units: list[str]) -> np.ndarray:
        """Kernel values of units of usual length."""
        out = np.zeros((len(units), len(self.marks)), np.float32)
        sizes = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.letters, points), self.size - 2)
        code = np.where(self.letters[place] == points, place + 1, 0)
        owner = np.repeat(np.arange(len(units)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
        first = code * self.size
        for b, c in _triples():
            n = len(code) - c
            if n <= 0:
                continue
            rows = self.row[(first[:n] + code[b : n + b]) * self.size + code[c:]]
            at = np.flatnonzero((rows > 0) & (left[:n] > c))
            if len(at):
                own = owner[at]
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out[own[heads]] += np.add.reduceat(self.table[rows[at]], heads, axis=0) * np.float32(DECAY ** (c + 1))
        return out

    def of(self, units: list[str]) -> np.ndarray:
        """Kernel values of units of any length; long ones take the greatest of their windows."""
        step = WINDOW // 2
        cut = [u[a : a + WINDOW] for u in units for a in range(0, max(1, len(u) - step), step)]
        first = np.cumsum([0, *(len(range(0, max(1, len(u) - step), step)) for u in units[:-1])]) if units else np.zeros(0, np.int64)
        out = np.concatenate([self.pieces(cut[a : a + 20_000]) for a in range(0, len(cut), 20_000)] or [np.zeros((0, len(self.marks)), np.float32)])
        out = np.maximum.reduceat(out, first, axis=0) if len(cut) > len(units) else out
        return np.minimum(out, 1.5) ** POWER


def unit_of(word: str) -> str:
    return NOT_LETTERS.sub("", word)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower-cased; a text without any has one empty sentence."""
    return [words for s in SENTENCE.split(text.lower()) if (words := s.split())] or [[]]


class Units:
    """Kernel values of the units seen so far, a bounded number of them."""

    def __init__(self, marks: list[str]):
        self.kernel = Kernel(marks)
        self.forget()

    def forget(self) -> None:
        self.of_word: dict[str, int] = {"": 0}
        self.letters: list[str] = [""]
        self.single = [False]
        self.values = np.zeros((1, len(self.kernel.marks)), np.float32)

    def number(self, word: str) -> int:
        unit = unit_of(word)
        found = self.of_word.get(unit)
        if found is None:
            found = self.of_word[unit] = len(self.letters)
            self.letters.append(unit)
            self.single.append(len(unit) == 1)
        self.of_word[word] = found
        return found

    def table(self) -> np.ndarray:
        if len(self.letters) > len(self.values):
            self.values = np.concatenate([self.values, self.kernel.of(self.letters[len(self.values) :])])
        return self.values


def described(texts: Iterable[str], units: Units) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(greatest kernel values of each sentence, sentences of each text) for some texts at a time.

    A text may be longer than a step: the sentences of its parts follow each other, and its count is in the last part.
    """
    words: list[int] = []
    bounds: list[int] = []
    counts: list[int] = []
    for text in texts:
        found = 0
        for sentence in sentences(text):
            bounds.append(len(words))
            words.append(0)
            of_word, number = units.of_word, units.number
            words += [of_word[w] if w in of_word else number(w) for w in sentence]
            found += 1
            if len(words) >= TOKENS_AT_ONCE:
                yield _pooled(units, words, bounds), np.array([*counts, -found])
                words, bounds, counts, found = [], [], [], 0
                if len(units.letters) > UNIT_STORE:
                    units.forget()
        counts.append(found)
    if counts:
        yield _pooled(units, words, bounds), np.array(counts)


def _pooled(units: Units, words: list[int], bounds: list[int]) -> np.ndarray:
    """Greatest values of each sentence; its first unit is the empty one, so that no spelled word goes over its start."""
    if not bounds:
        return np.zeros((0, len(units.kernel.marks)), np.float32)
    at, first = np.array(words), np.array(bounds)
    out = np.maximum.reduceat(units.table()[at], first, axis=0)
    steps = np.diff(np.concatenate([[0], np.array(units.single)[at].astype(np.int8), [0]]))
    begin, end = np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)
    long = end - begin >= SPELLED
    if long.any():
        spelled = ["".join(units.letters[k] for k in words[a:b]) for a, b in zip(begin[long].tolist(), end[long].tolist())]
        np.maximum.at(out, np.searchsorted(first, begin[long], "right") - 1, units.kernel.of(spelled))
    return out


@dataclass
class Model:
    """Landmarks, their inverse root, the machine over Nyström features, and the curve over its decisions."""

    prior: float
    marks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # inverse root times machine
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decisions(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias

    def score(self, texts: list[str], units: Units | None = None) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(texts), self.prior)
        return _squashed(_summed(texts, units or Units(self.marks), self.decisions) @ self.curve)


def _squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(texts: Iterable[str], units: Units, decisions) -> np.ndarray:
    """What the curve reads of each text: one, greatest decision, sentences that lean to the toxic side and their share, number of sentences."""
    rows: list[tuple[float, ...]] = []
    top, leaning, n = -3.0, 0.0, 0
    for pooled, counts in described(texts, units):
        values = decisions(pooled)
        at = 0
        for c in counts.tolist():
            part = values[at : at + abs(c)]
            at += abs(c)
            if len(part):
                top, leaning, n = max(top, float(part.max())), leaning + float(np.clip(part - LEAN, 0, 1).sum()), n + len(part)
            if c >= 0:
                rows.append((1.0, min(top, 2.0), np.log1p(10 * leaning), 10 * leaning / max(n, 1), np.log1p(n)))
                top, leaning, n = -3.0, 0.0, 0
    return np.array(rows).reshape(-1, 5)


def landmarks(texts: list[str], toxic: np.ndarray, n_toxic: int, n_clean: int) -> list[str]:
    """Word beginnings that tell toxic texts not told yet at the greatest difference of shares, then frequent clean units."""
    low, high = MARK_LETTERS
    holds: dict[str, list[int]] = defaultdict(list)
    clean: Counter[str] = Counter()
    halves: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    frequent: Counter[str] = Counter()
    for k, text in enumerate(texts):
        units = {unit_of(w) for w in text.lower().split()}
        starts = {u[:n] for u in units for n in range(low, high + 1) if len(u) >= n}
        if toxic[k]:
            for s in starts:
                holds[s].append(k)
        else:
            clean.update(starts)
            halves[k % 2].update(starts)
            frequent.update(u for u in units if low <= len(u) <= high)
    size = Counter((int(t), k % 2) for k, t in enumerate(toxic))
    n1, n0 = max(1, size[1, 0] + size[1, 1]), max(1, size[0, 0] + size[0, 1])

    def holds_up(s: str) -> bool:
        """In both halves of the texts the string is several times as usual in toxic ones, so that chance does not choose it."""
        odd = sum(k % 2 for k in holds[s])
        return all(h / max(1, size[1, part]) > TIMES * (halves[part][s] + 1) / max(1, size[0, part]) for part, h in ((0, len(holds[s]) - odd), (1, odd)))

    told: set[int] = set()
    out: list[str] = []
    ranked = {s: len(h) / n1 - clean[s] / n0 for s, h in holds.items() if len(h) > 2 and holds_up(s)}
    least = max(2 / n1, 0.02)
    while ranked and len(out) < n_toxic:
        best = max(ranked, key=lambda s: (ranked[s], len(s), s))
        if ranked[best] <= least:
            if not told:
                break
            told = set()  # every text is told: tell them once more by other strings
            ranked = {s: len(holds[s]) / n1 - clean[s] / n0 for s in ranked if s not in out and not any(s.startswith(m) or m.startswith(s) for m in out)}
            ranked = {s: v for s, v in ranked.items() if v > least}
            continue
        out.append(best)
        told.update(holds[best])
        ranked = {s: sum(k not in told for k in holds[s]) / n1 - clean[s] / n0 for s in ranked if s != best}
    return out + [u for u, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0])) if u not in out][:n_clean]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps over its support vectors; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(30):
        inside = y * (x @ w) < 1
        support = x[inside] * cost[inside, None]
        new = np.linalg.solve(support.T @ x[inside] + keep, support.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)]) * weight.sum() / len(weight)
    for _ in range(50):
        p = _squashed(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 3.0 / max(size, 1e-9))
        if size < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray, counts: tuple[int, int], n_toxic: int = 24, n_clean: int = 8, rounds: int = 4) -> Model:
    """The model of labelled texts; `counts` are the numbers of clean and toxic rows they stand for."""
    toxic = np.asarray(toxic, float)
    model = Model((counts[1] + 1) / (sum(counts) + 2))
    if not len(toxic) or toxic.min() == toxic.max():
        return model
    marks = landmarks(texts, toxic, n_toxic, n_clean)
    if not marks:
        return model
    units = Units(marks)
    values, vectors = np.linalg.eigh(units.kernel.among)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    parts = list(described(texts, units))
    x = np.concatenate([p for p, _ in parts]).astype(float) @ root
    owner = []
    k = 0
    for _, c in parts:
        for n in c.tolist():
            owner += [k] * abs(n)
            k += n >= 0
    owner = np.array(owner)
    bad = toxic[owner] == 1
    chosen = bad.copy()
    for _ in range(rounds):
        used = chosen | ~bad
        y = np.where(chosen, 1.0, -1.0)[used]
        w = _machine(x[used], y, np.where(y > 0, np.sqrt((y < 0).sum() / max(1, (y > 0).sum())), 1.0) / len(y))
        decision = x @ w[:-1] + w[-1]
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, decision)
        chosen = bad & ((decision > 0) | (decision == top[owner]))
    model.marks = marks
    model.weights, model.bias = root @ w[:-1], float(w[-1])
    per_text = _summed(texts, units, model.decisions)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    model.curve = _curve(per_text, toxic, np.where(toxic == 1, counts[1] / n1, counts[0] / n0))
    return model


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 1_500, fit_chars: int = 100_000) -> Model:
    """Fit on labelled texts outside the held-out fold, at most `max_rows` of each label and none above `fit_chars` characters."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("key").isNotNull()).where(~held_out("key"))
    counts = {r["label"]: r["n"] for r in known.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).toLocalIterator()}
    short = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= fit_chars)
    texts: list[str] = []
    toxic: list[int] = []
    for value in (0, 1):
        first = known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(2 * max_rows)
        rows = short.join(F.broadcast(first.select("key")), "key").orderBy(F.xxhash64("key"), "key", "text").limit(max_rows).select("text").toArrow()
        texts += rows.column("text").to_pylist()
        toxic += [value] * len(rows)
    return fit(texts, np.array(toxic), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 1_500) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        units = Units(model.marks) if model.marks else None
        for b in batches:
            for at, piece in slices(strings(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(piece)), pa.array(model.score(piece.to_pylist(), units), pa.float64())], names=[key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
