"""Runs of repeated word sequences: recompression, and grammar queries on a harmonic grid.

A run with period p holds two neighbouring multiples of p, so the pairs (kp, kp + p) of all
periods, a grid of n ln n pairs, meet every run. A pair whose words and neighbours cannot
belong to a run long enough is left out after a few comparisons. For the others the
texts are compressed into a grammar: block compression names runs of one symbol, pair
compression names neighbours whose first symbol lies in one half of the alphabet and whose second in
the other, in turn until one symbol is left. Both are locally consistent: two equal
stretches are cut alike except at their ends. The longest common extension of two
positions therefore climbs the levels, stepping over at most one block on each, and comes
down again the same way. Extensions to both sides give each run exactly. A pair with a
multiple of the smallest period gives the same stretch, and the smallest one stays.

A run is (start, length, period): period is the smallest one, length >= max(12, 2 * period),
and no neighbouring word goes on with it. Collapsing keeps of every run its first period.

Every text is read whole, in one task, with memory in proportion to its words. Null and
empty texts have no words and no runs. Rows are handled each by itself, so repeated rows
and shared keys give a row each; a null key has the checksum of the empty text and stays null. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdwright.llm.kernels import mix, slices, strings

LEAST_LENGTH = 12
SCREEN = 6  # a pair inside a run agrees in at least six words in a row, itself among them
GRID_STEP = 1 << 15
GROUP_WORDS = 1 << 17
BLOCK, PAIR = 0, 1


@dataclass
class Level:
    """One level of the grammar: symbols, and where each one's first child lies in the level below."""

    symbols: np.ndarray
    first: np.ndarray  # len(symbols) + 1
    kind: int = PAIR

    def flipped(self, below: int) -> Level:
        return Level(self.symbols[::-1], below - self.first[::-1], self.kind)


def _named(a: np.ndarray, b: np.ndarray, fresh: int) -> np.ndarray:
    """Equal pairs get equal new symbols, from `fresh` on."""
    width = int(b.max()) + 1
    return fresh + np.unique(a * width + b, return_inverse=True)[1].astype(np.int64)


def _grouped(symbols: np.ndarray, starts: np.ndarray, second: np.ndarray, several: np.ndarray, fresh: int, kind: int) -> Level:
    """The next level: groups begin at `starts`; those with more than one child are named by (first child, `second`)."""
    out = symbols[starts]
    if several.any():
        out[several] = _named(out[several], second[several], fresh)
    return Level(out, np.append(starts, len(symbols)), kind)


def recompress(symbols: np.ndarray) -> list[Level]:
    """Levels of the grammar, the text first, the start symbol last."""
    levels = [Level(symbols.astype(np.int64), np.zeros(0, np.int64))]
    fresh = int(symbols.max(initial=-1)) + 1
    turn = 0
    while len(now := levels[-1].symbols) > 1:
        starts = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        sizes = np.diff(np.append(starts, len(now)))
        levels.append(_grouped(now, starts, sizes, sizes > 1, fresh, BLOCK))
        fresh = max(fresh, int(levels[-1].symbols.max()) + 1)
        now = levels[-1].symbols
        if len(now) == 1:
            break
        best: np.ndarray | None = None
        for salt in range(4):  # halves of the alphabet by a bit of the symbol; the cut that names most pairs
            left = (mix(now.astype(np.uint64) + np.uint64(0x51ED270B * (4 * turn + salt + 1))) >> np.uint64(63)).astype(bool)
            for side in (left, ~left):
                heads = side[:-1] & ~side[1:]
                if best is None or heads.sum() > best.sum():
                    best = heads
        turn += 1
        if not best.any():
            continue
        inside = np.concatenate([[False], best])  # second symbol of a pair
        starts = np.flatnonzero(~inside)
        several = np.concatenate([best, [False]])[starts]
        levels.append(_grouped(now, starts, now[np.minimum(starts + 1, len(now) - 1)], several, fresh, PAIR))
        fresh = max(fresh, int(levels[-1].symbols.max()) + 1)
    return levels


class Extensions:
    """Longest common extensions to the right, by the levels of a grammar."""

    def __init__(self, levels: list[Level]):
        self.symbols = [np.append(x.symbols, -1) for x in levels]  # past the end: equal to nothing
        self.first = [x.first for x in levels]
        self.kind = [x.kind for x in levels]
        self.up, self.starts = [], []
        for x in levels[1:]:
            begins = np.zeros(x.first[-1] + 1, bool)
            begins[x.first] = True
            self.starts.append(begins)
            self.up.append(np.cumsum(begins) - 1)

    @classmethod
    def to_the_left(cls, levels: list[Level]) -> Extensions:
        return cls([Level(levels[0].symbols[::-1], levels[0].first), *(x.flipped(len(below.symbols)) for below, x in zip(levels, levels[1:]))])

    def _left_in_block(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.first[k + 1][self.up[k][at] + 1] - at

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from positions a and b on, a < b."""
        a, b, start = a.copy(), b.copy(), a
        at_level = np.full(len(a), len(self.symbols) - 1)
        climbing = np.arange(len(a))
        for k in range(len(self.symbols) - 1):
            begins, symbols = self.starts[k], self.symbols[k]
            inside = climbing[~(begins[a[climbing]] & begins[b[climbing]])]
            equal = symbols[a[inside]] == symbols[b[inside]]
            at_level[inside[~equal]] = k
            inside = inside[equal]
            step = np.minimum(self._left_in_block(k, a[inside]), self._left_in_block(k, b[inside]))
            a[inside] += step
            b[inside] += step
            at_level[inside[~(begins[a[inside]] & begins[b[inside]])]] = k  # blocks of unequal length: the next symbols differ
            climbing = climbing[at_level[climbing] > k]
            a[climbing], b[climbing] = self.up[k][a[climbing]], self.up[k][b[climbing]]
        for k in range(len(self.symbols) - 1, 0, -1):
            down = np.flatnonzero(at_level >= k)  # symbols a and b of level k differ
            a[down], b[down] = self.first[k][a[down]], self.first[k][b[down]]
            down = down[self.symbols[k - 1][a[down]] == self.symbols[k - 1][b[down]]]
            step = np.minimum(self._left_in_block(k - 1, a[down]), self._left_in_block(k - 1, b[down])) if self.kind[k] == BLOCK else 1
            a[down] += step
            b[down] += step
        return a - start


def grid(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, kp + p) of all grid pairs with first <= kp + p < last."""
    periods = np.arange(1, last, dtype=np.int64)
    below = (first - 1) // periods if first else np.zeros(len(periods), np.int64)
    count = (last - 1) // periods - below
    p = np.repeat(periods, count)
    nth = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
    return p, (np.repeat(below, count) + nth + 1) * p


_grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grid_of(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid of n words in steps; those of usual texts are made once per worker, ordered by kp + p."""
    size = 1 << max(6, (n - 1).bit_length())
    if size <= GRID_STEP:
        if size not in _grids:
            p, to = grid(0, size)
            order = np.argsort(to, kind="stable")
            _grids[size] = p[order].astype(np.int32), to[order].astype(np.int32)
        p, to = _grids[size]
        end = int(np.searchsorted(to, n))
        yield p[:end], to[:end]
        return
    for first in range(0, n, GRID_STEP):
        yield grid(first, min(n, first + GRID_STEP))


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of the grid pairs that may lie in a run."""
    n = len(words)
    found = []
    for p, to in _grid_of(n):
        keep = words[to - p] == words[to]
        p, to = p[keep].astype(np.int64), to[keep].astype(np.int64)
        keep = 2 * p <= n
        p, to = p[keep], to[keep]
        need = np.maximum(p, LEAST_LENGTH - p)
        after, before = np.ones(len(p), np.int64), np.zeros(len(p), np.int64)
        going, back = np.ones(len(p), bool), np.ones(len(p), bool)
        for step in range(1, SCREEN):
            if not len(p):
                break
            ahead, behind = to + step, to - p - step
            going &= (ahead < n) & (words[np.minimum(ahead, n - 1)] == words[np.minimum(ahead, n - 1) - p])
            back &= (behind >= 0) & (words[np.maximum(behind, 0)] == words[np.maximum(behind, 0) + p])
            after += going
            before += back
            keep = going | back | (after + before >= need)
            p, to, need, after, before, going, back = (x[keep] for x in (p, to, need, after, before, going, back))
        keep = going | back | (after + before >= need)
        found.append((to[keep] - p[keep], p[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(texts: list[np.ndarray], asked: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Runs (start, length, period) of each text, by start and period, from the pairs to ask."""
    lengths = np.array([len(t) for t in texts])
    offset = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.empty(offset[-1], np.int64)
    top = max(int(t.max()) for t in texts) + 1
    for k, t in enumerate(texts):
        joined[offset[k] : offset[k] + len(t)] = t
        joined[offset[k + 1] - 1] = top + k  # a separator of its own ends every text
    levels = recompress(joined)
    at = np.concatenate([offset[k] + i for k, (i, _) in enumerate(asked)])
    p = np.concatenate([p for _, p in asked])
    ahead = Extensions(levels).of(at, at + p)
    size = len(joined)
    back = Extensions.to_the_left(levels).of(size - (at + p), size - at)
    start, end = at - back, at + p + ahead
    keep = end - start >= np.maximum(LEAST_LENGTH, 2 * p)
    start, end, p = start[keep], end[keep], p[keep]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of one stretch the smallest period
    start, end, p = start[fresh], end[fresh], p[fresh]
    order = np.lexsort((p, start))
    rows = np.stack([start, end - start, p], 1)[order]
    return np.split(rows, np.searchsorted(rows[:, 0], offset[1:-1])) if len(texts) > 1 else [rows]


def located(rows: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """Starts counted from each text's own first word."""
    offset = 0
    out = []
    for r, n in zip(rows, lengths):
        out.append(r - np.array([offset, 0, 0]))
        offset += n + 1
    return out


def periodic_tail(words: list[bytes], key: object) -> list[bytes]:
    """The words, or for a tenth of the keys the same number of words with a periodic end."""
    h, n = zlib.crc32(str("" if key is None else key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which words a run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _row(runs: np.ndarray, words: list[bytes], whole: bool) -> tuple:
    if len(runs):
        top = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
        keep = ~dropped(runs, len(words))
        words = [w for w, k in zip(words, keep.tolist()) if k]
        best = (*top, 1000 * top[1] // top[2])
    else:
        best = (None,) * 4
    body = b" ".join(words)
    if whole:
        return (len(runs), *best, [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], body.decode())
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(body).hexdigest()


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", output: str = "runs", planted: bool = False) -> DataFrame:
    """The runs of every text, and the text without their repetitions.

    `output="runs"` returns (key, n_runs, start, length, period, exponent_milli, runs, collapsed), the four of the
    longest run (ties: smallest start, then period; null without a run); "digests" has sha256 strings in place of the last two.
    `planted` gives a tenth of the texts a periodic end first (see `periodic_tail`).
    """
    whole = output == "runs"
    tail = f"runs array<{RUN}>, collapsed string" if whole else "runs_sha256 string, collapsed_sha256 string"
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", *(["runs", "collapsed"] if whole else ["runs_sha256", "collapsed_sha256"])]
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    types = [pa.int64()] * 5 + ([run_type, pa.string()] if whole else [pa.string()] * 2)

    def answered(ids: list, held: list[tuple[list[bytes], np.ndarray, tuple]], kind: pa.DataType) -> pa.RecordBatch:
        asking = [k for k, (_, _, (at, _)) in enumerate(held) if len(at)]
        found: dict[int, np.ndarray] = {}
        group: list[int] = []
        size = 0
        for nth, k in enumerate(asking):
            group.append(k)
            size += len(held[k][1])
            if size >= GROUP_WORDS or nth == len(asking) - 1:
                texts = [held[j][1] for j in group]
                found.update(zip(group, located(runs_of(texts, [held[j][2] for j in group]), [len(t) for t in texts])))
                group, size = [], 0
        none = np.zeros((0, 3), np.int64)
        columns = list(zip(*(_row(found.get(k, none), words, whole) for k, (words, _, _) in enumerate(held))))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for at, piece in slices(strings(b.column(1))):
                held = []
                numbers: dict[bytes, int] = {}
                for k, body in enumerate(piece.cast(pa.large_binary()).to_pylist()):
                    words = body.split()  # bytes are cut at \x20 and \x09-\x0D
                    if planted:
                        words = periodic_tail(words, ids[at + k].as_py())
                    symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    held.append((words, symbols, candidates(symbols)))
                yield answered(ids.slice(at, len(piece)).to_pylist(), held, ids.type)

    return docs.select(key, text).mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, {tail}")
