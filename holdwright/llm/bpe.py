"""Byte-level BPE with word ends: propose greedily, verify pairs, merge only what fails.

A split of a word is its BPE encoding exactly when every two neighbouring tokens,
taken alone, encode to themselves. So each new word is cut by greedy longest match,
all neighbouring pairs of all new words are checked together in array lookups, and
only words with a failing pair go through the exact merge loop. Words repeat, so a task keeps what it has encoded; the store is emptied
when it is full, which changes the speed and nothing else.

Null text counts as empty. Empty texts give no ids and an empty decoding. Rows with
equal ids stay separate rows; other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from holdwright.llm.kernels import slices, strings

WORD_END = "</w>"
STORE_WORDS = 300_000
LONG_WORD = 64  # units from which a word is merged alone, over a heap
NO_PAIR = np.uint64(2**64 - 1)
# Fixed value: the word pattern of the vocabulary file's pre-tokenizer.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
GAP = regex.compile(f"[{SPACES}]+")
SEPARATOR_CONTROLS = regex.compile(r"[\x1c-\x1f]")  # str.split() takes these for white space, the pattern does not


def byte_symbols() -> list[str]:
    """Printable character for each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairCheck:
    """Judges many neighbouring pairs at once.

    A token's edge is the chain of pieces that stood at its border while it was
    merged; each piece lasts until the rank that consumed it. Two tokens are
    incompatible when some piece of the left one's right edge and some piece of
    the right one's left edge would have merged with each other before either was
    consumed (on equal ranks the left pair goes first).
    """

    NEVER = np.int64(2**31)

    def __init__(self, merges: list[tuple[int, int, int]], size: int) -> None:
        """merges: (left id, right id, merged id) by rank."""
        keys = np.array([(a << 32) | b for a, b, _ in merges], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([c for *_, c in merges], np.int64)
        made = {c: (a, b, rank) for rank, (a, b, c) in enumerate(merges)}
        self.edges = []
        for side in (1, 0):
            chains = []
            for token in range(size):
                chain, lasts = [token], [int(self.NEVER)]
                while chain[-1] in made:
                    a, b, rank = made[chain[-1]]
                    chain.append((a, b)[side])
                    lasts.append(rank)
                chains.append((chain, lasts))
            depth = max(len(c) for c, _ in chains)
            pieces = np.full((depth, size), -1, np.int64)
            until = np.full((depth, size), -1, np.int64)
            for token, (chain, lasts) in enumerate(chains):
                pieces[: len(chain), token], until[: len(chain), token] = chain, lasts
            self.edges.append((pieces, until))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NEVER where there is no merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found], self.NEVER)

    def good(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair keeps its border."""
        pairs, back = np.unique((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), return_inverse=True)
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        (lp, lu), (rp, ru) = self.edges
        ok = np.ones(len(pairs), bool)
        for i in range(len(lp)):
            for j in range(len(rp)):
                at = np.flatnonzero(ok & (lp[i, left] >= 0) & (rp[j, right] >= 0))
                if not len(at):
                    break
                a, b = left[at], right[at]
                rank = self.rank(lp[i, a], rp[j, b])
                ok[at[(rank < lu[i, a]) & (rank <= ru[j, b]) & (rank < self.NEVER)]] = False
        return ok[back]


class Vocabulary:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.symbols = byte_symbols()
        self.longest = max(map(len, self.ids))
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in self.ranks]
        self.merged = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.pairs = PairCheck(merges, max(self.tokens) + 1)
        self.sound = np.full(max(self.tokens) + 1, -1, np.int8)
        self.store = ChunkStore(self)

    def spelled(self, word: str) -> str:
        """A symbol for each byte; printable ASCII stands for itself."""
        return word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])

    def units(self, word: str) -> list[int]:
        """Smallest pieces of a word: one per byte, the last one marked as word end."""
        text = self.spelled(word)
        return [self.ids[c] for c in text[:-1]] + [self.ids[text[-1] + WORD_END]]

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """Exact encodings of words given as units.

        Short words are merged side by side: in each round every word that still has
        a mergeable pair merges its best-ranked one, the leftmost on ties. Long ones
        are merged one by one, so that their time grows with their length.
        """
        out: list[list[int]] = [self.merge_long(w) if len(w) > LONG_WORD else [] for w in words]
        active = np.array([k for k, w in enumerate(words) if len(w) <= LONG_WORD], np.int64)
        words = [words[k] for k in active.tolist()]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((u for w in words for u in w), np.int64, int(lengths.sum()))
        while len(active):
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rank = np.full(len(flat), self.pairs.NEVER)
            inner = np.ones(len(flat), bool)
            inner[firsts + lengths - 1] = False
            left = np.flatnonzero(inner)
            rank[left] = self.pairs.rank(flat[left], flat[left + 1])
            best = np.minimum.reduceat(rank, firsts)
            done = best == self.pairs.NEVER
            for k in np.flatnonzero(done):
                out[active[k]] = flat[firsts[k] : firsts[k] + lengths[k]].tolist()
            owner = np.repeat(np.arange(len(active)), lengths)
            hits = np.flatnonzero(rank == best[owner])
            hits = hits[~done[owner[hits]]]
            hits = hits[np.unique(owner[hits], return_index=True)[1]]
            flat[hits] = self.pairs.made[rank[hits]]
            keep = ~done[owner]
            keep[hits + 1] = False
            flat, active, lengths = flat[keep], active[~done], lengths[~done] - 1
        return out

    def merge_long(self, units: list[int]) -> list[int]:
        """Exact encoding of one word: pairs wait in a heap by rank and place, units are linked to their neighbours."""
        merges = self.merged
        now, n = list(units), len(units)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, now[k], now[k + 1], found[1]) for k in range(n - 1) if (found := merges.get((now[k], now[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, made = heapq.heappop(heap)
            other = after[k]
            if now[k] != left or other >= n or now[other] != right:
                continue  # one of the two has been merged since
            now[k], now[other] = made, -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
                if found := merges.get((made, now[after[k]])):
                    heapq.heappush(heap, (found[0], k, made, now[after[k]], found[1]))
            if (p := before[k]) >= 0 and (found := merges.get((now[p], made))):
                heapq.heappush(heap, (found[0], p, now[p], made, found[1]))
        return [u for u in now if u >= 0]

    def token_units(self, token: int) -> list[int]:
        text = self.tokens[token]
        if not text.endswith(WORD_END) or text == WORD_END:
            return [self.ids[c] for c in text]
        text = text.removesuffix(WORD_END)
        return [self.ids[c] for c in text[:-1]] + [self.ids[text[-1] + WORD_END]]

    def unsound(self, tokens: np.ndarray) -> np.ndarray:
        """Which of the tokens do not encode to themselves when they stand alone."""
        unknown = tokens[self.sound[tokens] < 0]
        if len(unknown):
            merged = self.merge([self.token_units(t) for t in unknown.tolist()])
            self.sound[unknown] = [m == [t] for m, t in zip(merged, unknown.tolist())]
        return tokens[self.sound[tokens] == 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        text = self.spelled(word)
        out, at, n = [], 0, len(text)
        while at < n:
            if n - at <= self.longest and (whole := self.ids.get(text[at:] + WORD_END)) is not None:
                out.append(whole)
                break
            to = min(n - 1, at + self.longest)
            while to > at and text[at:to] not in self.ids:
                to -= 1
            if to == at:
                raise ValueError(f"no token for {text[at]!r}")
            out.append(self.ids[text[at:to]])
            at = to
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Encoding of each distinct word."""
        proposed = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = owner[1:] == owner[:-1]
        failing = np.zeros(len(words), bool)
        failing[owner[:-1][inner][~self.pairs.good(flat[:-1][inner], flat[1:][inner])]] = True
        failing[owner[np.isin(flat, self.unsound(np.unique(flat)))]] = True
        again = np.flatnonzero(failing).tolist()
        for k, exact in zip(again, self.merge([self.units(words[k]) for k in again])):
            proposed[k] = exact
        return dict(zip(words, proposed))

    def pieces(self, chunk: str) -> list[str]:
        """Words and special tokens of a chunk that holds no white space.

        The word pattern never yields a special token's text, so the two cannot be mixed up.
        """
        out: list[str] = []
        for part in self.cut_special.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(part)
            elif part:
                plain = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                out.extend(PATTERN.findall(plain))
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [[c for c in GAP.split(t) if c] if SEPARATOR_CONTROLS.search(t) else t.split() for t in texts]
        self.store.learn({c for cs in chunks for c in cs})
        return [b"".join(map(self.store.__getitem__, cs)) for cs in chunks]

    def decode_bytes(self, ids: bytes) -> str:
        """The vocabulary has no decoder of its own: tokens stand with a space between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, np.dtype("<u4")).tolist()))


class ChunkStore(dict):
    """Encoded bytes of white-space-free chunks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.words: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Encode all chunks not seen yet, in one go."""
        if len(self) > STORE_WORDS:
            self.clear()
            self.words.clear()
        new = [c for c in chunks if c not in self]
        if not new:
            return
        pieces = [self.vocabulary.pieces(c) for c in new]
        unknown = list({p for ps in pieces for p in ps if p not in self.words})
        special = self.vocabulary.special
        encoded = self.vocabulary.encode_words([w for w in unknown if w not in special])
        for word in unknown:
            ids = [special[word]] if word in special else encoded[word]
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        for chunk, ps in zip(new, pieces):
            self[chunk] = self.words[ps[0]] if len(ps) == 1 else b"".join([self.words[p] for p in ps])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _shipped(name: str) -> Vocabulary:
    return vocabulary(SparkFiles.get(name))


def encode(docs: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text", output: str = "digests") -> DataFrame:
    """Encode every text and decode it again.

    `output="ids"` returns (key, ids array, decoded text); `"digests"` returns
    (key, n_tokens, ids_sha256, decoded_sha256). The file travels with the job.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary_file)
    name = vocabulary_file.rsplit("/", 1)[-1]
    full = output == "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _shipped(name)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, piece in slices(strings(texts)):
                rows = book.encode_texts(piece.to_pylist())
                decoded = [book.decode_bytes(r) for r in rows]
                part = keys.slice(at, len(piece))
                if full:
                    ids = pa.array([np.frombuffer(r, np.dtype("<u4")).astype(np.int32) for r in rows], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part, ids, pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])
                else:
                    columns = [
                        part,
                        pa.array([len(r) // 4 for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in rows]),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>, decoded string" if full else f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, schema)
