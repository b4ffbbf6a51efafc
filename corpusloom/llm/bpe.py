"""Encoding of the whole corpus with a public byte-level BPE vocabulary (P6).

Method: the distinct unknown words of an Arrow batch are encoded together as padded integer matrices, one per length
bucket; in each round every row merges its leftmost pair of least rank, pairs are looked up in an open-addressing
hash table, and rows are compacted; finished rows leave the matrix. Known words come from a table that a Python worker keeps between
batches, so the matrices see each word once. A document's ids are gathered from that table by one fancy index.

No shuffle: the scan's partitions stream through ``mapInArrow``. The broadcast is the vocabulary file, whose size is
fixed (about 50,000 entries).
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import TOKENIZERS

#: Fixed value: the splitting pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single blank between visible characters: no match of PATTERN spans it, so the parts can be encoded apart.
_PART = re.compile(r"(?<=\S) (?=\S)")
#: Longer words would make wide matrices; they are merged with a heap instead.
WIDEST = 256
#: Rank of a pair that does not merge.
_NONE = 1 << 30
#: Words kept by a worker before its table is started anew.
KEPT = 300_000


def vocabulary(path: str) -> list[bytes]:
    """The tokens by rank of a ``.tiktoken`` file."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return [t for _, t in sorted((int(r), base64.b64decode(t)) for t, r in pairs)]


class _Pairs:
    """Hash table from a pair of ids to the id of its merge, in numpy: linear probing, load below a quarter."""

    def __init__(self, tokens: Sequence[bytes]) -> None:
        rank = {t: i for i, t in enumerate(tokens)}
        keys, vals = [], []
        for t, i in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 17 | b)
                    vals.append(i)
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.vals = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        key, val = np.array(keys, np.int64), np.array(vals, np.int32)
        slot = self.slot(key)
        self.probes = 1
        while len(key):
            free = self.keys[slot] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True  # of several keys for one slot the first
            put = free & first
            self.keys[slot[put]], self.vals[slot[put]] = key[put], val[put]
            key, val, slot = key[~put], val[~put], (slot[~put] + 1) & (size - 1)
            self.probes += bool(len(key))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges, a large number where there is none."""
        key = left.astype(np.int64) << 17 | right
        slot = self.slot(key)
        out = np.full(key.shape, _NONE, np.int32)
        got = self.keys[slot]
        hit = got == key
        out[hit] = self.vals[slot[hit]]
        todo = np.nonzero(~hit & (got != -1))
        while len(todo[0]):
            s = (slot[todo] + 1) & (len(self.keys) - 1)
            slot[todo] = s
            got, k = self.keys[s], key[todo]
            hit = got == k
            out[tuple(x[hit] for x in todo)] = self.vals[s[hit]]
            go = ~hit & (got != -1)
            todo = tuple(x[go] for x in todo)
        return out


class Encoder:
    """Encodes texts with one vocabulary; keeps the ids of known words."""

    def __init__(self, tokens: Sequence[bytes]) -> None:
        import regex

        self.tokens = tokens
        self.find = regex.compile(PATTERN).findall
        self.byte_id = np.zeros(256, np.int32)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.byte_id[t[0]] = i
        self.pairs, self.rank = _Pairs(tokens), {t: i for i, t in enumerate(tokens)}
        self.reset()

    def reset(self) -> None:
        self.word: dict[str, int] = {}  # a word of the pattern: its place in ids
        self.part: dict[str, int] = {}  # text between single blanks: its place in ids
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.count = 0

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Appends the sequences that lie one after another in ids; returns their places."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
        places = np.arange(self.count, self.count + len(lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[places], self.n[places] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.count = self.used + len(ids), self.count + len(lengths)
        return places

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the sequences at places one after another, and their lengths."""
        n = self.n[places]
        ends = np.cumsum(n)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[places] - ends + n, n)
        return self.flat[index], n

    def _merge(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: padded byte ids. Merges each row's leftmost pair of least rank until no row has one."""
        done, lengths = np.zeros_like(rows), n.copy()
        live = np.arange(len(rows))
        while len(live):
            each, columns = np.arange(len(live)), np.arange(rows.shape[1])
            rank = self.pairs(rows[:, :-1], rows[:, 1:])
            rank[columns[None, :-1] >= (n - 1)[:, None]] = _NONE
            where = rank.argmin(1)
            best = rank[each, where]
            over = best == _NONE
            if over.any():
                done[live[over], : rows.shape[1]], lengths[live[over]] = rows[over], n[over]
                live, rows, n, where, best = (x[~over] for x in (live, rows, n, where, best))
                each = each[: len(live)]
            if len(live):
                rows = np.where(columns[None, :] > where[:, None], np.concatenate([rows[:, 1:], rows[:, -1:]], 1), rows)
                rows[each, where] = best
                n = n - 1
                rows = rows[:, : max(2, int(n.max()))]  # compaction: no wider than the longest row
        return done, lengths

    def _one(self, data: bytes) -> list[int]:
        """A very long word: pairs in a heap by (rank, place), neighbours in linked lists."""
        ids: list[int] = [int(self.byte_id[b]) for b in data]
        parts = [bytes([b]) for b in data]
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < n and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], ids[i], alive[j] = a + b, r, False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t, ok in zip(ids, alive) if ok]

    def _learn_words(self, words: list[str]) -> None:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        low = 0
        for high in (4, 8, 16, 32, 64, 128, WIDEST):
            pick = np.nonzero((size > low) & (size <= high))[0]
            low = high
            for pick in np.array_split(pick, max(1, len(pick) * high // (1 << 20))) if len(pick) else ():
                n = size[pick]
                rows = np.zeros((len(pick), int(n.max())), np.int32)
                rows[np.arange(rows.shape[1])[None, :] < n[:, None]] = self.byte_id[np.frombuffer(b"".join(data[i] for i in pick), np.uint8)]
                if rows.shape[1] > 1:
                    rows, n = self._merge(rows, n)
                places = self._store(rows[np.arange(rows.shape[1])[None, :] < n[:, None]], n)
                self.word.update(zip((words[i] for i in pick), places.tolist()))
        for i in np.nonzero(size > WIDEST)[0]:
            ids = self._one(data[i])
            self.word[words[i]] = int(self._store(np.array(ids, np.int32), np.array([len(ids)]))[0])

    def _learn_parts(self, parts: list[str]) -> None:
        split = [self.find(p[1:] if p[0] == " " else " " + p) for p in parts]
        if new := list(dict.fromkeys(w for ws in split for w in ws if w not in self.word)):
            self._learn_words(new)
        places = np.fromiter((self.word[w] for ws in split for w in ws), np.int64)
        ids, n = self._gather(places)
        ends = np.concatenate([[0], np.cumsum(n)])
        words = np.cumsum([0, *map(len, split)])
        self.part.update(zip(parts, self._store(ids, np.diff(ends[words])).tolist()))

    def _parts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Parts between single blanks. A part stands for itself behind a blank, which it never starts with; the
        first part of a text has no blank before it and is marked by one."""
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                plain = t[0] != " " and t[-1] != " " and "  " not in t and " \n" not in t and "\n " not in t and t.replace("\n", "").isprintable()
                p = t.split(" ") if plain else _PART.split(t)  # isprintable: there is no other white space
                p[0] = " " + p[0]
                counts[k] = len(p)
                parts += p
        return parts, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text); null and empty texts have none."""
        if self.count > 2 * KEPT:
            self.reset()
        parts, counts = self._parts(texts)
        known = self.part
        if new := list({p: None for p in parts if p not in known}):
            self._learn_parts(new)
        ids, n = self._gather(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
        return ids, self._per_text(n, counts)

    def count_ids(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids per text, without gathering them."""
        if self.count > 2 * KEPT:
            self.reset()
        parts, counts = self._parts(texts)
        known = self.part
        if new := list({p: None for p in parts if p not in known}):
            self._learn_parts(new)
        return self._per_text(self.n[np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))], counts)

    @staticmethod
    def _per_text(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(n)])
        return np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


_KEPT: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; kept while the worker lives."""
    tokens = shared.value
    key = hash((len(tokens), tokens[-1], tokens[len(tokens) // 2]))
    if key not in _KEPT or _KEPT[key].tokens != tokens:
        _KEPT.clear()
        _KEPT[key] = Encoder(tokens)
    return _KEPT[key]


def share_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """Broadcast of a vocabulary; bounded by the file, which does not grow with the data."""
    return spark.sparkContext.broadcast(tuple(vocabulary(f"{folder}/{name}.tiktoken")))


#: Characters of text that are encoded together.
_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, column: str = "text", most: int = _CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that a batch of very long texts needs no more memory."""
    col = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row: ordinary ids only, strings that look like special tokens are plain text.

    Null and empty texts give an empty list; any other text, blank ones included, is encoded whole. One row comes out per
    row; ``key`` is taken to be unique, so repeated rows come out repeated. An empty table gives an empty result.
    """
    shared = share_vocabulary(docs.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for whole in batches:
            for b in slices(whole):
                ids, n = enc.encode(b.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], ["key", "ids"])

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")
