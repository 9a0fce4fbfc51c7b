"""Benchmark decontamination by a prefix-filtered containment join.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
all characters beyond ASCII. Each benchmark item gives windows of
``window`` consecutive words; an item of fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit.

A window is a set of word shingles (five words, or the whole window if that is
shorter) at known places. As all of them must occur, one necessary prefix
token is enough to find each occurrence: the window's rarest shingle, by its
count over all documents. Document shingles join on these tokens; a match at
document word ``g`` for a token at place ``j`` can only be a window that starts
at ``g - j`` (positional bound) and must fit in the document (length bound).
What is left is compared word by word over the whole window.

The benchmark is split by hash into blocks of at most about ``block_bytes``
of text; each block is sent to the executors and scanned against all
documents, one block after another in the same pass. So no block outgrows its
bound, no document text is shuffled, and memory is that of a block.

Cases: null and empty texts have no words and are never contaminated; a null
item id counts as the string ``null``; repeated items count once; repeated
documents are separate rows; an empty benchmark contaminates nothing. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, small_batches, text_bytes

SHINGLE = 5
WINDOW = 10
#: Bytes of text that are hashed together; bounds a worker's arrays.
PIECE = 1 << 20

#: Lower-cased byte of a word character, 0 for all others.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


class Words:
    """Words of several texts: folded bytes, bounds, 64-bit hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.bytes = _FOLD[data[offsets[0] : offsets[-1]]]
        at = offsets - offsets[0]
        n = len(self.bytes)
        inside = self.bytes != 0
        edge = np.zeros(n + 1, bool)
        edge[at] = True  # a text's end ends its last word
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = _power(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes * up[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        h ^= h >> np.uint64(29)
        self.hashes = h * _STEP
        self.first = np.searchsorted(self.starts, at)

    def shingles(self, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words, also of those that cross texts."""
        n = max(0, len(self.hashes) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * _STEP + self.hashes[k : k + n]
        return h ^ (h >> np.uint64(31))

    def joined(self, start: int, size: int) -> bytes:
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.starts[start : start + size], self.ends[start : start + size], strict=True))


def _words_of(texts: list[str]) -> Words:
    return Words(*text_bytes(pa.array(texts, pa.string())))


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets, PIECE):
        yield a, b, Words(data, offsets[a : b + 1])


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``item, words, n``: the windows of all items, words joined by a space."""
    small_batches(items.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, w in _pieces(batch.column(1)):
                for k in range(a, b):
                    lo, hi = w.first[k - a], w.first[k - a + 1]
                    size = min(window, hi - lo)
                    if size:
                        rows = [w.joined(s, size).decode() for s in range(lo, hi - size + 1)]
                        yield pa.RecordBatch.from_pydict({"item": [names[k]] * len(rows), "words": rows, "n": pa.array([size] * len(rows), pa.int32())})

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))
    return named.mapInArrow(cut_up, "item string, words string, n int").distinct()


class _Index:
    """One block of windows, as arrays: prefix tokens in order, and their windows."""

    def __init__(self, found: pd.DataFrame):
        grouped = found.groupby("words", sort=True)["item"].agg(lambda x: sorted(set(x)))
        self.texts, self.items = [x.encode() for x in grouped.index], list(grouped)
        w = _words_of([x.decode() for x in self.texts])
        self.first, self.sizes = w.first[:-1], np.diff(w.first)
        self.shingle_size = np.minimum(self.sizes, SHINGLE)
        self.places = self.sizes - self.shingle_size + 1  # of shingles in a window
        self.owner = np.repeat(np.arange(len(self.sizes)), self.places)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.places) - self.places, self.places)
        self.tokens = np.zeros(len(self.owner), np.uint64)
        for k in np.unique(self.shingle_size):
            own = self.shingle_size[self.owner] == k
            self.tokens[own] = w.shingles(int(k))[self.first[self.owner[own]] + self.place[own]]
        self.token_size = self.shingle_size[self.owner]

    def keys(self, size: int) -> np.ndarray:
        return np.unique(self.tokens[self.token_size == size])

    def choose(self, counts: dict[int, int]) -> None:
        """Keep each window's rarest token."""
        rarity = np.array([counts.get(int(t), 0) for t in self.tokens.view(np.int64)], np.int64)
        order = np.lexsort((self.tokens, rarity, self.owner))
        best = order[np.unique(self.owner[order], return_index=True)[1]]
        self.prefix = {}
        for k in np.unique(self.token_size):
            own = best[self.token_size[best] == k]
            own = own[np.argsort(self.tokens[own], kind="stable")]
            keys, at = np.unique(self.tokens[own], return_index=True)
            self.prefix[int(k)] = (_Set(keys), np.append(at, len(own)), self.owner[own], self.place[own])
        del self.tokens, self.owner, self.place, self.token_size


class _Set:
    """Sorted 64-bit keys behind a bitmap of their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(12, min(22, int(len(keys)).bit_length() + 4)))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that are keys, and which keys they are."""
        at = np.flatnonzero(self.map[values >> self.shift])
        k = np.searchsorted(self.keys, values[at])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == values[at]
        return at[real], k[real]


def _counts(docs: DataFrame, index: _Index) -> dict[int, int]:
    """How often each shingle of a block occurs in all documents."""
    sets = {int(k): _Set(index.keys(int(k))) for k in np.unique(index.token_size)}
    shared = docs.sparkSession.sparkContext.broadcast(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(s.keys), np.int64) for k, s in shared.value.items()}
        for batch in batches:
            for _, _, w in _pieces(batch.column(0)):
                for size, s in shared.value.items():
                    sums[size] += np.bincount(s.find(w.shingles(size))[1], minlength=len(s.keys))
        for size, s in shared.value.items():
            own = sums[size] > 0
            yield pa.RecordBatch.from_pydict({"token": s.keys[own].view(np.int64), "n": sums[size][own]})

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict(rows.toPandas().itertuples(index=False))


_STATE = "doc_id long, text string, n_words long, hit array<int>, items array<string>"


def _scan(docs: DataFrame, index: _Index) -> DataFrame:
    """Add one block's hit words and items to those found so far."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            hits, items, n_words = batch.column(3).to_pylist(), [set(x) for x in batch.column(4).to_pylist()], np.zeros(len(batch), np.int64)
            for a, b, w in _pieces(batch.column(1)):
                n_words[a:b] = np.diff(w.first)
                for size, (keys, at, owner, place) in index.prefix.items():
                    where, key = keys.find(w.shingles(size))
                    many = at[key + 1] - at[key]
                    flat = np.repeat(at[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    window, start = owner[flat], np.repeat(where, many) - place[flat]
                    doc = np.searchsorted(w.first, np.repeat(where, many), "right") - 1
                    fits = (start >= w.first[doc]) & (start + index.sizes[window] <= w.first[doc + 1])
                    for s, x, d in zip(start[fits], window[fits], doc[fits], strict=True):
                        if w.joined(s, index.sizes[x]) == index.texts[x]:
                            row = a + d
                            own = s - w.first[d]
                            hits[row].append((int(own), int(own + index.sizes[x])))
                            items[row].update(index.items[x])
            flat_hits = [_union(h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words), pa.array(flat_hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "hit", "items"],
            )

    return docs.mapInArrow(scan, _STATE)


def _union(hit: list) -> list[int]:
    """Places of all hit words; what earlier blocks found comes as places, new finds as ranges."""
    if not hit:
        return []
    places = {x for x in hit if isinstance(x, int)}
    for x in hit:
        if not isinstance(x, int):
            places.update(range(*x))
    return sorted(places)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items, hit, contaminated``.

    ``hit`` lists the places of the hit words, ``items`` the ids (as strings,
    sorted) of items with windows that occur.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = cut(benchmark_windows(items, window, item_col, item_text_col))
    size = windows.agg(F.sum(F.length("words") + F.length("item"))).head()[0] or 0
    n = -(-size // block_bytes)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    state = own.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))
    for k in range(max(1, n)):
        block = windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(max(1, n))) == k).toPandas()
        index = _Index(block)
        index.choose(_counts(own, index))
        state = _scan(state, index)
    return state.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit", (F.size("hit") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    """Digest of item ids, as the result's ``items_sha256`` has it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
