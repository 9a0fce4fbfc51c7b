"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition makes a run: its texts' digests in order, each with the
smallest id and the number of its rows. The rows are a written table that can be
read back in any splits, so a partition's run can come in pieces; they are merged
first. Runs then meet in rounds. A run sits in a slot, a number of a few octal
digits that starts as its partition's number; there are as many digits, and
rounds, as the number of partitions asks for. In
round ``r`` digit ``r`` of the slot gives way to digit ``r`` of the digest, so
eight slots that differ in that digit alone exchange parts of their runs. Runs
travel as sorted chunks. A slot takes its chunks by their first digest and
merges the up to eight runs that they belong to, holding no more of each than a
chunk or two. After the last round a slot is a range of digests and its run is
final. Nobody ever holds more than its share of the distinct digests of eight
runs, and a text that fills a third of the corpus is one entry in each run.

The results go back the way they came: each entry of a run takes the smallest
id and the count of the entry it was merged into, round by round, down to the
rows of its own partition. No key on that way has more than eight entries (or
the rows of one partition), so there is no hot key.

An entry is verified by the length in bytes and a second, independent 64-bit
hash of its text: its key is all three, and only entries of equal keys merge.

Cases: null counts as the empty text; null ids come after all others as
keepers, so a group of them alone keeps null; repeated ids are separate rows,
of which each counts and all with the smallest id are kept; an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, cut, small_batches

#: Bytes of a key: a SHA-256 digest, the text's length and its second hash.
KEY = 48
#: Entries of a chunk.
CHUNK = 4096
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).max

_CHUNK = "slot int, met int, first binary, keys binary, low binary, n binary"
_ENTRY = "slot int, met int, key binary, low long, n long"
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space. The pattern passes over single spaces, which stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _key(text: str) -> Column:
    number = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.unhex(F.sha2(text, 256)), number(F.octet_length(text).cast("long")), number(F.xxhash64(text)))


def _met(slot: int, keys: np.ndarray, digit: int | None) -> np.ndarray:
    """The slot of each key in which it meets others: ``digit`` of its own slot comes from the digest."""
    if digit is None:
        return np.full(len(keys), slot, np.int64)
    own = keys.view(np.uint8).reshape(-1, KEY)[:, digit].astype(np.int64) & 7
    return slot + (own - (slot >> 3 * digit & 7)) * 8**digit


def _chunks(slot: int, entries: Entries, digit: int | None) -> Iterator[pa.RecordBatch]:
    """Sorted entries of one slot as chunks, for each slot that they go to."""
    keys, low, n = entries
    met = _met(slot, keys, digit)
    rows: list[tuple] = []
    for to in np.unique(met):
        own = np.flatnonzero(met == to)
        for a in range(0, len(own), CHUNK):
            some = own[a : a + CHUNK]
            raw = keys[some].tobytes()
            rows.append((slot, int(to), raw[:KEY], raw, low[some].tobytes(), n[some].tobytes()))
    if rows:
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slot", "met", "first", "keys", "low", "n"])


def _merged(parts: list[Entries]) -> Entries:
    """Sorted parts merged into one; of equal keys one entry stays, with the smallest id and all rows."""
    keys, low, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")  # finds the runs that it is given
    keys, low, n = keys[order], low[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.minimum.reduceat(low, first) if len(first) else low, np.add.reduceat(n, first) if len(first) else n


def _runs(digit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``slot, key, doc_id``, sorted, to the first runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, rest = None, None
        for batch in batches:
            if not len(batch):
                continue
            slots = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"S{KEY}")
            low = batch.column(2).fill_null(NO_ID).to_numpy()
            edges = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = (keys[a:b], low[a:b], np.ones(b - a, np.int64))
                if rest is not None and slot != slots[a]:
                    yield from _chunks(slot, rest, digit)
                    rest = None
                slot = int(slots[a])
                merged = _merged([rest, own] if rest is not None else [own])
                # the last entry may go on in the next batch
                yield from _chunks(slot, tuple(x[:-1] for x in merged), digit)
                rest = tuple(x[-1:] for x in merged)
        if rest is not None:
            yield from _chunks(slot, rest, digit)

    return run


def _merge(digit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks, sorted by slot and first key, to the merged run of each slot, in chunks for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, open_parts = None, []

        def below(key: bytes | None) -> Iterator[pa.RecordBatch]:
            """What no later chunk can add to: entries below its first key, or all."""
            nonlocal open_parts
            cuts = [len(p[0]) if key is None else int(np.searchsorted(p[0], np.array([key], f"S{KEY}"))[0]) for p in open_parts]
            ready = [tuple(x[:c] for x in p) for p, c in zip(open_parts, cuts, strict=True) if c]
            open_parts = [tuple(x[c:] for x in p) for p, c in zip(open_parts, cuts, strict=True) if c < len(p[0])]
            if ready:
                yield from _chunks(slot, _merged(ready), digit)

        for batch in batches:
            for to, first, keys, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != slot:
                    yield from below(None)
                    slot = to
                else:
                    yield from below(first)
                open_parts.append((np.frombuffer(keys, f"S{KEY}"), np.frombuffer(low, np.int64), np.frombuffer(n, np.int64)))
        yield from below(None)

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to their entries."""
    for batch in batches:
        for slot, met, _, keys, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m, low = len(keys) // KEY, np.frombuffer(low, np.int64)
            key = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * KEY).astype(np.int32)), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays([pa.array([slot] * m, pa.int32()), pa.array([met] * m, pa.int32()), key, pa.array(low, mask=low == NO_ID), pa.array(np.frombuffer(n, np.int64))], names=["slot", "met", "key", "low", "n"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    small_batches(spark)
    text = normalised(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    with Cuts(spark) as hold:
        rows = hold(rows.select("doc_id", _key("text").alias("key"), F.spark_partition_id().alias("slot")))
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.max("slot")).head()[0] or 0) + 1)
        digits = 1
        while 8**digits < partitions:
            digits += 1
        # without a shuffle: each split sorts its own rows; the pieces of a slot stay in it
        pieces = hold(rows.select("slot", "key", "doc_id").sortWithinPartitions("slot", "key").mapInArrow(_runs(None), _CHUNK))
        runs = [pieces]
        for digit in [*range(digits), None]:
            dealt = runs[-1].select(F.col("met").alias("slot"), "first", "keys", "low", "n").repartition("slot").sortWithinPartitions("slot", "first")
            runs.append(hold(dealt.mapInArrow(_merge(digit), _CHUNK)))
        hold.drop(pieces)
        final = runs.pop().mapInArrow(_entries, _ENTRY).select("slot", "key", "low", "n")
        for chunks in reversed(runs[1:]):  # of which each has a key once in a slot
            own = chunks.mapInArrow(_entries, _ENTRY).select("slot", "met", "key")
            final = own.join(final.withColumnRenamed("slot", "met"), ["met", "key"]).select("slot", "key", "low", "n")
        final = hold(final)
        out = rows.join(final, ["slot", "key"])
        return cut(
            out.select(
                "doc_id",
                F.col("low").alias("keep_id"),
                F.col("n").alias("group_size"),
                F.col("doc_id").eqNullSafe(F.col("low")).alias("kept"),
                F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
            )
        )
