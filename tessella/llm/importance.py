"""Importance resampling of documents to a target distribution.

Features of a text are all runs of one and two of its words (lower-cased A-Z,
cut at all ASCII characters but letters and digits), repeats included; each
falls into a bucket by the CRC-32 of its bytes. Bucket counts over all documents
and over all target texts give each bucket a gain, the floored log ratio of its
smoothed shares; a document's weight is the floored mean of its features' gains.
A draw by the hash of its id, Gumbel distributed, is added, so that the highest
scores are a sample without replacement in which weights count.

Counting and scoring are arrays: workers find the words of many texts at once
and run the CRC over all words of a piece of text side by side, a byte of each at
a time; a pair's CRC goes on from that of its first word. Counts add up in
arrays of ``BUCKETS`` numbers, one for each task.

The ``k`` highest scores are found without sorting: a row's key is its score, its
id and, for equal ones, more numbers, and radix selection finds the exact
``k``-th key digit by digit. Each round counts the next digit of the rows that
still agree with the key so far, and 2 ** ``DIGIT`` counts at most reach the
driver. Only rows up to that key are dealt out in ranges, sorted and ranked.

Cases: null and empty texts have no features and weight 0; documents of fewer
than ``least`` words are never drawn, their rank is null; null ids draw as the
text ``null`` and come after others of their score; repeated rows are separate,
and rows equal in id, score and features are interchangeable; an empty table
gives no rows, an empty target the gains of its smoothing. Extra columns are
not read. Scores are far from the bounds of a long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Running, scan
from .common import cut, small_batches, text_bytes

BUCKETS, SEED = 10_000, 7
#: Words that a document must have, and the share of such documents that is drawn, in percent.
LEAST, PERCENT = 20, 25
#: Bits of a key that a round of the selection decides.
DIGIT = 12
#: Bytes of text whose words are hashed side by side, and bytes of a word beyond which it is hashed alone.
PIECE, LONG = 1 << 20, 64

#: Lower-cased byte of a word character, 0 for all others.
_LOWER = np.array([b + 32 * chr(b).isupper() if b > 127 or chr(b).isalnum() else 0 for b in range(128)] + [*range(128, 256)], np.uint8)
_ALL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """What each low byte of a CRC register makes of it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_on(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers (the CRC with all bits flipped) after the bytes from each start to its end."""
    size = ends - starts
    order = np.argsort((LONG + 1 - np.minimum(size, LONG + 1)).astype(np.uint8), kind="stable")  # longer ones first
    r, at, size = register[order], starts[order], size[order]
    alone = np.count_nonzero(size > LONG)
    for i in range(alone):
        r[i] = np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(r[i] ^ _ALL))) ^ _ALL
    longer = len(size) - np.cumsum(np.bincount(size[alone:], minlength=LONG + 1))  # words of more than j bytes
    for j in range(int(size[alone]) if alone < len(size) else 0):
        own = slice(alone, longer[j])
        r[own] = _CRC[(r[own] ^ data[at[own] + j]) & np.uint32(255)] ^ (r[own] >> np.uint32(8))
    out = np.empty_like(r)
    out[order] = r
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end between words, also inside long texts."""
    a, end = int(offsets[0]), int(offsets[-1])
    while a < end:
        b = min(end, a + PIECE)
        text_end = int(offsets[np.searchsorted(offsets, b)])
        while b < text_end:
            gap = np.flatnonzero(_LOWER[data[b : min(b + 4096, text_end)]] == 0)
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + 4096, text_end)
        yield a, b
        a = b


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a batch: the row and bucket of each word, and of each pair of words."""
    data, offsets = text_bytes(column)
    last_row, last = -1, np.uint32(0)
    for a, b in _pieces(data, offsets):
        own = _LOWER[data[a:b]]
        inside = own != 0
        edge = np.zeros(len(own) + 1, bool)
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        edge[cuts], edge[0], edge[-1] = True, True, True
        before, after = np.zeros(len(own), bool), np.zeros(len(own), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if not len(starts):
            continue
        row = np.searchsorted(offsets, starts + a, "right") - 1
        words = crc_on(np.full(len(starts), _ALL), own, starts, ends)
        first, first_row = np.concatenate([[last], words[:-1]]), np.concatenate([[last_row], row[:-1]])
        paired = first_row == row
        space = _CRC[(first[paired] ^ np.uint32(0x20)) & np.uint32(255)] ^ (first[paired] >> np.uint32(8))
        pairs = crc_on(space, own, starts[paired], ends[paired])
        yield row, (words ^ _ALL) % BUCKETS, row[paired], (pairs ^ _ALL) % BUCKETS
        last_row, last = int(row[-1]), words[-1]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, words, _, pairs in features(batch.column(0)):
                seen += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(seen[some], pa.int64())})

    sums = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of each bucket's smoothed shares in target and source."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.array([math.log(x) for x in ratio])).astype(np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The draw of an id, thousandfold and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id, n_words, n_features, weight, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for row, word, pair_row, pair in features(batch.column(1)):
                words += np.bincount(row, minlength=n)
                n_features += np.bincount(row, minlength=n) + np.bincount(pair_row, minlength=n)
                for own, bucket in ((row, word), (pair_row, pair)):
                    # sums of whole numbers below 2 ** 53 are exact
                    total += np.bincount(own, shared.value[bucket], n).astype(np.int64)
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def radix_kth(rows: DataFrame, key: list[str], k: int, digit: int = DIGIT) -> list[int] | None:
    """The ``k``-th smallest key of rows, as values of the long columns ``key``; null if there are fewer.

    It may be cut short: rows up to its beginning, and with it, are ``k`` then.
    The differences of a column's values must fit a long.
    """
    found: list[int] = []
    left = k
    for name in key:
        rest = rows
        for c, v in zip(key, found, strict=False):
            rest = rest.filter(F.col(c) == v)
        low, high, n = rest.agg(F.min(name), F.max(name), F.count(F.lit(1))).head()
        if n < left or not n:
            return None
        if n == left:
            return found if found else [high]
        while low < high:
            shift = max(0, (high - low).bit_length() - digit)
            at = F.shiftright(F.col(name) - F.lit(low), shift)
            counts = rest.filter(F.col(name).between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()  # 2 ** digit rows at most
            for value, n in sorted((r.at, r.n) for r in counts):
                if n >= left:
                    break
                left -= n
            low, high = low + (value << shift), min(high, low + ((value + 1) << shift) - 1)
            if n == left:
                return [*found, high]  # all rows of this digit
        found.append(low)
    return found


def up_to(key: list[str], bound: list[int]) -> Column:
    """Rows whose key, or its beginning, is ``bound`` or smaller."""
    out = F.lit(True)
    for name, value in list(zip(key, bound, strict=False))[::-1]:
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_features, weight, score, rank``; rank is null for those not drawn."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    table = cut(scored(docs, gain, id_col, text_col, seed).withColumn("row", F.monotonically_increasing_id()))
    low = (1 << 32) - 1
    key = {
        "k0": -F.col("score"),
        "k1": F.col("doc_id").isNull().cast("long"),
        "k2": F.coalesce(F.shiftright("doc_id", 32), F.lit(0).cast("long")),
        "k3": F.coalesce(F.col("doc_id").bitwiseAND(F.lit(low)), F.lit(0).cast("long")),
        "k4": F.col("n_features"),
        "k5": F.col("row"),
    }
    able = table.filter(F.col("n_words") >= least).select("*", *[v.alias(k) for k, v in key.items()])
    names = list(key)
    k = able.count() * percent // 100
    bound = radix_kth(able, names, k) if k else None
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if bound is None:
        return table.select(*columns, none)
    drawn = scan(able.filter(up_to(names, bound)), [F.asc(c) for c in names], {"rank": Running("count")})
    rest = able.filter(~up_to(names, bound)).select(*columns, none).union(table.filter(F.col("n_words") < least).select(*columns, none))
    return rest.union(drawn.select(*columns, "rank"))
