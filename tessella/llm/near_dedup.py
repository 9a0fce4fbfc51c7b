"""Near-duplicate removal at an exact Jaccard similarity of word shingles.

A text is its set of runs of five words (cut at white space, A-Z lower-cased);
a text of fewer words is one run. Two texts are linked if the Jaccard
similarity of their sets is 0.8 at least; a component is what links reach.

Texts with equal sets are one entry, so copies cost nothing. Candidates come
from two sides. SimHash: entries whose fingerprints over their shingles are
within ``RADIUS`` bits, by the bit-sliced comparison of :mod:`.simhash`. That
is certain of close copies only, as pairs at 0.8 differ in about 9 bits. So
entries that agree in one of 40 bands of 6 minimum hashes are candidates as
well; a pair at 0.8 is missed with a chance of 5e-6, and of less above.

Each entry of a band's bucket is compared with the bucket's smallest one first.
What is in one component after that needs no further comparison; for the rest,
pairs of the bucket are made, so a large group does not make all its pairs and
no link of a bucket is lost. Pairs whose parity bitmaps differ in more bits than
the sets may differ in shingles are dropped where they are made; a bitmap has
about four bits for each shingle, so few pairs below the similarity are left.
The others are verified by their whole sets.

Rows are told apart by id and text, null-safely. Each component keeps one row:
that of the smallest id, a null id after all others, ties by the text's hash.
Rows equal in both are copies. Null and empty texts, and texts of white space
alone, are one entry. Extra columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, among, cut, small_batches
from .simhash import components, links, majority

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
RADIUS = 2
#: Shingles whose minimum hashes are taken together.
PIECE = 1 << 12

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word runs."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    own = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _STEP + own[k : k + len(h)]
    return np.unique((h ^ (h >> np.uint64(32))) * _STEP)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minimum hashes."""
    if not len(found):
        return np.empty(0, np.int64)
    high = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(high), PIECE):
        np.minimum(low, (high[a : a + PIECE] * _TIMES + _PLUS).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(29))) * _STEP + column
    return ((key ^ (key >> np.uint64(32))) * _STEP).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each of 64 bits, 128, 256 and so on, at least four for a hash.

    Halves laid over each other, bit by bit, are what half as many bits give.
    """
    bits = 64
    while bits < 4 * len(found):
        bits *= 2
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), np.concatenate([*values, np.empty(0, np.int64)]))

    def signed(values: Iterator[int]) -> pa.Array:
        return pa.array(np.fromiter(values, np.uint64).view(np.int64))

    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        columns = [
            *batch.columns[:2],
            signed(xxh64_intdigest(s.tobytes(), 42) for s in sets),
            pa.array([len(s) for s in sets], pa.int32()),
            signed(majority(s) for s in sets),
            lists([band_keys(s) for s in sets]),
            lists([parity(s) for s in sets]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "e", "n", "fp", "keys", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["e", "found"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (2, 3)), strict=True)
            linked = pa.array([similarity(x, y) >= threshold for x, y in sets], pa.bool_())
            yield batch.select([0, 1]).filter(linked)

    return run


def _may_be_similar(x: str, y: str, threshold: float) -> Column:
    """What sizes and bitmaps of the sets ``x`` and ``y`` (columns ``n, bits`` of these aliases) allow."""
    n, m, one, two = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.bits", f"{y}.bits"))
    words = F.least(F.size(one), F.size(two))
    # the longer bitmap is folded; sizes that may match differ by one doubling at most
    folded = lambda bits, i: F.get(bits, i).bitwiseXOR(F.coalesce(F.get(bits, i + words), F.lit(0).cast("long")))
    unlike = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda total, i: total + F.bit_count(folded(one, i).bitwiseXOR(folded(two, i))))
    least, most = F.least(n, m), F.greatest(n, m)
    return (least >= most * F.lit(threshold - 1e-9)) & F.when(least >= most * F.lit(threshold - 1e-9), unlike <= (n + m) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, label`` of each row: ``h`` is the hash of its text, ``label`` is equal within a component."""
    spark = docs.sparkSession
    small_batches(spark)
    own = _own(docs, id_col, text_col)
    schema = "doc_id long, h long, e long, n int, fp long, keys array<long>, bits array<long>"
    with Cuts(spark) as hold:
        rows = hold(own.mapInArrow(_entries, schema))
        lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("row")
        entry = hold(rows.groupBy("e").agg(lowest, *[F.first(c).alias(c) for c in ("n", "fp", "keys", "bits")]).select("e", "row.doc_id", "row.h", "n", "fp", "keys", "bits"))
        banded = entry.select("e", F.explode("keys").alias("key"))

        def verified(pairs: DataFrame) -> DataFrame:
            """The pairs ``a, b`` that are similar enough, by their whole sets."""
            pairs = hold(pairs)
            used = hold(entry.select("e", "doc_id", "h").join(pairs.select(F.col("a").alias("e")).union(pairs.select("b")).distinct(), "e", "left_semi"))
            left, right = own.filter(among(["doc_id", "h"], used)).alias("x"), used.alias("y")
            texts = left.join(right, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h"))).select("y.e", "x.text")
            sets = hold(texts.mapInArrow(_sets, "e long, found binary").dropDuplicates(["e"]))
            both = pairs.join(sets.select(F.col("e").alias("a"), F.col("found").alias("one")), "a").join(sets.select(F.col("e").alias("b"), F.col("found").alias("other")), "b")
            found = hold(both.select("a", "b", "one", "other").mapInArrow(_verified(threshold), "a long, b long"))
            hold.drop(pairs, used, sets)
            return found

        def possible(pairs: DataFrame) -> DataFrame:
            """Those of different pairs ``a, b`` that their sizes and bitmaps allow."""
            a, b = entry.select("e", "n", "bits").alias("x"), entry.select("e", "n", "bits").alias("y")
            joined = pairs.join(a, F.col("a") == F.col("x.e")).join(b, (F.col("b") == F.col("y.e")) & _may_be_similar("x", "y", threshold))
            return joined.select("a", "b")

        # fingerprints: one entry of each stands for it
        print_of = hold(entry.filter("n > 0").groupBy("fp").agg(F.min("e").alias("a")))
        alike = entry.filter("n > 0").select("fp", F.col("e").alias("b")).join(print_of, "fp").filter("a != b").select("a", "b")
        near = links(print_of.select("fp"), RADIUS).select(F.col("a").alias("one"), F.col("b").alias("other"))
        near = near.join(print_of.select(F.col("fp").alias("one"), "a"), "one").join(print_of.select(F.col("fp").alias("other"), F.col("a").alias("b")), "other").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        # buckets: each entry and the smallest one
        first = hold(banded.groupBy("key").agg(F.min("e").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("key", "a"))
        shared = hold(banded.join(first, "key").select("key", "a", "e"))
        star = shared.filter("e != a").select("a", F.col("e").alias("b"))
        edges = verified(possible(star.union(alike).union(near).distinct()))

        # what the first round left apart
        labels = components(edges)
        named = shared.join(labels, F.col("e") == F.col("node"), "left").select("key", "a", "e", F.coalesce("label", "e").alias("label"))
        centre = labels.select(F.col("node").alias("a"), F.col("label").alias("known"))
        named = hold(named.join(centre, "a", "left").select("key", "a", "e", "label", F.coalesce("known", "a").alias("main")))
        hold.drop(first, shared)
        # a bucket whose entries are all linked to its smallest one is done
        sized = entry.select("e", "n", "bits")
        apart = named.filter("label != main").join(sized, "e").select("key", "e", "label", "n", "bits")
        apart = hold(apart)
        others = named.filter("e != a").join(apart.select("key").distinct(), "key", "left_semi").join(sized, "e")
        unlinked = (F.col("x.label") != F.col("y.label")) & ((F.col("x.label") == F.col("x.main")) | (F.col("x.e") < F.col("y.e")))
        pairs = others.alias("x").join(apart.alias("y"), (F.col("x.key") == F.col("y.key")) & unlinked & _may_be_similar("x", "y", threshold))
        more = verified(pairs.select(F.least("x.e", "y.e").alias("a"), F.greatest("x.e", "y.e").alias("b")).distinct())

        labels = components(edges.union(more))
        return cut(rows.select("doc_id", "h", "e").join(labels, F.col("e") == F.col("node"), "left").select("doc_id", "h", F.coalesce("label", "e").alias("label")))


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that components keep, with all their columns."""
    groups = near_groups(docs, threshold, id_col, text_col)
    kept = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.h").alias("kept_h"))
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # whole rows travel in one column, so that no name of theirs can clash
    own = docs.select(F.col(id_col).cast("long").alias("own_id"), h.alias("own_h"), F.struct("*").alias("row"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_h") == F.col("kept_h"))
    return own.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_h"]).select("row.*")
