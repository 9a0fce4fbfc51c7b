"""SimHash near-duplicate groups by bit-sliced comparison.

A text's fingerprint has a bit set if over half of the XXH64 values (seed 42)
of its word shingles have it. Fingerprints within ``radius`` bits are linked;
a component is what links reach.

Only distinct fingerprints are compared, so copies cost nothing. If the 64
bits are cut into ``radius + 1`` bands, two linked fingerprints agree in one
band at least. The bands' values are buckets. With more fingerprints the bits
are cut into more bands and buckets are pairs, triples and so on of bands, which
keeps buckets small. A bucket that is still large is cut again by bands of the
bits that its key leaves open; a link inside it must agree in one of those as
well, so nothing is lost.

Inside buckets the comparison is bit-sliced. The fingerprints, bucket after
bucket, are stored as 64 bit planes, each packed along the fingerprints, and
compared with themselves shifted by 1, 2, 3 and so on places as long as a
bucket has that many members. For each shift the XOR of a plane goes into
carry-save counters (ones, twos and so on, saturated above), one instruction for
64 distances. After every few planes, words of 64 pairs that all exceed the
radius are abandoned.

A bucket gives the edges of a spanning forest, not its pairs. Components come
from label propagation with pointer jumping over tables in the shared folder;
fingerprints, links and labels never reach the driver.

Cases: null and empty texts, and texts of white space alone, have fingerprint
zero, which is linked like any other; texts of fewer words than a shingle are
one shingle; repeated ids are separate rows of one id; null ids stay null and
represent a component only if it has no other; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, shared_dir, small_batches

BITS = 64
#: Mean members of a bucket, beyond which buckets get more bands.
MEAN_BUCKET = 64
#: Members of a bucket, beyond which it is cut again, at most so often.
LARGE_BUCKET, CUTS = 4096, 3
#: Fingerprints whose bit planes are held together.
SLICE = 1 << 17

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that over half of some 64-bit numbers have."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):  # the bits of so many at once
        counts += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: fingerprints as signed 64-bit numbers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bands(width: int, parts: int) -> list[tuple[int, int]]:
    """``width`` cut into so many even parts: (first, size)."""
    at = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def _masks(open_bits: int, radius: int, count: int) -> list[int]:
    """Bit masks, of which two numbers that differ in ``radius`` of the open bits at most share one's bits at least."""
    places = [k for k in range(BITS) if open_bits >> k & 1]
    parts = radius + 1
    while parts < min(radius + 4, len(places)) and count / 2 ** (len(places) * (parts - radius) // parts) > MEAN_BUCKET:
        parts += 1
    bands = [sum(1 << places[k] for k in range(a, a + n)) for a, n in _bands(len(places), parts)]
    return [sum(c) for c in combinations(bands, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(fp: np.ndarray, spare: int) -> np.ndarray:
    """64 rows of packed bits: bit ``k`` of word ``w`` in row ``b`` is bit ``b`` of fingerprint ``64 w + k``; ``spare`` words follow."""
    words = -(-len(fp) // 64)
    out = np.zeros((BITS, words + spare), np.uint64)
    for a in range(0, words, SLICE // 64):
        own = fp[64 * a : 64 * a + SLICE]
        bits = np.zeros((-(-len(own) // 64) * 64, BITS), np.uint8)
        bits[: len(own)] = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)
        out[:, a : a + packed.shape[1]] = packed
    return out


def links_of_sorted(fp: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs among fingerprints whose equal buckets stand together, bit-sliced."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(first, n))
    most = int(size.max(initial=0))
    members = np.zeros(-(-n // 64) * 64, np.int64)
    members[:n] = np.repeat(size + first, size) - np.arange(n)  # from here to the bucket's end
    planes = _planes(fp, most // 64 + 2)
    left, right = [], []
    alive = np.arange(len(members) // 64)
    for shift in range(1, most):
        valid = np.packbits(members.reshape(-1, 64)[alive] > shift, axis=1, bitorder="little").view(np.uint64).ravel()
        alive, valid = alive[valid != 0], valid[valid != 0]
        hit = _near(planes, alive, valid, shift, radius)
        if len(hit):
            left.append(hit)
            right.append(hit + shift)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(left), join(right)


def _near(planes: np.ndarray, words: np.ndarray, valid: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Which valid fingerprints have ``radius`` bits at most other than the one ``shift`` places on.

    Carry-save counters hold 64 distances a word; lanes above the radius
    saturate in ``over``. Words with no lane left are abandoned.
    """
    far, bit = divmod(shift, 64)
    bit, back = np.uint64(bit), np.uint64(64 - bit)
    counters = [np.zeros(len(words), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = ~valid
    for k, plane in enumerate(planes):
        moved = plane[words + far] if not bit else (plane[words + far] >> bit) | (plane[words + far + 1] << back)
        carry = plane[words] ^ moved
        for c in range(len(counters)):
            carry, counters[c] = counters[c] & carry, counters[c] ^ carry
        over |= carry
        over |= _exceeds(counters, radius)
        if k % 4 == 3:
            going = over != _FULL
            if not going.all():
                words, over, counters = words[going], over[going], [c[going] for c in counters]
                if not len(words):
                    break
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return (words[:, None] * 64 + np.arange(64))[lanes]


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | (equal & counters[k]), equal & ~counters[k]
    return above


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest with the same components: each place but a root to its root."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _compare(radius: int):
    """A partition's buckets, sorted by key, to the edges of each; a bucket is compared once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = (np.empty(0, np.int64),) * 3

        def edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp) > 1:
                new = np.concatenate([[False], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
                left, right = links_of_sorted(fp.view(np.uint64), np.cumsum(new), radius)
                if len(left):
                    a, b = _forest(left, right)
                    yield pa.RecordBatch.from_pydict({"a": fp[a], "b": fp[b]})

        for batch in batches:
            if not len(batch):
                continue
            mask, key, fp = (np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest))
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            whole = last[-1] + 1 if len(last) else 0
            yield from edges(mask[:whole], key[:whole], fp[:whole])
            rest = (mask[whole:], key[whole:], fp[whole:])
        yield from edges(*rest)

    return run


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``), with the same components as all links."""
    n = distinct.count()
    masks = F.array(*[F.lit(_signed(m)) for m in _masks((1 << BITS) - 1, radius, n)])
    keyed = distinct.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    found, spark = [], distinct.sparkSession
    for depth in range(CUTS + 1):
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        sizes = cut(sizes)
        large = sizes.filter(F.col("members") > LARGE_BUCKET)
        last = depth == CUTS or not large.take(1)
        small = sizes if last else sizes.filter(F.col("members") <= LARGE_BUCKET)
        ready = keyed.join(small.select("mask", "key"), ["mask", "key"]).select("mask", "key", "fp")
        found.append(ready.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_compare(radius), "a long, b long"))
        if last:
            break
        # the open bits of a large bucket are those that its mask leaves
        again = {m.mask: [_signed(x | (m.mask & (1 << 64) - 1)) for x in _masks(~m.mask & (1 << 64) - 1, radius, 0)] for m in large.select("mask").distinct().collect()}
        finer = F.element_at(F.create_map(*[y for k, v in again.items() for y in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("mask"))
        keyed = keyed.join(large.select("mask", "key"), ["mask", "key"]).select("fp", F.explode(finer).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp").distinct()
        keyed = cut(keyed)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that the edges ``a, b`` reach, for each node that has one.

    Each round every node takes the smallest label among its neighbours and
    itself, then its label's label. Labels only fall; the rounds end when none
    did. Sums and minima meet before they are shuffled; joins on a node with
    very many neighbours are left to adaptive skew splitting.
    """
    spark = edges.sparkSession
    edges_path, both_path, path = (shared_dir(spark) for _ in range(3))
    edges = cut(edges, edges_path)  # both directions must be of the same edges, also if a plan gives others when it runs again
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), both_path)
    remove(spark, edges_path)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), path)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        mine = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new_path = shared_dir(spark)
        new = cut(mine.join(jump, "low").select("node", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("label")).alias("fell")), new_path)
        remove(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not new.filter("fell").take(1):
            remove(spark, both_path)
            return labels


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, fingerprint, component_id`` (16 hex digits; the smallest id that links reach)."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = components(links(distinct.select("fp"), radius))
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    # only linked fingerprints can take their id from another
    linked = labelled.join(labels.select("node"), labelled.fp == labels.node, "left_semi")
    lowest = linked.groupBy("label").agg(F.min("low").alias("lowest"))
    named = cut(labelled.join(lowest, "label", "left").select("fp", F.coalesce("lowest", "low").alias("component_id")))
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
