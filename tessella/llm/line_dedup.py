r"""Line deduplication by an exact set-similarity join, in DataFrame operations.

A line is the set of its words. A line is removed if an earlier line, in
order of document id, text hash and place, has a Jaccard similarity of at least
``threshold`` with it; lines without words stay.

Lines of equal sets are one entry, so that a line that fills a third of the
corpus is compared once. Each entry's words are ordered by rarity. Of two sets
that are similar enough, the smaller has a common word in its first few (the
index prefix) that is among the first of the larger, too (the longer prefix), so
entries join on these words and on a class of lengths. Lengths that cannot match, places from which too
little can follow, and sets whose parity bitmaps differ in more bits than the
sets may differ in words are filtered in the join. Then the words of candidates
are read again from their documents and the Jaccard similarity is verified.

Only whether an entry is near any earlier one matters. So where many entries
share a rare word, each is first compared with the earliest of them; pairs of
which both are then known to be near an earlier one are not made, which spares
a large group of near copies all its pairs. It is done only if these are
more than a few for each entry of the table; the join finds all pairs by itself.

Rarity orders words by a sketch of counts over all documents, 2^16 hashed
counters, and breaks ties by the word's hash. The candidates' places are in a
filter of 2^20 hashed bits, so that few other lines are shuffled when words are
read again. Both have a fixed size and go with the plan; as they only choose an
order, the same for all lines, and drop what the join would drop, results are
exact for any counts. Words are compared by 52-bit hashes; the join on prefix
words takes 32 bits of these, which can only add candidates. Equal sets are
told by 64 bits and the number of their words.

Cases: null and empty texts have one empty line, which stays; rows that agree
in id and text get one decision; null ids come first; very long lines are
entries like others; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log, log2
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, among, cut, long_array

SKETCH = 1 << 16
THRESHOLD = 0.8
#: Sets of more words have a bitmap of half their words, too, as 64 bits tell long lines apart less well:
#: with it the bitmap of all words falls into two, and the differences of both halves add up.
WIDE = 80
#: How many of their rarest words let entries meet the earliest one first, and how many entries of a word do so.
STAR, CROWD = 5, 64
#: The entries near an earliest one are looked up first if they make more than so many pairs for each entry of the table;
#: looking them up reads all texts once more.
SPARED = 5
#: No place of a prefix is that high.
CROSSED = 1 << 29
#: The join on prefix words is made in so many parts of the words, one after the other, so that only one part's rows are on disk.
PARTS = 2
_KEY = ["doc_id", "h"]


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(SKETCH - 1)).cast("int")


def _split(text: Column) -> Column:
    """Words of a text without line feeds, perhaps with empty strings between them.

    Splitting at one plain character is Java's fast path; it also looks for a character several times faster than ``contains``.
    """
    other = reduce(or_, [F.size(F.split(text, c, 2)) > 1 for c in "\t\x0b\x0c\r"])
    return F.when(other, F.split(text, r"[\x20\x09-\x0D]+", -1)).otherwise(F.split(text, " ", -1))


def _rarity(docs: DataFrame) -> Column:
    """An array literal: for each counter the rank, from -128 to 127, of its count; a step is a sixth of a doubling.

    Java keeps one object for each number of this range, so that all counters together are small enough for a core's cache.
    """
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    words = lines.select(F.explode(_split(F.col("line"))).alias("word"))
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("b")).count().collect()  # SKETCH rows at most
    ranks = [-128] * SKETCH
    for b, n in counts:
        ranks[b] = min(int(6 * log2(n)), 255) - 128
    return long_array(ranks)


def _tokens(line: Column, rarity: Column) -> Column:
    """A line's different words as numbers, rarest first: rank in the top bits, word hash below."""
    # no value is null, and Spark is told so, as it sorts such numbers without boxing them; each word is hashed once.
    # Array functions stand outside of transform, as Spark compiles them only there; one of them drops repeats and the empty word.
    rank = lambda h: F.coalesce(rarity.getItem(h.bitwiseAND(F.lit(SKETCH - 1))), F.lit(0).cast("long"))
    number = lambda h: F.shiftleft(rank(h), 52).bitwiseOR(F.shiftrightunsigned(h, 12))
    hashes = F.transform(_split(line), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_except(F.transform(hashes, number), F.array(number(F.xxhash64(F.lit(""))))))


def _parity(tokens: str | Column) -> Column:
    """64 bits: whether an odd number of the words falls on each."""
    at = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at(x))))


def _least(n: Column, share: float) -> Column:
    """The smallest whole number that is not below ``share * n``, sparing rounding errors."""
    return F.ceil(n * share - 1e-9).cast("int")


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def _unlike(a: str, b: str) -> Column:
    """At least so many words are in only one of two sets, as their bitmaps tell."""
    bits, half = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("parity", "half")]
    return F.coalesce(F.bit_count(half) + F.bit_count(bits.bitwiseXOR(half)), F.bit_count(bits))


def _stars(entries: DataFrame, threshold: float, hold: Cuts) -> DataFrame:
    """Pairs ``x, y`` of an entry ``y`` and the earliest one, ``x``, with which it shares one of its ``STAR`` rarest words, where ``CROWD`` entries do."""
    columns = ["n", "parity", "half"]
    words = entries.select("id", *columns, F.explode(F.slice("prefix", 1, STAR)).alias("word"))
    crowds = hold(words.groupBy("word").agg(F.min("id").alias("x"), F.count(F.lit(1)).alias("members")).filter(F.col("members") >= CROWD).select("word", "x"))
    centres = hold(crowds.join(entries.select(F.col("id").alias("x"), *columns), "x"))
    share = threshold / (1 + threshold)
    a_n, b_n = F.col("a.n"), F.col("b.n")
    alike = (F.least(a_n, b_n) >= F.greatest(a_n, b_n) * threshold - 1e-9) & (a_n + b_n - _unlike("a", "b") >= 2 * _least(a_n + b_n, share))
    members = words.filter(among(["word"], crowds))
    joined = members.alias("b").join(centres.alias("a"), (F.col("a.word") == F.col("b.word")) & (F.col("a.x") != F.col("b.id")) & alike)
    return joined.select("a.x", F.col("b.id").alias("y")).distinct()


def _candidates(entries: DataFrame, threshold: float, hold: Cuts) -> DataFrame:
    """Pairs ``x, y`` of the ids of sets that may be similar; ``entries`` has ``id, n, parity, half, prefix, near``.

    If the later of two entries, that of the greater id, is known to be near an earlier one, they make no pair, as nothing follows from it.
    """
    share = threshold / (1 + threshold)
    class_of = lambda n: F.floor(F.ln(n) / (2 * -log(threshold) or 1)).cast("int")  # noqa: E731  # of length
    n, at = F.col("n"), F.col("at")
    places = entries.select("id", "n", "near", "parity", "half", F.posexplode("prefix").alias("at", "word"))
    # The larger set's length is of the smaller's class or of the next one. A row that stands for a smaller set in
    # the next class has CROSSED added to its place, so that it is never taken for a larger one.
    crosses = (at <= n - _least(n, 2 * share)) & (class_of(F.floor(n / threshold + 1e-9)) > class_of(n))
    up = F.explode(F.when(crosses, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("up")
    rows = lambda part: places.filter(F.pmod("word", F.lit(PARTS)) == part).select("*", up).select(
        F.shiftleft(F.col("word").cast("long"), 20).bitwiseOR(class_of(n) + F.col("up")).alias("word"),
        "id",
        F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(F.col("near").cast("long"), 31)).bitwiseOR((at + F.col("up") * CROSSED).cast("long")).alias("told"),
        "parity",
        "half",
    )
    told = lambda side, shift, mask: F.shiftrightunsigned(f"{side}.told", shift).bitwiseAND(F.lit(mask).cast("long")).cast("int")
    a_n, b_n = told("a", 32, 0x7FFFFFFF), told("b", 32, 0x7FFFFFFF)
    a_at, b_at = told("a", 0, CROSSED - 1), told("b", 0, 2 * CROSSED - 1)
    needed = _least(a_n + b_n, share)
    possible = F.least(a_n - a_at, b_n - b_at)
    # The index prefix is of the smaller set. Conditions are on both sides, so that these read one shuffle.
    indexed = a_at <= F.least(a_n, b_n) - _least(F.least(a_n, b_n), 2 * share)
    # Nearly all pairs fall at this: the bitmaps of all words, which no other column is needed for, differ in more bits than sets of
    # these sizes may in words. It comes first as it is cheap; the last condition is stricter.
    wide = lambda side: F.shiftrightunsigned(f"{side}.told", 32)
    alike = F.bit_count(F.col("a.parity").bitwiseXOR(F.col("b.parity"))) * (1 << 20) <= (wide("a") + wide("b")) * ceil((1 - 2 * share) * (1 << 20) + 1)
    later_near = F.when(F.col("a.id") < F.col("b.id"), told("b", 31, 1)).otherwise(told("a", 31, 1)) == 1
    met = (
        (F.col("a.word") == F.col("b.word")) & alike & (a_n <= b_n) & (a_n >= b_n * threshold - 1e-9) & ((a_n < b_n) | (F.col("a.id") < F.col("b.id")))
        & indexed & ~later_near & (possible >= needed) & (a_n + b_n - _unlike("a", "b") >= 2 * needed)
    )
    found = [hold(rows(k).alias("a").join(rows(k).alias("b"), met).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()) for k in range(PARTS)]
    return reduce(DataFrame.union, found)


def removals(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different ``doc_id, h``: ``n_lines``, ``removed``, the places (from 0) of removed lines, and ``copies``, the number of its rows."""
    own = _text_rows(docs, id_col, text_col)
    rarity = _rarity(own)
    split = own.select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    n = F.size("t")
    # a set of fewer words is similar to none but itself and needs no prefix
    paired = n >= (threshold / (1 - threshold) - 1e-9 if threshold < 1 else float("inf"))
    rarest = F.transform(F.slice("t", 1, n - _least(n, threshold) + 1), lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int"))
    prefix = F.when(paired, rarest).otherwise(F.array().cast("array<int>"))
    place = [*_KEY, "line"]
    # a filter on the words here would make Spark compute them twice
    sets = split.select(*place, _tokens(F.col("words"), rarity).alias("t"))
    sets = sets.select(F.struct(*place).alias("first"), n.alias("n"), F.xxhash64("t").alias("set"), _parity("t").alias("parity"), F.when(n > WIDE, _parity(F.filter("t", lambda x: x.bitwiseAND(F.lit(64)) > 0))).alias("half"), prefix.alias("prefix"))
    # ``some`` is n again: a filter on n itself would be made before grouping, and there compute the words twice
    grouped = sets.groupBy("set", "n").agg(F.max("n").alias("some"), F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("parity", "half", "prefix")])

    def near(pairs: DataFrame, entries: DataFrame, hold: Cuts) -> DataFrame:
        """Ids of the later ones of the pairs that are similar; their words are read again."""
        pairs = hold(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        if pairs.isEmpty():
            return pairs.select(F.col("y").alias("id"))
        ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
        wanted = hold(entries.join(ids, "id").select("id", "first"))
        texts = own.filter(among(_KEY, wanted.select("first.*")))
        again = texts.select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("line", "words")).filter(among(place, wanted.select("first.*"))).select(F.struct(*place).alias("first"), "words").join(wanted, "first")
        sets = hold(again.select("id", _tokens(F.col("words"), rarity).alias("t")).dropDuplicates(["id"]))
        x, y = (sets.select(F.col("id").alias(c), F.col("t").alias(f"{c}_t")) for c in "xy")
        common = F.size(F.array_intersect("x_t", "y_t"))
        similar = lambda some: some.join(x, "x").join(y, "y").filter(common >= (F.size("x_t") + F.size("y_t") - common) * threshold - 1e-9).select(F.col("y").alias("id"))
        # one earlier entry is enough: each entry is compared with the earliest first, and with the others only if that one is not near
        first = hold(pairs.groupBy("y").agg(F.min("x").alias("x")))
        found = hold(similar(first))
        open_ = first.join(found, F.col("y") == F.col("id"), "left_anti").select("y", F.col("x").alias("tried"))
        rest = hold(similar(pairs.join(open_, "y").filter("x > tried").select("x", "y")).distinct())
        hold.drop(pairs, wanted, sets, first)
        return found.union(rest)

    with Cuts(docs.sparkSession) as hold:
        # ids in the order of first places (by columns, as a struct has no sort prefix), so the later of two entries is that of the greater id
        entries = hold(grouped.filter("some > 0").select("first", "n", "parity", "half", "prefix").orderBy("first.doc_id", "first.h", "first.line").withColumn("id", F.monotonically_increasing_id()))
        comparable = entries.filter(F.size("prefix") > 0)
        stars = hold(_stars(comparable, threshold, hold))
        spared = stars.groupBy("x").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        known = near(stars if spared > SPARED * entries.count() else stars.limit(0), entries, hold)
        marked = comparable.join(known.withColumn("near", F.lit(True)), "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
        gone = known.union(near(_candidates(marked, threshold, hold), entries, hold)).distinct()
        # what stays is the first line of each set that is not near an earlier one
        stay = cut(entries.join(gone, "id", "left_anti").select("first.*").groupBy(*_KEY).agg(F.collect_list("line").alias("stay")))
    worded = F.transform(F.split("text", "\n", -1), lambda line, k: F.when(F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != "", k))
    counted = own.select(*_KEY, worded.alias("worded")).select(*_KEY, F.size("worded").cast("long").alias("n_lines"), F.array_compact("worded").alias("worded"))
    counted = counted.groupBy(*_KEY).agg(F.first("n_lines").alias("n_lines"), F.first("worded").alias("worded"), F.count(F.lit(1)).alias("copies"))
    joined = counted.alias("c").join(stay.alias("s"), F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("c.h") == F.col("s.h")), "left")
    removed = F.array_except("worded", F.coalesce("stay", F.array().cast("array<int>")))
    return joined.select("c.doc_id", "c.h", "n_lines", F.sort_array(removed).alias("removed"), "copies")


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its columns with the removed lines cut from the text, and ``n_lines, removed``."""
    gone = removals(docs, threshold, id_col, text_col).select(F.col("doc_id").alias("_line_id"), F.col("h").alias("_line_h"), F.col("n_lines").alias("_line_n"), F.col("removed").alias("_line_gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_line_id")) & (F.xxhash64(text) == F.col("_line_h")))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_line_gone", i)), "\n")
    columns = [(F.when(F.col(text_col).isNull(), None).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns]
    return joined.select(*columns, F.col("_line_n").alias("n_lines"), F.col("_line_gone").alias("removed"))
