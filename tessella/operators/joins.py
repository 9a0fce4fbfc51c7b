"""Joins beyond equality: intervals, points, lags, k-mers, and checks of keys.

Intervals are half-open, ``[start, end)``, on 64-bit positions. Interval joins
cut both sides into bins of a fixed width and join on the bin, so each is one
hash or sort-merge join that Spark can split and spill; a pair is reported in
the one bin where the later of both starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import pearson


def _bins(start: Column, end: Column, width: int) -> Column:
    """All bins that an interval touches; none if it is empty."""
    last = F.floor((end - 1) / width)
    return F.when(end > start, F.sequence(F.floor(start / width), last)).otherwise(F.array().cast("array<bigint>"))


def interval_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, how: str = "inner", names: tuple[str, str, str, str] = ("l_start", "l_end", "r_start", "r_end")) -> DataFrame:
    """Pairs of intervals that overlap, with the length of their ``overlap``.

    ``names`` are the bounds' columns; sides share only ``keys``. ``how`` may
    be ``left``: rows without a pair then come once, with nulls.
    """
    ls, le, rs, re_ = names
    a = left.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else left
    x = a.withColumn("_bin", F.explode(_bins(F.col(ls), F.col(le), width)))
    y = right.withColumn("_bin", F.explode(_bins(F.col(rs), F.col(re_), width)))
    pairs = x.join(y, [*keys, "_bin"]).filter((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.floor(F.greatest(ls, rs) / width) == F.col("_bin"))).drop("_bin")
    if how == "left":
        rest = a.join(pairs.select("_row").distinct(), "_row", "left_anti")
        pairs = pairs.unionByName(rest, allowMissingColumns=True).drop("_row")
    return pairs.withColumn("overlap", F.least(le, re_) - F.greatest(ls, rs))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], width: int, at: str = "at", names: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Points with each interval that holds them."""
    s, e = names
    y = intervals.withColumn("_bin", F.explode(_bins(F.col(s), F.col(e), width)))
    x = points.withColumn("_bin", F.floor(F.col(at) / width))
    return x.join(y, [*keys, "_bin"]).filter((F.col(at) >= F.col(s)) & (F.col(at) < F.col(e))).drop("_bin")


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str], width: int, names: tuple[str, str, str, str] = ("l_start", "l_end", "r_start", "r_end")) -> DataFrame:
    """Pairs whose left interval lies within the right one."""
    ls, le, rs, re_ = names
    x = inner.withColumn("_bin", F.floor(F.col(ls) / width))
    y = outer.withColumn("_bin", F.explode(_bins(F.col(rs), F.col(re_), width)))
    return x.join(y, [*keys, "_bin"]).filter((F.col(rs) <= F.col(ls)) & (F.col(le) <= F.col(re_))).drop("_bin")


def weighted_overlap(pairs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of ``value`` over overlapping pairs, weighted by overlap length, and the length covered."""
    return pairs.groupBy(*by).agg((F.sum(F.col(value) * F.col("overlap")) / F.sum("overlap")).alias("weighted_mean"), F.sum("overlap").alias("covered"))


def lag_join(series: DataFrame, keys: Sequence[str], time: str, x: str, y: str, lags: Sequence[int]) -> DataFrame:
    """Pairs ``x`` at t and ``y`` at t + lag, for each lag, joined on the time's value, so that gaps make fewer pairs."""
    early = series.select(*keys, F.col(time).alias("_t"), F.col(x).alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    early = early.withColumn("_at", F.col("_t") + F.col("lag"))
    late = series.select(*keys, F.col(time).alias("_at"), F.col(y).alias("y"))
    return early.join(late, [*keys, "_at"]).select(*keys, F.col("_t").alias(time), "lag", "x", "y")


def lag_correlation(series: DataFrame, keys: Sequence[str], time: str, x: str, y: str, lags: Sequence[int], by_key: bool = False) -> DataFrame:
    """Pearson correlation and number of pairs for each lag; null if a side is constant."""
    pairs = lag_join(series, keys, time, x, y, lags)
    return pairs.groupBy(*(keys if by_key else []), "lag").agg(pearson("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left outer join to the first row of each key on the right."""
    first = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return left.join(first, list(keys), "left")


def only_match(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is theirs alone; ambiguous keys are dropped."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side alone has, with the ``side``; empty if both have the same."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    return both.filter("_l IS NULL OR _r IS NULL").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def self_pairs(df: DataFrame, on: Sequence[str], item: str, carry: Sequence[str]) -> DataFrame:
    """Unordered pairs of different items that share ``on``; ``carry`` comes as ``_a`` and ``_b``."""
    a = df.select(*on, F.col(item).alias(f"{item}_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = df.select(*on, F.col(item).alias(f"{item}_b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, list(on)).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))


def symmetric_distinct(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs, whichever way round they stand."""
    return df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def kmers(text: Column, k: int) -> Column:
    """All substrings of ``k`` characters with their places from 0."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("at"), F.substring(text, i + 1, F.lit(k)).alias("kmer")))).otherwise(F.array().cast("array<struct<at:int,kmer:string>>"))


def word_grams(text: Column, k: int) -> Column:
    """All runs of ``k`` words, joined by a space."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>")))[0]


def seed_join(queries: DataFrame, targets: DataFrame, seed: str, most: int | None = None) -> DataFrame:
    """Equi-join on seeds. Seeds that occur more than ``most`` times among the targets are repeats and don't seed."""
    if most is not None:
        rare = targets.groupBy(seed).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select(seed)
        targets = targets.join(rare, seed, "left_semi")
    return queries.join(targets, seed)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the latest ``carry`` of the right at or before its time: one sort of both sides, no pairs."""
    l_ = left.withColumn("_side", F.lit(1))
    r_ = right.select(*keys, time, F.struct(*carry).alias("_carry"), F.lit(0).alias("_side"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_last", F.last("_carry", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in carry])
