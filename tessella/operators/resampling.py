"""Resampling as grouped aggregations over replicates.

Draws are digests of the replicate's number and what is drawn, so every run,
and every retry of a task, draws the same, and nothing is collected. Rows are first
added up by the unit that is resampled; only these sums meet the replicates.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from . import ordered, solvers

#: Shares of a Poisson variable of mean one up to each number; beyond twelve none is drawn in 2 ** 32.
_POISSON = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(13)]
#: Draws that are made from one row at once.
BLOCK = 4096
#: Ranges of the digest by which a round's units are added up.
BINS = 256


def uniform(*parts: Column | str) -> Column:
    """A number from [0, 1) that the parts, joined by ``-``, give: eight hexadecimal digits of their digest."""
    text = F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_draw(u: Column) -> Column:
    """How often a unit is drawn: the Poisson variable of mean one at which a uniform number stands."""
    return sum((F.when(u >= c, 1).otherwise(0) for c in _POISSON[1:]), F.when(u >= _POISSON[0], 1).otherwise(0))


def _replicated(df: DataFrame, rounds: int) -> DataFrame:
    return df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))


def bootstrap(df: DataFrame, unit: str, sums: dict[str, Column], statistic: Column, rounds: int, by: Sequence[str] = (), seed: str = "b") -> DataFrame:
    """A statistic of sums when whole units are drawn with replacement: ``by, round, value``.

    ``sums`` are aggregates of rows that add up, such as ``F.sum``; ``statistic``
    is an expression of their names. Round 0 has every unit once. A round in
    which no unit of a group is drawn has a null. The number of draws is
    Poisson, not fixed, as is usual where units are many.
    """
    units = df.groupBy(*by, unit).agg(*[c.alias(k) for k, c in sums.items()])
    draws = F.when(F.col("round") == 0, 1).otherwise(poisson_draw(uniform(F.lit(seed), "round", unit)))
    each = units.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds)))).withColumn("_w", draws)
    totals = each.groupBy(*by, "round").agg(*[F.sum(F.col(k) * F.col("_w")).alias(k) for k in sums], F.sum("_w").alias("_n"))
    return totals.select(*by, "round", F.when(F.col("_n") > 0, statistic).alias("value"))


def bounds(values: DataFrame, by: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Quantiles and mean of replicates: ``by, low, high, mean, rounds``."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q")  # one value for each replicate
    return values.groupBy(*by).agg(q, F.avg(value).alias("mean"), F.count(value).alias("rounds")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "mean", "rounds")


def permutation_test(df: DataFrame, unit: str, flag: str, value: str, rounds: int, by: Sequence[str] = (), seed: str = "p") -> DataFrame:
    """Whether flagged units have a higher mean than others: ``by, observed, null_mean, null_sd, p, z``.

    Each round deals the flags out anew: units stand in the order of a digest
    and the first get them, as many as there are. A round's units are counted
    and added up by ``BINS`` ranges of the digest; only those of the range in
    which the flags run out are put in order, by a scan in parts. So a round
    may have any number of units, and no round is shuffled whole. ``p`` counts
    the observed value among the rounds (add one). Groups without units of
    both kinds have nulls.
    """
    units = staged(df.groupBy(*by, unit).agg(F.max(F.col(flag).cast("int")).alias("_f"), F.avg(F.col(value).cast("double")).alias("_v")))
    totals = units.groupBy(*by).agg(F.count("_f").alias("_n"), F.sum("_f").alias("_k"), F.sum("_v").alias("_t"), F.sum(F.col("_v") * F.col("_f")).alias("_s"))
    with_totals = lambda rows: rows.join(totals, list(by)) if by else rows.crossJoin(F.broadcast(totals))  # noqa: E731  # one row
    apart = lambda s: F.try_divide(s, F.col("_k")) - F.try_divide(F.col("_t") - s, F.col("_n") - F.col("_k"))
    u = uniform(F.lit(seed), "round", unit)
    bins = _replicated(units, rounds).groupBy(*by, "round", F.floor(u * BINS).cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_x"))
    up = Window.partitionBy(*by, "round").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows at most
    bins = with_totals(bins.withColumn("_to", F.sum("_c").over(up)))
    left = F.col("_k") - (F.col("_to") - F.col("_c"))  # flags that a bin's units have before them to get
    begun = staged(bins.groupBy(*by, "round").agg(F.sum(F.when(left >= F.col("_c"), F.col("_x"))).alias("_x"), F.max(F.when((left > 0) & (left < F.col("_c")), F.struct("_b", left.alias("_left")))).alias("_open")))
    # a group's open bins are one list, so that units meet it before they meet the rounds
    lists = staged(begun.filter(F.col("_open").isNotNull()).groupBy(*by).agg(F.collect_list(F.struct("round", "_open")).alias("_l")))
    met = units.join(lists, list(by)) if by else units.crossJoin(F.broadcast(lists))  # one row
    dealt = met.select(*by, unit, "_v", F.explode("_l").alias("_l")).select(*by, unit, "_v", "_l.round", "_l._open").withColumn("_u", u).filter(F.floor(F.col("_u") * BINS) == F.col("_open._b"))
    placed = ordered.scan(staged(dealt), [F.asc("_u"), F.asc(unit)], {"_place": ordered.Running("count")}, [*by, "round"])
    ended = placed.filter(F.col("_place") <= F.col("_open._left")).groupBy(*by, "round").agg(F.sum("_v").alias("_rest"))
    joined = with_totals(begun.join(ended, [*by, "round"], "left"))
    x = F.coalesce("_x", F.lit(0.0)) + F.coalesce("_rest", F.lit(0.0))
    null = joined.select(*by, apart(x).alias("_null"))
    seen = totals.select(*by, apart(F.col("_s")).alias("observed"))
    both = null.join(seen, list(by)) if by else null.crossJoin(F.broadcast(seen))  # one row
    above = F.count_if(F.col("_null") >= F.col("observed") - 1e-12)
    out = both.groupBy(*by, "observed").agg(F.avg("_null").alias("null_mean"), F.stddev_samp("_null").alias("null_sd"), F.when(F.col("observed").isNotNull(), (above + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return out.withColumn("z", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")))


def multinomial(shares: DataFrame, category: str, share: str, depth: int, rounds: int, by: Sequence[str] = (), seed: str = "m") -> DataFrame:
    """Counts of ``depth`` draws from each distribution of shares: ``by, round, category, n``; categories that are not drawn have no row.

    Shares are scaled to one; a draw takes the first category, in their order,
    whose sum of shares up to it is above a uniform number. Each distribution
    is one list, so its categories must be few enough for a row.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(category).alias("c"), F.col(share).cast("double").alias("s"))))
    lists = shares.filter(F.col(share) > 0).groupBy(*by).agg(order.alias("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x.s)
    sums = F.aggregate("_l", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x.s)))
    lists = lists.withColumn("_t", total).withColumn("_c", F.transform(sums, lambda x: x / F.col("_t")))
    blocks = _replicated(lists, rounds).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(max(0, depth - 1)), F.lit(BLOCK)))) if depth else _replicated(lists, rounds).limit(0).withColumn("_b", F.lit(0))
    draws = blocks.withColumn("_i", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + BLOCK, F.lit(depth)) - 1))).withColumn("_u", uniform(F.lit(seed), *by, "round", "_i"))
    at = F.least(F.size(F.filter("_c", lambda c: c <= F.col("_u"))), F.size("_c") - 1)
    return draws.groupBy(*by, "round", F.get("_l", at)["c"].alias(category)).agg(F.count(F.lit(1)).alias("n"))


def mixture_bootstrap(counts: DataFrame, profiles: DataFrame, feature: str, value: str, kind: str, depth: int, rounds: int, seed: str = "m") -> tuple[DataFrame, DataFrame]:
    """The likeliest weights of profiles for one table of counts, and those of ``rounds`` tables drawn from the fitted mixture: ``kind, weight`` and ``round, kind, weight``."""
    fit = solvers.unmix(counts.withColumn("round", F.lit(0)), profiles, "round", feature, value, kind, "em")
    scaled = profiles.withColumn("_s", F.col(value) / F.sum(value).over(Window.partitionBy(kind)))
    fitted = scaled.join(fit, kind).groupBy(feature).agg(F.sum(F.col("_s") * F.col("weight")).alias("_p"))
    draws = multinomial(fitted, feature, "_p", depth, rounds, seed=seed).withColumnRenamed("n", value)
    return fit.drop("round"), solvers.unmix(draws, profiles, "round", feature, value, kind, "em")


def vote_confidence(df: DataFrame, unit: str, candidate: str, feature: str, score: str, rounds: int, seed: str = "v") -> DataFrame:
    """How often each candidate of a unit has the highest score when features are drawn with replacement: ``unit, candidate, wins, confidence``.

    The first by name of equal candidates wins; a round in which no feature of
    a unit is drawn has no winner.
    """
    each = _replicated(df.groupBy(unit, candidate, feature).agg(F.sum(score).alias("_s")), rounds).withColumn("_w", poisson_draw(uniform(F.lit(seed), "round", feature)))
    sums = each.groupBy(unit, "round", candidate).agg(F.sum(F.col("_w") * F.col("_s")).alias("_t"), F.sum("_w").alias("_d"))
    best = sums.filter("_d > 0").groupBy(unit, "round").agg(F.min(F.struct((-F.col("_t")).alias("t"), F.col(candidate).alias("c"))).alias("_b"))
    won = best.groupBy(unit, F.col("_b.c").alias(candidate)).agg(F.count(F.lit(1)).alias("wins"))
    return won.withColumn("confidence", F.col("wins") / F.sum("wins").over(Window.partitionBy(unit)))
