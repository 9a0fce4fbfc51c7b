"""Statistics as grouped or windowed expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes a median absolute deviation comparable to a standard deviation.
MAD_SCALE = 1.4826


def global_median(df: DataFrame, value: str, spread: float = 1e-3) -> float | None:
    """The exact median of all rows, without one task that holds all different values.

    A sketch bounds it within ``spread`` of the ranks on both sides; only rows
    within these bounds are sorted, by ranges.
    """
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).filter("x IS NOT NULL")
    low, high, n = rows.agg(F.percentile_approx("x", 0.5 - spread, 100_000), F.percentile_approx("x", 0.5 + spread, 100_000), F.count("x")).head()
    if not n:
        return None
    # a little beyond the values themselves, so that no rounding of a recomputed value crosses a bound
    low, high = low - 1e-9 * abs(low) - 1e-12, high + 1e-9 * abs(high) + 1e-12
    below = rows.filter(F.col("x") < low).count()
    middle = rows.filter(F.col("x").between(low, high)).orderBy("x").offset((n - 1) // 2 - below).limit(2 - n % 2).collect()
    return sum(r.x for r in middle) / len(middle)


def mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median and scaled median absolute deviation of each group."""
    if not by:
        middle = global_median(df, value)
        spread = None if middle is None else global_median(df.select(F.abs(F.col(value) - middle).alias("_apart")), "_apart")
        one = [(middle, None if spread is None else spread * MAD_SCALE)]
        return df.sparkSession.createDataFrame(one, "median double, mad double")
    centre = df.groupBy(*by).agg(F.median(value).alias("median"))
    joined = df.join(centre, list(by)) if by else df.crossJoin(F.broadcast(centre))  # one row
    return joined.groupBy(*by, "median").agg((F.median(F.abs(F.col(value) - F.col("median"))) * MAD_SCALE).alias("mad"))


def robust_z(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "z") -> DataFrame:
    """Distance from the median in scaled deviations; null where the deviation is 0."""
    scale = mad(df, by, value)
    joined = df.join(scale, list(by)) if by else df.crossJoin(F.broadcast(scale))
    return joined.withColumn(name, F.try_divide(F.col(value) - F.col("median"), F.col("mad"))).drop("median", "mad")


def line_fit(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares slope, intercept and coefficient of determination."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def residuals(df: DataFrame, fit: DataFrame, y: str, x: str, by: Sequence[str] = (), name: str = "residual") -> DataFrame:
    """What a fit leaves; without ``by`` the fit is one row."""
    f = fit.select(*by, "slope", "intercept")
    joined = df.join(f, list(by)) if by else df.crossJoin(F.broadcast(f))
    return joined.withColumn(name, F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))).drop("slope", "intercept")


def moments(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Sums from which means, variances and correlations follow, and which add up over parts."""
    a, b = F.col(x), F.col(y)
    return df.filter(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )


def pearson_of_moments() -> Column:
    """Correlation from :func:`moments`; null if a side is constant."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(F.lit(0.0), n * sxx - sx * sx)) * F.sqrt(F.greatest(F.lit(0.0), n * syy - sy * sy)))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null, not an error, if a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def counts_with_zeros(df: DataFrame, dimension: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Count for every key of ``dimension``, also those that have no rows."""
    return dimension.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def share_of(value: str, by: Sequence[str]) -> Column:
    """Part of its group's total; null if that is 0."""
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by)))


def split_difference(df: DataFrame, by: Sequence[str], value: str, flag: str) -> DataFrame:
    """Mean of flagged rows less mean of others; null if a side is empty."""
    return df.groupBy(*by).agg((F.avg(F.when(F.col(flag), F.col(value))) - F.avg(F.when(~F.col(flag), F.col(value)))).alias("difference"))


def size_factors(counts: DataFrame, gene: str, sample: str, value: str) -> DataFrame:
    """Median-of-ratios size factors: over genes present in all samples, counts over their geometric mean."""
    n = counts.select(sample).distinct().count()
    mean = counts.filter(F.col(value) > 0).groupBy(gene).agg(F.avg(F.ln(value)).alias("_log_mean"), F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == n)
    return counts.join(mean, gene).groupBy(sample).agg(F.median(F.col(value) / F.exp("_log_mean")).alias("size_factor"))


def cosine(df: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """Cosine of each pair of rows of a long matrix, ``a < b``; rows of zeros have none."""
    unit = df.withColumn("_u", F.try_divide(F.col(value), F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(row)))))
    a = unit.select(F.col(row).alias("a"), feature, F.col("_u").alias("x"))
    b = unit.select(F.col(row).alias("b"), feature, F.col("_u").alias("y"))
    return a.join(b, feature).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def correlations(df: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """Pearson correlation of each pair of rows over the features that both have."""
    a = df.select(F.col(row).alias("a"), feature, F.col(value).alias("x"))
    b = df.select(F.col(row).alias("b"), feature, F.col(value).alias("y"))
    return a.join(b, feature).filter("a < b").groupBy("a", "b").agg(pearson("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def log_normalised(df: DataFrame, cell: str, value: str, scale: float = 1e4, name: str = "log_norm") -> DataFrame:
    """``log1p`` of a value's share of its cell, times ``scale``."""
    return df.withColumn(name, F.log1p(F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(cell))) * scale))


def dense_mean(df: DataFrame, cells: DataFrame, cell: str, group: str, feature: str, value: str) -> DataFrame:
    """Mean of a sparse matrix by group and feature: missing entries are zeros, so sums are over all cells."""
    size = cells.groupBy(group).agg(F.countDistinct(cell).alias("_n"))
    sums = df.join(cells, cell).groupBy(group, feature).agg(F.sum(value).alias("_s"))
    return sums.join(size, group).select(group, feature, (F.col("_s") / F.col("_n")).alias("mean"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a share's Wilson interval."""
    p, zz = F.try_divide(k, n), F.lit(z * z)
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (middle - half) / (1 + zz / n), (middle + half) / (1 + zz / n)


def log_ratio_interval(a: Column, b: Column, z: float = 1.959963984540054, pseudo: float = 0.5) -> tuple[Column, Column, Column]:
    """Log of the ratio of two counts, and bounds."""
    ratio, se = F.ln((a + pseudo) / (b + pseudo)), F.sqrt(1 / (a + pseudo) + 1 / (b + pseudo))
    return ratio, ratio - z * se, ratio + z * se


def effect_size(df: DataFrame, group: str, first: object, second: object, value: str) -> DataFrame:
    """Group means, deviations, pooled deviation and Cohen's d of two groups."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(
        F.count(of(first)).alias("n1"), F.count(of(second)).alias("n2"), F.avg(of(first)).alias("mean1"), F.avg(of(second)).alias("mean2"),
        F.stddev_samp(of(first)).alias("sd1"), F.stddev_samp(of(second)).alias("sd2"),
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("sd1") ** 2 + (F.col("n2") - 1) * F.col("sd2") ** 2) / (F.col("n1") + F.col("n2") - 2))
    return s.withColumn("pooled_sd", pooled).withColumn("d", F.try_divide(F.col("mean1") - F.col("mean2"), F.col("pooled_sd")))


def jackknife(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Mean without each unit, from totals less the unit's own, so nothing is multiplied."""
    per = df.groupBy(unit).agg(F.sum(value).alias("_own"), F.count(value).alias("_own_n"))
    total = df.agg(F.sum(value).alias("_all"), F.count(value).alias("_all_n"))
    return per.crossJoin(F.broadcast(total)).select(unit, F.try_divide(F.col("_all") - F.col("_own"), F.col("_all_n") - F.col("_own_n")).alias("mean_without"))


def best_method(df: DataFrame, method: str, got: str, want: str) -> DataFrame:
    """Root mean square error of each method; the smallest is marked."""
    rmse = df.groupBy(method).agg(F.sqrt(F.avg((F.col(got) - F.col(want)) ** 2)).alias("rmse"))
    least = rmse.agg(F.min_by(method, F.struct("rmse", method)).alias("_best"))
    return rmse.crossJoin(F.broadcast(least)).select(method, "rmse", (F.col(method) == F.col("_best")).alias("best"))


def softmax(score: str, by: Sequence[str]) -> Column:
    """Confidence of a score among its group, safe for large scores."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def row_z(value: str, by: Sequence[str]) -> Column:
    """Population z-score in a group; null if all are equal."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def floored_z(df: DataFrame, row: str, value: str, name: str = "z") -> DataFrame:
    """Row z-score whose deviation is at least the median of all rows' deviations."""
    per = df.groupBy(row).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    floor = per.agg(F.median("_s").alias("_f"))
    return df.join(per, row).crossJoin(F.broadcast(floor)).withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.greatest("_s", "_f"))).drop("_m", "_s", "_f")


def swap_gain(similarity: DataFrame, item: str, label: str, value: str) -> DataFrame:
    """For pairs of items, how much better each fits the other's label than its own: the smaller of both gains."""
    own = similarity.filter(F.col(item) == F.col(label)).select(F.col(item).alias("k"), F.col(value).alias("own"))
    cross = similarity.select(F.col(item).alias("a"), F.col(label).alias("b"), F.col(value).alias("ab")).filter("a <> b")
    back = cross.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("ab").alias("ba"))
    pairs = cross.filter("a < b").join(back, ["a", "b"])
    pairs = pairs.join(own.select(F.col("k").alias("a"), F.col("own").alias("aa")), "a").join(own.select(F.col("k").alias("b"), F.col("own").alias("bb")), "b")
    return pairs.select("a", "b", F.least(F.col("ab") - F.col("aa"), F.col("ba") - F.col("bb")).alias("swap_score"))


def swap_directions(scores: DataFrame, markers: DataFrame, item: str, feature: str, value: str) -> DataFrame:
    """For pairs of items, how well each carries the other's markers: ``a, b, cross, win_rate, n, swap_score``.

    ``markers`` has the features that mark an item. ``cross`` is the smaller of
    both means of the one's markers in the other; ``win_rate`` the share of
    the markers of both that are higher in the other than in their own item; the
    score is ``cross + 2 win_rate - 1``. Markers without a value on either side do not count.
    """
    z = scores.select(F.col(feature).alias("f"), F.col(item).alias("i"), F.col(value).alias("v")).filter("v IS NOT NULL")
    own = markers.select(F.col(item).alias("o"), F.col(feature).alias("f")).distinct()
    held = own.join(z.withColumnRenamed("i", "o").withColumnRenamed("v", "self"), ["o", "f"])
    met = held.join(z, "f").filter("i <> o").groupBy("o", "i").agg(F.avg("v").alias("m"), F.count_if(F.col("v") > F.col("self")).alias("w"), F.count(F.lit(1)).alias("n"))
    one = met.filter("o < i").select(F.col("o").alias("a"), F.col("i").alias("b"), F.col("m").alias("ma"), F.col("w").alias("wa"), F.col("n").alias("na"))
    two = met.filter("o > i").select(F.col("i").alias("a"), F.col("o").alias("b"), F.col("m").alias("mb"), F.col("w").alias("wb"), F.col("n").alias("nb"))
    win = (F.col("wa") + F.col("wb")) / (F.col("na") + F.col("nb"))
    pairs = one.join(two, ["a", "b"]).select("a", "b", F.least("ma", "mb").alias("cross"), win.alias("win_rate"), (F.col("na") + F.col("nb")).alias("n"))
    return pairs.withColumn("swap_score", F.col("cross") + 2 * F.col("win_rate") - 1)


def stratified_sample(df: DataFrame, group: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of each group without replacement, by a hash of keys; the same rows in each run."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("_n", n).withColumn("_k", k).filter(F.col("_k") <= F.ceil(F.col("_n") * share)).drop("_n", "_k")


def thresholds(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Rows at or below each of several thresholds, in one pass."""
    each = F.array(*[F.struct(F.lit(float(c)).alias("cut"), (F.col(value) <= c).alias("hit")) for c in cuts])
    return df.select(F.explode(each).alias("c")).groupBy("c.cut").agg(F.count_if("c.hit").alias("hits"), F.count(F.lit(1)).alias("n")).withColumn("share", F.col("hits") / F.col("n"))


def fold_change(df: DataFrame, by: Sequence[str], group: str, first: object, second: object, value: str, pseudo: float = 1.0) -> DataFrame:
    """Means of two groups, their ratio and its binary logarithm, with a pseudocount; null if a group is empty."""
    a, b = (F.avg(F.when(F.col(group) == g, F.col(value))) for g in (first, second))
    means = df.groupBy(*by).agg(a.alias("mean_first"), b.alias("mean_second"))
    ratio = (F.col("mean_first") + pseudo) / (F.col("mean_second") + pseudo)
    return means.withColumn("fold_change", ratio).withColumn("log2_fold_change", F.log2(ratio))


def negative_binomial_wald(counts: DataFrame, gene: str, sample: str, value: str, groups: DataFrame, group: str, first: object, second: object) -> DataFrame:
    """Differential expression between two groups of samples, for each gene.

    Counts are divided by median-of-ratios size factors. The dispersion is that
    of moments, pooled over the groups; the test is Wald's on the log ratio of
    the group means with negative binomial weights. A gene without counts in a
    group has nulls. Missing entries are zeros.
    """
    factors = size_factors(counts, gene, sample, value)
    design = groups.filter(F.col(group).isin(first, second)).select(sample, (F.col(group) == first).alias("_first")).join(factors, sample)
    cells = counts.select(gene).distinct().join(design)  # every gene meets the samples, which are few
    full = cells.join(counts.select(gene, sample, F.col(value).cast("double").alias("_v")), [gene, sample], "left").withColumn("_k", F.coalesce("_v", F.lit(0.0)) / F.col("size_factor"))
    own = full.groupBy(gene, "_first").agg(F.avg("_k").alias("_m"), F.var_samp("_k").alias("_s2"), F.count(F.lit(1)).alias("_n"), F.collect_list("size_factor").alias("_f"), F.avg(1 / F.col("size_factor")).alias("_inv"))
    # a mean's variance is m / f + a m^2, so a follows from both
    own = own.withColumn("_a", F.when(F.col("_m") > 0, (F.col("_s2") - F.col("_m") * F.col("_inv")) / (F.col("_m") * F.col("_m"))))
    side = lambda flag, c: F.max(F.when(F.col("_first") == flag, F.col(c)))
    wide = own.groupBy(gene).agg(*[side(flag, c).alias(f"{c}{k}") for k, flag in enumerate((True, False)) for c in ("_m", "_n", "_f")], (F.sum(F.col("_a") * (F.col("_n") - 1)) / F.sum(F.when(F.col("_a").isNotNull(), F.col("_n") - 1))).alias("_alpha"))
    alpha = F.greatest(F.lit(1e-8), F.coalesce("_alpha", F.lit(0.0)))
    weight = lambda k: F.aggregate(f"_f{k}", F.lit(0.0), lambda total, f: total + F.col(f"_m{k}") * f / (1 + F.col("dispersion") * F.col(f"_m{k}") * f))
    out = wide.withColumn("dispersion", alpha).withColumns({"_w0": weight(0), "_w1": weight(1)})
    both = (F.col("_m0") > 0) & (F.col("_m1") > 0)
    log = F.when(both, F.ln(F.col("_m0") / F.col("_m1")))
    se = F.when(both, F.sqrt(1 / F.col("_w0") + 1 / F.col("_w1")))
    return out.select(gene, ((F.col("_m0") * F.col("_n0") + F.col("_m1") * F.col("_n1")) / (F.col("_n0") + F.col("_n1"))).alias("base_mean"), "dispersion", (log / F.ln(F.lit(2.0))).alias("log2_fold_change"), (log / se).alias("wald"))


def conditional(df: DataFrame, given: Sequence[str], event: Sequence[str], weight: str | None = None) -> DataFrame:
    """Share of each event among the rows (or the sums of ``weight``) of what is given, from pooled sums."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    pooled = df.groupBy(*given, *event).agg(amount.alias("joint"))
    return pooled.withColumn("probability", share_of("joint", given))


def vote_share(df: DataFrame, unit: str, feature: str, candidate: str, score: str) -> DataFrame:
    """Each feature votes for its unit's candidate of the highest score, the first by name of equals: votes and their share."""
    order = Window.partitionBy(unit, feature).orderBy(F.desc(score), candidate)
    won = df.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return won.groupBy(unit, candidate).agg(F.count(F.lit(1)).alias("votes")).withColumn("share", share_of("votes", [unit]))


def cell_quality(counts: DataFrame, cell: str, gene: str, value: str, marked: Column) -> DataFrame:
    """Library size, detected genes and the share of ``marked`` genes (such as mitochondrial ones) of each cell."""
    own = F.sum(F.when(marked, F.col(value)).otherwise(0))
    return counts.groupBy(cell).agg(F.sum(value).alias("library"), F.countDistinct(F.when(F.col(value) > 0, F.col(gene))).alias("detected"), F.try_divide(own, F.sum(value)).alias("marked_share"))


def split_half(df: DataFrame, group: str, half: str, feature: str, value: str) -> DataFrame:
    """Correlation of each group's mean profile in one half (``half`` is 0) with every group's in the other: ``a, b, r``.

    A group that is told apart matches itself best; shuffled halves give the
    null to compare with.
    """
    means = df.groupBy(group, half, feature).agg(F.avg(value).alias("_m"))
    a = means.filter(F.col(half) == 0).select(F.col(group).alias("a"), feature, F.col("_m").alias("x"))
    b = means.filter(F.col(half) == 1).select(F.col(group).alias("b"), feature, F.col("_m").alias("y"))
    return a.join(b, feature).groupBy("a", "b").agg(pearson("x", "y").alias("r"))


def winner_counts(df: DataFrame, candidate: str, feature: str, score: str, rounds: int) -> DataFrame:
    """How often each candidate has the highest sum of scores when features are drawn with replacement.

    A feature's number of draws in a round comes from a digest of both, in
    shares near those of a Poisson variable of mean one: so nothing is collected, and
    each run gives the same.
    """
    digit = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("round").cast("string"), F.col(feature).cast("string"))), 1, 1), 16, 10).cast("int")
    drawn = F.when(digit < 6, 0).when(digit < 12, 1).when(digit < 15, 2).otherwise(3)
    each = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", drawn)
    sums = each.groupBy("round", candidate).agg(F.sum(F.col("_w") * F.col(score)).alias("_s"))
    won = sums.withColumn("_n", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("_s"), candidate))).filter("_n = 1")
    return won.groupBy(candidate).agg(F.count(F.lit(1)).alias("wins"))


def pearson_without(df: DataFrame, by: Sequence[str], feature: str, x: str, y: str) -> DataFrame:
    """Correlation of each group with one feature left out at a time, from sums less the feature's own."""
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    own = moments(df, [*by, feature], x, y)
    total = moments(df, by, x, y).select(*by, *[F.col(c).alias(f"_{c}") for c in names])
    joined = own.join(total, list(by)) if by else own.crossJoin(F.broadcast(total))  # one row
    left = joined.select(*by, feature, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in names])
    return left.select(*by, feature, pearson_of_moments().alias("r"))


def within_effect(df: DataFrame, y: str, group: str, covariate: str) -> DataFrame:
    """Effect of a 0/1 group on ``y`` beside one level of the covariate for each of its values: least squares of what differs from the level's means."""
    w = Window.partitionBy(covariate)
    apart = df.select((F.col(y) - F.avg(y).over(w)).alias("_y"), (F.col(group) - F.avg(group).over(w)).alias("_g"))
    return apart.agg(F.try_divide(F.sum(F.col("_y") * F.col("_g")), F.sum(F.col("_g") * F.col("_g"))).alias("effect"), F.count(F.lit(1)).alias("n"))


def k_means(df: DataFrame, key: str, features: Sequence[str], centres: Sequence[Sequence[float]], rounds: int) -> DataFrame:
    """Lloyd's iterations from given centres: ``key, cluster``; the first of equally near centres.

    Centres are few and go with the plan; each round is one grouped
    aggregation, and a cluster that loses all its rows keeps its centre.
    """
    def nearest(at: Sequence[Sequence[float]]) -> Column:
        far = [sum(((F.col(f) - float(c)) ** 2 for f, c in zip(features[1:], centre[1:], strict=True)), (F.col(features[0]) - float(centre[0])) ** 2) for centre in at]
        return F.array_position(F.array(*far), F.least(*far) if len(far) > 1 else far[0]).cast("int") - 1

    at = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        found = df.groupBy(nearest(at).alias("_c")).agg(*[F.avg(f).alias(f) for f in features]).collect()  # a row for each centre
        for r in found:
            at[r["_c"]] = [r[f] for f in features]
    return df.select(key, nearest(at).alias("cluster"))
