"""Queries of mixtures, resampling, counts models, latent axes and assignments, with SQL that recomputes their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import axes, counts, mixtures, resampling
from . import tasks
from .registry import Tables, query

#: Profiles of the regions over the brands, in a pattern of both numbers.
_PROFILES = "SELECT r_regionkey AS kind, b, CAST(1 + (r_regionkey * 7 + b * b * 3 + r_regionkey * b * 5) % 17 AS DOUBLE) AS v FROM region, (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS b FROM part)"
#: What suppliers shipped of the brands, the brands in a pattern of both numbers.
_SHIPPED = "SELECT l_suppkey AS spot, CAST(substr(p_brand, 7) AS BIGINT) AS b, CAST(sum(l_quantity * ((l_suppkey * 3 + CAST(substr(p_brand, 7) AS BIGINT) * l_suppkey) % 7)) AS DOUBLE) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def _brand() -> F.Column:
    return F.substring("p_brand", 7, 9).cast("long").alias("b")


def _profiles(t: Tables) -> DataFrame:
    kind, b = F.col("r_regionkey"), F.col("b")
    return t.region.join(t.part.select(_brand()).distinct(), F.lit(True)).select(kind.alias("kind"), "b", (1 + (kind * 7 + b * b * 3 + kind * b * 5) % 17).cast("double").alias("v"))  # a few regions and brands


def _shipped(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select("p_partkey", _brand()), F.col("l_partkey") == F.col("p_partkey"))
    v = F.col("l_quantity") * ((F.col("l_suppkey") * 3 + F.col("b") * F.col("l_suppkey")) % 7)
    return rows.groupBy(F.col("l_suppkey").alias("spot"), "b").agg(F.sum(v).cast("double").alias("v"))


def _det3(r: tuple[str, str, str], *rows: tuple[str, str, str]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = r, *rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _lattice(profiles: str, spots: str) -> str:
    """SQL of all singles, pairs and triplets: their own fits by determinants, and where a weight would fall below 0 the best face."""
    g = {(i, j): f"g{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    row = lambda k, r: tuple(f"r{k}" if j == r else g[k, j] for j in range(3))
    d = _det3(*[row(k, -1) for k in range(3)])
    w = [f"{_det3(*[row(k, j) for k in range(3)])} / {d}" for j in range(3)]
    return f"""
p AS ({profiles}), y AS ({spots}), gm AS (SELECT a.kind AS i, c.kind AS j, sum(a.v * c.v) AS g FROM p a JOIN p c USING (b) GROUP BY ALL), yy AS (SELECT spot, sum(v * v) AS yy FROM y GROUP BY 1), r AS (SELECT spot, kind, sum(y.v * p.v) AS r FROM y JOIN p USING (b) GROUP BY ALL),
s1 AS (SELECT spot, kind AS i, yy, r, g, greatest(r / g, 0) AS w, yy - greatest(r, 0) * greatest(r, 0) / g AS res FROM r JOIN gm ON i = kind AND j = kind JOIN yy USING (spot)),
q2 AS (SELECT a.spot, a.i AS i, c.i AS j, a.yy, a.r AS r0, c.r AS r1, a.g AS g00, c.g AS g11, m.g AS g01, a.res AS f0, c.res AS f1 FROM s1 a JOIN s1 c ON a.spot = c.spot AND a.i < c.i JOIN gm m ON m.i = a.i AND m.j = c.i),
w2 AS (SELECT *, (r0 * g11 - r1 * g01) / (g00 * g11 - g01 * g01) AS w0, (r1 * g00 - r0 * g01) / (g00 * g11 - g01 * g01) AS w1 FROM q2),
s2 AS (SELECT *, CASE WHEN w0 > 0 AND w1 > 0 THEN yy - w0 * r0 - w1 * r1 ELSE least(f0, f1) END AS res FROM w2),
q3 AS (SELECT a.spot, a.i AS i, a.j AS j, c.j AS k, a.yy, a.r0, a.r1, c.r1 AS r2, a.g00, a.g01, a.g11, c.g01 AS g02, c.g11 AS g22, e.g01 AS g12, least(a.res, c.res, e.res) AS f FROM s2 a JOIN s2 c ON a.spot = c.spot AND a.i = c.i AND a.j < c.j JOIN s2 e ON e.spot = a.spot AND e.i = a.j AND e.j = c.j),
w3 AS (SELECT *, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2 FROM q3),
s3 AS (SELECT *, CASE WHEN w0 > 0 AND w1 > 0 AND w2 > 0 THEN yy - w0 * r0 - w1 * r1 - w2 * r2 ELSE f END AS res FROM w3),
lattice AS (SELECT spot, 1 AS size, [i] AS kinds, res, yy FROM s1 UNION ALL SELECT spot, 2, [i, j], res, yy FROM s2 UNION ALL SELECT spot, 3, [i, j, k], res, yy FROM s3)"""


@query(f"""
WITH {_lattice(_PROFILES, _SHIPPED)}
SELECT spot, CAST(size AS INTEGER) AS size, array_to_string(kinds, ',') AS kinds, CASE WHEN yy > 0 THEN round(greatest(1 - res / yy, 0), 7) END AS r2 FROM lattice""")
def subset_residuals(t: Tables) -> DataFrame:
    """Residual sums of all singles, pairs and triplets of profiles, of one Gram matrix."""
    fits = mixtures.subset_fits(_shipped(t), _profiles(t), "spot", "b", "v", "kind", 3, all_subsets=True)
    return fits.select("spot", "size", F.array_join(F.col("kinds").cast("array<string>"), ",").alias("kinds"), F.when(F.col("r2").isNotNull(), F.round(F.greatest("r2", F.lit(0.0)), 7)).alias("r2"))


@query(f"""
WITH {_lattice(_PROFILES, _SHIPPED)}, b AS (SELECT spot, size, kinds, res / yy AS u, row_number() OVER (PARTITION BY spot, size ORDER BY res, kinds) AS n FROM lattice)
SELECT spot, array_to_string(any_value(kinds) FILTER (size = 1), ',') AS pure, array_to_string(any_value(kinds) FILTER (size = 2), ',') AS pair, round(any_value(u) FILTER (size = 1) - any_value(u) FILTER (size = 2), 7) AS pair_gain, round(any_value(u) FILTER (size = 2) - any_value(u) FILTER (size = 3), 7) AS triplet_gain
FROM b WHERE n = 1 GROUP BY spot""")
def selected_subsets(t: Tables) -> DataFrame:
    """The best profile and pair of each spot, and what one more kind gains."""
    best = mixtures.subset_fits(_shipped(t), _profiles(t), "spot", "b", "v", "kind", 3)
    at = lambda k, c: F.max(F.when(F.col("size") == k, F.col(c)))
    wide = best.withColumn("names", F.array_join(F.col("kinds").cast("array<string>"), ",")).groupBy("spot").agg(at(1, "names").alias("pure"), at(2, "names").alias("pair"), *[at(k, "r2").alias(f"r{k}") for k in (1, 2, 3)])
    return wide.select("spot", "pure", "pair", F.round(F.col("r2") - F.col("r1"), 7).alias("pair_gain"), F.round(F.col("r3") - F.col("r2"), 7).alias("triplet_gain"))


_BOUGHT = "SELECT o_custkey AS item, CAST(substr(p_brand, 7) AS BIGINT) AS b, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


_NEAR = f"""
y AS ({_SHIPPED}), c AS ({_BOUGHT}), f AS (SELECT DISTINCT b FROM (SELECT b FROM y UNION ALL SELECT b FROM c)), n AS (SELECT count(*) AS n FROM f),
ys AS (SELECT spot, sum(v) AS s, sum(v * v) AS ss FROM y GROUP BY 1), cs AS (SELECT item, sum(v) AS s, sum(v * v) AS ss FROM c GROUP BY 1), x AS (SELECT spot, item, sum(y.v * c.v) AS xy FROM y JOIN c USING (b) GROUP BY ALL),
r AS (SELECT ys.spot, cs.item, round((n * coalesce(xy, 0) - ys.s * cs.s) / sqrt((n * ys.ss - ys.s * ys.s) * (n * cs.ss - cs.s * cs.s)), 9) AS r FROM ys JOIN cs ON true JOIN n ON true LEFT JOIN x ON x.spot = ys.spot AND x.item = cs.item WHERE n * ys.ss > ys.s * ys.s AND n * cs.ss > cs.s * cs.s),
k AS (SELECT spot, item, row_number() OVER (PARTITION BY spot ORDER BY r DESC, item) AS k FROM r)"""


@query(f"""
WITH {_NEAR.strip()}
SELECT spot, c_mktsegment AS label, count(*) AS votes, round(count(*) / sum(count(*)) OVER (PARTITION BY spot), 6) AS share FROM k JOIN customer ON item = c_custkey WHERE k <= 100 GROUP BY 1, 2""")
def nearest_votes(t: Tables) -> DataFrame:
    """Labels of the hundred rows that correlate best with each spot, found by blocks of products."""
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", _brand()), F.col("l_partkey") == F.col("p_partkey"))
    bought = rows.groupBy(F.col("o_custkey").alias("item"), "b").agg(F.sum("l_quantity").cast("double").alias("v"))
    labelled = bought.join(t.customer.select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("label")), "item")
    return mixtures.neighbour_votes(_shipped(t), labelled, "spot", "item", "b", "v", "label").withColumn("share", F.round("share", 6))


# -------------------------------------------------------------- resampling


def _u(*parts: str) -> str:
    """SQL: a number from [0, 1) that a digest of the parts gives."""
    return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0"


def _drawn(u: str) -> str:
    """SQL: the Poisson variable of mean one at which a uniform number stands."""
    return "(" + " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in resampling._POISSON) + ")"


@query(f"""
WITH v AS (SELECT n_regionkey, s_nationkey AS k, sum(s_acctbal) AS s, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT n_regionkey, r, s, n, CASE WHEN r = 0 THEN 1 ELSE {_drawn(_u("'b'", 'r', 'k'))} END AS w FROM v, range(0, 201) x(r)),
m AS (SELECT n_regionkey, r, CASE WHEN sum(w) > 0 THEN sum(w * s) / sum(w * n) END AS m FROM w GROUP BY ALL)
SELECT n_regionkey, round(any_value(m) FILTER (r = 0), 6) AS estimate, round(quantile_cont(m, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (r > 0), 6) AS high, round(avg(m) FILTER (r > 0), 6) AS mean, count(m) FILTER (r > 0) AS rounds FROM m GROUP BY 1""")
def bootstrap_bounds(t: Tables) -> DataFrame:
    """A mean of each region and its bounds when whole nations are drawn with replacement."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    values = resampling.bootstrap(rows, "s_nationkey", {"s": F.sum("s_acctbal"), "n": F.count(F.lit(1))}, F.col("s") / F.col("n"), 200, ["n_regionkey"])
    found = resampling.bounds(values.filter("round > 0"), ["n_regionkey"], "value")
    joined = values.filter("round = 0").select("n_regionkey", F.col("value").alias("estimate")).join(found, "n_regionkey")
    return joined.select("n_regionkey", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high", "mean")], "rounds")


@query(f"""
WITH v AS (SELECT c_nationkey % 5 AS g, c_custkey AS k, CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS f, c_acctbal AS v FROM customer),
t AS (SELECT g, count(*) AS n, sum(f) AS k, sum(v) AS t, sum(v * f) AS s FROM v GROUP BY 1), p AS (SELECT g, r, v, row_number() OVER (PARTITION BY g, r ORDER BY {_u("'p'", 'r', 'k')}, k) AS i FROM v, range(1, 101) x(r)),
x AS (SELECT g, r, sum(v) FILTER (i <= k) AS x FROM p JOIN t USING (g) GROUP BY ALL), d AS (SELECT g, x / k - (t - x) / (n - k) AS d, s / k - (t - s) / (n - k) AS o FROM x JOIN t USING (g))
SELECT g, round(o, 8) AS observed, round(avg(d), 8) AS null_mean, round(stddev_samp(d), 7) AS null_sd, round((count(*) FILTER (d >= o - 1e-12) + 1) / (count(*) + 1), 8) AS p, round((o - avg(d)) / stddev_samp(d), 8) AS z FROM d GROUP BY g, o""")
def permuted_segments(t: Tables) -> DataFrame:
    """Differences of means against flags dealt out anew, one-sided, with one added."""
    v = t.customer.select((F.col("c_nationkey") % 5).alias("g"), "c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("f"), "c_acctbal")
    out = resampling.permutation_test(v, "c_custkey", "f", "c_acctbal", 100, ["g"])
    return out.select("g", F.round("null_sd", 7).alias("null_sd"), *[F.round(c, 8).alias(c) for c in ("observed", "null_mean", "z", "p")])


@query(f"""
WITH s AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY p_type ORDER BY p_brand) / sum(n) OVER (PARTITION BY p_type) AS hi, (sum(n) OVER (PARTITION BY p_type ORDER BY p_brand) - n) / sum(n) OVER (PARTITION BY p_type) AS lo FROM s),
d AS (SELECT m.p_type, r, {_u("'m'", 'm.p_type', 'r', 'i')} AS u FROM (SELECT DISTINCT p_type FROM s) m, range(1, 41) x(r), range(0, 200) y(i)),
k AS (SELECT p_type, r, p_brand, count(*) AS n FROM d JOIN c USING (p_type) WHERE u >= lo AND u < hi GROUP BY ALL)
SELECT p_type, p_brand, round(quantile_cont(n, 0.025), 6) AS low, round(quantile_cont(n, 0.975), 6) AS high, round(avg(n), 6) AS mean, count(*) AS rounds FROM k GROUP BY 1, 2""")
def drawn_shares(t: Tables) -> DataFrame:
    """Counts of categories in draws from their own shares."""
    shares = t.part.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    draws = resampling.multinomial(shares, "p_brand", "n", 200, 40, ["p_type"])
    found = resampling.bounds(draws, ["p_type", "p_brand"], "n")
    return found.select("p_type", "p_brand", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean")], "rounds")


_MIXED = "SELECT b, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM (SELECT b, max(v) FILTER (kind = 0) AS p, max(v) FILTER (kind = 1) AS q FROM ({0}) GROUP BY 1)".format(_PROFILES)
#: SQL: the weight of the likeliest mixture of two profiles, lists ``v, p, q``, by halving the interval of the slope's zero.
_LIKELIEST = "list_reduce(list_transform(range(1, 46), lambda i: CAST(i AS DOUBLE)), lambda w, i: w + CASE WHEN list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * (p[k] - q[k]) / ((w + pow(2, -i)) * p[k] + (1 - w - pow(2, -i)) * q[k]))) > 0 THEN pow(2, -i) ELSE 0.0 END, CAST(0 AS DOUBLE))"


@query(f"""
WITH z AS ({_MIXED}), o AS (SELECT b, sum(v) AS v FROM ({_SHIPPED}) GROUP BY 1), l AS (SELECT list(v ORDER BY b) AS v, list(p ORDER BY b) AS p, list(q ORDER BY b) AS q FROM o JOIN z USING (b)), f AS (SELECT {_LIKELIEST} AS w FROM l),
c AS (SELECT b, sum(w * p + (1 - w) * q) OVER (ORDER BY b) AS hi, sum(w * p + (1 - w) * q) OVER (ORDER BY b) - (w * p + (1 - w) * q) AS lo FROM z, f), e AS (SELECT b, CASE WHEN b = max(b) OVER () THEN 2 ELSE hi END AS hi, CASE WHEN b = min(b) OVER () THEN 0 ELSE lag(hi) OVER (ORDER BY b) END AS lo FROM c),
d AS (SELECT r, {_u("'m'", 'r', 'i')} AS u FROM range(1, 31) x(r), range(0, 500) y(i)), k AS (SELECT r, b, CAST(count(*) AS DOUBLE) AS v FROM d JOIN e ON u >= lo AND u < hi GROUP BY ALL),
m AS (SELECT r, list(v ORDER BY b) AS v, list(p ORDER BY b) AS p, list(q ORDER BY b) AS q FROM k JOIN z USING (b) GROUP BY 1), g AS (SELECT r, {_LIKELIEST} AS w FROM m)
SELECT round((SELECT w FROM f), 5) AS estimate, round(quantile_cont(w, 0.025), 5) AS low, round(quantile_cont(w, 0.975), 5) AS high, count(*) AS rounds FROM g""")
def mixture_bounds(t: Tables) -> DataFrame:
    """The likeliest weight of a profile, and its bounds over counts drawn from the fitted mixture."""
    profiles = _profiles(t).filter("kind < 2").select("b", F.concat(F.lit("k"), "kind").alias("kind"), "v")
    counts = _shipped(t).groupBy("b").agg(F.sum("v").alias("v"))
    fit, drawn = resampling.mixture_bootstrap(counts, profiles, "b", "v", "kind", 500, 30)
    found = resampling.bounds(drawn.filter("kind = 'k0'"), ["kind"], "weight").join(fit, "kind")
    return found.select(F.round("weight", 5).alias("estimate"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "rounds")


@query(f"""
WITH s AS (SELECT c_nationkey AS u, c_mktsegment AS c, o_orderpriority AS f, sum(CAST(round(o_totalprice) AS BIGINT)) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT u, c, r, sum(w * s) AS t, sum(w) AS d FROM (SELECT *, {_drawn(_u("'v'", 'r', 'f'))} AS w FROM s, range(1, 61) x(r)) GROUP BY ALL), b AS (SELECT u, c, row_number() OVER (PARTITION BY u, r ORDER BY t DESC, c) AS k FROM t WHERE d > 0)
SELECT u AS c_nationkey, c AS c_mktsegment, count(*) AS wins, round(count(*) / sum(count(*)) OVER (PARTITION BY u), 6) AS confidence FROM b WHERE k = 1 GROUP BY 1, 2""")
def vote_confidence(t: Tables) -> DataFrame:
    """How often each candidate of a unit wins when features are drawn with replacement."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("s", F.round("o_totalprice").cast("long"))
    return resampling.vote_confidence(rows, "c_nationkey", "c_mktsegment", "o_orderpriority", "s", 60).withColumn("confidence", F.round("confidence", 6))


# ------------------------------------------------------------------- counts

#: Twelve samples in two arms over genes; every fifth gene has one count that is far out.
_ARMS = "SELECT p_brand || p_type AS gene, l_suppkey % 12 AS sample, CAST(sum(l_quantity) * CASE WHEN p_size % 5 = 0 AND l_suppkey % 12 = 3 THEN 40 ELSE 1 END AS DOUBLE) AS n FROM lineitem JOIN (SELECT p_partkey, p_brand, p_type, min(p_size) OVER (PARTITION BY p_brand, p_type) AS p_size FROM part) ON l_partkey = p_partkey GROUP BY p_brand, p_type, p_size, l_suppkey % 12"
#: SQL: the mean of a group's scaled counts ``ks`` with factors ``fs`` that makes them likeliest under dispersion ``alpha``.
_MEAN = "list_reduce(list_transform(range(0, 41), lambda i: CASE WHEN i = 0 THEN list_sum(ks) / list_sum(fs) ELSE 0.0 END), lambda m, i: m * exp(list_sum(list_transform(range(1, len(ks) + 1), lambda j: (ks[j] - m * fs[j]) / (1 + alpha * m * fs[j]))) / list_sum(list_transform(range(1, len(ks) + 1), lambda j: m * fs[j] / (1 + alpha * m * fs[j])))))"


def _fitted(name: str, source: str) -> str:
    """SQL: dispersions and fitted means of two groups of counts ``gene, sample, k, f``."""
    return f"""
{name}a AS (SELECT gene, least(greatest(10, count(*)), greatest(1e-8, sum((pow(k / f - m, 2) - m / f) / (m * m)) / (count(*) - 2))) AS alpha FROM (SELECT *, greatest(avg(k / f) OVER (PARTITION BY gene, sample < 6), avg(k / f) OVER (PARTITION BY gene) / 10, 1e-9) AS m FROM {source}) GROUP BY 1),
{name}g AS (SELECT gene, sample < 6 AS first, list(k ORDER BY sample) AS ks, list(f ORDER BY sample) AS fs FROM {source} GROUP BY ALL),
{name}m AS (SELECT gene, first, alpha, {_MEAN} AS m, fs FROM {name}g JOIN {name}a USING (gene)),
{name} AS (SELECT gene, first, alpha, m, list_sum(list_transform(fs, lambda f: m * f / (1 + alpha * m * f))) AS w FROM {name}m)"""


_NORMAL = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(abs(z) + i * 0.005, 2)))) * 0.005 / 3 * 2 / sqrt(2 * pi())"


@query(f"""
WITH c AS ({_ARMS}), size AS (SELECT count(DISTINCT sample) AS n, CAST(floor(0.2 * count(DISTINCT sample)) AS BIGINT) AS cut FROM c), whole AS (SELECT gene FROM c GROUP BY 1 HAVING count(*) = (SELECT n FROM size)), l AS (SELECT gene, avg(ln(n)) AS m FROM c JOIN whole USING (gene) GROUP BY 1), s AS (SELECT sample, median(n / exp(m)) AS f FROM c JOIN l USING (gene) GROUP BY 1),
k AS (SELECT g.gene, s.sample, coalesce(n, 0) AS k, f FROM (SELECT DISTINCT gene FROM c) g CROSS JOIN s LEFT JOIN c ON c.gene = g.gene AND c.sample = s.sample), {_fitted('one', 'k')},
v AS (SELECT gene, k / f AS q, f, median(k / f) OVER (PARTITION BY gene, sample < 6) AS c FROM k), b AS (SELECT gene, pow(1.4826 * median(abs(q - c)), 2) AS s2, avg(c) AS m, avg(1 / f) AS inv FROM v GROUP BY 1), u AS (SELECT gene, least(greatest(10, n), greatest(0.04, (s2 - m * inv) / (m * m))) AS robust FROM b, size),
d AS (SELECT k.*, pow(k - m * f, 2) / (m * f + robust * pow(m * f, 2)) / 2 * (m * f / (1 + alpha * m * f) / w) / pow(1 - m * f / (1 + alpha * m * f) / w, 2) AS cook FROM k JOIN one ON one.gene = k.gene AND first = (sample < 6) JOIN u ON u.gene = k.gene),
t AS (SELECT gene, list_avg(list_sort(list(k / f))[any_value(cut) + 1:any_value(n) - any_value(cut)]) AS t, max(cook) AS most_cook, count(*) FILTER (cook > 7.5) AS replaced, avg(k / f) AS base_mean FROM d, size GROUP BY 1),
r AS (SELECT d.gene, sample, f, CASE WHEN cook > 7.5 THEN t * f ELSE k END AS k FROM d JOIN t USING (gene)), {_fitted('two', 'r')},
z AS (SELECT gene, any_value(alpha) AS alpha, ln(max(m) FILTER (first) / max(m) FILTER (NOT first)) AS b, sqrt(1 / max(w) FILTER (first) + 1 / max(w) FILTER (NOT first)) AS se FROM two GROUP BY 1),
p AS (SELECT *, {_NORMAL} AS p FROM (SELECT *, b / se AS z FROM z)), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene) AS raw FROM p)
SELECT gene, round(base_mean, 4) AS base_mean, round(alpha, 7) AS dispersion, round(b / ln(2), 6) + 0.0 AS log2_fold_change, round(se / ln(2), 6) AS std_error, round(p, 7) AS p, round(least(1.0, min(raw) OVER (ORDER BY p, gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted,
  round(most_cook, 5) AS most_cook, CAST(replaced AS INTEGER) AS replaced FROM q JOIN t USING (gene)""")
def differential_model(t: Tables) -> DataFrame:
    """Log-linear count models with Cook's distances, counts that are far out replaced and fitted anew, Wald tests and adjustment."""
    far = F.min("p_size").over(Window.partitionBy("p_brand", "p_type"))
    parts = t.part.select("p_partkey", F.concat("p_brand", "p_type").alias("gene"), far.alias("size"))
    rows = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("sample", F.col("l_suppkey") % 12)
    n = F.sum("l_quantity") * F.when((F.col("size") % 5 == 0) & (F.col("sample") == 3), 40).otherwise(1)
    table = rows.groupBy("gene", "size", "sample").agg(n.alias("n"))
    design = t.supplier.select((F.col("s_suppkey") % 12).alias("sample")).distinct().withColumn("arm", (F.col("sample") < 6).cast("int"))
    out = counts.negative_binomial(table, "gene", "sample", "n", design, ["arm"], "arm", cutoff=7.5)
    return out.select("gene", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("base_mean", 4), ("dispersion", 7), ("log2_fold_change", 6), ("std_error", 6), ("p", 7), ("adjusted", 6), ("most_cook", 5))], "replaced")


# --------------------------------------------------------------------- axes

#: Rows over features with two patterns of unlike size beside what was shipped.
_LATENT = f"SELECT spot, b, v + 300 * (spot % 5) * b + 700 * (spot % 3) * (b % 4) AS v FROM ({_SHIPPED})"


def _power(g: str, start: str) -> str:
    """SQL: the leading direction of a Gram matrix, a list of lists, by repeated products."""
    product = f"list_transform({g}, lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda j: r[j] * x[j])))"
    scaled = "list_transform(y, lambda e: e / sqrt(list_sum(list_transform(y, lambda u: u * u))))"
    return f"list_reduce(list_transform(range(0, 120), lambda i: CASE WHEN i = 0 THEN {start} ELSE CAST([] AS DOUBLE[]) END), lambda x, i: list_transform([{product}], lambda y: {scaled})[1])"


_AXES = f"""
l AS ({_LATENT}), n AS (SELECT count(DISTINCT spot) AS n FROM l), m AS (SELECT b, sum(v) / any_value(n) AS m FROM l, n GROUP BY 1), x AS (SELECT s.spot, m.b, coalesce(v, 0) - m AS x FROM (SELECT DISTINCT spot FROM l) s CROSS JOIN m LEFT JOIN l ON l.spot = s.spot AND l.b = m.b),
c AS (SELECT a.b AS i, c.b AS j, sum(a.x * c.x) / any_value(n) AS c FROM x a JOIN x c USING (spot), n GROUP BY ALL), r AS (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY 1), g AS (SELECT list(r ORDER BY i) AS g, list(CAST(1 + i % 3 AS DOUBLE) ORDER BY i) AS s FROM r),
p1 AS (SELECT g, s, {_power('g', 's')} AS p FROM g), e1 AS (SELECT *, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * list_sum(list_transform(range(1, len(p) + 1), lambda j: g[i][j] * p[j])))) AS e FROM p1),
h AS (SELECT p AS p1, e AS e1, s, list_transform(range(1, len(p) + 1), lambda i: list_transform(range(1, len(p) + 1), lambda j: g[i][j] - e * p[i] * p[j])) AS g FROM e1), p2 AS (SELECT p1, e1, g, {_power('g', 's')} AS p2 FROM h),
a AS (SELECT 1 AS axis, p1 AS p FROM p2 UNION ALL SELECT 2, p2 FROM p2), d AS (SELECT axis, CASE WHEN list_max(p) >= -list_min(p) THEN p ELSE list_transform(p, lambda e: -e) END AS p FROM a)"""


@query(f"""
WITH {_AXES.strip()}, v AS (SELECT spot, list(x ORDER BY b) AS x FROM x GROUP BY 1)
SELECT spot, CAST(axis AS INTEGER) AS axis, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * x[i])), 2) + 0.0 AS score FROM v, d""")
def latent_scores(t: Tables) -> DataFrame:
    """Scores of rows on the axes of largest variance, by an iterated distributed product; the SQL iterates a Gram matrix."""
    v = F.col("v") + 300 * (F.col("spot") % 5) * F.col("b") + 700 * (F.col("spot") % 3) * (F.col("b") % 4)
    _, scores = axes.latent_axes(_shipped(t).withColumn("v", v), "spot", "b", "v", 2)
    return scores.select("spot", "axis", (F.round("score", 2) + 0.0).alias("score"))


@query(f"""
WITH {_AXES.strip()}, f AS (SELECT list(b ORDER BY b) AS f FROM m), u AS (SELECT axis, unnest(range(1, len(p) + 1)) AS i, p FROM d)
SELECT CAST(axis AS INTEGER) AS axis, f[i] AS b, round(p[i], 7) + 0.0 AS weight FROM u, f""")
def principal_axes(t: Tables) -> DataFrame:
    """Weights of the features on the axes of largest variance."""
    v = F.col("v") + 300 * (F.col("spot") % 5) * F.col("b") + 700 * (F.col("spot") % 3) * (F.col("b") % 4)
    found, _ = axes.latent_axes(_shipped(t).withColumn("v", v), "spot", "b", "v", 2)
    return found.select("axis", "b", (F.round("weight", 7) + 0.0).alias("weight"))


# ---------------------------------------------------------- whole analyses

_CELLS = "SELECT o_custkey AS cell, c_nationkey % 5 AS kind, CAST(substr(p_brand, 7) AS BIGINT) AS b, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


@query(f"""
WITH {_lattice(_PROFILES, _SHIPPED)}, best AS (SELECT spot, size, kinds, CASE WHEN yy > 0 THEN greatest(1 - res / yy, 0) ELSE 0 END AS r, row_number() OVER (PARTITION BY spot, size ORDER BY res, kinds) AS n FROM lattice),
wide AS (SELECT spot, any_value(kinds) FILTER (size = 1) AS k1, any_value(kinds) FILTER (size = 2) AS k2, any_value(kinds) FILTER (size = 3) AS k3, max(r) FILTER (size = 1) AS r1, max(r) FILTER (size = 2) AS r2, max(r) FILTER (size = 3) AS r3 FROM best WHERE n = 1 GROUP BY 1),
model AS (SELECT spot, CASE WHEN r2 - r1 >= 0.02 AND r3 - r2 >= 0.02 THEN 3 WHEN r2 - r1 >= 0.02 THEN 2 ELSE 1 END AS n, k1, k2, k3, r1, r2, r3 FROM wide),
near AS ({"WITH " + _NEAR.strip()} SELECT spot, c_nationkey % 5 AS label, count(*) AS votes FROM k JOIN customer ON item = c_custkey WHERE k <= 100 GROUP BY 1, 2),
label AS (SELECT spot, label, votes / sum(votes) OVER (PARTITION BY spot) AS share, row_number() OVER (PARTITION BY spot ORDER BY votes DESC, label) AS n FROM near),
out AS (SELECT m.spot, ['pure', 'pair', 'triplet'][m.n] AS model, CASE m.n WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END AS kinds, CASE m.n WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS r2, label, share FROM model m LEFT JOIN label l ON l.spot = m.spot AND l.n = 1)
SELECT spot, model, array_to_string(kinds, ',') AS kinds, round(r2, 7) AS r2, label, round(share, 6) AS label_share, coalesce(list_contains(kinds, label), false) AS agrees FROM out""")
def deconvolved_spots(t: Tables) -> DataFrame:
    """A whole analysis: what each spot is a mixture of, and whether its nearest rows say the same."""
    named = {"b": "feature", "v": "value"}
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", _brand()), F.col("l_partkey") == F.col("p_partkey"))
    bought = rows.groupBy(F.col("o_custkey").alias("cell"), F.col("b").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value"))
    cells = bought.join(t.customer.select(F.col("c_custkey").alias("cell"), (F.col("c_nationkey") % 5).alias("kind")), "cell")
    out = tasks.deconvolution(_shipped(t).withColumnsRenamed(named), _profiles(t).withColumnsRenamed(named), cells, 0.02)
    return out.select("spot", "model", F.array_join(F.col("kinds").cast("array<string>"), ",").alias("kinds"), F.round(F.greatest("r2", F.lit(0.0)), 7).alias("r2"), "label", F.round("label_share", 6).alias("label_share"), "agrees")


@query("""
WITH c AS (SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(substr(p_brand, 7) AS BIGINT) AS f, sum(l_quantity * (1 + (l_linenumber * 5 + CAST(substr(p_brand, 7) AS BIGINT) * 3) % 7)) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
z AS (SELECT f, i, (n - avg(n) OVER (PARTITION BY f)) / stddev_pop(n) OVER (PARTITION BY f) AS v FROM c), k AS (SELECT f, i AS o FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, f) AS k FROM z) WHERE k <= 5),
m AS (SELECT o, z.i, avg(z.v) AS m, count(*) FILTER (z.v > s.v) AS w, count(*) AS n FROM k JOIN z s ON s.f = k.f AND s.i = o JOIN z ON z.f = k.f AND z.i <> o GROUP BY ALL),
p AS (SELECT x.o AS a, x.i AS b, least(x.m, y.m) AS cr, (x.w + y.w) / (x.n + y.n) AS win, least(x.m, y.m) + 2 * (x.w + y.w) / (x.n + y.n) - 1 AS s FROM m x JOIN m y ON x.o = y.i AND x.i = y.o WHERE x.o < x.i)
SELECT row_number() OVER (ORDER BY round(s, 9) DESC, a, b) AS rank, a, b, round(cr, 6) AS "cross", round(win, 6) AS win_rate, round(s, 6) AS swap_score, round(s - lead(s) OVER (ORDER BY round(s, 9) DESC, a, b), 6) AS margin FROM p""")
def swapped_samples(t: Tables) -> DataFrame:
    """A whole analysis: pairs of samples that carry each other's markers, ranked."""
    rows = t.lineitem.join(t.part.select("p_partkey", _brand()), F.col("l_partkey") == F.col("p_partkey"))
    n = (F.col("l_quantity") * (1 + (F.col("l_linenumber") * 5 + F.col("b") * 3) % 7)).cast("double")
    out = tasks.sample_swaps(rows.select(F.col("l_linenumber").cast("long").alias("sample"), F.col("b").alias("feature"), n.alias("value")), 5)
    return out.select("rank", "a", "b", *[F.round(c, 6).alias(c) for c in ("cross", "win_rate", "swap_score", "margin")])
