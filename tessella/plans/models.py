"""Queries of statistics, mixtures, matching, scoring and checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence
from ..operators import matching, scoring, solvers, stats, validate
from . import tasks
from .registry import Tables, query


@query("""
WITH m AS (SELECT p_brand, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, round(a, 4) AS mean_first, round(b, 4) AS mean_second, round((a + 1) / (b + 1), 6) AS fold_change, round(log2((a + 1) / (b + 1)), 6) + 0.0 AS log2_fold_change FROM m""")
def fold_changes(t: Tables) -> DataFrame:
    """Ratios of two groups' means and their binary logarithms."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = stats.fold_change(rows, ["p_brand"], "l_returnflag", "R", "A", "l_extendedprice")
    return out.select("p_brand", *[F.round(c, 4).alias(c) for c in ("mean_first", "mean_second")], F.round("fold_change", 6).alias("fold_change"), (F.round("log2_fold_change", 6) + 0.0).alias("log2_fold_change"))


_COUNTS = "SELECT p_brand AS gene, l_linenumber AS sample, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 6 GROUP BY ALL"


def _counts(t: Tables) -> DataFrame:
    rows = t.lineitem.filter("l_linenumber <= 6").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("gene"), F.col("l_linenumber").alias("sample")).agg(F.sum("l_quantity").alias("n"))


@query(f"""
WITH c AS ({_COUNTS}), l AS (SELECT gene, avg(ln(n)) AS m FROM c GROUP BY 1 HAVING count(*) = 6), f AS (SELECT sample, median(n / exp(m)) AS f FROM c JOIN l USING (gene) GROUP BY 1),
k AS (SELECT gene, sample <= 3 AS first, n / f AS k, f FROM c JOIN f USING (sample)), o AS (SELECT gene, first, avg(k) AS m, var_samp(k) AS s2, count(*) AS n, list(f) AS fs, avg(1 / f) AS inv FROM k GROUP BY ALL),
a AS (SELECT gene, greatest(1e-8, sum((s2 - m * inv) / (m * m) * (n - 1)) / sum(n - 1)) AS alpha FROM o GROUP BY 1),
w AS (SELECT o.gene, first, m, n, alpha, list_sum(list_transform(fs, lambda f: m * f / (1 + alpha * m * f))) AS w FROM o JOIN a USING (gene)),
x AS (SELECT gene, any_value(alpha) AS alpha, max(m) FILTER (first) AS m0, max(m) FILTER (NOT first) AS m1, max(w) FILTER (first) AS w0, max(w) FILTER (NOT first) AS w1 FROM w GROUP BY 1)
SELECT gene, round((m0 + m1) / 2, 3) AS base_mean, round(alpha, 6) AS dispersion, round(log2(m0 / m1), 6) + 0.0 AS log2_fold_change, round(ln(m0 / m1) / sqrt(1 / w0 + 1 / w1), 4) + 0.0 AS wald FROM x""")
def differential_expression(t: Tables) -> DataFrame:
    """Negative binomial dispersion and Wald test of two groups of samples (M5 M3 M4)."""
    groups = t.spark.createDataFrame([(i, "a" if i <= 3 else "b") for i in range(1, 7)], "sample int, arm string")
    out = stats.negative_binomial_wald(_counts(t), "gene", "sample", "n", groups, "arm", "a", "b")
    return out.select("gene", F.round("base_mean", 3).alias("base_mean"), F.round("dispersion", 6).alias("dispersion"), (F.round("log2_fold_change", 6) + 0.0).alias("log2_fold_change"), (F.round("wald", 4) + 0.0).alias("wald"))


@query(f"""
WITH c AS ({_COUNTS}), e AS (SELECT gene, bool_or(n > 700) AS expressed FROM c GROUP BY 1), r AS (SELECT DISTINCT p_brand AS gene, 1.5 - CAST(right(p_brand, 1) AS INTEGER) AS fc, CAST(right(p_brand, 1) AS INTEGER) / 60.0 AS padj FROM part)
SELECT gene, 'S-' || gene AS symbol, expressed AND abs(fc) >= 1 AND padj < 0.05 AS passed, CASE WHEN fc > 0 THEN 'up' WHEN fc < 0 THEN 'down' ELSE 'none' END AS direction FROM r JOIN e USING (gene)""")
def expression_flags(t: Tables) -> DataFrame:
    """Genes expressed, changed and significant, with direction and symbol."""
    last = F.right("p_brand", F.lit(1)).cast("int")
    results = t.part.select(F.col("p_brand").alias("gene"), (1.5 - last).alias("log2fc"), (last / 60.0).alias("padj")).distinct()
    names = t.part.select(F.col("p_brand").alias("gene"), F.concat(F.lit("S-"), "p_brand").alias("symbol"))
    return tasks.expression_passes(_counts(t), results, names, least=700).select("gene", "symbol", "passed", "direction")


#: Two profiles over the brands that overlap everywhere, and what suppliers shipped of the brands.
_TWO = "SELECT b, CAST(1 + b * b * 3 % 17 AS DOUBLE) AS p, CAST(1 + (7 + b * 5 + b * b * 3) % 17 AS DOUBLE) AS q FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS b FROM part)"
_SPOTS = "SELECT l_suppkey AS spot, CAST(substr(p_brand, 7) AS BIGINT) AS b, CAST(sum(l_quantity * (1 + (l_suppkey + b * b * l_suppkey) % 5)) AS DOUBLE) AS v FROM (SELECT *, CAST(substr(p_brand, 7) AS BIGINT) AS b FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"


def _unmixed(t: Tables, method: str) -> DataFrame:
    brand = F.substring("p_brand", 7, 9).cast("long").alias("b")
    rows = t.lineitem.join(t.part.select("p_partkey", brand), F.col("l_partkey") == F.col("p_partkey"))
    v = F.col("l_quantity") * (1 + (F.col("l_suppkey") + F.col("b") * F.col("b") * F.col("l_suppkey")) % 5)
    spots = rows.groupBy(F.col("l_suppkey").alias("spot"), "b").agg(F.sum(v).cast("double").alias("v"))
    b = F.col("b")
    both = F.array(F.struct(F.lit("p").alias("kind"), (1 + b * b * 3 % 17).cast("double").alias("v")), F.struct(F.lit("q").alias("kind"), (1 + (7 + b * 5 + b * b * 3) % 17).cast("double").alias("v")))
    profiles = t.part.select(brand).distinct().select("b", F.explode(both).alias("x")).select("b", "x.kind", "x.v")
    return solvers.unmix(spots, profiles, "spot", "b", "v", "kind", method).select("spot", "kind", F.round("weight", 5).alias("weight"))


@query(f"""
WITH s AS (SELECT spot, v, p, q FROM ({_SPOTS}) JOIN ({_TWO}) USING (b)), g AS (SELECT spot, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(v * p) AS vp, sum(v * q) AS vq FROM s GROUP BY 1),
w AS (SELECT spot, (vp * qq - vq * pq) / (pp * qq - pq * pq) AS a, (vq * pp - vp * pq) / (pp * qq - pq * pq) AS b, vp * vp / pp > vq * vq / qq AS first FROM g),
x AS (SELECT spot, CASE WHEN a > 0 AND b > 0 THEN a / (a + b) WHEN first THEN 1 ELSE 0 END AS a FROM w)
SELECT spot, 'p' AS kind, round(a, 5) AS weight FROM x UNION ALL SELECT spot, 'q', round(1 - a, 5) FROM x""")
def unmixed_squares(t: Tables) -> DataFrame:
    """Weights of profiles that overlap, by non-negative least squares."""
    return _unmixed(t, "nnls")


@query(f"""
WITH z AS (SELECT b, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM ({_TWO})), s AS (SELECT spot, list(v ORDER BY b) AS v, list(p ORDER BY b) AS p, list(q ORDER BY b) AS q FROM ({_SPOTS}) JOIN z USING (b) GROUP BY 1),
x AS (SELECT spot, list_reduce(list_transform(range(1, 46), lambda i: CAST(i AS DOUBLE)), lambda w, i: w + CASE WHEN list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * (p[k] - q[k]) / ((w + pow(2, -i)) * p[k] + (1 - w - pow(2, -i)) * q[k]))) > 0 THEN pow(2, -i) ELSE 0.0 END, CAST(0 AS DOUBLE)) AS a FROM s)
SELECT spot, 'p' AS kind, round(a, 5) AS weight FROM x UNION ALL SELECT spot, 'q', round(1 - a, 5) FROM x""")
def unmixed_likelihood(t: Tables) -> DataFrame:
    """Weights of profiles that overlap which make counts likeliest; the SQL halves the interval of the slope's zero."""
    return _unmixed(t, "em")


#: What each supplier shipped, in five classes of lines by five of orders.
_PAIRS = "SELECT l_suppkey AS g, l_partkey % 5 AS i, l_orderkey % 5 AS j, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY ALL"
_FILLED = f"SELECT g.g, i.i, j.j, coalesce(w, 0) AS w FROM (SELECT DISTINCT l_suppkey AS g FROM lineitem) g CROSS JOIN range(5) i(i) CROSS JOIN range(5) j(j) LEFT JOIN ({_PAIRS}) p ON p.g = g.g AND p.i = i.i AND p.j = j.j"
_PERMUTED = f"w AS ({_FILLED}), l AS (SELECT g, i, list(w ORDER BY j) AS w FROM w GROUP BY ALL), h AS (SELECT g, list(w ORDER BY i) AS w FROM l GROUP BY 1), q AS (SELECT a.j AS a, b.j AS b, c.j AS c, d.j AS d, e.j AS e FROM range(5) a(j), range(5) b(j), range(5) c(j), range(5) d(j), range(5) e(j) WHERE len(list_distinct([a.j, b.j, c.j, d.j, e.j])) = 5), p AS (SELECT g, [a, b, c, d, e] AS js, w[1][a + 1] + w[2][b + 1] + w[3][c + 1] + w[4][d + 1] + w[5][e + 1] AS total FROM h, q)"


def _weights(t: Tables, g: Column) -> DataFrame:
    own = t.lineitem.groupBy(g.alias("g"), (F.col("l_partkey") % 5).alias("i"), (F.col("l_orderkey") % 5).alias("j")).agg(F.sum("l_quantity").cast("double").alias("w"))
    five = F.array(*[F.lit(k).cast("long") for k in range(5)])
    cells = t.lineitem.select(g.alias("g")).distinct().withColumn("i", F.explode(five)).withColumn("j", F.explode(five))
    return cells.join(own, ["g", "i", "j"], "left").na.fill(0.0, ["w"])


@query(f"WITH {_PERMUTED} SELECT g, max(total) AS best, list_sort(list(total), 'DESC')[2] AS second, max(total) AS assigned FROM p GROUP BY 1")
def permutation_audit(t: Tables) -> DataFrame:
    """The best assignment of each group against all permutations."""
    return solvers.permutation_audit(_weights(t, F.col("l_suppkey")), "i", "j", "w", ["g"])


@query(f"WITH {_PERMUTED.replace('l_suppkey AS g', 'l_suppkey % 8 AS g')} SELECT g, CAST(5 AS BIGINT) AS pairs, max(total) AS total FROM p GROUP BY 1")
def auction_totals(t: Tables) -> DataFrame:
    """Totals of assignments that an auction finds, with prices as a table and the rows of each group in two tasks."""
    found = matching.auction(_weights(t, F.col("l_suppkey") % 8), "i", "j", "w", ["g"], unit=1.0, blocks=2)
    one = found.groupBy("g").agg(F.countDistinct("i", "j").alias("n"), F.countDistinct("j").alias("pairs"), F.sum("w").alias("total"))
    return one.filter("n = pairs").select("g", "pairs", "total")


@query(f"WITH {_PERMUTED}, u AS (SELECT g, unnest(range(5)) AS i, js, total FROM p), m AS (SELECT g, i, js[i + 1] AS j, max(total) AS total FROM u GROUP BY ALL) SELECT g, i, j, total, max(total) OVER (PARTITION BY g) - total AS loss FROM m")
def fixed_pairs(t: Tables) -> DataFrame:
    """The best total of each group with each pair held fixed, and what it costs."""
    return solvers.fixed_pair_totals(_weights(t, F.col("l_suppkey")), "i", "j", "w", ["g"])


@query("""
WITH s AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, CAST((x.n_nationkey * 7 + y.n_nationkey * 13) % 17 AS DOUBLE) AS v FROM nation x, nation y)
SELECT p.a, p.b, least(p.v - s.v, q.v - u.v) AS swap_score FROM s p JOIN s q ON p.a = q.b AND p.b = q.a AND p.a < p.b JOIN s s ON s.a = p.a AND s.b = p.a JOIN s u ON u.a = p.b AND u.b = p.b""")
def swap_scores(t: Tables) -> DataFrame:
    """How much better two items fit each other's labels than their own."""
    a, b = t.nation.select(F.col("n_nationkey").alias("a")), t.nation.select(F.col("n_nationkey").alias("b"))
    similarity = a.crossJoin(F.broadcast(b)).withColumn("v", ((F.col("a") * 7 + F.col("b") * 13) % 17).cast("double"))  # 25 rows each
    return stats.swap_gain(similarity, "a", "b", "v")


@query("""
WITH c AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS f, l_linenumber AS i, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), z AS (SELECT f, i, (n - avg(n) OVER (PARTITION BY f)) / stddev_pop(n) OVER (PARTITION BY f) AS v FROM c), k AS (SELECT DISTINCT f, f % 7 + 1 AS o FROM c),
m AS (SELECT o, z.i, avg(z.v) AS m, count(*) FILTER (z.v > s.v) AS w, count(*) AS n FROM k JOIN z s ON s.f = k.f AND s.i = o JOIN z ON z.f = k.f AND z.i <> o GROUP BY ALL)
SELECT x.o AS a, CAST(x.i AS BIGINT) AS b, round(least(x.m, y.m), 6) AS "cross", round((x.w + y.w) / (x.n + y.n), 6) AS win_rate, x.n + y.n AS n, round(least(x.m, y.m) + 2 * (x.w + y.w) / (x.n + y.n) - 1, 6) AS swap_score FROM m x JOIN m y ON x.o = y.i AND x.i = y.o WHERE x.o < x.i""")
def swap_directions(t: Tables) -> DataFrame:
    """How well two items carry each other's markers: the smaller mean, the win rate and both as a score."""
    rows = t.lineitem.join(t.part.select("p_partkey", F.substring("p_brand", 7, 9).cast("long").alias("f")), F.col("l_partkey") == F.col("p_partkey"))
    n = rows.groupBy("f", F.col("l_linenumber").cast("long").alias("i")).agg(F.sum("l_quantity").cast("double").alias("n"))
    z = n.select("f", "i", stats.row_z("n", ["f"]).alias("v"))
    out = stats.swap_directions(z, n.select("f", (F.col("f") % 7 + 1).alias("i")).distinct(), "i", "f", "v")
    return out.select("a", "b", F.round("cross", 6).alias("cross"), F.round("win_rate", 6).alias("win_rate"), "n", F.round("swap_score", 6).alias("swap_score"))


@query("""
WITH v AS (SELECT l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS g, l_linenumber AS k FROM lineitem), d AS (SELECT y - avg(y) OVER (PARTITION BY k) AS y, g - avg(g) OVER (PARTITION BY k) AS g FROM v)
SELECT round(sum(y * g) / sum(g * g), 4) + 0.0 AS effect, count(*) AS n FROM d""")
def adjusted_effect(t: Tables) -> DataFrame:
    """Effect of a group beside levels of a covariate."""
    v = t.lineitem.select(F.col("l_extendedprice").alias("y"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("g"), F.col("l_linenumber").alias("k"))
    return stats.within_effect(v, "y", "g", "k").select((F.round("effect", 4) + 0.0).alias("effect"), "n")


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice AS v FROM orders), p AS (SELECT o_custkey, avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY 1), f AS (SELECT median(s) AS f FROM p)
SELECT o_orderkey, round((v - m) / greatest(s, f), 5) + 0.0 AS z FROM v JOIN p USING (o_custkey), f""")
def floored_scores(t: Tables) -> DataFrame:
    """z-scores in rows whose deviation has a floor."""
    z = stats.floored_z(t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v")), "o_custkey", "v")
    return z.select("o_orderkey", (F.round("z", 5) + 0.0).alias("z"))


@query("SELECT c_mktsegment, CAST(ceil(count(*) * 0.1) AS BIGINT) AS n FROM customer GROUP BY 1")
def stratified_pick(t: Tables) -> DataFrame:
    """A tenth of each group without replacement."""
    return stats.stratified_sample(t.customer, "c_mktsegment", "c_custkey", 0.1).groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("n"))


@query("""
WITH v AS (SELECT l_suppkey AS g, l_quantity AS x, CASE l_suppkey % 4 WHEN 0 THEN 2 * l_quantity + 1 WHEN 1 THEN l_discount WHEN 2 THEN 7 ELSE l_quantity + l_tax * 100 END AS y, CASE WHEN l_suppkey % 3 = 0 THEN l_quantity - l_discount * 100 ELSE 1 END AS z FROM lineitem),
c AS (SELECT g, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM v GROUP BY 1),
d AS (SELECT *, xx * yy - xy * xy AS dxy, xx * zz - xz * xz AS dxz, yy * zz - yz * yz AS dyz, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM c)
SELECT g, n, CAST(CASE WHEN yy > 1e-9 AND zz > 1e-9 AND det > 1e-6 * xx * yy * zz THEN 4 WHEN dxy > 1e-9 * xx * yy + 1e-12 OR dxz > 1e-9 * xx * zz + 1e-12 OR dyz > 1e-9 * yy * zz + 1e-12 THEN 3 WHEN xx > 1e-9 OR yy > 1e-9 OR zz > 1e-9 THEN 2 ELSE 1 END AS INTEGER) AS rank FROM d""")
def design_ranks(t: Tables) -> DataFrame:
    """Ranks of designs with repeated, constant and free columns; the SQL has them from determinants."""
    g, x = F.col("l_suppkey"), F.col("l_quantity")
    y = F.when(g % 4 == 0, 2 * x + 1).when(g % 4 == 1, F.col("l_discount")).when(g % 4 == 2, F.lit(7.0)).otherwise(x + F.col("l_tax") * 100)
    v = t.lineitem.select(g.alias("g"), x.alias("x"), y.alias("y"), F.when(g % 3 == 0, x - F.col("l_discount") * 100).otherwise(F.lit(1.0)).alias("z"))
    return solvers.design_ranks(v, ["g"], ["x", "y", "z"])


@query("""
WITH v AS (SELECT l_returnflag AS g, l_linenumber AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT DISTINCT f FROM v)
SELECT v.g AS grp, f.f AS without, round(corr(x, y), 6) AS r FROM v JOIN f ON v.f <> f.f GROUP BY 1, 2""")
def correlation_without(t: Tables) -> DataFrame:
    """Correlations with one feature left out at a time."""
    v = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("without"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return stats.pearson_without(v, ["grp"], "without", "x", "y").select("grp", "without", F.round("r", 6).alias("r"))


@query("""
WITH v AS (SELECT s_suppkey, s_acctbal AS x FROM supplier), a AS (SELECT avg(x) FILTER (abs(x) <= abs(x - 4000) AND abs(x) <= abs(x - 8000)) AS c0, avg(x) FILTER (abs(x) > abs(x - 4000) AND abs(x - 4000) <= abs(x - 8000)) AS c1, avg(x) FILTER (abs(x - 8000) < abs(x - 4000) AND abs(x - 8000) < abs(x)) AS c2 FROM v)
SELECT s_suppkey, CAST(CASE WHEN abs(x - c0) <= abs(x - c1) AND abs(x - c0) <= abs(x - c2) THEN 0 WHEN abs(x - c1) <= abs(x - c2) THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM v, a""")
def balance_clusters(t: Tables) -> DataFrame:
    """A round of k-means from given centres."""
    return stats.k_means(t.supplier, "s_suppkey", ["s_acctbal"], [[0.0], [4000.0], [8000.0]], 1)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS joint, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS probability FROM orders GROUP BY 1, 2")
def conditional_shares(t: Tables) -> DataFrame:
    """Conditional probabilities from pooled counts."""
    return stats.conditional(t.orders, ["o_orderpriority"], ["o_orderstatus"]).withColumn("probability", F.round("probability", 6))


@query("""
WITH v AS (SELECT l_suppkey AS u, l_linenumber AS f, l_shipmode_ AS c, sum(l_quantity) AS s FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY ALL), w AS (SELECT u, c, row_number() OVER (PARTITION BY u, f ORDER BY s DESC, c) AS k FROM v)
SELECT u AS l_suppkey, c AS candidate, count(*) AS votes, round(count(*) / sum(count(*)) OVER (PARTITION BY u), 6) AS share FROM w WHERE k = 1 GROUP BY 1, 2""")
def vote_shares(t: Tables) -> DataFrame:
    """Votes of features for candidates, and their shares."""
    v = t.lineitem.groupBy("l_suppkey", "l_linenumber", F.col("l_returnflag").alias("candidate")).agg(F.sum("l_quantity").alias("s"))
    return stats.vote_share(v, "l_suppkey", "l_linenumber", "candidate", "s").withColumn("share", F.round("share", 6))


@query("""
WITH c AS (SELECT l_orderkey % 200 AS cell, 'g' || (l_partkey % 30) AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)
SELECT cell, sum(n) AS library, count(DISTINCT gene) FILTER (n > 0) AS detected, round(coalesce(sum(n) FILTER (gene IN ('g1', 'g2', 'g3')), 0) / sum(n), 6) AS marked_share FROM c GROUP BY 1""")
def cell_quality(t: Tables) -> DataFrame:
    """Library size, detected genes and the share of marked ones."""
    c = t.lineitem.groupBy((F.col("l_orderkey") % 200).alias("cell"), F.concat(F.lit("g"), F.col("l_partkey") % 30).alias("gene")).agg(F.sum("l_quantity").alias("n"))
    return stats.cell_quality(c, "cell", "gene", "n", F.col("gene").isin("g1", "g2", "g3")).withColumn("marked_share", F.round("marked_share", 6))


@query("""
WITH v AS (SELECT l_returnflag AS g, l_orderkey % 2 AS h, l_suppkey AS f, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT a.g AS a, b.g AS b, round(corr(a.m, b.m), 6) AS r FROM v a JOIN v b USING (f) WHERE a.h = 0 AND b.h = 1 GROUP BY 1, 2""")
def split_halves(t: Tables) -> DataFrame:
    """Profiles of one half of the data against those of the other."""
    v = t.lineitem.select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") % 2).alias("h"), F.col("l_suppkey").alias("f"), F.col("l_extendedprice").alias("v"))
    return stats.split_half(v, "g", "h", "f", "v").withColumn("r", F.round("r", 6))


@query("""
WITH v AS (SELECT l_returnflag AS c, l_linenumber AS f, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), r AS (SELECT *, strpos('0123456789abcdef', substr(md5(k || '-' || f), 1, 1)) - 1 AS d FROM v, range(1, 41) x(k)),
w AS (SELECT k, c, sum(CASE WHEN d < 6 THEN 0 WHEN d < 12 THEN 1 WHEN d < 15 THEN 2 ELSE 3 END * s) AS t FROM r GROUP BY ALL), b AS (SELECT c, row_number() OVER (PARTITION BY k ORDER BY t DESC, c) AS p FROM w)
SELECT c AS candidate, count(*) AS wins FROM b WHERE p = 1 GROUP BY 1""")
def bootstrap_winners(t: Tables) -> DataFrame:
    """How often each candidate wins when features are drawn with replacement."""
    v = t.lineitem.groupBy(F.col("l_returnflag").alias("candidate"), F.col("l_linenumber").alias("f")).agg(F.sum("l_quantity").alias("s"))
    return stats.winner_counts(v, "candidate", "f", "s", 40)


@query("SELECT doc_id, n_chars > 500 AS predicted, quality, (n_chars > 500) = (quality = 1) AS agrees FROM documents JOIN labels USING (doc_id)")
def blind_scores(t: Tables) -> DataFrame:
    """Scores that are made before their labels are read."""
    found = validate.labelled_after(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", "quality", lambda d: d.select("doc_id", (F.col("n_chars") > 500).alias("predicted")))
    return found.withColumn("agrees", F.col("predicted") == (F.col("quality") == 1))


@query("""
WITH c AS (SELECT l_orderkey % 200 AS cell, 'g' || l_linenumber AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY ALL), s AS (SELECT cell, gene, ln(1 + n / sum(n) OVER (PARTITION BY cell) * 1e4) AS v FROM c),
p AS (SELECT * FROM (VALUES ('A', 0, ['g1', 'g3']), ('B', 1, ['g2']), ('C', 2, ['g4', 'g5', 'g6'])) x(k, i, gs)), x AS (SELECT DISTINCT cell, cell % 4 AS sample FROM c),
sc AS (SELECT x.cell, sample, k, i, coalesce((SELECT sum(v) FROM s WHERE s.cell = x.cell AND list_contains(gs, gene)), 0) / len(gs) AS v FROM x, p), b AS (SELECT sample, k, row_number() OVER (PARTITION BY cell ORDER BY v DESC, i) AS r FROM sc),
n AS (SELECT f.sample, f.k, count(b.k) AS n FROM (SELECT DISTINCT sample, k FROM x, p) f LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON b.sample = f.sample AND b.k = f.k GROUP BY ALL)
SELECT sample, k AS cell_type, n AS n_cells, round(n / sum(n) OVER (PARTITION BY sample), 6) AS fraction FROM n""")
def cell_types(t: Tables) -> DataFrame:
    """Cells labelled by their best set of markers, counted with zeros."""
    counts = t.lineitem.groupBy((F.col("l_orderkey") % 200).alias("cell"), F.concat(F.lit("g"), "l_linenumber").alias("gene")).agg(F.sum("l_quantity").alias("n"))
    cells = counts.select("cell").distinct().withColumn("sample", F.col("cell") % 4)
    panel = t.spark.createDataFrame([("A", "g1, g3", 0), ("B", "g2", 1), ("C", "g4, g5, g6", 2)], "cell_type string, markers string, i int")
    return tasks.cell_composition(counts, cells, panel).select("sample", "cell_type", "n_cells", F.round("fraction", 6).alias("fraction"))


@query("""
WITH p AS (SELECT 'B' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS well, n_regionkey AS r, 1 + n_nationkey % 3 AS v FROM nation WHERE n_nationkey % 2 = 1), s AS (SELECT r, sum(v) AS need FROM p GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY well) AS INTEGER) AS step, 'A' || r AS source, well AS destination, CAST(v AS DOUBLE) AS transfer, 'p20' AS transfer_pipette, CAST(100 - v AS DOUBLE) AS diluent, 'p300' AS diluent_pipette, need <= 5 AS enough FROM p JOIN s USING (r)""")
def plate_recovery(t: Tables) -> DataFrame:
    """Transfers that finish a plate, their pipettes, and whether the stock suffices."""
    number = lambda c: c.cast("decimal(18,6)")
    well = F.concat(F.lit("B"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    plates = t.nation.select(well.alias("well"), F.concat(F.lit("c"), "n_regionkey").alias("compound_id"), number(1 + F.col("n_nationkey") % 3).alias("requested_final_uM"), number(F.lit(100)).alias("requested_final_volume_uL"))
    log = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("event_id"), F.lit("dispense").alias("operation"), F.lit("completed").alias("status"), well.alias("well"))
    inventory = t.region.select(F.concat(F.lit("A"), "r_regionkey").alias("source"), F.concat(F.lit("c"), "r_regionkey").alias("compound_id"), number(F.lit(100)).alias("concentration_uM"), number(F.lit(5)).alias("available_volume_uL"))
    d = Decimal
    pipettes = t.spark.createDataFrame([("p20", d(1), d(20), d("0.5")), ("p300", d(20), d(300), d(1))], "pipette string, min_ul decimal(18,6), max_ul decimal(18,6), increment_ul decimal(18,6)")
    out = tasks.plate_recovery(plates, log, inventory, pipettes)
    return out.select("step", "source", "destination", F.col("transfer_uL").cast("double").alias("transfer"), "transfer_pipette", F.col("diluent_uL").cast("double").alias("diluent"), "diluent_pipette", "enough")


# ------------------------------------------------------------ scores, checks


@query("""
WITH f AS (SELECT n_regionkey AS r, n_name FROM nation WHERE n_nationkey % 4 <> 0), m AS (SELECT n.n_regionkey AS r, list_sort(list(n.n_name) FILTER (f.n_name IS NULL)) AS missing FROM nation n LEFT JOIN f ON n.n_name = f.n_name GROUP BY 1)
SELECT 'T' || r AS task, coalesce(array_to_string(missing, ','), '') AS missing, CAST(CASE WHEN len(coalesce(missing, [])) = 0 THEN 10 ELSE 0 END AS INTEGER) AS points FROM m""")
def files_present(t: Tables) -> DataFrame:
    """Points for tasks all of whose files are there (V1)."""
    manifest = t.nation.select(F.concat(F.lit("T"), "n_regionkey").alias("task"), F.col("n_name").alias("name"))
    files = t.nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 0, 0).otherwise(5).alias("length"))
    return scoring.present(manifest, files).select("task", F.array_join("missing", ",").alias("missing"), "points")


@query("SELECT CAST(r_regionkey AS INTEGER) AS k, r_regionkey NOT IN (1, 3) AS ok FROM region")
def typed_artifacts(t: Tables) -> DataFrame:
    """Whether contents are what their suffixes say (V2)."""
    k = F.col("r_regionkey")
    name = F.concat(F.lit("f"), F.when(k == 0, ".json").when(k == 1, ".json").when(k == 2, ".csv").when(k == 3, ".csv").otherwise(".txt"))
    content = F.when(k == 0, '{"a": 1}').when(k == 1, '{"a":').when(k == 2, "h\n1\n").when(k == 3, "h\n").otherwise("x")
    return t.region.select(k.alias("k"), validate.artifact_ok(name, content.cast("binary")).alias("ok"))


@query("""
SELECT n_nationkey AS key, '$.a.b' AS path, CAST(n_regionkey AS DOUBLE) AS number FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, '$.c[' || i || ']', CAST(n_nationkey + i AS DOUBLE) FROM nation, range(2) r(i) WHERE n_nationkey % 5 <> 0
UNION ALL SELECT n_nationkey, '$.a', NULL FROM nation WHERE n_nationkey % 5 = 0""")
def finite_leaves(t: Tables) -> DataFrame:
    """Leaves of JSON documents; numbers that are not finite are marked."""
    k = F.col("n_nationkey")
    body = F.when(k % 5 == 0, F.lit('{"a": NaN}')).otherwise(F.format_string('{"a": {"b": %d}, "c": [%d, %d]}', "n_regionkey", k, k + 1))
    return validate.leaf_rows(t.nation.select(k.alias("key"), body.alias("t")), "key", "t").select("key", "path", "number")


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, n_nationkey % 5 <> 0 AS syntax_ok, CASE WHEN n_nationkey % 5 <> 0 THEN '/data/' || n_nationkey ELSE '' END AS paths, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 2 = 0 THEN 'fit' ELSE '' END AS tainted, CASE WHEN n_nationkey % 5 <> 0 THEN 'read,fit' ELSE '' END AS calls FROM nation")
def script_checks(t: Tables) -> DataFrame:
    """Whether scripts parse, their calls and paths, and what their secrets reach."""
    k = F.col("n_nationkey")
    code = F.when(k % 5 == 0, F.lit("def (")).otherwise(F.concat(F.format_string("x = truth\ny = x + 1\nread('/data/%d')\n", k), F.when(k % 2 == 0, "fit(y)\n").otherwise("fit(3)\n")))
    found = validate.script_facts(t.nation.select(k.alias("k"), code.alias("code")), "code", ["truth"], ["fit"])
    join = lambda c: F.array_join(f"facts.{c}", ",")
    return found.select("k", "facts.syntax_ok", join("absolute_paths").alias("paths"), join("tainted").alias("tainted"), join("calls").alias("calls"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'blocked' WHEN toxic = 1 THEN 'missing' ELSE 'scored' END AS status FROM labels")
def score_status(t: Tables) -> DataFrame:
    """Blocked until controls are accepted, then scored or missing (V6)."""
    return t.labels.select("doc_id", scoring.status(F.col("quality") == 1, F.when(F.col("toxic") == 0, 1.0)).alias("status"))


@query("SELECT doc_id, CAST(0 AS INTEGER) AS i, 'quality' AS part, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'toxic', CAST(toxic AS DOUBLE) FROM labels")
def long_scores(t: Tables) -> DataFrame:
    """Scores in long form, in a stable order."""
    return scoring.long_form(t.labels, "doc_id", ["quality", "toxic"])


@query("""
SELECT n_nationkey, CASE WHEN r.r_name IS NOT NULL THEN 'first' WHEN q.r_name IS NOT NULL THEN 'second' END AS matched_cell, coalesce(r.r_regionkey, q.r_regionkey) AS score FROM
(SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'AFRICA' ELSE 'none' END AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'ASIA' ELSE 'no' END AS b FROM nation) n LEFT JOIN region r ON r.r_name = a LEFT JOIN region q ON q.r_name = b""")
def merged_scores(t: Tables) -> DataFrame:
    """Scores merged back by the first cell that matches."""
    k = F.col("n_nationkey")
    table = t.nation.select("n_nationkey", F.when(k % 3 == 0, "AFRICA").otherwise("none").alias("first"), F.when(k % 2 == 0, "ASIA").otherwise("no").alias("second"))
    return scoring.merge_back(table, t.region.select("r_name", F.col("r_regionkey").alias("score")), "r_name", ["first", "second"], "score").select("n_nationkey", "matched_cell", "score")


@query("SELECT n_nationkey, n_nationkey % 11 IN (3, 4) AS says_it, 'NATION_' || n_nationkey AS choice, CASE WHEN n_nationkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity, CASE WHEN n_nationkey % 3 = 0 THEN '0-based half-open' WHEN n_nationkey % 3 = 1 THEN '1-based inclusive' END AS convention FROM nation")
def stated_evidence(t: Tables) -> DataFrame:
    """Counts in digits or words, a named first choice, the sense of a decision, and how intervals count."""
    k = F.col("n_nationkey")
    count = F.when(k % 11 == 3, "3 marker genes").when(k % 11 == 4, "three genes").otherwise("9 genes")
    text = F.concat(F.lit("We found "), count, F.lit(". The best candidate is "), "n_name", F.when(k % 2 == 0, "; we accept it").otherwise("; we reject it"), F.when(k % 3 == 0, ". Positions are 0-based.").when(k % 3 == 1, ". Bounds are inclusive.").otherwise("."))
    d = t.nation.select("n_nationkey", text.alias("x"))
    x = F.col("x")
    return d.select("n_nationkey", evidence.says_number(x, 3, "gene").alias("says_it"), evidence.top_choice(x, r"NATION_\d+").alias("choice"), evidence.polarity(x).alias("polarity"), evidence.interval_convention(x).alias("convention"))


@query("SELECT conv_id, regexp_full_match(string_agg(CASE role WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '' END, '' ORDER BY turn, role), '(ua)*') AS ok FROM conversations GROUP BY 1")
def paired_turns(t: Tables) -> DataFrame:
    """Whether opening and closing steps alternate in each group."""
    return scoring.paired(t.conversations, "conv_id", "turn", "role", "user", "assistant")


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn, role), '>') = 'user>assistant' AS ok FROM conversations GROUP BY 1")
def exact_turns(t: Tables) -> DataFrame:
    """Whether each group's steps are exactly those wanted."""
    return scoring.exact_sequence(t.conversations, "conv_id", "turn", "role", ["user", "assistant"]).select("conv_id", "ok")


@query("""
WITH v AS (SELECT CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS g, c_acctbal AS v FROM customer), s AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, avg(v) FILTER (g = 1) AS m1, avg(v) FILTER (g = 0) AS m2, stddev_samp(v) FILTER (g = 1) AS s1, stddev_samp(v) FILTER (g = 0) AS s2 FROM v)
SELECT round(m1, 4) AS mean1, round(m2, 4) AS mean2, round((m1 - m2) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 6) + 0.0 AS d, true AS has_n FROM s""")
def group_power(t: Tables) -> DataFrame:
    """Effect size of two groups and the group size that power takes."""
    v = t.customer.select((F.col("c_mktsegment") == "BUILDING").cast("int").alias("g"), F.col("c_acctbal").alias("v"))
    out = tasks.power_summary(v, "g", 1, 0, "v")
    return out.select(F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"), (F.round("d", 6) + 0.0).alias("d"), (F.col("n_per_group") > 1).alias("has_n"))
