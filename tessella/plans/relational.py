"""Projection, join, aggregation, set and order queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import joins, ordered, stats
from .registry import Tables, query

_RISK = "CASE WHEN returned AND top_discount >= 0.08 THEN 'critical' WHEN returned THEN 'high' WHEN top_discount >= 0.08 THEN 'medium' ELSE 'low' END"


@query(f"""
WITH o AS (
  SELECT o_custkey, o_orderkey, o_totalprice, bool_or(l_returnflag = 'R') AS returned, max(l_discount) AS top_discount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
), c AS (SELECT *, {_RISK} AS risk FROM o)
SELECT o_custkey, o_orderkey, o_totalprice, risk,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
FROM c""")
def flagship_risk_rank(t: Tables) -> DataFrame:
    """Orders ranked for each customer by the risk of their lines, then by price."""
    facts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max("l_discount").alias("top_discount"))
    high = F.col("top_discount") >= 0.08
    risk = F.when(F.col("returned") & high, "critical").when(F.col("returned"), "high").when(high, "medium").otherwise("low")
    ordinal = F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("risk"))
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice").join(facts, "o_orderkey").withColumn("risk", risk)
    return ordered.ranked(rows, [ordinal, F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice", "risk", "rank")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def star_lookup(t: Tables) -> DataFrame:
    """Chained key joins to small dimensions."""
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, coalesce(max(o_orderpriority), '') AS last_priority FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_lookup_filled(t: Tables) -> DataFrame:
    """Left outer lookup whose missing text is empty."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderpriority").alias("last_priority"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("last_priority", F.lit("")).alias("last_priority"))


@query("""
WITH f AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1)
SELECT c_custkey, o_orderkey AS first_order, o_totalprice AS first_price FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def first_order_lookup(t: Tables) -> DataFrame:
    """Left join to the first right row of each key, in a stated order."""
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    out = joins.first_match(t.customer.select("c_custkey"), right, ["c_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return out.select("c_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("first_price"))


@query("""
SELECT CAST((SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS BIGINT) AS with_orders,
  CAST((SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS BIGINT) AS without_orders,
  CAST((SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS BIGINT) AS common,
  CAST((SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS BIGINT) AS missing""")
def anti_semi_sets(t: Tables) -> DataFrame:
    """Semi and anti joins against intersection and difference."""
    c, o = t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(c.join(o, "c_custkey", "left_semi"), "with_orders"), n(c.join(o, "c_custkey", "left_anti"), "without_orders"), n(c.intersect(o), "common"), n(c.subtract(o), "missing")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_set_difference(t: Tables) -> DataFrame:
    """Keys that one side alone has."""
    return joins.key_difference(t.supplier.select(F.col("s_suppkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("""
SELECT p_partkey, p_size, name FROM part JOIN (VALUES ('small', 0, 11), ('medium', 11, 31), ('large', 31, 1000)) b(name, lo, hi) ON p_size >= lo AND p_size < hi""")
def size_band_join(t: Tables) -> DataFrame:
    """Points in labelled intervals, joined on bins."""
    bands = t.spark.createDataFrame([("small", 0, 11), ("medium", 11, 31), ("large", 31, 1000)], "name string, start long, end long")
    return joins.point_in_interval(t.part.select("p_partkey", "p_size"), bands, [], 16, "p_size").select("p_partkey", "p_size", "name")


_SPANS = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) AS s, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) + CAST(l_quantity AS INTEGER) + 1 AS e FROM lineitem"


def _spans(t: Tables) -> DataFrame:
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), day.alias("s"), (day + F.col("l_quantity").cast("int") + 1).alias("e"))


@query(f"""
WITH v AS ({_SPANS})
SELECT a.l_orderkey, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap
FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.s < b.e AND b.s < a.e GROUP BY 1""")
def ship_overlaps(t: Tables) -> DataFrame:
    """Overlapping ship spans of an order's lines and how long they overlap."""
    v = _spans(t)
    a = v.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("s").alias("l_start"), F.col("e").alias("l_end"))
    b = v.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("s").alias("r_start"), F.col("e").alias("r_end"))
    pairs = joins.interval_overlap(a, b, ["l_orderkey"], 64).filter("i < j")
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("overlap"))


@query(f"""
WITH v AS ({_SPANS}), w AS (SELECT l_orderkey, q, least(e, 3287) - greatest(s, 2922) AS o FROM v WHERE s < 3287 AND e > 2922)
SELECT l_orderkey, round(sum(q * o) / sum(o), 6) AS weighted_mean, CAST(sum(o) AS BIGINT) AS covered FROM w GROUP BY 1""")
def weighted_interval_mean(t: Tables) -> DataFrame:
    """Mean quantity within a window of days, weighted by overlap."""
    window = t.spark.createDataFrame([(2922, 3287)], "r_start long, r_end long")
    pairs = joins.interval_overlap(_spans(t).withColumnsRenamed({"s": "l_start", "e": "l_end"}), F.broadcast(window), [], 512)  # one row
    return joins.weighted_overlap(pairs, ["l_orderkey"], "q").select("l_orderkey", F.round("weighted_mean", 6).alias("weighted_mean"), "covered")


@query(f"""
WITH v AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT l_orderkey, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS members FROM g GROUP BY l_orderkey, i""")
def merged_ship_intervals(t: Tables) -> DataFrame:
    """Union of an order's ship spans."""
    return ordered.merged(_spans(t), ["l_orderkey"], "s", "e")


@query(f"""
WITH v AS ({_SPANS}), m AS (SELECT l_orderkey, e AS gap_start, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS gap_end FROM v)
SELECT * FROM m WHERE gap_end > gap_start""")
def ship_gaps(t: Tables) -> DataFrame:
    """What lies between neighbouring spans."""
    return ordered.gaps(_spans(t), ["l_orderkey"], "s", "e")


@query("""
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events),
p AS (SELECT l.lag, a.value AS x, b.value AS y FROM s a, (VALUES (-2), (-1), (0), (1), (2)) l(lag), s b WHERE b.user_id = a.user_id AND b.step = a.step + l.lag)
SELECT lag, round(corr(x, y), 6) AS r, count(*) AS n FROM p GROUP BY lag""")
def lag_corr_by_user(t: Tables) -> DataFrame:
    """Correlation of a series with itself at several lags, joined on the step's value."""
    steps = t.events.select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))
    return joins.lag_correlation(steps, ["user_id"], "step", "value", "value", range(-2, 3)).select("lag", F.round("r", 6).alias("r"), "n")


@query("SELECT a.c_mktsegment AS seg_a, b.c_mktsegment AS seg_b, a.c_nationkey AS nation, a.n AS n_a, b.n AS n_b FROM (SELECT c_nationkey, c_mktsegment, count(*) n FROM customer GROUP BY ALL) a JOIN (SELECT c_nationkey, c_mktsegment, count(*) n FROM customer GROUP BY ALL) b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment < b.c_mktsegment")
def segment_pairs(t: Tables) -> DataFrame:
    """Unordered pairs within a group."""
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    pairs = joins.self_pairs(n, ["c_nationkey"], "c_mktsegment", ["n"])
    return pairs.select(F.col("c_mktsegment_a").alias("seg_a"), F.col("c_mktsegment_b").alias("seg_b"), F.col("c_nationkey").alias("nation"), "n_a", "n_b")


@query("""
SELECT event_id, user_id, (SELECT max(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts
  AND o.ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts)) AS last_purchase FROM events e WHERE event_type = 'view'""")
def as_of_purchase(t: Tables) -> DataFrame:
    """Each view with its user's latest purchase at or before it (J20, an extension)."""
    bought = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    seen = t.events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return joins.as_of(seen, bought, ["user_id"], "ts", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n, round(median(o_totalprice), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice) / 1e6, 4) AS var_m, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def price_summary(t: Tables) -> DataFrame:
    """Mean, count, median, deviations and a quantile."""
    p = F.col("o_totalprice")
    r = lambda c, name: F.round(c, 4).alias(name)
    return t.orders.groupBy("o_orderstatus").agg(r(F.avg(p), "mean_price"), F.count(F.lit(1)).alias("n"), r(F.median(p), "med"), r(F.stddev_samp(p), "sd"), r(F.var_pop(p) / 1e6, "var_m"), r(F.percentile(p, 0.9), "p90"))


@query("""
WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1)
SELECT p_brand, round(any_value(m), 6) AS median, round(median(abs(p_retailprice - m)) * 1.4826, 6) AS mad FROM part JOIN m USING (p_brand) GROUP BY 1""")
def price_mad(t: Tables) -> DataFrame:
    """Scaled median absolute deviation (A4)."""
    return stats.mad(t.part, ["p_brand"], "p_retailprice").select("p_brand", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("""
SELECT user_id, event_type, CAST(count(e.event_id) AS BIGINT) AS n, round(count(e.event_id) / nullif(sum(count(e.event_id)) OVER (PARTITION BY user_id), 0), 6) AS share
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k LEFT JOIN events e USING (user_id, event_type) GROUP BY 1, 2""")
def composition_zero_fill(t: Tables) -> DataFrame:
    """Counts with zeros for absent types, and shares."""
    kinds = t.events.select("event_type").distinct()
    all_ = t.events.select("user_id").distinct().crossJoin(F.broadcast(kinds))  # a few event types
    n = stats.counts_with_zeros(t.events, all_, ["user_id", "event_type"])
    return n.withColumn("share", F.round(stats.share_of("n", ["user_id"]), 6))


@query("SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, bool_or(o_totalprice > 400000) AS any_large, bool_and(o_totalprice > 900) AS all_real, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS urgent FROM orders GROUP BY 1")
def order_flags(t: Tables) -> DataFrame:
    """Distinct counts and any, all and counted conditions."""
    p = F.col("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.bool_or(p > 400000).alias("any_large"), F.bool_and(p > 900).alias("all_real"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY 1")
def extreme_orders(t: Tables) -> DataFrame:
    """The key of the largest and the smallest value."""
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min_by("o_orderkey", "o_totalprice").alias("cheapest"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 100 >= l_tax * 100 AND l_discount * 100 >= l_quantity / 10 THEN 'discount' WHEN l_tax * 100 >= l_quantity / 10 THEN 'tax' ELSE 'quantity' END AS largest, (l_quantity > 45 OR l_discount > 0.09 OR l_tax > 0.07) AS any_high FROM lineitem")
def row_argmax(t: Tables) -> DataFrame:
    """The first column with a row's largest value, and any-of-several conditions."""
    names = ("discount", "tax", "quantity")
    values = F.array((F.col("l_discount") * 100).cast("double"), (F.col("l_tax") * 100).cast("double"), (F.col("l_quantity") / 10).cast("double"))
    largest = F.get(F.array(*map(F.lit, names)), (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", largest.alias("largest"), ((F.col("l_quantity") > 45) | (F.col("l_discount") > 0.09) | (F.col("l_tax") > 0.07)).alias("any_high"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def moments_corr(t: Tables) -> DataFrame:
    """Correlation from sums that combine over parts."""
    rows = t.lineitem.select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return stats.moments(rows, ["l_returnflag"], "x", "y").select("l_returnflag", F.round(stats.pearson_of_moments(), 6).alias("r"), "n")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM part GROUP BY 1")
def joined_types(t: Tables) -> DataFrame:
    """Sorted distinct values as one text."""
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"))


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F'), 4) AS difference FROM orders GROUP BY 1")
def flag_difference(t: Tables) -> DataFrame:
    """Difference of means by a flag."""
    rows = t.orders.withColumn("f", F.col("o_orderstatus") == "F")
    return stats.split_difference(rows, ["o_orderpriority"], "o_totalprice", "f").select("o_orderpriority", F.round("difference", 4).alias("difference"))


@query("SELECT * FROM (SELECT p_size, p_partkey, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS k FROM part) WHERE k = 1")
def unambiguous_names(t: Tables) -> DataFrame:
    """Rows whose key is theirs alone."""
    return joins.only_match(t.part, ["p_brand", "p_type", "p_size"]).select("p_size", "p_partkey").withColumn("k", F.lit(1).cast("long"))


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY 1")
def status_crosstab(t: Tables) -> DataFrame:
    """Counts pivoted on stated values."""
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("o_orderpriority", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "FOP"])


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t: Tables) -> DataFrame:
    """All grouping sets of two columns (A25, an extension)."""
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS exact FROM lineitem")
def exact_distinct_parts(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("exact"))


@query()
def approximate_distinct_parts(t: Tables) -> DataFrame:
    """HyperLogLog count (A24, an extension)."""
    return t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"))


@query("SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey)) / 2.0 AS mean_rank FROM supplier")
def mean_rank_integration(t: Tables) -> DataFrame:
    """Average of ranks by two measures."""
    return ordered.mean_rank(t.supplier, [F.desc("s_acctbal"), F.asc("s_suppkey")], [F.asc("s_name"), F.asc("s_suppkey")], ["s_nationkey"]).select("s_suppkey", "mean_rank")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS avg_rank FROM part")
def average_tie_ranks(t: Tables) -> DataFrame:
    """Ranks whose ties share their mean."""
    return t.part.select("p_partkey", ordered.average_ties("p_size", ["p_brand"]).alias("avg_rank"))


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
SELECT p_brand, max(p_partkey) FILTER (k = 1) AS best, max(p_partkey) FILTER (k = 2) AS runner_up, round(max(p_retailprice) FILTER (k = 1) - max(p_retailprice) FILTER (k = 2), 4) AS margin FROM r GROUP BY 1""")
def runner_up_margin(t: Tables) -> DataFrame:
    """Best and second of each group, and their margin."""
    return ordered.top_two(t.part, ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "best", "runner_up", F.round("margin", 4).alias("margin"))


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 6),
g AS (SELECT date_diff('day', DATE '1990-01-01', d) AS k, date_diff('day', DATE '1990-01-01', d) - row_number() OVER (ORDER BY d) AS i FROM d)
SELECT CAST(min(k) AS BIGINT) AS island_start, CAST(max(k) AS BIGINT) AS island_end, count(*) AS length FROM g GROUP BY i""")
def order_day_islands(t: Tables) -> DataFrame:
    """Runs of quiet days."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("k")
    return ordered.islands(t.orders.groupBy(day).count().filter("count <= 6").select("k"), [], "k")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem")
def price_ranks(t: Tables) -> DataFrame:
    """Ranks over a whole table, without one task that sorts it."""
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return ordered.ranked(t.lineitem, order).select("l_orderkey", "l_linenumber", "rank")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) % 1000003 / 1000003.0 AS p FROM lineitem),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_orderkey, l_linenumber) AS raw FROM p)
SELECT l_orderkey, l_linenumber, round(least(1.0, min(raw) OVER (ORDER BY p, l_orderkey, l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS adjusted FROM r""")
def lines_adjusted(t: Tables) -> DataFrame:
    """Benjamini-Hochberg adjustment over all rows, as a scan with carry."""
    p = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber")) % 1000003 / 1000003.0
    rows = t.lineitem.select("l_orderkey", "l_linenumber", p.alias("p"))
    return ordered.benjamini_hochberg(rows, "p", [], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round("adjusted", 8).alias("adjusted"))


@query("""
SELECT event_id, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cents_before,
  count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS most,
  last_value(CASE WHEN user_id % 7 = 0 THEN user_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seventh FROM events""")
def event_scan(t: Tables) -> DataFrame:
    """Running values in groups that may each be a large part of the table."""
    seventh = F.when(F.col("user_id") % 7 == 0, F.col("user_id"))
    running = {"cents_before": ordered.Running("sum", F.bround(F.col("value") * 100).cast("long"), before=True), "n": ordered.Running("count"), "most": ordered.Running("max", "value"), "seventh": ordered.Running("last", seventh, before=True)}
    run = ordered.scan(t.events, [F.asc("ts"), F.asc("event_id")], running, ["event_type"])
    return run.select("event_id", F.coalesce("cents_before", F.lit(0)).alias("cents_before"), "n", "most", "seventh")


@query("""
WITH v AS (SELECT CAST(round(l_extendedprice) AS BIGINT) * 10 AS s, CAST(round(l_extendedprice) AS BIGINT) * 10 + CAST(l_quantity AS BIGINT) AS e, l_orderkey, l_linenumber FROM lineitem),
m AS (SELECT *, max(e) OVER (ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (ORDER BY s, e, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS members FROM g GROUP BY i""")
def merged_prices(t: Tables) -> DataFrame:
    """Union of all intervals of a table, across its parts."""
    start = F.round("l_extendedprice").cast("long") * 10
    return ordered.merged(t.lineitem.select(start.alias("s"), (start + F.col("l_quantity").cast("long")).alias("e")), [], "s", "e")


@query("SELECT o_orderkey, CAST(coalesce(sum(c) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", l_linenumber FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS c FROM lineitem)")
def cumulative_offsets(t: Tables) -> DataFrame:
    """Sum of the sizes before each part."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("c"))
    return ordered.offsets(rows, ["o_orderkey"], [F.asc("l_linenumber"), F.asc("c")], "c").select("o_orderkey", "l_linenumber", "offset")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 4) AS ahead, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS step FROM events")
def rolling_value(t: Tables) -> DataFrame:
    """Windowed sums ahead, and differences to the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(ordered.rolling_sum("value", ["user_id"], [F.col("ts"), F.col("event_id")], 5), 4).alias("ahead"), F.round(F.col("value") - F.lag("value").over(w), 4).alias("step"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, (o_orderkey * 7919 % 100003) / 100003.0 AS p FROM orders),
r AS (SELECT *, p * count(*) OVER (PARTITION BY o_custkey % 5) / row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY p, o_orderkey) AS raw FROM p)
SELECT o_orderkey, round(least(1.0, min(raw) OVER (PARTITION BY o_custkey % 5 ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS adjusted FROM r""")
def bh_adjust(t: Tables) -> DataFrame:
    """Benjamini-Hochberg adjustment in groups."""
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("g"), (F.col("o_orderkey") * 7919 % 100003 / 100003.0).alias("p"))
    return ordered.benjamini_hochberg(rows, "p", ["g"], ["o_orderkey"]).select("o_orderkey", F.round("adjusted", 8).alias("adjusted"))


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders)
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM w WHERE b < 0.6 * s GROUP BY 1""")
def smallest_cover_share(t: Tables) -> DataFrame:
    """How many of a customer's largest orders make 60 % of their value."""
    return ordered.smallest_cover(t.orders, ["o_custkey"], "o_totalprice", [F.desc("o_totalprice"), F.asc("o_orderkey")], 0.6).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey)::INTEGER AS k FROM part) WHERE k <= 3")
def top_three_parts(t: Tables) -> DataFrame:
    """The first rows of each group in a composite order."""
    return ordered.ranked(t.part, [F.desc("p_size"), F.asc("p_retailprice"), F.asc("p_partkey")], ["p_brand"], "k").filter("k <= 3").select("p_brand", "p_partkey", "p_size", "k")


@query("SELECT l_partkey, round(var_pop(l_extendedprice) / 1e6, 6) AS v FROM lineitem GROUP BY 1 ORDER BY var_pop(l_extendedprice) DESC, l_partkey LIMIT 20")
def top_variance_parts(t: Tables) -> DataFrame:
    """Top k by variance, ties by key."""
    return t.lineitem.groupBy("l_partkey").agg(F.var_pop("l_extendedprice").alias("x")).orderBy(F.desc("x"), "l_partkey").limit(20).select("l_partkey", F.round(F.col("x") / 1e6, 6).alias("v"))


@query("SELECT p_brand, m AS top, CAST(count(*) AS BIGINT) AS tied FROM part JOIN (SELECT p_brand, max(p_size) AS m FROM part GROUP BY 1) USING (p_brand) WHERE p_size = m GROUP BY 1, 2")
def ties_at_top(t: Tables) -> DataFrame:
    """How many share the best value."""
    return ordered.tied_at_top(t.part, ["p_brand"], "p_size")


@query("SELECT o_orderstatus, array_to_string((list(o_orderkey ORDER BY o_orderkey))[1:8], ',') AS examples FROM orders GROUP BY 1")
def bounded_examples(t: Tables) -> DataFrame:
    """At most eight examples of each group, picked before they are collected."""
    few = ordered.top_k(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], [F.asc("o_orderkey")], 8)
    return few.groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("examples"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 350000 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_orderkey")
def categorical_order(t: Tables) -> DataFrame:
    """Order by a category's ordinal."""
    return t.orders.filter("o_totalprice > 350000").orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_of_shapes(t: Tables) -> DataFrame:
    """Union of tables of different shape by name."""
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT DISTINCT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b FROM supplier JOIN customer ON s_suppkey = c_custkey")
def symmetric_pairs(t: Tables) -> DataFrame:
    """Distinct unordered pairs."""
    return joins.symmetric_distinct(t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")), "a", "b")


@query(r"""
WITH n AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM part)
SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN p_size * 1e6 WHEN p_size % 3 = 1 THEN p_size * 1e3 ELSE p_size END AS DOUBLE) AS bases,
  p_size / 100.0 AS share, CAST(floor(p_size / 7.0) * 7 AS BIGINT) AS bucket, CAST(floor(p_retailprice / 100 + 0.5) * 100 AS BIGINT) AS hundred,
  p_size % 2 = 0 AS flag, p_size BETWEEN 10 AND 20 AS mid FROM n""")
def coerced_fields(t: Tables) -> DataFrame:
    """Units, percents, buckets, rounding and booleans read from text."""
    size = F.col("p_size").cast("string")
    text = F.concat(size, F.when(F.col("p_size") % 3 == 0, " Mb").when(F.col("p_size") % 3 == 1, "kb").otherwise(""))
    return t.part.select(
        "p_partkey",
        coerce.with_unit(text, {"mb": 1e6, "kb": 1e3}).alias("bases"),
        coerce.fraction(F.concat(size, F.lit("%"))).alias("share"),
        coerce.bucket(F.col("p_size"), 7).cast("long").alias("bucket"),
        coerce.round_half_up(F.col("p_retailprice"), 100).cast("long").alias("hundred"),
        coerce.boolean(F.when(F.col("p_size") % 2 == 0, " Yes").otherwise("FALSE")).alias("flag"),
        F.col("p_size").between(10, 20).alias("mid"),
    )


@query("""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity < 5 THEN 'few' END, CASE WHEN l_tax > 0.06 THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM lineitem""")
def rejection_reasons(t: Tables) -> DataFrame:
    """Names of the conditions that hold."""
    r = coerce.rejections(discount=F.col("l_discount") > 0.08, few=F.col("l_quantity") < 5, tax=F.col("l_tax") > 0.06)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(r, ",").alias("reasons"))


@query("SELECT count(*) AS rows, CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS missing_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def missing_counts(t: Tables) -> DataFrame:
    """How often a field is missing (P20)."""
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderkey").isNull()).alias("missing_order"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice - l_quantity * 1000) <= greatest(0.02 * greatest(abs(l_extendedprice), abs(l_quantity * 1000)), 5.0)")
def tolerant_match(t: Tables) -> DataFrame:
    """Agreement within relative and absolute tolerance."""
    return t.lineitem.filter(coerce.near(F.col("l_extendedprice").cast("double"), (F.col("l_quantity") * 1000).cast("double"), rel=0.02, tol=5.0)).select("l_orderkey", "l_linenumber")
