"""Statistics, matrix, text-evidence, scoring and sequence queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, evidence
from ..operators import joins, ordered, scoring, sequence, solvers, stats
from ..streaming import events as streams
from .registry import Tables, query

_PRICES = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem"


def _prices(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))


@query(f"""
WITH v AS ({_PRICES}), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM v),
r AS (SELECT l_orderkey, l_linenumber, y - (a + b * x) AS e FROM v, f), m AS (SELECT median(e) AS m FROM r), d AS (SELECT median(abs(e - m)) * 1.4826 AS s FROM r, m)
SELECT l_orderkey, l_linenumber, round((e - m) / s, 5) + 0.0 AS z FROM r, m, d""")
def robust_price_z(t: Tables) -> DataFrame:
    """Residuals of a line fit as robust z-scores."""
    v = _prices(t)
    z = stats.robust_z(stats.residuals(v, stats.line_fit(v, [], "y", "x"), "y", "x"), "residual")
    return z.select("l_orderkey", "l_linenumber", (F.round("z", 5) + 0.0).alias("z"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def line_fits(t: Tables) -> DataFrame:
    """Slope, intercept and determination by group."""
    fit = stats.line_fit(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return fit.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


_MATRIX = "SELECT s_nationkey AS gene, l_returnflag || l_linestatus AS sample, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def _matrix(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("gene"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum("l_quantity").cast("double").alias("n"))


@query(f"""
WITH m AS ({_MATRIX}), k AS (SELECT count(DISTINCT sample) AS k FROM m), g AS (SELECT gene, exp(avg(ln(n))) AS g FROM m WHERE n > 0 GROUP BY gene HAVING count(*) = (SELECT k FROM k))
SELECT sample, round(median(n / g), 6) AS size_factor FROM m JOIN g USING (gene) GROUP BY sample""")
def median_ratio_factors(t: Tables) -> DataFrame:
    """Median-of-ratios size factors (M3)."""
    return stats.size_factors(_matrix(t), "gene", "sample", "n").select("sample", F.round("size_factor", 6).alias("size_factor"))


@query(f"WITH m AS ({_MATRIX}) SELECT gene, sample, round(ln(1 + n / sum(n) OVER (PARTITION BY sample) * 10000), 6) AS log_norm, round(n / avg(n) OVER (PARTITION BY gene), 6) AS relative FROM m")
def log_normalised_counts(t: Tables) -> DataFrame:
    """Library-size normalised logs and mean-relative profile (M1 M2)."""
    m = stats.log_normalised(_matrix(t), "sample", "n")
    return m.select("gene", "sample", F.round("log_norm", 6).alias("log_norm"), F.round(F.col("n") / F.avg("n").over(Window.partitionBy("gene")), 6).alias("relative"))


@query(f"""
WITH m AS ({_MATRIX}), s AS (SELECT gene, sample, (n - avg(n) OVER (PARTITION BY gene)) / nullif(stddev_pop(n) OVER (PARTITION BY gene), 0) AS z FROM m)
SELECT gene, sample, round(z, 5) + 0.0 AS z, round(exp(z - max(z) OVER (PARTITION BY gene)) / sum(exp(z)) OVER (PARTITION BY gene) * exp(max(z) OVER (PARTITION BY gene)), 6) AS confidence FROM s""")
def row_scores(t: Tables) -> DataFrame:
    """Row z-scores and softmax confidence."""
    z = _matrix(t).withColumn("z", stats.row_z("n", ["gene"]))
    return z.select("gene", "sample", (F.round("z", 5) + 0.0).alias("z"), F.round(stats.softmax("z", ["gene"]), 6).alias("confidence"))


@query(f"""
WITH m AS ({_MATRIX}) SELECT a.sample AS a, b.sample AS b, round(corr(a.n, b.n), 6) AS r, count(*) AS n FROM m a JOIN m b ON a.gene = b.gene AND a.sample < b.sample GROUP BY 1, 2""")
def sample_correlations(t: Tables) -> DataFrame:
    """Pairwise Pearson correlations of a long matrix's columns."""
    return stats.correlations(_matrix(t), "sample", "gene", "n").select("a", "b", F.round("r", 6).alias("r"), "n")


@query(f"""
WITH m AS ({_MATRIX}), r AS (SELECT gene, sample, rank() OVER (PARTITION BY sample ORDER BY n) + (count(*) OVER (PARTITION BY sample, n) - 1) / 2.0 AS k FROM m)
SELECT a.sample AS a, b.sample AS b, round(corr(a.k, b.k), 6) AS rho FROM r a JOIN r b ON a.gene = b.gene AND a.sample < b.sample GROUP BY 1, 2""")
def sample_spearman(t: Tables) -> DataFrame:
    """Rank correlation with average ties."""
    ranks = _matrix(t).withColumn("k", ordered.average_ties("n", ["sample"]))
    return stats.correlations(ranks, "sample", "gene", "k").select("a", "b", F.round("r", 6).alias("rho"))


@query("""
WITH p AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY ALL), u AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY nation)) AS u FROM p)
SELECT a.nation AS a, b.nation AS b, round(sum(a.u * b.u), 6) AS cosine FROM u a JOIN u b ON a.seg = b.seg AND a.nation < b.nation GROUP BY 1, 2""")
def nation_pair_similarity(t: Tables) -> DataFrame:
    """Cosine of nations' segment profiles."""
    p = t.customer.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return stats.cosine(p, "nation", "seg", "n").select("a", "b", F.round("cosine", 6).alias("cosine"))


def _centroids(t: Tables) -> DataFrame:
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    return cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))


@query("""
WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), c AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY 1, 2),
u AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS u FROM c)
SELECT a.label AS a, b.label AS b, round(sum(a.u * b.u), 5) + 0.0 AS cosine FROM u a JOIN u b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2""")
def embedding_centroid_cosine(t: Tables) -> DataFrame:
    """Cosine of label centroids."""
    return stats.cosine(_centroids(t), "label", "dim", "c").select("a", "b", (F.round("cosine", 5) + 0.0).alias("cosine"))


@query()
def centroid_assignment(t: Tables) -> DataFrame:
    """Best one-to-one match of label centroids of even and odd vectors."""
    half = lambda k: t.embeddings.filter(F.col("vec_id") % 2 == k).select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("c"))
    a, b = half(0).withColumnsRenamed({"label": "row", "c": "x"}), half(1).withColumnsRenamed({"label": "col", "c": "y"})
    weights = a.join(b, "dim").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("weight"))
    return solvers.assignment(weights, "row", "col", "weight")


@query("""
SELECT o_orderpriority, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high
FROM (SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / count(*) AS p, 1.959963984540054 AS z FROM orders GROUP BY 1)""")
def wilson_shares(t: Tables) -> DataFrame:
    """Wilson intervals of shares."""
    n = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return n.select("o_orderpriority", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""
WITH s AS (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m2, stddev_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS s1, stddev_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS s2, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus = 'O') AS n2 FROM orders)
SELECT round((m1 - m2) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 6) AS d FROM s""")
def price_effect_size(t: Tables) -> DataFrame:
    """Cohen's d of two groups."""
    return stats.effect_size(t.orders, "o_orderstatus", "F", "O", "o_totalprice").select(F.round("d", 6).alias("d"))


@query("SELECT o_orderpriority, round((sum(sum(o_totalprice)) OVER () - sum(o_totalprice)) / (sum(count(*)) OVER () - count(*)), 4) AS mean_without FROM orders GROUP BY 1")
def leave_one_out(t: Tables) -> DataFrame:
    """Jackknife means from totals."""
    return stats.jackknife(t.orders, "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round("mean_without", 4).alias("mean_without"))


@query("""
WITH c AS (SELECT p_brand, avg(p_retailprice) AS m, median(p_retailprice) AS d FROM part GROUP BY 1), e AS (SELECT 'mean' AS method, p_retailprice AS want, m AS got FROM part JOIN c USING (p_brand) UNION ALL SELECT 'median', p_retailprice, d FROM part JOIN c USING (p_brand)),
r AS (SELECT method, sqrt(avg((got - want) * (got - want))) AS rmse FROM e GROUP BY 1) SELECT method, round(rmse, 5) AS rmse, rmse = (SELECT min(rmse) FROM r) AS best FROM r""")
def method_selection(t: Tables) -> DataFrame:
    """The candidate method with the least error."""
    c = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.median("p_retailprice").alias("median"))
    e = t.part.join(c, "p_brand").select(F.col("p_retailprice").alias("want"), F.explode(F.array(F.struct(F.lit("mean").alias("method"), F.col("mean").alias("got")), F.struct(F.lit("median").alias("method"), F.col("median").alias("got")))).alias("m"))
    return stats.best_method(e.select("want", "m.*"), "method", "got", "want").select("method", F.round("rmse", 5).alias("rmse"), "best")


@query("SELECT cut, CAST(count(*) FILTER (l_discount <= cut + 1e-9) AS BIGINT) AS hits, count(*) AS n FROM lineitem, (VALUES (0.02), (0.05), (0.08)) c(cut) GROUP BY 1")
def threshold_sweep(t: Tables) -> DataFrame:
    """Hits at several thresholds in one pass."""
    return stats.thresholds(t.lineitem.withColumn("d", F.col("l_discount") - 1e-9), "d", [0.02, 0.05, 0.08]).select("cut", "hits", "n")


@query("""
WITH c AS (SELECT c_mktsegment AS seg, c_nationkey % 5 AS x, CAST(count(*) AS BIGINT) AS k FROM customer GROUP BY ALL)
SELECT seg, x, k, CAST(sum(k) OVER (PARTITION BY seg) AS BIGINT) AS drawn, CAST(sum(k) OVER (PARTITION BY x) AS BIGINT) AS marked, CAST(sum(k) OVER () AS BIGINT) AS total FROM c""")
def enrichment_counts(t: Tables) -> DataFrame:
    """The four numbers of an over-representation test."""
    n = t.customer.groupBy(F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 5).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    total = n.agg(F.sum("k").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("seg", "x", "k", F.sum("k").over(Window.partitionBy("seg")).alias("drawn"), F.sum("k").over(Window.partitionBy("x")).alias("marked"), "total")


@query("""
WITH c AS (SELECT c_mktsegment AS seg, c_nationkey % 5 AS x, CAST(count(*) AS BIGINT) AS k FROM customer GROUP BY ALL),
n AS (SELECT seg, x, k, CAST(sum(k) OVER (PARTITION BY seg) AS BIGINT) AS drawn, CAST(sum(k) OVER (PARTITION BY x) AS BIGINT) AS marked, CAST(sum(k) OVER () AS BIGINT) AS total FROM c),
t AS (SELECT *, least(1.0, list_sum(list_transform(range(greatest(k, drawn + marked - total, 0), least(drawn, marked) + 1), lambda i: exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1)
  - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1))))) AS p FROM n),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, seg, x) AS raw FROM t)
SELECT seg, x, k, drawn, marked, total, round(p, 8) AS p, round(least(1.0, min(raw) OVER (ORDER BY p, seg, x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS adjusted FROM r""")
def enrichment_p(t: Tables) -> DataFrame:
    """Hypergeometric tails, adjusted."""
    tails = solvers.hypergeometric(enrichment_counts(t), "k", "drawn", "marked", "total")
    out = ordered.benjamini_hochberg(tails, "p", [], ["seg", "x"])
    return out.withColumns({"p": F.round("p", 8), "adjusted": F.round("adjusted", 8)})


_SOLVED = """h AS (SELECT r, b0, b1, b2, sum(n * (y - p)) AS g0, sum(n * (y - p) * q) AS g1, sum(n * (y - p) * d) AS g2, sum(n * w) AS h00, sum(n * w * q) AS h01, sum(n * w * d) AS h02, sum(n * w * q * q) AS h11, sum(n * w * q * d) AS h12, sum(n * w * d * d) AS h22
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT it.*, y, q, d, n, 1 / (1 + exp(-(b0 + b1 * q + b2 * d))) AS p FROM it, v)) GROUP BY r, b0, b1, b2),
c AS (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM h)"""


@query(f"""
WITH RECURSIVE v AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_quantity AS DOUBLE) AS q, l_discount * 100 AS d, count(*) AS n FROM lineitem GROUP BY ALL),
it AS (SELECT 0 AS r, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 UNION ALL (WITH {_SOLVED} SELECT r + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det FROM c WHERE r < 12)),
{_SOLVED}, e AS (SELECT unnest(['(intercept)', 'quantity', 'discount']) AS term, unnest([b0, b1, b2]) AS estimate, unnest([sqrt(c00 / det), sqrt(c11 / det), sqrt(c22 / det)]) AS std_error FROM c WHERE r = 12),
z AS (SELECT *, estimate / std_error AS z FROM e)
SELECT term, round(estimate, 6) + 0.0 AS estimate, round(std_error, 7) AS std_error, round(z, 4) + 0.0 AS z, round(list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(abs(z) + i * 0.005, 2)))) * 0.005 / 3 * 2 / sqrt(2 * pi()), 6) AS p_value, round(exp(estimate), 6) AS odds_ratio FROM z""")
def return_model(t: Tables) -> DataFrame:
    """Logistic regression by reweighted least squares: estimates, errors, Wald tests and odds ratios; the SQL repeats the steps."""
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_discount") * 100).cast("double").alias("discount"))
    found = solvers.logistic(rows, "y", ["quantity", "discount"])
    return found.select("term", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("estimate", 6), ("std_error", 7), ("z", 4), ("p_value", 6), ("odds_ratio", 6))])


@query("""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\\s+')) AS s FROM documents), f AS (SELECT doc_id, regexp_matches(lower(s), '\\b(the|and)\\b') AS hit, regexp_matches(lower(s), '\\b(not|no|never|without)\\b') AS neg FROM s)
SELECT doc_id, bool_or(hit AND NOT neg) AS affirmed, bool_or(hit AND neg) AS denied, CAST(count(*) AS BIGINT) AS sentences FROM f GROUP BY 1""".replace("\\\\", "\\"))
def doc_negation_affirm(t: Tables) -> DataFrame:
    """Sentences that assert a term, and those that deny it."""
    return evidence.asserted(t.documents, "doc_id", "text", "the|and")


@query("SELECT doc_id, regexp_matches(lower(text), '(?s)\\bthe\\b.{0,40}\\bof\\b|\\bof\\b.{0,40}\\bthe\\b') AS close FROM documents")
def doc_term_proximity(t: Tables) -> DataFrame:
    """Two terms within a bounded distance, either way round."""
    return t.documents.select("doc_id", evidence.close(evidence.lowered(F.col("text")), evidence.word("the"), evidence.word("of"), 40).alias("close"))


@query("SELECT doc_id, CAST(len(x) AS BIGINT) AS numbers, CAST(coalesce(list_sum([CASE WHEN abs(TRY_CAST(v AS DOUBLE) - n_chars) <= 0.5 * n_chars THEN 1 ELSE 0 END FOR v IN x]), 0) AS BIGINT) AS consistent FROM (SELECT doc_id, n_chars, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') AS x FROM documents)")
def doc_number_consistency(t: Tables) -> DataFrame:
    """Numbers in a text that agree with a table's value."""
    return evidence.numbers_near(t.documents, "doc_id", "text", "n_chars", rel=0.5)


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
rare AS (SELECT g FROM bg GROUP BY g HAVING count(*) <= 3)
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) JOIN rare USING (g) GROUP BY 1, 2""")
def ngram_overlap(t: Tables) -> DataFrame:
    """Seed join on word 5-grams, with repeats of the target left out."""
    # grams of a text are made distinct in place, so that none of the documents' are shuffled but those that meet a target
    grams = lambda df, k: df.select(k, F.explode(F.array_distinct(joins.word_grams(F.col("text"), 5))).alias("g"))
    return joins.seed_join(grams(t.documents, "doc_id"), grams(t.benchmark, "item_id"), "g", most=3).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT key, count(*) AS n, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values FROM (SELECT e.event_id, j.key, j.value FROM events e, json_each(e.props) j) GROUP BY 1")
def props_json_leaves(t: Tables) -> DataFrame:
    """Leaves of JSON texts by key."""
    leaves = t.events.select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_values"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous, array_to_string(list(role ORDER BY turn, role), '>') AS roles FROM conversations GROUP BY 1")
def conversation_order_check(t: Tables) -> DataFrame:
    """Whether turns are contiguous, and the exact order of roles."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role)
    return t.conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), ((F.max("turn") - F.min("turn") + 1 == F.count(F.lit(1))) & (F.countDistinct("turn") == F.count(F.lit(1)))).alias("contiguous"), F.array_join(roles, ">").alias("roles")
    )


@query("""
WITH s AS (SELECT doc_id, least(40, n_chars // 100) AS core, CASE WHEN lang = 'en' THEN 15 ELSE 5 END AS direction, CASE WHEN quality = 1 THEN 5 ELSE 0 END AS summary, list_filter([CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN n_chars < 200 THEN 'SHORT' END], lambda x: x IS NOT NULL) AS f FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST(core + direction + summary + 20 AS BIGINT) AS total, len(f) = 0 AS hardgate_pass, CAST(CASE WHEN len(f) = 0 THEN core + direction + summary + 20 ELSE least(49, core + direction + summary + 20) END AS BIGINT) AS shown, array_to_string(list_sort(f), ',') AS codes FROM s""")
def quality_gate(t: Tables) -> DataFrame:
    """Scores, failure codes, hard gate and the cap of what a failed gate shows."""
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.least(F.lit(40), F.floor(F.col("n_chars") / 100)).alias("core"), F.when(F.col("lang") == "en", 15).otherwise(5).alias("direction"), F.when(F.col("quality") == 1, 5).otherwise(0).alias("summary"),
        coerce.rejections(TOXIC=F.col("toxic") == 1, SHORT=F.col("n_chars") < 200).alias("codes"),
    )
    return scoring.gated(rows, ["core", "direction", "summary"], "codes", 20).select("doc_id", "total", "hardgate_pass", "shown", F.array_join("codes", ",").alias("codes"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - abs(l_discount - 0.05) / 0.05), 4) + 0.0 AS linear, CAST(round_even(20.0 * l_linenumber / 7, 0) AS BIGINT) AS prorated FROM lineitem")
def graded_credit(t: Tables) -> DataFrame:
    """Linear credit by error, and prorated points rounded half to even."""
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.round(scoring.linear_credit(F.col("l_discount"), F.lit(0.05), 0.05), 4) + 0.0).alias("linear"), scoring.prorated(F.col("l_linenumber"), F.lit(7), 20).alias("prorated"))


@query("""
WITH j AS (SELECT doc_id, toxic, quality FROM labels), r AS (SELECT doc_id, (toxic * 3 + quality + doc_id % 4) % 6 AS r1, (quality * 2 + doc_id % 5) % 6 AS r2, (doc_id % 3) AS r3 FROM j)
SELECT doc_id, round((r1 + r2 + r3) / 3.0, 2) AS judged FROM r""")
def mean_of_runs(t: Tables) -> DataFrame:
    """Mean of three runs joined by key."""
    k = F.col("doc_id")
    runs = [t.labels.select("doc_id", ((F.col("toxic") * 3 + F.col("quality") + k % 4) % 6).alias("score")), t.labels.select("doc_id", ((F.col("quality") * 2 + k % 5) % 6).alias("score")), t.labels.select("doc_id", (k % 3).alias("score"))]
    return scoring.mean_of_runs(runs, ["doc_id"], "score").select("doc_id", F.round("mean_score", 2).alias("judged"))


_DNA = "SELECT p_partkey, translate(upper(p_name || p_type), 'BDEFHIJKLMNOPQRSUVWXYZ -#0123456789', 'ACGTACGTACGTACGTACGTAC') AS s FROM part"
_SEQ = "translate(upper(concat(p_name, p_type)), 'BDEFHIJKLMNOPQRSUVWXYZ -#0123456789', 'ACGTACGTACGTACGTACGTAC')"


@query(f"""
WITH d AS ({_DNA}) SELECT p_partkey, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, CAST(len(s) // 3 AS INTEGER) AS codons, len(s) % 3 = 0 AS whole, CAST(len(list_filter(range(1, len(s)), lambda i: s[i:i + 1] = 'AC')) AS INTEGER) AS motifs FROM d""")
def sequence_facts(t: Tables) -> DataFrame:
    """Reverse complements, codons and overlapping motif places."""
    d = t.part.select("p_partkey", F.expr(_SEQ).alias("s"))
    s = F.col("s")
    return d.select("p_partkey", sequence.reverse_complement(s).alias("rc"), F.size(sequence.codons(s)).alias("codons"), (F.length(s) % 3 == 0).alias("whole"), F.size(sequence.occurrences(s, F.lit("AC"))).alias("motifs"))


@query(f"""
WITH v AS (SELECT l_suppkey % 10 AS contig, CAST(l_extendedprice AS BIGINT) AS s, CAST(l_extendedprice AS BIGINT) + CAST(l_quantity AS BIGINT) * 40 AS e FROM lineitem),
b AS (SELECT contig, s, e, unnest(range(s // 1000, (e - 1) // 1000 + 1)) * 1000 AS bin FROM v WHERE e > s)
SELECT contig, bin, CAST(sum(least(e, bin + 1000) - greatest(s, bin)) AS BIGINT) AS depth FROM b GROUP BY 1, 2""")
def binned_coverage(t: Tables) -> DataFrame:
    """Overlap-weighted depth in bins."""
    v = t.lineitem.select((F.col("l_suppkey") % 10).alias("contig"), F.bround("l_extendedprice").cast("long").alias("s"), (F.bround("l_extendedprice").cast("long") + F.col("l_quantity").cast("long") * 40).alias("e"))
    return sequence.binned_depth(v, ["contig"], "s", "e", 1000)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_day_windows(t: Tables) -> DataFrame:
    """Tumbling windows, as the stream has them (an extension)."""
    w = streams.windowed_counts(t.events, "1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(t: Tables) -> DataFrame:
    """Sessions that end after two hours without events (an extension)."""
    return streams.user_sessions(t.events, "2 hours").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("""
WITH v AS (SELECT doc_id, regexp_matches(lower(text), '\\b(causes?|caused|causal|drives?|driven by|leads? to|results? in|proves?)\\b') AS causal, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents)
SELECT doc_id, causal, CAST(numbers AS INTEGER) AS numbers, CASE WHEN causal THEN 'claim' WHEN numbers > 0 THEN 'figures' ELSE 'plain' END AS kind FROM v""")
def doc_claims(t: Tables) -> DataFrame:
    """Causal wording and figures, as a cascade."""
    causal = F.lower("text").rlike(r"\b(causes?|caused|causal|drives?|driven by|leads? to|results? in|proves?)\b")
    d = t.documents.select("doc_id", causal.alias("causal"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"))
    return d.withColumn("kind", F.when(F.col("causal"), "claim").when(F.col("numbers") > 0, "figures").otherwise("plain"))


@query("SELECT n_nationkey AS nation, s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 2) AS apart FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey WHERE abs(s_acctbal - c_acctbal) < 5")
def near_balances(t: Tables) -> DataFrame:
    """Pairs within a group that lie within a window."""
    bucket = lambda x: F.floor(F.col(x) / 5)  # noqa: E731  # as wide as the window, so a match is in the same or a neighbouring one
    a = t.supplier.select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("x"), F.explode(F.sequence(bucket("s_acctbal") - 1, bucket("s_acctbal") + 1)).alias("b"))
    b = t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("y"), bucket("c_acctbal").alias("b"))
    return a.join(b, ["nation", "b"]).filter(F.abs(F.col("x") - F.col("y")) < 5).select("nation", "s_suppkey", "c_custkey", F.round(F.abs(F.col("x") - F.col("y")), 2).alias("apart"))
