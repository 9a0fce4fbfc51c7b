"""Library operators on small tables with known answers, and every query against its SQL."""

import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.functions import coerce, evidence
from tessella.operators import joins, ordered, scoring, sequence, solvers, stats

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (bool, np.bool_, str)):
        return v
    return None if pd.isna(v) else float(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), db.sql(plans.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


# ------------------------------------------------------------------- coerce


def test_numbers_and_units(spark):
    df = spark.createDataFrame([("1,200",), ("nan",), ("inf",), ("x",), (None,), ("-2.5e1",)], "t string")
    assert [r[0] for r in df.select(coerce.number(F.col("t"))).collect()] == [1200.0, None, None, None, None, -25.0]
    one = spark.createDataFrame([("1.5 Mb", "12%", "yes", " chrMT", "3/4", "0.125")], "a string, b string, c string, d string, e string, f string")
    got = one.select(coerce.with_unit(F.col("a"), {"mb": 1e6}), coerce.fraction(F.col("b")), coerce.boolean(F.col("c")), coerce.chromosome(F.col("d")), coerce.ratio_text(F.col("e")), coerce.written_tolerance(F.col("f"))).head()
    assert got[:5] == (1.5e6, 0.12, True, "M", 0.75) and math.isclose(got[5], 0.500001e-3)


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Cell ID` int, Value int")
    assert coerce.resolve_columns(df, {"cell_id": [], "value": [], "other": ["x"]}).columns == ["cell_id", "value", "other"]
    with pytest.raises(ValueError):
        coerce.resolve_columns(df, {"a": []}, "exact")
    with pytest.raises(ValueError):
        coerce.resolve_columns(df, {"a": []}, "required")


# -------------------------------------------------------------------- joins


def test_interval_joins_equal_nested_loop(spark):
    rng = np.random.default_rng(0)
    make = lambda n: [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, n), rng.integers(-50, 200, n), rng.integers(0, 60, n), strict=True)]
    left, right = make(60), make(50)
    l_ = spark.createDataFrame(left, "k int, l_start long, l_end long")
    r_ = spark.createDataFrame(right, "k int, r_start long, r_end long")
    want = sorted((a[0], a[1], a[2], b[1], b[2], min(a[2], b[2]) - max(a[1], b[1])) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2])
    for width in (7, 64, 1000):
        got = joins.interval_overlap(l_, r_, ["k"], width).select("k", "l_start", "l_end", "r_start", "r_end", "overlap")
        assert sorted(map(tuple, got.collect())) == want
    assert joins.interval_overlap(l_, r_, ["k"], 16, "left").select("k", "l_start", "l_end").distinct().count() == len(set(left))
    inside = sorted((a[0], a[1], b[1], b[2]) for a in left for b in right if a[0] == b[0] and b[1] <= a[1] < b[2])
    points = l_.select("k", F.col("l_start").alias("at"))
    got = joins.point_in_interval(points, r_.withColumnsRenamed({"r_start": "start", "r_end": "end"}), ["k"], 13).select("k", "at", "start", "end")
    assert sorted(map(tuple, got.collect())) == inside


def test_lag_join_counts_gaps(spark):
    df = spark.createDataFrame([("a", t, float(t * t)) for t in (0, 1, 2, 4, 5)] + [("b", 0, 1.0)], "k string, t int, v double")
    got = dict((r.lag, r.n) for r in joins.lag_correlation(df, ["k"], "t", "v", "v", [0, 1, 2]).collect())
    assert got == {0: 6, 1: 3, 2: 2}
    flat = spark.createDataFrame([("a", t, 1.0) for t in range(4)], "k string, t int, v double")
    assert joins.lag_correlation(flat, ["k"], "t", "v", "v", [0]).head().r is None


def test_as_of_and_seeds(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 10, "z")], "k int, t int, v string")
    assert rows(joins.as_of(left, right, ["k"], "t", ["v"]), "k", "t") == [(1, 1, None), (1, 5, "y"), (2, 9, None)]
    q = spark.createDataFrame([("aa",), ("ab",)], "seed string")
    t = spark.createDataFrame([("aa", i) for i in range(5)] + [("ab", 9)], "seed string, at int")
    assert rows(joins.seed_join(q, t, "seed", most=3), "at") == [("ab", 9)]


# ------------------------------------------------------------------ ordered


def test_islands_merges_and_gaps(spark):
    df = spark.createDataFrame([(0, p) for p in (1, 2, 3, 7, 8, 20)], "g int, p long")
    runs = ordered.islands(df, ["g"], "p")
    assert rows(runs.select("island_start", "island_end", "length"), "island_start") == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]
    assert ordered.longest_island(runs, ["g"]).head().length == 3
    iv = spark.createDataFrame([(0, 1, 5), (0, 4, 6), (0, 6, 7), (0, 9, 12), (0, 10, 11)], "g int, start int, end int")
    assert rows(ordered.merged(iv, ["g"]).select("start", "end", "members"), "start") == [(1, 7, 3), (9, 12, 2)]
    assert rows(ordered.merged(iv, ["g"], slack=2).select("start", "end"), "start") == [(1, 12)]
    assert rows(ordered.gaps(iv, ["g"]).select("gap_start", "gap_end"), "gap_start") == [(7, 9)]
    assert ordered.overlapping_neighbours(iv, ["g"], "start", "end").count() == 2


def test_greedy_clusters_differ_from_sessions(spark):
    df = spark.createDataFrame([(0, p) for p in (0, 8, 16, 24)], "g int, p int")
    assert [r[2] for r in rows(ordered.greedy_clusters(df, ["g"], "p", 10), "p")] == [1, 1, 2, 2]
    assert [r[2] for r in rows(ordered.sessions(df, ["g"], "p", 10), "p")] == [1, 1, 1, 1]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "g int, i int, p double")
    got = [r.adjusted for r in ordered.benjamini_hochberg(df, "p", ["g"], ["i"]).orderBy("i").collect()]
    assert np.allclose(got, [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


# -------------------------------------------------------------------- stats


def test_effect_size_and_size_factors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 6.0)], "g string, v double")
    assert math.isclose(stats.effect_size(df, "g", "b", "a", "v").head().d, 3 / math.sqrt(2))
    base = [("g1", 10.0), ("g2", 20.0), ("g3", 40.0)]
    m = spark.createDataFrame([(g, "s1", v) for g, v in base] + [(g, "s2", 2 * v) for g, v in base] + [("g4", "s1", 0.0), ("g4", "s2", 9.0)], "g string, s string, v double")
    f = dict(map(tuple, stats.size_factors(m, "g", "s", "v").collect()))
    assert math.isclose(f["s2"] / f["s1"], 2.0)


def test_constant_rows_have_no_score(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 1.0), ("b", 2, 3.0)], "r string, f int, v double")
    got = {(r.r, r.f): r.z for r in df.withColumn("z", stats.row_z("v", ["r"])).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", 1): -1.0, ("b", 2): 1.0}
    assert stats.robust_z(df.filter("r = 'a'"), "v").filter("z is not null").count() == 0


def test_swap_gain_finds_the_swap(spark):
    sim = {("A", "A"): 0.1, ("A", "B"): 0.9, ("A", "C"): 0.0, ("B", "A"): 0.8, ("B", "B"): 0.2, ("B", "C"): 0.1, ("C", "A"): 0.1, ("C", "B"): 0.0, ("C", "C"): 1.0}
    df = spark.createDataFrame([(i, l_, v) for (i, l_), v in sim.items()], "item string, label string, v double")
    best = stats.swap_gain(df, "item", "label", "v").orderBy(F.desc("swap_score")).head()
    assert (best.a, best.b) == ("A", "B") and math.isclose(best.swap_score, 0.6)


# ----------------------------------------------------------------- sequence


def test_sequence_expressions(spark):
    s = spark.createDataFrame([("ATGAAATAGGG", "AAAA", "GATTACA")], "a string, b string, c string")
    got = s.select(
        sequence.reverse_complement(F.col("a")), sequence.translated(F.col("a")), sequence.inframe_stops(F.col("a")), sequence.occurrences(F.col("b"), F.lit("AA")), sequence.homopolymer(F.col("a")),
        sequence.mismatches(F.col("c"), F.lit("GACTATA")), sequence.nearest_motif(F.col("c"), F.lit("TTG")), sequence.occurrences(F.col("b"), F.lit("")),
    ).head()
    assert got[0] == "CCCTATTTCAT" and got[1] == "MK*" and got[2] == [2] and got[3] == [0, 1, 2] and got[4] == 3 and got[5] == 2
    assert (got[6].distance, got[6].at) == (1, 2) and got[7] == []


def test_amplicons_and_cigar(spark):
    s = spark.createDataFrame([("TTACGTACCCGGATT", "ACG", "ATCC")], "t string, f string, r string")
    assert [(x.start, x.end, x["size"]) for x in s.select(sequence.amplicons(F.col("t"), F.col("f"), F.col("r")).alias("x")).head().x] == [(2, 14, 12)]
    c = spark.createDataFrame([("ACGTACGT", "2S3M1I1D2M", 100)], "seq string, cigar string, pos int")
    at = lambda p: c.select(sequence.base_at(F.col("seq"), F.col("cigar"), F.col("pos"), F.lit(p))).head()[0]
    assert [at(p) for p in (99, 100, 102, 103, 104, 105, 106)] == [None, "G", "A", None, "G", "T", None]
    assert c.select(sequence.reference_span(F.col("cigar"))).head()[0] == 6


def test_reference_lookup_over_chunks(spark):
    genome = "ACGT" * 20 + "GGCC"
    g = spark.createDataFrame([("c", genome)], "chrom string, seq string")
    chunks = sequence.chunked(g, "chrom", "seq", 16, 3)
    sites = spark.createDataFrame([("c", p, genome[p : p + n]) for p, n in ((0, 1), (14, 4), (15, 2), (80, 4))] + [("d", 1, "A")], "chrom string, pos long, ref string")
    got = sequence.reference_lookup(sites, chunks, "chrom", "pos", F.length("ref"), 16)
    assert got.filter("chrom = 'c' AND ref <> reference").count() == 0
    assert got.filter("chrom = 'd' AND reference IS NOT NULL").count() == 0
    rate = sequence.match_rate(got.withColumn("build", F.lit("x")), "build", "reference", "ref").head()
    assert (rate.n, rate.matches) == (4, 4)


# ------------------------------------------------------- evidence and scores


def test_text_evidence(spark):
    t = spark.createDataFrame([(1, "Guide g02 is the top choice. It may cause harm; but X causes Y. Do not use g03.")], "id int, t string")
    got = t.select(evidence.top_choice(F.col("t"), r"g\d+"), evidence.polarity(F.lit("Do not use")), evidence.says_number(F.lit("There are three guides"), 3, "guide")).head()
    assert tuple(got) == ("g02", "negative", True)
    assert evidence.overclaims(t, "id", "t").head()[1:] == (1, 1)


def test_scores(spark):
    df = spark.createDataFrame([(40, 15, []), (40, None, ["X"])], "a int, b int, codes array<string>")
    assert [(r.total, r.hardgate_pass, r.shown) for r in scoring.gated(df, ["a", "b"], "codes", 20).collect()] == [(75, True, 75), (60, False, 49)]
    steps = spark.createDataFrame([("w", 1, "pick"), ("w", 2, "use"), ("w", 3, "drop"), ("v", 1, "drop")], "well string, i int, step string")
    assert rows(scoring.paired(steps, "well", "i", "step", "pick", "drop"), "well") == [("v", False), ("w", True)]
    assert [r.ok for r in scoring.exact_sequence(steps, "well", "i", "step", ["pick", "use", "drop"]).orderBy("well").collect()] == [False, True]


# ------------------------------------------------------------------ solvers


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        w = rng.normal(size=(n, m)).round(1)
        best = max(sum(w[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        got = solvers.best_assignment(w)
        assert len(set(got)) == n and math.isclose(w[range(n), got].sum(), best, abs_tol=1e-9)


def test_mixtures_recover_weights(spark):
    rng = np.random.default_rng(2)
    a, w = rng.random((30, 4)), np.array([0.5, 0.3, 0.2, 0.0])
    assert np.allclose(solvers.nonnegative_fit(a, a @ w), w, atol=1e-8)
    p = a / a.sum(axis=0)
    assert np.allclose(solvers.multinomial_mixture(p, p @ w * 1e5, 20_000), w, atol=1e-2)
    profiles = spark.createDataFrame([(f"f{i}", f"k{j}", float(a[i, j])) for i in range(30) for j in range(4)], "f string, kind string, v double")
    spots = spark.createDataFrame([("s", f"f{i}", float(v)) for i, v in enumerate(a @ w)], "spot string, f string, v double")
    got = {r.kind: r.weight for r in solvers.unmix(spots, profiles, "spot", "f", "v", "kind").collect()}
    assert np.allclose([got[f"k{j}"] for j in range(4)], w, atol=1e-6)


def test_power_matches_known_size():
    assert solvers.minimum_n(0.21628) == 337
    assert solvers.two_sample_power(0.21628, 337) >= 0.8 > solvers.two_sample_power(0.21628, 336)


def test_logistic_and_tails(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int)
    got = {r.term: r for r in solvers.logistic(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", ["x"]).collect()}
    assert abs(got["x"].estimate - 1.2) < 0.15 and abs(got["(intercept)"].estimate - 0.5) < 0.12 and got["x"].p_value < 1e-20
    with pytest.raises(ValueError):
        solvers.logistic(spark.createDataFrame(pd.DataFrame({"x": x, "z": 2 * x, "y": y})), "y", ["x", "z"])
    assert math.isclose(solvers.hypergeometric_tail(2, 3, 4, 10), 1 / 3)
    assert math.isclose(solvers.binomial_tail(8, 10, 0.5), 56 / 1024)
    assert math.isclose(solvers.students_t_p(0.5, 20), 0.02477, abs_tol=2e-4)


def test_leaks_refuses_too_many_labels(spark):
    import pytest

    from tessella.operators.validate import leaks

    ids = spark.createDataFrame([("x-label10005-y",)], "item string")
    labels = spark.range(10_006).selectExpr("concat('label', id) AS label")
    with pytest.raises(ValueError, match="10,000"):
        leaks(ids, labels, "item", "label")
