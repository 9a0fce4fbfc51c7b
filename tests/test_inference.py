"""Mixtures, resampling, counts models, axes and assignments against plain numpy."""

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import mixtures, solvers


def long(spark, m, key, names="long", start=0):
    """A matrix as ``key, f, v``; zeros are missing."""
    rows = [(start + i, f"f{j:03d}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]]
    return spark.createDataFrame(rows, f"{key} {names}, f string, v double")


def test_subset_fits(spark):
    rng = np.random.default_rng(71)
    p = rng.random((6, 12)) * (rng.random((6, 12)) < 0.7)
    p[5] = 2 * p[4]  # spans no more than its half
    y = np.vstack([rng.random((5, 6)) @ p + 0.1 * rng.random((5, 12)), p[:1], rng.random((3, 12)), -p[1:2]])
    got = mixtures.subset_fits(long(spark, y, "spot"), long(spark, p, "kind"), "spot", "f", "v", "kind", 3, all_subsets=True).collect()
    found = {(r.spot, tuple(r.kinds)): r for r in got}
    assert len(found) == len(got) == len(y) * (6 + 15 + 20)
    for i in range(len(y)):
        for k in (1, 2, 3):
            for s in combinations(range(6), k):
                w = solvers.nonnegative_fit(p[list(s)].T, y[i])
                want = float(((y[i] - w @ p[list(s)]) ** 2).sum())
                r = found[i, s]
                assert r.residual == pytest.approx(want, abs=1e-8), (i, s)
                assert ((y[i] - np.array(r.weights) @ p[list(s)]) ** 2).sum() == pytest.approx(want, abs=1e-8) and min(r.weights) >= 0
    best = mixtures.subset_fits(long(spark, y, "spot"), long(spark, p, "kind"), "spot", "f", "v", "kind", 2).collect()
    assert len(best) == 2 * len(y) and all(r.residual <= min(x.residual for (i, s), x in found.items() if i == r.spot and len(s) == r["size"]) + 1e-12 for r in best)
    assert mixtures.subset_fits(long(spark, y, "spot").limit(0), long(spark, p, "kind"), "spot", "f", "v", "kind").count() == 0


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_most_correlated(spark, monkeypatch, block):
    monkeypatch.setattr(mixtures, "BLOCK", block)
    rng = np.random.default_rng(72)
    items, queries = rng.integers(0, 4, (90, 5)).astype(float), rng.integers(0, 9, (7, 5)).astype(float)
    items[3], items[8] = 0, 2  # constant rows
    table = long(spark, items, "item").withColumn("label", F.when(F.col("item") % 3 == 0, "a").otherwise("b")).repartition(6)
    got = mixtures.most_correlated(long(spark, queries, "spot"), table, "spot", "item", "f", "v", 10, ["label"]).collect()
    for q in range(7):
        r = {i: round(float(np.corrcoef(queries[q], items[i])[0, 1]), 9) for i in range(90) if items[i].std() > 0}
        want = sorted(r, key=lambda i: (-r[i], i))[:10]
        own = sorted((x for x in got if x.spot == q), key=lambda x: x["rank"])
        assert [x.item for x in own] == want and all(x.label == ("a" if x.item % 3 == 0 else "b") for x in own)
    assert mixtures.most_correlated(long(spark, queries, "spot").limit(0), table, "spot", "item", "f", "v", 10).count() == 0


def test_nonnegative_columns(spark):
    rng = np.random.default_rng(73)
    items = rng.random((60, 15))
    target = rng.random(60) * (rng.random(60) < 0.1) @ items + 0.05 * rng.random(15)
    t = spark.createDataFrame([(f"f{j:03d}", float(target[j])) for j in range(15)], "f string, v double")
    got = {r.item: r.weight for r in mixtures.nonnegative_columns(t, long(spark, items, "item"), "item", "f", "v", at_once=3).collect()}
    w = solvers.nonnegative_fit(items.T, target)
    mine = np.array([got.get(i, 0.0) for i in range(60)])
    assert (mine >= 0).all() and ((target - mine @ items) ** 2).sum() == pytest.approx(((target - w @ items) ** 2).sum(), abs=1e-7)


def test_mixtures_of_many_spots():
    rng = np.random.default_rng(74)
    p = rng.random((30, 3))
    p /= p.sum(axis=0)
    w = rng.dirichlet([1, 1, 1], 8)
    counts = np.vstack([w @ p.T * 1e4, np.zeros((1, 30))])
    got = solvers.multinomial_mixture(p, counts)
    assert np.allclose(got[:8], w, atol=1e-4) and np.allclose(got[8], 1 / 3)
    with pytest.raises(ValueError, match="convergence"):
        solvers.multinomial_mixture(p, counts, 2)


# -------------------------------------------------------------- resampling


def test_bootstrap_of_clusters(spark):
    from tessella.operators import resampling

    rng = np.random.default_rng(75)
    rows = [(int(u), f"g{u % 2}", float(10 * (u % 2) + rng.normal(0, 1) + u / 50)) for u in range(200) for _ in range(3)]
    df = spark.createDataFrame(rows, "u long, g string, v double")
    values = resampling.bootstrap(df, "u", {"s": F.sum("v"), "n": F.count(F.lit(1))}, F.col("s") / F.col("n"), 400, ["g"])
    again = resampling.bootstrap(df.repartition(9), "u", {"s": F.sum("v"), "n": F.count(F.lit(1))}, F.col("s") / F.col("n"), 400, ["g"])
    key = lambda d: sorted((r.g, r.round, round(r.value, 9)) for r in d.collect())
    assert key(values) == key(again)
    for r in resampling.bounds(values.filter("round > 0"), ["g"], "value").collect():
        own = np.array([v for _, g, v in rows if g == r.g])
        units = own.reshape(-1, 3).mean(axis=1)
        assert r.low < own.mean() < r.high and r.rounds == 400
        assert (r.high - r.low) / (2 * 1.96 * units.std(ddof=1) / np.sqrt(len(units))) == pytest.approx(1, abs=0.25)


def test_poisson_draws(spark):
    from tessella.operators import resampling

    n = spark.range(20_000).select(resampling.poisson_draw(resampling.uniform(F.lit("x"), "id")).alias("w")).groupBy("w").count().toPandas().set_index("w")["count"] / 20_000
    assert [abs(n[k] - np.exp(-1) / f) < 0.015 for k, f in enumerate((1, 1, 2, 6))] == [True] * 4


def test_mixture_with_a_weight_that_fades_slowly():
    """A weight of exactly zero at the optimum, and many noisy spots at once: both converge, at points where no weight should grow."""
    for seed in range(5):
        rng = np.random.default_rng(seed)
        p = rng.random((30, 4))
        p, w = p / p.sum(axis=0), np.array([0.5, 0.3, 0.2, 0.0])
        assert np.allclose(solvers.multinomial_mixture(p, p @ w * 1e5), w, atol=1e-4)
        n = rng.poisson(p @ w * 1e4, size=(20, 30))
        got = solvers.multinomial_mixture(p, n)
        slope = (n / (got @ p.T)) @ p / n.sum(axis=1, keepdims=True)
        assert slope.max() < 1 + 1e-4 and np.abs((slope - 1) * got).max() < 1e-6 and np.allclose(got.sum(axis=1), 1)


def test_permutation(spark):
    from tessella.operators import resampling

    rng = np.random.default_rng(76)
    rows = [(i, g, i % 3 == 0, float(rng.normal(0, 1) + (1.5 if g == "shifted" and i % 3 == 0 else 0))) for i in range(90) for g in ("shifted", "same", "alone") if g != "alone" or i % 3]
    out = {r.g: r for r in resampling.permutation_test(spark.createDataFrame(rows, "i long, g string, f boolean, v double"), "i", "f", "v", 199, ["g"]).collect()}
    assert out["shifted"].p == pytest.approx(1 / 200) and out["shifted"].z > 4
    assert 0.01 < out["same"].p <= 1 and abs(out["same"].null_mean) < 0.1
    assert out["alone"].p is None and out["alone"].observed is None
    whole = resampling.permutation_test(spark.createDataFrame(rows, "i long, g string, f boolean, v double").filter("g = 'shifted'"), "i", "f", "v", 199).head()
    assert whole.observed == pytest.approx(out["shifted"].observed) and whole.p == out["shifted"].p


def test_permutation_orders_few_rows(spark, monkeypatch):
    """Each round as a plain loop has it, though only one range of the digest is put in order."""
    import hashlib

    from tessella.operators import ordered, resampling

    rng = np.random.default_rng(79)
    share = {"few": 0.02, "most": 0.9, "none": 0.0, "all": 1.0}
    rows = [(i, g, bool(rng.random() < p), None if i % 97 == 5 else float(rng.normal())) for g, p in share.items() for i in range(600)]
    seen, scan = [], ordered.scan
    monkeypatch.setattr(ordered, "scan", lambda df, *a: (seen.append(df.count()), scan(df, *a))[1])
    df = spark.createDataFrame(rows, "i long, g string, f boolean, v double")
    got = {r.g: r for r in resampling.permutation_test(df, "i", "f", "v", 30, ["g"]).collect()}
    assert len(got) == 4 and 0 < seen[0] < len(rows) * 30 / 50
    for g in share:
        own = {i: (f, v or 0.0) for i, h, f, v in rows if h == g}
        n, k, t = len(own), sum(f for f, _ in own.values()), sum(v for _, v in own.values())
        if k in (0, n):
            assert got[g].observed is None and got[g].null_mean is None and got[g].p is None
            continue
        null = []
        for r in range(1, 31):
            order = sorted(own, key=lambda i: (int(hashlib.md5(f"p-{r}-{i}".encode()).hexdigest()[:8], 16), i))
            s = sum(own[i][1] for i in order[:k])
            null.append(s / k - (t - s) / (n - k))
        s = sum(v for f, v in own.values() if f)
        assert got[g].observed == pytest.approx(s / k - (t - s) / (n - k)) and got[g].null_mean == pytest.approx(np.mean(null)) and got[g].null_sd == pytest.approx(np.std(null, ddof=1))


def test_multinomial_and_mixture_bootstrap(spark):
    from tessella.operators import resampling

    shares = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 3.0), ("x", "c", 0.0), ("y", "d", 2.0)], "g string, c string, s double")
    got = resampling.multinomial(shares, "c", "s", 5000, 4, ["g"]).toPandas()
    assert got.groupby(["g", "round"])["n"].sum().eq(5000).all() and "c" not in set(got["c"])
    assert (got[got["c"] == "b"]["n"] / 5000 - 0.75).abs().max() < 0.03
    rng = np.random.default_rng(77)
    p = rng.random((2, 8))
    profiles = long(spark, p, "kind", "int").withColumn("kind", F.concat(F.lit("k"), "kind"))
    mix = 0.3 * p[0] / p[0].sum() + 0.7 * p[1] / p[1].sum()
    counts = spark.createDataFrame([(f"f{j:03d}", float(1e4 * mix[j])) for j in range(8)], "f string, v double")
    fit, drawn = resampling.mixture_bootstrap(counts, profiles, "f", "v", "kind", 2000, 20)
    assert {r.kind: round(r.weight, 3) for r in fit.collect()} == {"k0": 0.3, "k1": 0.7}
    found = {r.kind: r for r in resampling.bounds(drawn, ["kind"], "weight").collect()}
    assert found["k0"].low < 0.3 < found["k0"].high and found["k0"].high - found["k0"].low < 0.4


def test_vote_confidence(spark):
    from tessella.operators import resampling

    rows = [(u, c, f"f{i}", 2.0 if c == "a" and u == 1 else 1.0 if (i + len(c)) % 2 else 0.9) for u in (1, 2) for c in ("a", "bb") for i in range(8)]
    got = {(r.u, r.c): r.confidence for r in resampling.vote_confidence(spark.createDataFrame(rows, "u int, c string, f string, s double"), "u", "c", "f", "s", 100).collect()}
    assert got[1, "a"] == 1.0 and (1, "bb") not in got and 0.1 < got[2, "a"] < 0.9 and got[2, "a"] + got[2, "bb"] == pytest.approx(1)


def test_design_ranks(spark):
    rng = np.random.default_rng(78)
    rows = [(g, float(x := rng.normal(1e6, 1)), float(2 * x + 1 if g == 0 else rng.normal()), 5.0 if g < 2 else float(rng.normal())) for g in range(3) for _ in range(40)] + [(3, None, 1.0, 1.0), (4, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    assert {(r.g, r["rank"], r.n) for r in solvers.design_ranks(df, ["g"], ["x", "y", "z"]).collect()} == {(0, 2, 40), (1, 3, 40), (2, 4, 40), (3, 0, 0), (4, 1, 1)}
    assert solvers.design_ranks(df, [], ["x"]).head()["rank"] == 2


# ------------------------------------------------------------ counts, axes


def test_f_quantile():
    from tessella.operators.counts import f_quantile

    assert [f_quantile(0.99, *d) for d in ((2, 10), (1, 4), (5, 30))] == pytest.approx([7.559, 21.198, 3.699], rel=1e-3)


def test_negative_binomial(spark):
    from tessella.operators import counts

    rng = np.random.default_rng(79)
    n, arm, batch = 14, np.arange(14) % 2, (np.arange(14) // 7)
    f = np.exp(rng.normal(0, 0.3, n))
    fold = np.where(np.arange(60) < 5, 2.0, np.where(np.arange(60) < 10, -2.0, 0.0))  # as many up as down
    mu = np.exp(rng.normal(5, 0.5, 60))[:, None] * np.exp(fold[:, None] * np.log(2) * arm + 0.4 * batch) * f
    k = rng.negative_binomial(20, 20 / (20 + mu)).astype(float)
    k[30, 3] = k[30].max() * 60  # far out
    k[50] = 0
    k[51, arm == 1] = 0
    table = spark.createDataFrame([(f"g{i:02d}", j, float(k[i, j])) for i in range(60) for j in range(n) if k[i, j]], "gene string, s int, v double").repartition(5)
    design = spark.createDataFrame([(j, int(arm[j]), int(batch[j])) for j in range(n)], "s int, arm int, batch int")
    got = {r.gene: r for r in counts.negative_binomial(table, "gene", "s", "v", design, ["arm", "batch"], "arm").collect()}
    assert len(got) == 59  # a gene without any count is not in the table
    true = [got[f"g{i:02d}"] for i in range(50)]
    assert all(r.adjusted < 0.01 and abs(r.log2_fold_change - fold[i]) < 0.8 for i, r in enumerate(true[:10]))
    assert np.mean([r.p < 0.05 for r in true[10:]]) < 0.2  # dispersions of moments are not shared between genes
    far = got["g30"]
    assert far.replaced == 1 and far.most_cook > 10 and abs(far.log2_fold_change) < 1
    assert sum(r.replaced for r in true) <= 3 and all(r.adjusted >= r.p - 1e-12 for r in true)
    # scores are zero where the fit ends
    x = np.column_stack([np.ones(n), arm, batch]).astype(float)
    alpha = counts.dispersions(k[:50], f, x)
    beta, covariance, mean = counts.fit(k[:50], f, x, alpha)
    score = ((k[:50] - mean) / (1 + alpha[:, None] * mean)) @ x
    assert np.abs(score).max() < 1e-5 and np.isfinite(beta).all() and (np.diagonal(covariance, axis1=1, axis2=2) > 0).all()
    with pytest.raises(ValueError, match="rank"):
        counts.negative_binomial(table, "gene", "s", "v", design.withColumn("twin", F.col("arm") * 2), ["arm", "twin"], "arm")


@pytest.mark.parametrize("scale", [False, True])
def test_latent_axes(spark, monkeypatch, scale):
    from tessella.operators import axes

    monkeypatch.setattr(axes, "BLOCK", 100)
    rng = np.random.default_rng(80)
    m = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 9)) * 5 + rng.normal(size=(80, 9)) * np.arange(1, 10) / 5 + 3
    m[:, 4] = 2.0  # constant
    m[7] = 0  # a row that has one value only, and that is nothing
    df = long(spark, m, "id").unionByName(spark.createDataFrame([(7, "f000", 0.0)], "id long, f string, v double")).repartition(6)
    table, scores = axes.latent_axes(df, "id", "f", "v", 3, scale)
    x = m - m.mean(axis=0)
    if scale:
        x = np.divide(x, m.std(axis=0), out=np.zeros_like(x), where=m.std(axis=0) > 1e-9)
    values, vectors = np.linalg.eigh(x.T @ x / 80)
    got = {(r.axis, r.f): r for r in table.collect()}
    mine = {(r.id, r.axis): r.score for r in scores.collect()}
    assert len(mine) == 240
    for j in range(3):
        v = vectors[:, -1 - j]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert [got[j + 1, f"f{i:03d}"].weight for i in range(9)] == pytest.approx(v.tolist(), abs=1e-6)
        assert got[j + 1, "f000"].variance == pytest.approx(values[-1 - j])
        assert [mine[i, j + 1] for i in range(80)] == pytest.approx((x @ v).tolist(), abs=1e-5)


# ----------------------------------------------------------------- matching


@pytest.mark.parametrize(("rows", "cols", "blocks"), [(12, 12, 3), (7, 11, 2), (9, 9, 1)])
def test_auction(spark, rows, cols, blocks):
    from tessella.operators import matching

    rng = np.random.default_rng(rows)
    tables = {g: rng.integers(-20, 60, (rows, cols)) / 4 for g in ("a", None)}
    data = [(g, i, f"c{j:02d}", float(w[i, j])) for g, w in tables.items() for i in range(rows) for j in range(cols)]
    df = spark.createDataFrame([*data, ("a", None, "c00", 99.0), ("a", 0, "c01", None)], "g string, i int, c string, w double").repartition(5)
    got = matching.auction(df, "i", "c", "w", ["g"], unit=0.25, blocks=blocks).collect()
    for g, w in tables.items():
        own = [r for r in got if r.g == g]
        assert sorted(r.i for r in own) == list(range(rows)) and len({r.c for r in own}) == rows
        assert all(r.w == w[r.i, int(r.c[1:])] for r in own)
        assert sum(r.w for r in own) == pytest.approx(w[range(rows), solvers.best_assignment(w)].sum())


def test_auction_of_a_sparse_table_and_edges(spark):
    from tessella.operators import matching

    df = spark.createDataFrame([(0, 0, 5.0), (0, 1, 4.0), (1, 0, 5.0), (2, 2, 1.0), (2, 1, 9.0)], "i int, j int, w double")
    assert {(r.i, r.j) for r in matching.auction(df, "i", "j", "w").collect()} == {(0, 1), (1, 0), (2, 2)}
    assert matching.auction(df.limit(0), "i", "j", "w").count() == 0
    with pytest.raises(ValueError, match="more rows"):
        matching.auction(df.withColumn("j", F.lit(1)), "i", "j", "w")


def test_assignment_audits(spark):
    rng = np.random.default_rng(81)
    w = rng.integers(0, 30, (4, 4)).astype(float)
    df = spark.createDataFrame([("x", i, j, float(w[i, j])) for i in range(4) for j in range(4)], "g string, i int, j int, w double")
    totals = sorted((w[range(4), list(p)].sum() for p in permutations(range(4))), reverse=True)
    r = solvers.permutation_audit(df, "i", "j", "w", ["g"]).head()
    assert (r.best, r.second, r.assigned) == (totals[0], totals[1], totals[0])
    for r in solvers.fixed_pair_totals(df, "i", "j", "w", ["g"]).collect():
        want = max(w[range(4), list(p)].sum() for p in permutations(range(4)) if p[r.i] == r.j)
        assert (r.total, r.loss) == (want, totals[0] - want)


def test_most_correlated_holds_no_whole_product(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    tasks = []
    frame = type(spark.range(1))
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: tasks.append((df, f)) or whole(df, f, schema))
    monkeypatch.setattr(mixtures, "BLOCK", 64_000)
    rng = np.random.default_rng(91)
    base, queries = rng.integers(0, 9, (40, 4)).astype(float), rng.integers(0, 9, (300, 4)).astype(float)
    items = np.vstack([base, base, base])
    table = long(spark, items, "item").withColumn("item", F.concat(F.lit("i"), "item")).repartition(3)
    got = mixtures.most_correlated(long(spark, queries, "spot"), table, "spot", "item", "f", "v", 5).collect()
    assert len(got) == 300 * 5
    for q in (0, 17, 299):  # equal values of copies go by the item, also where it is a text
        r = {f"i{i}": round(float(np.corrcoef(queries[q], items[i])[0, 1]), 9) for i in range(120)}
        assert [x.item for x in sorted((x for x in got if x.spot == q), key=lambda x: x["rank"])] == sorted(r, key=lambda i: (-r[i], i))[:5]
    df, f = tasks[0]
    batch = pa.Table.from_batches([b for b in df.toArrow().to_batches()] * 160).combine_chunks().to_batches()[0]  # a product with the block's queries at once would take dozens of MB
    tracemalloc.start()
    list(f(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6, peak


def test_most_correlated_compares_equal_rows_once(spark, monkeypatch):
    tasks = []
    frame = type(spark.range(1))
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: tasks.append(df) or whole(df, f, schema))
    rng = np.random.default_rng(97)
    base, asked = rng.integers(0, 4, (40, 5)).astype(float), rng.integers(0, 9, (6, 5)).astype(float)
    items, queries = np.vstack([*[base] * 4, 2 * base, base[:1] * 0, *[base[:2]] * 30]), np.vstack([asked, asked, asked[:3]])  # copies, multiples that correlate alike, and a row of zeros
    table = long(spark, items, "item").repartition(5)
    for k, name in ((1, "label"), (10, "kind"), (30, "id")):  # names that the plan uses may be carried
        labelled = table.withColumn(name, F.concat(F.lit("l"), F.col("item") % 3))
        got = mixtures.most_correlated(long(spark, queries, "spot"), labelled, "spot", "item", "f", "v", k, [name]).collect()
        votes = {(r.spot, r[name]): (r.votes, r.share) for r in mixtures.neighbour_votes(long(spark, queries, "spot"), labelled, "spot", "item", "f", "v", name, k).collect()}
        want_votes = {}
        for q in range(len(queries)):
            r = {i: round(float(np.corrcoef(queries[q], items[i])[0, 1]), 9) for i in range(len(items)) if items[i].std() > 0}
            want = sorted(r, key=lambda i: (-r[i], i))[:k]
            own = sorted((x for x in got if x.spot == q), key=lambda x: x["rank"])
            assert [x.item for x in own] == want and [x.r for x in own] == [r[i] for i in want] and all(x[name] == f"l{x.item % 3}" for x in own)
            for i in want:
                at = (q, f"l{i % 3}")
                want_votes[at] = (want_votes.get(at, (0,))[0] + 1, 0)
        assert {at: (n, pytest.approx(n / k)) for at, (n, _) in want_votes.items()} == votes
    assert tasks and all(df.count() <= 2 * len(np.unique(base, axis=0)) for df in tasks)
