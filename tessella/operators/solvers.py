"""Solvers that no built-in expresses, in numpy.

Each runs on a matrix that its caller has reduced: sums that a model needs are
gathered by Spark, in parts that add up, and only these reach a solver. Where a
problem comes in many groups, each group is solved in its own task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import erfc, exp, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- assignment


def best_assignment(weights: np.ndarray) -> np.ndarray:
    """For each row the column of the assignment with the largest total weight (rows <= columns).

    Shortest augmenting paths with dual prices: rows enter one at a time, and
    the path to the nearest free column shifts those before.
    """
    n, m = weights.shape
    cost = weights.max(initial=0) - weights
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        distance, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, reached, last = start, 0.0, -1
        visited = [start]
        while True:
            slack = reached + cost[row] - row_price[row] - col_price
            better = ~done & (slack < distance)
            distance[better], via[better] = slack[better], last
            last = int(np.where(done, np.inf, distance).argmin())
            reached = distance[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = int(owner[last])
            visited.append(row)
        row_price[start] += reached
        for c in np.flatnonzero(done):
            if c != last and owner[c] >= 0:
                row_price[owner[c]] += reached - distance[c]
        inner = done.copy()
        inner[last] = False
        col_price[inner] -= reached - distance[inner]
        while last >= 0:
            before = int(via[last])
            owner[last] = start if before < 0 else owner[before]
            last = before
    out = np.full(n, -1)
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def assignment(weights: DataFrame, row: str, col: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """One-to-one matches with the largest total weight; each group is one task."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index=row, columns=col, values=weight, fill_value=0.0).sort_index().sort_index(axis=1)
        w = table.to_numpy(float)
        best = best_assignment(w) if w.shape[0] <= w.shape[1] else None
        pairs = list(enumerate(best)) if best is not None else [(r, c) for c, r in enumerate(best_assignment(w.T))]
        out = pd.DataFrame({row: [table.index[r] for r, _ in pairs], col: [table.columns[c] for _, c in pairs], weight: [w[r, c] for r, c in pairs]})
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, row, col, weight]]

    kept = weights.select(*by, row, col, F.col(weight).cast("double").alias(weight))
    return kept.groupBy(*by).applyInPandas(solve, kept.schema)


def _table(rows: pd.DataFrame, row: str, col: str, weight: str) -> pd.DataFrame:
    return rows.pivot_table(index=row, columns=col, values=weight, fill_value=0.0).sort_index().sort_index(axis=1)


def permutation_audit(weights: DataFrame, row: str, col: str, weight: str, by: Sequence[str]) -> DataFrame:
    """The assignment of each group against all others: ``by, best, second, assigned``, of square tables of nine rows at most.

    All totals are tried; ``assigned`` is what :func:`best_assignment` reaches.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        w = _table(rows, row, col, weight).to_numpy(float)
        n = len(w)
        if n > 9 or w.shape[1] != n:
            raise ValueError("a square table of at most 9 rows is needed")
        totals = np.sort(w[np.arange(n), np.array(list(permutations(range(n))))].sum(axis=1))[::-1]
        out = pd.DataFrame({"best": [totals[0]], "second": [totals[min(1, len(totals) - 1)]], "assigned": [w[range(n), best_assignment(w)].sum()]})
        return out.assign(**{k: rows[k].iloc[0] for k in by})[[*by, "best", "second", "assigned"]]

    kept = weights.select(*by, row, col, F.col(weight).cast("double").alias(weight))
    kinds = ", ".join(f"`{c}` {weights.schema[c].dataType.simpleString()}" for c in by)
    return kept.groupBy(*by).applyInPandas(solve, f"{kinds}, best double, second double, assigned double")


def fixed_pair_totals(weights: DataFrame, row: str, col: str, weight: str, by: Sequence[str]) -> DataFrame:
    """The largest total of each group with each pair held fixed in turn, and what that costs: ``by, row, col, total, loss``.

    The loss is 0 for pairs of a best assignment. Tables have no more rows than columns.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        table = _table(rows, row, col, weight)
        w = table.to_numpy(float)
        n, m = w.shape
        totals = np.empty((n, m))
        for r in range(n):
            for c in range(m):
                rest = np.delete(np.delete(w, r, 0), c, 1)
                totals[r, c] = w[r, c] + (rest[range(n - 1), best_assignment(rest)].sum() if n > 1 else 0.0)
        out = pd.DataFrame({row: np.repeat(table.index, m), col: np.tile(table.columns, n), "total": totals.ravel(), "loss": (totals.max() - totals).ravel()})
        return out.assign(**{k: rows[k].iloc[0] for k in by})[[*by, row, col, "total", "loss"]]

    kept = weights.select(*by, row, col, F.col(weight).cast("double").alias(weight))
    kinds = ", ".join(f"`{c}` {weights.schema[c].dataType.simpleString()}" for c in (*by, row, col))
    return kept.groupBy(*by).applyInPandas(solve, f"{kinds}, total double, loss double")


# ------------------------------------------------------------------ mixtures

#: Cells of a table of profiles that is sent to the tasks.
MOST_CELLS = 20_000_000


def nonnegative_fit(a: np.ndarray, b: np.ndarray, gram: np.ndarray | None = None) -> np.ndarray:
    """Least squares of ``a x = b`` with no x below 0, by an active set; ``gram`` is ``a.T @ a`` where many fits share it."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, rhs = a.T @ a if gram is None else gram, a.T @ b
    for _ in range(10 * n + 10):
        slope = rhs - gram @ x
        slope[free] = -np.inf
        if free.all() or slope.max() <= 1e-10 * max(1.0, np.abs(rhs).max()):
            return x
        free[slope.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            trial = np.zeros(n)
            trial[at] = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            if (trial[at] > 0).all():
                x = trial
                break
            low = at[trial[at] <= 0]
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    raise ValueError("the active set does not settle")


#: Rounds of expectation and maximisation after which steps are extrapolated.
_SLOW = 2000


def multinomial_mixture(profiles: np.ndarray, counts: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Weights of profiles (columns that sum to 1) that make counts likeliest, by expectation and maximisation.

    ``counts`` is a vector, or a matrix with a row for each of many spots, which
    are fitted together. Spots without counts get even weights. A weight that
    goes to zero may do so as slowly as one over the round, so after ``_SLOW``
    rounds steps are extrapolated (squared), where that is likelier.
    """
    many = np.atleast_2d(counts).astype(float)
    w = np.full((len(many), profiles.shape[1]), 1 / profiles.shape[1])
    left = np.flatnonzero(many.sum(axis=1) > 0)

    def scaled(new: np.ndarray, old: np.ndarray) -> np.ndarray:
        total = new.sum(axis=1, keepdims=True)
        return np.where(total > 0, new / np.where(total > 0, total, 1), old)

    def step(old: np.ndarray, n: np.ndarray) -> np.ndarray:
        mix = old @ profiles.T
        return scaled(old * (np.divide(n, mix, out=np.zeros_like(mix), where=mix > 0) @ profiles), old)

    def likelihood(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        mix = at @ profiles.T
        return (n * np.log(mix, out=np.zeros_like(mix), where=mix > 0)).sum(axis=1)

    for k in range(rounds):
        if not len(left):
            return w if np.ndim(counts) == 2 else w[0]
        old, n = w[left], many[left]
        new = step(old, n)
        moved = np.abs(new - old).max(axis=1)
        if k >= _SLOW:
            last = step(new, n)
            r, v = new - old, last - 2 * new + old
            bend = np.sqrt((v * v).sum(axis=1, keepdims=True))
            far = np.sqrt((r * r).sum(axis=1, keepdims=True)) / np.where(bend > 0, bend, np.inf)
            tried = old + 2 * far * r + far * far * v
            tried = scaled(np.where(tried > 0, tried, last), last)  # no weight is lost
            better = (moved >= 1e-10) & (likelihood(tried, n) >= likelihood(last, n))
            new = np.where(better[:, None], tried, np.where((moved >= 1e-10)[:, None], last, new))
        w[left] = new
        left = left[moved >= 1e-10]
    raise ValueError(f"no convergence in {rounds} rounds")


def unmix(spots: DataFrame, profiles: DataFrame, spot: str, feature: str, value: str, kind: str, method: str = "nnls") -> DataFrame:
    """Weights of each kind in each spot: ``spot, kind, weight``, summing to 1.

    ``profiles`` is a table of kinds by features of at most ``MOST_CELLS`` cells;
    it goes to the tasks as one matrix, and the spots of a batch are solved together.
    """
    n_features, n_kinds = profiles.agg(F.countDistinct(feature), F.countDistinct(kind)).head()
    if n_features * n_kinds > MOST_CELLS:
        raise ValueError(f"profiles have {n_features} x {n_kinds} cells; the bound is {MOST_CELLS}")
    table = profiles.groupBy(feature).pivot(kind).agg(F.first(value)).na.fill(0.0).toPandas().set_index(feature).sort_index()
    matrix, kinds, place = table.to_numpy(float), list(table.columns), {f: i for i, f in enumerate(table.index)}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, shares = matrix.T @ matrix, matrix / matrix.sum(axis=0)
        for rows in batches:
            b = np.zeros((len(rows), len(matrix)))
            for i, own in enumerate(rows["own"]):
                for x in own:
                    if x["f"] in place:
                        b[i, place[x["f"]]] += x["v"]
            w = np.stack([nonnegative_fit(matrix, x, gram) for x in b]) if method == "nnls" and len(b) else multinomial_mixture(shares, b)
            total = w.sum(axis=1, keepdims=True)
            w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
            yield pd.DataFrame({spot: np.repeat(rows[spot].to_numpy(), len(kinds)), kind: kinds * len(rows), "weight": w.ravel()})

    kind_of = lambda c: spots.schema[c].dataType.simpleString()
    entries = F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v"))).alias("own")  # features of a spot
    return spots.groupBy(spot).agg(entries).mapInPandas(solve, f"{spot} {kind_of(spot)}, {kind} string, weight double")


# ---------------------------------------------------------------- regression


def logistic(df: DataFrame, y: str, x: Sequence[str], rounds: int = 25) -> DataFrame:
    """Estimates, standard errors, Wald tests and odds ratios of a logistic regression.

    Each round Spark adds up the gradient and the information matrix over all
    rows, a few numbers for each partition; the driver solves for the step.
    """
    k = len(x) + 1
    rows = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in x]).na.drop()
    beta = np.zeros(k)

    def parts(beta: np.ndarray) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h = np.zeros(k), np.zeros((k, k))
            for b in batches:
                m = np.column_stack([np.ones(len(b)), b[list(x)].to_numpy(float)])
                p = 1 / (1 + np.exp(-np.clip(m @ beta, -500, 500)))
                g += m.T @ (b["_y"].to_numpy() - p)
                h += m.T @ (m * (p * (1 - p))[:, None])
            yield pd.DataFrame({"i": range(k + k * k), "v": np.concatenate([g, h.ravel()])})

        return run

    rows = rows.persist()  # every round reads them
    try:
        beta, h = _newton(rows, parts, beta, k, rounds)
    finally:
        rows.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    out = [("(intercept)" if i == 0 else x[i - 1], float(b), float(s), float(b / s), erfc(abs(b / s) / sqrt(2)), float(np.exp(b))) for i, (b, s) in enumerate(zip(beta, se, strict=True))]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, z double, p_value double, odds_ratio double")


def _newton(rows: DataFrame, parts: Callable, beta: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and information matrix where the steps have ended; an error if they do not."""
    for _ in range(rounds):
        sums = rows.mapInPandas(parts(beta), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        if not len(sums):
            raise ValueError("no complete rows")
        g, h = sums[:k], sums[k:].reshape(k, k)
        if np.linalg.matrix_rank(h) < k:
            raise ValueError("the design is not of full rank")
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-10 * max(1.0, np.abs(beta).max()):
            return beta, h
    raise ValueError(f"no convergence in {rounds} rounds")


def design_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank of each group's design of ``columns`` and an intercept: ``by, rank, n``.

    Spark adds up the products of each two columns, less their means so that
    a large offset hides nothing; numpy has the ranks of many groups at once. Rows with a
    missing value do not count; a group without others has rank 0.
    """
    values = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    whole = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns[1:]), F.when(F.col(columns[0]).isNull(), 1).otherwise(0)) == 0
    rows = df.select(*by, whole.alias("_w"), *values)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    own = lambda c: F.when(F.col("_w"), c)
    sums = rows.groupBy(*by).agg(F.count_if("_w").alias("n"), F.array(*[F.coalesce(F.covar_pop(own(F.col(f"_x{i}")), own(F.col(f"_x{j}"))), F.lit(0.0)) for i, j in pairs]).alias("_c"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = np.zeros((len(b), len(columns), len(columns)))
            for k, (i, j) in enumerate(pairs):
                c[:, i, j] = c[:, j, i] = [x[k] for x in b["_c"]]
            scale = 1 / np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2), 1e-12))
            found = np.linalg.matrix_rank(c * scale[:, :, None] * scale[:, None, :], tol=1e-9) if len(b) else np.empty(0)
            yield b[[*by]].assign(**{name: np.where(b["n"] > 0, 1 + found, 0).astype("int32"), "n": b["n"]})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(rank, f"{kinds + ', ' if by else ''}`{name}` int, n long")


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sums of products of columns, added up over partitions."""
    cols = list(columns)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((len(cols), len(cols)))
        for b in batches:
            m = b.to_numpy(float)
            g += m.T @ m
        yield pd.DataFrame({"i": range(g.size), "v": g.ravel()})

    sums = df.select(*cols).mapInPandas(parts, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    return sums.reshape(len(cols), len(cols))


def principal_axes(g: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading directions of a Gram matrix; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh(g)
    axes = vectors[:, np.argsort(values)[::-1][:k]]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])


def adjusted_effect(rows: pd.DataFrame, y: str, group: str, covariate: str) -> float:
    """Effect of a 0/1 group on ``y``, beside one level of the covariate for each of its values."""
    levels = pd.get_dummies(rows[covariate]).to_numpy(float)
    design = np.column_stack([rows[group].to_numpy(float), levels])
    return float(np.linalg.lstsq(design, rows[y].to_numpy(float), rcond=None)[0][0])


# --------------------------------------------------------------------- tails


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric_tail(k: int, drawn: int, marked: int, total: int) -> float:
    """Probability of at least ``k`` marked among those drawn."""
    low, high = max(k, drawn + marked - total, 0), min(drawn, marked)
    base = _log_choose(total, drawn)
    return min(1.0, sum(exp(_log_choose(marked, i) + _log_choose(total - marked, drawn - i) - base) for i in range(low, high + 1)))


def binomial_tail(k: int, n: int, p: float, side: str = "greater") -> float:
    """Probability of at least, at most, or (two-sided) no likelier than ``k`` successes."""
    if p <= 0 or p >= 1:
        mass = [float(i == (0 if p <= 0 else n)) for i in range(n + 1)]
    else:
        mass = [exp(_log_choose(n, i) + i * log(p) + (n - i) * log(1 - p)) for i in range(n + 1)]
    picked = {"greater": mass[k:], "less": mass[: k + 1], "two": [m for m in mass if m <= mass[k] * (1 + 1e-7)]}[side]
    return min(1.0, sum(picked))


def hypergeometric(df: DataFrame, k: str, drawn: str, marked: str, total: str) -> DataFrame:
    """Add ``p``, the upper tail, to each row."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_tail(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)

    return df.withColumn("p", tail(k, drawn, marked, total))


def binomial(df: DataFrame, k: str, n: str, p: float, side: str = "greater", name: str = "p") -> DataFrame:
    """Add the tail of a binomial with success probability ``p`` to each row; equal pairs are computed once in a batch."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], float] = {}
        for x in zip(a, b, strict=True):
            if x not in known:
                known[x] = binomial_tail(int(x[0]), int(x[1]), p, side)
        return pd.Series([known[x] for x in zip(a, b, strict=True)], dtype=float)

    return df.withColumn(name, tail(k, n))


def t_quantile_normal_start(p: float) -> float:
    """A normal quantile by bisection."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * erfc(-middle / sqrt(2)) < p else (low, middle)
    return (low + high) / 2


def noncentral_t_cdf(t: float, df: float, shift: float, points: int = 4000) -> float:
    """P(T <= t), by integrating the normal over the chi distribution of the denominator."""
    spread = 12 / sqrt(2 * df)
    s = np.linspace(max(1e-9, 1 - spread), 1 + spread, points)  # chi / sqrt(df)
    log_density = log(2) + (df / 2) * log(df / 2) - lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    normal = np.array([0.5 * erfc(-(t * x - shift) / sqrt(2)) for x in s])
    y = normal * np.exp(log_density)
    return float(np.clip(((y[1:] + y[:-1]) / 2 * np.diff(s)).sum(), 0, 1))


def t_critical(alpha: float, df: float) -> float:
    """Two-sided critical value of Student's t."""
    low, high = 0.0, 1e3
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if noncentral_t_cdf(middle, df, 0.0) < 1 - alpha / 2 else (low, middle)
    return (low + high) / 2


def two_sample_power(d: float, n: int, alpha: float = 0.05) -> float:
    """Power of a two-sided t test with ``n`` in each group."""
    df, shift = 2 * n - 2, d * sqrt(n / 2)
    c = t_critical(alpha, df)
    return 1 - noncentral_t_cdf(c, df, shift) + noncentral_t_cdf(-c, df, shift)


def minimum_n(d: float, power: float = 0.8, alpha: float = 0.05) -> int:
    """The smallest group size that reaches a power, searched around the normal approximation."""
    z = t_quantile_normal_start(1 - alpha / 2) + t_quantile_normal_start(power)
    n = max(2, int(2 * (z / abs(d)) ** 2) - 2)
    while n > 2 and two_sample_power(d, n - 1, alpha) >= power:
        n -= 1
    while two_sample_power(d, n, alpha) < power:
        n += 1
    return n


def students_t_p(r: float, n: int) -> float:
    """Two-sided p of a correlation, by integrating Student's density."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    df = n - 2
    t = abs(r) * sqrt(df / (1 - r * r))
    x = np.tan(np.linspace(np.arctan(t), pi / 2 - 1e-9, 20_001))
    density = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    return float(min(1.0, 2 * ((density[1:] + density[:-1]) / 2 * np.diff(x)).sum()))
