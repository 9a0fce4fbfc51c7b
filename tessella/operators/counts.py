"""Negative binomial regression of counts, many genes at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered, stats

#: Samples whose design goes to the tasks; a gene is a row of as many numbers.
MOST_SAMPLES = 20_000
#: The least dispersion, and the share that is cut off at both ends of a trimmed mean.
LEAST, TRIM = 1e-8, 0.2
#: The least robust dispersion, and the deviation of a normal variable in median distances.
ROBUST_LEAST, MAD = 0.04, 1.4826


def f_quantile(q: float, d1: float, d2: float) -> float:
    """A quantile of the F distribution: the beta density, over a quarter turn where it is smooth, is summed and cut at ``q``."""
    turn = np.linspace(0, np.pi / 2, 200_001)
    log = (d1 - 1) * np.log(np.maximum(np.sin(turn), 1e-300)) + (d2 - 1) * np.log(np.maximum(np.cos(turn), 1e-300))
    density = np.exp(log - log.max())
    area = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    at = np.interp(q, area / area[-1], turn)
    return float(d2 / d1 * np.tan(at) ** 2)


def fit(k: np.ndarray, f: np.ndarray, x: np.ndarray, alpha: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their covariances and the means of log-linear models of all genes, by Newton's steps.

    ``k`` is genes by samples, ``f`` the size factors, ``x`` the design,
    ``alpha`` a dispersion for each gene. What does not converge is nan.
    """
    n, p = x.shape
    beta = np.log(np.maximum(k / f, 0.1)) @ np.linalg.pinv(x).T
    left = np.arange(len(k))
    for _ in range(rounds):
        if not len(left):
            break
        mu, a = f * np.exp(np.clip(beta[left] @ x.T, -30, 30)), alpha[left, None]
        # the curvature at these counts, which is never negative, rather than the expected one: steps then shrink fast also far out
        info = np.einsum("gn,np,nq->gpq", mu * (1 + a * k[left]) / (1 + a * mu) ** 2, x, x)
        step = np.linalg.solve(info + 1e-12 * np.eye(p), np.einsum("gn,np->gp", (k[left] - mu) / (1 + a * mu), x)[:, :, None])[:, :, 0]
        beta[left] += np.clip(step, -2, 2)
        left = left[np.abs(step).max(axis=1) >= 1e-10]
    beta[left] = np.nan
    mu = f * np.exp(np.clip(beta @ x.T, -30, 30))
    w = np.nan_to_num(mu / (1 + alpha[:, None] * mu), nan=1.0)
    covariance = np.linalg.pinv(np.einsum("gn,np,nq->gpq", w, x, x), hermitian=True)
    return beta, covariance, mu


def dispersions(k: np.ndarray, f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dispersions of moments around the least-squares means of scaled counts.

    Means are a tenth of the gene's at least, as a line may fall below zero, and
    dispersions are bounded by the larger of ten and the number of samples.
    """
    q = k / f
    mu = np.maximum(q @ np.linalg.pinv(x).T @ x.T, np.maximum(q.mean(axis=1, keepdims=True) / 10, 1e-9))
    return np.clip((((q - mu) ** 2 - mu / f) / mu**2).sum(axis=1) / max(1, len(f) - x.shape[1]), LEAST, max(10, len(f)))


def robust_dispersions(k: np.ndarray, f: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Dispersions that a count far out does not move: from the median distance of scaled counts to the medians of samples of equal design."""
    q = k / f
    middle = np.stack([np.median(q[:, cell == c], axis=1) for c in range(cell.max() + 1)], axis=1)[:, cell]
    spread = (MAD * np.median(np.abs(q - middle), axis=1)) ** 2
    m = np.maximum(middle.mean(axis=1), 1e-9)
    return np.clip((spread - m * (1 / f).mean()) / m**2, ROBUST_LEAST, max(10, len(f)))


def cooks(k: np.ndarray, mu: np.ndarray, x: np.ndarray, alpha: np.ndarray, covariance: np.ndarray, robust: np.ndarray) -> np.ndarray:
    """Cook's distance of each gene's samples, whose residuals are measured by ``robust`` dispersions."""
    h = np.clip(mu / (1 + alpha[:, None] * mu) * np.einsum("np,gpq,nq->gn", x, covariance, x), 0, 1 - 1e-9)
    return (k - mu) ** 2 / (mu + robust[:, None] * mu**2) / x.shape[1] * h / (1 - h) ** 2


def negative_binomial(counts: DataFrame, gene: str, sample: str, value: str, design: DataFrame, columns: Sequence[str], test: str, cutoff: float | None = None, replicates: int = 3) -> DataFrame:
    """Log-linear models of counts with an intercept and ``columns``: ``gene, base_mean, dispersion, log2_fold_change, std_error, wald, p, adjusted, most_cook, replaced``.

    Counts are scaled by median-of-ratios size factors. Each gene has the
    dispersion of moments around its least-squares means. A count whose Cook's
    distance is above ``cutoff`` (by default the 0.99 quantile of F) and whose
    design has ``replicates`` samples at least is replaced by the gene's trimmed mean in its
    sample's scale, and the gene is fitted anew. The test is Wald's of ``test``; p-values are adjusted over
    all genes, by a scan in parts. Missing counts are zeros; a fit that does not converge, as where
    a group has no counts, has nulls. Genes are fitted in batches, the design goes to the tasks.
    """
    rows = counts.select(F.col(gene).alias("gene"), F.col(sample).alias("sample"), F.col(value).cast("double").alias("v")).groupBy("gene", "sample").agg(F.sum("v").alias("v"))
    factors = stats.size_factors(rows, "gene", "sample", "v")
    known = design.select(F.col(sample).alias("sample"), *[F.col(c).cast("double").alias(c) for c in columns]).join(factors, "sample").orderBy("sample").limit(MOST_SAMPLES + 1).toPandas()
    if len(known) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    x = np.column_stack([np.ones(len(known)), known[list(columns)].to_numpy(float)])
    if len(known) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the design is not of full rank, or leaves nothing")
    f, names, tested = known["size_factor"].to_numpy(float), known["sample"].tolist(), 1 + list(columns).index(test)
    limit = f_quantile(0.99, x.shape[1], len(f) - x.shape[1]) if cutoff is None else cutoff
    _, cell, size = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    cell = cell.ravel()
    replaceable = size[cell] >= replicates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = np.stack(b["k"].to_numpy()).astype(float) if len(b) else np.empty((0, len(f)))
            alpha = dispersions(k, f, x)
            beta, covariance, mu = fit(k, f, x, alpha)
            d = np.nan_to_num(cooks(k, mu, x, alpha, covariance, robust_dispersions(k, f, cell)))
            out = (d > limit) & replaceable
            cut = int(TRIM * len(f))
            trimmed = np.sort(k / f, axis=1)[:, cut : len(f) - cut].mean(axis=1)
            again = np.flatnonzero(out.any(axis=1))
            if len(again):
                new = np.where(out[again], trimmed[again, None] * f, k[again])
                alpha[again] = dispersions(new, f, x)
                beta[again], covariance[again], _ = fit(new, f, x, alpha[again])
            se = np.sqrt(covariance[:, tested, tested])
            z = beta[:, tested] / se
            none = lambda v: [None if np.isnan(e) else float(e) for e in v]
            yield pd.DataFrame(
                {
                    "gene": b["gene"], "base_mean": (k / f).mean(axis=1), "dispersion": alpha, "log2_fold_change": none(beta[:, tested] / np.log(2)), "std_error": none(np.where(np.isnan(z), np.nan, se / np.log(2))),
                    "wald": none(z), "p": none([erfc(abs(e) / sqrt(2)) if not np.isnan(e) else np.nan for e in z]), "most_cook": d.max(axis=1, initial=0), "replaced": out.sum(axis=1).astype("int32"),
                }
            )

    entries = F.map_from_entries(F.collect_list(F.struct("sample", "v")))  # an entry for each sample
    order = F.array(*[F.lit(s) for s in names])
    genes = rows.filter(F.col("v").isNotNull()).groupBy("gene").agg(entries.alias("m")).select("gene", F.transform(order, lambda s: F.coalesce(F.element_at("m", s), F.lit(0.0))).alias("k"))
    kind = counts.schema[gene].dataType.simpleString()
    found = ordered.staged(genes.mapInPandas(run, f"gene {kind}, base_mean double, dispersion double, log2_fold_change double, std_error double, wald double, p double, most_cook double, replaced int"))
    adjusted = ordered.benjamini_hochberg(found.filter("p IS NOT NULL"), "p", [], ["gene"])
    rest = found.filter("p IS NULL").withColumn("adjusted", F.lit(None).cast("double"))
    return adjusted.unionByName(rest).withColumnRenamed("gene", gene)
