"""Latent axes of a matrix of any number of rows, and the rows' scores on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Numbers of the axes and as many more that are iterated with them; they are on the driver and in each task.
MOST_CELLS = 20_000_000
#: Directions that are iterated beside those asked for, so that the last of these settle as well.
SPARE = 4
#: Rows of a dense block in a task, in cells.
BLOCK = 1 << 22


def _dense(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, own in enumerate(rows):
        for x in own:
            out[k, x["i"]] += x["v"]
    return out


def _blocks(batch: pd.DataFrame, width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, BLOCK // max(1, width))
    for a in range(0, len(batch), step):
        some = batch.iloc[a : a + step]
        yield some, _dense(some["x"].tolist(), width)


def latent_axes(df: DataFrame, key: str, feature: str, value: str, k: int, scale: bool = False, rounds: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The ``k`` directions of largest variance of rows ``key`` over features: ``axis, variance, feature, weight`` and ``key, axis, score``.

    The matrix is in long form, missing values are zeros; features are centred and, with
    ``scale``, divided by their deviations (constant ones stay zero). A
    subspace is iterated: each round every task multiplies its rows with the
    current directions and their transposes with the result; the sums of these
    small products reach the driver, which makes them orthogonal again. So no
    product of features with each other is ever held. Rows' scores come from a last pass. An axis's largest weight,
    the first of equals, is positive. Axes of equal variance are any directions
    of their plane. An error is raised if the directions do not settle.
    """
    spark = df.sparkSession
    long = df.select(F.col(key).alias("key"), F.col(feature).alias("f"), F.col(value).cast("double").alias("v")).filter("f IS NOT NULL AND v IS NOT NULL")
    n = df.select(key).distinct().count()
    sums = long.groupBy("key", "f").agg(F.sum("v").alias("v"))
    bound = MOST_CELLS // (k + SPARE)
    per = sums.groupBy("f").agg((F.sum("v") / n).alias("mean"), (F.sum(F.col("v") * F.col("v")) / n).alias("square")).orderBy("f").limit(bound + 1).toPandas()
    if len(per) > bound:
        raise ValueError(f"more than {bound} features")
    width = len(per)
    mean, spread = per["mean"].to_numpy(float), np.sqrt(np.maximum(per["square"] - per["mean"] ** 2, 0).to_numpy(float))
    factor = np.where(spread > 1e-12, 1 / np.maximum(spread, 1e-300), 0.0) if scale else np.ones(width)
    place = spark.createDataFrame([(f, i) for i, f in enumerate(per["f"].tolist())], f"f {df.schema[feature].dataType.simpleString()}, i int")
    entries = F.collect_list(F.struct("i", "v")).alias("x")  # features of a row
    rows = staged(sums.join(F.broadcast(place), "f").groupBy("key").agg(entries))

    def products(q: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, seen = np.zeros((width + 1, q.shape[1])), False
            for batch in batches:
                for _, x in _blocks(batch, width):
                    y = (x * factor) @ q - (mean * factor) @ q
                    total[:width] += (x * factor).T @ y
                    total[width] += y.sum(axis=0)
                    seen = True
            if seen:
                yield pd.DataFrame({"i": range(width + 1), "t": total.tolist()})

        return run

    def applied(q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``."""
        each = F.array(*[F.sum(F.col("t")[j]) for j in range(q.shape[1])]).alias("t")
        found = rows.mapInPandas(products(q), "i int, t array<double>").groupBy("i").agg(each).orderBy("i").toPandas()  # a row for each feature
        t = np.stack(found["t"].to_numpy())
        # rows without any entry are zeros less the mean
        empty = n - held
        y0 = -(mean * factor) @ q
        return (t[:width] - np.outer(mean * factor, t[width] + empty * y0)) / n

    held = rows.count()
    m = min(width, k + SPARE)
    if not m or not held:
        raise ValueError("no values")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, m)))[0]
    before = None
    for _ in range(rounds):
        z = applied(q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        best = np.argsort(values)[::-1]
        found, variance = (q @ turn)[:, best][:, :k], values[best][:k]
        moved = np.inf if before is None else np.abs(np.abs((before * found).sum(axis=0)) - 1)[variance > 1e-9 * max(1e-300, variance[0])].max(initial=0)
        if moved < 1e-13:
            break
        before = found
        q = np.linalg.qr(z)[0]
    else:
        raise ValueError(f"no convergence in {rounds} rounds")
    axes = found * np.sign(found[np.abs(found).round(9).argmax(axis=0), range(found.shape[1])])
    names = per["f"].tolist()
    table = [(j + 1, float(max(0.0, variance[j])), f, float(axes[i, j])) for j in range(axes.shape[1]) for i, f in enumerate(names)]
    out = spark.createDataFrame(table, f"axis int, variance double, `{feature}` {df.schema[feature].dataType.simpleString()}, weight double")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some, x in _blocks(batch, width):
                yield pd.DataFrame({"key": some["key"], "s": ((x * factor - mean * factor) @ axes).tolist()})

    kind = df.schema[key].dataType.simpleString()
    scores = rows.mapInPandas(scored, f"key {kind}, s array<double>")
    none = [float(x) for x in -(mean * factor) @ axes]  # of rows without entries
    others = df.select(F.col(key).alias("key")).distinct().join(rows.select("key"), "key", "left_anti").withColumn("s", F.array(*map(F.lit, none)))
    each = scores.unionByName(others).select("key", F.posexplode("s").alias("axis", "score"))
    return out, each.select(F.col("key").alias(key), (F.col("axis") + 1).alias("axis"), "score")
