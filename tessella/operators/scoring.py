"""Scores, gates and credits of submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a submission that failed its gate shows at most.
CAP = 49


def gated(df: DataFrame, parts: Sequence[str], codes: str, base: int = 0, cap: int = CAP) -> DataFrame:
    """Add ``total``, ``hardgate_pass`` (no failure codes) and ``shown``, capped where the gate failed."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(base)).cast("long")
    passed = F.size(codes) == 0
    return df.withColumns({"total": total, "hardgate_pass": passed}).withColumn("shown", F.when(F.col("hardgate_pass"), F.col("total")).otherwise(F.least(F.lit(cap).cast("long"), "total")))


def in_bounds(parts: dict[str, tuple[float, float]]) -> Column:
    """Whether all scores lie in their bounds; a missing one does not."""
    ok = F.lit(True)
    for name, (low, high) in parts.items():
        ok = ok & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return ok


def status(accepted: Column, score: Column) -> Column:
    """``blocked`` until controls are accepted, then ``scored``; without a score ``missing``."""
    return F.when(~F.coalesce(accepted, F.lit(False)), "blocked").when(score.isNull(), "missing").otherwise("scored")


def linear_credit(got: Column, want: Column, scale: float) -> Column:
    """Full credit for no error, none from ``scale`` on."""
    return F.greatest(F.lit(0.0), 1 - F.abs(got - want) / scale)


def prorated(k: Column, n: Column, points: int) -> Column:
    """Points for ``k`` of ``n``; halves go to the even number."""
    return F.bround(F.lit(float(points)) * k / n, 0).cast("long")


def mean_of_runs(runs: Sequence[DataFrame], keys: Sequence[str], score: str) -> DataFrame:
    """Keys that all runs have, with the mean of their scores."""
    out = runs[0].select(*keys, F.col(score).alias("_0"))
    for i, run in enumerate(runs[1:], 1):
        out = out.join(run.select(*keys, F.col(score).alias(f"_{i}")), list(keys))
    return out.select(*keys, (sum((F.col(f"_{i}") for i in range(1, len(runs))), F.col("_0")) / len(runs)).alias("mean_score"))


def present(manifest: DataFrame, files: DataFrame, name: str = "name", points: int = 10) -> DataFrame:
    """Points for a task all of whose listed files are there and not empty, else none: ``task, missing, points``."""
    found = files.filter("length > 0").select(name).distinct().withColumn("_there", F.lit(True))
    each = manifest.join(found, name, "left").groupBy("task").agg(F.array_sort(F.collect_set(F.when(F.col("_there").isNull(), F.col(name)))).alias("missing"))
    return each.withColumn("points", F.when(F.size("missing") == 0, points).otherwise(0))


def exact_sequence(df: DataFrame, by: str, order: str, step: str, want: Sequence[str]) -> DataFrame:
    """Whether each group's steps, in order, are exactly those wanted."""
    got = F.transform(F.array_sort(F.collect_list(F.struct(order, step))), lambda x: x[step])
    return df.groupBy(by).agg(got.alias("steps")).withColumn("ok", F.col("steps") == F.array(*map(F.lit, want)))


def paired(df: DataFrame, by: str, order: str, step: str, opens: str, closes: str) -> DataFrame:
    """Whether opening and closing steps alternate in each group and all are closed."""
    kinds = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, step))), lambda x: x[step]), lambda s: s.isin(opens, closes))
    state = lambda k: F.aggregate(k, F.lit(0), lambda a, s: F.when((a == 0) & (s == opens), 1).when((a == 1) & (s == closes), 0).otherwise(-1))
    return df.groupBy(by).agg(kinds.alias("_k")).select(by, (state(F.col("_k")) == 0).alias("ok"))


def long_form(df: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """A row for each score, in the order of ``parts``: ``key, i, part, score``."""
    each = F.posexplode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("score")) for p in parts])).alias("i", "x")
    return df.select(key, each).select(key, "i", "x.part", "x.score")


def merge_back(table: DataFrame, scores: DataFrame, key: str, cells: Sequence[str], score: str) -> DataFrame:
    """Add to each row the score whose ``key`` is in the first of ``cells`` that matches any; null if none does."""
    out = table
    for i, cell in enumerate(cells):
        own = scores.select(F.col(key).alias(f"_k{i}"), F.col(score).alias(f"_s{i}")).dropDuplicates([f"_k{i}"])
        out = out.join(own, F.col(cell) == F.col(f"_k{i}"), "left")
    matched = F.coalesce(*[F.when(F.col(f"_k{i}").isNotNull(), F.struct(F.lit(c).alias("cell"), F.col(f"_s{i}").alias("s"))) for i, c in enumerate(cells)])
    return out.withColumns({"matched_cell": matched["cell"], score: matched["s"]}).select(*table.columns, "matched_cell", score)
