"""Scans with carry over all rows and over groups of any size, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(31)
    group = [None, "a", "b", "c"]
    data = [(i, group[int(rng.choice(4, p=[0.1, 0.7, 0.15, 0.05]))], float(rng.integers(0, 50)) if rng.random() < 0.9 else None, int(rng.integers(-9, 9))) for i in range(3000)]
    return data, spark.createDataFrame(data, "id long, g string, v double, w long").repartition(7)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_scan(spark, rows, by):
    data, df = rows
    R = ordered.Running
    got = {r.id: r for r in ordered.scan(df, [F.desc("w"), F.asc("id")], {"s": R("sum", "v", before=True), "n": R("count"), "low": R("min", "v", down=True), "high": R("max", F.col("v") + 1), "near": R("last", "v", before=True, down=True), "k": R("count", "v", before=True)}, by).collect()}
    assert len(got) == len(data)
    for g in {x[1] for x in data} if by else {0}:
        own = sorted((x for x in data if not by or x[1] == g), key=lambda x: (-x[3], x[0]))
        for i, (at, _, v, _) in enumerate(own):
            r, before, after = got[at], [x[2] for x in own[:i] if x[2] is not None], [x[2] for x in own[i:] if x[2] is not None]
            assert r.n == i + 1 and r.k == len(before) and r.s == (sum(before) if before else None)
            assert r.low == min(after, default=None) and r.high == max([x + 1 for x in before + ([v] if v is not None else [])], default=None)
            assert r.near == next((x[2] for x in own[i + 1 :] if x[2] is not None), None)
    empty = ordered.scan(df.limit(0), [F.asc("id")], {"n": R("count")}, by)
    assert empty.count() == 0 and empty.columns == [*df.columns, "n"]


def test_no_single_partition_of_rows(spark, rows):
    _, df = rows
    for out in (ordered.ranked(df, [F.asc("id")]), ordered.islands(df, [], "id"), ordered.benjamini_hochberg(df.fillna(0.5).withColumn("v", F.col("v") / 50), "v", [], ["id"]), ordered.offsets(df, [], [F.asc("id")], "w"), ordered.mean_rank(df, [F.asc("id")], [F.desc("id")], [])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, plan
    assert {r.mean_rank for r in ordered.mean_rank(df, [F.asc("id")], [F.desc("id")], []).collect()} == {(len(rows[0]) + 1) / 2}


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_greedy_clusters(spark, by, kind):
    rng = np.random.default_rng(32)
    data = [(i, [None, "a", "b"][i % 3], None if i % 50 == 7 else float(rng.integers(0, 4000))) for i in range(900)] + [(1000, "alone", 5.0), (1001, "none", None)]
    df = spark.createDataFrame(data, "id long, g string, at double").withColumn("at", F.col("at").cast(kind))
    got = {r.id: r.cluster for r in ordered.greedy_clusters(df, by, "at", 25).collect()}
    want = {}
    for g in {x[1] for x in data} if by else {0}:
        first, number = None, 0
        for i, _, x in sorted((x for x in data if x[2] is not None and (not by or x[1] == g)), key=lambda x: x[2]):
            if first is None or x - first > 25:
                first, number = x, number + 1
            want[i] = number
    assert got == {x[0]: want.get(x[0]) for x in data}
    assert ordered.greedy_clusters(df.limit(0), by, "at", 25).count() == 0


def test_merged_takes_more_tasks_for_more_rows(spark, monkeypatch):
    from tessella import session

    df = spark.range(2000).select((F.col("id") % 500).alias("g"), F.col("id").alias("start"), (F.col("id") + 7).alias("end"))
    monkeypatch.setattr(session, "_TASK_ROWS", 50)
    out = ordered.merged(df, ["g"])
    assert out.rdd.getNumPartitions() == 40 and out.count() == 2000 and out.agg(F.sum("members")).head()[0] == 2000


def test_nearest_value_from_other_ranges(spark, monkeypatch):
    """The nearest value may lie in the range before, or in the one after, at its near end."""
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") % 3 == 1, F.col("id")).alias("v"))
    monkeypatch.setattr(ordered, "staged", lambda x, staged=ordered.staged: staged(x.repartitionByRange(8, "id").sortWithinPartitions("id").withColumn("_scan_at", F.monotonically_increasing_id()) if "_scan_at" in x.columns else x))
    R = ordered.Running
    out = ordered.scan(df, [F.asc("id")], {"above": R("last", "v", before=True, down=True), "below": R("last", "v", before=True)})
    for r in out.collect():
        assert r.above == next((i for i in range(r.id + 1, 400) if i % 3 == 1), None) and r.below == next((i for i in range(r.id - 1, -1, -1) if i % 3 == 1), None)


def test_scan_takes_more_ranges_for_more_rows(spark, rows, monkeypatch):
    from tessella import session

    monkeypatch.setattr(session, "_TASK_ROWS", 100)
    placed = ordered.placed(rows[1], [F.asc("id")])
    assert placed.select("_scan_part").distinct().count() > 20
    assert sorted((r.id, r.n) for r in ordered.ranked(rows[1], [F.asc("id")], name="n").collect()) == [(i, i + 1) for i in range(3000)]
