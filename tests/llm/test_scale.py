"""Operators on tables that are read back in splits, and stages on tables with clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_llm import SCHEMA, docs_of


@pytest.fixture
def small_splits(spark):
    """Tables are written in small row groups and read back in many splits."""
    hadoop, names = spark.sparkContext._jsc.hadoopConfiguration(), {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    for k, v in {"parquet.block.size": "32768", "parquet.page.size.row.check.min": "100", "parquet.page.row.count.limit": "500", "parquet.block.size.row.check.min": "100"}.items():
        hadoop.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
    for k in ("parquet.block.size", "parquet.page.size.row.check.min", "parquet.page.row.count.limit", "parquet.block.size.row.check.min"):
        hadoop.unset(k)


def test_exact_dedup_in_splits(spark, small_splits):
    from tessella.llm.exact_dedup import exact_dedup

    n = 30_000
    rows = spark.range(0, 2 * n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % n).cast("string")).alias("text"))
    out = exact_dedup(rows)
    found = out.agg(F.count(F.lit(1)), F.countDistinct("doc_id"), F.count_if("kept"), F.min("group_size"), F.max("group_size"), F.count_if(F.col("keep_id") != F.col("doc_id") % n)).head()
    assert tuple(found) == (2 * n, 2 * n, n, 2, 2, 0)


def test_exact_dedup_many_slots_null_and_repeated_ids(spark, small_splits):
    """More slots than one digit counts, null and repeated ids, and texts of very different lengths."""
    from tessella.llm.exact_dedup import exact_dedup

    rng = np.random.default_rng(21)
    pool = ["", "a", "x" * 300_000, "long \t words " * 20_000, *(f"text {i}" for i in range(60))]
    rows = [(None if rng.random() < 0.2 else int(rng.integers(0, 400)), None if rng.random() < 0.05 else str(pool[int(rng.integers(0, len(pool)))])) for _ in range(1500)]
    same = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[same(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[same(t)]
        low = min((x for x in ids if x is not None), default=None)
        want[(i, low, len(ids), i == low, hashlib.sha256(same(t).encode()).hexdigest())] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("slot", F.lit("x")).repartition(70)
    assert Counter(tuple(r) for r in exact_dedup(df).collect()) == want


CLASHES = {"kept_id": 1, "kept_h": "a", "_near_h": 2, "own_id": 3, "own_h": 4, "text_key": "mine", "row": 5, "_mix_key": 6, "mix_key": 7, "own": 8, "n": 9, "k": 10, "h": 11, "label": "x", "mix_id": 1, "mix_rows": 2, "copies": 3, "doc": 1, "rows": 2, "p": 0.5, "_id": 4, "_text": "t", "k0": 1, "kt": "x", "_block": 2, "e": 1, "node": 2, "a.b": 3}


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    plain = docs_of(spark, [*texts, None, "", texts[0]])
    clash = docs_of(spark, [*texts, None, "", texts[0]], **CLASHES)
    for name, stage in p.STAGES[:-1]:
        want, got = stage(spark, plain, sf), stage(spark, clash, sf)
        assert got.columns == clash.columns and dict(got.dtypes) == dict(clash.dtypes), name
        rows = got.collect()
        assert all(r[k] == v for r in rows for k, v in CLASHES.items()), name
        if name != "mixing":  # whose draws follow all columns
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in want.collect()), name
    assert p.STAGES[-1][1](spark, clash, sf).count() == clash.count()
    assert clash.limit(0).schema == p.STAGES[1][1](spark, clash.limit(0), sf).schema


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in p.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0, name
