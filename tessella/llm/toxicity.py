"""Toxicity scores from a character n-gram classifier with naive Bayes features.

Texts are folded to lower-case letters and single spaces; their character
n-grams of a few sizes are hashed to buckets. From labelled texts come, for each
bucket, the numbers of toxic and of other texts that have it, and from those
the log of the ratio of its smoothed shares. A text's features are the logs of
its bucket counts scaled by these ratios, for the ``FEATURES`` buckets whose
ratios are most significant. A logistic classifier over them, with L2 penalty,
is fitted in numpy and gives the probability.

The fit takes at most ``MAX_LABELLED`` labelled texts, in the order of a hash of
their ids, and of these the first that have ``MAX_ENTRIES`` features together at
most; the bounds are on what the driver holds. Counting and featurising run
on the executors, and every whole text is scored, many at a time, in numpy.
Only the bounded list of chosen labels is broadcast to find their texts.

Cases: null and empty texts have no features and get the score of the
classifier's bias; labels other than 0 and 1, or null, are not learned from;
without texts of both labels all scores are the share of label 1 (0 if there
are none). Repeated rows are scored alike; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, small_batches
from .language_id import folded, grams

GRAMS = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 8192
MAX_LABELLED = 12_000
#: Features of all texts that are learned from; so many numbers and places are on the driver.
MAX_ENTRIES = 16_000_000
#: Code points that are hashed together; bounds a worker's arrays.
PIECE = 1 << 18
SMOOTHING = 1.0


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts, the buckets of all their n-grams, and the text (from 0) of each."""
    points, at = folded(texts)
    for a, b in blocks(at, PIECE):
        own, edges = points[at[a] : at[b]], at[a : b + 1] - at[a]
        ids, of = [], []
        doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(edges))
        for size in GRAMS:
            n = len(own) - size + 1
            if n > 0:
                inside = doc[:n] == doc[size - 1 :]
                ids.append(grams(own, size, BUCKETS)[inside])
                of.append(doc[:n][inside])
        yield a, b, np.concatenate(ids or [np.empty(0, np.uint32)]), np.concatenate(of or [np.empty(0, np.int32)])


@dataclass
class Model:
    places: np.ndarray  # of each bucket its feature, or -1
    weights: np.ndarray  # ratio times classifier weight
    bias: float

    def counts(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For ranges of texts: the first one's place, and text, feature and log count of what they have."""
        k = max(1, len(self.weights))
        for a, b, ids, of in _pieces(texts):
            place = self.places[ids]
            own = place >= 0
            n = np.bincount(of[own].astype(np.int64) * k + place[own], minlength=(b - a) * k)
            some = np.flatnonzero(n)
            yield a, some // k, some % k, np.log1p(n[some])

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for a, of, feature, value in self.counts(texts):
            if len(of):
                sums = np.bincount(of, value * self.weights[feature])
                z[a : a + len(sums)] += sums
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, label`` of at most ``most`` labels, by a hash of ids."""
    named = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label"))
    chosen = named.filter(learn & F.col("label").isin(0, 1)).distinct().orderBy(F.xxhash64(F.lit("toxicity"), "_id"), "_id", "label").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = cut(rows.join(F.broadcast(chosen), "_id").select(F.xxhash64(F.lit("toxicity"), "_id").alias("drawn"), "text", "label"))  # at most ``most`` pairs of numbers
    # repeated ids can make more rows than labels
    entries = F.least(F.lit(FEATURES), F.length("text") * len(GRAMS))
    sizes = found.select("drawn", entries.alias("n")).groupBy("drawn").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("drawn").limit(most).collect()
    total = np.cumsum([max(r.n or 0, r.rows) for r in sizes])
    enough = int(np.searchsorted(total, MAX_ENTRIES, "right"))
    last = sizes[enough - 1].drawn if enough else None
    return found.filter(F.col("drawn") <= F.lit(last)).select("text", "label") if enough else found.limit(0).select("text", "label")


def _ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most significant buckets and their log-count ratios."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, ids, of in _pieces(batch.column(0).to_pylist()):
                pairs = np.unique(of.astype(np.int64) * BUCKETS + ids)
                for y in (0, 1):
                    own = label[a:b][pairs // BUCKETS] == y
                    seen[y] += np.bincount(pairs[own] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "no": pa.array(seen[0][some], pa.int64()), "yes": pa.array(seen[1][some], pa.int64())})

    sums = rows.mapInArrow(count, "bucket int, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    found = sums.filter(F.col("no") + F.col("yes") >= 3).toPandas()  # BUCKETS rows at most
    no, yes = found["no"].to_numpy() + SMOOTHING, found["yes"].to_numpy() + SMOOTHING
    ratio = np.log(yes / yes.sum()) - np.log(no / no.sum()) if len(found) else np.empty(0)
    weight = np.abs(ratio) / np.sqrt(1 / yes + 1 / no)
    best = np.lexsort((found["bucket"], -weight))[:FEATURES]
    return found["bucket"].to_numpy()[best].astype(np.int64), ratio[best]


def _logistic(of: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, k: int, penalty: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of least penalised loss, by gradient steps with momentum and adapted rates."""
    w, bias = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(of, value * w[feature], len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        g = np.append(np.bincount(feature, value * err[of], k) + penalty * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w -= move[:-1]
        bias -= float(move[-1])
    return w, bias


def train(rows: DataFrame) -> Model:
    """Fit a model to the bounded table ``text, label``."""
    n, yes = rows.agg(F.count(F.lit(1)), F.sum("label")).head()
    empty = np.full(BUCKETS, -1, np.int32)
    if not n or not yes or yes == n:
        share = min(max((yes or 0) / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(empty, np.zeros(0), float(np.log(share / (1 - share))))
    buckets, ratio = _ratios(rows)
    model = Model(empty, np.ones(len(buckets)), 0.0)
    model.places[buckets] = np.arange(len(buckets), dtype=np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features: list[list[int]] = [[] for _ in range(len(batch))]
            values: list[list[float]] = [[] for _ in range(len(batch))]
            for a, of, feature, value in shared.value.counts(batch.column(0).to_pylist()):
                at = np.searchsorted(of, np.arange(of[-1] + 2)) if len(of) else [0]
                for d, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    features[a + d], values[a + d] = feature[i:j].tolist(), value[i:j].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["label", "feature", "value"])

    table = rows.mapInArrow(featurise, "label int, feature array<int>, value array<float>").toArrow()
    y = table["label"].to_numpy().astype(float)
    lists = table["feature"].combine_chunks()
    of = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    feature = np.asarray(lists.flatten()).astype(np.int64)
    value = np.asarray(table["value"].combine_chunks().flatten()).astype(float) * ratio[feature]
    w, bias = _logistic(of, feature, value, y, len(buckets))
    return Model(model.places, ratio * w, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: ``doc_id, score, predicted``. ``learn``, over ``_id``, marks labels that may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(cut(labelled(docs, labels, learn, most, id_col, text_col, label_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, predicted int")
