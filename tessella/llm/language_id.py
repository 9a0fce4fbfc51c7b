"""Language identification with averaged hashed subword embeddings.

A text is folded to lower-case letters and single spaces. Its subwords, all
character n-grams of a few sizes, are hashed to rows of an embedding table; the
text is the mean of its rows, and a linear softmax over languages reads it. Table
and softmax are trained together by stochastic gradient descent in numpy (with
steps that shrink by past gradients) on a bounded sample: about ``per_lang``
labelled texts of each language, chosen by a hash of their ids. Texts of more
than ``LONGEST`` characters are not sampled, and the sample has ``SAMPLE_CHARS``
characters at most.

Rejection is learned and calibrated. The softmax has one more class, of no
language: texts whose characters are shuffled, and random letters, made from the
sample. A text's score is the probability of its best language beside that
class. On a held-back tenth of the sample a temperature is chosen by
likelihood, of passages of several lengths and as many shuffled and random ones;
and for each class of lengths a text is rejected if its probability to be of any
language is below one half, or below what all but a fraction ``reject`` of held-back
real passages of that length reach, if that is less. So texts in two languages,
and short ones, of which little can be said, stay.

As the model is linear after the mean, its rows are sent out as scores for each
language, which gives the same result. Every whole text is scored in numpy,
many at a time; no text is shuffled.

Cases: a null text or one without a letter is ``und`` with score 0 and counts
as rejected; null labels are not learned from; with no labelled text every
prediction is ``und``; one language alone is always predicted.
Repeated rows are scored alike; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, small_batches

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
WIDTH = 16
#: Bound of the sample: texts of a language, and characters of a text.
PER_LANG, LONGEST = 800, 200_000
#: Characters of the whole sample, shared evenly by the languages.
SAMPLE_CHARS = 64_000_000
#: Code points that are scored together; bounds a worker's arrays.
PIECE = 1 << 19
#: Lengths, in characters, at which confidence is calibrated; a class of lengths reaches from each halfway, by ratio, to the next.
LENGTHS = (20, 40, 80, 200, 1000)

_STEP = np.uint32(0x9E3779B1)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    if not _letters:
        table = np.full(0x110000, 0x20, np.uint32)
        own = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.uint32)
        table[own] = own
        _letters.append(table)
    return _letters[0]


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, runs of other than letters as one space, and n+1 offsets.

    Each text begins and ends with a space, so its first and last words have bounds.
    """
    parts = [f" {t.lower()} " if t else "  " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    points = _letter_table()[points]
    blank = points == 0x20
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1]] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def grams(points: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """A bucket for the n-gram that starts at each code point but the last few."""
    n = len(points) - size + 1
    h = np.full(max(n, 0), size, np.uint32)
    for k in range(size):
        h = (h ^ points[k : k + n]) * _STEP
        h ^= h >> np.uint32(15)
    return h & np.uint32(buckets - 1)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x (langs and none): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    thresholds: np.ndarray  # for each class of lengths

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its probabilities, of none last, whether it has a letter, and its class of lengths."""
        points, at = folded(texts)
        k = len(self.bias)
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
        for a, b in blocks(at, PIECE):
            own, edges = points[at[a] : at[b]], at[a : b + 1] - at[a]
            for size in GRAMS:
                ids = grams(own, size, BUCKETS)
                stops = np.maximum(edges[1:] - size + 1, edges[:-1])
                for j in range(k):
                    total = np.concatenate([[0.0], np.cumsum(self.scores[:, j][ids], dtype=np.float64)])
                    total = np.pad(total, (0, size), mode="edge")
                    sums[a:b, j] += total[stops] - total[edges[:-1]]
                counts[a:b] += stops - edges[:-1]
        known = np.diff(at) > 2  # a letter between the spaces
        known &= np.array([bool(t) for t in texts], bool) if texts else known
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p, known, _length_class(np.diff(at) - 2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether it is rejected, of each text."""
        p, known, length = self.probabilities(texts)
        best = p[:, : len(self.langs)].argmax(axis=1)
        score = np.where(known, p[np.arange(len(p)), best], 0.0)
        lang = [self.langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)]
        return lang, score, ~known | (1 - p[:, -1] < self.thresholds[length])


def _length_class(n: np.ndarray) -> np.ndarray:
    """The class of folded lengths."""
    edges = [(a * b) ** 0.5 for a, b in zip(LENGTHS[:-1], LENGTHS[1:], strict=True)]
    return np.searchsorted(edges, n, "right")


def scrambled(text: str, rng: np.random.Generator, letters: np.ndarray) -> str:
    """A text of no language and the same length: its characters shuffled, or random letters of a few kinds in words."""
    if rng.random() < 0.5:
        return "".join(rng.permutation(list(text)))
    few = rng.choice(letters, rng.integers(2, max(3, len(letters))))
    own = rng.choice(few, len(text))
    own[rng.random(len(text)) < rng.choice([0.0, 0.1, 0.2])] = " "
    return "".join(own)


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their share of the n-grams, for each text."""
    out = []
    for text in texts:
        points, _ = folded([text])
        ids, n = np.unique(np.concatenate([grams(points, s, BUCKETS) for s in GRAMS]), return_counts=True)
        out.append((ids, (n / n.sum()).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.1, reject: float = 0.001, seed: int = 0) -> Model:
    """Fit a model; whole texts and passages of them, so that short texts are read as well."""
    langs = sorted(set(labels))
    if not langs:
        return Model(["und"], np.zeros((BUCKETS, 2), np.float32), np.zeros(2), 1.0, np.full(len(LENGTHS), 2.0))
    rng = np.random.default_rng(seed)
    target = np.array([langs.index(x) for x in labels])
    none = len(langs)
    held = rng.random(len(texts)) < 0.1
    if held.all() or not held.any():
        held[:] = False
    letters = np.array(sorted({c for t in texts for c in set(t.lower()) if c.isalpha()}) or ["x"])
    fit = np.flatnonzero(~held)

    def passage(text: str, length: int) -> str:
        start = rng.integers(0, max(1, len(text) - length))
        return text[start : start + length]

    passages, of = [], []
    for i in fit:
        text = texts[i]
        for own in (text, passage(text, 40), passage(text, 200)):
            passages.append(own)
            of.append(target[i])
        passages.append(scrambled(passage(text, int(rng.choice([40, 200, 1000]))), rng, letters))
        of.append(none)
    x, y = _sparse(passages), np.array(of)
    k = len(langs) + 1
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    # each parameter's steps shrink with the gradients it has had
    table_past, weights_past = np.full((BUCKETS, 1), 1e-8, np.float32), np.full((WIDTH, k), 1e-8, np.float32)
    # classes weigh alike, whatever their share of the sample
    share = np.bincount(y, minlength=k) / len(y)
    scale = (1 / (k * np.maximum(share, 1e-9))).clip(max=10).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(x)):
            ids, w = x[i]
            mean = w @ table[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= scale[y[i]]
            back = weights @ p
            slope = np.outer(mean, p)
            weights_past += slope * slope
            weights -= step * slope / np.sqrt(weights_past)
            bias -= 0.01 * step * p
            table_past[ids, 0] += w * w * np.mean(back * back)
            table[ids] -= (step * w / np.sqrt(table_past[ids, 0]))[:, None] * back
    model = Model(langs, table @ weights, bias, 1.0, np.zeros(len(LENGTHS)))
    check = np.flatnonzero(held) if held.any() else fit
    real = [passage(texts[i], n) for n in LENGTHS for i in check]
    _calibrate(model, real, np.tile(target[check], len(LENGTHS)), [scrambled(t, rng, letters) for t in real], reject)
    return model


def _calibrate(model: Model, real: list[str], truth: np.ndarray, negative: list[str], reject: float) -> None:
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 41):
        model.temperature = float(t)
        lang, score, _ = model.predict(real)
        right = np.array([model.langs.index(x) if x != "und" else -1 for x in lang]) == truth
        loss = -np.log(np.clip(np.where(right, score, 1 - score), 1e-6, 1)).mean() - np.log(np.clip(1 - model.predict(negative)[1], 1e-6, 1)).mean()
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    p, known, length = model.probabilities(real)
    for c in range(len(LENGTHS)):
        own = 1 - p[known & (length == c), -1]
        # where no passage of a length was seen, only what is surely no language goes
        model.thresholds[c] = min(0.5, float(np.quantile(own, reject))) if len(own) else 0.01


def sample(docs: DataFrame, learn: Column, per_lang: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """Texts and labels to learn from: about ``per_lang`` of each language, by a hash of ids, in one pass over texts."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(rows.groupBy(F.col(lang_col).cast("string")).count().collect())
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter((draw < F.element_at(share, F.col(lang_col).cast("string"))) & (F.length(text_col) <= LONGEST))
    chosen = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("drawn"))
    chosen = chosen.orderBy("drawn", "text").limit(per_lang * len(counts) * 2)
    # of the drawn texts, a few hundred of each language, those that the driver can hold
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("drawn", "text"))
    found = chosen.withColumn("before", before).filter(F.col("before") <= SAMPLE_CHARS // len(counts)).orderBy("drawn", "text").collect()
    return [r.text for r in found], [r.lang for r in found]


def identify(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id, lang_pred, score, rejected`` and the columns to ``keep``, named ``kept_...``.

    ``learn`` marks the rows whose labels may be learned from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(*sample(docs, learn, per_lang, id_col, text_col, lang_col)))

    # the text goes to the workers once, also where it is to be kept
    extra = [c for c in keep if c != text_col]
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(extra)])
    kept = [f"k{i} {kinds[c]}" for i, c in enumerate(extra)] + (["kt string"] if text_col in keep else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.value.predict(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            columns += [batch.column(2 + i) for i in range(len(extra))] + ([batch.column(1)] if text_col in keep else [])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(["_id long, _lang string, _score double, _rejected boolean", *kept])
    names = ["_id", "_lang", "_score", "_rejected", *[k.split(" ")[0] for k in kept]]
    out = own.mapInArrow(run, schema)
    back = {c: f"k{i}" for i, c in enumerate(extra)} | {text_col: "kt"}
    return out.select(F.col("_id").alias("doc_id"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"), *[F.col(back[c]).alias(f"kept_{c}") for c in keep])


def crc_fold(id_col: Column, folds: int) -> Column:
    """CRC-32 of an id's text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
