"""Quality scores by positive-unlabelled learning.

What is labelled good is trusted; everything else is web text of which nobody
says what it is. The classifier minimises the non-negative unbiased risk: with
the class prior ``pi`` (the share of good texts), the risk of calling good texts
bad among the unlabelled is taken out with the trusted ones, and where what is
left of the unlabelled risk falls below zero, which only overfitting can do,
steps go against it instead. The loss is the sigmoid of the margin against a
text, which is bounded, so that few texts cannot outweigh the rest; the score is
the sigmoid of the margin. Labels of bad texts are never used.

The class prior is estimated: a plain classifier of trusted against unlabelled
texts is fitted first and scores *all* documents, whose scores are counted in
bins on the executors. Above a threshold that nearly all held-back trusted texts
pass, the shares of documents and of trusted texts that pass give an upper bound
of the prior; the bound is taken where it is surest to be low, that is where it
is least after a margin for the number of texts counted.

A text's features are hashed n-grams of its shape (letters by case, in runs as
one, digits, space, other characters as they are), hashed words, and bins of a
few figures: lengths, shares of capitals, digits, marks and space, and how many
words repeat the one before, the one before that, or any earlier one. Each group
of counts is scaled to its roots of shares. The model is linear in them and is
fitted in numpy by minibatches.

The fit takes at most ``MOST`` trusted and ``MOST_UNLABELLED`` unlabelled texts,
drawn by a hash from those of ``LONGEST`` characters at most; these bounds are on
what the driver holds. Every whole text is scored. Texts of more than ``SEGMENT`` characters are read in segments,
whose counts add up; words and n-grams across two segments are not seen, and words
count as repeated within their segment.

Cases: null and empty texts have the figures of an empty text and are scored like
others; labels other than 1, or null, are not trusted; without trusted texts all
scores are 0, without unlabelled ones 1, up to nine places. Repeated rows are scored alike; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .decontaminate import _power

#: Buckets of shape n-grams and words, figures, and bins of each.
SHAPES, WORDS, FIGURES, BINS = 1536, 2048, 10, 32
WIDTH = SHAPES + WORDS + FIGURES * BINS
SHAPE_GRAMS = (1, 2, 3, 4, 5)
#: Bounds of the sample, in texts and in characters of a text.
MOST, MOST_UNLABELLED, LONGEST = 3000, 5000, 200_000
#: Characters of a long text that are read together, and of several texts; texts of a block.
SEGMENT, PIECE, ROWS = 1 << 20, 1 << 18, 128
#: Bins of the scores from which the prior is estimated.
SCORES = 512

_STEP = np.uint32(0x9E3779B1)
_tables: list[np.ndarray] = []
_LETTER, _CAPITAL, _DIGIT, _SPACE, _OTHER = (ord(c) for c in "aA0 ~")


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its shape, and its lower-case form."""
    if not _tables:
        shape, lower = np.full(0x110000, _OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                shape[c] = _CAPITAL if x.isupper() else _LETTER
                if len(y := x.lower()) == 1:
                    lower[c] = ord(y)
            elif x.isdigit():
                shape[c] = _DIGIT
            elif x.isspace():
                shape[c] = 0x0A if x == "\n" else _SPACE
            elif c < 128:
                shape[c] = c
        _tables.extend((shape, lower))
    return _tables[0], _tables[1]


def _hashed(values: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` values."""
    n = max(0, len(values) - size + 1)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h = (h ^ values[k : k + n]) * _STEP
        h ^= h >> np.uint32(15)
    return h


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts, or segments of them, that are looked at together."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for a in range(0, max(1, len(text)), SEGMENT):
            part = text[a : a + SEGMENT]
            if parts and (size + len(part) > PIECE or len(parts) == ROWS):
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part) + 1
    if parts:
        yield rows, parts


def _counted(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part: counts of shapes, counts of words, and sums from which its figures come."""
    shape_of, lower_of = _table()
    k = len(parts)
    points = np.frombuffer("".join(f"{p}\n" for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    of = np.repeat(np.arange(k), np.diff(edges))
    shape = shape_of[points]
    inside = np.ones(len(points), bool)
    inside[edges[1:] - 1] = False  # the mark after each part
    letter, capital, digit, space = shape == _LETTER, shape == _CAPITAL, shape == _DIGIT, (shape == _SPACE) | (shape == 0x0A)
    count = lambda x: np.bincount(of[x & inside], minlength=k)
    sums = [np.diff(edges) - 1, count(letter | capital), count(capital), count(digit), count(space)]
    # shapes: a run of small letters is one
    stays = np.ones(len(shape), bool)
    stays[1:] = ~(letter[1:] & letter[:-1])
    short, own = shape[stays].astype(np.uint32), of[stays]
    shapes = np.zeros(k * SHAPES, np.int64)
    for size in SHAPE_GRAMS:
        h = _hashed(short, size) % np.uint32(SHAPES)
        first, last = own[: len(h)], own[size - 1 :]
        same = first == last
        shapes += np.bincount(first[same] * SHAPES + h[same], minlength=k * SHAPES)
    # words: runs of letters and digits
    word = letter | capital | digit
    begins, ends = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
    if len(word) and word[0]:
        begins = np.concatenate([[0], begins])
    up, down = _power(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(lower_of[points].astype(np.uint64) * up[: len(points)], out=total[1:])
    h = (total[ends] - total[begins]) * down[begins]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    at = of[begins]
    words = np.bincount(at * WORDS + (h >> np.uint64(40)).astype(np.int64) % WORDS, minlength=k * WORDS)
    again = lambda d: np.bincount(at[d:][(h[d:] == h[:-d]) & (at[d:] == at[:-d])], minlength=k)
    order = np.lexsort((h, at))
    seen = np.bincount(at[order][1:][(h[order][1:] == h[order][:-1]) & (at[order][1:] == at[order][:-1])], minlength=k) if len(h) else np.zeros(k, np.int64)
    sums += [np.bincount(at, minlength=k), again(1), again(2), seen, np.bincount(at, ends - begins, k).astype(np.int64)]
    return shapes.reshape(k, SHAPES), words.reshape(k, WORDS), np.stack(sums, axis=1)


def _vectors(shapes: np.ndarray, words: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Features of each text."""
    k = len(sums)
    chars, letters, capitals, digits, spaces, n_words, again, second, seen, word_chars = sums.T.astype(float)
    share = lambda a, b: a / np.maximum(b, 1)
    bins = [
        np.log2(chars + 1) * BINS / 24, np.log2(n_words + 1) * BINS / 20, share(word_chars, n_words) * BINS / 16, share(capitals, letters) * BINS, np.sqrt(share(digits, chars)) * BINS,
        np.sqrt(np.clip(share(chars - letters - digits - spaces, chars), 0, 1)) * BINS, share(spaces, chars) * 2 * BINS, np.sqrt(share(again, n_words)) * BINS, np.sqrt(share(second, n_words)) * BINS, share(seen, n_words) * BINS,
    ]
    out = np.zeros((k, WIDTH), np.float32)
    out[:, :SHAPES] = np.sqrt(shapes / np.maximum(shapes.sum(axis=1, keepdims=True), 1))
    out[:, SHAPES : SHAPES + WORDS] = np.sqrt(words / np.maximum(words.sum(axis=1, keepdims=True), 1))
    for j, b in enumerate(bins):
        out[np.arange(k), SHAPES + WORDS + j * BINS + np.clip(b, 0, BINS - 1).astype(int)] = 0.5
    return out


def vectors(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Features of all texts, a block at a time: the first one's row, and the vectors."""
    held = None  # what a long text has so far: its row and counts
    for rows, parts in _blocks(texts):
        counts = _counted(parts)
        at = np.asarray(rows)
        if held is not None:
            at = np.concatenate([[held[0]], at])
            counts = tuple(np.concatenate([x, y]) for x, y in zip(held[1], counts, strict=True))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        counts = tuple(np.add.reduceat(x, first) for x in counts)
        at = at[first]
        held = (int(at[-1]), tuple(x[-1:] for x in counts))  # the last one may go on
        if len(at) > 1:
            yield int(at[0]), _vectors(*(x[:-1] for x in counts))
    if held is not None:
        yield held[0], _vectors(*held[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, x in vectors(texts):
            out[a : a + len(x)] = _sigmoid(x.astype(np.float64) @ self.weights + self.bias)
        return np.round(out, 9)  # whatever texts stand in a block with it


def fit(trusted: np.ndarray, other: np.ndarray, prior: float | None, steps: int = 400, batch: int = 2000, rate: float = 0.05, penalty: float = 1e-5, seed: int = 0) -> Model:
    """A linear model by minibatches: of the non-negative risk under ``prior``, or without one the logistic model of trusted against other texts."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(WIDTH, np.float32), 0.0
    m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        p, u = (x[rng.integers(0, len(x), min(batch, len(x)))] for x in (trusted, other))
        at_p, at_u = _sigmoid(p @ w + bias), _sigmoid(u @ w + bias)
        slope_p, slope_u = at_p * (1 - at_p), at_u * (1 - at_u)  # of the risk to call a text good
        if prior is None:
            by_p, by_u = at_p - 1, at_u
        elif at_u.mean() >= prior * at_p.mean():
            by_p, by_u = -2 * prior * slope_p, slope_u
        else:  # the risk of the unlabelled has been overfitted
            by_p, by_u = prior * slope_p, -slope_u
        by_p, by_u = by_p / len(p), by_u / len(u)
        g = np.append(by_p.astype(np.float32) @ p + by_u.astype(np.float32) @ u + penalty * w, by_p.sum() + by_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    return Model(w, bias)


def class_prior(all_counts: np.ndarray, trusted: np.ndarray, delta: float = 0.1) -> float:
    """An estimate of the share of good texts from scores in bins, of all texts and of held-back trusted ones."""
    n_u, n_p = max(1, all_counts.sum()), max(1, trusted.sum())
    above_u, above_p = np.cumsum(all_counts[::-1])[::-1] / n_u, np.cumsum(trusted[::-1])[::-1] / n_p
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    some = above_p > 0
    best = int(np.argmin(np.where(some, (above_u + margin) / np.maximum(above_p, 1e-12), np.inf)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-12), 0.01, 0.99))


def _bins(score: np.ndarray) -> np.ndarray:
    return np.bincount((np.clip(score, 0, 1) * (SCORES - 1)).astype(int), minlength=SCORES)


def _score_counts(texts: DataFrame, model: Model) -> np.ndarray:
    """How many of all texts score in each bin."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SCORES, np.int64)
        for batch in batches:
            seen += _bins(shared.value.score(batch.column(0).to_pylist()))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(some, pa.int32()), "n": pa.array(seen[some], pa.int64())})

    out = np.zeros(SCORES, np.int64)
    for b, n in texts.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():  # SCORES rows at most
        out[b] = n
    return out


def _featured(texts: DataFrame, most: int) -> np.ndarray:
    """Features of a bounded table of texts, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in vectors(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())})

    rows = texts.limit(most).mapInArrow(run, "x binary").toArrow().column("x")
    out = np.empty((len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r.as_buffer(), np.float16)
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Model, float]:
    """The model and the class prior it was fitted for. ``learn``, over ``_id``, marks rows whose labels and texts may be learned from."""
    drawn = F.xxhash64(F.lit("quality"), "_id")
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).filter(learn & (F.col("y") == 1))
    chosen = chosen.select("_id").distinct().orderBy(drawn, "_id").limit(MOST)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    able = rows.filter(learn & (F.coalesce(F.length("text"), F.lit(0)) <= LONGEST))
    by = F.xxhash64(F.lit("drawn"), "_id", "text")
    trusted = cut(able.join(F.broadcast(chosen), "_id").select(by.alias("by"), "text"))  # MOST ids
    n = able.count()
    part = F.pmod(by, F.lit(1 << 40)) < F.lit(int(min(1.0, 1.2 * MOST_UNLABELLED / max(1, n)) * (1 << 40)))
    other = cut(able.filter(part).select(by.alias("by"), "text").orderBy("by", "text").limit(MOST_UNLABELLED))
    p, u = _featured(trusted.orderBy("by", "text").select("text"), MOST), _featured(other.select("text"), MOST_UNLABELLED)
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH, np.float32), 50.0 if len(p) else -50.0), float(bool(len(p)))
    held = np.arange(len(p)) % 5 == 0
    first = fit(p[~held] if len(p) > 1 else p, u, None, batch=500, rate=0.02, penalty=1e-4)
    known = _sigmoid(p[held] @ first.weights + first.bias)
    prior = class_prior(_score_counts(rows.select("text"), first), _bins(known))
    return fit(p, u, prior), prior


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: ``doc_id, score, predicted``. ``learn``, over ``_id``, marks rows that may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, learn, id_col, text_col, label_col)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, predicted int")
