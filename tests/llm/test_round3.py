"""Quality, importance resampling and fill-in-middle against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .test_llm import SCHEMA, TEXTS, docs_of, empty, words_of

# ---------------------------------------------------- importance resampling


def slow_features(text):
    w = words_of(text)
    return [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]], len(w)


def slow_resample(rows, target):
    s, t = (Counter(f for x in texts for f in slow_features(x)[0]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    out, able = [], []
    for i, x in rows:
        f, n = slow_features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            able.append(len(out) - 1)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, out[k][1]))
    for r, k in enumerate(able[: 25 * len(able) // 100]):
        out[k][4] = r + 1
    return Counter(map(tuple, out))


def test_resample_brute_force(spark):
    from tessella.llm.importance import resample

    rng = np.random.default_rng(41)
    vocabulary = [*"abcdefghij", "Naïve", "日本", "x9", "y-z", "LONG" * 30]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [*TEXTS, *(make(int(rng.integers(0, 90))) for _ in range(300)), make(4000)]
    target = [make(12)[:40], None, "a b c a b c", ""]
    docs, bench = docs_of(spark, texts, score=1, row="x", k0=2, weight=3), spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample(docs, bench).collect())
    assert got == slow_resample(list(enumerate(texts)), target)
    assert sum(r[4] is not None for r in got) > 50
    # negative, null, repeated and far ids; ties at the bound
    many = [(i, x) for i in (None, -5, 7, 1 << 62, -(1 << 62)) for x in (make(25), make(25), "same words " * 15) for _ in range(4)]
    got = resample(spark.createDataFrame(many, "doc_id long, text string"), bench).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == slow_resample(many, target)
    assert resample(empty(spark), bench).count() == 0
    assert resample(docs, bench.limit(0)).count() == len(texts)


def test_word_hashes_in_pieces(monkeypatch):
    """Pieces of any size and slices of a batch give the same features."""
    from tessella.llm import importance

    rng = np.random.default_rng(42)
    texts = ["", None, *TEXTS, "x" * 900 + " y", *("".join(rng.choice(list("abZé9-_ 日"), int(rng.integers(0, 300)))) for _ in range(60))]
    for piece in (1 << 20, 7, 100):
        monkeypatch.setattr(importance, "PIECE", piece)
        found = [[] for _ in texts]
        for row, word, pair_row, pair in importance.features(pa.array(["zz", *texts])[1:]):
            for i, b in [*zip(row, word, strict=True), *zip(pair_row, pair, strict=True)]:
                found[i].append(int(b))
        assert [sorted(x) for x in found] == [sorted(slow_features(t)[0]) for t in texts]


@pytest.mark.parametrize("digit", [1, 3, 12])
def test_radix_selection(spark, digit):
    from tessella.llm.importance import radix_kth, up_to

    rng = np.random.default_rng(43)
    rows = [(int(rng.integers(-40, 40)) ** 3, int(rng.integers(0, 3)), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 57, 399, 400):
        bound = radix_kth(df, ["a", "b", "c"], k, digit)
        assert sorted(map(tuple, df.filter(up_to(["a", "b", "c"], bound)).collect())) == sorted(rows)[:k]
    assert radix_kth(df, ["a"], 401) is None and radix_kth(df.limit(0), ["a"], 1) is None


# ---------------------------------------------------------- fill in middle


def slow_fim(doc_id, text):
    t = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", t
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", t


@pytest.mark.parametrize("seen", [1 << 18, 2])
def test_fill_in_middle_brute_force(spark, monkeypatch, seen):
    """Texts of all widths, copies by the hundred, marks and half marks, null and repeated ids, a long text."""
    from tessella.llm import fill_in_middle as fim

    monkeypatch.setattr(fim, "SEEN", seen)
    rng = np.random.default_rng(51)
    wide = ["a", "é", "日", "😀", " ", "\n", "<", "P", "S>", "<M", "\u0301"]
    texts = [*TEXTS, "x <P> y", "<S>", "a<M>", "<P", "S>", "<", ">", "😀" * 700, "aé日😀" * 90_000, *("".join(rng.choice(wide, int(rng.integers(0, 1500)))) for _ in range(60))]
    rows = list(enumerate(texts)) + [(1000 + i, "one text with many copies, é") for i in range(500)] + [(None, "no id")] * 9 + [(None, None), (3, "again"), (3, "again"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(1)).withColumn("part", F.lit(2)).repartition(5)
    got = Counter(tuple(r) for r in fim.fill_in_middle(df).collect())
    assert got == Counter(slow_fim(*r) for r in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty(spark)).count() == 0


@pytest.mark.parametrize(("sample", "chunk"), [(512, 1 << 20), (4, 7), (3, 16)])
def test_boundary_lists(monkeypatch, sample, chunk):
    from tessella.llm import fill_in_middle as fim

    monkeypatch.setattr(fim, "SAMPLE", sample)
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = np.random.default_rng(52)
    for letters in ("ab", "aé", "日é😀a", "😀"):
        for n in (0, 1, 8, 9, 300):
            text = "".join(rng.choice(list(letters), n))
            found = fim.boundaries(np.frombuffer(text.encode(), np.uint8))
            views = [memoryview(x) if isinstance(x, bytes) else x for x in found]
            assert [fim.select(i, *views) for i in range(n + 1)] == [len(text[:i].encode()) for i in range(n + 1)]


# ------------------------------------------------------------------ quality


def quality_corpus(n=900):
    """Good prose, and three kinds of junk of which no label is ever given."""
    rng = np.random.default_rng(61)
    words = ["house", "river", "morning", "table", "window", "garden", "über", "walked", "The", "a"]
    texts, good = [], []
    for i in range(n):
        w = [str(x) for x in rng.choice(words, int(rng.integers(15, 120)))]
        kind = ["caps", "marks", "echo", *["prose"] * 9][i % 12]
        if kind == "caps":
            w = [x.upper() + "!!" for x in w]
        elif kind == "marks":
            w = [x + "$$$" for x in w]
        elif kind == "echo":
            w = [w[0]] * 40 + [w[1]] * 40
        else:
            w[-1] += "."
        texts.append(" ".join(w))
        good.append(kind == "prose")
    return texts, good


def test_quality_held_out(spark):
    from tessella.llm.language_id import crc_fold
    from tessella.llm.quality import score_quality, train

    texts, good = quality_corpus()
    df = docs_of(spark, [*texts, None, ""], score=1, by="x", y=2)
    # only some good texts are labelled; labels of bad ones say nothing to the fit
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good) if i % 3 or not g] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    learn = crc_fold(F.col("_id"), 5) != 0
    got = {r.doc_id: r for r in score_quality(df, labels, learn).collect()}
    assert len(got) == len(texts) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted for i in held if good[i]]) > 0.97
    assert np.mean([got[i].predicted for i in held if not good[i]]) < 0.1
    without = score_quality(df, labels.filter("quality = 1"), learn)
    assert all(abs(r.score - got[r.doc_id].score) < 1e-6 for r in without.collect())
    assert abs(train(df, labels, learn)[1] - np.mean(good)) < 0.08
    assert score_quality(empty(spark), labels, F.lit(True)).count() == 0
    assert {r.score for r in score_quality(df.limit(3), labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_quality_features_of_long_texts(monkeypatch):
    """Blocks of any size give the same features; a long text is read in segments, all of it."""
    from tessella.llm import quality

    texts = [*quality_corpus(30)[0], None, "", "x", *TEXTS]
    whole = np.concatenate([x for _, x in quality.vectors(texts)])
    for piece, rows in ((50, 128), (1 << 18, 3)):
        monkeypatch.setattr(quality, "PIECE", piece)
        monkeypatch.setattr(quality, "ROWS", rows)
        found = list(quality.vectors(texts))
        assert [a for a, _ in found] == list(np.cumsum([0, *[len(x) for _, x in found]])[:-1])
        assert np.allclose(np.concatenate([x for _, x in found]), whole)
    monkeypatch.setattr(quality, "SEGMENT", 60)  # of words that end in spaces, so that no word is cut
    text = "abcde fghi " * 600 + "!!!! " * 300
    counted = quality.SHAPES + quality.WORDS
    a = next(quality.vectors([text]))[1][0][:counted]
    monkeypatch.setattr(quality, "SEGMENT", 1 << 20)
    c = next(quality.vectors([text]))[1][0][:counted]
    assert np.abs(a - c).max() < 0.2 and a @ c > 0.9 * (c @ c)


def test_class_prior():
    from tessella.llm.quality import SCORES, class_prior

    rng = np.random.default_rng(62)
    for share in (0.3, 0.6, 0.9):
        count = lambda x: np.bincount((np.clip(x, 0, 0.999) * SCORES).astype(int), minlength=SCORES)
        good, bad = rng.normal(0.6, 0.08, int(20_000 * share)), rng.normal(0.2, 0.08, int(20_000 * (1 - share)))
        assert abs(class_prior(count(np.concatenate([good, bad])), count(rng.normal(0.6, 0.08, 600))) - share) < 0.06


# ------------------------------------------------------- language rejection


def test_language_rejection_rates():
    """Trained on a small corpus: shuffled texts, random letters and a language left out are rejected, held-out real texts and short ones are not."""
    import duckdb

    from tessella.llm.language_id import train

    docs = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang IS NOT NULL AND length(text) > 0 ORDER BY 1").fetchall()
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    learn = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 != 0]
    model = train([d[1] for d in learn], [d[2] for d in learn])
    rng = np.random.default_rng(95)
    lang, score, rejected = model.predict([d[1] for d in held])
    assert np.mean([a == d[2] for a, d in zip(lang, held, strict=True)]) > 0.98 and rejected.mean() <= 0.01
    assert model.predict([d[1][:25] for d in held])[2].mean() <= 0.02
    assert model.predict(["".join(rng.permutation(list(d[1]))) for d in held])[2].mean() >= 0.9
    assert model.predict(["".join(rng.choice(list("qxzjkvw   "), 300)) for _ in range(200)])[2].mean() >= 0.9
    without = train([d[1] for d in learn if d[2] != "fr"], [d[2] for d in learn if d[2] != "fr"])
    assert without.predict([d[1] for d in held if d[2] == "fr"])[2].mean() >= 0.9
    assert train([], []).predict(["some text"])[0] == ["und"]
    assert train(["one two three four"] * 20, ["en"] * 20).predict(["one two three"])[0] == ["en"]


# ----------------------------------------------------------------- secrets


def wrappers():
    import base64
    import gzip
    import urllib.parse

    text = lambda f: lambda s: "".join(f(c) for c in s)
    packed = lambda f: lambda s: base64.b64encode(f(s.encode())).decode()
    return {
        "percent": text(lambda c: "".join(f"%{b:02X}" for b in c.encode())), "quoted": urllib.parse.quote, "u": text(lambda c: f"\\u{ord(c):04x}"), "U": text(lambda c: f"\\U{ord(c):08X}"), "brace": text(lambda c: f"\\u{{{ord(c):x}}}"),
        "percent-u": text(lambda c: f"%u{ord(c):04X}"), "reference": text(lambda c: f"&#{ord(c)};"), "hexadecimal": text(lambda c: f"&#x{ord(c):x};"), "base64": packed(lambda b: b), "url-safe": lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
        "gzip": packed(lambda b: gzip.compress(b, mtime=0)), "zlib": packed(zlib.compress), "twice": packed(lambda b: gzip.compress(zlib.compress(b), mtime=0)),
    }


def test_secrets_in_random_nestings():
    """A secret under one to four layers of any kinds is found, with the span of what hides it."""
    from tessella.llm.secrets import scan

    rng, ways = np.random.default_rng(96), wrappers()
    for k in range(150):
        secret = f'{rng.choice(["password", "api_key", "Token"])}: "{"".join(rng.choice(list("abcdXYZ0189"), 14))}"'
        names = list(rng.choice(list(ways), int(rng.integers(1, 5))))
        hidden = secret
        for name in names:
            hidden = ways[name](hidden)
        if len(hidden) > 20_000 or hidden == secret:
            continue
        base, spans, _ = scan(f"before it {hidden} after it")
        own = [(a, b) for kind, a, b in spans if kind == "assign" and a >= 10 and b <= 10 + len(hidden)]
        assert own, (names, hidden[:200])
        assert max(b - a for a, b in own) >= 0.5 * len(hidden), names
    assert scan("&#99999999; \\U7fffffff \\u{ffffff} %uD800 &#xD800; token=abcdefgh")[1] == [("assign", 50, 64)]


def test_secrets_reads_packed_looking_lines_once():
    """Lines that only start like compressed data don't make a scan quadratic."""
    import time

    from tessella.llm.secrets import scan

    rng = np.random.default_rng(97)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    took = []
    for n in (1000, 4000):
        text = "\n".join("eJ" + "".join(rng.choice(letters, 74)) for _ in range(n))
        start = time.time()
        scan(text)
        took.append(time.time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_secrets_of_a_table(spark):
    """Base spans equal plain patterns on a whole table, and each planted layer adds its span."""
    from tessella.llm.secrets import scan_secrets

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    way = list(wrappers().items())
    texts = {int(i): f"{t}\n{way[k % len(way)][1]('secret = hunter2hunter2')} end" if k % 3 == 0 else t for k, (i, t) in enumerate(zip(docs["doc_id"], docs["text"], strict=True))}
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    patterns = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    for k, (i, t) in enumerate(texts.items()):
        want = sorted((m.start(), n, m.end(), kind) for n, (kind, (p, g, least)) in enumerate(patterns.items()) for m in re.finditer(p, t, re.ASCII) if len(m.group(g)) >= least)
        assert got[i].base == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[3] == kind for w in want) for kind in patterns)
        if k % 3 == 0:
            planted = t.rindex("\n") + 1
            assert any(x.startswith("assign:") and int(x.split(":")[1]) >= planted for x in got[i].spans.split(",")), (i, t[planted:])
