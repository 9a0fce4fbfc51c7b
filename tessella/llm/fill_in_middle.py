"""Fill-in-middle transformation over an index of distinct texts.

A text of ``n`` code points is cut into prefix, middle and suffix at two places
that the document's id draws, and written as prefix, suffix, middle or as suffix,
prefix, middle, each part after its mark; some texts stay plain.

Cuts are counted in code points, texts are bytes. So a distinct text gets a list
of where its code points begin: an Elias-Fano list, whose high parts are unary in
one bit array, with the place of every ``SAMPLE``-th in a directory, and whose
low bits stand apart. A task makes it once for each text that it meets, however
many copies it has, and sends text and list on under a SHA-256 key; there, texts
are grouped by their whole content, which verifies them, and each is joined back
to its documents. The seeded cuts are then select queries, which read the few
bytes between two places of the directory; the parts are cut from the bytes,
and no text is decoded.

Texts move once: a list that were made only after grouping would send them a
second time, to the join. A key with many documents is split: the few keys that
hold more than an eighth of a partition's share of rows (so fewer than eight for
each partition) are dealt out by their ids as well.

Cases: null counts as the empty text, which is plain; null ids draw as the text
``null``; rows equal in id and text are computed once and repeated; texts that
hold a mark stay plain; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes
from .mixing import _each_row

SEED = 1
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Draws from here on, of 100, leave a text plain; of the others, draws below put the suffix first.
PLAIN, SUFFIX_FIRST = 90, 20
#: Code points between places of the directory.
SAMPLE = 512
#: Bytes of a text that are looked at together.
CHUNK = 1 << 20
#: Texts of which a task knows that it has sent them on.
SEEN = 1 << 18

_INDEX = "struct<n:bigint,bytes:bigint,bits:int,high:binary,low:binary,places:binary>"


def boundaries(data: np.ndarray) -> tuple[int, int, int, bytes, bytes, bytes]:
    """The Elias-Fano list of where the code points of UTF-8 bytes begin.

    Their number, the number of bytes, the low bits of each, the unary high
    parts, planes of low bits, and the places of every ``SAMPLE``-th in the high parts.
    """
    pieces = [(a, (data[a : a + CHUNK] & 0xC0) != 0x80) for a in range(0, len(data), CHUNK)]
    n = sum(int(np.count_nonzero(x)) for _, x in pieces)
    bits = (len(data) // n).bit_length() - 1 if n else 0
    high, low = np.zeros(((len(data) >> bits) + n) // 8 + 1, np.uint8), [[] for _ in range(bits)]
    places, i = [], 0
    rest = [np.empty(0, np.uint8) for _ in range(bits)]
    for a, begins in pieces:
        at = np.flatnonzero(begins) + a
        if not len(at):
            continue
        place = (at >> bits) + np.arange(i, i + len(at))
        places.append(place[-i % SAMPLE :: SAMPLE])
        first = int(place[0]) >> 3
        own = np.zeros(((int(place[-1]) >> 3) - first + 1) * 8, np.uint8)
        own[place - first * 8] = 1
        high[first : first + len(own) // 8] |= np.packbits(own, bitorder="little")
        for k in range(bits):
            plane = np.concatenate([rest[k], (at >> k & 1).astype(np.uint8)])
            whole = len(plane) // 8 * 8
            low[k].append(np.packbits(plane[:whole], bitorder="little").tobytes())
            rest[k] = plane[whole:]
        i += len(at)
    planes = [b"".join([*x, np.packbits(r, bitorder="little").tobytes()]) for x, r in zip(low, rest, strict=True)]
    return n, len(data), bits, high.tobytes(), b"".join(planes), np.concatenate([np.empty(0, np.int64), *places]).astype("<i8").tobytes()


def select(i: int, n: int, size: int, bits: int, high: memoryview, low: memoryview, places: memoryview) -> int:
    """Where code point ``i`` begins; the end for ``i = n``."""
    if i >= n:
        return size
    directory = np.frombuffer(places, "<i8")
    k, left = divmod(i, SAMPLE)
    start = int(directory[k])
    end = int(directory[k + 1]) if k + 1 < len(directory) else len(high) * 8
    own = np.unpackbits(np.frombuffer(high, np.uint8)[start >> 3 : (end + 7) >> 3], bitorder="little")
    ones = np.flatnonzero(own[start & 7 :])
    value = (start + int(ones[left]) - i) << bits
    plane = (n + 7) // 8
    for b in range(bits):
        value |= (low[b * plane + (i >> 3)] >> (i & 7) & 1) << b
    return value


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, text`` to ``part, text, index``, each of them once as far as ``SEEN`` parts can tell."""
    kinds = {"n": pa.int64(), "bytes": pa.int64(), "bits": pa.int32(), "high": pa.binary(), "low": pa.binary(), "places": pa.binary()}
    seen: set[bytes] = set()
    for batch in batches:
        parts, new = batch.column(0).to_pylist(), []
        for i, part in enumerate(parts):
            if part not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(part)
                new.append(i)
        batch = batch.take(pa.array(new, pa.int64()))
        data, at = text_bytes(batch.column(1))
        found = [boundaries(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names=list(kinds))], names=["part", "text", "index"])


def _selected(index: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    n, size, bits, *lists = index.flatten()
    high, low, places = ([memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in c] for c in lists)
    known = list(zip(n.to_pylist(), size.to_pylist(), bits.to_pylist(), high, low, places, strict=True))
    found = [[select(i, *x) for i, x in zip(c.to_pylist(), known, strict=True)] for c in (first, second)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in found], names=["x", "y"])


def _draw(doc_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits that an id draws, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n, form, prefix_chars, middle_chars, output, restored``; ``restored`` is made of output and form alone."""
    spark = docs.sparkSession
    small_batches(spark)
    selected = F.arrow_udf(_selected, "struct<x:int,y:int>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    keys = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    # keys of many documents
    per_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.sum("n")).head()[0] or 0
    share = max(1, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = per_key.filter(F.col("n") > share).select(F.hex("key").alias("key"), F.ceil(F.col("n") / share).alias("splits")).collect()  # fewer than eight for each partition
    part = F.col("key")
    if hot:
        splits = F.create_map(*[x for r in hot for x in (F.lit(r.key), F.lit(r.splits))])[F.hex("key")]
        part = F.when(splits.isNotNull(), F.concat("key", F.pmod(F.xxhash64("doc_id"), splits).cast("string").cast("binary"))).otherwise(part)
    texts = rows.select(part.alias("part"), "text").mapInArrow(_index, f"part binary, text string, index {_INDEX}")
    texts = texts.repartition("part").groupBy("part", "text", "index").agg(F.lit(0).alias("none"))
    found = texts.join(keys.select("doc_id", part.alias("part"), "rows").hint("shuffle_hash"), "part")
    n = F.col("index.n")
    a, b = (_draw(F.col("doc_id"), seed, k) % (n + 1) for k in (1, 2))
    cut_up = found.select("doc_id", "rows", "text", n.alias("n"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), selected("index", F.least(a, b), F.greatest(a, b)).alias("at"))
    data = F.col("text").cast("binary")
    part = lambda start, size: F.substring(data, start, size).cast("string")
    prefix, middle = part(F.lit(1), F.col("at.x")), part(F.col("at.x") + 1, F.col("at.y") - F.col("at.x"))
    suffix = part(F.col("at.y") + 1, F.octet_length("text") - F.col("at.y"))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.col("text").contains(m)
    stays = (F.col("n") == 0) | marked | (_draw(F.col("doc_id"), seed, 3) % 100 >= plain)
    form = F.when(stays, "plain").when(_draw(F.col("doc_id"), seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    p, s, m = map(F.lit, MARKS)
    written = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    out = cut_up.withColumn("form", form).select(
        "doc_id", "rows", "n", "form", F.when(F.col("form") != "plain", F.col("a")).alias("prefix_chars"), F.when(F.col("form") != "plain", F.col("b") - F.col("a")).alias("middle_chars"), written.alias("output")
    )
    return _each_row(out.withColumn("restored", restored(F.col("output"), F.col("form"))), "rows", "row").drop("rows", "row")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. No mark stands in a part, and none arises where parts meet."""
    parts = F.split(output, "|".join(MARKS), -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
