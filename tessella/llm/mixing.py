"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; every document of a source is then
due the same fraction of copies, target over source size. Whole copies are
taken as they are. What remains is a probability ``p`` for one more copy, and
pivotal rounding makes it 0 or 1: two sides meet, and mass (``p`` times size,
so words) moves from one to the other, in a direction drawn so that each ``p``
keeps its expectation, until one of them is integral. The other goes on with
the residual. No word of mass is lost on the way.

First, documents of more than a ``LARGE``-th of their source (so fewer than
``LARGE`` of each) meet, from the largest down, the pool of all that are
smaller: what a document gains the pool loses evenly, so the pool keeps one
probability. Then come the leaves of a reduction tree, groups of about ``FAN``
documents of one source, chosen by a hash. In a leaf, too, each document meets
the pool of the smaller ones, so what is left open is one of the smallest. The
open documents of ``FAN`` neighbouring groups then meet one another and leave
one open, and so on until a source has one, which is drawn; this is all by which
a source can miss its target. Every level is one grouped aggregation, so a
source of a third of the corpus is as many groups as its size needs. Draws are
hashes of rows, so reruns agree.

A document that outweighs all smaller ones of its source can stay open to the
end. Then the miss is as large as what its drawing changes.

Everything is DataFrame operations. Sources are ranked by a range-partitioned
sort and prefix sums over partitions, targets found by a loop over sums.

Cases: a null source is a source of its own, ranked last; null and empty texts
have size zero and take nothing; repeated and null ids are separate rows, told
apart by a hash of all columns and, where that is equal, by a number, so they
spread over leaves as others do; an empty table gives no rows. Extra columns
count only in that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents that a leaf has on average, and children of an inner node.
FAN = 32
#: A document of more than this part of its source meets the pool of all others first.
LARGE = 64
#: Rows that are made at once from a count.
BLOCK = 4096
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MOST = 3.0


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, name: str = "source") -> DataFrame:
    """Add ``rank``, from 0, in code point order with null last, without one task sorting all."""
    dealt = cut(sources.repartitionByRange(F.col(name).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    per = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    before = per.alias("x").join(per.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.own"), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col(name).asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(before, "part").select(*sources.columns, (F.col("before") + F.col("inside") - 1).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Add ``target`` to ``source, source_size``.

    All sizes are shared by weight; a target that would pass ``most`` times
    its source's size stops there and the excess is shared again.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked(sizes).withColumn("weight", w))
    cap = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).head()[0] or 0
    # Level l gives min(l * weight, cap). Each round pours what capped sources leave over the rest.
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        taken, free, n = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).head()
        if n == capped or not free:
            break
        level, capped = (total - taken) / free, n
    pour = F.lit(0.0) if level is None else F.col("weight") * level
    return table.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(pour, cap)))


_DOC = "struct<size:bigint,h:bigint,doc:struct<id:bigint,source:string,source_size:bigint,target:double,whole:int,key:bigint,rows:bigint>,p:double>"


def _with(name: str, p: str) -> str:
    """SQL: the document ``name`` with probability ``p``."""
    return f"struct({name}.size AS size, {name}.h AS h, {name}.doc AS doc, {p} AS p)"


def _draw(*values: str | int) -> str:
    """SQL: a number from [0, 1) that depends on these values alone."""
    return f"(shiftrightunsigned(xxhash64({', '.join(map(str, values))}), 11) / 9007199254740992D)"


def _pool(seed: int, rest: str) -> str:
    """SQL that folds the documents ``docs``, from the largest down, all of one probability, into ``done``, ``o`` and ``q``.

    Each document is paired with the pool of all that are smaller, which hold
    ``rest`` words with it and share the probability ``q``. ``up`` words may
    move to the document, ``down`` words to the pool; either makes one of both
    integral. ``o`` is the document that is left open, if any, and ``q`` what
    the rest of the pool beyond ``docs`` has come to.
    """
    said = "struct(v.q AS q, v.s AS rest, v.o AS o, v.done AS done)"
    moves = "struct(least((1 - a.q) * x.size, a.q * (a.rest - x.size)) AS up, least(a.q * x.size, (1 - a.q) * (a.rest - x.size)) AS down, a.rest - x.size AS s)"
    state = lambda q, o, done: f"struct({q} AS q, m.s AS s, {o} AS o, {done} AS done)"
    more = lambda p: f"concat(a.done, array({_with('x', p)}))"
    return f"""
aggregate(docs, struct(docs[0].p AS q, CAST({rest} AS double) AS rest, CAST(null AS {_DOC}) AS o, CAST(array() AS array<{_DOC}>) AS done), (a, x) ->
  CASE WHEN x.size = 0 OR a.q <= 0 OR a.q >= 1 THEN struct(a.q AS q, a.rest - x.size AS rest, a.o AS o, {more("CASE WHEN a.q >= 1 AND x.size > 0 THEN 1D ELSE 0D END")} AS done)
  WHEN a.rest <= x.size THEN struct(0D AS q, 0D AS rest, {_with("x", "a.q")} AS o, a.done AS done)
  ELSE transform(transform(array({moves}), m ->
    CASE WHEN {_draw("x.h", seed, "'pool'")} * (m.up + m.down) < m.down THEN
      CASE WHEN m.up >= (1 - a.q) * x.size THEN {state("greatest(0D, a.q - m.up / m.s)", "a.o", more("1D"))}
      ELSE {state("0D", _with("x", "least(1D, a.q + m.up / x.size)"), "a.done")} END
    WHEN m.down >= a.q * x.size THEN {state("least(1D, a.q + m.down / m.s)", "a.o", more("0D"))}
    ELSE {state("1D", _with("x", "greatest(0D, a.q - m.down / x.size)"), "a.done")} END), v -> {said})[0] END)"""


def _pivot(level: int, seed: int) -> str:
    """SQL that folds the documents ``docs`` of a group into ``done``, the decided ones, and ``o``, the open one.

    Of the open document and the next, ``mo`` and ``mx`` are the masses in
    words, ``ro`` and ``rx`` the room above them. ``up`` may move to the next,
    ``down`` to the open one; either makes one of both integral.
    """
    to_next = f"""CASE WHEN v.mo <= v.rx
        THEN struct({_with("x", "least(1D, (v.mx + v.up) / x.size)")} AS o, concat(a.done, array({_with("a.o", "0D")})) AS done)
        ELSE struct({_with("a.o", "greatest(0D, (v.mo - v.up) / a.o.size)")} AS o, concat(a.done, array({_with("x", "1D")})) AS done) END"""
    to_open = f"""CASE WHEN v.mx <= v.ro
        THEN struct({_with("a.o", "least(1D, (v.mo + v.down) / a.o.size)")} AS o, concat(a.done, array({_with("x", "0D")})) AS done)
        ELSE struct({_with("x", "greatest(0D, (v.mx - v.down) / x.size)")} AS o, concat(a.done, array({_with("a.o", "1D")})) AS done) END"""
    masses = "a.o.p * a.o.size AS mo, x.p * x.size AS mx, (1 - a.o.p) * a.o.size AS ro, (1 - x.p) * x.size AS rx"
    moves = "m.mo AS mo, m.mx AS mx, m.ro AS ro, m.rx AS rx, least(m.mo, m.rx) AS up, least(m.mx, m.ro) AS down"
    return f"""
aggregate(docs, struct(CAST(null AS {_DOC}) AS o, CAST(array() AS array<{_DOC}>) AS done), (a, x) ->
  CASE WHEN x.p <= 0 OR x.p >= 1 OR x.size = 0 THEN struct(a.o AS o, concat(a.done, array({_with("x", "x.p")})) AS done)
  WHEN a.o IS NULL THEN struct({_with("x", "x.p")} AS o, a.done AS done)
  ELSE transform(transform(array(struct({masses})), m -> struct({moves})), v ->
    CASE WHEN {_draw("a.o.h", "x.h", level, seed)} * (v.up + v.down) < v.down THEN {to_next} ELSE {to_open} END)[0] END)"""


def _rounded(seed: int) -> str:
    """SQL: ``f`` with its open document, the last of its source, rounded."""
    last = _with("f.o", f"CASE WHEN {_draw('f.o.h', seed, chr(39) + 'last' + chr(39))} < f.o.p THEN 1D ELSE 0D END")
    return f"CASE WHEN f.o IS NULL THEN f.done ELSE concat(f.done, array({last})) END"


def _each_row(groups: DataFrame, n: str, ordinal: str) -> DataFrame:
    """Each row of ``groups`` as often as its column ``n`` says, numbered from 0, without an array of ``n`` elements."""
    block = F.lit(BLOCK).cast("long")
    blocked = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, block)))
    own = F.sequence(F.col("_block"), F.least(F.col(n), F.col("_block") + block) - 1)
    return blocked.withColumn(ordinal, F.explode(own)).drop("_block")


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken``, and ``key, rows``.

    Rows equal in id and ``key``, a hash of all columns, are interchangeable;
    ``rows`` tells how many there are.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _row_key(docs).alias("key"))
    groups = cut(own.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows")))
    per = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    goal = cut(targets(per, weights, most).select(F.col("source").alias("name"), "source_size", "target", "n"))
    most_docs = goal.agg(F.max("n")).head()[0] or 0
    # a source has FAN ** depth leaves, with the depth that its own number of documents needs
    depth = 0
    while 2 * FAN ** (depth + 1) < most_docs:
        depth += 1
    own_depth = sum((F.when(F.col("n") > 2 * FAN ** (k + 1), 1).otherwise(0) for k in range(depth)), F.lit(0))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64(F.lit(seed), "id", "key", "k")
    rows = _each_row(groups.join(goal, F.col("source").eqNullSafe(F.col("name"))), "rows", "k").select(
        "size",
        h.alias("h"),
        F.struct("id", "source", "source_size", "target", F.floor(each).cast("int").alias("whole"), "key", "rows").alias("doc"),
        (each - F.floor(each)).alias("p"),
        own_depth.alias("left"),
        F.pmod(h, F.pow(F.lit(float(FAN)), own_depth).cast("long")).alias("node"),
    )
    collected = F.sort_array(F.collect_list(F.struct("size", "h", "doc", "p")), asc=False).alias("docs")
    # documents that outweigh a leaf are paired with all the rest of their source first; a source has fewer than LARGE
    large = F.col("size") * LARGE > F.col("doc.source_size")
    first = rows.filter(large).groupBy(F.col("doc.source").alias("s")).agg(collected)
    first = cut(first.select("s", F.expr(_pool(seed, "docs[0].doc.source_size")).alias("f")).select("s", F.expr(_rounded(seed)).alias("done"), "f.q"))
    decided = [first.select(F.explode("done").alias("d")).select("d.*")]
    rest = rows.filter(~large).join(first.select(F.col("s"), "q", F.lit(True).alias("met")), F.col("doc.source").eqNullSafe(F.col("s")), "left")
    open_docs = rest.select("size", "h", "doc", F.when(F.col("met"), F.col("q")).otherwise(F.col("p")).alias("p"), "left", "node")
    for level in range(depth + 1):
        folded = open_docs.groupBy(F.col("doc.source").alias("s"), "node", "left").agg(collected)
        fold = F.expr(_pivot(level, seed) if level else _pool(seed, "aggregate(docs, 0D, (s, x) -> s + x.size)"))
        folded = folded.select("node", "left", fold.alias("f"))
        done = F.when(F.col("left") == 0, F.expr(_rounded(seed))).otherwise(F.col("f.done"))
        folded = cut(folded.select("node", "left", F.when(F.col("left") > 0, F.col("f.o")).alias("o"), done.alias("done")))
        decided.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        # a group none of whose documents stays open hands nothing on
        open_docs = folded.filter("o IS NOT NULL").select("o.*", (F.col("left") - 1).alias("left"), F.floor(F.col("node") / FAN).alias("node"))
    out = decided[0]
    for x in decided[1:]:
        out = out.union(x)
    copies = F.col("doc.whole") + F.when(F.col("p") >= 1, 1).otherwise(0)
    return out.select(
        F.col("doc.id").alias("doc_id"), F.col("doc.source").alias("source"), "size", F.col("doc.source_size").alias("source_size"), F.col("doc.target").alias("target"),
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.col("doc.key").alias("key"), F.col("doc.rows").alias("rows"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as :func:`mix` takes it.

    Rows equal in all columns are interchangeable: their copies are made from
    one of them.
    """
    taken = mix(docs, **options).groupBy(F.col("key").alias("mix_key"), F.col("doc_id").alias("mix_id"), F.col("rows").alias("mix_rows"))
    copies = cut(taken.agg(F.sum("copies").alias("n")).filter("n > 0"))
    # whole rows travel in one column, so that no name of theirs can clash
    keyed = docs.select(_row_key(docs).alias("own"), F.col(options.get("id_col", "doc_id")).cast("long").alias("own_id"), F.struct("*").alias("row"))
    same = (F.col("own") == F.col("mix_key")) & F.col("own_id").eqNullSafe(F.col("mix_id"))
    once = keyed.join(copies.filter("mix_rows = 1"), same)
    often = keyed.join(copies.filter("mix_rows > 1"), same).dropDuplicates(["own", "own_id"])
    return _each_row(once.select("row", "n").union(often.select("row", "n")), "n", "k").select("row.*")
