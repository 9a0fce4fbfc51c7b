"""Sequence, mapping, variant and junction queries on sequences that are made from driver tables.

Contigs are digests of their numbers in the four letters, so both engines make the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import genome, joins, ordered, sequence, solvers
from ..session import staged
from .registry import Tables, query

_PART = "translate(upper(concat(p_name, p_type)), 'BDEFHIJKLMNOPQRSUVWXYZ -#0123456789', 'ACGTACGTACGTACGTACGTAC')"
#: Bases of a contig's piece, and pieces of a contig.
_WIDE, _PIECES = 32, 40
_PIECE = "translate(md5('{0}' || {1} || '-' || {2}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_CONTIGS = f"SELECT 'c' || r_regionkey AS contig, string_agg({_PIECE.format('g', 'r_regionkey', 'i')}, '' ORDER BY i) AS s FROM region, range({_PIECES}) r(i) GROUP BY r_regionkey"
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"  # fixed values: the standard genetic code in the order T, C, A, G


def _amino(codon: str) -> str:
    """SQL: the amino acid of a codon."""
    return f"substr('{_CODE}', 16 * (strpos('TCAG', substr({codon}, 1, 1)) - 1) + 4 * (strpos('TCAG', substr({codon}, 2, 1)) - 1) + strpos('TCAG', substr({codon}, 3, 1)), 1)"


def _random(name: str, *parts: str) -> str:
    """Spark's form of a digest in the four letters."""
    return f"translate(md5(concat('{name}', {', '.join(parts)})), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _contigs(t: Tables) -> DataFrame:
    pieces = ", ".join(_random("g", "r_regionkey", "'-'", str(i)) for i in range(_PIECES))
    return t.region.select(F.concat(F.lit("c"), "r_regionkey").alias("contig"), F.expr(f"concat({pieces})").alias("s"))


def _parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", F.expr(_PART).alias("s"))


@query(f"""
WITH d AS (SELECT p_partkey, {_PART} AS s FROM part), w AS (SELECT p_partkey, s, unnest(range(0, length(s) - 1)) AS i FROM d),
a AS (SELECT p_partkey, i FROM w WHERE substr(s, i + 1, 2) = 'AC'), b AS (SELECT p_partkey, i FROM w WHERE substr(s, i + 1, 2) = 'TA')
SELECT a.p_partkey, count(*) AS products, CAST(min(b.i + 2 - a.i) AS INTEGER) AS shortest, CAST(max(b.i + 2 - a.i) AS INTEGER) AS longest FROM a JOIN b ON a.p_partkey = b.p_partkey AND b.i >= a.i + 2 GROUP BY 1""")
def pcr_products(t: Tables) -> DataFrame:
    """What a primer pair spans in each sequence."""
    each = _parts(t).select("p_partkey", F.explode(sequence.amplicons(F.col("s"), F.lit("AC"), F.lit("TA"))).alias("a"))
    return each.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("products"), F.min("a.size").alias("shortest"), F.max("a.size").alias("longest"))


@query(f"""
WITH d AS (SELECT p_partkey, {_PART} AS s FROM part)
SELECT p_partkey, list_aggregate(list_transform(range(0, length(s) // 3), lambda i: {_amino('substr(s, 3 * i + 1, 3)')}), 'string_agg', '') AS protein,
  coalesce(list_aggregate(list_filter(range(0, length(s) // 3), lambda i: substr(s, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA')), 'string_agg', ','), '') AS stops FROM d""")
def protein_and_stops(t: Tables) -> DataFrame:
    """Proteins, and the in-frame stops of their codons."""
    s = F.col("s")
    return _parts(t).select("p_partkey", sequence.translated(s).alias("protein"), F.array_join(sequence.inframe_stops(s), ",").alias("stops"))


@query(f"""
WITH d AS (SELECT p_partkey, p_size % 2 = 0 AS inframe, CASE WHEN p_size % 3 = 0 THEN 'C-tag' ELSE 'N-tag' END AS tag, CASE WHEN p_size % 4 = 0 THEN 'ATG' ELSE '' END || {_PART} || CASE WHEN p_size % 5 = 0 THEN 'TAA' ELSE '' END AS s FROM part),
f AS (SELECT *, starts_with(s, 'ATG') AS a, right(s, 3) IN ('TAA', 'TAG', 'TGA') AS z, length(s) % 3 = 0 AND inframe AS w FROM d)
SELECT p_partkey, concat_ws(',', CASE WHEN NOT a THEN 'start_invalid' END, CASE WHEN NOT z THEN 'stop_invalid' END, CASE WHEN NOT w THEN 'frame_invalid' END, CASE WHEN tag = 'C-tag' AND z THEN 'tag_invalid' END) AS issues FROM f""")
def frame_audit(t: Tables) -> DataFrame:
    """Start, stop, reading frame and tag of constructs, and what is wrong with them."""
    size = F.col("p_size")
    s = F.concat(F.when(size % 4 == 0, "ATG").otherwise(""), "s", F.when(size % 5 == 0, "TAA").otherwise(""))
    d = _parts(t).select("p_partkey", s.alias("s"), F.when(size % 3 == 0, "C-tag").otherwise("N-tag").alias("tag"), F.when(size % 2 == 0, "in-frame").otherwise("out").alias("frame"))
    return sequence.orf_audit(d, "s", "tag", "frame").select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query(f"""
WITH d AS (SELECT p_partkey, {_PART} AS s FROM part), w AS (SELECT p_partkey, s, CASE WHEN length(s) >= 6 THEN list_transform(range(0, length(s) - 5), lambda i: hamming(substr(s, i + 1, 6), 'ACGTAC')) END AS h FROM d)
SELECT p_partkey, CAST(list_min(h) AS INTEGER) AS distance, CAST(list_position(h, list_min(h)) - 1 AS INTEGER) AS at, CAST(list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+'), lambda x: length(x))) AS INTEGER) AS homopolymer FROM w""")
def motif_distances(t: Tables) -> DataFrame:
    """The window closest to a motif, and the longest run of one base."""
    near = sequence.nearest_motif(F.col("s"), F.lit("ACGTAC"))
    return _parts(t).select("p_partkey", near.alias("m"), sequence.homopolymer(F.col("s")).alias("homopolymer")).select("p_partkey", "m.distance", "m.at", "homopolymer")


@query(f"""
WITH g AS ({_CONTIGS}), p AS (SELECT contig, s, unnest(range(0, length(s) - 3, 41)) AS q FROM g)
SELECT contig, CAST(q AS BIGINT) AS "at", substr(s, q + 1, 3) AS reference FROM p""")
def reference_bases(t: Tables) -> DataFrame:
    """Reference bases at positions, by chunks of the contigs."""
    g = _contigs(t)
    sites = g.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.length("s").cast("long") - 4, F.lit(41).cast("long"))).alias("at"))
    return sequence.reference_lookup(sites, sequence.chunked(g, "contig", "s", 128, 8), "contig", "at", F.lit(3), 128).select("contig", "at", "reference")


@query(f"""
WITH g AS ({_CONTIGS}), p AS (SELECT contig, s, unnest(range(0, length(s), 17)) AS q FROM g), v AS (SELECT contig, substr(s, q + 1, 1) AS ref, q FROM p),
e AS (SELECT 'a' AS assembly, ref, CASE WHEN q % 5 = 0 THEN 'A' ELSE ref END AS want FROM v UNION ALL SELECT 'b', ref, CASE WHEN q % 2 = 0 THEN 'C' ELSE ref END FROM v)
SELECT assembly, count(*) AS n, count(*) FILTER (ref = want) AS matches, CAST(row_number() OVER (ORDER BY count(*) FILTER (ref = want) / count(*) DESC, assembly) AS INTEGER) AS rank FROM e GROUP BY 1""")
def assembly_match(t: Tables) -> DataFrame:
    """Share of sites whose reference an assembly has, and the best assembly."""
    g = _contigs(t)
    sites = g.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.length("s").cast("long") - 1, F.lit(17).cast("long"))).alias("at"))
    found = sequence.reference_lookup(sites, sequence.chunked(g, "contig", "s", 128, 8), "contig", "at", F.lit(1), 128)
    a = found.select(F.lit("a").alias("assembly"), "reference", F.when(F.col("at") % 5 == 0, "A").otherwise(F.col("reference")).alias("want"))
    b = found.select(F.lit("b").alias("assembly"), "reference", F.when(F.col("at") % 2 == 0, "C").otherwise(F.col("reference")).alias("want"))
    return sequence.match_rate(a.union(b), "assembly", "reference", "want").select("assembly", "n", "matches", "rank")


@query(f"""
WITH g AS ({_CONTIGS}), r AS (SELECT contig, unnest(range(0, length(s) - 50, 37)) AS q FROM g)
SELECT contig || ':' || q AS read, contig, CASE WHEN q % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(q AS BIGINT) AS position, CAST(CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS mismatches FROM r""")
def mapped_reads(t: Tables) -> DataFrame:
    """Reads of both strands, some with a changed base, mapped by seeds that vote and verified."""
    g = _contigs(t)
    read = g.select("contig", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 51, F.lit(37))).alias("at"))
    piece = F.expr("substr(s, at + 1, 50)")
    changed = F.overlay(piece, F.translate(F.substring(piece, 25, 1), "ACGT", "CGTA"), F.lit(25))
    own = F.when(F.col("at") % 3 == 0, changed).otherwise(piece)
    reads = read.select(F.concat_ws(":", "contig", "at").alias("read"), F.when(F.col("at") % 2 == 0, own).otherwise(sequence.reverse_complement(own)).alias("seq"))
    chunks = sequence.chunked(g, "contig", "s", 256, 63)
    placed = genome.best_placement(genome.seed_votes(reads, genome.reference_kmers(chunks, 12), 12, 3, 3), 0.5)
    found = genome.verified(placed, reads, chunks, 256, 2)
    return found.select("read", "contig", "strand", F.col("diagonal").cast("long").alias("position"), "mismatches")


_GENES = f"SELECT s_suppkey AS k, string_agg({_PIECE.format('e', 's_suppkey', 'i')}, '' ORDER BY i) AS s FROM supplier, range(12) r(i) GROUP BY 1"
_SPLICED = "substr(s, 11, 50) || substr(s, 121, 30 + k % 20) || substr(s, 251, 90)"
_CHANGED = "substr(r, 1, 19) || translate(substr(r, 20, 1), 'ACGT', 'CGTA') || substr(r, 21)"


@query(f"""
WITH g AS ({_GENES}), t AS (SELECT k, s, {_SPLICED} AS t FROM g), o AS (SELECT k, t, i AS q, substr(t, i + 1, 40) AS r FROM t, range(0, 120, 7) x(i) UNION ALL SELECT k, t, 1000 + i, substr(s, i + 1, 40) FROM t, range(100, 260, 13) x(i)),
c AS (SELECT k, t, q, CASE WHEN q % 3 = 0 THEN {_CHANGED} ELSE r END AS r, 1 + q % 3 AS n FROM o),
h AS (SELECT k, q, n, i AS a, i + 40 AS b, hamming(substr(t, i + 1, 40), r) AS m FROM c, range(0, 160) x(i) WHERE i + 40 <= length(t)),
p AS (SELECT k, q, n, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k, q ORDER BY m, a) AS z FROM h WHERE m <= 2) WHERE z = 1),
e AS (SELECT k, CAST(unnest([1, 2, 3]) AS INTEGER) AS exon, unnest([0, 50, 80 + k % 20]) AS x, unnest([50, 80 + k % 20, 170 + k % 20]) AS y FROM g),
u AS (SELECT e.k, exon, x, y, a, b, n, coalesce(a <= x - 5 AND b >= x + 5, false) AS l, coalesce(a <= y - 5 AND b >= y + 5, false) AS r FROM e LEFT JOIN p ON e.k = p.k AND a < y AND b > x)
SELECT 'T' || k AS transcript, exon, CAST(coalesce(sum(n), 0) AS BIGINT) AS overlap, CASE WHEN exon > 1 THEN CAST(coalesce(sum(n) FILTER (l), 0) AS BIGINT) END AS "left", CASE WHEN exon < 3 THEN CAST(coalesce(sum(n) FILTER (r), 0) AS BIGINT) END AS "right", CASE WHEN exon = 2 THEN CAST(coalesce(sum(n) FILTER (l AND r), 0) AS BIGINT) END AS "both"
FROM u GROUP BY k, exon""")
def transcript_support(t: Tables) -> DataFrame:
    """Reads laid on candidate transcripts over their joints, counted for exons and joints; the SQL tries every place."""
    pieces = ", ".join(_random("e", "s_suppkey", "'-'", str(i)) for i in range(12))
    g = t.supplier.select(F.concat(F.lit("T"), "s_suppkey").alias("contig"), F.col("s_suppkey").alias("k"), F.expr(f"concat({pieces})").alias("s"))
    bounds = F.array(*[F.struct(F.lit(i).alias("exon"), F.lit(a).cast("long").alias("start"), b.cast("long").alias("end")) for i, (a, b) in enumerate(((10, F.lit(60)), (120, 150 + F.col("k") % 20), (250, F.lit(340))), 1)])
    exons = g.select(F.col("contig").alias("transcript"), "contig", F.explode(bounds).alias("x")).select("transcript", "contig", "x.*")
    transcripts = staged(genome.spliced(exons, sequence.chunked(g, "contig", "s", 128, 64), 128))
    own = g.select("k", F.expr(f"{_SPLICED}").alias("t"), "s")
    cut = lambda c, first, last, step, more: own.select("k", F.col(c).alias("c"), F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("i")).select("k", (F.col("i") + more).alias("q"), F.expr("substr(c, i + 1, 40)").alias("r"))
    reads = cut("t", 0, 119, 7, 0).union(cut("s", 100, 259, 13, 1000))
    r = F.when(F.col("q") % 3 == 0, F.expr(_CHANGED)).otherwise(F.col("r"))
    reads = reads.select(F.concat_ws(":", "k", "q").alias("read"), F.when(F.col("q") % 2 == 0, r).otherwise(sequence.reverse_complement(r)).alias("seq"), (1 + F.col("q") % 3).alias("n"))
    return genome.exon_support(genome.realigned(reads, transcripts), transcripts, reads, 5, "n")


_BASES = "SELECT l_suppkey AS contig, l_linenumber AS pos, substr('ACGT', CAST(l_partkey % 4 AS INTEGER) + 1, 1) AS base, l_returnflag AS strand, l_quantity AS q FROM lineitem"


def _bases(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("contig"), F.col("l_linenumber").alias("pos"), F.expr("substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1)").alias("base"), F.col("l_returnflag").alias("strand"), F.col("l_quantity").alias("q"))


@query(f"SELECT contig, pos, base, strand, count(*) AS n FROM ({_BASES}) WHERE q >= 10 GROUP BY ALL")
def base_pileup(t: Tables) -> DataFrame:
    """Bases by position and strand above a floor of quality."""
    return sequence.pileup(_bases(t), ["contig", "pos"], "base", "strand", "q", 10)


@query(f"""
WITH c AS (SELECT contig, pos, base, count(*) AS n FROM ({_BASES}) WHERE q >= 10 GROUP BY ALL), d AS (SELECT contig, pos, sum(n) AS depth FROM c GROUP BY ALL),
a AS (SELECT contig, pos, base AS alt, n AS alt_n, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, base) AS k FROM c WHERE base <> 'A')
SELECT contig, pos, CAST(depth AS BIGINT) AS depth, alt, CAST(coalesce(alt_n, 0) AS BIGINT) AS alt_n, round(coalesce(alt_n, 0) / depth, 6) AS af FROM d LEFT JOIN (SELECT * FROM a WHERE k = 1) USING (contig, pos)""")
def alternate_bases(t: Tables) -> DataFrame:
    """The most frequent other base of each position and its share."""
    counts = _bases(t).filter("q >= 10").groupBy("contig", "pos", "base").agg(F.count(F.lit(1)).alias("n")).withColumn("ref", F.lit("A"))
    return sequence.alternate(counts, ["contig", "pos"], "base", "ref").select("contig", "pos", "depth", "alt", "alt_n", F.round("af", 6).alias("af"))


_TAIL = "list_sum(list_transform(range({0}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({1}) + (n - i) * ln(1 - {1}))))"


@query(f"""
WITH v AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_partkey % 4 = 1) AS k FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, k, round(least(1.0, {_TAIL.format('k', '0.25')}), 7) AS p FROM v""")
def mosaic_tails(t: Tables) -> DataFrame:
    """Binomial tails of counts of a base."""
    v = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_partkey") % 4 == 1).alias("k"))
    return solvers.binomial(v, "k", "n", 0.25).select("l_suppkey", "n", "k", F.round("p", 7).alias("p"))


@query("""
WITH v AS (SELECT DISTINCT l_orderkey AS o, l_suppkey % 20 AS c FROM lineitem)
SELECT x.c AS a, y.c AS b, count(*) AS reads FROM v x JOIN v y ON x.o = y.o AND x.c < y.c GROUP BY 1, 2""")
def allele_cooccurrence(t: Tables) -> DataFrame:
    """How many reads carry both of two candidates."""
    return sequence.cooccurrence(t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 20).alias("c")), "l_orderkey", "c")


_TX = f"""
x AS (SELECT r_regionkey AS r, 'T' || r_regionkey AS transcript, CASE WHEN r_regionkey % 2 = 0 THEN '+' ELSE '-' END AS strand, {_PIECE.format('t', 'r_regionkey', "'a'")} || left({_PIECE.format('t', 'r_regionkey', "'b'")}, 28) AS cds FROM region),
v AS (SELECT r, transcript, strand, cds, i, CASE WHEN i < 30 THEN 100 + i ELSE 200 + i - 30 END AS pos FROM x, range(60) t(i)),
w AS (SELECT *, CASE WHEN strand = '+' THEN i ELSE 59 - i END AS q FROM v), b AS (SELECT *, translate(substr(cds, q + 1, 1), 'ACGT', 'CGTA') AS nb, q - q % 3 AS f FROM w),
c AS (SELECT *, substr(cds, f + 1, 3) AS codon, substr(cds, f + 1, q - f) || nb || substr(cds, q + 2, f + 2 - q) AS changed FROM b)"""


@query(f"""
WITH {_TX.strip()}, e AS (SELECT *, {_amino('codon')} AS aa, {_amino('changed')} AS na FROM c)
SELECT transcript, CAST(pos AS BIGINT) AS pos, CAST(q AS INTEGER) AS cds_pos, aa, na AS new_aa, CASE WHEN aa = na THEN 'synonymous' WHEN na = '*' THEN 'stop_gained' WHEN aa = '*' THEN 'stop_lost' WHEN q < 3 THEN 'start_lost' ELSE 'missense' END AS effect FROM e""")
def coding_effects(t: Tables) -> DataFrame:
    """Effects of single-base changes on transcripts of both strands."""
    r = F.col("r_regionkey")
    tx = t.region.select(F.concat(F.lit("T"), r).alias("transcript"), F.concat(F.lit("c"), r).alias("chrom"), F.when(r % 2 == 0, "+").otherwise("-").alias("strand"), F.expr(f"concat({_random('t', 'r_regionkey', chr(39) + '-a' + chr(39))}, left({_random('t', 'r_regionkey', chr(39) + '-b' + chr(39))}, 28))").alias("cds"))
    exons = tx.select("chrom", "transcript", "strand", F.explode(F.expr("array(named_struct('start', 100L, 'end', 130L), named_struct('start', 200L, 'end', 230L))")).alias("e")).select("chrom", "transcript", "strand", "e.start", "e.end")
    each = tx.select("chrom", "strand", "cds", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    at = F.when(F.col("strand") == "+", F.col("i")).otherwise(59 - F.col("i"))
    base = F.substring("cds", at + 1, F.lit(1))
    new = F.translate(base, "ACGT", "CGTA")
    forward = F.when(F.col("strand") == "+", new).otherwise(sequence.reverse_complement(new))
    pos = F.when(F.col("i") < 30, 100 + F.col("i")).otherwise(170 + F.col("i")).cast("long")
    variants = each.select("chrom", pos.alias("pos"), base.alias("ref"), forward.alias("alt"))
    found = genome.consequence(variants, genome.cds_positions(exons), tx.select("transcript", "cds"))
    return genome.worst_effect(found, ("chrom", "pos", "alt", "transcript")).select("transcript", "pos", "cds_pos", "aa", "new_aa", "effect")


@query(f"""
WITH s AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'GT' WHEN 1 THEN 'GC' WHEN 2 THEN 'AT' ELSE 'TT' END || {_PIECE.format('s', 'n_nationkey', "'x'")} || CASE WHEN n_nationkey % 4 = 2 THEN 'AC' ELSE 'AG' END AS q FROM nation)
SELECT n_nationkey, CAST(CASE left(q, 2) || right(q, 2) WHEN 'GTAG' THEN 0 WHEN 'GCAG' THEN 1 WHEN 'ATAC' THEN 2 ELSE 3 END AS INTEGER) AS priority FROM s""")
def splice_motifs(t: Tables) -> DataFrame:
    """Which splice motif an intron has."""
    k = F.col("n_nationkey") % 4
    seq = F.concat(F.when(k == 0, "GT").when(k == 1, "GC").when(k == 2, "AT").otherwise("TT"), F.expr(_random("s", "n_nationkey", "'-x'")), F.when(k == 2, "AC").otherwise("AG"))
    return t.nation.select("n_nationkey", sequence.splice_priority(seq).alias("priority"))


_JUNCTIONS = f"""
g AS ({_CONTIGS}), j AS (SELECT contig, s, CAST(a AS BIGINT) AS a, CAST(a + 60 AS BIGINT) AS b FROM (SELECT contig, s, unnest(range(20, 1200, 23)) AS a FROM g)),
m AS (SELECT *, d, substr(s, a + d + 1, 60) AS q FROM j, range(-3, 4) t(d)), p AS (SELECT *, CASE left(q, 2) || right(q, 2) WHEN 'GTAG' THEN 0 WHEN 'GCAG' THEN 1 WHEN 'ATAC' THEN 2 ELSE 3 END AS p FROM m)"""


@query(f"""
WITH {_JUNCTIONS.strip()}, k AS (SELECT contig, a, b, min(p) AS best FROM p GROUP BY ALL), o AS (SELECT p.contig, p.a, p.b, min(d) AS d, min(p) AS pr FROM p JOIN k ON p.contig = k.contig AND p.a = k.a AND p = best AND p < 3 GROUP BY ALL HAVING count(*) = 1)
SELECT contig AS chrom, a + d AS "start", b + d AS "end", CAST(pr AS INTEGER) AS priority FROM o""")
def canonical_introns(t: Tables) -> DataFrame:
    """Junctions moved to the one best splice motif near by."""
    each = _contigs(t).select(F.col("contig").alias("chrom"), "s", F.explode(F.sequence(F.lit(20).cast("long"), F.lit(1199).cast("long"), F.lit(23).cast("long"))).alias("start"))
    junctions = each.select("chrom", "start", (F.col("start") + 60).alias("end"), "s")
    found = genome.canonical_junctions(junctions, F.expr("substr(s, CAST(start + d + 1 AS INT), 60)"))
    return found.select("chrom", "start", "end", "priority")


_SEEN = """
x AS (SELECT 'c' || r_regionkey AS chrom, 'G' || r_regionkey AS gene, r_regionkey AS r FROM region),
seen AS (SELECT chrom, 100 AS a, 1000 AS b, 50 AS n FROM x UNION ALL SELECT chrom, 100, 400 + r, 9 FROM x UNION ALL SELECT chrom, 450 + 2 * r, 1000, 7 + r FROM x UNION ALL SELECT chrom, 480, 1000, 3 FROM x UNION ALL SELECT chrom, 1100, 2000, 20 FROM x),
known AS (SELECT chrom, 100 AS a, 1000 AS b FROM x UNION ALL SELECT chrom, 1100, 2000 FROM x)"""


@query(f"""
WITH {_SEEN.strip()}, new AS (SELECT gene, a, b, n FROM seen JOIN x USING (chrom) WHERE (chrom, a, b) NOT IN (SELECT chrom, a, b FROM known)),
p AS (SELECT l.gene, l.b AS s, r.a AS e, least(l.n, r.n) AS support, l.n + r.n AS both_n FROM new l JOIN new r ON l.gene = r.gene AND r.a - l.b BETWEEN 15 AND 500)
SELECT gene, CAST(s AS BIGINT) AS exon_start, CAST(e AS BIGINT) AS exon_end, CAST(support AS INTEGER) AS support, CAST(row_number() OVER (PARTITION BY gene ORDER BY support DESC, both_n DESC, s, e) AS INTEGER) AS rank FROM p""")
def cryptic_exons(t: Tables) -> DataFrame:
    """Exons that pairs of novel junctions enclose, best support first."""
    r = F.col("r_regionkey")
    row = lambda a, b, n: F.struct(F.lit(a).cast("long").alias("start") if isinstance(a, int) else a.cast("long").alias("start"), F.lit(b).cast("long").alias("end") if isinstance(b, int) else b.cast("long").alias("end"), (F.lit(n) if isinstance(n, int) else n).cast("int").alias("reads"))
    base = t.region.select(F.concat(F.lit("c"), r).alias("chrom"), F.concat(F.lit("G"), r).alias("gene"), "r_regionkey")
    seen = base.select("chrom", F.explode(F.array(row(100, 1000, 50), row(100, 400 + r, 9), row(450 + 2 * r, 1000, 7 + r), row(480, 1000, 3), row(1100, 2000, 20))).alias("j")).select("chrom", "j.*")
    exons = base.select("chrom", F.col("gene").alias("transcript"), "gene", F.explode(F.expr("array(named_struct('start', 0L, 'end', 100L), named_struct('start', 1000L, 'end', 1100L), named_struct('start', 2000L, 'end', 2100L))")).alias("e")).select("chrom", "transcript", "gene", "e.*")
    genes = base.select("chrom", "gene", F.lit(0).cast("long").alias("start"), F.lit(2100).cast("long").alias("end"))
    return genome.cryptic_exons(genome.novel(seen, genome.introns(exons)), genes).select("gene", "exon_start", "exon_end", "support", "rank")


#: Reads of all lines; in some stretches of each contig four of five are moved on, which leaves dips.
_READS = "SELECT contig, s, s + 60 AS e FROM (SELECT contig, CASE WHEN x // 300 % 13 = 2 * contig AND l_partkey % 5 <> 0 THEN (x + 600) % 20000 ELSE x END AS s FROM (SELECT CAST(l_suppkey % 5 AS BIGINT) AS contig, CAST(l_extendedprice AS BIGINT) % 20000 AS x, l_partkey FROM lineitem))"


@query(f"""
WITH v AS ({_READS}), b AS (SELECT contig, s, e, unnest(range(s // 100, (e - 1) // 100 + 1)) * 100 AS bin FROM v), d AS (SELECT contig, bin, sum(least(e, bin + 100) - greatest(s, bin)) AS depth FROM b GROUP BY ALL),
m AS (SELECT c AS contig, k * 100 AS bin FROM range(5) x(c), range(200) y(k)), r AS (SELECT contig, bin, coalesce(depth, 0) / 80.0 AS raw FROM m LEFT JOIN d USING (contig, bin)), q AS (SELECT *, raw / median(raw) OVER (PARTITION BY contig) AS ratio FROM r),
l AS (SELECT contig, bin // 100 AS k, bin // 100 - row_number() OVER (PARTITION BY contig ORDER BY bin) AS g FROM q WHERE ratio < 0.4)
SELECT contig, CAST(min(k) * 100 AS BIGINT) AS "start", CAST((max(k) + 1) * 100 AS BIGINT) AS "end", count(*) AS length FROM l GROUP BY contig, g""")
def depth_dips(t: Tables) -> DataFrame:
    """Depth by mappable bases, and all runs of bins below a share of the median."""
    x, contig = F.bround("l_extendedprice").cast("long") % 20000, F.col("l_suppkey") % 5
    at = F.when((F.floor(x / 300) % 13 == 2 * contig) & (F.col("l_partkey") % 5 != 0), (x + 600) % 20000).otherwise(x)
    reads = t.lineitem.select(contig.alias("contig"), at.alias("start"), (at + 60).alias("end"))
    bins = t.spark.range(5).select(F.col("id").alias("contig"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k")).select("contig", (F.col("k") * 100).cast("long").alias("bin"), F.lit(80).alias("mappable"))
    runs = genome.low_runs(genome.normalised_depth(reads, bins, 100), 100, 0.4)
    return runs.select("contig", "start", "end", "length")


_PAIRS = """
p AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS contig, CASE WHEN l_orderkey % 50 = 0 THEN 980 + l_linenumber ELSE 100 + l_linenumber * 90 END AS a, CASE WHEN l_orderkey % 50 = 0 THEN 2010 + l_linenumber ELSE 400 + l_linenumber * 90 + l_orderkey % 7 END AS b FROM lineitem),
m AS (SELECT median(b - a) AS m FROM p), d AS (SELECT median(abs(b - a - m)) * 1.4826 AS d FROM p, m), far AS (SELECT contig, a, b FROM p, m, d WHERE b - a > m + 6 * greatest(d, 1.0))"""


@query(f"""
WITH {_PAIRS.strip()} SELECT contig, CAST(1000 AS BIGINT) AS "start", CAST(2000 AS BIGINT) AS "end", count(*) AS pairs, CAST(max(a) AS BIGINT) AS "left", CAST(min(b) AS BIGINT) AS "right" FROM far WHERE abs(a - 1000) <= 150 AND abs(b - 2000) <= 150 GROUP BY contig HAVING count(*) >= 2""")
def deletion_calls(t: Tables) -> DataFrame:
    """Runs of low depth that pairs of unusual span bracket."""
    k, n = F.col("l_orderkey") % 50 == 0, F.col("l_linenumber")
    a = F.when(k, 980 + n).otherwise(100 + n * 90).cast("long")
    b = F.when(k, 2010 + n).otherwise(400 + n * 90 + F.col("l_orderkey") % 7).cast("long")
    pairs = t.lineitem.select((F.col("l_suppkey") % 5).alias("contig"), a.alias("pos1"), b.alias("pos2"), F.lit("+").alias("strand1"), F.lit("-").alias("strand2"))
    runs = t.spark.range(5).select(F.col("id").alias("contig"), F.lit(1000).cast("long").alias("start"), F.lit(2000).cast("long").alias("end"))
    return genome.deletions(runs, genome.spanning_pairs(pairs), 150).select("contig", "start", "end", "pairs", "left", "right")


@query(f"""
WITH d AS (SELECT n_nationkey, 5 + n_nationkey AS k, {_PIECE.format('l', 'n_nationkey', "'x'")} AS l, {_PIECE.format('r', 'n_nationkey', "'x'")} AS r FROM nation),
q AS (SELECT *, substr(l, 1, k) || right(r, 32 - k) AS s FROM d)
SELECT CAST(n_nationkey AS INTEGER) AS read, CAST(unnest(list_filter(range(2, 31), lambda i: substr(l, 1, i) = substr(s, 1, i) AND right(r, 32 - i) = right(s, 32 - i))) AS INTEGER) AS at FROM q""")
def split_points(t: Tables) -> DataFrame:
    """Where reads change from one reference to another."""
    left, right, k = F.expr(_random("l", "n_nationkey", "'-x'")), F.expr(_random("r", "n_nationkey", "'-x'")), 5 + F.col("n_nationkey")
    reads = t.nation.select(F.col("n_nationkey").alias("read"), left.alias("l"), right.alias("r"), F.concat(F.substring(left, F.lit(1), k), F.right(right, 32 - k)).alias("s"))
    return genome.split_reads(reads, "l", "r", "s", 2).select("read", "at")


@query("""
WITH b AS (SELECT CAST(l_suppkey % 3 AS BIGINT) AS chrom, CAST(l_extendedprice AS BIGINT) // 500 * 500 AS bin, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT p_partkey AS gene, CAST(p_size % 3 AS BIGINT) AS chrom, CAST(p_retailprice AS BIGINT) * 20 AS tss FROM part)
SELECT gene, CAST(sum(v) AS DOUBLE) AS signal, count(*) AS bins FROM g JOIN b ON g.chrom = b.chrom AND bin // 500 BETWEEN (tss - 1200) // 500 AND (tss + 1200) // 500 GROUP BY gene""")
def promoter_signal(t: Tables) -> DataFrame:
    """Sums of the bins around gene starts."""
    bins = t.lineitem.groupBy((F.col("l_suppkey") % 3).alias("chrom"), (F.floor(F.bround("l_extendedprice").cast("long") / 500) * 500).alias("bin")).agg(F.sum("l_quantity").alias("v"))
    genes = t.part.select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 3).cast("long").alias("chrom"), (F.bround("p_retailprice").cast("long") * 20).alias("tss"))
    return genome.promoter_signal(bins, genes, 500, 1200, "v")


@query("""
SELECT 'arm' || n_regionkey AS arm, n_name AS contig, CAST(coalesce(sum(n_nationkey + 1) OVER w, 0) AS BIGINT) AS arm_start, CAST(coalesce(sum(n_nationkey + 1) OVER w, 0) + n_nationkey + 1 AS BIGINT) AS arm_end FROM nation
WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def placed_contigs(t: Tables) -> DataFrame:
    """Contigs that an arm was cut into, on the arm."""
    contigs = t.nation.select(F.concat(F.lit("arm"), "n_regionkey").alias("arm"), F.col("n_name").alias("contig"), F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1).cast("long").alias("size"))
    return genome.contig_arms(contigs.select("arm").distinct(), contigs).select("arm", "contig", "arm_start", "arm_end")


@query("""
WITH RECURSIVE p AS (SELECT CAST(l_suppkey AS BIGINT) AS g, CAST(l_extendedprice AS BIGINT) AS x FROM lineitem GROUP BY ALL),
c AS (SELECT g, min(x) AS first, CAST(1 AS BIGINT) AS k FROM p GROUP BY g UNION ALL SELECT g, (SELECT min(x) FROM p WHERE p.g = c.g AND p.x > c.first + 1500) AS first, k + 1 FROM c WHERE (SELECT min(x) FROM p WHERE p.g = c.g AND p.x > c.first + 1500) IS NOT NULL)
SELECT p.g AS contig, p.x AS at, max(c.k) AS cluster, count(DISTINCT c.k) AS opened FROM p JOIN c ON p.g = c.g AND c.first <= p.x GROUP BY 1, 2""")
def scanned_clusters(t: Tables) -> DataFrame:
    """Clusters that a sorted scan opens, each as wide as a bound from its first member."""
    p = t.lineitem.select(F.col("l_suppkey").alias("contig"), F.bround("l_extendedprice").cast("long").alias("at"))
    # lines without a contig or a position belong to no cluster
    found = ordered.greedy_clusters(p.na.drop().distinct(), ["contig"], "at", 1500)
    return found.select("contig", "at", "cluster", F.col("cluster").alias("opened"))


@query("""
WITH k AS (SELECT n_nationkey, n_name AS s FROM nation), w AS (SELECT n_nationkey, s, unnest(range(0, length(s) - 2)) AS i FROM k)
SELECT n_nationkey, CAST(i AS INTEGER) AS at, substr(s, i + 1, 3) AS kmer FROM w""")
def kmer_places(t: Tables) -> DataFrame:
    """All substrings of a length, with their places."""
    return t.nation.select("n_nationkey", F.explode(joins.kmers(F.col("n_name"), 3)).alias("x")).select("n_nationkey", "x.at", "x.kmer")
