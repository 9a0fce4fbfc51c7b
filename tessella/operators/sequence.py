"""Sequence and genomic operators, as expressions and joins.

Positions are from 0 and intervals half-open unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The standard genetic code in the order T, C, A, G of each base.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
STOPS = ("TAA", "TAG", "TGA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))


def occurrences(seq: Column, motif: Column) -> Column:
    """Places of all occurrences, also overlapping ones; none for an empty motif."""
    n = F.length(seq) - F.length(motif)
    places = F.when((n >= 0) & (F.length(motif) > 0), F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(seq, i + 1, F.length(motif)) == motif)


def amplicons(seq: Column, forward: Column, reverse: Column) -> Column:
    """In-silico PCR: start, end and size of what a primer pair spans, for all places of both."""
    back = reverse_complement(reverse)
    lefts, rights = occurrences(seq, forward), occurrences(seq, back)
    each = F.transform(
        lefts,
        lambda i: F.transform(
            F.filter(rights, lambda j: j >= i + F.length(forward)),
            lambda j: F.struct(i.alias("start"), (j + F.length(back)).alias("end"), (j + F.length(back) - i).alias("size")),
        ),
    )
    return F.flatten(each)


def is_dna(seq: Column, length: int | None = None) -> Column:
    return seq.rlike(f"^[ACGT]{{{length}}}$" if length else "^[ACGT]+$")


def codons(seq: Column) -> Column:
    """Whole codons from the start; what is left over is dropped."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.upper(seq), i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translated(seq: Column) -> Column:
    """Protein of a coding sequence; codons with unknown bases are X."""
    code = F.create_map(*[F.lit(x) for c, a in zip(CODONS, AMINO, strict=True) for x in (c, a)])
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.element_at(code, c), F.lit("X"))), "")


def inframe_stops(seq: Column) -> Column:
    """Numbers, from 0, of the codons that are stops."""
    return F.filter(F.transform(codons(seq), lambda c, i: F.when(c.isin(*STOPS), i)), lambda i: i.isNotNull())


def orf_audit(df: DataFrame, seq: str, tag: str, frame: str) -> DataFrame:
    """Whether a construct starts, ends, is in frame and can be tagged, and the list of what is wrong."""
    s = F.upper(F.col(seq))
    start, stop = s.startswith("ATG"), F.right(s, F.lit(3)).isin(*STOPS)
    whole = F.length(s) % 3 == 0
    claimed = F.lower(frame).isin("in-frame", "in_frame", "yes", "true", "in frame", "inframe")
    tagged = F.when(F.lower(tag).startswith("c"), ~stop).otherwise(F.lit(True))
    out = df.withColumns({"start_ok": start, "stop_ok": stop, "frame_ok": whole & claimed, "tag_ok": tagged})
    issues = F.array_compact(F.array(*[F.when(~F.col(f"{k}_ok"), F.lit(f"{k}_invalid")) for k in ("start", "stop", "frame", "tag")]))
    return out.withColumn("issues", issues)


def bounds_ok(start: Column, end: Column, length: Column) -> Column:
    """Whether 1-based inclusive bounds lie within a sequence."""
    return F.coalesce((start >= 1) & (start <= end) & (end <= length), F.lit(False))


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance; null if the lengths differ."""
    places = F.sequence(F.lit(1), F.length(a))
    n = F.aggregate(places, F.lit(0), lambda s, i: s + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(F.length(a) != F.length(b), None).when(F.length(a) == 0, 0).otherwise(n)


def nearest_motif(seq: Column, motif: Column) -> Column:
    """Place and distance of the window closest to a motif; the first of equals."""
    n = F.length(seq) - F.length(motif)
    windows = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    each = F.transform(windows, lambda i: F.struct(mismatches(F.substring(seq, i + 1, F.length(motif)), motif).alias("distance"), i.alias("at")))
    return F.array_min(each)


def homopolymer(seq: Column) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def cigar(text: Column) -> Column:
    """Operations of a CIGAR string as structs ``size, op``."""
    sizes = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(sizes, ops, lambda n, o: F.struct(n.cast("int").alias("size"), o.alias("op")))


def reference_span(text: Column) -> Column:
    """Reference bases that an alignment covers."""
    return F.aggregate(cigar(text), F.lit(0), lambda s, x: s + F.when(x.op.isin("M", "D", "N", "=", "X"), x["size"]).otherwise(0))


def base_at(seq: Column, text: Column, start: Column, position: Column) -> Column:
    """The read's base over a reference position; null in deletions, skips and outside."""
    zero = F.struct(start.cast("int").alias("r"), F.lit(0).alias("q"), F.lit(None).cast("string").alias("base"))

    def step(a: Column, x: Column) -> Column:
        on_ref, on_read = x.op.isin("M", "D", "N", "=", "X"), x.op.isin("M", "I", "S", "=", "X")
        here = on_ref & on_read & (position >= a.r) & (position < a.r + x["size"])
        base = F.when(here, F.substring(seq, (a.q + position - a.r + 1).cast("int"), F.lit(1))).otherwise(a.base)
        r = a.r + F.when(on_ref, x["size"]).otherwise(0)
        q = a.q + F.when(on_read, x["size"]).otherwise(0)
        return F.struct(r.cast("int").alias("r"), q.cast("int").alias("q"), base.alias("base"))

    return F.aggregate(cigar(text), zero, step, lambda a: a.base)


def tss(start: Column, end: Column, strand: Column) -> Column:
    """Transcription start of a gene with half-open bounds."""
    return F.when(strand.cast("string").isin("-", "-1"), end - 1).otherwise(start)


def promoter_bins(df: DataFrame, at: str, width: int, radius: int) -> DataFrame:
    """The bins within ``radius`` bins of a position."""
    middle = F.floor(F.col(at) / width)
    return df.withColumn("bin", F.explode(F.sequence(middle - radius, middle + radius))).withColumn("bin", F.col("bin") * width)


def chunked(df: DataFrame, key: str, seq: str, width: int, overlap: int) -> DataFrame:
    """Long sequences as rows of ``width`` bases and the next ``overlap``: ``key, chunk, offset, seq``."""
    last = F.floor((F.length(seq) - 1) / width).cast("int")
    rows = df.select(key, F.col(seq).alias("_s"), F.explode(F.when(F.length(seq) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * width).cast("long").alias("offset"), F.substring("_s", F.col("chunk") * width + 1, F.lit(width + overlap)).alias("seq"))


def reference_lookup(sites: DataFrame, chunks: DataFrame, key: str, position: str, length: Column, width: int) -> DataFrame:
    """Reference bases at positions: an equi-join on the chunk, then a substring within it.

    Chunks are never broadcast: Spark takes them for as small as the rows that they were cut from.
    """
    placed = sites.withColumn("chunk", F.floor(F.col(position) / width).cast("int"))
    found = placed.join(chunks.hint("merge"), [key, "chunk"], "left")
    return found.withColumn("reference", F.substring("seq", (F.col(position) - F.col("offset") + 1).cast("int"), length)).drop("chunk", "offset", "seq")


def match_rate(df: DataFrame, by: str, got: str, want: str) -> DataFrame:
    """Share of sites that match, by assembly, best first; sites without a reference count for none."""
    seen = df.filter(F.col(got).isNotNull() & (F.col(got) != ""))
    rate = seen.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper(got) == F.upper(want)).alias("matches")).withColumn("rate", F.col("matches") / F.col("n"))
    return rate.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rate"), by)))  # a row for each assembly


def binned_depth(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """Bases covered in each bin."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    cut = df.filter(F.col(end) > F.col(start)).withColumn("bin", F.explode(bins)).withColumn("bin", F.col("bin") * width)
    covered = F.least(F.col(end), F.col("bin") + width) - F.greatest(F.col(start), F.col("bin"))
    return cut.groupBy(*keys, "bin").agg(F.sum(covered).alias("depth"))


def spliced_offsets(exons: DataFrame, transcript: str, start: str, end: str, strand: str) -> DataFrame:
    """Offset of each exon in its spliced transcript, along the strand."""
    forward = F.when(F.col(strand).cast("string").isin("-", "-1"), -F.col(start)).otherwise(F.col(start))
    order = Window.partitionBy(transcript).orderBy(forward).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("offset", F.coalesce(F.sum(F.col(end) - F.col(start)).over(order), F.lit(0)))


def pair_class(strand1: Column, strand2: Column, pos1: Column, pos2: Column, most: int) -> Column:
    """How mates face each other: proper, far apart, or of another orientation."""
    inward = F.when(pos1 <= pos2, (strand1 == "+") & (strand2 == "-")).otherwise((strand2 == "+") & (strand1 == "-"))
    return F.when(~inward, "orientation").when(F.abs(pos1 - pos2) > most, "spanning").otherwise("proper")


def splice_priority(seq: Column) -> Column:
    """0 for an intron GT...AG, 1 for GC...AG, 2 for AT...AC, 3 for others."""
    ends = F.concat(F.left(F.upper(seq), F.lit(2)), F.right(F.upper(seq), F.lit(2)))
    return F.when(ends == "GTAG", 0).when(ends == "GCAG", 1).when(ends == "ATAC", 2).otherwise(3)


def cooccurrence(df: DataFrame, read: str, candidate: str) -> DataFrame:
    """For pairs of candidates, how many reads carry both."""
    a, b = df.select(read, F.col(candidate).alias("a")).distinct(), df.select(read, F.col(candidate).alias("b")).distinct()
    return a.join(b, read).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("reads"))


def pileup(bases: DataFrame, by: Sequence[str], base: str, strand: str, quality: str, least: int) -> DataFrame:
    """Counts of bases by position and strand, with a quality floor."""
    return bases.filter(F.col(quality) >= least).groupBy(*by, base, strand).agg(F.count(F.lit(1)).alias("n"))


def alternate(counts: DataFrame, by: Sequence[str], base: str, reference: str, n: str = "n") -> DataFrame:
    """The most frequent other base of each position, the first by name of equals, and its share of all."""
    total = F.sum(n).alias("depth")
    own = F.max_by(F.col(base), F.when(F.col(base) != F.col(reference), F.struct(F.col(n), -F.ascii(base))))
    high = F.max(F.when(F.col(base) != F.col(reference), F.col(n)))
    return counts.groupBy(*by, reference).agg(total, own.alias("alt"), F.coalesce(high, F.lit(0)).alias("alt_n")).withColumn("af", F.col("alt_n") / F.col("depth"))
