"""Read mapping, junctions, deletions and variant consequences, as joins and grouped expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt, staged, tasks_for
from .joins import kmers, seed_join
from .ordered import islands
from .sequence import binned_depth, mismatches, reference_lookup, reverse_complement, splice_priority, translated


def both_strands(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads as they are and reverse-complemented, with their ``strand``."""
    each = F.array(F.struct(F.lit("+").alias("strand"), F.col(seq).alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col(seq)).alias("s")))
    return reads.withColumn("_e", F.explode(each)).withColumn("strand", F.col("_e.strand")).withColumn(seq, F.col("_e.s")).drop("_e")


def reference_kmers(chunks: DataFrame, k: int) -> DataFrame:
    """``contig, pos, kmer`` of chunks that overlap by ``k - 1`` at least; each place once."""
    each = chunks.select("contig", "offset", F.explode(kmers(F.col("seq"), k)).alias("x"))
    return each.select("contig", (F.col("offset") + F.col("x.at")).alias("pos"), F.col("x.kmer").alias("kmer")).distinct()


def seed_votes(reads: DataFrame, index: DataFrame, k: int, step: int, most: int | None) -> DataFrame:
    """Diagonals on which a read's seeds agree: ``read, strand, contig, diagonal, votes``. Seeds with more than ``most`` places don't vote."""
    each = both_strands(reads).select("read", "strand", F.explode(F.filter(kmers(F.col("seq"), k), lambda x: x.at % step == 0)).alias("x"))
    seeds = each.select("read", "strand", F.col("x.at").alias("at"), F.col("x.kmer").alias("kmer"))
    return seed_join(seeds, index, "kmer", most).groupBy("read", "strand", "contig", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))


def best_placement(votes: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Each read's diagonal with most votes; dropped if the second has more than ``ratio`` of them."""
    w = Window.partitionBy("read").orderBy(F.desc("votes"), "contig", "diagonal", "strand")
    two = votes.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("votes").over(w)).filter("_n = 1")
    return two.filter(F.coalesce(F.col("_next"), F.lit(0)) <= ratio * F.col("votes")).drop("_n", "_next")


def verified(placed: DataFrame, reads: DataFrame, chunks: DataFrame, width: int, most_mismatches: int) -> DataFrame:
    """Placements whose read differs from the reference in few bases; chunks overlap by a read's length."""
    s = both_strands(reads).select("read", "strand", "seq")
    at = placed.join(s, ["read", "strand"]).withColumn("chunk", F.floor(F.col("diagonal") / width).cast("int"))
    ref = chunks.select("contig", "chunk", F.col("offset").alias("_o"), F.col("seq").alias("_ref"))
    both = at.join(ref, ["contig", "chunk"])
    window = F.substring("_ref", (F.col("diagonal") - F.col("_o") + 1).cast("int"), F.length("seq"))
    return both.withColumn("mismatches", mismatches(F.col("seq"), window)).filter(F.col("mismatches") <= most_mismatches).drop("_o", "_ref", "chunk")


def spliced(exons: DataFrame, chunks: DataFrame, width: int, piece: int = 64) -> DataFrame:
    """``transcript, seq, joints`` of candidate transcripts: their exons' bases one after another, and where each exon ends in them.

    ``exons`` has ``transcript, exon`` (its number in order), ``contig, start,
    end`` (from 0, end exclusive). Bases are looked up in pieces of ``piece``,
    by which chunks must overlap at least, so no contig is ever one row.
    """
    pieces = exons.select("transcript", "exon", "contig", "end", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1, F.lit(piece).cast("long"))).alias("at"))
    found = reference_lookup(pieces, chunks, "contig", "at", F.least(F.lit(piece), F.col("end") - F.col("at")).cast("int"), width)
    order = F.array_sort(F.collect_list(F.struct("exon", "at", F.col("reference").alias("s"))))  # pieces of one transcript
    seqs = found.groupBy("transcript").agg(F.array_join(F.transform(order, lambda x: x.s), "").alias("seq"))
    lengths = F.array_sort(F.collect_list(F.struct("exon", (F.col("end") - F.col("start")).cast("long").alias("n"))))
    ends = exons.groupBy("transcript").agg(lengths.alias("_l")).select("transcript", F.aggregate("_l", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x.n))).alias("joints"))
    return seqs.join(ends.hint("merge"), "transcript")


#: Bases beside a seed that are compared where reads and transcripts meet, on each side, and the longest seed.
_FLANK, _LONGEST_SEED = 16, 32


def _seeds(df: DataFrame, at: Column, k: int, *keep: str) -> DataFrame:
    """``keep, at, kmer, left, right``: the seeds of ``seq`` at places, with the bases beside them."""
    each = df.select(*keep, "seq", F.explode(at).alias("at"))
    first = F.greatest(F.col("at") - _FLANK, F.lit(0))
    piece = lambda start, n: F.substring("seq", start + 1, n)
    return each.select(*keep, "at", piece(F.col("at"), F.lit(k)).alias("kmer"), piece(first, F.col("at") - first).alias("left"), piece(F.col("at") + k, F.lit(_FLANK)).alias("right"))


def realigned(reads: DataFrame, transcripts: DataFrame, k: int = 12, step: int = 5, most_mismatches: int = 2) -> DataFrame:
    """Reads laid on candidate transcripts without gaps, also over their joints: ``read, transcript, strand, start, end, mismatches, votes``.

    Transcripts are indexed in spliced positions, so that a seed over two
    exons is found like any other. A read within ``most_mismatches`` has one of
    ``most_mismatches + 1`` parts unchanged, so seeds at the starts of these parts find all its
    places; they are as long as the shortest read's parts, ``k`` at least. Only where a read is too short for
    that, its seeds lie ``step`` bases apart, and a place where none of them agrees is missed. Bases beside
    a seed are compared in the join, so that chance hits end there. ``votes`` are the seeds of length ``k``,
    ``step`` apart, that agree on a start. A read keeps its best place in each
    transcript, by mismatches, votes, start and strand.
    """
    # written and dealt out by their number: both may come of few small rows, by which Spark would plan a few tasks and broadcasts
    reads, transcripts = (dealt(staged(df), key) for df, key in ((reads, "read"), (transcripts, "transcript")))
    parts = most_mismatches + 1
    n = F.length("seq")
    known = reads.agg(F.min(n), F.count(F.lit(1))).head()
    size = max(k, min(_LONGEST_SEED, (known[0] or 0) // parts))
    places = transcripts.agg(F.sum(n)).head()[0] or 0
    tasks = tasks_for(reads.sparkSession, max(places, 2 * parts * known[1]))
    starts = F.when(n >= parts * size, F.transform(F.sequence(F.lit(0), F.lit(most_mismatches)), lambda i: (i * F.floor(n / parts)).cast("int"))).when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step)))
    seeds = _seeds(both_strands(reads), starts, size, "read", "strand").repartition(tasks, "kmer")
    index = _seeds(transcripts, F.when(n >= size, F.sequence(F.lit(0), n - size)), size, "transcript").select("transcript", F.col("at").alias("pos"), "kmer", F.col("left").alias("_l"), F.col("right").alias("_r")).repartition(tasks, "kmer")
    # an edit distance is never above the number of mismatches, and Spark's own stops early: it drops nearly all chance hits before bases are counted
    beside = F.concat(F.expr("right(_l, length(left))"), F.expr("left(_r, length(right))"))
    alike = (F.length("_l") >= F.length("left")) & (F.length("_r") >= F.length("right")) & (F.levenshtein(F.concat("left", "right"), beside, most_mismatches) >= 0)
    met = seeds.join(index.hint("merge"), "kmer").filter(alike)
    few = staged(met.select("read", "strand", "transcript", (F.col("pos") - F.col("at")).alias("start")).distinct())
    laid = few.join(both_strands(reads).select("read", "strand", "seq").hint("merge"), ["read", "strand"]).join(transcripts.select("transcript", F.col("seq").alias("_t")).hint("merge"), "transcript")
    start = F.col("start").cast("long")
    inside = laid.filter((start >= 0) & (start + n <= F.length("_t"))).withColumn("_at", F.substring("_t", (start + 1).cast("int"), n))
    near = inside.filter(F.levenshtein("seq", "_at", most_mismatches) >= 0)
    tested = near.withColumn("mismatches", mismatches(F.col("seq"), F.col("_at"))).filter(F.col("mismatches") <= most_mismatches)
    agree = F.when(n >= k, F.size(F.filter(F.sequence(F.lit(0), n - k, F.lit(step)), lambda i: F.substring("seq", i + 1, F.lit(k)) == F.substring("_at", i + 1, F.lit(k))))).otherwise(0).cast("long")
    best = F.min(F.struct("mismatches", (-agree).alias("v"), start.alias("start"), "strand", (start + n).alias("end"))).alias("_b")
    return tested.groupBy("read", "transcript").agg(best).select("read", "transcript", "_b.strand", "_b.start", "_b.end", "_b.mismatches", (-F.col("_b.v")).alias("votes"))


def exon_support(placed: DataFrame, transcripts: DataFrame, reads: DataFrame, overhang: int, weight: str | None = None) -> DataFrame:
    """Reads for each exon of each candidate: ``transcript, exon, overlap, left, right, both``.

    ``overlap`` counts reads that touch the exon, ``left`` and ``right`` those
    that cross its joints by ``overhang`` bases on both sides, ``both`` those
    that cross both; a transcript's outer ends are no joints and have nulls. Reads count
    ``weight`` times, if given. Exons without reads have zeros.
    """
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    # reads and exons may come of few small rows, by which Spark would plan broadcasts
    rows = placed.join(reads.select("read", n.alias("_w")).hint("merge"), "read")
    bounds = transcripts.select("transcript", F.size("joints").alias("_k"), F.posexplode(F.transform("joints", lambda e, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("joints", i - 1)).alias("a"), e.alias("b")))).alias("_i", "_x"))
    exons = bounds.select("transcript", (F.col("_i") + 1).alias("exon"), F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"), (F.col("_i") > 0).alias("_left"), (F.col("_i") + 1 < F.col("_k")).alias("_right"))
    met = exons.join(rows.hint("merge"), (exons.transcript == rows.transcript) & (F.col("start") < F.col("_b")) & (F.col("end") > F.col("_a")), "left").drop(rows.transcript)
    over = lambda at: F.coalesce((F.col("start") <= F.col(at) - overhang) & (F.col("end") >= F.col(at) + overhang), F.lit(False))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_w"))), F.lit(0).cast("long"))
    sums = met.groupBy("transcript", "exon", "_left", "_right").agg(count(F.col("start").isNotNull()).alias("overlap"), count(over("_a")).alias("_l"), count(over("_b")).alias("_r"), count(over("_a") & over("_b")).alias("_lr"))
    return sums.select("transcript", "exon", "overlap", F.when(F.col("_left"), F.col("_l")).alias("left"), F.when(F.col("_right"), F.col("_r")).alias("right"), F.when(F.col("_left") & F.col("_right"), F.col("_lr")).alias("both"))


def split_reads(reads: DataFrame, left: str, right: str, seq: str, least: int) -> DataFrame:
    """Break points of reads that match the start of a left and the end of a right reference exactly: ``at`` bases come from the left."""
    n = F.length(seq)
    fits = lambda i: (F.substring(left, 1, i) == F.substring(seq, 1, i)) & (F.right(F.col(right), n - i) == F.right(F.col(seq), n - i))
    places = F.when(n >= 2 * least, F.filter(F.sequence(F.lit(least), n - least), fits)).otherwise(F.array().cast("array<int>"))
    return reads.withColumn("at", F.explode(places))


def canonical_junctions(junctions: DataFrame, chunks_at: Column, shift: int = 3) -> DataFrame:
    """Move each junction within ``shift`` bases to where its intron has the best splice motif, if one place alone has it.

    ``chunks_at(start, end)`` is the intron's sequence as a column of ``d``, the shift.
    """
    moved = junctions.withColumn("d", F.explode(F.sequence(F.lit(-shift), F.lit(shift)))).withColumn("_p", splice_priority(chunks_at))
    key = [c for c in junctions.columns]
    best = moved.withColumn("_best", F.min("_p").over(Window.partitionBy(*key))).filter("_p = _best AND _p < 3")
    one = best.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("_n = 1")
    return one.withColumns({"start": F.col("start") + F.col("d"), "end": F.col("end") + F.col("d")}).select(*key, F.col("_p").alias("priority"))


def novel(junctions: DataFrame, known: DataFrame) -> DataFrame:
    """Junctions that no annotated intron has."""
    return junctions.join(known.select("chrom", "start", "end"), ["chrom", "start", "end"], "left_anti")


def introns(exons: DataFrame) -> DataFrame:
    """What lies between a transcript's neighbouring exons."""
    w = Window.partitionBy("transcript").orderBy("start")
    return exons.select("chrom", "transcript", "gene", F.col("end").alias("start"), F.lead("start").over(w).alias("end")).filter("end > start")


def cryptic_exons(junctions: DataFrame, genes: DataFrame, shortest: int = 15, longest: int = 500) -> DataFrame:
    """Pairs of novel junctions within a gene that enclose an exon of plausible length, with most support first.

    ``tied`` counts the pairs that share the best support.
    """
    inside = junctions.alias("j").join(genes.alias("g"), (F.col("j.chrom") == F.col("g.chrom")) & (F.col("j.start") >= F.col("g.start")) & (F.col("j.end") <= F.col("g.end"))).select("g.gene", "j.start", "j.end", "j.reads")
    a = inside.select("gene", F.col("start").alias("left_start"), F.col("end").alias("exon_start"), F.col("reads").alias("r1"))
    b = inside.select("gene", F.col("start").alias("exon_end"), F.col("end").alias("right_end"), F.col("reads").alias("r2"))
    pairs = a.join(b, "gene").filter((F.col("exon_end") - F.col("exon_start")).between(shortest, longest)).withColumn("support", F.least("r1", "r2"))
    w = Window.partitionBy("gene")
    top = pairs.withColumn("_top", F.max("support").over(w))
    tied = F.sum((F.col("support") == F.col("_top")).cast("int")).over(w)
    order = w.orderBy(F.desc("support"), F.desc(F.col("r1") + F.col("r2")), "exon_start", "exon_end")
    return top.withColumn("tied", tied).withColumn("rank", F.row_number().over(order)).drop("_top")


def normalised_depth(reads: DataFrame, mappable: DataFrame, width: int) -> DataFrame:
    """Depth of each bin per mappable base, over the contig's median; bins without mappable bases have none."""
    depth = binned_depth(reads, ["contig"], "start", "end", width)
    both = mappable.join(depth, ["contig", "bin"], "left").withColumn("raw", F.try_divide(F.coalesce(F.col("depth"), F.lit(0)).cast("double"), F.col("mappable").cast("double")))
    middle = both.groupBy("contig").agg(F.median("raw").alias("_m"))
    return both.join(middle, "contig").withColumn("ratio", F.try_divide(F.col("raw"), F.col("_m"))).drop("_m")


def low_runs(depth: DataFrame, width: int, below: float) -> DataFrame:
    """Runs of neighbouring bins whose ratio is below a bound, longest first in each contig."""
    low = depth.filter(F.col("ratio") < below).select("contig", (F.col("bin") / width).cast("long").alias("k"))
    runs = islands(low, ["contig"], "k")
    spans = runs.select("contig", (F.col("island_start") * width).alias("start"), ((F.col("island_end") + 1) * width).alias("end"), "length")
    return spans.withColumn("rank", F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("length"), "start")))


def spanning_pairs(pairs: DataFrame, regular: float = 6.0) -> DataFrame:
    """Inward pairs whose span is more than ``regular`` scaled deviations above the median span."""
    inward = pairs.filter("strand1 = '+' AND strand2 = '-' AND pos2 > pos1").withColumn("span", F.col("pos2") - F.col("pos1"))
    middle = inward.agg(F.median("span").alias("_m"))
    spread = inward.crossJoin(F.broadcast(middle)).agg((F.median(F.abs(F.col("span") - F.col("_m"))) * 1.4826).alias("_s"))
    both = inward.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(spread))  # one row each
    return both.filter(F.col("span") > F.col("_m") + regular * F.greatest(F.col("_s"), F.lit(1.0))).drop("_m", "_s")


def deletions(runs: DataFrame, spanning: DataFrame, slack: int, least: int = 2) -> DataFrame:
    """Low-depth runs that enough spanning pairs bracket, with bounds from the pairs."""
    near = (F.abs(F.col("pos1") - F.col("start")) <= slack) & (F.abs(F.col("pos2") - F.col("end")) <= slack)
    both = runs.join(spanning.select("contig", "pos1", "pos2"), "contig").filter(near)
    calls = both.groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("pairs"), F.max("pos1").alias("left"), F.min("pos2").alias("right"))
    return calls.filter(F.col("pairs") >= least)


def cds_positions(exons: DataFrame) -> DataFrame:
    """Coding exons with the offset of their first base in the spliced CDS, along the strand."""
    forward = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    w = Window.partitionBy("transcript").orderBy(forward).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))


def consequence(variants: DataFrame, coding: DataFrame, sequences: DataFrame) -> DataFrame:
    """Effect of single-base changes on each transcript whose coding exon holds them.

    ``variants``: chrom, pos (from 0), ref, alt. ``coding``: chrom, transcript,
    strand, start, end, offset. ``sequences``: transcript, cds.
    """
    held = variants.join(coding, "chrom").filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).join(sequences, "transcript")
    inside = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    held = held.withColumn("cds_pos", (F.col("offset") + inside).cast("int"))
    base = F.when(F.col("strand") == "-", reverse_complement(F.col("alt"))).otherwise(F.upper("alt"))
    first = (F.col("cds_pos") - F.col("cds_pos") % 3).cast("int")
    codon = F.substring("cds", first + 1, F.lit(3))
    changed = F.overlay(codon, base, (F.col("cds_pos") % 3 + 1).cast("int"))
    held = held.withColumns({"codon": codon, "new_codon": changed}).withColumns({"aa": translated(F.col("codon")), "new_aa": translated(F.col("new_codon"))})
    effect = (
        F.when(F.col("aa") == F.col("new_aa"), "synonymous")
        .when(F.col("new_aa") == "*", "stop_gained")
        .when(F.col("aa") == "*", "stop_lost")
        .when(F.col("cds_pos") < 3, "start_lost")
        .otherwise("missense")
    )
    return held.select("chrom", "pos", "ref", "alt", "transcript", "cds_pos", "aa", "new_aa", effect.alias("effect"))


#: Effects from the most severe on.
SEVERITY = ("stop_gained", "start_lost", "stop_lost", "missense", "synonymous")


def worst_effect(effects: DataFrame, by: Sequence[str] = ("chrom", "pos", "alt")) -> DataFrame:
    """The most severe effect over transcripts; the first transcript of equals."""
    order = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("effect"))
    w = Window.partitionBy(*by).orderBy(order, "transcript")
    return effects.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def promoter_signal(bins: DataFrame, genes: DataFrame, width: int, pad: int, value: str) -> DataFrame:
    """Sum of the bins within ``pad`` of each gene's start; bins that are missing count as none."""
    around = genes.withColumn("bin", F.explode(F.sequence(F.floor((F.col("tss") - pad) / width), F.floor((F.col("tss") + pad) / width)))).withColumn("bin", F.col("bin") * width)
    return around.join(bins, ["chrom", "bin"]).groupBy("gene").agg(F.sum(value).alias("signal"), F.count(F.lit(1)).alias("bins"))


def contig_arms(arms: DataFrame, contigs: DataFrame) -> DataFrame:
    """Place contigs that an arm was cut into on the arm, by running sums of their sizes in order."""
    w = Window.partitionBy("arm").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.join(arms, "arm").withColumn("arm_start", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("arm_end", F.col("arm_start") + F.col("size"))


def extended_segments(reads: DataFrame, reference: str, k: int, schema: str = "read string, at int, pos int, length int") -> DataFrame:
    """Longest exact segments of reads in a short reference, by seed and extension.

    For references of one transcript or window; larger ones go through
    :func:`seed_votes`. Reads are worked on in batches, each on its own.
    """
    places: dict[str, list[int]] = {}
    for i in range(len(reference) - k + 1):
        places.setdefault(reference[i : i + k], []).append(i)

    def extend(batches):
        for batch in batches:
            out = []
            for name, seq in zip(batch["read"], batch["seq"], strict=True):
                best = (0, 0, 0)
                for i in range(0, max(0, len(seq) - k + 1)):
                    for p in places.get(seq[i : i + k], ()):
                        a, n = 0, k
                        while i - a > 0 and p - a > 0 and seq[i - a - 1] == reference[p - a - 1]:
                            a += 1
                        while i + n < len(seq) and p + n < len(reference) and seq[i + n] == reference[p + n]:
                            n += 1
                        best = max(best, (n + a, -(i - a), -(p - a)))
                if best[0]:
                    out.append((name, -best[1], -best[2], best[0]))
            yield pd.DataFrame(out, columns=["read", "at", "pos", "length"])

    return reads.select("read", "seq").mapInPandas(extend, schema)
