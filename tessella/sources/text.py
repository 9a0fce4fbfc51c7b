"""Readers of text formats, as DataFrame plans over lines.

Every reader has its schema; fields that cannot be read are null. Records that
span lines are put together by line number, which the number of lines in each
split tells, or by the format's own separator. Only small files are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import Running, scan
from ..session import staged


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or something that its pattern matches, is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(list(found)) > 0


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", missing_ok: bool = True, **options: str) -> DataFrame:
    """A table with a header; a byte order mark is dropped, a missing file is an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, sep=sep, header=True, encoding="UTF-8", mode="PERMISSIVE", enforceSchema=True, **options)


def read_bounded(spark: SparkSession, path: str, schema: str, most_bytes: int, most_rows: int) -> DataFrame:
    """A table of a file of bounded size, and at most so many of its rows; a larger file is an error."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).head()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{path} has {size} bytes; the bound is {most_bytes}")
    return read_csv(spark, path, schema).limit(most_rows)


def sniffed_separator(spark: SparkSession, path: str, candidates: str = ",;\t") -> str:
    """The candidate that the first line has most of; the first of equals."""
    line = spark.read.text(path).head()
    return max(candidates, key=lambda c: line[0].count(c)) if line else candidates[0]


def read_sniffed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema, sep=sniffed_separator(spark, path))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True, parts: int = 0) -> DataFrame:
    """Tab-separated text, also gzipped; a gzipped file is one split, so ``parts`` spreads its rows."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=header)
    return df.repartition(parts) if parts else df


def read_json_documents(spark: SparkSession, path: str | list[str], schema: str | StructType, most_bytes: int | None = None) -> DataFrame:
    """One row for each file, with its ``file`` name; unreadable and oversized documents are null."""
    files = spark.read.format("binaryFile").load(path)
    text = files["content"].cast("string")
    ok = F.lit(True) if most_bytes is None else files["length"] <= most_bytes
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.when(ok, F.from_json(text, schema if isinstance(schema, str) else schema.simpleString())).alias("document"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``file, text``."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def read_verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files whose SHA-256 is their manifest's: ``file, content, ok``. The manifest has ``file, sha256``."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return manifest.join(files, "file", "left").select("file", "content", F.coalesce(F.sha2("content", 256) == F.lower("sha256"), F.lit(False)).alias("ok"))


def embedded_json(text: Column, schema: str) -> Column:
    """JSON that stands in a text as base64."""
    return F.from_json(F.unbase64(text).cast("string"), schema)


# ----------------------------------------------------------------- sequences


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, description, seq``: records are cut at their marks, sequence lines joined and upper-cased."""
    records = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    head = F.trim(F.get(lines, F.lit(0)))
    seq = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", ""))
    return records.select(F.split(head, r"\s+", 2)[0].alias("name"), F.get(F.split(head, r"\s+", 2), F.lit(1)).alias("description"), seq.alias("seq"))


def cds_bounds(description: Column) -> Column:
    """1-based bounds in a description's ``CDS=a-b``; null without them."""
    part = lambda k: F.regexp_extract(description, r"CDS=(\d+)-(\d+)", k).try_cast("long")
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, name, seq, qual, ok``: four lines a record, ``ok`` if they are as they should be.

    Files are read in byte ranges, so a record may lie in two splits; only
    gzipped files are one split each. The lines are written once, so that
    splits stay as they are; the number of lines in each split tells where the
    next one goes on. ``n`` counts records from 0 through all files in the order
    of their paths, and each file begins a record. Blank lines after a file's
    last record are none.
    """
    meta = F.col("_metadata")
    line = F.regexp_replace("value", r"\r\z", "")
    lines = staged(spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_b"), line.alias("_l")).withColumn("_i", F.monotonically_increasing_id()))
    # a row for each split, then one for each file: few, whatever the number of lines
    splits = lines.groupBy("file", "_b").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.max(F.when(F.col("_l") != "", F.col("_i"))).alias("_full"))
    splits = splits.withColumn("_from", F.sum("_lines").over(Window.partitionBy("file").orderBy("_b")) - F.col("_lines") - F.col("_first"))
    files = splits.groupBy("file").agg(F.max(F.col("_full") + F.col("_from")).alias("_end"))  # the last line that is not blank
    files = files.filter(F.col("_end").isNotNull()).withColumn("_records", F.floor(F.col("_end") / 4) + 1)
    files = files.withColumn("_before", F.sum("_records").over(Window.orderBy("file")) - F.col("_records"))
    places = F.broadcast(splits.join(files, "file").select("file", "_b", "_from", "_end", "_before"))
    at = F.col("_i") + F.col("_from")
    own = lines.join(places, ["file", "_b"]).select(F.floor(at / 4).alias("_n"), F.pmod(at, F.lit(4)).alias("_k"), "_l", "_end", "_before").filter(F.col("_n") * 4 <= F.col("_end"))
    # a file is told by the number of records before it, which is shorter than its path
    records = own.groupBy("_before", (F.col("_before") + F.col("_n")).alias("n")).agg(*[F.max(F.when(F.col("_k") == k, F.col("_l"))).alias(f"l{k}") for k in range(4)])
    ok = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    return records.join(F.broadcast(files.select("file", "_before")), "_before").select("file", "n", F.regexp_extract("l0", r"^@(\S+)", 1).alias("name"), F.upper("l1").alias("seq"), F.col("l3").alias("qual"), F.coalesce(ok, F.lit(False)).alias("ok"))


def paired_fastq(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by record number: both sequences and whether their names agree; a missing mate is not ok."""
    bare = lambda c: F.regexp_replace(c, r"/[12]$", "")
    a = first.select("n", F.col("name").alias("name1"), F.col("seq").alias("seq1"), F.col("ok").alias("ok1"))
    b = second.select("n", F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("ok").alias("ok2"))
    ok = F.col("ok1") & F.col("ok2") & (bare("name1") == bare("name2"))
    return a.join(b, "n", "full_outer").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("ok1", "ok2")


def sequence_counts(reads: DataFrame) -> DataFrame:
    """How often each sequence occurs."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


def phred(quality: Column, offset: int = 33) -> Column:
    """Base qualities as numbers."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


# ------------------------------------------------------------ genome formats


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos, id, ref, alt, info`` of the lines that are no comments."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), f[2].alias("id"), F.upper(f[3]).alias("ref"), F.upper(F.get(f, F.lit(4))).alias("alt"), F.get(f, F.lit(7)).alias("info"))


def read_gtf(spark: SparkSession, path: str, features: Sequence[str] = ()) -> DataFrame:
    """Nine columns with ``attributes`` as a map; bounds become half-open from 0."""
    names = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, raw string"
    df = spark.read.csv(path, schema=names, sep="\t", comment="#", quote="")
    if features:
        df = df.filter(F.col("feature").isin(*features))
    keys = F.regexp_extract_all("raw", F.lit(r'(\w+) "([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all("raw", F.lit(r'(\w+) "([^"]*)"'), F.lit(2))
    # a key may stand several times; the last value holds, and all tags are kept
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.map_from_entries(F.filter(F.transform(entries, lambda e, i: F.when(F.array_position(F.slice(F.transform(entries, lambda x: x.k), i + 2, F.size(entries)), e.k) == 0, F.struct(e.k, e.v))), lambda e: e.isNotNull()))
    tags = F.transform(F.filter(entries, lambda e: e.k == "tag"), lambda e: e.v)
    return df.select("chrom", "feature", (F.col("start") - 1).alias("start"), "end", "strand", last.alias("attributes"), tags.alias("tags"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Ordered names and sizes: ``name, size, i``, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).filter(F.trim("line") != "")
    f = F.split("line", "\t")
    return whole.select(f[0].alias("name"), f[1].try_cast("long").alias("size"), "i")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries ``row, col, value`` (from 1) of a coordinate matrix, and one row of dimensions with ``ok``."""
    whole = spark.read.text(path).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    banner = spark.read.text(path).filter(F.col("value").startswith("%%MatrixMarket")).agg(F.max("value")).head()[0]
    if not banner or "coordinate" not in banner:
        raise ValueError("not a MatrixMarket coordinate file")
    f = F.split(F.trim("value"), r"\s+")
    numbered = whole.select("value", F.monotonically_increasing_id().alias("_i"))
    first = numbered.agg(F.min_by("value", "_i").alias("value"), F.min("_i").alias("_i"))  # the line after the comments
    head = first.select(f[0].cast("long").alias("rows"), f[1].cast("long").alias("cols"), f[2].cast("long").alias("entries"), "_i")
    entries = numbered.join(F.broadcast(first.select("_i")), "_i", "left_anti").select(f[0].try_cast("long").alias("row"), f[1].try_cast("long").alias("col"), f[2].try_cast("double").alias("value"))
    got = entries.agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("r"), F.max("col").alias("c"))
    ok = (F.col("n") == F.col("entries")) & (F.coalesce("r", F.lit(0)) <= F.col("rows")) & (F.coalesce("c", F.lit(0)) <= F.col("cols"))
    return entries, head.crossJoin(got).select("rows", "cols", "entries", ok.alias("ok"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """``term, description, gene``, a row for each member of a set."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.trim(f[0]).alias("term"), F.get(f, F.lit(1)).alias("description"), F.explode(F.array_distinct(F.slice(f, 3, F.size(f)))).alias("gene")).filter("gene <> ''")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The first eleven fields of alignment lines; positions become from 0."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(f) >= 11))
    flag = f[1].try_cast("int")
    return rows.select(f[0].alias("name"), flag.alias("flag"), f[2].alias("chrom"), (f[3].try_cast("long") - 1).alias("pos"), f[4].try_cast("int").alias("mapq"), f[5].alias("cigar"), F.upper(f[9]).alias("seq"), f[10].alias("qual"), F.when(flag.bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), F.when(flag.bitwiseAND(128) > 0, 2).otherwise(1).alias("mate"))


def allele_depths(info: Column, alt: Column) -> Column:
    """Depth of each alternative in a call's ``AD=``: structs ``alt, depth, total``."""
    depths = F.transform(F.split(F.regexp_extract(info, r"AD=([\d,]+)", 1), ","), lambda x: x.try_cast("long"))
    total = F.aggregate(depths, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.transform(F.split(alt, ","), lambda a, i: F.struct(a.alias("alt"), F.get(depths, i + 1).alias("depth"), total.alias("total")))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of fixed-width records: ``serial, atom, residue, chain, number, x, y, z``."""
    at = lambda a, n: F.trim(F.substring("value", a, n))
    rows = spark.read.text(path).filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    return rows.select(
        at(7, 5).try_cast("int").alias("serial"), at(13, 4).alias("atom"), at(18, 3).alias("residue"), at(22, 1).alias("chain"), at(23, 4).try_cast("int").alias("number"),
        *[at(31 + 8 * k, 8).try_cast("double").alias(c) for k, c in enumerate("xyz")],
    )


# ---------------------------------------------------------------- documents


def markdown_sections(df: DataFrame, key: str, text: str, level: int = 2) -> DataFrame:
    """``key, i, title, body`` of the sections under headings of a level."""
    mark = "#" * level
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), rf"\n{mark}\s+"), 2, 1_000_000)
    rows = df.select(key, F.posexplode(parts).alias("i", "part"))
    return rows.select(key, "i", F.trim(F.split("part", "\n", 2)[0]).alias("title"), F.coalesce(F.get(F.split("part", "\n", 2), F.lit(1)), F.lit("")).alias("body"))


def markdown_cells(body: Column) -> Column:
    """Cells of a pipe table's rows; the rule below the header is left out."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML table, by Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def fasta_chunks(spark: SparkSession, path: str, width: int, overlap: int) -> DataFrame:
    """Long FASTA sequences as rows of ``width`` bases and the next ``overlap``: ``file, contig, chunk, offset, seq``, in upper case.

    Files are read in byte ranges, so a contig may lie in many splits. A scan
    with carry over the lines of each file gives each its header and its place
    in the sequence; lines are then cut into the chunks that they touch. No row
    or task holds a whole contig. Headers count up to the first white space;
    contigs of equal names in a file are told apart by order, ``record`` from 1.
    Text before the first header is not read; a contig without bases has no row.
    """
    meta = F.col("_metadata")
    line = F.trim("value")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_b"), line.alias("_l")).withColumn("_i", F.monotonically_increasing_id())
    head = F.startswith("_l", F.lit(">"))
    order = [F.asc("_b"), F.asc("_i")]
    first = {
        "record": Running("count", F.when(head, 1)),
        "contig": Running("last", F.when(head, F.regexp_extract("_l", r"^>\s*(\S*)", 1))),
        "_at": Running("sum", F.when(head, 0).otherwise(F.length("_l")).cast("long"), before=True),
    }
    told = scan(lines, order, first, ["file"])
    # places only grow along a file, so the last header's is the largest so far
    told = scan(told, order, {"_from": Running("max", F.when(head, F.coalesce("_at", F.lit(0).cast("long"))))}, ["file"])
    own = told.filter(~head & (F.length("_l") > 0) & (F.col("record") > 0)).select("file", "contig", "record", F.upper("_l").alias("_l"), (F.col("_at") - F.col("_from")).alias("_o"))
    last = F.col("_o") + F.length("_l") - 1
    low = F.greatest(F.lit(0), F.floor((F.col("_o") - overlap) / width))
    each = own.withColumn("chunk", F.explode(F.sequence(low, F.floor(last / width)))).withColumn("_a", F.greatest(F.col("_o"), F.col("chunk") * width))
    piece = F.substring("_l", (F.col("_a") - F.col("_o") + 1).cast("int"), (F.least(last + 1, (F.col("chunk") + 1) * width + overlap) - F.col("_a")).cast("int"))
    pieces = each.select("file", "contig", "record", "chunk", "_a", piece.alias("_s")).filter(F.length("_s") > 0)
    order = F.array_sort(F.collect_list(F.struct("_a", "_s")))  # lines of a chunk
    joined = pieces.groupBy("file", "record", "contig", "chunk").agg(F.array_join(F.transform(order, lambda x: x["_s"]), "").alias("seq"))
    # what follows a sequence's last base alone is no chunk
    return joined.select("file", "record", "contig", F.col("chunk").cast("int").alias("chunk"), (F.col("chunk") * width).alias("offset"), "seq")
