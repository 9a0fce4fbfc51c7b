"""Queries that write driver tables in a format and read them back, and coercions of text fields."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import joins, ordered, sequence, validate
from ..session import put, ranged
from ..sources import archives, matrices, sinks, text
from .registry import Tables, query

_SEQ = "translate(upper(concat(p_name, p_type)), 'BDEFHIJKLMNOPQRSUVWXYZ -#0123456789', 'ACGTACGTACGTACGTACGTAC')"


def _lines(df: DataFrame, value: str, path: str, *order: str, parts: bool = False, **options: str) -> str:
    """Write an SQL expression of each row as a line, or several.

    If an order is given, in one file, which is for tables of bounded size, or
    with ``parts`` in files of ranges whose names are in that order.
    """
    out = df.select(F.expr(value).alias("value"), *order)
    if parts:
        out = ranged(out, *order)
    elif order:
        out = out.repartition(1).sortWithinPartitions(*order)
    out.select("value").write.mode("overwrite").options(**options).text(path)
    return path


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS segment, c_acctbal FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    """A table as CSV with empty nulls and back."""
    path = t.folder()
    sinks.write_csv(t.customer.select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), "c_acctbal"), path, one_file=False)
    return text.read_csv(t.spark, path, "c_custkey long, c_name string, segment string, c_acctbal double")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def bounded_csv(t: Tables) -> DataFrame:
    """The first rows of a file of bounded size."""
    path = t.folder()
    sinks.write_csv(t.nation.repartition(1).sortWithinPartitions("n_nationkey").select("n_nationkey", "n_name"), path)
    return text.read_bounded(t.spark, path, "n_nationkey int, n_name string", 1 << 20, 10)


@query("SELECT r_regionkey, r_name FROM region")
def sniffed_csv(t: Tables) -> DataFrame:
    """A table whose separator is told from its first line (S3)."""
    path = t.folder()
    sinks.write_csv(t.region.select("r_regionkey", "r_name"), path, sep=";")
    return text.read_sniffed(t.spark, path, "r_regionkey int, r_name string")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def gzip_tsv(t: Tables) -> DataFrame:
    """A gzipped table with tabs, spread over partitions."""
    path = t.folder()
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.csv(path, sep="\t", header=True, compression="gzip")
    return text.read_tsv(t.spark, path, "s_suppkey long, s_name string, s_acctbal double", parts=4)


@query("SELECT s_suppkey, printf('%.3f', s_acctbal) AS balance, printf('%.1f', CAST(s_nationkey AS DOUBLE)) AS nation FROM supplier")
def fixed_format(t: Tables) -> DataFrame:
    """Numbers written in a fixed format (K3)."""
    path = t.folder()
    sinks.write_csv(t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")), path, {"balance": "%.3f", "nation": "%.1f"})
    return text.read_csv(t.spark, path, "s_suppkey long, balance string, nation string")


@query("SELECT r_regionkey, r_name FROM region")
def json_documents(t: Tables) -> DataFrame:
    """One JSON document a file, all files together, with a bound of size."""
    path = t.folder()
    t.region.select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return text.read_json_documents(t.spark, f"{path}/*/*.txt", "r_regionkey int, r_name string", 1 << 20).select("document.*")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS region FROM nation")
def json_lines(t: Tables) -> DataFrame:
    """Rows as JSON lines and back; a missing field is null (K4)."""
    path = t.folder()
    sinks.write_json(t.nation.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region")), path)
    return t.spark.read.schema("n_nationkey int, n_name string, region int").json(path)


@query("SELECT CAST(0 AS INTEGER) AS i, 'Key' AS title, CAST(r_regionkey AS VARCHAR) AS body FROM region UNION ALL SELECT CAST(1 AS INTEGER), 'Name', r_name FROM region")
def markdown_parts(t: Tables) -> DataFrame:
    """Whole Markdown files cut at their headings."""
    path = t.folder()
    body = F.format_string("# Region\n\n## Key\n%d\n\n## Name\n%s\n", "r_regionkey", "r_name")
    t.region.select(body.alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return text.markdown_sections(text.read_texts(t.spark, f"{path}/*/*.txt"), "file", "text").select("i", "title", F.trim(F.regexp_replace("body", r"\s+", " ")).alias("body"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INTEGER) AS i, '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT * FROM (VALUES (CAST(0 AS INTEGER), '| r_regionkey | r_name |'), (CAST(1 AS INTEGER), '|---|---|'))")
def markdown_report(t: Tables) -> DataFrame:
    """A bounded result as a Markdown table (K6)."""
    lines = sinks.markdown(t.region.orderBy("r_regionkey").select("r_regionkey", "r_name")).split("\n")
    return t.spark.createDataFrame(list(enumerate(lines)), "i int, line string")


@query("SELECT n_nationkey, n_name, true AS same FROM nation")
def twin_files(t: Tables) -> DataFrame:
    """The same rows as CSV with a byte order mark and as JSON, read and compared (K8)."""
    csv, json = t.folder(), t.folder()
    sinks.write_twins(t.nation.select("n_nationkey", "n_name"), csv, json)
    a = text.read_csv(t.spark, csv, "n_nationkey int, n_name string")
    b = t.spark.read.schema("n_nationkey int, n_name string").json(json).select("n_nationkey", F.col("n_name").alias("other"))
    return a.join(b, "n_nationkey", "full_outer").select("n_nationkey", "n_name", F.col("n_name").eqNullSafe(F.col("other")).alias("same"))


@query(f"""
WITH d AS (SELECT p_partkey, p_size, {_SEQ} AS s FROM part)
SELECT 'P' || p_partkey AS name, CAST(p_size AS BIGINT) AS cds_start, CAST(2 * p_size AS BIGINT) AS cds_end, CAST(length(s) AS INTEGER) AS bases, regexp_full_match(s, '[ACGT]+') AS dna, 2 * p_size <= length(s) AND p_size >= 1 AS in_bounds FROM d""")
def fasta_records(t: Tables) -> DataFrame:
    """FASTA records over several lines, their coding bounds and alphabet."""
    d = t.part.select("p_partkey", "p_size", F.expr(_SEQ).alias("s"))
    path = _lines(d, r"concat('>P', p_partkey, ' exon_joined CDS=', p_size, '-', 2 * p_size, '\n', substr(s, 1, 10), '\n', lower(substr(s, 11)))", t.folder())
    found = text.read_fasta(t.spark, path).withColumn("c", text.cds_bounds(F.col("description")))
    return found.select("name", F.col("c.start").alias("cds_start"), F.col("c.end").alias("cds_end"), F.length("seq").alias("bases"), sequence.is_dna(F.col("seq")).alias("dna"), sequence.bounds_ok(F.col("c.start"), F.col("c.end"), F.length("seq")).alias("in_bounds"))


@query(r"""
WITH g AS (SELECT s_suppkey AS k, string_agg(translate(md5('f' || s_suppkey || '-' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS s FROM supplier, range(12) r(i) GROUP BY 1),
c AS (SELECT 'S' || k AS contig, CAST(unnest(range(0, 4)) AS INTEGER) AS chunk, s FROM g)
SELECT contig, chunk, CAST(chunk AS BIGINT) * 100 AS "offset", substr(s, chunk * 100 + 1, 117) AS seq FROM c""")
def fasta_ranges(t: Tables) -> DataFrame:
    """Chunks of FASTA sequences, whose files are read in byte ranges."""
    pieces = ", ".join(f"translate(md5(concat('f', s_suppkey, '-', {i})), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in range(12))
    d = t.supplier.select("s_suppkey", F.expr(f"concat({pieces})").alias("s"))
    cut = ", ".join(rf"lower(substr(s, {i}, 59)), '\n'" for i in range(1, 384, 59))
    path = _lines(d, rf"concat('>S', s_suppkey, ' some words\n', {cut})", t.folder())
    return text.fasta_chunks(t.spark, path, 100, 17).select("contig", "chunk", "offset", "seq")


def _fastq(t: Tables, mate: int) -> DataFrame:
    d = t.part.select("p_partkey", F.expr(_SEQ).alias("s"))
    seq = "s" if mate == 1 else "reverse(translate(s, 'ACGT', 'TGCA'))"
    name = f"concat('@R', p_partkey + IF({mate} = 2 AND p_partkey % 10 = 0, 1, 0), '/{mate}')"
    return text.read_fastq(t.spark, _lines(d, rf"concat({name}, '\n', {seq}, '\n+\n', repeat('I', length(s)))", t.folder(), "p_partkey", parts=True))


@query(f"""
WITH d AS (SELECT p_partkey, {_SEQ} AS s FROM part)
SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS n, s AS seq1, reverse(translate(s, 'ACGT', 'TGCA')) AS seq2, p_partkey % 10 <> 0 AS ok FROM d""")
def fastq_pairs(t: Tables) -> DataFrame:
    """Mates of two FASTQ texts, each in files of ranges, by record, and whether their names agree."""
    return text.paired_fastq(_fastq(t, 1), _fastq(t, 2)).select("n", "seq1", "seq2", "ok")


@query(f"SELECT {_SEQ} AS seq, count(*) AS n FROM part GROUP BY 1")
def fastq_counts(t: Tables) -> DataFrame:
    """How often each read occurs."""
    return text.sequence_counts(_fastq(t, 1))


@query("""
WITH v AS (SELECT o_orderstatus AS chrom, o_orderkey + 1 AS pos, substr('ACGT', CAST(o_custkey % 4 AS INTEGER) + 1, 1) AS ref, substr('CGTA', CAST(o_custkey % 4 AS INTEGER) + 1, 1) AS alt, o_custkey % 30 AS a, o_orderkey % 20 AS b FROM orders)
SELECT chrom, pos, ref, alt, CAST(b AS BIGINT) AS depth, CAST(a + b AS BIGINT) AS total FROM v""")
def vcf_depths(t: Tables) -> DataFrame:
    """Sites of a VCF and the depths of their alternatives."""
    base = lambda letters: f"substr('{letters}', CAST(o_custkey % 4 AS INT) + 1, 1)"
    value = rf"concat_ws('\t', o_orderstatus, o_orderkey + 1, '.', {base('ACGT')}, {base('CGTA')}, '.', 'PASS', concat('DP=9;AD=', o_custkey % 30, ',', o_orderkey % 20))"
    rows = text.read_vcf(t.spark, _lines(t.orders, value, t.folder()))
    each = rows.select("chrom", "pos", "ref", F.explode(text.allele_depths(F.col("info"), F.col("alt"))).alias("a"))
    return each.select("chrom", "pos", "ref", "a.alt", "a.depth", "a.total")


@query("""
SELECT 'chr' || p_size AS chrom, 'G' || p_partkey AS gene, CAST(p_partkey * 10 AS BIGINT) AS "start", CAST(p_partkey * 10 + p_size AS BIGINT) AS "end",
  CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 ELSE p_partkey * 10 + p_size - 1 END AS BIGINT) AS tss FROM part WHERE p_partkey % 3 <> 0""")
def gtf_starts(t: Tables) -> DataFrame:
    """Exons of a GTF, their attributes and transcription starts."""
    value = r"""concat_ws('\t', concat('chr', p_size), 'x', IF(p_partkey % 3 = 0, 'gene', 'exon'), p_partkey * 10 + 1, p_partkey * 10 + p_size, '.', IF(p_partkey % 2 = 0, '+', '-'), '.', concat('gene_id "G', p_partkey, '"; tag "a"; tag "b";'))"""
    rows = text.read_gtf(t.spark, _lines(t.part, value, t.folder()), ["exon"])
    return rows.select("chrom", F.element_at("attributes", "gene_id").alias("gene"), "start", "end", sequence.tss(F.col("start"), F.col("end"), F.col("strand")).alias("tss"))


@query("SELECT n_name AS name, CAST(100 * n_nationkey + 1 AS BIGINT) AS size, CAST(n_nationkey AS INTEGER) AS i, CAST(coalesce(sum(100 * n_nationkey + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM nation")
def contig_sizes(t: Tables) -> DataFrame:
    """Sizes in file order, and where each contig starts."""
    sizes = text.read_sizes(t.spark, _lines(t.nation, r"concat(n_name, '\t', 100 * n_nationkey + 1)", t.folder(), "n_nationkey"))
    return ordered.offsets(sizes, [], [F.asc("i")], "size", "start")


@query("SELECT CAST(o_custkey % 50 + 1 AS BIGINT) AS row, CAST(o_orderkey % 40 + 1 AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value, true AS whole FROM orders GROUP BY 1, 2")
def matrix_market(t: Tables) -> DataFrame:
    """A coordinate matrix and whether its header holds."""
    cells = t.orders.groupBy((F.col("o_custkey") % 50 + 1).alias("r"), (F.col("o_orderkey") % 40 + 1).alias("c")).agg(F.count(F.lit(1)).alias("v"))
    n = cells.count()
    head = t.spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 1, "% a comment"), (0, 2, f"50 40 {n}")], "k long, i long, line string")
    body = cells.select(F.col("r").alias("k"), F.col("c").alias("i"), F.concat_ws(" ", "r", "c", "v").alias("line"))
    entries, dimensions = text.read_matrix_market(t.spark, _lines(head.union(body), "line", t.folder(), "k", "i"))
    return entries.crossJoin(F.broadcast(dimensions.select(F.col("ok").alias("whole"))))  # one row


@query("SELECT o_custkey % 50 AS cell, 'G' || (o_orderkey % 40) AS gene, CAST(count(*) AS DOUBLE) AS value, CASE WHEN o_custkey % 50 < 25 THEN 'a' ELSE 'b' END AS sample FROM orders GROUP BY ALL")
def sparse_cells(t: Tables) -> DataFrame:
    """A sparse matrix with described rows and columns."""
    cells = t.orders.groupBy((F.col("o_custkey") % 50).alias("row"), (F.col("o_orderkey") % 40).alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    obs = t.spark.range(50).select(F.col("id").alias("row"), F.when(F.col("id") < 25, "a").otherwise("b").alias("sample"))
    var = t.spark.range(40).select(F.col("id").alias("col"), F.concat(F.lit("G"), "id").alias("gene"))
    path = t.folder()
    matrices.write_sparse(cells, obs, var, path)
    entries, obs, var = matrices.read_sparse(t.spark, path)
    return entries.join(obs, "row").join(var, "col").select(F.col("row").alias("cell"), "gene", "value", "sample")


@query("SELECT 'r' || r_regionkey || '.txt' AS member, r_name AS text FROM region")
def tar_members(t: Tables) -> DataFrame:
    """Members of a compressed archive whose names match."""
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as tar:
        for r in t.region.collect():
            for name, content in ((f"r{r.r_regionkey}.txt", r.r_name), (f"r{r.r_regionkey}.bin", "x")):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content.encode()))
    path = f"{t.folder()}/a.tar.gz"
    put(t.spark, path, held.getvalue())
    return archives.read_tar(t.spark, path, r".*\.txt").select("member", F.col("content").cast("string").alias("text"))


def _workbook(rows: list[tuple]) -> bytes:
    """A workbook of one sheet, ``S``, of text cells."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate(rows))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return held.getvalue()


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def workbook_sheet(t: Tables) -> DataFrame:
    """The named columns of a workbook's sheet."""
    rows = [("name", "other", "id"), *[(r.r_name, "x", r.r_regionkey) for r in t.region.collect()]]
    path = f"{t.folder()}/a.xlsx"
    put(t.spark, path, _workbook(rows))
    return archives.sheet_table(archives.read_xlsx(t.spark, path, "S"), ["id", "name"]).select("id", "name")


@query("SELECT p_brand AS term, count(DISTINCT p_type) AS genes, 'about' AS description FROM part GROUP BY 1")
def gene_sets(t: Tables) -> DataFrame:
    """Sets of a GMT file, each member once."""
    sets = t.part.groupBy("p_brand").agg(F.array_join(F.collect_list("p_type"), "\t").alias("g"))
    rows = text.read_gmt(t.spark, _lines(sets, r"concat_ws('\t', p_brand, 'about', g)", t.folder()))
    return rows.groupBy("term", "description").agg(F.count(F.lit(1)).alias("genes"))


@query("SELECT 'r' || r_regionkey || '.txt' AS file, r_regionkey <> 3 AS ok FROM region")
def verified_files(t: Tables) -> DataFrame:
    """Files against the digests of their manifest; one of them is wrong."""
    path = t.folder()
    for r in t.region.collect():
        put(t.spark, f"{path}/r{r.r_regionkey}.txt", r.r_name.encode())
    told = F.sha2(F.concat("r_name", F.when(F.col("r_regionkey") == 3, "!").otherwise("")), 256)
    manifest = t.region.select(F.concat(F.lit("r"), "r_regionkey", F.lit(".txt")).alias("file"), told.alias("sha256"))
    return text.read_verified(t.spark, path, manifest).select("file", "ok")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation")
def embedded_resource(t: Tables) -> DataFrame:
    """JSON that stands in a text as base64."""
    packed = t.nation.select(F.base64(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))).cast("binary")).alias("b"))
    return packed.select(text.embedded_json(F.col("b"), "k int, v string").alias("d")).select("d.*")


@query(f"""
WITH d AS (SELECT p_partkey, p_size % 3 AS k, left({_SEQ} || 'ACGTACGTAC', 10) AS s FROM part)
SELECT 'R' || p_partkey AS name, CAST(p_partkey * 7 AS BIGINT) AS pos, CASE k WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 8 END AS span, CASE k WHEN 0 THEN substr(s, 7, 1) WHEN 2 THEN substr(s, 9, 1) END AS base, p_partkey % 2 = 1 AS reverse FROM d""")
def sam_spans(t: Tables) -> DataFrame:
    """Alignments: the reference they span, and the base over a position."""
    d = t.part.select("p_partkey", "p_size", F.left(F.concat(F.expr(_SEQ), F.lit("ACGTACGTAC")), F.lit(10)).alias("s"))
    cigar = "CASE p_size % 3 WHEN 0 THEN '10M' WHEN 1 THEN '2S4M3D4M' ELSE '4M2I4M' END"
    value = rf"concat_ws('\t', concat('R', p_partkey), IF(p_partkey % 2 = 1, 16, 0), 'c', p_partkey * 7 + 1, 60, {cigar}, '*', 0, 0, s, repeat('I', 10))"
    rows = text.read_sam(t.spark, _lines(d, value, t.folder()))
    base = sequence.base_at(F.col("seq"), F.col("cigar"), F.col("pos"), F.col("pos") + 6)
    return rows.select("name", "pos", sequence.reference_span(F.col("cigar")).alias("span"), base.alias("base"), (F.col("flag").bitwiseAND(16) > 0).alias("reverse"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS n FROM nation")
def xml_rows(t: Tables) -> DataFrame:
    """Rows of an XML table."""
    path = f"{t.folder()}/a.xml"
    rows = "".join(f"<row><k>{r.n_nationkey}</k><n>{r.n_name}</n></row>" for r in t.nation.collect())
    put(t.spark, path, f"<table>{rows}</table>".encode())
    return text.read_xml_rows(t.spark, path, "row", "k int, n string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS serial, 'CA' AS atom, 'A' AS chain, CAST(n_regionkey + 1 AS INTEGER) AS number, CAST(n_nationkey + 0.25 AS DOUBLE) AS x, CAST(-1.5 * n_nationkey AS DOUBLE) + 0.0 AS y FROM nation")
def pdb_atoms(t: Tables) -> DataFrame:
    """Atoms of fixed-width records."""
    value = "format_string('ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f  1.00', n_nationkey, n_regionkey + 1, n_nationkey + 0.25D, -1.5D * n_nationkey, 0D)"
    atoms = text.read_pdb(t.spark, _lines(t.nation, value, t.folder()))
    return atoms.select("serial", "atom", "chain", "number", "x", (F.col("y") + 0.0).alias("y"))


# ----------------------------------------------------------------- coercion


@query("SELECT n_nationkey AS key, n_name AS name, CAST(NULL AS VARCHAR) AS other, n_name AS filled FROM nation")
def alias_fields(t: Tables) -> DataFrame:
    """Fields by any of their names, and the first that is filled."""
    df = t.nation.select(F.col("n_nationkey").alias("Nation Key"), F.col("n_name").alias("NAME"), "n_regionkey")
    found = coerce.resolve_columns(coerce.resolve_columns(df, {"n_regionkey": []}, "required"), {"key": ["nation_key"], "name": ["nm"], "other": ["x"]})
    return found.withColumn("filled", coerce.first_filled(F.lit("  "), F.col("other"), F.col("name")))


@query("""
SELECT p_partkey, CAST(p_size * CASE p_size % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000000.0 ELSE 1.0 END AS DOUBLE) AS bases, CASE WHEN p_size % 2 = 0 THEN p_size / 100.0 WHEN p_size > 1 THEN p_size / 100.0 ELSE CAST(p_size AS DOUBLE) END AS share,
  CAST(p_size AS BIGINT) AS whole, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'STANDARD' THEN 'plain' ELSE 'rest' END AS kind, CASE WHEN p_size = 25 THEN 'M' ELSE CAST(p_size AS VARCHAR) END AS chrom FROM part""")
def unit_fields(t: Tables) -> DataFrame:
    """Numbers with units, shares, whole numbers in text, labels and chromosome names."""
    size = F.col("p_size")
    unit = F.concat(size, F.when(size % 3 == 0, " kb").when(size % 3 == 1, " Mb").otherwise(" bp"))
    share = F.concat(size, F.when(size % 2 == 0, "%").otherwise(""))
    return t.part.select(
        "p_partkey", coerce.with_unit(unit, {"kb": 1e3, "mb": 1e6, "bp": 1.0}).alias("bases"), coerce.fraction(share).alias("share"), coerce.integer(F.concat(F.lit("n = "), size, F.lit(" items"))).alias("whole"),
        coerce.label(F.col("p_type"), {"cheap": ["economy"], "plain": ["Standard"]}, "rest").alias("kind"), coerce.chromosome(F.when(size == 25, "chrMT").otherwise(F.concat(F.lit("chr"), size))).alias("chrom"),
    )


@query("""
WITH v AS (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS p, o_totalprice - 100000 AS v FROM orders),
r AS (SELECT 'missing p' AS rule, count(*) FILTER (p IS NULL) AS n FROM v UNION ALL SELECT 'not positive v', count(*) FILTER (v <= 0) FROM v UNION ALL SELECT 'repeated o_custkey', (SELECT count(*) FROM (SELECT o_custkey FROM v GROUP BY 1 HAVING count(*) > 1)))
SELECT rule, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""")
def table_rules(t: Tables) -> DataFrame:
    """How many rows break rules of uniqueness, completeness and sign."""
    v = t.orders.select("o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"), (F.col("o_totalprice") - 100000).alias("v"))
    return validate.violations(v, ["o_custkey"], ["p"], ["v"])


@query("SELECT p_partkey, lower(p_type) AS leaked FROM part WHERE p_partkey % 4 = 0")
def leak_guard(t: Tables) -> DataFrame:
    """Ids that contain a label, whatever its case and marks."""
    ids = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("g_"), F.initcap("p_type"), F.lit("-7"))).otherwise("g_7").alias("id"))
    found = validate.leaks(ids, t.part.select("p_type"), "id", "p_type")
    return found.select("p_partkey", F.array_join("leaked", ",").alias("leaked"))


# ------------------------------------------------------------ interval joins


@query("SELECT l_orderkey, l_linenumber, n_nationkey FROM lineitem JOIN nation ON l_quantity >= 2 * n_nationkey AND l_quantity < 2 * n_nationkey + 3")
def points_in_bands(t: Tables) -> DataFrame:
    """Points with each interval that holds them."""
    points = t.lineitem.select("l_orderkey", "l_linenumber", F.lit(1).alias("k"), F.col("l_quantity").cast("long").alias("at"))
    bands = t.nation.select("n_nationkey", F.lit(1).alias("k"), (F.col("n_nationkey").cast("long") * 2).alias("start"), (F.col("n_nationkey").cast("long") * 2 + 3).alias("end"))
    return joins.point_in_interval(points, bands, ["k"], 8).select("l_orderkey", "l_linenumber", "n_nationkey")


_RANGES = "(SELECT p_partkey AS a, p_size % 5 AS k, p_partkey * 3 AS s, p_partkey * 3 + p_size AS e FROM part), o AS (SELECT p_partkey AS b, p_size % 5 AS k, p_partkey * 3 - p_size AS s, p_partkey * 3 + 2 * p_size AS e, p_retailprice AS v FROM part)"


def _ranges(t: Tables) -> tuple[DataFrame, DataFrame]:
    at, size = F.col("p_partkey") * 3, F.col("p_size")
    inner = t.part.select(F.col("p_partkey").alias("a"), (size % 5).alias("k"), at.alias("l_start"), (at + size).alias("l_end"))
    return inner, t.part.select(F.col("p_partkey").alias("b"), (size % 5).alias("k"), (at - size).alias("r_start"), (at + 2 * size).alias("r_end"), F.col("p_retailprice").alias("v"))


@query(f"WITH i AS {_RANGES} SELECT a, b FROM i JOIN o USING (k) WHERE o.s <= i.s AND i.e <= o.e AND i.e > i.s")
def contained_ranges(t: Tables) -> DataFrame:
    """Intervals that lie within others."""
    inner, outer = _ranges(t)
    return joins.contained(inner, outer, ["k"], 64).select("a", "b")


@query(f"WITH i AS {_RANGES} SELECT a, round(sum(v * (least(i.e, o.e) - greatest(i.s, o.s)) / (o.e - o.s)), 4) + 0.0 AS spread FROM i JOIN o USING (k) WHERE o.s < i.e AND i.s < o.e GROUP BY a")
def spread_values(t: Tables) -> DataFrame:
    """Values of intervals, spread over those that they overlap."""
    pairs = joins.interval_overlap(*_ranges(t), ["k"], 64)
    part = F.col("v") * F.col("overlap") / (F.col("r_end") - F.col("r_start"))
    return pairs.groupBy("a").agg((F.round(F.sum(part), 4) + 0.0).alias("spread"))


@query("""
WITH a AS (SELECT * FROM lineitem WHERE l_linenumber = 1), b AS (SELECT * FROM lineitem WHERE l_linenumber = 2),
m AS (SELECT a.l_orderkey AS o, CASE WHEN a.l_partkey % 2 = 0 THEN '+' ELSE '-' END AS s1, CASE WHEN b.l_partkey % 2 = 0 THEN '+' ELSE '-' END AS s2, CAST(a.l_suppkey AS BIGINT) AS p1, CAST(b.l_suppkey AS BIGINT) AS p2 FROM a JOIN b ON a.l_orderkey = b.l_orderkey)
SELECT o AS l_orderkey, p1, p2, CASE WHEN NOT (CASE WHEN p1 <= p2 THEN s1 = '+' AND s2 = '-' ELSE s2 = '+' AND s1 = '-' END) THEN 'orientation' WHEN abs(p1 - p2) > 30 THEN 'spanning' ELSE 'proper' END AS class FROM m""")
def mate_classes(t: Tables) -> DataFrame:
    """Mates by record name and flag, and how they face each other."""
    strand = F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-")
    mate = lambda k: t.lineitem.filter(F.col("l_linenumber") == k).select("l_orderkey", strand.alias(f"s{k}"), F.col("l_suppkey").alias(f"p{k}"))
    both = mate(1).join(mate(2), "l_orderkey")
    return both.select("l_orderkey", "p1", "p2", sequence.pair_class(F.col("s1"), F.col("s2"), F.col("p1"), F.col("p2"), 30).alias("class"))
