"""Readers on small files, and streams against tables."""

import base64
import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import archives, sinks, text
from tessella.streaming import events


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"file://{path}"


def test_csv_bom_missing_and_bounds(spark, tmp_path):
    p = put(tmp_path / "a.csv", "﻿id,v\n1,x\n2,\n")
    assert [tuple(r) for r in text.read_csv(spark, p, "id int, v string").collect()] == [(1, "x"), (2, None)]
    assert text.read_csv(spark, f"file://{tmp_path}/none.csv", "id int, v string").count() == 0
    assert text.read_bounded(spark, p, "id int, v string", 100, 1).count() == 1
    with pytest.raises(ValueError):
        text.read_bounded(spark, p, "id int, v string", 3, 1)
    semi = put(tmp_path / "b.csv", "id;v\n1;x,y\n")
    assert text.read_sniffed(spark, semi, "id int, v string").head() == (1, "x,y")
    tsv = put(tmp_path / "c.tsv.gz", gzip.compress(b"id\tv\n1\tx\n"))
    assert text.read_tsv(spark, tsv, "id int, v string", parts=2).head() == (1, "x")


def test_json_texts_and_manifest(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"k": 1}))
    put(tmp_path / "b.json", "broken")
    got = {r.file: r.document for r in text.read_json_documents(spark, f"file://{tmp_path}/*.json", "k int").collect()}
    assert got["a.json"].k == 1 and (got["b.json"] is None or got["b.json"].k is None)
    manifest = spark.createDataFrame([("a.json", hashlib.sha256(b'{"k": 1}').hexdigest()), ("b.json", "0"), ("c.json", "0")], "file string, sha256 string")
    assert {r.file: r.ok for r in text.read_verified(spark, f"file://{tmp_path}/*.json", manifest).collect()} == {"a.json": True, "b.json": False, "c.json": False}
    b64 = base64.b64encode(b'{"k": 7}').decode()
    assert spark.range(1).select(text.embedded_json(F.lit(b64), "k int").alias("j")).head().j.k == 7


def test_fasta_and_fastq(spark, tmp_path):
    fa = put(tmp_path / "t.fa", ">TX1 exon_joined CDS=1-6\nacgt\nac\n>TX2\nGG\n")
    got = {r.name: r for r in text.read_fasta(spark, fa).withColumn("cds", text.cds_bounds(F.col("description"))).collect()}
    assert got["TX1"].seq == "ACGTAC" and tuple(got["TX1"].cds) == (1, 6) and got["TX2"].seq == "GG"
    one = put(tmp_path / "r1.fastq", "@a/1\nACG\n+\nIII\n@b/1\nAC\n+\nI\n")
    two = put(tmp_path / "r2.fastq.gz", gzip.compress(b"@a/2\nCCC\n+\nIII\n"))
    first, second = text.read_fastq(spark, one), text.read_fastq(spark, two)
    assert [(r.name, r.ok) for r in first.orderBy("n").collect()] == [("a/1", True), ("b/1", False)]
    assert [r.ok for r in text.paired_fastq(first, second).orderBy("n").collect()] == [True, False]
    assert text.sequence_counts(first).count() == 2
    assert first.orderBy("n").select(text.phred(F.col("qual")).alias("q")).head().q == [40, 40, 40]


def test_fastq_in_splits_and_files(spark, tmp_path):
    """Records across splits, files in order of their names, either line end, an empty read and blank lines at the end."""
    reads = [(f"r{i}", "ACGT" * (i % 9)) for i in range(150)]
    record = lambda name, s, mate, end: end.join([f"@{name}/{mate}", s, "+", "I" * len(s)]) + end
    for mate, cuts, end in ((1, (0, 70, 70, 150), "\n"), (2, (0, 10, 149, 150), "\r\n")):
        (tmp_path / f"m{mate}").mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            put(tmp_path / f"m{mate}" / f"part-{k}.fastq", "".join(record(*r, mate, end) for r in reads[a:b]) + (end * k if b > a else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        first, second = (text.read_fastq(spark, f"file://{tmp_path}/m{mate}") for mate in (1, 2))
        got = text.paired_fastq(first, second).orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.n, r.seq1, r.seq2, r.ok) for r in got] == [(i, s, s, True) for i, (_, s) in enumerate(reads)]
    assert {(r.file.rsplit("/", 1)[1], r.k) for r in first.groupBy("file").agg(F.count(F.lit(1)).alias("k")).collect()} == {("part-0.fastq", 70), ("part-2.fastq", 80)}


def test_fastq_queries_write_ranges(spark, tmp_path, monkeypatch):
    """More rows make more files, none of which is read whole."""
    from tessella import session
    from tessella.plans import formats
    from tessella.plans.registry import Tables

    monkeypatch.setattr(session, "_TASK_ROWS", 25)
    spark.range(1000).selectExpr("id AS p_partkey", "concat('x', id) AS p_name", "'y' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    reads = formats._fastq(Tables(spark, f"file://{tmp_path}"), 1)
    assert reads.select("file").distinct().count() > 30
    assert [(r.n, r.name) for r in reads.orderBy("n").collect()] == [(i, f"R{i}/1") for i in range(1000)]


def test_genome_formats(spark, tmp_path):
    vcf = put(tmp_path / "v.vcf", "##x\n#CHROM\nchr1\t5\t.\ta\tG,T\t.\t.\tAD=10,3,1\n")
    v = text.read_vcf(spark, vcf)
    assert v.head()[:5] == ("chr1", 5, ".", "A", "G,T")
    assert [tuple(x) for x in v.select(text.allele_depths(F.col("info"), F.col("alt")).alias("x")).head().x] == [("G", 3, 14), ("T", 1, 14)]
    gtf = put(tmp_path / "g.gtf", '#c\nchr1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "G1"; tag "basic"; tag "main";\nchr1\tsrc\tgene\t1\t90\t.\t+\t.\tgene_id "G1";\n')
    g = text.read_gtf(spark, gtf, ["exon"]).head()
    assert (g.start, g.end, g.attributes["gene_id"], g.tags) == (10, 20, "G1", ["basic", "main"])
    sizes = put(tmp_path / "s.sizes", "chr2\t5\nchr1\t7\n")
    assert [tuple(r) for r in text.read_sizes(spark, sizes).orderBy("i").collect()] == [("chr2", 5, 0), ("chr1", 7, 1)]
    gmt = put(tmp_path / "s.gmt", "A\td\tg1\tg2\tg1\nB\t\tg3\n")
    assert sorted((r.term, r.gene) for r in text.read_gmt(spark, gmt).collect()) == [("A", "g1"), ("A", "g2"), ("B", "g3")]
    sam = put(tmp_path / "x.sam", "@HD\nr1\t16\tchr1\t101\t60\t3M\t*\t0\t0\tacg\tIII\n")
    s = text.read_sam(spark, sam).head()
    assert (s.pos, s.strand, s.seq, s.mate) == (100, "-", "ACG", 1)
    pdb = put(tmp_path / "m.pdb", "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.00           C\n")
    a = text.read_pdb(spark, pdb).head()
    assert (a.atom, a.residue, a.chain, a.number, a.x, a.z) == ("CA", "ALA", "A", 1, 11.104, -6.504)


def test_matrix_market(spark, tmp_path):
    p = put(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate integer general\n% note\n3 2 2\n1 1 5\n3 2 7\n")
    entries, head = text.read_matrix_market(spark, p)
    assert sorted(map(tuple, entries.collect())) == [(1, 1, 5.0), (3, 2, 7.0)] and head.head().ok
    bad = put(tmp_path / "n.mtx", "%%MatrixMarket matrix coordinate integer general\n3 2 9\n1 1 5\n")
    assert not text.read_matrix_market(spark, bad)[1].head().ok


def test_markdown_and_xml(spark, tmp_path):
    df = spark.createDataFrame([(1, "# t\n## One\n| a | b |\n|---|---|\n| 1 | 2 |\n## Two\nx")], "id int, t string")
    got = text.markdown_sections(df, "id", "t").orderBy("i")
    assert [r.title for r in got.collect()] == ["One", "Two"]
    assert got.select(text.markdown_cells(F.col("body")).alias("c")).head().c == [["a", "b"], ["1", "2"]]
    x = put(tmp_path / "t.xml", "<t><tr><a>1</a></tr><tr><a>2</a></tr></t>")
    assert [r.a for r in text.read_xml_rows(spark, x, "tr", "a int").orderBy("a").collect()] == [1, 2]


def workbook():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>gene</t></si><si><r><t>EN</t></r><r><t>O1</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>fc</t></is></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_archives(spark, tmp_path):
    p = put(tmp_path / "b.xlsx", workbook())
    cells = archives.read_xlsx(spark, p, "S")
    assert archives.sheet_table(cells, ["gene", "fc"]).select("gene", "fc").head() == ("ENO1", "2.5")
    with pytest.raises(Exception, match="hidden or computed"):
        archives.sheet_table(cells, ["gene", "x"]).collect()
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        info = tarfile.TarInfo("d/a.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    put(tmp_path / "a.tar.gz", raw.getvalue())
    assert [(r.member, bytes(r.content)) for r in archives.read_tar(spark, f"file://{tmp_path}/a.tar.gz", r".*\.txt").collect()] == [("d/a.txt", b"hi")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, None), (2, float("nan"), "x")], "id int, v double, s string")
    sinks.write_csv(df.orderBy("id"), f"file://{tmp_path}/o", {"v": "%.3f"})
    part = next((tmp_path / "o").glob("part-*"))
    assert part.read_text().splitlines() == ["id,v,s", "1,0.100,", "2,NaN,x"]
    with pytest.raises(Exception, match="not finite"):
        sinks.write_json(df, f"file://{tmp_path}/j")
    sinks.write_json(df.filter("id = 1"), f"file://{tmp_path}/k")
    sinks.write_json(df.filter("id = 1").repartition(4), f"file://{tmp_path}/m", one_file=False)
    for folder in ("k", "m"):
        lines = [x for part in (tmp_path / folder).glob("part-*") for x in part.read_text().splitlines()]
        assert [json.loads(x) for x in lines] == [{"id": 1, "v": 0.1}]
    assert sinks.markdown(df.filter("id = 1").select("id", "v")) == "| id | v |\n|---|---|\n| 1 | 0.1 |"


def test_streams_equal_tables(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.event_stream(spark, f"{tmp_path}/in", table.schema)
    for k, plan in enumerate((lambda e: events.windowed_counts(e, "1 day", "12 hours"), lambda e: events.user_sessions(e, "2 hours"))):
        q = plan(stream).writeStream.outputMode("complete" if k == 0 else "append").format("memory").queryName(f"s{k}").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(f"s{k}").selectExpr("*").drop("total")
        want = plan(table).drop("total")
        if k == 0:
            assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
        else:  # sessions that the watermark has not closed stay open
            assert got.count() > 0 and got.exceptAll(want).count() == 0
    log = spark.createDataFrame([("A", 1, "ok"), ("A", 10, "failed"), ("B", 2, "failed"), ("B", 9, "ok")], "well string, id int, status string")
    assert [tuple(r) for r in events.terminal_failures(log, "well", "id", "status").collect()] == [("A", 10)]


def test_fasta_in_byte_ranges(spark, tmp_path):
    """One long contig over many splits, contigs of equal names, empty ones, blank lines and both line ends."""
    import numpy as np

    from tessella.sources import text

    rng = np.random.default_rng(91)
    seqs = ["".join(rng.choice(list("ACGTN"), n)) for n in (60_000, 0, 7, 100, 200)]
    names = ["long", "none", "twin", "twin", "last"]
    for f, eol in (("a", "\n"), ("b", "\r\n")):
        lines = ["no header yet"]
        for name, s in zip(names, seqs, strict=True):
            lines += [f">{name} described here", *(s[i : i + 61].lower() for i in range(0, len(s), 61)), ""]
        (tmp_path / f"{f}.fa").write_text(eol.join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(f"{tmp_path}/*.fa").rdd.getNumPartitions() > 20
        got = text.fasta_chunks(spark, f"{tmp_path}/*.fa", 100, 30).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for f in "ab":
        own = {(r.record, r.contig, r.chunk, r.offset): r.seq for r in got if r.file.endswith(f"{f}.fa")}
        want = {(k, n, c, c * 100): s[c * 100 : c * 100 + 130] for k, (n, s) in enumerate(zip(names, seqs, strict=True), 1) for c in range(-(-len(s) // 100))}
        assert own == want
