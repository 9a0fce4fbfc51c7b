"""Whole analyses, genome operators and checks on tables with known answers."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import genome, sequence, validate
from tessella.plans import tasks


def test_guide_ranking(spark):
    guides = spark.createDataFrame([("a", "ACGT" * 5, 0.9, 0), ("b", "ACGT" * 5, 0.8, 0), ("c", "ACGT" * 5, 0.7, 0), ("d", "NNNN", 1.0, 0)], "guide_id string, spacer string, activity_score double, coding_bystander_count int")
    hits = spark.createDataFrame([("a", 1, "coding_exon", "low"), ("b", 2, "coding_exon", "low")], "guide_id string, mismatches int, region string, expression_risk string")
    got = [(r.guide_id, r.risk_class) for r in tasks.guide_ranking(guides, hits).orderBy("rank").collect()]
    assert got == [("c", "low"), ("b", "high"), ("a", "critical"), ("d", "low")]


def test_primer_audit(spark):
    primers = spark.createDataFrame([("p1", "ACG", "ATCC", "T1", 12), ("p2", "ACG", "ATCC", "T1", 99), ("p3", "TTTTTT", "AAAAAA", "T1", 5)], "pair_id string, forward string, reverse string, expected_transcript string, expected_product_bp int")
    transcripts = spark.createDataFrame([("T1", "TTACGTACCCGGATT"), ("T2", "CCCC")], "name string, seq string")
    assert {r.pair_id: r.status for r in tasks.primer_audit(primers, transcripts).collect()} == {"p1": "as_claimed", "p2": "other_product", "p3": "no_product"}


def test_orf_audit(spark):
    df = spark.createDataFrame([("ok", "ATGAAATAA", "N-tag", "in-frame"), ("bad", "TTGAA", "C-tag", "out")], "id string, s string, tag string, frame string")
    got = {r.id: r.issues for r in sequence.orf_audit(df, "s", "tag", "frame").collect()}
    assert got == {"ok": [], "bad": ["start_invalid", "stop_invalid", "frame_invalid"]}


def test_structure_ranking(spark):
    m = spark.createDataFrame([("A", 0.9, 0.8, 2.0, 100, True), ("B", 0.95, 0.8, 2.0, 100, False), ("C", 0.9, 0.8, 2.0, 90, True)], "model_id string, tm_score double, lddt double, rmsd_a double, aligned_residues int, chain_mapping_complete boolean")
    e = spark.createDataFrame([("A", 1, 190, 4.0), ("A", 191, 300, 6.0), ("C", 1, 50, 9.0)], "model_id string, residue_start int, residue_end int, mean_error_a double")
    got = tasks.structure_ranking(m, e, (181, 240)).orderBy("rank").collect()
    assert [r.model_id for r in got] == ["A", "C", "B"] and got[0].local_risk == pytest.approx((10 * 4 + 50 * 6) / 60) and got[1].local_risk is None


@pytest.mark.parametrize("model", ["log1p", "raw"])
def test_contact_integration(spark, model):
    rng = np.random.default_rng(0)
    rows = [(f"b{i}", "background", int(d), *[int(max(0, 200 - 30 * np.log10(d) + e)) for e in rng.normal(0, 2, 3)]) for i, d in enumerate(rng.integers(10**4, 10**6, 80))]
    rows += [("x", "candidate", 10**5, 150, 150, 150), ("y", "candidate", 10**5, 120, 120, 120), ("z", "candidate", 10**5, 50, 50, 50)]
    contacts = spark.createDataFrame(rows, "pair_id string, set string, distance_bp long, count_rep1 int, count_rep2 int, count_rep3 int")
    e = [(p, g, c, k, v if c == "perturbed" else 100) for p, v in (("x", 20), ("y", 60), ("z", 99)) for g in ("g1", "g2") for c in ("control", "perturbed") for k in (1, 2)]
    got = [r.pair_id for r in tasks.contact_integration(contacts, spark.createDataFrame(e, "pair_id string, guide_id string, condition string, replicate int, rna_count int"), model).orderBy("rank").collect()]
    assert got == (["x", "y"] if model == "log1p" else ["x", "y", "z"])


def test_plate_recovery(spark):
    d = Decimal
    plates = spark.createDataFrame([("B1", "c", d(1), d(100)), ("B2", "c", d(2), d(100))], "well string, compound_id string, requested_final_uM decimal(18,6), requested_final_volume_uL decimal(18,6)")
    log = spark.createDataFrame([(1, "dispense", "completed", "B1"), (2, "dispense", "failed", "B2")], "event_id int, operation string, status string, well string")
    inventory = spark.createDataFrame([("A2", "c", d(100), d(50)), ("W", None, None, d(900))], "source string, compound_id string, concentration_uM decimal(18,6), available_volume_uL decimal(18,6)")
    pipettes = spark.createDataFrame([("p20", d(1), d(20), d("0.5")), ("p300", d(20), d(300), d(1))], "pipette string, min_ul decimal(18,6), max_ul decimal(18,6), increment_ul decimal(18,6)")
    got = tasks.plate_recovery(plates, log, inventory, pipettes).collect()
    assert [(r.destination, float(r.transfer_uL), r.transfer_pipette, float(r.diluent_uL), r.diluent_pipette, r.enough) for r in got] == [("B2", 2.0, "p20", 98.0, "p300", True)]


def test_cell_composition(spark):
    counts = spark.createDataFrame([("c1", "g1", 9), ("c1", "g3", 1), ("c2", "g2", 5), ("c3", "g9", 4)], "cell string, gene string, n int")
    cells = spark.createDataFrame([("c1", "s"), ("c2", "s"), ("c3", "s")], "cell string, sample string")
    panel = spark.createDataFrame([("A", "g1, g3", 0), ("B", "g2", 1), ("C", "g7", 2)], "cell_type string, markers string, i int")
    got = {r.cell_type: (r.n_cells, round(r.fraction, 3)) for r in tasks.cell_composition(counts, cells, panel).collect()}
    assert got == {"A": (2, 0.667), "B": (1, 0.333), "C": (0, 0.0)}  # a cell without markers goes to the first


def test_expression_and_enrichment(spark):
    counts = spark.createDataFrame([("a", "s1", 50), ("b", "s1", 3), ("c", "s1", 90)], "gene string, sample string, n int")
    results = spark.createDataFrame([("a", 2.0, 0.01), ("b", 3.0, 0.01), ("c", -1.5, None)], "gene string, log2fc double, padj double")
    names = spark.createDataFrame([("a", "AA"), ("a", "AB")], "gene string, symbol string")
    assert {r.gene: (r.symbol, r.passed, r.direction) for r in tasks.expression_passes(counts, results, names).collect()} == {"a": ("AA", True, "up"), "b": ("", False, "up"), "c": ("", False, "down")}
    g = lambda *x: spark.createDataFrame([(i,) for i in x], "gene string")
    sets = spark.createDataFrame([("T", "a"), ("T", "b"), ("U", "z")], "term string, gene string")
    got = tasks.over_representation(g("a", "b"), sets, g(*"abcdefghij")).collect()
    assert [(r.term, r.k, round(r.p, 6), r.genes) for r in got] == [("T", 2, round(1 / 45, 6), "a;b")]


def test_lagged_contacts(spark):
    rows = [(c, t, 0.0, 0.0, 0.0, 100.0 if (t + c) % 3 else 400.0, 0.0, 0.0, int((t - 1 + c) % 3 != 0)) for c in range(3) for t in range(30)]
    cells, lags = tasks.lagged_contacts(spark.createDataFrame(rows, "cell_id int, time int, enh_x double, enh_y double, enh_z double, prom_x double, prom_y double, prom_z double, transcription int"), most_lag=1)
    assert cells.head().contact_fraction == pytest.approx(2 / 3)
    best = lags.orderBy(F.desc("association")).head()
    assert best.lag == 1 and best.association == pytest.approx(1.0) and best.n_observations == 87


def test_column_match(spark):
    rng = np.random.default_rng(1)
    x, perm = rng.normal(size=(40, 4)), [2, 0, 3, 1]
    left = spark.createDataFrame([(f"f{i}", f"r{j}", float(x[i, j])) for i in range(40) for j in range(4)], "feature string, column string, value double")
    right = spark.createDataFrame([(f"f{i}", f"c{j}", float(x[i, perm[j]] + 0.1 * rng.normal())) for i in range(40) for j in range(4)], "feature string, column string, value double")
    assert {(r.row, r.col) for r in tasks.column_match(left, right, 30).collect()} == {(f"r{perm[j]}", f"c{j}") for j in range(4)}


def test_response_and_power(spark):
    rng = np.random.default_rng(2)
    rows = [("PR" if rng.random() < 1 / (1 + np.exp(-(a - 50) / 5)) else "SD", str(a), "F" if i % 2 else "M") for i, a in enumerate(rng.integers(30, 70, 400))] + [("PR", "", "F")]
    got = {r.term: r for r in tasks.response_model(spark.createDataFrame(rows, "e string, age string, sex string"), "e", "PR", ["age"], {"sex": "F"}).collect()}
    assert set(got) == {"(intercept)", "age", "sex"} and got["age"].odds_ratio > 1.1
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(0, 1, 50)] + [("b", float(v)) for v in rng.normal(1, 1, 50)], "g string, v double")
    assert 8 < tasks.power_summary(df, "g", "b", "a", "v").head().n_per_group < 60


# ------------------------------------------------------------------- genome


def test_mapping_and_deletion(spark):
    rng = np.random.default_rng(3)
    g = "".join(rng.choice(list("ACGT"), 3000))
    chunks = sequence.chunked(spark.createDataFrame([("c", g)], "contig string, s string"), "contig", "s", 256, 63).withColumnRenamed("contig", "contig")
    reads = [(f"r{p}", g[p : p + 50]) for p in range(0, 2900, 97)]
    table = spark.createDataFrame(reads, "read string, seq string")
    votes = genome.seed_votes(table, genome.reference_kmers(chunks, 16), 16, 5, 3)
    placed = genome.verified(genome.best_placement(votes, 0.5), table, chunks, 256, 2)
    assert {r.read: (r.strand, r.diagonal, r.mismatches) for r in placed.collect()} == {n: ("+", int(n[1:]), 0) for n, _ in reads}

    depth = [("c", s, s + 50) for s in range(0, 1000, 10)] + [("c", s, s + 50) for s in range(2000, 2950, 10)]
    mappable = spark.createDataFrame([("c", b, 100) for b in range(0, 3000, 100)], "contig string, bin long, mappable int")
    runs = genome.low_runs(genome.normalised_depth(spark.createDataFrame(depth, "contig string, start long, end long"), mappable, 100), 100, 0.3).filter("rank = 1")
    pairs = spark.createDataFrame([("c", p, p + 300 + p % 7, "+", "-") for p in range(100, 600, 20)] + [("c", 980, 2030, "+", "-"), ("c", 990, 2020, "+", "-")], "contig string, pos1 long, pos2 long, strand1 string, strand2 string")
    call = genome.deletions(runs, genome.spanning_pairs(pairs), 150).head()
    assert (call.left, call.right, call.pairs) == (990, 2020, 2)


def test_consequences(spark):
    coding = genome.cds_positions(spark.createDataFrame([("c", "T", "+", 100, 104), ("c", "T", "+", 200, 205), ("c", "M", "-", 300, 309)], "chrom string, transcript string, strand string, start long, end long"))
    seqs = spark.createDataFrame([("T", "ATGTACTAA"), ("M", "ATGTACTAA")], "transcript string, cds string")
    variants = spark.createDataFrame([("c", 201, "C", "A"), ("c", 103, "T", "G"), ("c", 303, "G", "T"), ("c", 100, "A", "C")], "chrom string, pos long, ref string, alt string")
    got = {(r.pos, r.transcript): r.effect for r in genome.worst_effect(genome.consequence(variants, coding, seqs)).collect()}
    assert got == {(201, "T"): "stop_gained", (103, "T"): "missense", (303, "M"): "stop_gained", (100, "T"): "start_lost"}


def test_cryptic_exon(spark):
    exons = spark.createDataFrame([("c", "T", "G", 0, 100), ("c", "T", "G", 1000, 1100)], "chrom string, transcript string, gene string, start long, end long")
    known = genome.introns(exons)
    assert [(r.start, r.end) for r in known.collect()] == [(100, 1000)]
    seen = spark.createDataFrame([("c", 100, 1000, 50), ("c", 100, 400, 9), ("c", 450, 1000, 7), ("c", 402, 1000, 3)], "chrom string, start long, end long, reads int")
    best = genome.cryptic_exons(genome.novel(seen, known), spark.createDataFrame([("c", "G", 0, 1100)], "chrom string, gene string, start long, end long")).filter("rank = 1").head()
    assert (best.exon_start, best.exon_end, best.support, best.tied) == (400, 450, 7, 1)


def test_split_and_segments(spark):
    reads = spark.createDataFrame([("r", "AAAACCCC", "AAAATTTT", "GGGGCCCC")], "read string, seq string, l string, r string")
    assert [x.at for x in genome.split_reads(reads, "l", "r", "seq", 2).collect()] == [4]
    got = genome.extended_segments(reads.select("read", "seq"), "TTAAAACCTT", 4).head()
    assert (got.at, got.pos, got.length) == (0, 2, 6)


# ------------------------------------------------------------------- checks


def test_table_checks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, -1.0), (None, 3.0)], "id int, v double")
    assert {r.rule: r.n for r in validate.violations(df, ["id"], ["id"], ["v"]).collect()} == {"repeated id": 1, "missing id": 1, "not positive v": 1}
    with pytest.raises(Exception, match="v_positive"):
        validate.demand(df, v_positive=F.col("v") > 0).collect()
    assert validate.bijection(df, "id", "v", 3).head().ok is False
    ids = spark.createDataFrame([("guide_TP53_1",), ("g2",)], "g string")
    assert [r.leaked for r in validate.leaks(ids, spark.createDataFrame([("TP53",)], "t string"), "g", "t").collect()] == [["tp53"]]


def test_json_leaves_and_scripts(spark):
    docs = spark.createDataFrame([(1, '{"build": "hg38", "x": [{"rate": 0.5}, {"rate": 1}]}'), (2, "{"), (3, '{"a": NaN}')], "id int, t string")
    leaves = validate.leaf_rows(docs, "id", "t")
    got = {(r.key, r.path): (r.name, r.number, r.inherited) for r in leaves.collect()}
    assert got[(1, "$.x[1].rate")] == ("rate", 1.0, '{"build": "hg38"}') and got[(2, "$")][0] == "!" and got[(3, "$.a")][0] == "!"
    assert {r.name: r.value for r in validate.last_leaves(leaves).filter("key = 1").collect()} == {"build": "hg38", "rate": "1"}
    code = "import x\ny = read('/data/truth')\nz = y + 1\nfit(z)\nfit(3)\n"
    facts = validate.script_facts(spark.createDataFrame([(code,), ("def (",)], "s string"), "s", ["read", "/data/truth"], ["fit"]).collect()
    assert facts[0].facts.syntax_ok and facts[0].facts.absolute_paths == ["/data/truth"] and facts[0].facts.tainted == ["fit"] and not facts[1].facts.syntax_ok
    files = spark.createDataFrame([("a.json", b"{}"), ("b.json", b"{"), ("c.png", bytes.fromhex("89504e470d0a1a0a")), ("d.csv", b"h\n")], "n string, c binary")
    assert [r[0] for r in files.select(validate.artifact_ok(F.col("n"), F.col("c"))).collect()] == [True, False, True, False]


def test_words_and_spaces_of_sql(spark):
    from tessella.functions import evidence

    texts = ["the\u00e9 no", "\u00e9lan th\u00e9", "x?\x0bno and", "the w\u0130thout", "n\u00f3 the", "not\u00fc the. and no\u0661"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.affirmed, r.denied, r.sentences) for r in evidence.asserted(df, "i", "t", "the|and").collect()}
    assert got == {0: (False, True, 1), 1: (False, False, 1), 2: (False, True, 1), 3: (False, True, 1), 4: (True, False, 1), 5: (False, True, 2)}


def test_realigned_seeds_are_not_planned_by_their_source(spark):
    t = "ACGTTGCAAGGCTTAACCGATCGGATATCCGTAGCTAACGTTCGA"
    reads = spark.createDataFrame([("r", t[2:40])], "read string, seq string")
    out = genome.realigned(reads, spark.createDataFrame([("T", t)], "transcript string, seq string"))
    assert [(r.transcript, r.start, r.mismatches) for r in out.collect()] == [("T", 2, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # the strands alone; seeds are a table


def test_one_window_is_broadcast(spark):
    from tessella import plans

    joined = plans.QUERIES["weighted_interval_mean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined


def test_scanned_clusters_without_contig_or_position(spark, tmp_path):
    from tessella import plans

    rows = [(1, 10.0), (1, 1600.0), (1, None), (None, 5.0), (1, 10.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["scanned_clusters"](spark, str(tmp_path)).select("contig", "at", "cluster", "opened").collect()
    assert sorted(map(tuple, got)) == [(1, 10, 1, 1), (1, 1600, 2, 2)]


def test_realigned_finds_every_place_and_broadcasts_nothing(spark):
    t = "ACGTTGCAAGGCTTAACCGATCGGATATCCGTAGCTAACGTTCGA"
    read = t[2:42]
    lost = read[:11] + "C" + read[12:25] + "C" + read[26:]  # each seed of twelve bases, five apart, holds one of the changes
    assert sum(a != b for a, b in zip(read, lost, strict=True)) == 2
    repeats = "ACGTACGGTCATTGCAGGCTAACGT" * 14 + "ACGTACGGTCATTGCAGGCTTTCGT" + "ACGTACGGTCATTGC"  # many starts of equal votes; the unchanged place is the last of them
    last = repeats[-40:]
    reads = spark.createDataFrame([("lost", lost), ("last", last), ("short", t[3:17])], "read string, seq string")
    transcripts = spark.createDataFrame([("T", t, [20, 45]), ("R", repeats, [len(repeats)])], "transcript string, seq string, joints array<long>")
    rows = [r for r in reads.collect() if r.read != "short"]
    for some in (reads, reads.filter("read <> 'short'")):
        placed = genome.realigned(some, transcripts)
        got = {(r.read, r.transcript): (r.start, r.mismatches) for r in placed.collect() if r.read != "short"}
        whole = {}
        for r in rows:
            for name, s in (("T", t), ("R", repeats)):
                at = [(sum(a != b for a, b in zip(r.seq, s[i:], strict=False)), i) for i in range(len(s) - 39)]
                if min(at)[0] <= 2:
                    whole[r.read, name] = min(at)[::-1]
        if some is not reads:  # seeds in parts find all places; a short read makes them shorter, not fewer
            assert got == whole and got["lost", "T"] == (2, 2) and got["last", "R"] == (len(repeats) - 40, 0)
        assert got == whole
    plan = genome.exon_support(placed, transcripts, reads, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_transcript_support_broadcasts_no_exploded_rows(spark):
    from tessella import plans

    joined = plans.QUERIES["transcript_support"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    g = spark.range(3).selectExpr("concat('c', id) AS contig", "repeat('ACGT', 100) AS s")
    sites = g.selectExpr("contig", "explode(array(0L, 130L)) AS at")
    found = sequence.reference_lookup(sites, sequence.chunked(g, "contig", "s", 128, 8), "contig", "at", F.lit(5), 128)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.at, r.reference) for r in found.collect()} == {(0, "ACGTA"), (130, "GTACG")}
