"""Whole analyses as plans over tables: rankings, audits, integration, recovery, annotation.

Each takes DataFrames and returns one. Where a written rule and its usual
grading differ, the rule is the default and the other is an option.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import mixtures, ordered, sequence, solvers, stats


def guide_ranking(guides: DataFrame, hits: DataFrame) -> DataFrame:
    """Guides by the risk of their off-target hits, then activity: ``rank, guide_id, activity_score, risk_class``.

    Guides: guide_id, spacer, activity_score, coding_bystander_count. Hits:
    guide_id, mismatches, region, expression_risk. A guide without hits is low.
    """
    exon = F.lower("region").contains("exon")
    facts = hits.groupBy("guide_id").agg(
        F.bool_or(exon & (F.col("mismatches") <= 1)).alias("_critical"),
        F.bool_or(exon & (F.col("mismatches") <= 2)).alias("_high"),
        F.bool_or((F.lower("expression_risk") == "high") & (F.col("mismatches") <= 2)).alias("_expressed"),
        F.bool_or(F.col("mismatches") <= 3).alias("_medium"),
    )
    joined = guides.join(facts, "guide_id", "left")
    risk = F.when(F.col("_critical"), "critical").when(F.col("_high") | F.col("_expressed"), "high").when(F.col("_medium"), "medium").otherwise("low")
    place = F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("risk_class"))
    valid = joined.withColumn("risk_class", risk).withColumn("valid", sequence.is_dna(F.col("spacer"), 20))
    order = [F.desc("valid"), place, F.asc("coding_bystander_count"), F.desc("activity_score"), F.asc("guide_id")]
    return ordered.ranked(valid, order).select("rank", "guide_id", "activity_score", "risk_class", "valid")


def primer_audit(primers: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Products of each primer pair in each transcript against what is claimed.

    Primers: pair_id, forward, reverse, expected_transcript, expected_product_bp.
    Transcripts: name, seq. Both tables are short; every pair meets every
    transcript.
    """
    each = primers.crossJoin(F.broadcast(transcripts)).select("pair_id", "expected_transcript", "expected_product_bp", "name", F.explode(sequence.amplicons(F.col("seq"), F.upper("forward"), F.upper("reverse"))).alias("a"))
    found = each.groupBy("pair_id").agg(F.array_sort(F.collect_set(F.struct(F.col("name").alias("transcript"), F.col("a.size").alias("product_bp")))).alias("products"))
    joined = primers.join(found, "pair_id", "left").withColumn("products", F.coalesce("products", F.array().cast("array<struct<transcript:string,product_bp:int>>")))
    right = F.exists("products", lambda p: (p.transcript == F.col("expected_transcript")) & (p.product_bp == F.col("expected_product_bp")))
    status = F.when(F.size("products") == 0, "no_product").when(F.size("products") > 1, "ambiguous").when(right, "as_claimed").otherwise("other_product")
    return joined.select("pair_id", "products", status.alias("status"))


def structure_ranking(metrics: DataFrame, errors: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Models by completeness, similarity and local risk; the risk is the mean error weighted by overlap with a window (inclusive)."""
    low, high = window
    overlap = F.least(F.col("residue_end"), F.lit(high)) - F.greatest(F.col("residue_start"), F.lit(low)) + 1
    risk = errors.withColumn("_w", overlap).filter("_w > 0").groupBy("model_id").agg((F.sum(F.col("mean_error_a") * F.col("_w")) / F.sum("_w")).alias("local_risk"))
    order = [F.desc("chain_mapping_complete"), F.desc("tm_score"), F.desc("lddt"), F.asc("rmsd_a"), F.desc("aligned_residues"), F.asc_nulls_last("local_risk"), F.asc("model_id")]
    return ordered.ranked(metrics.join(risk, "model_id", "left"), order).select("rank", "model_id", "local_risk")


def contact_integration(contacts: DataFrame, expression: DataFrame, model: str = "log1p", least_z: float = 1.645) -> DataFrame:
    """Pairs with contact beyond distance and an effect of perturbation, by their product or by mean rank.

    Contacts: pair_id, set, distance_bp, count_rep1..3. Expression: pair_id,
    guide_id, condition, replicate, rna_count. ``model``: ``log1p`` fits the
    log of the mean count and ranks by the product of robust z and effect;
    ``raw`` fits the mean count and ranks by the mean of two ranks.
    """
    reps = [c for c in contacts.columns if c.startswith("count_rep")]
    mean = sum((F.col(c) for c in reps[1:]), F.col(reps[0])) / len(reps)
    own = contacts.withColumn("_x", F.log10(F.col("distance_bp").cast("double"))).withColumn("_y", F.log1p(mean) if model == "log1p" else mean.cast("double"))
    background = own.filter("set = 'background'")
    left = stats.residuals(own, stats.line_fit(background, [], "_y", "_x"), "_y", "_x")
    centre = stats.mad(left.filter("set = 'background'"), [], "residual")
    scored = left.filter("set <> 'background'").crossJoin(F.broadcast(centre)).withColumn("contact_evidence", F.try_divide(F.col("residual") - F.col("median"), F.col("mad")))
    means = expression.groupBy("pair_id", "guide_id").pivot("condition", ["control", "perturbed"]).agg(F.avg("rna_count"))
    effect = means.withColumn("_e", F.log2((F.col("control") + 1) / (F.col("perturbed") + 1))).groupBy("pair_id").agg(F.median("_e").alias("perturbation_effect"))
    both = scored.join(effect, "pair_id").withColumn("eligible", F.col("contact_evidence") >= least_z)
    if model == "log1p":
        out = both.filter("eligible").withColumn("combined_support", F.col("contact_evidence") * F.col("perturbation_effect"))
        return ordered.ranked(out, [F.desc("combined_support"), F.asc("pair_id")]).select("rank", "pair_id", "contact_evidence", "perturbation_effect", "combined_support")
    out = ordered.mean_rank(both, [F.desc("contact_evidence"), F.asc("pair_id")], [F.desc("perturbation_effect"), F.asc("pair_id")], [], "combined_support")
    return ordered.ranked(out, [F.asc("combined_support"), F.asc("pair_id")]).select("rank", "pair_id", "contact_evidence", "perturbation_effect", "combined_support")


def plate_recovery(plates: DataFrame, log: DataFrame, inventory: DataFrame, pipettes: DataFrame) -> DataFrame:
    """Transfers that finish a plate whose run broke off: wells not completed, source and diluent volumes, and the one pipette that fits.

    Plates: well, compound_id, requested_final_uM, requested_final_volume_uL.
    Log: event_id, operation, status, well. Inventory: source, compound_id,
    concentration_uM, available_volume_uL (the diluent has no compound).
    Pipettes: pipette, min_ul, max_ul, increment_ul. All are decimals.
    """
    done = log.filter("operation = 'dispense' AND status = 'completed'").select("well").distinct()
    open_ = plates.join(done, "well", "left_anti")
    sources = inventory.filter("compound_id IS NOT NULL").select("compound_id", "source", "concentration_uM", "available_volume_uL")
    joined = open_.join(sources, "compound_id").withColumn("transfer_uL", (F.col("requested_final_uM") * F.col("requested_final_volume_uL") / F.col("concentration_uM")).cast("decimal(18,6)"))
    joined = joined.withColumn("diluent_uL", (F.col("requested_final_volume_uL") - F.col("transfer_uL")).cast("decimal(18,6)"))

    def pipette(df: DataFrame, volume: str, name: str) -> DataFrame:
        p = pipettes.select(F.col("pipette").alias(name), "min_ul", "max_ul", "increment_ul")
        fits = df.join(p, (F.col(volume) >= F.col("min_ul")) & (F.col(volume) <= F.col("max_ul")) & (F.col(volume) % F.col("increment_ul") == 0), "left")
        one = fits.withColumn("_n", F.count(name).over(Window.partitionBy("well")))
        return one.withColumn(name, F.when(F.col("_n") == 1, F.col(name))).drop("_n", "min_ul", "max_ul", "increment_ul").dropDuplicates(["well"])

    planned = pipette(pipette(joined, "transfer_uL", "transfer_pipette"), "diluent_uL", "diluent_pipette")
    demand = planned.withColumn("_need", F.sum("transfer_uL").over(Window.partitionBy("source")))
    out = demand.withColumn("enough", F.col("_need") <= F.col("available_volume_uL"))
    return ordered.ranked(out, [F.asc("well")], (), "step").select("step", "source", F.col("well").alias("destination"), "transfer_uL", "transfer_pipette", "diluent_uL", "diluent_pipette", "enough")


def cell_composition(counts: DataFrame, cells: DataFrame, panel: DataFrame) -> DataFrame:
    """Label each cell by the marker set with the highest mean normalised expression, and count labels by sample.

    Counts: cell, gene, n (zeros left out). Cells: cell, sample. Panel: cell_type,
    markers, i; a comma list, and the order that breaks ties. Labels without
    cells count zero.
    """
    markers = panel.select("cell_type", "i", F.explode(F.transform(F.split("markers", ","), lambda m: F.trim(m))).alias("gene"))
    size = markers.groupBy("cell_type", "i").agg(F.countDistinct("gene").alias("_k"))
    norm = stats.log_normalised(counts, "cell", "n")
    sums = norm.join(F.broadcast(markers), "gene").groupBy("cell", "cell_type").agg(F.sum("log_norm").alias("_s"))  # a panel is a short list
    every = cells.crossJoin(F.broadcast(size)).join(sums, ["cell", "cell_type"], "left").withColumn("score", F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_k"))
    label = every.groupBy("cell", "sample").agg(F.max_by("cell_type", F.struct("score", -F.col("i"))).alias("cell_type"))
    frame = cells.select("sample").distinct().crossJoin(F.broadcast(panel.select("cell_type")))
    n = stats.counts_with_zeros(label, frame, ["sample", "cell_type"], "n_cells")
    return n.withColumn("fraction", stats.share_of("n_cells", ["sample"]))


def expression_passes(counts: DataFrame, results: DataFrame, names: DataFrame, least: int = 10, fold: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Genes that are expressed, whose change is large and significant; symbols by the first entry of each id.

    Counts: gene, sample, n. Results: gene, log2fc, padj. Names: gene, symbol.
    """
    expressed = counts.groupBy("gene").agg(F.bool_or(F.col("n") > least).alias("expressed"))
    first = names.groupBy("gene").agg(F.min("symbol").alias("symbol"))
    passed = F.coalesce((F.abs("log2fc") >= fold) & (F.col("padj") < alpha), F.lit(False)) & F.col("expressed")
    out = results.join(expressed, "gene").join(first, "gene", "left")
    return out.select("gene", F.coalesce("symbol", F.lit("")).alias("symbol"), "log2fc", "padj", passed.alias("passed"), F.when(F.col("log2fc") > 0, "up").when(F.col("log2fc") < 0, "down").otherwise("none").alias("direction"))


def over_representation(hits: DataFrame, sets: DataFrame, background: DataFrame) -> DataFrame:
    """Gene sets among hits, by hypergeometric tail, adjusted: ``term, k, set_size, n_hits, total, p, adjusted, genes``."""
    universe = background.select("gene").distinct()
    own = hits.select("gene").distinct().join(universe, "gene", "left_semi")
    known = sets.select("term", "gene").distinct().join(universe, "gene", "left_semi")
    sizes = known.groupBy("term").agg(F.count(F.lit(1)).alias("set_size"))
    found = known.join(own, "gene").groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("genes"))
    totals = universe.agg(F.count(F.lit(1)).alias("total")).crossJoin(own.agg(F.count(F.lit(1)).alias("n_hits")))
    rows = found.join(sizes, "term").crossJoin(F.broadcast(totals))
    return ordered.benjamini_hochberg(solvers.hypergeometric(rows, "k", "n_hits", "set_size", "total"), "p", [], ["term"])


def lagged_contacts(series: DataFrame, contact_nm: float = 260.0, most_lag: int = 20) -> tuple[DataFrame, DataFrame]:
    """Means of each cell's distance, contact and transcription, and contact against transcription at lags.

    Series: cell_id, time, enh_x..z, prom_x..z, transcription.
    """
    d = F.sqrt(sum(((F.col(f"enh_{a}") - F.col(f"prom_{a}")) ** 2 for a in "yz"), (F.col("enh_x") - F.col("prom_x")) ** 2))
    rows = series.withColumn("distance", d).withColumn("contact", (F.col("distance") <= contact_nm).cast("double")).withColumn("active", F.col("transcription").cast("double"))
    cells = rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_timepoints"), F.avg("distance").alias("mean_distance_nm"), F.avg("contact").alias("contact_fraction"), F.avg("active").alias("transcription_fraction"))
    from ..operators.joins import lag_correlation

    lags = lag_correlation(rows, ["cell_id"], "time", "contact", "active", range(-most_lag, most_lag + 1))
    return cells, lags.select("lag", F.col("r").alias("association"), F.col("n").alias("n_observations"))


def column_match(left: DataFrame, right: DataFrame, features: int = 2000) -> DataFrame:
    """Match columns of two matrices by correlation over the features that vary most on the left.

    Both: feature, column, value, in long form. Returns the one-to-one match
    with each row's runner-up score.
    """
    shared = right.select("feature").distinct()
    top = left.join(shared, "feature", "left_semi").groupBy("feature").agg(F.var_pop("value").alias("_v")).orderBy(F.desc("_v"), "feature").limit(features).select("feature")
    a = left.join(top, "feature", "left_semi").select("feature", F.col("column").alias("row"), F.col("value").alias("x"))
    b = right.select("feature", F.col("column").alias("col"), F.col("value").alias("y"))
    scores = a.join(b, "feature").groupBy("row", "col").agg(stats.pearson("x", "y").alias("weight")).na.fill(0.0)
    second = ordered.top_two(scores, ["row"], "weight", "col").select("row", "runner_up_score")
    return solvers.assignment(scores, "row", "col", "weight").join(second, "row").select("row", "col", F.col("weight").alias("match_score"), "runner_up_score")


def power_summary(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """Effect size of two groups and the group size that 80 % power takes."""
    row = stats.effect_size(df, group, first, second, value).head()
    n = solvers.minimum_n(row.d) if row.d else None
    return df.sparkSession.createDataFrame([(row.mean1, row.mean2, row.sd1, row.sd2, row.pooled_sd, row.d, n)], "mean1 double, mean2 double, sd1 double, sd2 double, pooled_sd double, d double, n_per_group int")


def response_model(df: DataFrame, outcome: str, positive: str, numeric: list[str], flags: dict[str, str]) -> DataFrame:
    """Logistic model of an outcome on complete cases; ``flags`` name a text column's level that counts one."""
    columns = [outcome, *numeric, *flags]
    whole, _ = coerce.complete_cases(df.select(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]), columns)
    rows = whole.select((F.col(outcome) == positive).cast("int").alias("_outcome"), *[coerce.number(F.col(c)).alias(c) for c in numeric], *[(F.col(c) == v).cast("int").alias(c) for c, v in flags.items()])
    return solvers.logistic(rows, "_outcome", [*numeric, *flags])


def deconvolution(spots: DataFrame, profiles: DataFrame, cells: DataFrame, gain: float = 0.01, nearest: int = 100) -> DataFrame:
    """What each spot is a mixture of: ``spot, model, kinds, r2, label, label_share, agrees``.

    Spots: spot, feature, value. Profiles: kind, feature, value. Cells: cell,
    kind, feature, value. The model is the largest of one, two or three profiles whose last one adds ``gain``
    of the spot's sum of squares at least, by non-negative fits; the label is that of most of the
    ``nearest`` best correlated cells, the first of equals, and agrees if the model has it.
    """
    fits = mixtures.subset_fits(spots, profiles, "spot", "feature", "value", "kind", 3)
    at = lambda k, c: F.max(F.when(F.col("size") == k, F.col(c)))
    wide = fits.groupBy("spot").agg(*[at(k, "kinds").alias(f"_k{k}") for k in (1, 2, 3)], *[F.coalesce(at(k, "r2"), F.lit(0.0)).alias(f"_r{k}") for k in (1, 2, 3)])
    two = F.col("_r2") - F.col("_r1") >= gain
    size = F.when(two & (F.col("_r3") - F.col("_r2") >= gain), 3).when(two, 2).otherwise(1)
    pick = lambda c: F.when(F.col("_n") == 3, F.col(f"{c}3")).when(F.col("_n") == 2, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    model = wide.withColumn("_n", size).select("spot", F.element_at(F.array(F.lit("pure"), F.lit("pair"), F.lit("triplet")), F.col("_n")).alias("model"), pick("_k").alias("kinds"), pick("_r").alias("r2"))
    votes = mixtures.neighbour_votes(spots, cells, "spot", "cell", "feature", "value", "kind", nearest)
    best = votes.groupBy("spot").agg(F.min(F.struct((-F.col("votes")).alias("v"), "kind", "share")).alias("b")).select("spot", F.col("b.kind").alias("label"), F.col("b.share").alias("label_share"))
    return model.join(best, "spot", "left").withColumn("agrees", F.coalesce(F.array_contains("kinds", F.col("label")), F.lit(False)))


def sample_swaps(signal: DataFrame, markers: int) -> DataFrame:
    """Pairs of samples ranked by how well each carries the other's markers: ``rank, a, b, cross, win_rate, swap_score, margin``.

    Signal: sample, feature, value. Values are scored within features; a
    sample's markers are the ``markers`` features that it scores highest, the
    first of equals. ``margin`` is what a pair is ahead of the next one.
    """
    z = signal.groupBy("sample", "feature").agg(F.sum("value").alias("value")).select("sample", "feature", stats.row_z("value", ["feature"]).alias("z")).filter("z IS NOT NULL")
    own = ordered.top_k(z, ["sample"], [F.desc(F.round("z", 9)), F.asc("feature")], markers).select("sample", "feature")
    pairs = stats.swap_directions(z, own, "sample", "feature", "z")
    placed = ordered.ranked(pairs.withColumn("_s", F.round("swap_score", 9)), [F.desc("_s"), F.asc("a"), F.asc("b")])
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("swap_score").alias("_next"))
    return placed.join(after, "rank", "left").select("rank", "a", "b", "cross", "win_rate", "swap_score", (F.col("swap_score") - F.col("_next")).alias("margin"))
