"""Scores of whole evaluations: rows of cases, cohorts, ratios with their denominators, targets, provenance, blinded inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .evaluate import interval

#: Counts of a sample that are summed as they are.
TOTALS = ("truth_haplotypes", "truth_events", "predicted_alleles", "missing_alleles", "independent_missing_alleles", "unproven_duplicate_alleles", "extra_alleles")
#: Endpoints of a sample known as bounds (least and largest over tied assignments).
BOUNDS = ("sequence_exact", "structure_exact", "independent_sequence_exact", "independent_structure_exact", "all_sequences_exact")
#: The three ways to read a prediction: every event, those with read support, those with the older support.
VIEWS = ("", "supported_", "legacy_supported_")


def allele_rows(cases: DataFrame, alleles: str = "alleles") -> DataFrame:
    """A row for each allele of a case, numbered from 1, with the case's other columns; cases without alleles give none."""
    kept = [F.col(c) for c in cases.columns if c != alleles]
    return cases.select(*kept, F.posexplode(alleles).alias("_i", "_a")).select(*kept, (F.col("_i") + 1).alias("allele"), "_a.*")


def cohort(rows: DataFrame, name: str) -> DataFrame:
    """all; negatives (normal or benign); pathogenic. A null flag is no member."""
    member = {"all": F.lit(True), "negatives": F.col("normal") | F.col("benign"), "pathogenic": F.col("pathogenic")}[name]
    return rows.where(F.coalesce(member, F.lit(False)))


def is_indel(major, minor) -> Column:
    """Do a site's alleles differ in length: runs and insertions by their kind's value, columns by a gap."""
    return (F.col(major) == "-") | (F.col(minor) == "-") | (F.length(major) != F.length(minor))


def known_sites(sites: DataFrame, runs: DataFrame, inserted: DataFrame) -> DataFrame:
    """Sites whose change is a template's signature: runs by (base, major, minor), insertions by what the minor adds.

    sites(kind, base, major, minor); runs(base, major, minor) and inserted(bases) come from the templates: a few hundred at most.
    """
    from .joins import small

    by_run = sites.where("kind = 'run'").join(small(runs), ["base", "major", "minor"], "left_semi")
    added = F.when(F.startswith("minor", "major"), F.substr("minor", F.length("major") + 1))
    by_text = sites.where("kind = 'ins'").withColumn("_added", added).join(small(inserted), F.col("_added") == F.col("bases"), "left_semi").drop("_added")
    return by_run.unionByName(by_text)


def composition(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Share of each value of each named column among a key's rows: (keys, column, value, n, share)."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select(*keys, "x.*")
    n = long.groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))
    # a column has a handful of values
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "column")))


def both_ways(truth: DataFrame, chosen: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sample the truths without a chosen prediction (missing) and the predictions without a truth (extra).

    truth(sample, t), predicted(sample, p), chosen(sample, t, p).
    """
    missing = truth.join(chosen, ["sample", "t"], "left_anti").groupBy("sample").agg(F.count("*").alias("missing"))
    extra = predicted.join(chosen, ["sample", "p"], "left_anti").groupBy("sample").agg(F.count("*").alias("extra"))
    samples = truth.select("sample").union(predicted.select("sample")).distinct()
    return samples.join(missing, "sample", "left").join(extra, "sample", "left").fillna(0, ["missing", "extra"])


def _share(top: Column, bottom: Column) -> Column:
    return F.struct(top.alias("numerator"), bottom.alias("denominator"), F.try_divide(top, bottom).alias("value"))


def ratios(samples: DataFrame) -> DataFrame:
    """Every ratio of an evaluation with its numerator and denominator: (name, numerator, denominator, value); value null over nothing.

    One pass of sums over the samples of valid truth; true positives count at their least, false ones at their most.
    """
    valid = F.col("truth_status") == "valid"
    yes = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: F.count_if(valid & yes(c))
    total = lambda c: F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).cast("long")
    positive, tp, called = F.col("mutation_positive_truth"), F.col("normal_true_negative"), F.col("predicted_alleles") > 0
    truths, events, n = total("truth_haplotypes"), total("truth_events"), F.count_if(valid)
    matched = F.coalesce(F.sum(F.when(valid, F.least("predicted_alleles", "truth_haplotypes"))), F.lit(0)).cast("long")
    made: dict[str, Column] = {}
    for view in VIEWS:
        hit, wrong = total(f"{view}event_tp_min"), total(f"{view}event_fp_max")
        made[f"{view}event_recall"] = _share(hit, events)
        made[f"{view}event_precision"] = _share(hit, hit + wrong)
        alarm = F.col(f"{view}sample_alarm")
        made[f"{view}sample_alarm_precision"] = _share(count(positive & alarm), count(alarm))
        made[f"{view}sample_alarm_sensitivity"] = _share(count(positive & alarm), count(positive))
        calm, false = F.col(f"{view}normal_true_negative"), F.col(f"{view}normal_false_positive")
        made[f"{view}normal_specificity"] = _share(count(calm), count(yes(calm) | yes(false)))
    for what in ("sequence", "structure"):
        literal, independent = total(f"{what}_exact_min"), total(f"independent_{what}_exact_min")
        made[f"literal_{what}_accuracy"] = _share(literal, truths)
        made[f"{what}_accuracy"] = made[f"independently_recovered_{what}_accuracy"] = _share(independent, truths)
    made["literal_conditional_sequence_accuracy"] = _share(total("sequence_exact_min"), matched)
    made["conditional_sequence_accuracy"] = made["independently_recovered_conditional_sequence_accuracy"] = _share(total("independent_sequence_exact_min"), matched)
    made["exact_sample_reconstruction"] = _share(total("all_sequences_exact_min"), n)
    made["call_rate"], made["no_call_rate"] = _share(count(called), n), _share(count(F.col("predicted_alleles") == 0), n)
    made["normal_confident_negative_rate"] = _share(count(tp), F.count_if(valid & ~yes(positive)))
    resolved = (F.col("status") == "completed") & (F.col("missing_alleles") == 0) & (F.col("extra_alleles") == 0) & F.col("independent_haplotype_evidence")
    made["resolved_reconstruction_call_rate"] = _share(count(resolved), n)
    one = samples.agg(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("r")) for k, v in made.items()]).alias("all"))
    return one.select(F.explode("all").alias("x")).select("x.name", "x.r.*")


def judged_targets(rows: DataFrame, targets: DataFrame, *, alpha: float = 0.05, basis: str = "point") -> DataFrame:
    """Each target pooled and by profile: k, n, rate, interval, judged value and whether it passes; an empty cohort fails.

    rows(set, profile, pathogenic, normal, benign, decision, inconclusive, false_positive), targets(metric, comparator, threshold, scope): a
    target of scope "pooled" binds by its pooled row only, one of scope "profile" by each profile's; the other rows inform.
    A set verdict is the conjunction of its binding rows (``set_passes``).
    """
    one = lambda c: F.coalesce(c, F.lit(False))
    metrics = {
        "pathogenic_rate": (F.col("pathogenic"), F.col("decision") == "PATHOGENIC"),
        "inconclusive_rate": (F.lit(True), F.col("inconclusive")),
        "false_positive_rate": (one(F.col("normal")) | one(F.col("benign")), F.col("false_positive")),
    }
    sums = [f(one(member) if hit is None else one(member) & one(hit)).alias(f"{name}_{x}") for name, (member, won) in metrics.items() for x, hit in (("n", None), ("k", won)) for f in (F.count_if,)]
    grouped = rows.groupingSets([[F.col("set")], [F.col("set"), F.col("profile")]], F.col("set"), F.col("profile")).agg(F.grouping("profile").alias("_pooled"), *sums)
    long = grouped.select("set", "profile", (F.col("_pooled") == 1).alias("pooled"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_k").alias("k"), F.col(f"{m}_n").alias("n")) for m in metrics])).alias("x")).select("set", "profile", "pooled", "x.*")
    from .joins import small

    both = interval(long.join(small(targets), "metric"), alpha=alpha).withColumn("rate", F.try_divide("k", "n"))
    least = F.col("comparator") == "ge"
    judged = F.col("rate") if basis == "point" else F.when(least, F.col("low")).otherwise(F.col("high"))
    passes = F.when(least, judged >= F.col("threshold")).otherwise(judged <= F.col("threshold"))
    return both.withColumns({"judged": judged, "pass": F.coalesce(passes, F.lit(False)), "binding": F.col("pooled") == (F.col("scope") == "pooled")})


def set_passes(judged: DataFrame) -> DataFrame:
    return judged.where("binding").groupBy("set").agg(F.every("pass").alias("pass"))


def templates_needed(target: int, artefact: float, share, floor: float = 0.05) -> Column:
    """(share, capped, templates): molecules that give the minor allele its full-length reads; below the floor it gets fewer."""
    share = F.col(share) if isinstance(share, str) else share
    used = F.greatest(share, F.lit(floor))
    return F.struct(used.alias("share"), (share < floor).alias("capped"), F.ceil(target / (used * (1 - artefact))).alias("templates"))


def provenance(rows: DataFrame, version: str, digest: str) -> DataFrame:
    """How many cases each version made, and one digest of their inputs' digests in order."""
    return rows.groupBy(version).agg(F.count("*").alias("cases"), F.count_distinct(digest).alias("inputs"), F.sha2(F.array_join(F.array_sort(F.collect_set(digest)), "\n"), 256).alias("inputs_sha256"))


def level_tables(rows: DataFrame, levels: list[tuple[str, str]], headline: str, alpha: float = 0.05) -> DataFrame:
    """A row for each set, factor and level of the design, also where no case has it; the headline set first.

    rows(set, factor, level, hit).
    """
    spark = rows.sparkSession
    design = F.broadcast(spark.createDataFrame(levels, "factor string, level string"))  # a driver's list
    sums = rows.groupBy("set", "factor", "level").agg(F.count_if("hit").alias("k"), F.count("*").alias("n"))
    grid = rows.select("set").distinct().crossJoin(design)
    full = interval(grid.join(sums, ["set", "factor", "level"], "left").fillna(0, ["k", "n"]), alpha=alpha)
    return full.withColumn("rate", F.try_divide("k", "n")).withColumn("headline", F.col("set") == headline).orderBy(F.col("headline").desc(), "set", "factor", "level")


def top_reasons(rows: DataFrame, reason: str, most: int) -> DataFrame:
    """The legend of the ``most`` frequent reasons, by count and then name (the limit is the feature)."""
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), reason).limit(most)


def blinded(designs: DataFrame, modes: list[str], seed: int, name: str = "design") -> DataFrame:
    """Every design in every mode under a token that tells neither: a keyed digest, so tokens don't depend on the table's order."""
    token = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(name).cast("string"), "mode"), 256), 1, 16)
    return designs.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).withColumn("token", token)


def archive_runs(report: DataFrame, target: str) -> DataFrame:
    """An archive's report of runs as an inventory: arm by strategy and target, the sample by the alias before its library, files aligned.

    report(run_accession, sample_alias, library_strategy, fastq_ftp, fastq_bytes, fastq_md5), all text; ``aligned`` is false where
    the lists of files, sizes and digests don't match.
    """
    alias, strategy = F.trim("sample_alias"), F.upper(F.trim("library_strategy"))
    own = F.upper(F.element_at(F.split(alias, "_"), -1)) == target.upper()
    arm = F.when(own & (strategy == "AMPLICON"), "primary_amplicon").when(own & (strategy == "WGS"), "secondary_wgs").otherwise("excluded")
    urls, sizes, md5s = (F.split(c, ";") for c in ("fastq_ftp", "fastq_bytes", "fastq_md5"))
    aligned = (F.col("fastq_ftp") != "") & (F.size(urls) == F.size(sizes)) & (F.size(urls) == F.size(md5s)) & F.forall(sizes, lambda x: x.rlike("^[0-9]+$")) & F.forall(md5s, lambda x: F.length(x) == 32)
    files = F.transform(F.arrays_zip(urls.alias("u"), sizes.alias("b"), md5s.alias("m")), lambda x: F.struct(F.when(x["u"].contains("://"), x["u"]).otherwise(F.concat(F.lit("https://"), x["u"])).alias("url"), x["b"].try_cast("long").alias("bytes"), F.lower(x["m"]).alias("md5")))
    sample = F.split(F.split(alias, "_PCR_")[0], "_WGS_")[0]
    return report.select(F.trim("run_accession").alias("run"), alias.alias("alias"), sample.alias("biological_sample"), arm.alias("arm"), F.coalesce(aligned, F.lit(False)).alias("aligned"), F.when(aligned, files).alias("files"))


def region(text) -> Column:
    """(contig, start, end) of ``contig:start-end``; thousands separators are allowed; null if it isn't one."""
    text = F.regexp_replace(text, ",", "")
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("contig"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end")))


def checked_with_calls(mutations: DataFrame, calls: DataFrame, *, penalty: float = 0.5, border: int = 2) -> DataFrame:
    """Mutations(sample, pos, index, units, confidence) with whether a variant call confirms them, and the confidence reweighted.

    calls(sample, pos, qual). Within ``border`` units of an end a call can't be expected, so the confidence is lowered by the penalty.
    """
    own = calls.groupBy("sample", "pos").agg(F.max("qual").alias("qual"))
    both = mutations.join(own, ["sample", "pos"], "left")
    near = (F.col("index") <= border) | (F.col("index") > F.col("units") - border)
    weight = F.when(near, F.lit(1 - penalty)).otherwise(F.lit(1.0))
    return both.withColumns({"concordant": F.col("qual").isNotNull(), "at_border": near, "weighted": F.col("confidence") * weight})


def scaled_targets(rows: DataFrame) -> DataFrame:
    """Targets(sample, hap, pos, design_units, actual_units) moved to the unit at the same share of the chain that was made."""
    at = F.round(F.col("pos") * F.col("actual_units") / F.col("design_units")).cast("long")
    return rows.withColumn("actual_pos", F.greatest(F.lit(1), F.least(F.col("actual_units").cast("long"), at)))


def with_rare_units(chains: DataFrame, rare: list[str], *, share: float = 0.1, guard: int = 5, seed: int = 0) -> DataFrame:
    """Chains(id, units): about ``share`` of the interior units replaced by rare ones, chosen by a hash of id, place and seed."""
    draw = lambda i, salt: F.pmod(F.xxhash64("id", i, F.lit(seed), F.lit(salt)), F.lit(1 << 20))
    pick = F.array(*[F.lit(u) for u in rare])
    inner = lambda i: (i >= guard) & (i < F.size("units") - guard)
    new = F.transform("units", lambda u, i: F.when(inner(i) & (draw(i, 1) < share * (1 << 20)), F.get(pick, (draw(i, 2) % len(rare)).cast("int"))).otherwise(u))
    return chains.withColumn("units", new)
