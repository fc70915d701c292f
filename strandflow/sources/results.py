"""Results of runs and truths of samples: what an attempt came to, and whether a truth is what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses that a sidecar file may have, and those of them that end the question. Fixed values.
SIDECAR = ("running", "completed", "execution_failed", "insufficient_evidence", "interrupted")
FINAL = ("execution_failed", "insufficient_evidence", "interrupted")
#: Values that allow a finished call, by field. Fixed values.
SETTLED = {
    "phase_status": ("phased", "single_heterozygous_unordered", "no_informative_heterozygosity"),
    "reconstruction_status": ("complete_segmentation", "candidate_reference_confidence_unverified"),
}


def settled(present: dict[str, Column | str], sequence: Column | str = "sequence") -> Column:
    """May an allele count as finished: each field that is present (``present``: name to a flag) has a known value, its bases are certain."""
    rules = [~(F.col(flag) if isinstance(flag, str) else flag) | F.coalesce(F.col(name).isin(*SETTLED[name]), F.lit(False)) for name, flag in present.items()]
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    out = sequence.rlike("^[ACGT]*$")
    for rule in rules:
        out = out & rule
    return F.coalesce(out, F.lit(False))


def observation_status(runs: DataFrame) -> DataFrame:
    """Adds ``observed``: what an attempt came to. A failed execution outranks files that it left behind.

    runs(recorded, exit_code, sidecar, summary, predictions, unsettled): the record's status and exit code, the sidecar's status (null:
    none; unknown: invalid), the summary (null: none, "valid" or "invalid"), its predictions, and whether any is unsettled.
    """
    code, recorded, sidecar = F.col("exit_code"), F.col("recorded"), F.col("sidecar")
    failed = F.coalesce(code != 0, F.lit(False)) | F.coalesce(recorded.isin("execution_failed", "timeout"), F.lit(False))
    beyond = F.coalesce(recorded == "timeout", F.lit(False)) | F.coalesce(~code.isin(0, 1), F.lit(False))
    known = sidecar.isin(*SIDECAR)
    status = (
        F.when(sidecar.isNotNull() & ~known, F.when(failed, "execution_failed").otherwise("invalid_artifacts"))
        .when(known & beyond, "execution_failed")
        .when(sidecar.isin(*FINAL), sidecar)
        .when(failed, "execution_failed")
        .when(sidecar == "running", "invalid_artifacts")
        .when(recorded == "not_attempted", "not_attempted")
        .when(F.col("summary").isNull(), F.when(code == 0, "invalid_artifacts").otherwise("not_attempted"))
        .when(F.col("summary") != "valid", "invalid_artifacts")
        .when(F.col("unsettled"), "ambiguous_reconstruction")
        .when(F.col("predictions") > 0, "completed")
        .otherwise("insufficient_evidence")
    )
    return runs.withColumn("observed", status)


def read_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries under ``folder`` (one folder a sample, one JSON object a file): sample, summary, predictions.

    A file that is no object, or whose classifications and alleles disagree, is invalid and keeps its row.
    """
    raw = spark.read.text(f"{folder}/*/summary.json", wholetext=True).select("value", F.input_file_name().alias("_file"))
    kind = "struct<classifications:map<string,string>,alleles:map<string,string>>"
    parsed = raw.withColumn("_x", F.from_json("value", kind))
    named, listed = F.map_keys("_x.classifications"), F.map_keys("_x.alleles")
    sound = F.coalesce(F.size(F.array_except(named, listed)) == 0, F.lit(False)) & F.col("_x.classifications").isNotNull()
    sample = F.element_at(F.split("_file", "/"), -2)
    return parsed.select(sample.alias("sample"), F.when(sound, "valid").otherwise("invalid").alias("summary"), F.when(sound, F.size(named)).otherwise(0).alias("predictions"))


def checked_truth(chains: DataFrame, sequences: DataFrame, units: DataFrame, left: str = "", right: str = "") -> DataFrame:
    """Truths rebuilt from their parts: per (sample, hap) whether flank, units in order and flank are the sequence given.

    chains(sample, hap, pos, unit), units(id, seq). Unknown units, gaps in the order, or a missing side make a truth invalid.
    """
    from ..operators.joins import small

    known = chains.join(small(units.select(F.col("id").alias("unit"), F.col("seq").alias("_s"))), "unit", "left")
    built = known.groupBy("sample", "hap").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_s"))), lambda x: x["_s"]), "").alias("_mid"),
        (F.count("_s") == F.count("*")).alias("_all"), ((F.max("pos") - F.min("pos") + 1 == F.count("*")) & (F.count_distinct("pos") == F.count("*"))).alias("_even"),
    )
    both = built.join(sequences.select("sample", "hap", "seq"), ["sample", "hap"], "full")
    same = F.concat(F.lit(left), "_mid", F.lit(right)) == F.upper("seq")
    return both.select("sample", "hap", F.coalesce(F.col("_all") & F.col("_even") & same, F.lit(False)).alias("valid"))


def hydrated(records: DataFrame) -> DataFrame:
    """Curated records(strand, dna, sha256, length, ...) with their sequence on the declared strand, and whether digest, length and letters hold."""
    from ..functions.sequence import reverse_complement

    dna = F.upper("dna")
    own = F.when(F.col("strand") == "+", dna).when(F.col("strand") == "-", reverse_complement(dna))
    out = records.withColumn("sequence", own)
    holds = F.col("sequence").rlike("^[ACGT]+$") & (F.length("sequence") == F.col("length")) & (F.sha2("sequence", 256) == F.lower("sha256"))
    return out.withColumn("verified", F.coalesce(holds, F.lit(False)))
