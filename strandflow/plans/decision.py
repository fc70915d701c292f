"""Reads to decisions in one plan: alleles, read support of their events, what speaks against a call, and the decision of each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DecisionSettings, ReadSettings
from ..dictionary import Dictionary, default
from ..operators import decide as D
from ..operators.records import selection_status
from ..operators.support import event_support, mutations
from .alleles import reconstruct

#: How a peak that wasn't split leaves its sample, in order of precedence.
UNRESOLVED = {"unconfirmed_single_site": "unresolved_single_site", "unconfirmed_group_size": "unresolved_group_size"}


def selection(run: dict[str, DataFrame]) -> DataFrame:
    """(sample, selection): is it sure which alleles the sample has."""
    peaks = run["peaks"].groupBy("sample").agg(F.array_compact(F.collect_set("reason")).alias("rejected"))
    groups = run["alleles"].groupBy("sample").agg(F.collect_set("basis").alias("bases"))
    # reads of no group, of an excluded one or of a third belong to no allele
    own = run["alleles"].select("sample", "peak", "group", F.lit(True).alias("kept"))
    placed = run["placed"].join(own, ["sample", "peak", "group"], "left").groupBy("sample").agg(F.count_distinct("peak", "group").alias("groups"), F.avg(F.col("kept").isNull().cast("double")).alias("unassigned"))
    both = placed.join(groups, "sample").join(peaks, "sample")
    return both.select("sample", selection_status(F.col("rejected"), F.col("bases"), F.col("groups"), F.col("unassigned"), UNRESOLVED).alias("selection"))


def call(raw: DataFrame, words: Dictionary | None = None, s: ReadSettings = ReadSettings(), d: DecisionSettings = DecisionSettings(), *, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """``reconstruct``'s tables, and support, mutations, gates and decisions, over raw(sample, ord, name, seq, qual).

    A sample of which no read spans the repeat, or no allele was found, has the decision NO_CALL.
    """
    words = words or default()
    run = reconstruct(raw, words, s, keep=keep)
    run["units"] = keep(run["units"], "units")
    found, residual = event_support(run["alleles"], run["units"], run["members"], words, s, keep=keep)
    support = keep(found, "support")
    gates = run["alleles"].join(residual.withColumnRenamed("sites", "residual_sites"), ["sample", "allele"], "left").join(selection(run), "sample", "left")
    # sites that tests refused, but that may hide a second allele, speak against a negative call
    gates = gates.select(
        "sample", "allele", "reads", F.col("depth").alias("depth_status"), F.col("selection").alias("selection_status"), F.coalesce("residual_sites", F.lit(0)).alias("residual_sites"),
        F.coalesce(F.json_array_length("tiers"), F.lit(0)).alias("unassessed_run_sites"), F.lit(None).cast("boolean").alias("stage_discordant"),
    )
    gates = keep(gates, "gates")
    named = mutations(support, run["units"])
    with_depth = named.join(gates.select("sample", "allele", "depth_status", F.lit(False).alias("_low")), ["sample", "allele"])
    fields = ("frameshift", "template_match", "support_status", "read_support_status", "ambiguous_place")
    blocked = with_depth.withColumn("blockers", D.blockers(F.struct(*fields), F.col("depth_status"), F.col("_low"))).drop("_low", "depth_status")
    blocked = keep(blocked, "mutations")
    speaks = ("depth_status", "selection_status", "residual_sites", "unassessed_run_sites", "stage_discordant")
    assessed = F.col("depth_status").isNotNull()
    by_allele = gates.select("sample", F.struct("allele", "depth_status", D.allele_reasons(F.struct(*speaks), F.col("allele"), assessed).alias("reasons")).alias("a"))
    alleles = by_allele.groupBy("sample").agg(F.sort_array(F.collect_list("a")).alias("alleles"))
    events = blocked.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("name", "blockers"))).alias("mutations"))
    counts = run["categories"].groupBy("sample").agg(F.count("*").alias("total_reads"))
    bases = run["alleles"].groupBy("sample").agg(F.sum(F.length(F.translate("seq", "ACGT", ""))).alias("ambiguous_bases"))
    none = F.array().cast("array<struct<name:string,blockers:array<string>>>")
    samples = counts.join(alleles, "sample", "left").join(events, "sample", "left").join(bases, "sample", "left")
    # an allele without events has been looked at; a sample without alleles has not
    samples = samples.withColumn("mutations", F.when(F.col("alleles").isNotNull(), F.coalesce("mutations", none))).withColumn("execution_ok", F.lit(True))
    decisions = D.decide(samples, d).select("sample", "decision", "reasons", "caveats", "total_reads")
    return run | {"support": support, "mutations": blocked, "gates": gates, "decisions": decisions}
