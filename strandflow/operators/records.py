"""Records of alleles and events: statuses by precedence, located reasons, confidences, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequence import col, quality_weight, runs
from .joins import spread

GATING = ("support_below_threshold", "max_alleles", "smear_ambiguous")


def selection_status(rejected: Column, bases: Column, groups: Column, unassigned: Column, splits: dict[str, str], limit: float = 0.2) -> Column:
    """One status a sample, by precedence: too many alleles, an unconfirmed split, a rejected peak that matters, too many unassigned.

    ``rejected``: reasons of rejected peaks; ``bases``: how each peak was split; ``splits``: basis to status, in order of precedence.
    """
    weighty = F.exists(rejected, lambda r: r.isin(*GATING))
    out = F.when((groups > 2) | F.array_contains(rejected, "max_alleles"), "unresolved_max_alleles")
    for basis, status in splits.items():
        out = out.when(F.array_contains(bases, basis), status)
    return out.when(weighty, "unresolved_rejected_peak").when(unassigned > limit, "unresolved_unassigned_spanning").otherwise("resolved")


def located_site(kind: Column, pos: Column, major: Column, minor: Column, af: Column, unit_bp: int = 60) -> Column:
    """Names an unresolved site by its 1-based unit."""
    unit = (F.floor(pos / unit_bp) + 1).cast("string")
    return F.concat(F.lit("unresolved heterozygous site at repeat "), unit, F.lit(" ("), kind, F.lit(" "), major, F.lit(">"), minor, F.lit(", AF "), F.round(af, 3).cast("string"), F.lit(")"))


def single_group(resolved: Column, residual: Column) -> Column:
    """A sample with one group is homozygous only if resolved and without residual sites."""
    return F.coalesce(resolved & (residual == 0), F.lit(False))


def event_confidence(units: DataFrame, calls: DataFrame, *, near_end: int = 3, penalty: float = 0.5, absent: float = 0.3) -> DataFrame:
    """Units' confidences weighed by their calls: units(id, index, confidence), calls(id, index, status, qual).

    A supported event takes its best call's weight, an absent one ``absent``; events near the end of a long enough chain
    are penalised. Rounded half-even to four decimals.
    """
    best = calls.groupBy("id", "index").agg(F.max("qual").alias("qual"), F.max("status").alias("status"))
    total = F.count("*").over(W.partitionBy("id"))
    both = units.join(best, ["id", "index"], "left").withColumn("_n", total)
    weight = F.when(F.col("status").isNull(), 1.0).when(F.col("status") == "supported", quality_weight("qual")).when(F.col("status") == "absent", absent).otherwise(1.0)
    boundary = F.col("status").isNotNull() & (F.col("_n") > 2 * near_end) & (F.col("index") > F.col("_n") - near_end)
    value = F.col("confidence") * weight * F.when(boundary, penalty).otherwise(1.0)
    out = both.withColumn("boundary", boundary).withColumn("confidence", F.when(F.col("status").isNotNull(), F.bround(value, 4)).otherwise(F.col("confidence")))
    return out.select("id", "index", "confidence", "boundary")


def allele_confidence(units: DataFrame) -> DataFrame:
    return units.groupBy("id").agg(F.bround(F.avg("confidence"), 4).alias("confidence"))


def run_signatures(templates: DataFrame, units: DataFrame, least: int = 3) -> DataFrame:
    """What single-base events look like in a run: (base, parent length, event length), distinct. templates(parent, seq), units(id, seq).

    A template that changes exactly one run of its parent by its net length has a signature; one that changes none, or more, is blind.
    """
    sizes = lambda seq: F.transform(runs(seq, 1), lambda r: F.struct(r["base"].alias("base"), (r["end"] - r["start"]).alias("n")))
    both = templates.join(units.select(F.col("id").alias("parent"), F.col("seq").alias("_p")), "parent")
    # the signature is one of the two sequences, however many templates have them; filters on keys would be worked out before the grouping
    both = spread(both.groupBy(F.col("_p").alias("_k"), F.col("seq").alias("_l")).agg(F.max("_p").alias("_p"), F.max("seq").alias("seq")).drop("_k", "_l"), "_p", "seq")
    z = both.withColumn("_a", sizes("_p")).withColumn("_b", sizes("seq")).where(F.size("_a") == F.size("_b"))
    pairs = F.filter(F.zip_with("_a", "_b", lambda x, y: F.struct(x["base"].alias("base"), y["base"].alias("other"), x["n"].alias("parent_length"), y["n"].alias("event_length"))), lambda p: (p["base"] != p["other"]) | (p["parent_length"] != p["event_length"]))
    one = z.withColumn("_d", pairs).where((F.size("_d") == 1) & (F.get("_d", F.lit(0))["base"] == F.get("_d", F.lit(0))["other"]))
    x = one.select(F.get("_d", F.lit(0)).alias("x")).select("x.base", "x.parent_length", "x.event_length").distinct()
    return x.where(F.greatest("parent_length", "event_length") >= least)


def pending(points: DataFrame, done: DataFrame, key: str = "sha256") -> DataFrame:
    """Points that still have to be worked out: those whose hash has no result yet."""
    return points.join(done.select(key), key, "left_anti")


def resolved_thresholds(explicit: Column, recorded: Column, default) -> Column:
    return F.coalesce(explicit, recorded, F.lit(default))


def label(status) -> Column:
    """A status for people: words instead of underscores, first letter large."""
    text = F.translate(col(status), "_", " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
