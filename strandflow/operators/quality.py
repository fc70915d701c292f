"""Flags, bounds, integrity checks and classes of samples and designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import touching
from .decide import reasons, true


def reconstruction_flags(df: DataFrame) -> Column:
    """Why a sample's reconstruction isn't complete, in order. Columns: status, alleles, ambiguous, unresolved, duplicate."""
    return reasons(
        (F.col("status") != "completed", F.concat(F.lit("status "), "status")),
        (F.col("alleles") < 2, "fewer than two alleles"),
        (F.col("ambiguous") > 0, "ambiguous bases"),
        (true(F.col("unresolved")), "unresolved units"),
        (true(F.col("duplicate")), "unproven duplicate"),
    )


def event_bounds(length: Column, head: int = 5, tail: int = 4) -> Column:
    """First and last unit an event may sit in, 1-based; a chain with none is an error."""
    ok = length > head + tail
    first = F.when(ok, F.lit(head + 1)).otherwise(F.raise_error(F.concat(F.lit("no room in "), length)).cast("int"))
    return F.struct(first.alias("first"), (length - tail).cast("int").alias("last"))


def atlas_class(depth: Column, expected: Column, least: int) -> Column:
    """expected where a design makes the reason likely or reads are few, depth_unknown without depth, else resolvable."""
    return F.when(expected | true(depth < least), "expected").when(depth.isNull(), "depth_unknown").otherwise("resolvable")


def secondary_mode(modes: DataFrame, apart: int = 5) -> DataFrame:
    """Share of the largest mode that lies ``apart`` units or more from the largest of all, per sample; modes(sample, units, n)."""
    top = modes.groupBy("sample").agg(F.max(F.struct("n", (-F.col("units")).alias("u"))).alias("t")).select("sample", F.col("t.n").alias("top_n"), (-F.col("t.u")).alias("top"))
    other = modes.join(top, "sample").withColumn("_o", F.when(F.abs(F.col("units") - F.col("top")) >= apart, F.col("n")))
    return other.groupBy("sample", "top", "top_n").agg(F.try_divide(F.coalesce(F.max("_o"), F.lit(0)), F.max("top_n")).alias("fraction"))


def class_fractions(spans: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """Share of each class among a key's spans; 0 where there are none."""
    return spans.groupBy(key).agg(*[F.coalesce(F.try_divide(F.count_if(F.col("class") == c), F.count("*")), F.lit(0.0)).alias(c) for c in classes])


def integrity(records: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur twice or in several splits."""
    n = records.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(split).alias("splits"))
    return n.where("n > 1 or splits > 1")


def selection_audit(counts: DataFrame, selected: DataFrame, least: int) -> DataFrame:
    """Contigs that weren't selected, with why: under the threshold or outside the chosen clusters."""
    left = counts.join(selected.select("sample", "units"), ["sample", "units"], "left_anti")
    return left.withColumn("why", F.when(F.col("n") < least, "below_threshold").otherwise("unselected"))


def merged_exons(exons: DataFrame, region: DataFrame) -> DataFrame:
    """Exons of each gene and its repeat region as disjoint intervals: (gene, start, end), touching ones joined."""
    both = exons.select("gene", "start", "end").unionByName(region.select("gene", "start", "end"))
    return touching(both, ["gene"]).groupBy("gene", "event").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("event")


def source_frame(truth: DataFrame, offsets: DataFrame) -> DataFrame:
    """Intervals of haplotypes moved into the frame of the sequence reads were made from."""
    return truth.join(offsets, ["sample", "hap"]).select("sample", "hap", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))


def setting(command: Column, entry: Column, metadata: Column, default: str, allowed: list[str]) -> Column:
    """Command line, else entry, else metadata, else default; a value that isn't allowed is an error."""
    value = F.coalesce(command, entry, metadata, F.lit(default))
    return F.when(value.isin(allowed), value).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), value)).cast("string"))


def error_rates(counts: DataFrame) -> DataFrame:
    """Errors of each kind over reference bases by strand, and over both ("all"); counts(strand, kind, errors, bases)."""
    out = counts.groupingSets([[F.col("strand"), F.col("kind")], [F.col("kind")]], F.col("strand"), F.col("kind"))
    sums = out.agg(F.sum("errors").alias("errors"), F.sum("bases").alias("bases"))
    return sums.withColumn("strand", F.coalesce("strand", F.lit("all"))).withColumn("rate", F.try_divide("errors", "bases"))


def balanced_levels(rows: DataFrame, order: str, factors: dict[str, list]) -> DataFrame:
    """Each factor's levels dealt in turn over the rows, so that every level occurs as often as any other, to within one."""
    from .aggregates import numbered

    out = numbered(rows, [F.col(order)], "_i").withColumn("_i", F.col("_i") - 1)
    step = 1
    for name, levels in factors.items():
        values = F.array(*[F.lit(v) for v in levels])
        out = out.withColumn(name, F.get(values, F.pmod(F.floor(F.col("_i") / step), F.lit(len(levels))).cast("int")))
        step *= len(levels)
    return out.drop("_i")


def visit_frequency(transitions: DataFrame, steps: int = 2000) -> dict[str, float]:
    """Time-averaged visits of a Markov chain over unit labels; transitions(a, b, p): a dictionary's square at most, so it is worked out on the driver."""
    import numpy as np

    rows = transitions.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] += r["p"]
    m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-12)
    now = np.full(len(names), 1 / len(names))
    mean = np.zeros(len(names))
    for _ in range(steps):
        now = now @ m
        mean += now
    return dict(zip(names, (mean / steps).tolist()))


def variant_site(differences: DataFrame) -> DataFrame:
    """The stretch of a unit that differs, as a half-open interval from 0; differences(id, pos, ref): 1-based. Empty ref: a point."""
    start = F.min(F.col("pos") - 1)
    return differences.groupBy("id").agg(start.cast("int").alias("start"), F.max(F.col("pos") - 1 + F.length("ref")).cast("int").alias("end"))
