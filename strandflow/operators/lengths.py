"""Length modes of samples: density, maxima, support, tests for smear, and the accepted peaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ReadSettings
from ..functions.stats import binomial_upper_tail
from .joins import spread, within


@dataclass(frozen=True)
class LengthSettings:
    unit_bp: int = 60
    grid_bp: int = 2
    margin_bp: int = 100
    bandwidth_bp: float = 8.0
    bandwidth_share: float = 0.004
    kernel_reach: float = 4.0
    apart_units: float = 0.7
    window_bp: float = 30.0
    window_per_unit: float = 0.6
    noise_reads: int = 2
    least_reads: int = 8
    far_share: float = 0.03
    near_share: float = 0.20
    near_units: float = 2.0
    guard: float = 0.5
    smear_units: float = 1.5
    alleles: int = 2
    smear_alpha: float = 0.001
    smear_factor: float = 3.0
    core_share: float = 0.25
    flank_units: float = 2.0
    flank_reads: int = 5
    dimer_share: float = 0.05


def counted(spans: DataFrame) -> DataFrame:
    """Spans by (sample, length) with their number n; tables that have n are summed."""
    return spans.groupBy("sample", "length").agg((F.sum("n") if "n" in spans.columns else F.count("*")).alias("n"))


def half_window(length, s: LengthSettings) -> Column:
    return s.window_bp + s.window_per_unit * length / s.unit_bp


#: Grid points of a block, the unit in which densities are worked out.
BLOCK = 32


def _blocks(spans: DataFrame, s: LengthSettings) -> DataFrame:
    """(sample, lo, block, near): each sample's grid in blocks, with the distinct lengths whose kernels reach the block or a point beside it.

    A block's lengths are no more than the base pairs that it and the reach span. Only they are gathered, never grid points.
    """
    own = W.partitionBy("sample")  # goes over a sample's distinct lengths
    # a few bytes make a whole grid: all tasks share the samples
    lengths = spread(counted(spans), "sample").withColumns({"lo": F.min("length").over(own) - s.margin_bp, "_hi": F.max("length").over(own) + s.margin_bp})
    lengths = lengths.withColumn("bw", s.bandwidth_bp + s.bandwidth_share * F.col("length"))
    reach = F.lit(s.kernel_reach) * F.col("bw")
    first = F.greatest(F.ceil((F.col("length") - reach - F.col("lo")) / s.grid_bp), F.lit(0))
    last = F.least(F.floor((F.col("length") + reach - F.col("lo")) / s.grid_bp), F.floor((F.col("_hi") - F.col("lo")) / s.grid_bp))
    met = lengths.withColumns({"first": first, "last": last}).where("first <= last")
    cut = met.withColumn("block", F.explode(F.sequence(F.floor((F.greatest(F.col("first"), F.lit(1)) - 1) / BLOCK), F.floor((F.col("last") + 1) / BLOCK))))
    # in order of length, so that a point has the same sum in whichever block it is worked out
    return cut.groupBy("sample", "lo", "block").agg(F.sort_array(F.collect_list(F.struct("length", "n", "bw", "first", "last"))).alias("near"))


def _point(i: Column, s: LengthSettings) -> Column:
    """The density of a block's grid point, null where no kernel reaches."""

    def add(acc, q):
        z = (F.col("lo") + i * s.grid_bp - q["length"]) / q["bw"]
        return F.when((i >= q["first"]) & (i <= q["last"]), F.coalesce(acc, F.lit(0.0)) + q["n"] * F.exp(-0.5 * z * z)).otherwise(acc)

    return F.aggregate("near", F.lit(None).cast("double"), add)


def density(spans: DataFrame, s: LengthSettings = LengthSettings()) -> DataFrame:
    """(sample, i, x, d): truncated Gaussian kernel sums on each sample's grid.

    Lengths meet only the grid points within their kernel's reach, by blocks of the grid; equal lengths are counted first.
    """
    start = F.col("block") * BLOCK
    opened = _blocks(spans, s).withColumn("i", F.explode(F.sequence(start, start + BLOCK - 1)))
    return opened.select("sample", "i", (F.col("lo") + F.col("i") * s.grid_bp).alias("x"), _point(F.col("i"), s).alias("d")).where("d is not null")


def maxima(spans: DataFrame, s: LengthSettings = LengthSettings()) -> DataFrame:
    """(sample, centers): maxima by density, without those near a higher one. A sample has dozens, so its list is folded in place."""
    start = F.col("block") * BLOCK
    # a block's points with one more at either end: what lies beside a point is at hand
    along = _blocks(spans, s).withColumn("_d", F.transform(F.sequence(start - 1, start + BLOCK), lambda i: _point(i, s)))
    at = lambda k: F.get("_d", k)
    # a grid point that is missing has no density
    high = lambda k: (at(k) >= F.coalesce(at(k - 1), F.lit(0.0))) & (at(k) > F.coalesce(at(k + 1), F.lit(0.0)))
    found = F.filter(F.sequence(F.lit(1), F.lit(BLOCK)), lambda k: F.coalesce(high(k), F.lit(False)))
    peaks = along.withColumn("_k", F.explode(found)).select("sample", (F.col("lo") + (start - 1 + F.col("_k")) * s.grid_bp).alias("x"), at(F.col("_k")).alias("d"))
    listed = peaks.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct((-F.round("d", 9)).alias("d"), "x"))).alias("l"))
    far = s.apart_units * s.unit_bp
    keep = lambda acc, p: F.when(F.exists(acc, lambda q: F.abs(q - p["x"]) < far), acc).otherwise(F.concat(acc, F.array(p["x"])))
    return listed.select("sample", F.aggregate("l", F.array().cast("array<bigint>"), keep).alias("centers"))


def supported(spans: DataFrame, centers: DataFrame, s: LengthSettings = LengthSettings()) -> DataFrame:
    """One row per candidate: its order, support, the sample's total and its best candidate."""
    lengths = counted(spans)
    total = lengths.groupBy("sample").agg(F.sum("n").alias("total"))
    c = centers.select("sample", F.posexplode("centers").alias("ord", "center"))
    cells = c.withColumn("half", half_window(F.col("center"), s))
    # candidates of a sample are few; lengths meet them by bins of 240 bp
    near = cells.withColumn("low", F.col("center") - F.col("half")).withColumn("high", F.col("center") + F.col("half"))
    hits = within(lengths, near, ["sample"], "length", "low", "high", 4 * s.unit_bp)
    n = hits.groupBy("sample", "ord", "center", "half").agg(F.sum("n").alias("support"))
    best = F.max(F.struct("support", (-F.col("ord")).alias("o"), "center")).over(W.partitionBy("sample"))
    return n.join(total, "sample").withColumn("_b", best).select(*n.columns, "total", F.col("_b.center").alias("top"), F.col("_b.support").alias("top_support"))


def smear_p(cand: DataFrame, lengths: DataFrame, s: LengthSettings = LengthSettings()) -> DataFrame:
    """Adds smear_p: for candidates where _t holds the larger p-value of their core against the background on either side, in the region _lo .. _hi; else 0.

    lengths(sample, length, n). A side's background reaches from the candidate's window to where it holds ``flank_reads`` reads, but ``flank_units`` units at least and not
    beyond the region; a side without room has no p-value. A tested candidate carries its sample's distinct lengths along as one array.
    """
    own = lengths.groupBy("sample").agg(F.collect_list(F.struct("length", "n")).alias("_own"))
    total = lambda list_, of: F.aggregate(list_, F.lit(0).cast("long"), lambda acc, q: acc + of(q))
    core = lambda q: F.when(F.abs(q["length"] - F.col("center")) <= s.core_share * F.col("half"), q["n"]).otherwise(0)
    met = cand.join(own, "sample", "left").withColumn("_k", F.when(F.col("_t"), total("_own", core)))
    for name, side, end in (("_left", -1, "_lo"), ("_right", 1, "_hi")):
        edge = (F.col("center") + side * F.col("half")).cast("double")
        room = ((F.col(end) - edge) * side).cast("double")
        away = F.transform("_own", lambda q: F.struct(((q["length"] - edge) * side).alias("d"), q["n"].alias("n")))  # noqa: B023
        met = met.withColumn("_room", room).withColumn("_in", F.when(F.col("_t") & (F.col("_room") > 0), F.sort_array(F.filter(away, lambda q: (q["d"] > 0) & (q["d"] <= F.col("_room"))))))
        upto = lambda acc, q: F.struct((acc["n"] + q["n"]).alias("n"), F.when(acc["d"].isNull() & (acc["n"] + q["n"] >= s.flank_reads), q["d"]).otherwise(acc["d"]).alias("d"))
        enough = F.aggregate("_in", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d")), upto)["d"]
        met = met.withColumn("_enough", enough)
        reach = F.when(F.col("_enough").isNull(), F.col("_room")).otherwise(F.greatest(F.lit(float(s.flank_units * s.unit_bp)), F.col("_enough")))
        met = met.withColumn("_width", F.least(reach, F.col("_room")))
        met = met.withColumn("_of", F.col("_k") + total("_in", lambda q: F.when(q["d"] <= F.col("_width"), q["n"]).otherwise(0)))
        rho = 2 * s.core_share * F.col("half") / F.col("_width")
        met = met.withColumn("_p", F.when(F.col("_in").isNotNull(), rho / (1 + rho)))
        met = met.withColumn(name, F.when(F.col("_p").isNotNull(), binomial_upper_tail("_k", "_of", "_p"))).drop("_room", "_in", "_enough", "_width", "_of", "_p")
    return met.select(*cand.columns, F.coalesce(F.greatest("_left", "_right"), F.lit(0.0)).alias("smear_p"))


def _verdict(s: LengthSettings) -> Column:
    """Of the candidates tested together (_t): smear, ambiguous, or null where the peak stands out."""
    family = F.sum(F.col("_t").cast("int")).over(W.partitionBy("sample"))  # dozens of candidates a sample
    p = F.col("smear_p") * F.greatest(family, F.lit(1))
    return F.when(~F.col("_t") | (p < s.smear_alpha / s.smear_factor), None).when(p < s.smear_alpha * s.smear_factor, "smear_ambiguous").otherwise("smear")


def between_alleles(judged: DataFrame, lengths: DataFrame, s: LengthSettings = LengthSettings()) -> DataFrame:
    """Weak candidates between two alleles, where the shorter is the top, tested for smear; the others as they are."""
    own, accepted = W.partitionBy("sample"), F.col("reason").isNull()  # dozens of candidates a sample
    judged = judged.withColumns(
        {
            "_c": F.count_if(accepted).over(own), "_most": F.max(F.when(accepted, F.col("support"))).over(own),
            "_short": F.min(F.when(accepted, F.col("center"))).over(own), "_long": F.max(F.when(accepted, F.col("center"))).over(own),
        }
    )
    low, high = F.col("_short") + half_window(F.col("_short"), s), F.col("_long") - s.smear_units * s.unit_bp
    mine = (F.col("_c") >= 2) & (F.col("top") == F.col("_short")) & (F.col("reason") == "support_below_threshold") & (F.col("center") > low) & (F.col("center") < high) & (F.col("support") < s.guard * F.col("_most"))
    tested = smear_p(judged.withColumns({"_t": F.coalesce(mine, F.lit(False)), "_lo": low.cast("double"), "_hi": high.cast("double")}).drop("smear_p"), lengths, s)
    return tested.withColumn("reason", F.coalesce(_verdict(s), "reason"))


def length_model(spans: DataFrame, s: LengthSettings = LengthSettings(), *, smear: bool = True) -> DataFrame:
    """Every candidate of every sample with its reason; accepted peaks have none. spans(sample, length)."""
    cand = supported(spans, maxima(spans, s), s)
    below = (F.col("center") <= F.col("top") - s.smear_units * s.unit_bp) & (F.col("support") < s.guard * F.col("top_support")) & (F.col("center") != F.col("top")) & (F.col("support") > s.noise_reads)
    lengths = counted(spans)
    if smear:
        cand = cand.join(lengths.groupBy("sample").agg(F.min("length").cast("double").alias("_least")), "sample")
        cand = smear_p(cand.withColumns({"_t": F.coalesce(below, F.lit(False)), "_lo": F.col("_least"), "_hi": (F.col("top") - s.smear_units * s.unit_bp).cast("double")}), lengths, s)
        label = _verdict(s)
    else:
        label = F.lit(None).cast("string")
    near = F.abs(F.col("center") - F.col("top")) < s.near_units * s.unit_bp
    floor = F.greatest(F.lit(float(s.least_reads)), F.when(near, s.near_share).otherwise(s.far_share) * F.col("total"))
    reason = F.when(F.col("center") == F.col("top"), None).when(F.col("support") <= s.noise_reads, "noise").otherwise(F.coalesce(label, F.when(F.col("support") < floor, "support_below_threshold")))
    judged = cand.withColumn("_why", reason)
    place = F.row_number().over(W.partitionBy("sample", F.col("_why").isNull()).orderBy((F.col("center") != F.col("top")).cast("int"), F.col("support").desc(), "ord"))
    judged = judged.withColumn("reason", F.when(F.col("_why").isNull() & (place > s.alleles), "max_alleles").otherwise(F.col("_why")))
    return (between_alleles(judged, lengths, s) if smear else judged).select("sample", "center", "support", "total", "reason")


def junctions(spans: DataFrame, words, r: ReadSettings = ReadSettings()) -> DataFrame:
    """Adds first_bp and second_bp where a span holds its layout's end and then its start again: two products joined in one read."""
    from ..functions.align import infix_hits, once

    first, last = (words.units[u] for u in words.ends)
    unit = words.unit_bp

    def work(batches):
        for pdf in batches:
            # equal spans of a batch are searched once
            given, which = once(pdf["seq"])
            inner = [q[unit:-unit] for q in given]
            ends = infix_hits(last, inner, r.anchor_edits)
            starts = infix_hits(first, [q[e[1] :] if e else "" for q, e in zip(inner, ends)], r.anchor_edits)
            found = [(unit + e[1], len(q) - e[1] - b[0] + unit) if e and b else (None, None) for q, e, b in zip(inner, ends, starts)]
            pdf["first_bp"], pdf["second_bp"] = [found[i][0] for i in which], [found[i][1] for i in which]
            pdf["first_bp"], pdf["second_bp"] = pdf["first_bp"].astype("Int64"), pdf["second_bp"].astype("Int64")
            yield pdf

    return spans.select("sample", "ord", "seq").mapInPandas(work, "sample string, ord long, seq string, first_bp long, second_bp long").drop("seq")


def dimer_parents(found: DataFrame, model: DataFrame, s: LengthSettings = LengthSettings()) -> DataFrame:
    """Of joined reads(sample, ord, first_bp, second_bp) those whose parts each fall in an accepted peak's window, with their parents a and b."""
    peaks = model.where("reason is null").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("center", half_window(F.col("center"), s).alias("half"), "support"))).alias("_p"))
    parent = lambda bp: F.array_min(F.transform(F.filter("_p", lambda p: F.abs(p["center"] - F.col(bp)) <= p["half"]), lambda p: F.struct(F.abs(p["center"] - F.col(bp)).alias("d"), p["center"].alias("center"), p["support"].alias("support"))))
    both = found.join(peaks, "sample").withColumn("_a", parent("first_bp")).withColumn("_b", parent("second_bp")).where("_a is not null and _b is not null")
    low, high = F.least("_a.center", "_b.center").alias("a"), F.greatest("_a.center", "_b.center").alias("b")
    return both.select("sample", "ord", low, high, F.least("_a.support", "_b.support").alias("least"))


def without_dimers(spans: DataFrame, words, r: ReadSettings = ReadSettings(), s: LengthSettings = LengthSettings(), keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """Spans without the reads that join two products, and those reads' pairs (sample, a, b, n, explained).

    A pair is explained while its reads are a small share of the weaker parent's. The removal holds for a sample only if the
    lengths without them keep every parent and bring no new peak; otherwise all its reads stay. ``keep(df, name)`` writes a
    table that is read several times.
    """
    bp = lambda df: df.select("sample", F.col("length").cast("long").alias("length"))
    model = keep(length_model(bp(spans), s), "first-model")
    reads = keep(dimer_parents(junctions(spans, words, r).where("first_bp is not null"), model, s), "joined")
    pairs = reads.groupBy("sample", "a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least"))
    pairs = keep(pairs.withColumn("explained", F.col("n") <= s.dimer_share * F.col("least")).drop("least"), "pairs")
    gone = keep(reads.drop("least").join(pairs.where("explained").select("sample", "a", "b"), ["sample", "a", "b"], "left_semi"), "dimers")
    mine = gone.groupBy("sample").agg(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b")))).alias("parents"))
    # judged anew only where reads were removed
    rest = spans.join(mine.select("sample"), "sample", "left_semi").join(gone.select("sample", "ord"), ["sample", "ord"], "left_anti")
    accepted = lambda m, name: m.where("reason is null").groupBy("sample").agg(F.collect_list("center").alias(name))
    both = accepted(model, "c").join(mine, "sample").join(accepted(length_model(bp(rest), s), "new"), "sample")
    near = lambda x, others: F.exists(others, lambda y: F.abs(x - y) <= half_window(y, s))
    sound = both.where(F.forall("new", lambda x: near(x, F.col("c"))) & F.forall("parents", lambda x: near(x, F.col("new")))).select("sample")
    removed = keep(gone.join(sound, "sample", "left_semi").select("sample", "ord"), "removed")
    return spans.join(removed, ["sample", "ord"], "left_anti"), pairs
