"""Curated cohorts: every run of an inventory scored against the truth of its sample, also runs that failed or have no truth.

Sequences are cut by anchors that occur once, and compared as sets of haplotypes by the assignments of least cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequence import is_dna, unique_place

#: Why a run isn't compared, in order of precedence.
NO_TRUTH = "no independent sequence truth"
NO_RUN = "run lacks validated completed artifacts"
NO_SEQUENCES = "missing sequence observations"
NOT_ONCE = "boundary anchors must occur exactly once (unique exact match)"
NOT_ORDERED = "boundary anchors overlap or have reversed order"


def interval(seq, left, right) -> Column:
    """struct(start, end, problem): 0-based stretch of ``seq`` from the left to the right anchor, both with it. Without anchors all of it."""
    seq, left, right = F.upper(seq), F.upper(left), F.upper(right)
    a, b = unique_place(seq, left), unique_place(seq, right)
    bare = left.isNull() & right.isNull()
    problem = F.when(bare, F.lit(None)).when(a.isNull() | b.isNull(), NOT_ONCE).when(b < a + F.length(left), NOT_ORDERED)
    start = F.when(bare, 0).when(problem.isNull(), a - 1)
    end = F.when(bare, F.length(seq)).when(problem.isNull(), b - 1 + F.length(right))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), problem.alias("problem"))


def _cut(rows: DataFrame) -> DataFrame:
    """rows(..., seq, left, right) with the stretch as ``value``."""
    at = rows.withColumn("_at", interval(F.col("seq"), F.col("left"), F.col("right")))
    value = F.when(F.col("_at.problem").isNull(), F.substring(F.upper("seq"), F.col("_at.start") + 1, F.col("_at.end") - F.col("_at.start")))
    return at.withColumns({"value": value, "start": F.col("_at.start"), "end": F.col("_at.end"), "problem": F.col("_at.problem")}).drop("_at")


def recoverable(calls: DataFrame, key: str) -> DataFrame:
    """calls(key, p, value, independent, origin) with whether each counts as recovered by itself.

    Of calls with one sequence all count if each is independent with an origin of its own, else the first; of calls of one origin only the first counts.
    """
    same, source = W.partitionBy(key, "value"), W.partitionBy(key, "origin")
    proven = F.min(F.coalesce(F.col("independent") & F.col("origin").isNotNull(), F.lit(False))).over(same) & (F.size(F.collect_set("origin").over(same)) == F.count("*").over(same))
    first = (F.row_number().over(same.orderBy("p")) == 1) | proven
    first_of_source = F.col("origin").isNull() | (F.row_number().over(source.orderBy("p")) == 1)
    return calls.withColumn("recoverable", first & first_of_source)


def assignments(n_truth: Column, n_calls: Column) -> Column:
    """All ways to give every truth a call of its own or (-1) none, with as many pairs as there can be. For the few alleles of a sample: ways grow with their factorial."""
    calls = F.when(n_calls > 0, F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), n_calls - 1))).otherwise(F.array(F.lit(-1)))
    widen = lambda plans, _: F.flatten(F.transform(plans, lambda plan: F.transform(F.filter(calls, lambda c: (c == -1) | ~F.array_contains(plan, c)), lambda c: F.concat(plan, F.array(c)))))
    plans = F.aggregate(F.sequence(F.lit(1), n_truth), F.array(F.array().cast("array<int>")), widen)
    return F.filter(plans, lambda plan: F.size(F.filter(plan, lambda c: c >= 0)) == F.least(n_truth, n_calls))


def best_assignments(truths: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """truths(key, t, value), calls(key, p, value, recoverable), t and p from 0 without gaps: one row per key with

    ``distance`` (least total of edits), ``ways`` (number of assignments that reach it), ``literal_exact`` and ``independent_exact`` (fewest
    equal pairs, and fewest of recoverable calls, over these ways). A key without calls has distance 0. Every pair of sequences is a row, so a
    sample's distances are worked out by several tasks.
    """
    t = truths.select(key, "t", F.col("value").alias("_t"))
    pairs = t.join(calls.select(key, "p", F.col("value").alias("_p"), "recoverable"), key)
    costed = pairs.select(key, "t", "p", F.levenshtein("_t", "_p").cast("long").alias("d"), (F.col("_t") == F.col("_p")).alias("exact"), "recoverable")
    cell = F.struct(F.struct("t", "p").alias("at"), F.struct("d", "exact", "recoverable").alias("pair"))
    table = costed.groupBy(key).agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"), (F.max("p") + 1).alias("n_calls"))
    size = truths.groupBy(key).agg((F.max("t") + 1).alias("n_truth"))
    both = size.join(table, key, "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))
    opened = both.select(key, "_cells", F.explode(assignments(F.col("n_truth"), F.col("n_calls"))).alias("_plan"))
    pair = F.transform("_plan", lambda c, i: F.when(c >= 0, F.try_element_at("_cells", F.struct(i.cast("int").alias("t"), c.cast("int").alias("p")))))
    taken = opened.withColumn("_pairs", F.filter(pair, lambda x: x.isNotNull()))
    count = lambda keep: F.size(F.filter("_pairs", keep))
    cost = F.aggregate("_pairs", F.lit(0).cast("long"), lambda n, x: n + x["d"])
    ways = taken.select(key, cost.alias("cost"), count(lambda x: x["exact"]).alias("_literal"), count(lambda x: x["exact"] & x["recoverable"]).alias("_own"))
    each = ways.groupBy(key, "cost").agg(F.count("*").alias("ways"), F.min("_literal").alias("literal_exact"), F.min("_own").alias("independent_exact"))
    best = each.groupBy(key).agg(F.min_by(F.struct("cost", "ways", "literal_exact", "independent_exact"), "cost").alias("b"))
    return best.select(key, F.col("b.cost").alias("distance"), "b.ways", "b.literal_exact", "b.independent_exact")


def compared(runs: DataFrame, truths: DataFrame, anchors: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for every run, with ``reason`` why it isn't compared (null if it is) and how its sequences agree.

    runs(run, sample, validated, callable), truths(sample, t, seq), anchors(sample, left, right), calls(run, p, seq, independent, origin); t and
    p count from 0. ``sequence_equal`` asks for equal multisets, recoverable calls alone and a callable run; ``independent_exact`` is 0 for a
    run that isn't callable. Truths that are no plain DNA or can't be cut are an error; called sequences may hold ambiguous letters.
    """
    run = runs.select("run", "sample", F.coalesce("validated", F.lit(False)).alias("validated"), F.coalesce("callable", F.lit(False)).alias("callable"))
    ends = anchors.select("sample", "left", "right")
    known = _cut(truths.join(ends, "sample", "left"))
    wrong = F.when(~is_dna(F.upper("seq")), F.raise_error(F.concat(F.lit("truth without plain DNA: "), "sample"))).when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("truth can't be cut: "), "sample")))
    known = known.where(wrong.cast("string").isNull()).select("sample", "t", "value")
    of_sample = known.groupBy("sample").agg(F.sort_array(F.collect_list("value")).alias("_expected"))
    seen = _cut(calls.join(run.select("run", "sample"), "run").join(ends, "sample", "left"))
    seen = seen.withColumn("_dna", is_dna(F.upper("seq"), ambiguous=True))
    of_run = seen.groupBy("run").agg(
        F.every("_dna").alias("_dna"),
        F.sort_array(F.collect_list("value")).alias("_values"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("p"))).alias("_problem"),
        F.sort_array(F.collect_list(F.struct("p", "start", "end"))).alias("intervals"),
    )
    rows = run.join(of_sample, "sample", "left").join(of_run, "run", "left")
    reason = F.when(F.col("_expected").isNull(), NO_TRUTH).when(~F.col("validated"), NO_RUN).when(F.col("_values").isNull() | ~F.col("_dna"), NO_SEQUENCES).otherwise(F.col("_problem"))
    rows = rows.withColumn("reason", reason)
    open_ = rows.where("reason is null").select("run", "sample")
    marked = recoverable(seen.join(open_.select("run"), "run", "left_semi"), "run")
    matched = best_assignments(open_.join(known, "sample").select("run", "t", "value"), marked, "run")
    alone = marked.groupBy("run").agg(F.every("recoverable").alias("_alone"))
    lengths = lambda c: F.sort_array(F.transform(c, F.length))
    equal = F.col("_values") == F.col("_expected")
    errors = F.when(F.size("_values") == F.size("_expected"), F.zip_with(lengths(F.col("_values")), lengths(F.col("_expected")), lambda a, b: a - b))
    when = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.join(matched, "run", "left").join(alone, "run", "left").select(
        "run", "sample", "reason",
        when(equal & F.col("_alone") & F.col("callable")).alias("sequence_equal"),
        when(equal).alias("literal_sequence_equal"),
        when(lengths(F.col("_values")) == lengths(F.col("_expected"))).alias("sequence_length_equal"),
        when(errors).alias("length_errors"),
        "distance", "ways", "literal_exact",
        F.when(F.col("callable"), F.col("independent_exact")).otherwise(when(F.lit(0))).alias("independent_exact"),
        when(F.col("intervals")).alias("intervals"),
    )
