"""Evaluation of predictions, stratified tables, adoption rule, targets, calibration and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from .aggregates import grouping_rates


def interval(df: DataFrame, k: str = "k", n: str = "n", alpha: float = 0.05) -> DataFrame:
    """Adds low and high; the interval is worked out once for each distinct (k, n), which are dealt to all cores."""
    ci = df.select(k, n).distinct().repartition(2 * df.sparkSession.sparkContext.defaultParallelism).withColumn("_ci", stats.clopper_pearson(k, n, alpha))
    return df.join(ci, [k, n]).select(*df.columns, F.col("_ci.low").alias("low"), F.col("_ci.high").alias("high"))


def stratified(rows: DataFrame, by: list[str], outcome: Column, alpha: float = 0.05) -> DataFrame:
    """k, n, rate and exact interval for each stratum."""
    out = rows.withColumn("_k", outcome.cast("long")).groupBy(*by).agg(F.sum("_k").alias("k"), F.count("_k").alias("n"), F.avg("_k").alias("rate"))
    return interval(out, alpha=alpha)


def tables(rows: DataFrame, sets: list[list[str]], outcome: Column, alpha: float = 0.05) -> DataFrame:
    return interval(grouping_rates(rows, sets, outcome), alpha=alpha)


def worst_assignment(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of equally good assignments, the one least in the prediction's favour."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order, "alternative"))).where("_r = 1").drop("_r")


def bounds(rows: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Least and largest value of each metric over a sample's tied assignments."""
    return rows.groupBy(*key).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("min", F.min), ("max", F.max))])


def bounded_ratios(samples: DataFrame) -> DataFrame:
    """Recall from the fewest true positives; precision from the fewest true and most false positives; null over nothing."""
    s = samples.agg(F.sum("tp_min").alias("tp"), F.sum("fp_max").alias("fp"), F.sum("truth_events").alias("truth"))
    return s.select("tp", "fp", "truth", F.try_divide("tp", "truth").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def judge_targets(rates: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(metric, minimum, maximum, binding): met, and binding misses; an empty cohort fails, an absent metric is null."""
    both = targets.join(rates, "metric", "left")
    met = F.when(F.col("n").isNull(), None).when(F.col("n") == 0, False).otherwise(
        F.coalesce(F.col("rate") >= F.col("minimum"), F.lit(True)) & F.coalesce(F.col("rate") <= F.col("maximum"), F.lit(True))
    )
    return both.withColumn("met", met).withColumn("fails", F.col("binding") & ~F.coalesce(met, F.lit(False)))


def adoption(rows: DataFrame, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Per profile: McNemar for each metric (candidate better b, worse c), Holm over them, superior if b > c and p < alpha.

    rows(profile, and for each metric <m>_base and <m>_new as 0 or 1, 1 being good).
    """
    sums = rows.groupBy("profile").agg(*[F.count_if((F.col(f"{m}_new") == 1) & (F.col(f"{m}_base") == 0)).alias(f"{m}_b") for m in metrics], *[F.count_if((F.col(f"{m}_new") == 0) & (F.col(f"{m}_base") == 1)).alias(f"{m}_c") for m in metrics])
    long = sums.select("profile", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_b").alias("b"), F.col(f"{m}_c").alias("c")) for m in metrics])).alias("x")).select("profile", "x.*")
    p = long.withColumn("p", stats.mcnemar_exact("b", "c"))
    adjusted = holm_adjusted(p, ["profile"], "p", "metric")
    return adjusted.withColumn("superior", (F.col("b") > F.col("c")) & (F.col("adjusted") < alpha))


def holm_adjusted(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p-values: running maximum of (n - i + 1) p, at most 1. A family has a handful of tests."""
    order = W.partitionBy(*family).orderBy(p, tie)
    scaled = (F.count("*").over(W.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p)
    out = df.withColumn("_s", scaled)
    return out.withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))).drop("_s")


def judge_objective(metrics: DataFrame, constraints: DataFrame) -> DataFrame:
    """Violated constraints of each point; a null metric violates. metrics(point, metric, value), constraints(metric, minimum, maximum)."""
    points = metrics.select("point").distinct()
    need = points.crossJoin(F.broadcast(constraints))  # an objective has a handful of constraints
    both = need.join(metrics, ["point", "metric"], "left")
    bad = ~F.coalesce((F.coalesce(F.col("value") >= F.col("minimum"), F.col("minimum").isNull())) & (F.coalesce(F.col("value") <= F.col("maximum"), F.col("maximum").isNull())) & F.col("value").isNotNull(), F.lit(False))
    return both.groupBy("point").agg(F.array_sort(F.array_compact(F.collect_list(F.when(bad, F.col("metric"))))).alias("violated")).withColumn("feasible", F.size("violated") == 0)


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, *, replicates: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean of rows and percentile interval over resampled clusters.

    Clusters become (sum, n); each replicate weighs a cluster by a Poisson(1) draw from a hash, so replicates need
    neither a driver loop nor a shared generator, and the result depends on the seed only.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = (F.pmod(F.xxhash64(cluster, "r", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cuts, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum((u > c).cast("int") for c in cuts)
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    ci = means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))
    return sums.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean")).crossJoin(ci)


def assign_lengths(truth: DataFrame, peaks: DataFrame, reach: float) -> DataFrame:
    """Per sample the matching of at most two truth lengths and peaks with fewest unmatched, then least distance, then a fixed order.

    truth(sample, lengths), peaks(sample, centers): arrays in order. Adds pairs, missed, extra.
    """
    both = truth.join(peaks, "sample", "left").withColumn("centers", F.coalesce("centers", F.array().cast("array<double>")))
    options = [(), ((0, 0),), ((0, 1),), ((1, 0),), ((1, 1),), ((0, 0), (1, 1)), ((0, 1), (1, 0))]
    plans = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in o]).cast("array<struct<t:int,p:int>>").alias("pairs")) for i, o in enumerate(options)])
    gap = lambda x: F.abs(F.get("lengths", x["t"]) - F.get("centers", x["p"]))
    fits = F.filter(plans, lambda q: F.forall(q["pairs"], lambda x: F.coalesce(gap(x) <= reach, F.lit(False))))
    best = F.array_min(F.transform(fits, lambda q: F.struct((F.size("lengths") + F.size("centers") - 2 * F.size(q["pairs"])).alias("left"), F.aggregate(q["pairs"], F.lit(0.0), lambda a, x: a + gap(x)).alias("d"), q["i"].alias("i"), F.size(q["pairs"]).alias("n"))))
    out = both.withColumn("_b", best)
    return out.select("sample", F.col("_b.n").alias("matched"), F.col("_b.d").alias("distance"), (F.size("lengths") - F.col("_b.n")).alias("missed"), (F.size("centers") - F.col("_b.n")).alias("extra"))


def cohort_summary(runs: DataFrame, group: list[str]) -> DataFrame:
    """Runs and distinct biological samples, callable and recovered; nothing is dropped from a denominator."""
    d = lambda c: F.count_distinct(F.when(c, F.col("biological_sample")))
    call, got = F.coalesce(F.col("callable"), F.lit(False)), F.coalesce(F.col("recovered"), F.lit(False))
    return runs.groupBy(*group).agg(
        F.count("*").alias("runs"), F.count_if(call).alias("callable_runs"), F.count_if(got).alias("recovered_runs"),
        F.count_distinct("biological_sample").alias("samples"), d(call).alias("callable_samples"), d(got).alias("recovered_samples"),
    )


def compare_metrics(found: DataFrame, targets: DataFrame) -> DataFrame:
    """found(metric, value) against targets(metric, target, tolerance): within, null where not measured."""
    both = targets.join(found, "metric", "left")
    return both.withColumn("within", F.abs(F.col("value") - F.col("target")) <= F.col("tolerance"))
