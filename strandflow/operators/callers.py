"""Two callers against known truth: error rates with exact intervals, paired tests, non-inferiority. All from counted cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .evaluate import holm_adjusted, interval

CALLERS = ("current", "candidate")
#: Error of a call, and the truth among which it can be made.
ERRORS = {"missed": True, "false_call": False}


def cases(rows: DataFrame, key: str, profile: str, stratum: str, callers: dict[str, str]) -> DataFrame:
    """One row for each key: profile, stratum and the callers' calls (SQL expressions over a row).

    A null call is no call. A key that occurs several times is called if all its rows are, in the smallest of their profiles and strata; rows of
    no key are left out, and a null or empty profile or stratum is "unassigned".
    """
    named = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unassigned"))
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), named(profile).alias("profile"), named(stratum).alias("stratum"), *[F.coalesce(F.expr(callers[c]), F.lit(False)).alias(c) for c in CALLERS])
    return each.groupBy("key").agg(F.min("profile").alias("profile"), F.min("stratum").alias("stratum"), *[F.bool_and(c).alias(c) for c in CALLERS])


def truths(rows: DataFrame, key: str, positive: str) -> DataFrame:
    """(key, truth): whether it is positive; keys whose rows disagree, and null truths, are left out."""
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.expr(positive).alias("truth"))
    return each.groupBy("key").agg(F.min("truth").alias("truth"), F.max("truth").alias("_most")).where("truth = _most").drop("_most")


def cells(found: DataFrame, known: DataFrame) -> DataFrame:
    """Cases with a truth, counted by profile, stratum, truth and both calls: at most eight rows for each stratum."""
    return found.join(known, "key").groupBy("profile", "stratum", "truth", *CALLERS).agg(F.count("*").alias("n"))


def _when(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def rates(counted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(profile, stratum, caller, metric, k, n, rate, low, high); a null stratum is the whole profile. A metric without cases has no row."""
    errors = [F.struct(F.lit(c).alias("caller"), F.lit(m).alias("metric"), (F.col(c) != F.col("truth")).alias("wrong"), (F.col("truth") == t).alias("counts")) for c in CALLERS for m, t in ERRORS.items()]
    long = counted.select("profile", "stratum", "n", F.explode(F.array(*errors)).alias("x")).select("profile", "stratum", "n", "x.*").where("counts")
    sets = [[F.col(c) for c in ("profile", "caller", "metric", *more)] for more in ((), ("stratum",))]
    out = long.groupingSets(sets, "profile", "caller", "metric", "stratum").agg(_when(F.col("wrong")).alias("k"), F.sum("n").alias("n"))
    return interval(out.withColumn("rate", F.col("k") / F.col("n")), alpha=alpha).select("profile", "stratum", "caller", "metric", "k", "n", "rate", "low", "high")


def paired(counted: DataFrame, margin: float, alpha: float = 0.05) -> DataFrame:
    """Candidate against current, per profile and metric: b (only the candidate is right), c (only the current), exact p, Holm over the
    metrics, difference of the error rates with its upper bound, and whether the candidate is superior or within ``margin``."""
    metrics = [F.struct(F.lit(m).alias("metric"), (F.col("truth") == t).alias("counts")) for m, t in ERRORS.items()]
    long = counted.select("*", F.explode(F.array(*metrics)).alias("x")).select("profile", "truth", *CALLERS, "n", "x.*").where("counts")
    old, new = (F.col(c) != F.col("truth") for c in CALLERS)
    sums = long.groupBy("profile", "metric").agg(_when(old & ~new).alias("b"), _when(new & ~old).alias("c"), _when(old).alias("_old"), _when(new).alias("_new"), F.sum("n").alias("n"))
    tested = holm_adjusted(sums.withColumn("p", stats.mcnemar_exact("b", "c")), ["profile"], "p", "metric")
    bound = stats.newcombe("_new", "n", "_old", "n", margin, alpha)
    out = tested.withColumn("_x", bound).withColumn("superior", (F.col("b") > F.col("c")) & (F.col("adjusted") < alpha))
    return out.select("profile", "metric", "b", "c", "n", "p", "adjusted", F.col("_x.difference").alias("difference"), F.col("_x.upper").alias("upper"), F.col("_x.noninferior").alias("noninferior"), "superior")
