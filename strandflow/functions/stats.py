"""Exact tests and intervals as Columns: sums of probability terms by recursion, no special functions needed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col


def log_factorial(n) -> Column:
    """ln n!: exact logs up to 20, beyond them Stirling's series, whose error there is under 1e-15."""
    n = col(n)
    small = F.expr(f"array({', '.join(f'{math.lgamma(i + 1)!r}D' for i in range(21))})")
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.get(small, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def log_binomial(n, k) -> Column:
    """ln C(n, k)."""
    n, k = col(n), col(k)
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _terms(first: Column, start: Column, end: Column, ratio) -> Column:
    """Sum of exp(log term) for j in start..end, given the first log term and log ratio of term j to j - 1."""
    step = lambda acc, j: F.struct((acc["t"] + ratio(j)).alias("t"), (acc["s"] + F.exp(acc["t"] + ratio(j))).alias("s"))
    more = F.when(end > start, F.sequence((start + 1).cast("long"), end.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(more, F.struct(first.alias("t"), F.exp(first).alias("s")), step)["s"]


def _beyond(log_choose: Column, k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for k at or above the mean: terms fall faster than a normal curve, so 5 sqrt(n) + 10 of them are all."""
    last = F.least(n, k + F.ceil(5 * F.sqrt(n.cast("double"))) + 10)
    odds = F.log(p) - F.log(1 - p)
    return _terms(log_choose + k * F.log(p) + (n - k) * F.log(1 - p), k, last, lambda j: F.log((n - j + 1) / j) + odds)


def binomial_upper_tail(k, n, p) -> Column:
    """P(X >= k), exact in log space; the work grows with the root of n."""
    k, n, p = col(k), col(n), col(p)
    # below the mean: one minus the other tail, seen from the failures
    tail = F.when(k >= n * p, _beyond(log_binomial(n, k), k, n, p)).otherwise(1 - _beyond(log_binomial(n, n - k + 1), n - k + 1, n, 1 - p))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(F.least(tail, F.lit(1.0)))


def binomial_lower_tail(k, n, p) -> Column:
    """P(X <= k)."""
    k, n, p = col(k), col(n), col(p)
    return binomial_upper_tail(n - k, n, 1 - p)


def clopper_pearson(k, n, alpha: float = 0.05, steps: int = 9) -> Column:
    """Exact interval (low, high) of a rate; null for n = 0. Use it on distinct (k, n).

    Newton steps on the log of the binomial tail against the log of p, from Wilson's bound. The tail's derivative is a
    single term, and its log is concave in log p, so after the first step they rise to the bound and don't pass it.
    """
    k, n = col(k), col(n)
    z = probit(1 - alpha / 2)

    def lower(k: Column) -> Column:
        """The p at which P(X >= k), rising in p, reaches alpha / 2."""

        def step(acc: Column, _: Column) -> Column:
            p = F.exp(acc["x"])
            tail = _beyond(acc["c"], k, n, p)
            slope = F.exp(acc["c"] + F.log(k.cast("double")) + k * acc["x"] + (n - k) * F.log1p(-p)) / tail
            x = acc["x"] - (F.log(tail) - math.log(alpha / 2)) / slope
            return F.struct(F.least(x, acc["top"]).alias("x"), acc["top"].alias("top"), acc["c"].alias("c"))

        top = F.log((k - 0.001) / n)  # just below k / n, where the tail is over a half
        start, _ = wilson(k, n, z)
        first = F.struct(F.least(F.log(F.greatest(start, F.lit(0.2) * k / n)), top).alias("x"), top.alias("top"), log_binomial(n, k).alias("c"))
        found = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda acc: acc["x"]))
        # all of n: P(X >= n) is p to the n
        return F.when(k <= 0, 0.0).when(k >= n, F.pow(F.lit(alpha / 2), 1 / n)).otherwise(found)

    # the upper bound is one minus the lower bound of the failures
    return F.when(n > 0, F.struct(lower(k).alias("low"), (1 - lower(n - k)).alias("high")))


def mcnemar_exact(b, c) -> Column:
    """Two-sided exact p of discordant counts: all outcomes as likely as the observed or less."""
    b, c = col(b), col(c)
    n, k = b + c, F.least(b, c)
    # symmetric at one half: both tails
    tail = 2 * binomial_lower_tail(k, n, F.lit(0.5))
    return F.when(n == 0, 1.0).otherwise(F.least(tail, F.lit(1.0)))


def fisher_lower(a, row, column, total) -> Column:
    """P(X <= a) of a hypergeometric count: ``row`` drawn of ``total`` of which ``column`` are marked."""
    a, row, column, total = map(col, (a, row, column, total))
    low = F.greatest(F.lit(0), row + column - total)
    first = log_binomial(column, low) + log_binomial(total - column, row - low) - log_binomial(total, row)
    ratio = lambda j: F.log((column - j + 1) * (row - j + 1) / (j * (total - column - row + j)))
    return F.when(a < low, 0.0).when(a >= F.least(row, column), 1.0).otherwise(F.least(_terms(first, low, a, ratio), F.lit(1.0)))


def probit(p: float) -> float:
    """Normal quantile of a literal, on the driver."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normal_below(z) -> Column:
    """P(Z <= z) of a normal variable: the error function's series near 0, its continued fraction beyond."""
    z = col(z).cast("double")
    x = F.abs(z) / math.sqrt(2)
    step = lambda acc, k: F.struct((acc["t"] * -x * x / k).alias("t"), (acc["s"] + acc["t"] * -x * x / k / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), step)["s"] * (2 / math.sqrt(math.pi))
    deep = F.aggregate(F.sequence(F.lit(40), F.lit(1)), F.lit(1.0), lambda acc, k: 1 + k / (2 * x * x) / acc)
    tail = F.when(x < 3, 1 - series).otherwise(F.exp(-x * x) / (x * math.sqrt(math.pi)) / deep)  # of both sides
    return F.when(z > 0, 1 - tail / 2).otherwise(tail / 2)


def wilson(x, n, z: float) -> tuple[Column, Column]:
    x, n = col(x), col(n)
    p, w = x / n, z * z / n
    mid, half = (p + w / 2) / (1 + w), z * F.sqrt(p * (1 - p) / n + w / (4 * n)) / (1 + w)
    return mid - half, mid + half


def newcombe(x1, n1, x0, n0, margin: float, alpha: float = 0.05) -> Column:
    """(difference, upper, noninferior): one-sided hybrid score bound of rate 1 minus rate 0."""
    z = probit(1 - alpha)
    _, u1 = wilson(x1, n1, z)
    l0, _ = wilson(x0, n0, z)
    p1, p0 = col(x1) / col(n1), col(x0) / col(n0)
    upper = (p1 - p0) + F.sqrt((u1 - p1) * (u1 - p1) + (p0 - l0) * (p0 - l0))
    return F.struct((p1 - p0).alias("difference"), upper.alias("upper"), (upper < margin).alias("noninferior"))


def phi(a, b, c, d) -> Column:
    """Signed phi of a two by two table; 0 if a margin is empty."""
    a, b, c, d = (col(x).cast("double") for x in (a, b, c, d))
    return F.coalesce(F.try_divide(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d))), F.lit(0.0))


def smoothed(counts: Column, size: int = 17, pseudo: float = 0.5) -> Column:
    """A map of counts by length as ``size`` probabilities, each with ``pseudo`` added."""
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(counts, i), F.lit(0)) + pseudo)
    total = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)
    return F.transform(filled, lambda x: x / total)


def shifted(p: Column, d: int) -> Column:
    """Probabilities moved by ``d`` places: what comes in at an end repeats it, and the whole is one again."""
    moved = F.transform(p, lambda x, i: F.get(p, F.greatest(F.least(i - d, F.size(p) - 1), F.lit(0))))
    total = F.aggregate(moved, F.lit(0.0), lambda a, x: a + x)
    return F.transform(moved, lambda x: x / total)


def pcr_share(short, long, slope: float, floor: float = 0.05, cap: float = 0.5) -> Column:
    """Share of templates that the longer allele keeps after PCR: logistic in the length difference (kb)."""
    return F.greatest(F.lit(floor), F.least(F.lit(cap), 1 / (1 + F.exp(slope * (col(long) - col(short)) / 1000))))


def depth_floor(least: int, af: float) -> int:
    return math.ceil(least / af)
