"""Intake of reads: a status for each, counted lengths of a batch, and the profile of a sample from the counts of all its batches.

Counts are sums, so a batch is counted once, and a sample's profile follows from the batches' counts without the reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import ReadSettings
from ..plans.alleles import depth_status

BASES = "ACGT"
STATUSES = ("accepted", "no_id", "empty", "length_mismatch", "short")
LEDGER = "read_id string, status string, length long, a long, c long, g long, t long, sample string"
COUNTS = "sample string, status string, length long, n long, a long, c long, g long, t long"


def _letters(seq: Column, base: str) -> Column:
    """How often a base occurs, in either case."""
    return (F.length(seq) - F.length(F.translate(seq, base + base.lower(), ""))).cast("long")


def checked(rows: DataFrame, read_id: str, sample: str, seq: str, length: str | None = None, least: int = 1) -> DataFrame:
    """A ledger row (LEDGER) for each of ``rows``; the status is the first problem found.

    ``length``: a column with the length the source states. Reads of no sample, or of an empty one, go to "unassigned".
    """
    text = F.col(seq)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    stated = F.col(length).cast("long") if length else F.lit(None).cast("long")
    status = (
        F.when(F.col(read_id).isNull(), "no_id").when(size == 0, "empty").when(F.coalesce(stated != size, F.lit(False)), "length_mismatch")
        .when(size < least, "short").otherwise("accepted")
    )
    own = F.coalesce(F.nullif(F.trim(F.col(sample).cast("string")), F.lit("")), F.lit("unassigned"))
    counts = [F.coalesce(_letters(text, b), F.lit(0).cast("long")).alias(b.lower()) for b in BASES]
    return rows.select(F.col(read_id).cast("string").alias("read_id"), status.alias("status"), size.alias("length"), *counts, own.alias("sample"))


def counted(ledger: DataFrame) -> DataFrame:
    """COUNTS of a ledger: how many reads of a sample have each status and length, and the bases in them."""
    return ledger.groupBy("sample", "status", "length").agg(F.count("*").alias("n"), *[F.sum(b.lower()).alias(b.lower()) for b in BASES])


def profile(counts: DataFrame, percents: tuple[int, ...] = (5, 50, 95), s: ReadSettings = ReadSettings()) -> DataFrame:
    """Per sample: reads, reads of each status, and of the accepted ones bases, nearest-rank lengths, N50, GC share and depth status.

    counts: COUNTS, any number of rows of one (sample, status, length). The windows go over a sample's distinct lengths.
    """
    whole = counts.groupBy("sample", "status", "length").agg(*[F.sum(c).alias(c) for c in ("n", "a", "c", "g", "t")])
    by = W.partitionBy("sample", "status")
    upto = by.orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    down = by.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    size = F.col("n") * F.col("length")
    placed = whole.select("*", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(by).alias("_all"), F.sum(size).over(down).alias("_down"), F.sum(size).over(by).alias("_size"))
    good = F.col("status") == "accepted"
    rank = lambda p: F.min(F.when(good & (F.col("_upto") > F.floor((F.col("_all") - 1) * p / 100)), F.col("length")))
    strong, weak = F.col("c") + F.col("g"), F.col("a") + F.col("t")
    out = placed.groupBy("sample").agg(
        F.sum("n").alias("reads"), *[F.coalesce(F.sum(F.when(F.col("status") == x, F.col("n"))), F.lit(0)).cast("long").alias(x) for x in STATUSES],
        F.coalesce(F.sum(F.when(good, size)), F.lit(0)).cast("long").alias("bases"), *[rank(p).alias(f"p{p}") for p in percents],
        F.max(F.when(good & (2 * F.col("_down") >= F.col("_size")), F.col("length"))).alias("n50"),
        F.round(F.try_divide(F.sum(F.when(good, strong)), F.sum(F.when(good, strong + weak))), 6).alias("gc"),
    )
    return out.withColumn("depth", depth_status("accepted", s))
