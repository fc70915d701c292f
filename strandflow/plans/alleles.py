"""Reads to alleles: scan, length model, phasing, assignment, segmentation. Many samples at once, keyed by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReadSettings
from ..dictionary import Dictionary, default
from ..operators import lengths, phase, reads, segment
from ..operators.joins import nearest_peak


def reconstruct(raw: DataFrame, words: Dictionary | None = None, s: ReadSettings = ReadSettings(), *, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """Tables of a run over raw(sample, ord, name, seq, qual): categories, peaks, alleles, units, placed, members, assigned.

    ``placed``: every read of a peak with its group, null where two are as near; ``members``: the reads of each allele.

    Categories, fitted spans and groups are made by Python stages and read several times: ``keep(df, name)`` writes one of them
    and returns the written table. Without it they are worked out again for each use.
    """
    words = words or default()
    categories = keep(reads.categorize(raw, words, s), "categories")
    spans = categories.where("category = 'spanning'")
    fitted, dimers = lengths.without_dimers(spans, words, s, keep=keep)
    fitted = keep(fitted, "fitted")
    model = lengths.length_model(fitted.select("sample", F.col("length").cast("long").alias("length")))
    model = keep(model, "peaks")
    peaks = model.where("reason is null").select("sample", F.col("center").alias("center"), lengths.half_window(F.col("center"), lengths.LengthSettings()).alias("half"))
    placed = nearest_peak(fitted, peaks).where("class = 'assigned'").select("sample", "peak", "ord", "seq", "strand", "mean_q")
    groups = keep(phase.phase(placed, s, words, keep=keep), "groups")
    # all reads of a peak are counted, not only those of the sample that found its groups
    nearest = keep(phase.members(placed, groups), "placed")
    sizes = nearest.where("group is not null").groupBy("sample", "peak", "group").agg(F.count("*").alias("members"))
    from pyspark.sql.window import Window as W

    # the two largest groups, in order of length; a sample has a handful
    counted = groups.join(sizes, ["sample", "peak", "group"], "left").withColumn("reads", F.coalesce("members", F.lit(0))).drop("members")
    size = F.row_number().over(W.partitionBy("sample").orderBy(F.col("reads").desc(), "peak", "group"))
    two = counted.where("not excluded").withColumn("_r", size).where("_r <= 2").drop("excluded")
    order = F.row_number().over(W.partitionBy("sample").orderBy(F.length("seq"), "_r"))
    alleles = two.withColumn("allele", F.concat(F.lit("allele_"), order)).withColumn("depth", depth_status("reads", s)).drop("_r")
    first = keep(alleles, "drafts")
    own = first.select("sample", "peak", "group", "allele")
    members = nearest.join(own, ["sample", "peak", "group"]).join(placed.select("sample", "peak", "ord", "seq", "strand"), ["sample", "peak", "ord"])
    members = keep(members.select("sample", "allele", "ord", "seq", "strand"), "members")
    assigned = keep(reads.assign(categories.where("category <> 'spanning'"), first.select("sample", "allele", "seq"), s), "assigned")
    # reads that cover a part of an allele vote in that part
    better = phase.refine(first, members, reads.inside(assigned, categories, words, s), s)
    alleles = keep(first.drop("seq").join(better, ["sample", "allele"]), "alleles")
    units = segment.segments(alleles.select(F.concat_ws("/", "sample", "allele").alias("id"), "seq"), words)
    return {"categories": categories, "peaks": model, "dimers": dimers, "alleles": alleles, "units": units, "placed": nearest, "members": members, "assigned": assigned}


def depth_status(n, s: ReadSettings = ReadSettings()):
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n >= s.adequate_depth, "adequate").when(n >= s.low_depth, "low").otherwise("insufficient")
