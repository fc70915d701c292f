"""The reference-ladder route's relational parts: filters, phase evidence, applied edits, stage agreement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .aggregates import bimodal_split, dominance, gap_clusters, valley_split
from .joins import missing


def filter_variants(variants: DataFrame, least_quality: float, least_depth: int) -> DataFrame:
    return variants.where((F.col("filter") == "PASS") & (F.col("qual") >= least_quality) & (F.coalesce("dp", F.lit(0)) >= least_depth))


def phase_evidence(variants: DataFrame) -> DataFrame:
    """Per sample: heterozygous sites, phase sets, overlaps; a status by them. variants(sample, pos, ref, genotype, phase_set)."""
    w = W.partitionBy("sample").orderBy("pos", "ref")
    end = F.col("pos") + F.length("ref")
    het = F.regexp_extract("genotype", r"^(\d+)", 1) != F.regexp_extract("genotype", r"(\d+)$", 1)
    marked = variants.withColumn("_overlap", F.coalesce(F.col("pos") < F.lag(end).over(w), F.lit(False))).withColumn("_het", het)
    n = marked.groupBy("sample").agg(
        F.count_if("_het").alias("het"), F.count_distinct(F.when(F.col("_het"), F.col("phase_set"))).alias("sets"),
        F.count_if(F.col("_het") & ~F.col("genotype").contains("|")).alias("unphased"), F.max("_overlap").alias("overlap"),
    )
    status = (
        F.when(F.col("overlap"), "overlapping")
        .when(F.col("het") == 0, "homozygous")
        .when(F.col("het") == 1, "single_site")
        .when((F.col("unphased") == 0) & (F.col("sets") == 1), "phased")
        .otherwise("unphased")
    )
    return n.withColumn("status", status)


def apply_variants(contigs: DataFrame, variants: DataFrame) -> DataFrame:
    """Consensus of each contig (id, seq) with its variants (id, pos, ref, alt), applied from the right so places hold."""
    listed = variants.groupBy("id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt")))).alias("_v"))
    step = lambda s, v: F.concat(F.substring(s, F.lit(1), v["pos"] - 1), v["alt"], F.substring(s, v["pos"] + F.length(v["ref"]), F.length(s)))
    none = F.array().cast("array<struct<pos:int,ref:string,alt:string>>")
    both = contigs.join(listed, "id", "left")
    return both.select(*contigs.columns, F.aggregate(F.coalesce("_v", none), F.col("seq"), step).alias("consensus"))


def stage_discordance(pileup: DataFrame, applied: DataFrame, *, af: float = 0.5, depth: int = 10) -> DataFrame:
    """Frameshifts that the pileup shows and the applied calls lack, per sample."""
    shift = F.pmod(F.length("alt") - F.length("ref"), F.lit(3)) != 0
    seen = pileup.where(shift & (F.col("af") >= af) & (F.col("dp") >= depth))
    left = missing(seen, applied, ["sample", "pos", "ref", "alt"])
    return pileup.select("sample").distinct().join(left.groupBy("sample").agg(F.count("*").alias("discordant")), "sample", "left").fillna(0, ["discordant"])


def detect_alleles(counts: DataFrame, *, least: int = 10, gap: int = 5, fixed_units: int = 9) -> DataFrame:
    """The two heaviest length clusters of each sample, as allele lengths; one cluster: homozygous."""
    c = gap_clusters(counts, ["sample"], "units", "n", least=least, gap=gap)
    r = F.row_number().over(W.partitionBy("sample").orderBy(F.col("total").desc(), "center"))
    return c.withColumn("rank", r).where("rank <= 2").withColumn("length", F.col("center") + fixed_units).withColumn("homozygous", F.count("*").over(W.partitionBy("sample")) == 1)


@dataclass(frozen=True)
class LadderSettings:
    least: int = 10
    gap: int = 5
    fixed_units: int = 9
    unit_bp: int = 60
    margin: int = 43
    dominant: int = 3
    ratio: float = 0.01
    apart: int = 6
    extra: int = 2
    minority: int = 3
    valley_points: int = 3
    valley_apart: int = 3
    split_reads: int = 5
    split_share: float = 0.15
    bin_bp: int = 5
    low_bp: int = 45
    high_bp: int = 320
    tolerance_bp: int = 15
    offset_bp: int = 30


def _primary() -> Column:
    """Records that are mapped, primary and whole."""
    return F.col("flag").bitwiseAND(4 | 256 | 2048) == 0


def length_modes(own: DataFrame, s: LadderSettings = LadderSettings()) -> DataFrame:
    """(sample, a, b): unit counts of two modes of the read lengths, a whole number of units apart; own: records of a sample's only cluster."""
    lengths = own.where(_primary()).select("sample", "length")
    two = bimodal_split(lengths, ["sample"], width=s.bin_bp, reads=s.split_reads, share=s.split_share, unit_bp=s.unit_bp)
    off = F.abs(F.col("first") - F.col("second"))
    rest = F.pmod(off, F.lit(s.unit_bp))
    good = (F.col("second_n") >= s.split_reads) & (F.col("second_n") >= F.floor(s.split_share * F.col("total"))) & off.between(s.low_bp, s.high_bp) & ((rest <= s.tolerance_bp) | (rest >= s.unit_bp - s.tolerance_bp))
    units = lambda c: (F.bround((F.col(c) - s.offset_bp) / s.unit_bp) - s.fixed_units).cast("int")
    return two.where(good).select("sample", F.least(units("first"), units("second")).alias("a"), F.greatest(units("first"), units("second")).alias("b")).where("a < b")


def indel_valleys(own: DataFrame, s: LadderSettings = LadderSettings()) -> DataFrame:
    """(sample, a, b): the contigs at which reads need fewest inserted and deleted bases, where there are two apart."""
    series = own.groupBy("sample", "units").agg(F.avg("indel").alias("indel"))
    enough = series.groupBy("sample").agg(F.count("*").alias("_c")).where(F.col("_c") >= s.valley_points).select("sample")
    return valley_split(series.join(enough, "sample"), ["sample"], apart=s.valley_apart).select("sample", F.col("low").cast("int").alias("a"), F.col("high").cast("int").alias("b")).distinct()


def accepted(sides: DataFrame, records: DataFrame, s: LadderSettings = LadderSettings()) -> DataFrame:
    """Of attempts those whose second side is an allele of its own by its reads: (sample, attempt, first, second).

    sides(sample, attempt, side, units): the contigs of both sides; the side with more records is the first, unless ``side`` is fixed by a positive number. Each side is
    stood for by its contig of the best mean score.
    """
    by_contig = records.groupBy("sample", "units").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.count_if(_primary()).alias("primary"))
    best = F.max(F.struct("mean", (-F.col("units")).alias("u")))
    each = sides.join(by_contig, ["sample", "units"]).groupBy("sample", "attempt", "side").agg(F.sum("n").alias("n"), F.sum("primary").alias("primary"), (-best["u"]).alias("units"))
    order = F.row_number().over(W.partitionBy("sample", "attempt").orderBy(F.when(F.col("side") > 0, F.col("side")).otherwise(0), F.desc("n"), "units"))
    placed = each.withColumn("_r", order)
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    pairs = placed.groupBy("sample", "attempt").agg(pick(1, "units").alias("first"), pick(2, "units").alias("second"), pick(2, "primary").alias("primary2"))
    pairs = pairs.where((F.col("primary2") >= s.dominant) & (F.col("first") != F.col("second"))).withColumn("key", F.to_json(F.struct("sample", "attempt")))
    met = records.select("sample", "read", "units", "score").join(pairs, "sample").where("units in (first, second)")
    on = lambda c: F.max(F.when(F.col("units") == F.col(c), F.col("score")))
    scores = met.groupBy("key", "read", "first", "second", "primary2").agg(on("first").alias("s1"), on("second").alias("s2"))
    scores = scores.select(F.col("key").alias("sample"), "read", "s1", "s2", F.abs(F.col("first") - F.col("second")).alias("distance"), "primary2")
    valid = dominance(scores, delta=s.margin, least=s.dominant, ratio=s.ratio, apart=s.apart, extra=s.extra).where("valid").select(F.col("sample").alias("key"))
    return pairs.join(valid, "key", "left_semi").select("sample", "attempt", "first", "second")


def alleles_of_ladder(records: DataFrame, s: LadderSettings = LadderSettings()) -> DataFrame:
    """(sample, basis, first, second): canonical units of a sample's alleles and how they were found; second is null where only one was.

    records(sample, read, units, score, indel, length, flag): alignments of reads to the ladder's contigs. Two clusters of contigs are two alleles (``clusters``). One cluster
    is split by the modes of read lengths, else by valleys of inserted and deleted bases, else a cluster of few records away from it is
    looked for: the first attempt whose second allele stands on its own reads holds (``read_length``, ``indel_valley``, ``minority``), otherwise ``single``.
    """
    counts = records.groupBy("sample", "units").agg(F.count("*").alias("n"))
    clusters = gap_clusters(counts, ["sample"], "units", "n", least=s.least, gap=s.gap)
    own = W.partitionBy("sample")
    ranked = clusters.withColumns({"of": F.count("*").over(own), "r": F.row_number().over(own.orderBy(F.desc("total"), "center"))})
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("center"))).cast("int")
    two = ranked.where("of > 1").groupBy("sample").agg(at(1).alias("first"), at(2).alias("second")).withColumn("basis", F.lit("clusters"))
    one = ranked.where("of = 1").select("sample", "low", "high", "center")
    contigs = counts.join(one, "sample")
    inside = contigs.where("units between low and high").select("sample", "units")
    alone = records.join(inside, ["sample", "units"], "left_semi")

    def halves(pairs: DataFrame, attempt: int, ties: bool) -> DataFrame:
        near, far = F.abs(F.col("units") - F.col("a")), F.abs(F.col("units") - F.col("b"))
        side = F.when(near < far, 0).when(near > far, -1).when(F.lit(ties), 0)
        return inside.join(pairs, "sample").select("sample", F.lit(attempt).alias("attempt"), side.alias("side"), "units").where("side is not null")

    few = gap_clusters(contigs.where((F.abs(F.col("units") - F.col("center")) >= s.gap)).select("sample", "units", "n"), ["sample"], "units", "n", least=s.minority, gap=s.gap)
    few = few.withColumn("attempt", F.row_number().over(own.orderBy("low")) + 2)
    far = counts.join(few.select("sample", "attempt", F.col("low").alias("_a"), F.col("high").alias("_b")), "sample").where(F.col("units").between(F.col("_a"), F.col("_b")) & (F.col("n") >= s.minority))
    main = inside.join(few.select("sample", "attempt"), "sample").select("sample", "attempt", F.lit(1).alias("side"), "units")
    sides = halves(length_modes(alone, s), 1, False).unionByName(halves(indel_valleys(alone, s), 2, True)).unionByName(main).unionByName(far.select("sample", "attempt", F.lit(2).alias("side"), "units"))
    found = accepted(sides, records, s).groupBy("sample").agg(F.min(F.struct("attempt", "first", "second")).alias("m"))
    basis = F.when(F.col("m.attempt") == 1, "read_length").when(F.col("m.attempt") == 2, "indel_valley").when(F.col("m.attempt") > 2, "minority").otherwise("single")
    rest = one.join(found, "sample", "left").select("sample", basis.alias("basis"), F.coalesce(F.col("m.first").cast("int"), F.col("center").cast("int")).alias("first"), F.col("m.second").cast("int").alias("second"))
    return two.select("sample", "basis", "first", "second").unionByName(rest)
