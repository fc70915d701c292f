"""Aggregations, windows and set operations of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .joins import by_rows, small


def modal(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first (smallest ``order``)."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = n.groupBy(*keys).agg(F.max(F.struct(F.col("n"), (-F.col("_first")).alias("_f"), F.col(value))).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def plurality(columns: DataFrame, slots: DataFrame, majority: float = 0.5) -> DataFrame:
    """Column votes (plurality, gaps included) and slot votes (an insertion needs more than ``majority`` of the votes).

    columns(key, pos, base, ord), slots(key, pos, inserted, ord); an absent insertion is the empty string. Rows: key, pos, base, inserted.
    """
    base = modal(columns, ["key", "pos"], "base", "ord").select("key", "pos", "base")
    votes = slots.groupBy("key", "pos").agg(F.count("*").alias("_all"))
    won = modal(slots.where("inserted <> ''"), ["key", "pos"], "inserted", "ord").join(votes, ["key", "pos"]).where(F.col("n") > majority * F.col("_all"))
    return base.join(won.select("key", "pos", "inserted"), ["key", "pos"], "left").withColumn("inserted", F.coalesce("inserted", F.lit("")))


def spell(voted: DataFrame) -> DataFrame:
    """The consensus of voted columns; a gap column gives nothing."""
    piece = F.concat("inserted", F.when(F.col("base") == "-", "").otherwise(F.col("base")))
    listed = voted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("s")))).alias("l"))
    return listed.select("key", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("consensus"))


def run_vote(observed: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Run length by half-up median of clean observations, at least 1."""
    return observed.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.median(length) + 0.5)).cast("int").alias("length"), F.count("*").alias("n"))


def concordance(observed: DataFrame, positions: DataFrame) -> DataFrame:
    """Mean over positions of agreeing share; positions(key, pos, base), observed(key, pos, base). Uncovered positions count 0."""
    each = observed.groupBy("key", "pos", "base").agg(F.count("*").alias("n"))
    cover = each.groupBy("key", "pos").agg(F.sum("n").alias("cover"))
    match = positions.join(each, ["key", "pos", "base"], "left").join(cover, ["key", "pos"], "left")
    return match.groupBy("key").agg(F.avg(F.coalesce(F.col("n") / F.col("cover"), F.lit(0.0))).alias("concordance"))


def residual_sites(observed: DataFrame, positions: DataFrame, share: float = 0.25) -> DataFrame:
    """Per position the first other allele of at least ``share``: most frequent, of equals seen first."""
    cons = positions.select("key", "pos", F.col("base").alias("_cons"))
    n = observed.groupBy("key", "pos", "base").agg(F.count("*").alias("n"), F.min("ord").alias("_first"))
    total = n.groupBy("key", "pos").agg(F.sum("n").alias("cover"))
    other = n.join(total, ["key", "pos"]).join(cons, ["key", "pos"]).where((F.col("base") != F.col("_cons")) & (F.col("n") >= share * F.col("cover")))
    best = other.groupBy("key", "pos").agg(F.max(F.struct("n", (-F.col("_first")).alias("f"), "base", "cover")).alias("b"))
    return best.select("key", "pos", F.col("b.base").alias("base"), F.col("b.n").alias("n"), (F.col("b.n") / F.col("b.cover")).alias("af"))


def run_histogram(runs: DataFrame, exclude: Column, cap: int = 16) -> DataFrame:
    """Per strand and capped observed length, how often; the event's own run left out."""
    return runs.where(~exclude).groupBy("key", "strand", F.least(F.col("length"), F.lit(cap)).alias("length")).agg(F.count("*").alias("n"))


def gap_clusters(counts: DataFrame, keys: list[str], value: str, weight: str, *, least: int, gap: int) -> DataFrame:
    """Islands of values less than ``gap`` apart, among those of at least ``least`` weight: weighted centre (half-even) and total."""
    w = W.partitionBy(*keys).orderBy(value)
    kept = counts.where(F.col(weight) >= least)
    new = (F.col(value) - F.lag(value).over(w) >= gap).cast("int")
    island = kept.withColumn("_island", F.sum(F.coalesce(new, F.lit(0))).over(w))
    out = island.groupBy(*keys, "_island").agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.sum(weight).alias("total"), F.bround(F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).cast("long").alias("center")
    )
    return out.drop("_island")


def best_contig(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Per contig mean score, mean indel and record classes; the best-scored contig of each key (ties: smaller contig).

    reads(keys, contig, score, indel, flag). Primary records have none of the flags 4, 256, 2048.
    """
    primary = F.col("flag").bitwiseAND(4 | 256 | 2048) == 0
    sums = reads.groupBy(*keys, "contig").agg(F.avg("score").alias("mean_score"), F.avg("indel").alias("mean_indel"), F.count_if(primary).alias("primary"), F.count("*").alias("records"))
    top = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("mean_score").desc(), "contig"))
    return sums.withColumn("best", top == 1)


def dominance(scores: DataFrame, *, delta: int, least: int, ratio: float = 0.01, apart: int = 6, extra: int = 2) -> DataFrame:
    """Does a second contig stand on its own: reads whose scores differ by over ``delta`` count for one.

    scores(sample, read, s1, s2, distance, primary2): best scores on both contigs, null if none. A read on one contig only counts
    where the contigs are ``apart`` units or more away.
    """
    lone = F.col("distance") >= apart
    two = F.when(F.col("s1").isNull(), lone & F.col("s2").isNotNull()).otherwise(F.coalesce(F.col("s2") - F.col("s1") > delta, F.lit(False)))
    one = F.when(F.col("s2").isNull(), lone & F.col("s1").isNotNull()).otherwise(F.coalesce(F.col("s1") - F.col("s2") > delta, F.lit(False)))
    n = scores.groupBy("sample").agg(F.count_if(one).alias("d1"), F.count_if(two).alias("d2"), F.count_if(~one & ~two).alias("ambiguous"), F.min("primary2").alias("_p"))
    floor = F.lit(least) + F.when(F.col("_p") == 0, extra).otherwise(0)
    return n.withColumn("valid", (F.col("d2") >= floor) & F.coalesce(F.try_divide(F.col("d2"), F.col("d1") + F.col("d2")) >= ratio, F.lit(False))).drop("_p")


def confusion(rows: DataFrame, group: list[str], states: list[str]) -> DataFrame:
    """Truth by decision counts; unknown truth stays a row of its own."""
    return rows.groupBy(*group, F.coalesce("truth", F.lit("unknown")).alias("truth")).agg(*[F.count_if(F.col("decision") == s).alias(s) for s in states])


def ratios(rows: DataFrame, group: list[str], pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Sums and their ratios; a zero denominator gives null, never 0."""
    aggs = [F.sum(c).alias(f"{n}_{s}") for n, (k, d) in pairs.items() for s, c in (("k", k), ("n", d))]
    out = rows.groupBy(*group).agg(*aggs)
    return out.withColumns({n: F.try_divide(F.col(f"{n}_k"), F.col(f"{n}_n")) for n in pairs})


def grouping_rates(rows: DataFrame, sets: list[list[str]], outcome: Column) -> DataFrame:
    """k, n and rate over several groupings at once; ``grouping`` tells a null key from one not grouped by."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    listed = [[F.col(k) for k in s] for s in sets]
    out = rows.withColumn("_k", outcome.cast("long")).groupingSets(listed, *[F.col(k) for k in keys])
    return out.agg(F.sum("_k").alias("k"), F.count("*").alias("n"), F.avg("_k").alias("rate"), F.grouping_id(*keys).alias("grouping"))


def offset_histogram(rows: DataFrame, keys: list[str], offset: str, width: int, low: int, high: int) -> DataFrame:
    """Counts and shares of offsets in bins of ``width``, the outermost bins open."""
    b = F.greatest(F.least(F.floor((F.col(offset) + width // 2) / width), F.lit(high)), F.lit(low)).alias("bin")
    n = rows.groupBy(*keys, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def through_origin(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"), F.median(y).alias("median"), F.min(y).alias("low"), F.max(y).alias("high"))


def reason_atlas(reasons: DataFrame, factor: str) -> DataFrame:
    """Cases of each reason and factor level, with an "(any)" row that counts a case once."""
    each = reasons.groupBy(factor, "reason").agg(F.count_distinct("case").alias("cases"))
    anyone = reasons.groupBy(factor).agg(F.count_distinct("case").alias("cases")).withColumn("reason", F.lit("(any)"))
    return each.unionByName(anyone.select(factor, "reason", "cases"))


def realized_depth(reads: DataFrame, haplotypes: DataFrame, spans: Column) -> DataFrame:
    """Spanning reads of every haplotype, none counted as 0."""
    n = reads.where(spans).groupBy("hap").agg(F.count("*").alias("depth"))
    return haplotypes.join(n, "hap", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def bimodal_split(lengths: DataFrame, keys: list[str], *, width: int = 5, reads: int = 10, share: float = 0.2, unit_bp: int = 60) -> DataFrame:
    """Two modes of a binned length histogram that lie a whole number of units apart: the peaks, best first, if the second holds enough.

    A bin is a peak if none of the two bins on each side (absent: empty) is larger, and it is larger than the next.
    """
    b = (F.floor(F.col("length") / width) * width).cast("int")
    n = lengths.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    around = W.partitionBy(*keys).orderBy("bin")
    side = lambda lo, hi: F.coalesce(F.max("n").over(around.rangeBetween(lo, hi)), F.lit(0))
    peaks = n.withColumn("_b", side(-2 * width, -width)).withColumn("_a", side(width, 2 * width)).where((F.col("n") >= F.col("_b")) & (F.col("n") > F.col("_a")))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = peaks.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), "bin"))).where("rank <= 2")
    two = ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("bin"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("bin"))).alias("second"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second_n"))
    out = two.join(total, keys)
    off = F.abs(F.col("first") - F.col("second"))
    near = F.least(F.pmod(off, F.lit(unit_bp)), unit_bp - F.pmod(off, F.lit(unit_bp)))
    ok = F.col("second").isNotNull() & (F.col("second_n") >= reads) & (F.col("second_n") >= share * F.col("total")) & (near <= width) & (off >= unit_bp - width)
    return out.withColumn("split", F.coalesce(ok, F.lit(False)))


def valley_split(series: DataFrame, keys: list[str], *, apart: int = 3) -> DataFrame:
    """The two best strict local minima of mean indel per length, ``apart`` units or more from each other, and the nearer one of each contig."""
    w = W.partitionBy(*keys).orderBy("units")
    inf = F.lit(float("inf"))
    low = series.withColumn("_p", F.coalesce(F.lag("indel").over(w), inf)).withColumn("_n", F.coalesce(F.lead("indel").over(w), inf)).where((F.col("indel") < F.col("_p")) & (F.col("indel") < F.col("_n")))
    low = low.withColumn("score", F.col("indel") / F.col("units"))
    first = low.groupBy(*keys).agg(F.min(F.struct("score", "units")).alias("m")).select(*keys, F.col("m.units").alias("first"))
    second = low.join(first, keys).where(F.abs(F.col("units") - F.col("first")) >= apart).groupBy(*keys, "first").agg(F.min(F.struct("score", "units")).alias("m"))
    pair = second.select(*keys, F.least("first", F.col("m.units")).alias("low"), F.greatest("first", F.col("m.units")).alias("high"))
    out = series.join(pair, keys)
    return out.withColumn("valley", F.when(F.abs(F.col("units") - F.col("low")) <= F.abs(F.col("units") - F.col("high")), F.col("low")).otherwise(F.col("high")))


def touching(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Number of the island of touching intervals (start, end) each site belongs to, from 0. A key's sites are in one task."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    return by_rows(sites, *keys).withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("event", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def count_within(values: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """How many values of the key lie within ``reach`` of each, itself included."""
    return values.withColumn("within", F.count("*").over(W.partitionBy(*keys).orderBy(value).rangeBetween(-reach, reach)))


def mid_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = W.partitionBy(*keys)
    return rows.withColumn("rank", F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2)


def hash_sample(rows: DataFrame, keys: list[str], center: str, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows of each key: those nearest the median, of equals by a seeded hash."""
    med = rows.groupBy(*keys).agg(F.median(center).alias("_m"))
    order = W.partitionBy(*keys).orderBy(F.abs(F.col(center) - F.col("_m")), F.xxhash64(F.lit(seed), *rows.columns))
    return rows.join(med, keys).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r", "_m")


def first_of_repeats(rows: DataFrame, keys: list[str], order: str, proven: str) -> DataFrame:
    """Keeps every proven row, and of unproven rows that repeat a key only the first."""
    r = F.row_number().over(W.partitionBy(*keys, proven).orderBy(order))
    return rows.withColumn("_r", r).where(F.col(proven) | (F.col("_r") == 1)).drop("_r")


def grid_points(spark, values: dict[str, list]) -> DataFrame:
    """Every combination of the listed values, each with a content hash."""
    out = None
    for name in sorted(values):
        one = spark.createDataFrame([(float(v),) for v in values[name]], f"`{name}` double")
        out = one if out is None else out.crossJoin(one)  # a grid is the product of its lists
    return out.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(values))), 256))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key; the others stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place (from 1) of each row in the whole order: rows are sorted in ranges, and a range begins where those before it end."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    within = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_pid").orderBy(*order)))
    # a row for each partition
    sizes = dealt.groupBy("_pid").agg(F.count("*").alias("_n"))
    starts = sizes.select("_pid", (F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    return within.join(F.broadcast(starts), "_pid").withColumn(name, (F.col("_start") + F.col("_at")).cast("int")).drop("_pid", "_at", "_start")


def rank_points(points: DataFrame, terms: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Feasible points first, then by the terms (name, ascending) in turn with nulls last, then by hash."""
    order = [F.col("feasible").desc(), *[F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in terms], F.col(tie)]
    return numbered(points, order, "rank")


def leave_one_out(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The key's total without the row's own value, and the smoothed rate (k + 0.5) / (n + 1)."""
    w = W.partitionBy(*keys)
    others = F.sum(value).over(w) - F.col(value)
    n = F.count("*").over(w) - 1
    return rows.withColumn("others", others).withColumn("rate", (others + 0.5) / (n + 1))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """The value at place (n - 1) * percent div 100 of each key's sorted values; works on counted distinct values."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    place = F.floor((F.sum("_c").over(w) - 1) * percent / 100)
    return n.withColumn("_u", upto).withColumn("_p", place).where(F.col("_u") > F.col("_p")).groupBy(*keys).agg(F.min(value).alias(f"p{percent}_rank"))


#: How far, as a share of the rows, the bounds of a percentile lie from it; approximate ones are right to a tenth of that.
BRACKET = 0.001


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact type-7 percentiles of each key, a column for each of ``shares``; null values don't count, and a key without others has nulls.

    Approximate percentiles bound a stretch around each; the values below and within it are counted, and only the stretch that holds the percentile is sorted.
    The bounds decide how much is sorted, never the result: should it lie outside of them, the stretch below or above is sorted in their place.
    """
    names = list(shares)
    at = [x for n in names for x in (max(shares[n] - BRACKET, 0.0), min(shares[n] + BRACKET, 1.0))]
    bounds = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(value, F.array(*map(F.lit, at)), F.lit(int(10 / BRACKET))).alias("_at"))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    with_bounds = rows.select(*keys, F.col(value).alias("_v")).where("_v is not null").join(small(bounds.select(*own, "_n", "_at")), same)
    low, high = (lambda k: F.col("_at")[2 * k]), (lambda k: F.col("_at")[2 * k + 1])
    counts = [c for k, n in enumerate(names) for c in (F.count_if(F.col("_v") < low(k)).alias(f"_below{k}"), F.count_if(F.col("_v") <= high(k)).alias(f"_upto{k}"))]
    known = with_bounds.groupBy(*keys, "_n", "_at").agg(*counts)

    def place(k: int, name: str) -> Column:
        spot = shares[name] * (F.col("_n") - 1)
        below, upto, first, last = F.col(f"_below{k}"), F.col(f"_upto{k}"), F.floor(spot), F.ceil(spot)
        # null: no bound on that side
        least = F.when(first >= upto, F.struct(high(k).alias("v"), upto.alias("n"), F.lit(True).alias("beyond"))).when(first >= below, F.struct(low(k).alias("v"), below.alias("n"), F.lit(False).alias("beyond")))
        most = F.when(last < below, F.struct(low(k).alias("v"), F.lit(True).alias("beyond"))).when(last < upto, F.struct(high(k).alias("v"), F.lit(False).alias("beyond")))
        return F.struct(F.lit(name).alias("name"), spot.alias("spot"), first.alias("first"), last.alias("last"), least.alias("least"), most.alias("most"))

    placed = small(known.select(*own, F.array(*[place(k, n) for k, n in enumerate(names)]).alias("_all")))
    v = F.col("_v")

    def held(x):
        above = x["least"].isNull() | F.when(x["least"]["beyond"], v > x["least"]["v"]).otherwise(v >= x["least"]["v"])
        under = x["most"].isNull() | F.when(x["most"]["beyond"], v < x["most"]["v"]).otherwise(v <= x["most"]["v"])
        return above & under

    found = rows.select(*keys, F.col(value).alias("_v")).where("_v is not null").join(placed, same).select(*keys, "_v", F.explode(F.filter("_all", held)).alias("x"))
    n = found.groupBy(*keys, "x", "_v").agg(F.count("*").alias("_c"))
    upto = F.coalesce(F.col("x.least.n"), F.lit(0)) + F.sum("_c").over(W.partitionBy(*keys, "x.name").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ends = n.withColumn("_u", upto).groupBy(*keys, F.col("x.name").alias("_name"), F.col("x.spot").alias("_spot"), F.col("x.first").alias("_first"), F.col("x.last").alias("_last")).agg(
        F.min(F.when(F.col("_u") > F.col("x.first"), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_u") > F.col("x.last"), F.col("_v"))).alias("_b")
    )
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("double")).otherwise((F.col("_last") - F.col("_spot")) * F.col("_a") + (F.col("_spot") - F.col("_first")) * F.col("_b"))
    wide = ends.groupBy(*own).agg(*[F.max(F.when(F.col("_name") == s, one)).alias(s) for s in names])
    return rows.select(*keys).distinct().join(wide, same, "left").select(*keys, *names)


def rank_sum(rows, keys, member, value):
    """U of the members against the rest and its z, tie and continuity corrected (low z: members are smaller)."""
    r = mid_ranks(rows, keys, value).withColumn("_t", F.count("*").over(W.partitionBy(*keys, value)))
    x = F.col(member)
    s = r.groupBy(*keys).agg(F.sum(F.when(x, F.col("rank"))).alias("_r"), F.count_if(x).alias("a"), F.count_if(~x).alias("b"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n = F.col("a") + F.col("b")
    u = F.col("_r") - F.col("a") * (F.col("a") + 1) / 2
    sd = F.sqrt(F.col("a") * F.col("b") / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    return s.withColumn("u", u).withColumn("z", F.try_divide(F.col("u") - F.col("a") * F.col("b") / 2 + 0.5, sd))
