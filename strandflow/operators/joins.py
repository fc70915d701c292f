"""Joins of the domain: dictionary lookups, nearest neighbours, intervals, optimal assignments.

Range conditions become equi-joins on bins of the range's width, so no side is ever crossed with the
other; only dictionaries and other tables of a checked size are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequence import apply_change

#: Rows and letters up to which a lookup table may be broadcast; larger ones are joined by shuffle.
SMALL, SMALL_BYTES = 50_000, 16 << 20
#: Rows that a task sorts or gathers, where tasks follow the rows.
TASK_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint, if it is small: few rows, and few letters in its texts."""
    texts = [F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = sum(texts, F.lit(0)).cast("long")
    n, letters = df.limit(SMALL + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL and letters <= SMALL_BYTES else df


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt, by keys if there are any, to as many tasks as the session shuffles to.

    For stages whose work is much more than their bytes suggest: adaptive execution would put them together in a few tasks.
    The number isn't that of other shuffles, since Spark leaves out a repartition like the shuffle before it, and would put that one's tasks together.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def by_rows(df: DataFrame, *keys: str | Column) -> DataFrame:
    """As ``spread``, but with a task for every TASK_ROWS rows at least, so that a task's memory doesn't follow the table. Rows are counted first; a key's rows stay together."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(n, *keys)


def each_once(df: DataFrame, inputs: list[str], outputs: dict[str, Column]) -> DataFrame:
    """``df`` with ``outputs``, worked out once for each distinct tuple of ``inputs`` and by all tasks.

    For costly functions of a few columns, be it that values recur or that the rows come in few files. Null is a value of its own.
    """
    named = {c: f"_in_{i}" for i, c in enumerate(inputs)}
    met = spread(df.select(*inputs).distinct(), *inputs).select(*[F.col(c).alias(n) for c, n in named.items()], *[c.alias(n) for n, c in outputs.items()])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    return df.join(met, same, "left").drop(*named.values())


def unit_lookup(pieces: DataFrame, units: DataFrame, templates: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds unit_id, template and match (exact, template or none) by equality; units(id, seq), templates(name, parent, seq)."""
    u = small(units.select(F.col("id").alias("_unit"), F.col("seq").alias("_u")))
    t = small(templates.select(F.col("name").alias("_name"), F.col("parent").alias("_parent"), F.col("seq").alias("_t")))
    out = pieces.join(u, F.col(seq) == F.col("_u"), "left").join(t, F.col(seq) == F.col("_t"), "left")
    kind = F.when(F.col("_unit").isNotNull(), "exact").when(F.col("_name").isNotNull(), "template").otherwise("none")
    return out.select(pieces["*"], F.coalesce("_unit", "_parent").alias("unit_id"), F.when(kind == "template", F.col("_name")).alias("template"), kind.alias("match"))


def nearest_unit(pieces: DataFrame, units: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds the unit of least edit distance (of equals the first in the dictionary) and that distance.

    Distances are worked out once for each distinct piece. Equal pieces are found by a hash join first; only the others are
    compared, with the dictionary as one array, each unit only within the best distance so far.
    """
    words = units.agg(F.sort_array(F.collect_list(F.struct("ord", "id", "seq"))).alias("_words"))
    exact = small(units.groupBy(F.col("seq").alias("_seq")).agg(F.min_by("id", "ord").alias("_id")))
    distinct = pieces.select(F.col(seq).alias("_piece")).distinct()
    known = distinct.join(exact, F.col("_piece") == F.col("_seq"), "left")
    best = F.aggregate(
        "_words",
        F.lit(None).cast("struct<d:int,id:string>"),
        lambda acc, w: F.when(acc.isNull(), F.struct(F.levenshtein(F.col("_piece"), w["seq"]).alias("d"), w["id"].alias("id")))
        .when(acc["d"] <= F.abs(F.length("_piece") - F.length(w["seq"])), acc)
        .otherwise(_nearer(acc, w)),
    )
    others = known.where("_id is null").crossJoin(F.broadcast(words)).select("_piece", best.alias("_best"))  # one row of the dictionary's size
    done = known.where("_id is not null").select("_piece", F.struct(F.lit(0).alias("d"), F.col("_id").alias("id")).alias("_best")).unionByName(others)
    out = pieces.join(done, pieces[seq].eqNullSafe(F.col("_piece")), "left")
    return out.select(pieces["*"], F.col("_best.id").alias("unit_id"), F.col("_best.d").alias("distance"))


def _nearer(acc, w):
    d = F.levenshtein(F.col("_piece"), w["seq"])
    return F.when(d < acc["d"], F.struct(d.alias("d"), w["id"].alias("id"))).otherwise(acc)


def nearest_peak(spans: DataFrame, peaks: DataFrame, key: str = "sample", short_bp: int = 90) -> DataFrame:
    """Adds peak (center) and class: assigned within the nearest peak's half-width, else short_product or unassigned.

    peaks(key, center, half): a handful for each key. Of two peaks as near, the smaller center.
    """
    listed = peaks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("center", "half"))).alias("_peaks"))
    near = F.array_min(F.transform("_peaks", lambda p: F.struct(F.abs(F.col("length") - p["center"]).alias("d"), p["center"].alias("center"), p["half"].alias("half"))))
    low = F.array_min(F.transform("_peaks", lambda p: p["center"]))
    out = spans.join(listed, key, "left").withColumn("_near", near).withColumn("_low", low)
    fits = F.col("_near.d") <= F.col("_near.half")
    kind = F.when(fits, "assigned").when(F.col("_low") - F.col("length") > short_bp, "short_product").otherwise("unassigned")
    return out.select(spans["*"], F.when(fits, F.col("_near.center")).alias("peak"), kind.alias("class"))


def argmin_assign(reads: DataFrame, refs: DataFrame, distance, *, margin: int = 3, error_rate: float = 0.15) -> DataFrame:
    """Each read's nearest reference, if it leads the second by ``margin`` and errs in at most ``error_rate`` of the read.

    reads(key, read, seq), refs(key, name, ord, seq); ``distance`` maps two Columns to a number.
    """
    listed = refs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ord", "name", F.col("seq").alias("ref")))).alias("_refs"))
    ranked = F.sort_array(F.transform("_refs", lambda r: F.struct(distance(F.col("seq"), r["ref"]).alias("d"), r["ord"].alias("ord"), r["name"].alias("name"))))
    out = reads.join(listed, "key").withColumn("_r", ranked)
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    off = first["d"] > error_rate * F.length("seq")
    close = second.isNotNull() & (second["d"] - first["d"] < margin)
    return out.select(*[reads[c] for c in reads.columns], first["d"].alias("distance"), F.when(off, "off_target").when(close, "undecided").otherwise(first["name"]).alias("assigned"))


def within(left: DataFrame, right: DataFrame, keys: list[str], point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner range join: rows of both with equal keys and ``low <= point <= high``; intervals are cut into bins of ``width``."""
    lo, hi = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    binned = right.withColumn("_bin", F.explode(F.sequence(lo, hi)))
    points = left.withColumn("_bin", F.floor(F.col(point) / width))
    return points.join(binned, [*keys, "_bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bin")


def dimer_pairs(parts: DataFrame, peaks: DataFrame, share: float = 0.05) -> DataFrame:
    """Pairs of parent peaks whose joined products are few: parts(sample, read, left_bp, right_bp), peaks(sample, peak, low, high, support)."""
    side = lambda p, n: peaks.select("sample", F.col("peak").alias(f"{n}_peak"), F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high"), F.col("support").alias(f"{n}_support"))
    both = within(within(parts, side(peaks, "l"), ["sample"], "left_bp", "l_low", "l_high", 240), side(peaks, "r"), ["sample"], "right_bp", "r_low", "r_high", 240)
    pair = both.select("sample", "read", F.least("l_peak", "r_peak").alias("i"), F.greatest("l_peak", "r_peak").alias("j"), F.least("l_support", "r_support").alias("parent"))
    sums = pair.groupBy("sample", "i", "j").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    return sums.withColumn("accepted", F.col("n") <= share * F.col("parent"))


def optimal_match(truth: DataFrame, predicted: DataFrame, key: str, cost) -> DataFrame:
    """All assignments of most pairs and least total cost, for at most two on each side.

    truth(key, t, t_value), predicted(key, p, p_value) with t, p in 1, 2. One row per pair of each best alternative.
    """
    t = truth.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", "t_value"))).alias("_t"))
    p = predicted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("p", "p_value"))).alias("_p"))
    both = t.join(p, key)
    plans = F.array(*[F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("p")) for a, b in plan]) for plan in (((1, 1), (2, 2)), ((1, 2), (2, 1)))])
    real = lambda plan: F.filter(plan, lambda x: F.col("_t")[x["t"]].isNotNull() & F.col("_p")[x["p"]].isNotNull())
    costed = F.transform(plans, lambda plan: F.struct(real(plan).alias("pairs"), F.aggregate(real(plan), F.lit(0).cast("long"), lambda s, x: s + cost(F.col("_t")[x["t"]], F.col("_p")[x["p"]])).alias("cost")))
    opened = both.select(key, F.posexplode(costed).alias("alternative", "plan"))
    size = F.size("plan.pairs")
    best = opened.withColumn("_rank", F.dense_rank().over(W.partitionBy(key).orderBy(size.desc(), F.col("plan.cost")))).where("_rank = 1")
    return best.select(key, "alternative", F.col("plan.cost").alias("cost"), F.explode("plan.pairs").alias("x")).select(key, "alternative", "cost", "x.t", "x.p")


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full key equality: a key on one side only is an error, not a lost row."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full")
    ok = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("unpaired unit: "), F.concat_ws("/", *keys))).cast("boolean")).otherwise(F.lit(True))
    return both.where(ok).drop("_l", "_r")


def required(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with their right row; a missing right row is an error."""
    both = left.join(right.withColumn("_r", F.lit(1)), keys, "left")
    ok = F.when(F.col("_r").isNull(), F.raise_error(F.concat(F.lit("no case for: "), F.concat_ws("/", *keys))).cast("boolean")).otherwise(F.lit(True))
    return both.where(ok).drop("_r")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def multiset_counts(expected: DataFrame, actual: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """True positives, missed and extra items of two multisets, per group."""
    keys = [*group, *item]
    e = expected.groupBy(*keys).agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("a"))
    both = e.join(a, keys, "full").fillna(0, ["e", "a"])
    return both.groupBy(*group).agg(
        F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp")
    )


def concordance(mutations: DataFrame, edits: DataFrame) -> DataFrame:
    """Which single edit supports which mutation: applied to the parent unit it must give the mutated one.

    mutations(id, index, parent_seq, seq), edits(id, edit, kind, start, end, bases). An edit that supports several units is ambiguous.
    """
    made = mutations.join(edits, "id").where(apply_change("parent_seq", "kind", "start", "end", "bases") == F.col("seq"))
    n = F.count("*").over(W.partitionBy("id", "edit"))
    supported = made.withColumn("_n", n).groupBy("id", "index").agg(F.min("_n").alias("_n"))
    status = F.when(F.col("_n").isNull(), "unsupported").when(F.col("_n") > 1, "ambiguous").otherwise("supported")
    return mutations.join(supported, ["id", "index"], "left").withColumn("status", status).drop("_n")


def shift_by_changes(units: DataFrame, mutations: DataFrame) -> DataFrame:
    """Display coordinates of units when mutated ones are shown at their parents' length: units(id, index, bp), mutations(id, index, net)."""
    joined = units.join(mutations, ["id", "index"], "left").fillna(0, ["net"])
    w = W.partitionBy("id").orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    shown = F.col("bp") - F.col("net")
    return joined.withColumn("start", F.coalesce(F.sum(shown).over(w), F.lit(0))).withColumn("end", F.col("start") + shown)


def delta(points: DataFrame, reference: DataFrame, key: str, metric: str) -> DataFrame:
    """Each point's metric against the reference's of the same key; null where it has none."""
    r = reference.select(key, F.col(metric).alias("_r"))
    return points.join(r, key, "left").withColumn("delta", F.col(metric) - F.col("_r")).drop("_r")


def candidates_of_span(evidence: DataFrame, spans: DataFrame, reach: int, width: int) -> DataFrame:
    """All candidates whose interval, widened by ``reach``, holds the length; none is preferred. evidence(id, length), spans(name, low, high)."""
    wide = spans.select("name", (F.col("low") - reach).alias("_low"), (F.col("high") + reach).alias("_high"))
    hit = within(evidence, wide, [], "length", "_low", "_high", width).groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("candidates"))
    return evidence.join(hit, "id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def pick(order: Column, keys: list[str]) -> Column:
    """1 for the first row of each key."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(order))
