"""Aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import lengths as L
from . import Registry, dna, dna_sql, table

R = Registry()
LINE = "(select l_suppkey as key, l_linenumber as pos, substr('ACGT-', (l_partkey % 5 + 1)::int, 1) as base, l_orderkey as ord, case when l_partkey % 3 = 0 then '' else substr('ACG', (l_orderkey % 3 + 1)::int, 1) end as inserted from lineitem)"


def _line(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as key", "l_linenumber as pos", "substr('ACGT-', cast(l_partkey % 5 + 1 as int), 1) as base", "l_orderkey as ord",
        "case when l_partkey % 3 = 0 then '' else substr('ACG', cast(l_orderkey % 3 + 1 as int), 1) end as inserted",
    )


@R.add(f"select key, pos, base, count(*)::bigint as n from {LINE} group by all")
def site_counts(spark, sf):
    return _line(spark, sf).groupBy("key", "pos", "base").agg(F.count("*").alias("n"))


MODAL = f"(select key, pos, base, n from (select key, pos, base, count(*) as n, row_number() over (partition by key, pos order by count(*) desc, min(ord), base desc) as r from {LINE} group by key, pos, base) where r = 1)"


@R.add(f"select key, pos, base, n::bigint as n from {MODAL}")
def modal_length(spark, sf):
    return A.modal(_line(spark, sf), ["key", "pos"], "base", "ord")


@R.add(f"""with i as (select key, pos, inserted, count(*) as n, row_number() over (partition by key, pos order by count(*) desc, min(ord), inserted desc) as r from {LINE} where inserted <> '' group by key, pos, inserted),
a as (select key, pos, count(*) as t from {LINE} group by key, pos)
select m.key, string_agg(coalesce(case when i.n > 0.5 * a.t then i.inserted end, '') || case when base = '-' then '' else base end, '' order by m.pos) as consensus
 from {MODAL} m join a using (key, pos) left join i on i.key = m.key and i.pos = m.pos and i.r = 1 group by m.key""")
def plurality_consensus(spark, sf):
    t = _line(spark, sf)
    return A.spell(A.plurality(t.select("key", "pos", "base", "ord"), t.select("key", "pos", "inserted", "ord")))


@R.add("select l_suppkey as key, l_linenumber as run, greatest(1, floor(median(l_quantity) + 0.5))::int as length, count(*)::bigint as n from lineitem group by all")
def run_vote(spark, sf):
    return A.run_vote(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("run"), "l_quantity"), ["key", "run"], "l_quantity")


@R.add(f"""select m.key, round(avg(coalesce((select count(*) from {LINE} x where x.key = m.key and x.pos = m.pos and x.base = m.base)::double / nullif((select count(*) from {LINE} x where x.key = m.key and x.pos = m.pos), 0), 0)), 6) as concordance from {MODAL} m group by m.key""")
def concordance(spark, sf):
    t = _line(spark, sf)
    out = A.concordance(t.select("key", "pos", "base"), A.modal(t, ["key", "pos"], "base", "ord").select("key", "pos", "base"))
    return out.withColumn("concordance", F.round("concordance", 6))


@R.add(f"""with c as (select key, pos, base, count(*) as n, min(ord) as f, sum(count(*)) over (partition by key, pos) as t from {LINE} group by key, pos, base)
select c.key, c.pos, c.base, c.n::bigint as n, round(c.n / c.t::double, 6) as af from c join {MODAL} m on c.key = m.key and c.pos = m.pos and c.base <> m.base where c.n >= 0.2 * t
 qualify row_number() over (partition by c.key, c.pos order by c.n desc, f, c.base desc) = 1""")
def residual_sites(spark, sf):
    t = _line(spark, sf)
    return A.residual_sites(t, A.modal(t, ["key", "pos"], "base", "ord").select("key", "pos", "base"), 0.2).withColumn("af", F.round("af", 6))


@R.add("select l_suppkey as key, l_returnflag as strand, least(l_quantity::int, 16) as length, count(*)::bigint as n from lineitem where l_linenumber <> 3 group by all")
def run_histogram(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("strand"), F.col("l_quantity").cast("int").alias("length"), "l_linenumber")
    return A.run_histogram(t, F.col("l_linenumber") == 3)


@R.add("""with c as (select l_suppkey as sample, (l_partkey % 97)::bigint as units, count(*) as n from lineitem group by all), k as (select *, case when units - lag(units) over (partition by sample order by units) >= 3 then 1 else 0 end as new from c where n >= 2),
g as (select *, sum(new) over (partition by sample order by units) as i from k)
select sample, min(units) as low, max(units) as high, sum(n)::bigint as total, round_even(sum(units * n) / sum(n)::double, 0)::bigint as center from g group by sample, i""")
def gap_clusters(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 97).alias("units")).agg(F.count("*").alias("n"))
    return A.gap_clusters(c, ["sample"], "units", "n", least=2, gap=3)


@R.add("""with s as (select l_suppkey as sample, l_linenumber as contig, avg(l_quantity) as m, avg(l_discount) as i, count_if((((l_orderkey % 3) * 2048 + (l_partkey % 2) * 4)::int & 2308) = 0) as p, count(*) as n from lineitem group by all)
select sample, contig, round(m, 6) as mean_score, round(i, 9) as mean_indel, p::bigint as primary, n as records, row_number() over (partition by sample order by m desc, contig) = 1 as best from s""")
def refine_contig(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("contig"), F.col("l_quantity").alias("score"), F.col("l_discount").alias("indel"), ((F.col("l_orderkey") % 3) * 2048 + (F.col("l_partkey") % 2) * 4).cast("int").alias("flag"))
    return A.best_contig(t, ["sample"]).withColumn("mean_score", F.round("mean_score", 6)).withColumn("mean_indel", F.round("mean_indel", 9))


@R.add("""with s as (select l_suppkey as sample, case when l_partkey % 4 > 0 then l_partkey % 200 end as s1, case when l_orderkey % 5 > 0 then l_orderkey % 200 end as s2, l_suppkey % 10 as d, l_suppkey % 2 as p from lineitem),
v as (select *, case when s2 is null then d >= 6 and s1 is not null else coalesce(s1 - s2 > 43, false) end as one, case when s1 is null then d >= 6 and s2 is not null else coalesce(s2 - s1 > 43, false) end as two from s),
n as (select sample, count_if(one) as d1, count_if(two) as d2, count_if(not one and not two) as a, min(p) as p from v group by sample)
select sample, d1::bigint as d1, d2::bigint as d2, a::bigint as ambiguous, d2 >= 3 + case when p = 0 then 2 else 0 end and coalesce(d2 / nullif(d1 + d2, 0)::double >= 0.01, false) as valid from n""")
def dominance(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_suppkey as sample", "l_orderkey as read", "case when l_partkey % 4 > 0 then l_partkey % 200 end as s1", "case when l_orderkey % 5 > 0 then l_orderkey % 200 end as s2", "l_suppkey % 10 as distance", "l_suppkey % 2 as primary2")
    return A.dominance(t, delta=43, least=3)


@R.add("""select o_orderpriority as profile, coalesce(case o_orderstatus when 'O' then 'pathogenic' when 'F' then 'normal' end, 'unknown') as truth, count_if(o_custkey % 3 = 0)::bigint as "POSITIVE", count_if(o_custkey % 3 = 1)::bigint as "INCONCLUSIVE", count_if(o_custkey % 3 = 2)::bigint as "NEGATIVE" from orders group by 1, 2""")
def confusion(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderpriority as profile", "case o_orderstatus when 'O' then 'pathogenic' when 'F' then 'normal' end as truth", "element_at(array('POSITIVE', 'INCONCLUSIVE', 'NEGATIVE'), cast(o_custkey % 3 + 1 as int)) as decision")
    return A.confusion(o, ["profile"], ["POSITIVE", "INCONCLUSIVE", "NEGATIVE"])


@R.add("""select l_linestatus as profile, sum((l_returnflag = 'R')::int)::bigint as recall_k, sum((l_linenumber > 5)::int)::bigint as recall_n, round(sum((l_returnflag = 'R')::int) / nullif(sum((l_linenumber > 5)::int), 0)::double, 6) as recall from lineitem group by 1""")
def event_recall(spark, sf):
    t = table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "profile")
    return A.ratios(t, ["profile"], {"recall": ((F.col("l_returnflag") == "R").cast("long"), (F.col("l_linenumber") > 5).cast("long"))}).withColumn("recall", F.round("recall", 6))


@R.add("""select l_linestatus, l_returnflag, l_linenumber, sum((l_quantity > 25)::int)::bigint as k, count(*)::bigint as n, round(avg((l_quantity > 25)::int), 6) as rate, grouping_id(l_linestatus, l_returnflag, l_linenumber)::bigint as grouping
 from lineitem group by grouping sets ((), (l_linestatus), (l_linestatus, l_returnflag), (l_linestatus, l_linenumber))""")
def grouping_sets_rates(spark, sf):
    t = table(spark, sf, "lineitem")
    out = A.grouping_rates(t, [[], ["l_linestatus"], ["l_linestatus", "l_returnflag"], ["l_linestatus", "l_linenumber"]], F.col("l_quantity") > 25)
    return out.withColumn("rate", F.round("rate", 6))


@R.add("""with b as (select event_type, greatest(least(floor((trunc(value) - 50 + 30) / 60.0), 3), -2)::bigint as bin, count(*) as n from events group by 1, 2) select event_type, bin, n::bigint as n, round(n / sum(n) over (partition by event_type), 6) as share from b""")
def offset_histogram(spark, sf):
    t = table(spark, sf, "events").select("event_type", (F.col("value").cast("int") - 50).alias("d"))
    return A.offset_histogram(t, ["event_type"], "d", 60, -2, 3).withColumn("share", F.round("share", 6))


@R.add("select l_returnflag, round(sum(l_quantity * l_tax) / sum(l_quantity * l_quantity), 8) as slope, round(median(l_tax), 6) as median, min(l_tax) as low, max(l_tax) as high from lineitem group by 1")
def origin_slope(spark, sf):
    return A.through_origin(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax").withColumn("slope", F.round("slope", 8)).withColumn("median", F.round("median", 6))


@R.add("""with r as (select l_orderkey as c, l_linestatus as f, 'reason' || l_linenumber as reason from lineitem) select f as factor, reason, count(distinct c)::bigint as cases from r group by all union all select f, '(any)', count(distinct c)::bigint from r group by all""")
def reason_atlas(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("factor"), F.concat(F.lit("reason"), "l_linenumber").alias("reason"))
    return A.reason_atlas(t, "factor")


@R.add("""select s_suppkey as hap, coalesce(n, 0)::bigint as depth from supplier left join (select l_suppkey, count(*) as n from lineitem where l_quantity > 49 group by 1) on l_suppkey = s_suppkey""")
def realized_depth(spark, sf):
    haps = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("hap"))
    return A.realized_depth(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "hap"), haps, F.col("l_quantity") > 49)


SPLIT = "(select l_suppkey as key, (l_partkey % 40 * 3 + case when l_orderkey % 2 = 0 then 0 else 60 end)::int as length from lineitem)"


@R.add(f"""with n as (select key, (floor(length / 5.0) * 5)::int as bin, count(*) as n from {SPLIT} group by all),
p as (select a.*, coalesce((select max(n) from n b where b.key = a.key and b.bin between a.bin - 10 and a.bin - 5), 0) as l, coalesce((select max(n) from n b where b.key = a.key and b.bin between a.bin + 5 and a.bin + 10), 0) as r from n a),
q as (select *, row_number() over (partition by key order by n desc, bin) as k from p where n >= l and n > r),
t as (select key, sum(n) as total from n group by key), w as (select key, max(bin) filter (k = 1) as first, max(bin) filter (k = 2) as second, max(n) filter (k = 2) as second_n from q where k <= 2 group by key)
select w.key, first, second, second_n::bigint as second_n, total::bigint as total, coalesce(second_n >= 10 and second_n >= 0.02 * total and least(abs(first - second) % 60, 60 - abs(first - second) % 60) <= 5 and abs(first - second) >= 55, false) as split from w join t using (key)""")
def bimodal_split(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_suppkey as key", "cast(l_partkey % 40 * 3 + case when l_orderkey % 2 = 0 then 0 else 60 end as int) as length")
    return A.bimodal_split(t, ["key"], share=0.02)


@R.add("""with s as (select l_suppkey as sample, l_quantity::int as units, avg(l_discount) as indel from lineitem group by all), m as (select *, indel / units as score from s window w as (partition by sample order by units) qualify indel < coalesce(lag(indel) over w, 'inf'::double) and indel < coalesce(lead(indel) over w, 'inf'::double)),
f as (select sample, units as f from m qualify row_number() over (partition by sample order by score, units) = 1), g as (select m.sample, f, units as g from m join f using (sample) where abs(units - f) >= 3 qualify row_number() over (partition by m.sample order by score, units) = 1)
select s.sample, s.units, least(f, g) as low, greatest(f, g) as high, case when abs(units - least(f, g)) <= abs(units - greatest(f, g)) then least(f, g) else greatest(f, g) end as valley from s join g using (sample)""")
def valley_split(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("int").alias("units")).agg(F.avg("l_discount").alias("indel"))
    return A.valley_split(s, ["sample"]).drop("indel")


@R.add("""with s as (select l_suppkey as sample, l_orderkey as site, l_linenumber as i, (l_partkey * 7)::bigint as start, (l_partkey * 7 + l_quantity::int)::bigint as "end" from lineitem),
n as (select *, case when start > max("end") over (partition by sample order by start, "end", site rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from s)
select sample, event::bigint as event, min(start) as low, max("end") as high, count(*)::bigint as n from (select *, sum(new) over (partition by sample order by start, "end", site rows unbounded preceding) as event from n) group by sample, event""")
def touching_events(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("l_suppkey as sample", "l_partkey * 7 as start", "l_partkey * 7 + cast(l_quantity as int) as end")
    return A.touching(s, ["sample"]).groupBy("sample", "event").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.count("*").alias("n"))


@R.add("select l_orderkey, l_linenumber, l_suppkey, l_quantity, count(*) over (partition by l_suppkey order by l_quantity range between 2 preceding and 2 following)::bigint as within from lineitem")
def count_within(spark, sf):
    return A.count_within(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 2)


@R.add("select l_orderkey, l_linenumber, l_suppkey, l_quantity, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as rank from lineitem")
def mid_ranks(spark, sf):
    return A.mid_ranks(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


@R.add()
def hash_sample(spark, sf):
    """A seeded sample of each supplier's lines nearest the median quantity (the limit is the operator's)."""
    return A.hash_sample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 40)


@R.add("select p_brand, p_type, p_partkey, p_size > 25 as proven from part qualify proven or row_number() over (partition by p_brand, p_type, p_size > 25 order by p_partkey) = 1")
def first_of_repeats(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", (F.col("p_size") > 25).alias("proven"))
    return A.first_of_repeats(p, ["p_brand", "p_type"], "p_partkey", "proven")


@R.add("select af, depth, tax from (select distinct l_discount as af from lineitem), (select distinct l_linenumber::double as depth from lineitem), (select distinct l_tax as tax from lineitem)")
def grid_product(spark, sf):
    """Every combination of the values that the lines have of three settings."""
    t = table(spark, sf, "lineitem")
    # the values of a setting are a handful
    values = lambda c: sorted(r[0] for r in t.select(c).distinct().collect())
    return A.grid_points(spark, {"depth": values("l_linenumber"), "af": values("l_discount"), "tax": values("l_tax")}).select("af", "depth", "tax")


@R.add("select c_custkey, c_acctbal from customer where c_custkey % 4 > 0 union all select c_custkey, c_acctbal + 1 from customer where c_custkey % 4 = 0")
def manifest_upsert(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return A.upsert(c, c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@R.add("""select p_partkey, row_number() over (order by p_size < 40 desc, case when p_partkey % 7 > 0 then p_retailprice end desc nulls last, p_size asc nulls last, p_partkey)::int as rank from part""")
def rank_points(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_size") < 40).alias("feasible"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("m"))
    return A.rank_points(p, [("m", False), ("p_size", True)], "p_partkey").select("p_partkey", "rank")


@R.add("select l_orderkey, l_linenumber, l_partkey, sum(l_quantity) over w - l_quantity as others, round((sum(l_quantity) over w - l_quantity + 0.5) / count(*) over w, 6) as rate from lineitem window w as (partition by l_suppkey)")
def loo_background(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return A.leave_one_out(t, ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "others", F.round("rate", 6).alias("rate"))


SPANS = "(select l_suppkey as sample, (l_quantity * 60)::bigint as length from lineitem)"
DENSITY = f"""ends as (select sample, min(length) - 100 as lo, max(length) + 100 as hi from {SPANS} group by sample),
c as (select sample, length, count(*) as n, 8 + 0.004 * length as bw from {SPANS} group by all),
dens as (select c.sample, lo + 2 * i as x, i, sum(n * exp(-0.5 * pow((lo + 2 * i - length) / bw, 2))) as d from c join ends using (sample), lateral (select unnest(range(greatest(ceil((length - 4 * bw - lo) / 2), 0)::bigint, least(floor((length + 4 * bw - lo) / 2), floor((hi - lo) / 2))::bigint + 1)) as i) group by all)"""


def _spans(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_quantity") * 60).cast("long").alias("length"))


@R.add(f"with {DENSITY} select sample, x, round(d, 6) as d from dens")
def kde_density(spark, sf):
    return L.density(_spans(spark, sf)).select("sample", "x", F.round("d", 6).alias("d"))


PEAKS = f"""with recursive {DENSITY}, top as (select a.sample, a.x, round(a.d, 9) as d from dens a left join dens l on l.sample = a.sample and l.i = a.i - 1 left join dens r on r.sample = a.sample and r.i = a.i + 1 where a.d >= coalesce(l.d, 0) and a.d > coalesce(r.d, 0)),
o as (select *, row_number() over (partition by sample order by d desc, x) as k from top),
nms(sample, k, kept) as (select sample, k, [x] from o where k = 1 union all select o.sample, o.k, case when len(list_filter(kept, lambda q: abs(q - o.x) < 42)) > 0 then kept else list_append(kept, o.x) end from nms join o on o.sample = nms.sample and o.k = nms.k + 1),
f as (select sample, kept from nms qualify row_number() over (partition by sample order by k desc) = 1),
p as (select sample, (i - 1)::int as ord, kept[i] as center, (select count(*) from {SPANS} s where s.sample = f.sample and abs(s.length - kept[i]) <= 30 + 0.6 * kept[i] / 60)::bigint as support from f, lateral (select unnest(range(1, len(kept) + 1)) as i))"""


@R.add(PEAKS + " select sample, ord, center, support from p")
def kde_peaks(spark, sf):
    spans = _spans(spark, sf)
    return L.supported(spans, L.maxima(spans)).select("sample", "ord", "center", "support")


@R.add(PEAKS + f""", n as (select sample, count(*) as total from {SPANS} group by sample), t as (select sample, center as top from p qualify row_number() over (partition by sample order by support desc, ord) = 1),
w as (select *, case when center = top then null when support <= 2 then 'noise' when support < greatest(8, case when abs(center - top) < 120 then 0.2 else 0.03 end * total) then 'support_below_threshold' end as why from p join n using (sample) join t using (sample)),
r as (select *, row_number() over (partition by sample, why is null order by center <> top, support desc, ord) as k from w)
select sample, center, support, total::bigint as total, case when why is null and k > 2 then 'max_alleles' else why end as reason from r""")
def length_candidates(spark, sf):
    """The length model without its smear test."""
    return L.length_model(_spans(spark, sf), smear=False)


@R.add()
def length_model(spark, sf):
    """All candidates with the reason of those that were rejected (smear test included)."""
    return L.length_model(_spans(spark, sf))
