"""Flags, bounds, integrity checks and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from . import Registry, table

R = Registry()


@R.add("""select o_orderkey, concat_ws('; ', case when o_orderstatus <> 'O' then 'status ' || o_orderstatus end, case when o_custkey % 3 < 2 then 'fewer than two alleles' end, case when o_custkey % 4 = 3 then 'ambiguous bases' end, case when o_custkey % 5 = 0 then 'unresolved units' end) as flags
 from orders where o_orderstatus <> 'completed'""")
def reconstruction_flags(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "if(o_orderstatus = 'O', 'completed', o_orderstatus) as status", "o_custkey % 3 as alleles", "if(o_custkey % 4 = 3, 1, 0) as ambiguous", "o_custkey % 5 = 0 as unresolved", "cast(null as boolean) as duplicate")
    return o.select("o_orderkey", F.array_join(Q.reconstruction_flags(o), "; ").alias("flags"))


@R.add("select p_partkey, 6 as first, (p_size + 10 - 4)::int as last from part")
def event_bounds(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", Q.event_bounds(F.col("p_size") + 10).alias("x"))
    return p.select("p_partkey", "x.first", "x.last")


@R.add("select l_orderkey, l_linenumber, case when l_discount > 0.08 or d < 10 then 'expected' when d is null then 'depth_unknown' else 'resolvable' end as class from (select *, case when l_partkey % 6 > 0 then l_quantity end as d from lineitem)")
def atlas_class(spark, sf):
    depth = F.when(F.col("l_partkey") % 6 > 0, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", Q.atlas_class(depth, F.col("l_discount") > 0.08, 10).alias("class"))


@R.add("""with m as (select l_suppkey as sample, l_quantity::int as units, count(*) as n from lineitem group by all), t as (select sample, units as top, n as top_n from m qualify row_number() over (partition by sample order by n desc, units) = 1)
select sample, top, top_n::bigint as top_n, round(coalesce(max(n) filter (abs(units - top) >= 5), 0) / top_n::double, 6) as fraction from m join t using (sample) group by sample, top, top_n""")
def secondary_mode(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("int").alias("units")).agg(F.count("*").alias("n"))
    return Q.secondary_mode(m).withColumn("fraction", F.round("fraction", 6))


@R.add("""select l_suppkey as sample, round(avg((l_returnflag = 'A')::int), 6) as "A", round(avg((l_returnflag = 'N')::int), 6) as "N", round(avg((l_returnflag = 'X')::int), 6) as "X" from lineitem group by 1""")
def class_fractions(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("class"))
    out = Q.class_fractions(t, "sample", ["A", "N", "X"])
    return out.select("sample", *[F.round(c, 6).alias(c) for c in "ANX"])


@R.add("select o_custkey as k, count(*)::bigint as n, count(distinct o_orderstatus)::bigint as splits from orders group by 1 having count(*) > 1 or count(distinct o_orderstatus) > 1")
def inventory_integrity(spark, sf):
    return Q.integrity(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("split")), "k", "split")


@R.add("""with c as (select l_suppkey as sample, l_quantity::int as units, count(*) as n from lineitem group by all) select sample, units, n::bigint as n, case when n < 8 then 'below_threshold' else 'unselected' end as why from c where not (units % 10 = 0)""")
def selection_audit(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("int").alias("units")).agg(F.count("*").alias("n"))
    return Q.selection_audit(c, c.where("units % 10 = 0"), 8)


@R.add("""with e as (select l_suppkey as gene, l_partkey * 3 as start, l_partkey * 3 + l_quantity::int as "end" from lineitem union all select s_suppkey, 50, 90 from supplier),
n as (select *, case when start > max("end") over (partition by gene order by start, "end" rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from e)
select gene, min(start)::bigint as start, max("end")::bigint as "end" from (select *, sum(new) over (partition by gene order by start, "end" rows unbounded preceding) as i from n) group by gene, i""")
def merged_exons(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr("l_suppkey as gene", "l_partkey * 3 as start", "l_partkey * 3 + cast(l_quantity as int) as end")
    r = table(spark, sf, "supplier").selectExpr("s_suppkey as gene", "cast(50 as bigint) as start", "cast(90 as bigint) as end")
    return Q.merged_exons(e, r)


@R.add("select l_orderkey as sample, l_linenumber as hap, l_partkey + s_nationkey as start, l_partkey + 60 + s_nationkey as \"end\" from lineitem join supplier on l_suppkey = s_suppkey")
def source_frame(spark, sf):
    t = table(spark, sf, "lineitem")
    s = table(spark, sf, "supplier")
    placed = t.join(s, t.l_suppkey == s.s_suppkey).withColumn("row", F.monotonically_increasing_id())
    frame = placed.selectExpr("l_orderkey as sample", "struct(l_linenumber, l_suppkey, l_partkey, l_extendedprice) as hap", "l_partkey as start", "l_partkey + 60 as end", "s_nationkey as offset")
    out = Q.source_frame(frame.drop("offset").distinct(), frame.select("sample", "hap", "offset").distinct())
    return out.select("sample", F.col("hap.l_linenumber").alias("hap"), "start", "end")


@R.add("select o_orderkey, coalesce(case when o_custkey % 5 = 0 then 'hifi' end, case when o_custkey % 3 = 0 then 'ont' end, 'hifi') as platform from orders")
def platform_setting(spark, sf):
    o = table(spark, sf, "orders")
    c = lambda x: F.expr(x)
    return o.select("o_orderkey", Q.setting(c("case when o_custkey % 5 = 0 then 'hifi' end"), c("case when o_custkey % 3 = 0 then 'ont' end"), F.lit(None).cast("string"), "hifi", ["hifi", "ont"]).alias("platform"))


@R.add("""select coalesce(l_linestatus, 'all') as strand, l_returnflag as kind, sum(l_linenumber)::bigint as errors, sum(l_partkey)::bigint as bases, round(sum(l_linenumber) / sum(l_partkey)::double, 9) as rate from lineitem group by grouping sets ((l_linestatus, l_returnflag), (l_returnflag))""")
def error_rates(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("strand"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("errors"), F.col("l_partkey").alias("bases"))
    return Q.error_rates(t).withColumn("rate", F.round("rate", 9))


@R.add("""select p_partkey, ['short', 'mid', 'long'][(i % 3 + 1)::int] as length, [30, 100][((i // 3) % 2 + 1)::int] as depth from (select p_partkey, row_number() over (order by p_partkey) - 1 as i from part)""")
def balanced_design(spark, sf):
    return Q.balanced_levels(table(spark, sf, "part").select("p_partkey"), "p_partkey", {"length": ["short", "mid", "long"], "depth": [30, 100]})


@R.add("""select l_orderkey as id, (min(l_partkey) - 1)::int as start, max(l_partkey - 1 + length(substr('ACG', 1, (l_linenumber % 3)::int)))::int as "end" from lineitem group by 1""")
def variant_site(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_orderkey as id", "l_partkey as pos", "substr('ACG', 1, cast(l_linenumber % 3 as int)) as ref")
    return Q.variant_site(d)


@R.add("""select l_returnflag as g, round(quantile_cont(l_extendedprice, 0.025), 4) as low, round(quantile_cont(l_extendedprice, 0.975), 4) as high, sort[((n - 1) * 95 // 100)::int + 1] as p95_rank from (select *, count(*) over (partition by l_returnflag) as n, list(l_quantity) over (partition by l_returnflag order by l_quantity rows between unbounded preceding and unbounded following) as sort from lineitem) group by l_returnflag, n, sort""")
def percentiles(spark, sf):
    """Type-7 percentiles and the nearest-rank one."""
    from ..operators.aggregates import nearest_rank
    from ..operators.aggregates import percentiles as exact

    t = table(spark, sf, "lineitem").withColumn("g", F.col("l_returnflag"))
    g = exact(t, ["g"], "l_extendedprice", {"low": 0.025, "high": 0.975}).select("g", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
    return g.join(nearest_rank(t, ["g"], "l_quantity", 95), "g")


@R.add("select o_orderkey, list_sum(d)::bigint as total, list_min(d)::bigint as least from (select o_orderkey, [o_custkey % 7, o_custkey % 11] as d from orders)")
def depth_of_map(spark, sf):
    m = F.create_map(F.lit("h1"), F.col("o_custkey") % 7, F.lit("h2"), F.col("o_custkey") % 11)
    v = F.map_values(m)
    return table(spark, sf, "orders").select("o_orderkey", F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(v).alias("least"))
