"""Statuses, located reasons, confidences and pending work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as X
from . import Registry, table
from .sequence import PLACE, _places

R = Registry()
SPLITS = {"unconfirmed_single_site": "unresolved_single_site", "unconfirmed_group_size": "unresolved_group_size"}


@R.add("""select o_orderkey, case when o_custkey % 4 > 2 or o_custkey % 5 = 0 then 'unresolved_max_alleles' when o_orderkey % 3 = 1 then 'unresolved_single_site' when o_orderkey % 3 = 2 then 'unresolved_group_size' when o_custkey % 5 = 1 then 'unresolved_rejected_peak' when o_custkey % 7 > 5 then 'unresolved_unassigned_spanning' else 'resolved' end as status from orders""")
def selection_status(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "array(element_at(array('max_alleles', 'support_below_threshold', 'noise', 'smear', 'noise'), cast(o_custkey % 5 + 1 as int))) as rejected", "array(element_at(array('none', 'unconfirmed_single_site', 'unconfirmed_group_size'), cast(o_orderkey % 3 + 1 as int))) as bases", "o_custkey % 4 as n", "(o_custkey % 7) / 25 as u")
    return o.select("o_orderkey", X.selection_status(F.col("rejected"), F.col("bases"), F.col("n"), F.col("u"), SPLITS).alias("status"))


@R.add("select l_orderkey, l_linenumber, 'unresolved heterozygous site at repeat ' || (l_partkey // 60 + 1) || ' (col ' || l_returnflag || '>' || l_linestatus || ', AF ' || l_discount || ')' as reason from lineitem")
def located_site(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", X.located_site(F.lit("col"), F.col("l_partkey"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_discount")).alias("reason"))


@R.add("""with u as (select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as index, l_quantity from lineitem), n as (select *, count(*) over (partition by id) as n from u),
c as (select *, case when index % 2 = 0 then case when id % 3 = 0 then 'absent' else 'supported' end end as status from n)
select id, index::int as index, round(case when status is null then 0.9 else 0.9 * case when status = 'absent' then 0.3 when id % 20 < 5 then 0.3 when id % 20 < 20 then 0.5 + 0.5 * (id % 20 - 5) / 15 else 1 end * case when n > 6 and index > n - 3 then 0.5 else 1 end end, 3) as confidence from c""")
def event_confidence(spark, sf):
    from pyspark.sql.window import Window as W

    t = table(spark, sf, "lineitem")
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    u = t.select(F.col("l_orderkey").alias("id"), i.alias("index"), F.lit(0.9).alias("confidence"))
    c = u.where("index % 2 = 0").selectExpr("id", "index", "if(id % 3 = 0, 'absent', 'supported') as status", "cast(id % 20 as double) as qual")
    return X.event_confidence(u, c).select("id", "index", F.round("confidence", 3).alias("confidence"))


@R.add("select p_partkey from part where p_partkey not in (select ps from (select l_partkey as ps from lineitem where l_linenumber = 1))")
def pending_points(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return X.pending(table(spark, sf, "part").select("p_partkey"), done, "p_partkey")


@R.add(f"""select distinct b as base, bw + aw as parent_length, bw + aw + 1 as event_length from (
 select b, length(left(unit, s - 1)) - length(rtrim(left(unit, s - 1), b)) as bw, length(substr(unit, s)) - length(ltrim(substr(unit, s), b)) as aw
 from (select *, substr('ACGT', (id // 7 % 4 + 1)::int, 1) as b from {PLACE})) where bw + aw >= 2""")
def run_signatures(spark, sf):
    """What single bases inserted into units, one for each part, look like in runs."""
    made = _places(spark, sf).withColumn("base", F.expr("substr('ACGT', cast(id div 7 % 4 + 1 as int), 1)"))
    templates = made.select(F.col("id").cast("string").alias("parent"), F.expr("substr(seq, 1, s - 1) || base || substr(seq, s)").alias("seq"))
    out = X.run_signatures(templates, made.select(F.col("id").cast("string").alias("id"), "seq"))
    return out.select("base", F.col("parent_length").cast("bigint").alias("parent_length"), F.col("event_length").cast("bigint").alias("event_length"))
