"""Decisions, evaluation, adoption, calibration, cohorts and the ladder's relational parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import joins
from ..operators import ladder as L
from ..operators import reads as reads_op
from ..operators import segment as segment_op
from .. import dictionary
from ..functions import align
from . import Registry, dna, dna_sql, keeper, table
from .sequence import UNITS_SQL
from .statistics import TAIL

R = Registry()
WORDS = dictionary.default()


def _mutations(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as sample", "concat('m', l_linenumber) as name", "l_partkey % 3 > 0 as frameshift", "l_suppkey % 2 = 0 as template_match", "l_partkey % 11 = 0 as ambiguous_place",
        "case when l_partkey % 2 = 0 then 'exact' end as support_status", "case when l_suppkey % 3 = 0 then 'supported' when l_suppkey % 3 = 1 then 'discordant' end as read_support_status",
        "element_at(array('adequate', 'low', null), cast(l_orderkey % 3 + 1 as int)) as depth_status", "l_quantity < 10 as legacy_low",
    )


MUT = """(select l_orderkey as sample, 'm' || l_linenumber as name, l_partkey % 3 > 0 as f, l_suppkey % 2 = 0 as t, l_partkey % 11 = 0 as a, (l_partkey % 2 = 0 or l_suppkey % 3 = 0) as s,
 ['adequate', 'low', null][l_orderkey % 3 + 1] as d, l_quantity < 10 as low, l_linenumber from lineitem)"""
BLOCK = """concat_ws('; ', case when not f then 'not a frameshift' end, case when not t then 'no exact template' end, case when a then 'ambiguous localisation' end, case when not s then 'not supported by reads or edits' end,
 case when d <> 'adequate' then 'low carrier depth' end, case when d is null and low then 'low coverage' end)"""


def _blocked(spark, sf):
    m = _mutations(spark, sf)
    s = F.struct(*m.columns)
    return m.withColumn("blockers", D.blockers(s, F.col("depth_status"), F.col("legacy_low"))), s


@R.add(f"select sample, name, {BLOCK} as blockers, f and t and s as supported from {MUT}")
def mutation_blockers(spark, sf):
    m, s = _blocked(spark, sf)
    return m.select("sample", "name", F.array_join("blockers", "; ").alias("blockers"), D.supported(s).alias("supported"))


@R.add(f"""with m as (select sample, bool_or({BLOCK} = '') as free, bool_or({BLOCK} <> '') as blocked, any_value(d) as d from {MUT} group by sample), o as (select o_orderkey as sample, o_custkey % 50 as reads, o_custkey % 13 as amb, o_orderstatus <> 'P' as ok from orders)
select sample, case when m.sample is null then 'NO_CALL' when free then 'PATHOGENIC' when blocked or (d is null and reads < 30) or amb > 10 or not ok or d = 'low' then 'INCONCLUSIVE' else 'NO_PATHOGENIC_VARIANT_DETECTED' end as decision from o left join m using (sample)""")
def decision_state(spark, sf):
    m, _ = _blocked(spark, sf)
    listed = m.groupBy("sample").agg(F.collect_list(F.struct("name", "blockers")).alias("mutations"), F.first("depth_status").alias("depth_status"))
    o = table(spark, sf, "orders").selectExpr("o_orderkey as sample", "o_custkey % 50 as total_reads", "o_custkey % 13 as ambiguous_bases", "o_orderstatus <> 'P' as execution_ok")
    allele = F.struct(F.col("depth_status"), F.lit("resolved").alias("selection_status"), F.lit(0).alias("residual_sites"), F.lit(0).alias("unassessed_run_sites"), F.lit(False).alias("stage_discordant"))
    both = o.join(listed, "sample", "left").withColumn("_a", allele)
    why = D.allele_reasons(F.col("_a"), F.lit("allele_1"), F.col("depth_status").isNotNull())
    both = both.withColumn("alleles", F.when(F.col("mutations").isNotNull(), F.array(F.struct(F.col("depth_status"), why.alias("reasons")))))
    return D.decide(both).select("sample", "decision")


@R.add("""select o_orderkey as sample, concat_ws('; ', case when d is null and a then 'allele_1: depth not assessed' when d <> 'adequate' and a then 'allele_1: depth ' || d end, case when o_orderstatus = 'P' then 'allele_1: unresolved selection' end, case when o_custkey % 5 > 3 then 'allele_1: residual heterozygous sites' end) as reasons
 from (select *, ['adequate', 'low', null][o_orderkey % 3 + 1] as d, o_custkey % 2 = 0 as a from orders)""")
def gate_reasons(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey as sample", "element_at(array('adequate', 'low', null), cast(o_orderkey % 3 + 1 as int)) as d", "o_custkey % 2 = 0 as assessed", "if(o_orderstatus = 'P', 'unresolved_length', 'resolved') as s", "if(o_custkey % 5 > 3, 1, 0) as r")
    a = F.struct(F.col("d").alias("depth_status"), F.col("s").alias("selection_status"), F.col("r").alias("residual_sites"), F.lit(0).alias("unassessed_run_sites"), F.lit(False).alias("stage_discordant"))
    return o.select("sample", F.array_join(D.allele_reasons(a, F.lit("allele_1"), F.col("assessed")), "; ").alias("reasons"))


@R.add("""select event_id, coalesce(case when event_id % 3 = 0 then case when json_valid(j) then json_extract_string(j, '$.clinical.decision') end else json_extract_string(j, '$.clinical.decision') end, 'NO_CALL') as decision
 from (select event_id, case event_id % 3 when 0 then '{broken' when 1 then '{"clinical": {"decision": "PATHOGENIC"}}' else '{"clinical": {}}' end as j from events)""")
def stored_decision(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr("""case event_id % 3 when 0 then '{broken' when 1 then '{"clinical": {"decision": "PATHOGENIC"}}' else '{"clinical": {}}' end""").alias("j"))
    return e.select("event_id", D.stored_decision("j").alias("decision"))


@R.add("""select l_orderkey as sample, case when count(n) = 0 then 'normal' when max((n % 3 <> 0)::int) = 1 then 'pathogenic' else 'benign' end as truth from (select l_orderkey, case when l_linenumber > 2 then l_partkey % 7 - 3 end as n from lineitem) group by 1""")
def truth_class(spark, sf):
    return D.truth_class(table(spark, sf, "lineitem").selectExpr("l_orderkey as sample", "case when l_linenumber > 2 then l_partkey % 7 - 3 end as net_bp"))


@R.add("select l_orderkey as sample, l_linenumber as alternative, l_partkey % 4 as exact, l_suppkey % 3 as tp from lineitem qualify row_number() over (partition by l_orderkey order by l_partkey % 4, l_suppkey % 3, l_linenumber, l_extendedprice) = 1")
def worst_assignment(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey as sample", "l_linenumber as alternative", "l_partkey % 4 as exact", "l_suppkey % 3 as tp")
    return E.worst_assignment(t, "sample", ["exact", "tp"])


@R.add("""with s as (select l_orderkey, min(l_suppkey % 3) as tp, max(l_partkey % 2) as fp, max(l_linenumber) as n from lineitem group by 1) select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(n)::bigint as truth, round(sum(tp) / sum(n)::double, 6) as recall, round(sum(tp) / (sum(tp) + sum(fp))::double, 6) as precision from s""")
def evaluation_bounds(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey as sample", "l_suppkey % 3 as tp", "l_partkey % 2 as fp", "l_linenumber as truth")
    s = E.bounds(t, ["sample"], ["tp", "fp", "truth"]).withColumnRenamed("truth_max", "truth_events")
    return E.bounded_ratios(s).withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@R.add("""select l_linestatus, l_shipmode_ as band, k, n, round(k / n::double, 6) as rate from (select l_linestatus, l_suppkey % 4 as l_shipmode_, count_if(l_returnflag = 'R')::bigint as k, count(*)::bigint as n from lineitem group by all)""")
def stratified_table(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("band", F.col("l_suppkey") % 4)
    return E.stratified(t, ["l_linestatus", "band"], F.col("l_returnflag") == "R").select("l_linestatus", "band", "k", "n", F.round("rate", 6).alias("rate"))


@R.add("""with r as (select 'm' || (l_suppkey % 4) as metric, count(*) as n, avg((l_returnflag = 'R')::int) as rate from lineitem group by 1), t as (select * from (values ('m0', 0.1, null, true), ('m1', 0.9, null, true), ('m2', null, 0.5, false), ('m9', 0.5, null, true)) t(metric, minimum, maximum, binding))
select metric, round(rate, 6) as rate, case when n is null then null else coalesce(rate >= minimum, true) and coalesce(rate <= maximum, true) end as met, binding and not coalesce(case when n is null then null else coalesce(rate >= minimum, true) and coalesce(rate <= maximum, true) end, false) as fails from t left join r using (metric)""")
def targets(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("metric")).agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("rate"))
    t = spark.createDataFrame([("m0", 0.1, None, True), ("m1", 0.9, None, True), ("m2", None, 0.5, False), ("m9", 0.5, None, True)], "metric string, minimum double, maximum double, binding boolean")
    return E.judge_targets(r, t).select("metric", F.round("rate", 6).alias("rate"), "met", "fails")


P = TAIL.format(p="0.5", a="0", b="least(b, c) + 1")


@R.add(f"""with x as (select l_suppkey % 10 as profile, m, count_if(n = 1 and o = 0)::bigint as b, count_if(n = 0 and o = 1)::bigint as c from (
 select l_suppkey, 'exact' as m, (l_returnflag = 'R')::int as o, (l_quantity > 30)::int as n from lineitem union all select l_suppkey, 'fp', (l_linestatus = 'O')::int, (l_discount > 0.02)::int from lineitem) group by all),
p as (select *, b + c as n, case when b + c = 0 then 1 else least(1, 2 * {P}) end as p from (select *, b + c as n from x)), o as (select *, row_number() over (partition by profile order by p, m) as i from p)
select profile, m as metric, b, c, round(p, 6) as p, round(least(1, max((2 - i + 1) * p) over (partition by profile order by i rows unbounded preceding)), 6) as adjusted from o""".replace("b + c as n, case when", "case when"))
def adoption_rule(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_suppkey % 10 as profile", "cast(l_returnflag = 'R' as int) as exact_base", "cast(l_quantity > 30 as int) as exact_new", "cast(l_linestatus = 'O' as int) as fp_base", "cast(l_discount > 0.02 as int) as fp_new")
    return E.adoption(t, ["exact", "fp"]).select("profile", "metric", "b", "c", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@R.add("""with m as (select p_brand as point, 'size' as metric, avg(p_size) as value from part group by 1 union all select p_brand, 'price', case when p_brand like '%1' then null else avg(p_retailprice) end from part group by p_brand), c as (select * from (values ('size', 24.0, null), ('price', null, 1500.0)) c(metric, minimum, maximum)),
b as (select p.point, c.metric, not coalesce(coalesce(value >= minimum, minimum is null) and coalesce(value <= maximum, maximum is null) and value is not null, false) as bad from (select distinct point from m) p, c left join m on m.point = p.point and m.metric = c.metric)
select point, coalesce(string_agg(metric, ',' order by metric) filter (bad), '') as violated from b group by point""")
def objective_judge(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "point")
    g = p.groupBy("point").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price")).withColumn("price", F.when(~F.col("point").endswith("1"), F.col("price")))
    m = g.select("point", F.explode(F.array(F.struct(F.lit("size").alias("metric"), F.col("size").alias("value")), F.struct(F.lit("price").alias("metric"), F.col("price").alias("value")))).alias("x")).select("point", "x.*")
    c = spark.createDataFrame([("size", 24.0, None), ("price", None, 1500.0)], "metric string, minimum double, maximum double")
    return E.judge_objective(m, c).select("point", F.array_join("violated", ",").alias("violated"))


@R.add()
def cluster_bootstrap(spark, sf):
    """Mean discount with an interval over resampled suppliers (the replicates are the operator's)."""
    return E.cluster_bootstrap(table(spark, sf, "lineitem"), "l_suppkey", "l_discount", replicates=500)


@R.add("""with t as (select o_orderkey as sample, (o_custkey % 40)::double as t1, (o_custkey % 40 + 5)::double as t2, case when o_custkey % 3 > 0 then (o_custkey % 41)::double end as c1, case when o_custkey % 3 > 1 then (o_custkey % 40 + 7)::double end as c2 from orders),
p as (select *, abs(t1 - c1) as a, abs(t2 - c2) as b, abs(t1 - c2) as c, abs(t2 - c1) as d, 2 + (c1 is not null)::int + (c2 is not null)::int as n from t),
o as (select sample, n, 0 as k, 0.0::double as d, 0 as i from p union all select sample, n, 1, a, 1 from p where a <= 3 union all select sample, n, 1, c, 2 from p where c <= 3 union all select sample, n, 1, d, 3 from p where d <= 3 union all select sample, n, 1, b, 4 from p where b <= 3
 union all select sample, n, 2, a + b, 5 from p where a <= 3 and b <= 3 union all select sample, n, 2, c + d, 6 from p where c <= 3 and d <= 3)
select sample, k::int as matched, d as distance, (2 - k)::int as missed, (n - 2 - k)::int as extra from o qualify row_number() over (partition by sample order by n - 2 * k, d, i) = 1""")
def assign_lengths(spark, sf):
    o = table(spark, sf, "orders")
    t = o.selectExpr("o_orderkey as sample", "array(cast(o_custkey % 40 as double), cast(o_custkey % 40 + 5 as double)) as lengths")
    p = o.selectExpr("o_orderkey as sample", "filter(array(if(o_custkey % 3 > 0, cast(o_custkey % 41 as double), null), if(o_custkey % 3 > 1, cast(o_custkey % 40 + 7 as double), null)), x -> x is not null) as centers")
    return E.assign_lengths(t, p, 3.0)


@R.add("""select o_orderpriority as arm, count(*)::bigint as runs, count_if(c)::bigint as callable_runs, count_if(coalesce(r, false))::bigint as recovered_runs, count(distinct o_custkey)::bigint as samples, count(distinct case when c then o_custkey end)::bigint as callable_samples, count(distinct case when r then o_custkey end)::bigint as recovered_samples
 from (select *, o_orderstatus = 'O' as c, case when o_orderstatus = 'O' then o_orderkey % 2 = 0 end as r from orders) group by 1""")
def cohort_recovery(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderpriority as arm", "o_custkey as biological_sample", "o_orderstatus = 'O' as callable", "case when o_orderstatus = 'O' then o_orderkey % 2 = 0 end as recovered")
    return E.cohort_summary(o, ["arm"])


@R.add("""select metric, round(value, 6) as value, abs(value - target) <= tolerance as within from (values ('click', 50.0, 5.0), ('view', 10.0, 1.0), ('absent', 1.0, 1.0)) t(metric, target, tolerance) left join (select event_type as metric, avg(value) as value from events group by 1) f using (metric)""")
def realism_compare(spark, sf):
    f = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    t = spark.createDataFrame([("click", 50.0, 5.0), ("view", 10.0, 1.0), ("absent", 1.0, 1.0)], "metric string, target double, tolerance double")
    return E.compare_metrics(f, t).select("metric", F.round("value", 6).alias("value"), "within")


V = "(select l_suppkey as sample, l_partkey::int as pos, substr('ACG', 1, (l_linenumber % 3 + 1)::int) as ref, case l_orderkey % 3 when 0 then '0|1' when 1 then '1|1' else '0/1' end as genotype, l_linenumber % 2 as ps, l_linenumber as n from lineitem)"


@R.add(f"""with v as (select *, substr(genotype, 1, 1) <> substr(genotype, 3, 1) as het, coalesce(pos < lag(pos + length(ref)) over (partition by sample order by pos, ref), false) as ov from {V}),
n as (select sample, count_if(het)::bigint as het, count(distinct case when het then ps end)::bigint as sets, count_if(het and genotype not like '%|%')::bigint as unphased, bool_or(ov) as overlap from v group by sample)
select *, case when overlap then 'overlapping' when het = 0 then 'homozygous' when het = 1 then 'single_site' when unphased = 0 and sets = 1 then 'phased' else 'unphased' end as status from n""")
def phase_evidence(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_suppkey as sample", "cast(l_partkey as int) as pos", "substr('ACG', 1, cast(l_linenumber % 3 + 1 as int)) as ref", "case l_orderkey % 3 when 0 then '0|1' when 1 then '1|1' else '0/1' end as genotype", "l_linenumber % 2 as phase_set")
    return L.phase_evidence(v)


@R.add(f"select doc_id as id, substr(d, 1, 4) || 'TT' || substr(d, 6, 14) || 'G' || substr(d, 23) as consensus from (select doc_id, {dna_sql('doc_id')} as d from documents)")
def apply_variants(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), dna("doc_id").alias("seq"))
    v = c.select("id", F.explode(F.array(F.struct(F.lit(5).alias("pos"), F.substring("seq", 5, 1).alias("ref"), F.lit("TT").alias("alt")), F.struct(F.lit(20).alias("pos"), F.substring("seq", 20, 3).alias("ref"), F.lit("G").alias("alt")))).alias("x")).select("id", "x.*")
    return L.apply_variants(c, v).select("id", "consensus")


@R.add("""with p as (select l_suppkey as sample, l_partkey as pos, substr('ACGT', 1, (l_linenumber % 3 + 1)::int) as ref, substr('TGCA', 1, (l_orderkey % 4 + 1)::int) as alt, l_quantity / 50 as af, l_orderkey % 20 as dp, l_linenumber from lineitem), a as (select * from p where l_linenumber % 2 = 0)
select s.sample, coalesce(n, 0)::bigint as discordant from (select distinct sample from p) s left join (select sample, count(*) as n from p where (length(alt) - length(ref)) % 3 <> 0 and af >= 0.5 and dp >= 10 and not exists (select 1 from a where a.sample = p.sample and a.pos = p.pos and a.ref = p.ref and a.alt = p.alt) group by 1) d using (sample)""")
def stage_discordance(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr("l_suppkey as sample", "l_partkey as pos", "substr('ACGT', 1, cast(l_linenumber % 3 + 1 as int)) as ref", "substr('TGCA', 1, cast(l_orderkey % 4 + 1 as int)) as alt", "l_quantity / 50 as af", "l_orderkey % 20 as dp", "l_linenumber")
    return L.stage_discordance(p, p.where("l_linenumber % 2 = 0"))


@R.add("""with c as (select l_suppkey as sample, (l_partkey % 97)::bigint as units, count(*) as n from lineitem group by all), k as (select *, case when units - lag(units) over (partition by sample order by units) >= 3 then 1 else 0 end as new from c where n >= 2),
g as (select *, sum(new) over (partition by sample order by units) as i from k), z as (select sample, sum(n)::bigint as total, round_even(sum(units * n) / sum(n)::double, 0)::bigint as center from g group by sample, i),
r as (select *, row_number() over (partition by sample order by total desc, center) as rank from z)
select sample, rank::int as rank, total, center + 9 as length, count(*) over (partition by sample) = 1 as homozygous from r where rank <= 2""")
def detect_alleles(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 97).alias("units")).agg(F.count("*").alias("n"))
    return L.detect_alleles(c, least=2, gap=3).select("sample", "rank", "total", "length", "homozygous")


def _chains(spark, sf, events=True, units=7):
    """A chain of seven units for each document, one of some an X with an inserted C, or without it."""
    u = F.broadcast(WORDS.tables(spark)["units"].select("ord", "seq"))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.sequence(F.lit(1), F.lit(units))).alias("p", "k"))
    j = d.join(u, F.col("ord") == F.pmod(F.col("doc_id") * 3 + F.col("k") * 5, F.lit(34)))
    unit = F.when((F.col("k") == 4) & (F.col("doc_id") % 4 == 0), F.lit(DUPC if events else WORDS.units["X"])).otherwise(F.col("seq"))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", unit.alias("s")))), lambda x: x["s"]), "").alias("seq"))


DUPC = next(s for s, v in WORDS.mutated.items() if v == ("X", "dupC"))


@R.add(f"""select doc_id::varchar as id, k::int as index, case when k = 4 and doc_id % 4 = 0 then 'X:dupC' else u.id end as label, k = 4 and doc_id % 4 = 0 as frameshift from documents, range(1, 8) r(k) join {UNITS_SQL} on ord = (doc_id * 3 + k * 5) % 34""")
def segment_events(spark, sf):
    return segment_op.segments(_chains(spark, sf).select(F.col("doc_id").alias("id"), "seq")).select("id", "index", "label", "frameshift")


@R.add(f"""select doc_id, k::int as index, case when k = 4 and doc_id % 4 = 0 then 'X:dupC' else u.id end as label, k = 4 and doc_id % 4 = 0 as frameshift, reverse(translate(case when k = 4 and doc_id % 4 = 0 then '{DUPC}' else u.seq end, 'ACGT', 'TGCA')) as turned
 from documents, range(1, 8) r(k) join {UNITS_SQL} on ord = (doc_id * 3 + k * 5) % 34""")
def segment_sql(spark, sf):
    """Segmentation and functions of sequences called from SQL."""
    import uuid

    from ..functions.tables import register

    view = f"chains_{uuid.uuid4().hex}"
    register(spark, WORDS, "sf_")
    _chains(spark, sf).createOrReplaceTempView(view)
    out = spark.sql(f"select doc_id, s.index, s.label, sf_is_frameshift(s.net_bp) as frameshift, sf_revcomp(substring(seq, s.start + 1, s.end - s.start)) as turned from {view}, lateral sf_segment(seq) as s")
    spark.catalog.dropTempView(view)
    return out


@R.add(f"select doc_id, levenshtein({dna_sql('doc_id')} || {dna_sql('doc_id + 1')} || {dna_sql('doc_id + 2')}, {dna_sql('doc_id + 1')} || {dna_sql('doc_id + 2')} || {dna_sql('doc_id + 3')})::int as distance from documents")
def edit_distance_long(spark, sf):

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align.edit_distance(x, y) for x, y in zip(a, b)])

    d = table(spark, sf, "documents")
    s = lambda k: dna(F.col("doc_id") + k)
    return d.select("doc_id", distance(F.concat(s(0), s(1), s(2)), F.concat(s(1), s(2), s(3))).alias("distance"))


@R.add(f"""with t as (select doc_id, {dna_sql('doc_id')} || {dna_sql('doc_id + 1')} as seq, substr({dna_sql('doc_id')}, 11, 12) as q from documents) select doc_id, instr(seq, q)::int - 1 as start, instr(seq, q)::int + 11 as "end", 0 as edits from t""")
def infix_hit(spark, sf):

    @F.pandas_udf("start int, end int, edits int")
    def hit(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align.infix_hit(a, b, 3) or (None, None, None) for a, b in zip(q, t)], columns=["start", "end", "edits"])

    d = table(spark, sf, "documents").select("doc_id", F.concat(dna("doc_id"), dna(F.col("doc_id") + 1)).alias("seq"), F.substring(dna("doc_id"), 11, 12).alias("q"))
    return d.withColumn("h", hit("q", "seq")).select("doc_id", "h.start", "h.end", "h.edits")


def _reads(spark, sf):
    """Reads of an allele with a length by document, some reversed and some cut short."""
    head, tail = "".join(WORDS.units[u] for u in "12345"), "".join(WORDS.units[u] for u in "6789")
    seq = F.concat(F.lit(WORDS.left[-40:] + head), F.repeat(F.lit(WORDS.units["X"]), (F.col("doc_id") % 3 * 4 + 8).cast("int")), F.lit(tail + WORDS.right[:40]))
    seq = F.when(F.col("doc_id") % 5 == 0, F.substring(seq, 1, 600)).otherwise(seq)
    from ..functions.sequence import reverse_complement

    seq = F.when(F.col("doc_id") % 2 == 0, reverse_complement(seq)).otherwise(seq)
    return table(spark, sf, "documents").select(F.col("lang").alias("sample"), F.col("doc_id").alias("ord"), F.concat(F.lit("r"), "doc_id").alias("name"), seq.alias("seq"), F.repeat(F.lit("5"), F.length(seq)).alias("qual"))


@R.add("""select lang as sample, doc_id as ord, case when doc_id % 5 = 0 then 'left' else 'spanning' end as category, case when doc_id % 5 > 0 then (doc_id % 3 * 4 + 17) * 60 else 600 end::int as length,
 case when doc_id % 5 > 0 then case when doc_id % 2 = 0 then '-' else '+' end end as strand, case when doc_id % 5 > 0 then 20.0 end as mean_q from documents""")
def categorize_reads(spark, sf):
    return reads_op.categorize(_reads(spark, sf)).select("sample", "ord", "category", "length", "strand", "mean_q")


@R.add()
def phase_split(spark, sf):
    """Consensus groups of the reads of each length peak."""
    from ..operators import phase

    spans = reads_op.categorize(_reads(spark, sf)).where("category = 'spanning'").select("sample", F.col("length").cast("long").alias("peak"), "ord", "seq", "strand")
    return phase.phase(spans, keep=keeper(spark, "phase"))


@R.add()
def assign_reads(spark, sf):
    """Every read assigned to two alleles of its sample."""
    r = _reads(spark, sf)
    alleles = r.groupBy("sample").agg(F.max_by("seq", "ord").alias("a"), F.min_by("seq", "ord").alias("b"))
    refs = alleles.select("sample", F.explode(F.array(F.struct(F.lit("allele_1").alias("allele"), F.col("a").alias("seq")), F.struct(F.lit("allele_2").alias("allele"), F.col("b").alias("seq")))).alias("x")).select("sample", "x.*")
    from ..config import ReadSettings

    return reads_op.assign(r, refs, ReadSettings(fragment_bp=500))


@R.add("""select doc_id::varchar as sample, 4 as index, 'run' as kind, 'dupC' as template, 12::bigint as n, case when doc_id % 3 = 0 then 12 else 3 end::bigint as alt, case when doc_id % 3 = 0 then 0 else 9 end::bigint as ref, 0::bigint as other
 from documents where doc_id % 4 = 0""")
def event_support(spark, sf):
    """Reads for and against each event: twelve for each document, of which all or a quarter carry its event."""
    from ..operators import support

    alleles = _chains(spark, sf).select(F.col("doc_id").cast("string").alias("sample"), F.lit("allele_1").alias("allele"), "seq", "doc_id")
    both = alleles.join(_chains(spark, sf, events=False).withColumnRenamed("seq", "wild"), "doc_id").withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    own = F.when((F.col("doc_id") % 3 == 0) | (F.col("ord") % 4 == 0), F.col("seq")).otherwise(F.col("wild"))
    members = both.select("sample", "allele", "ord", own.alias("seq"), F.when(F.col("ord") % 2 == 0, "+").otherwise("-").alias("strand"))
    units = segment_op.segments(alleles.select(F.concat_ws("/", "sample", "allele").alias("id"), "seq"))
    found, _ = support.event_support(alleles.drop("doc_id"), units, members, keep=keeper(spark, "support"))
    return found.select("sample", "index", "kind", "template", "n", "alt", "ref", "other")


@R.add(f"""select doc_id, md5(string_agg(u.seq, '' order by k)) as digest from documents, range(1, 4) r(k) join {UNITS_SQL} on ord = (doc_id * 3 + k * 5) % 34 group by doc_id""")
def graph_consensus(spark, sf):
    """The chain of each document from five reads of it, each with an error of its own."""
    from ..functions.consensus import consensus

    reads = _chains(spark, sf, units=3).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = F.pmod(F.col("doc_id") + 37 * F.col("k"), F.length("seq")).cast("int")
    wrong = F.concat(F.substring("seq", F.lit(1), at), F.translate(F.substring("seq", at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring("seq", at + 2, F.length("seq")))
    return joins.spread(reads.select("doc_id", wrong.alias("read")), "doc_id").groupBy("doc_id").agg(consensus("partial_order")("read").alias("seq")).select("doc_id", F.md5(F.col("seq").cast("binary")).alias("digest"))


@R.add()
def sample_decisions(spark, sf):
    """From reads to each sample's decision, with what speaks against a call."""
    from ..plans.decision import call

    return call(_reads(spark, sf), keep=keeper(spark, "decisions"))["decisions"]


@R.add()
def ladder_alleles(spark, sf):
    """Alleles of each supplier from records of reads on a ladder of contigs, with splits of a single cluster."""
    t = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    true = F.when(F.col("l_orderkey") % 2 == 0, 40).otherwise(40 + F.col("l_suppkey") % 9)
    # each read has a record on three contigs around its own
    rows = t.withColumn("own", true).withColumn("off", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    records = rows.select(
        F.col("l_suppkey").alias("sample"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("read"), (F.col("own") + F.col("off")).cast("int").alias("units"), (3000 - 60 * F.abs("off")).alias("score"),
        (60 * F.abs("off")).alias("indel"), (30 + 60 * (F.col("own") + 9)).cast("int").alias("length"), F.when(F.col("off") == 0, 0).otherwise(256).alias("flag"),
    )
    return L.alleles_of_ladder(records)
