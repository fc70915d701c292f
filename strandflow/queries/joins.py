"""Joins: dictionary, nearest, interval, assignment, anti and paired."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dictionary
from ..operators import joins as J
from . import Registry, dna, dna_sql, table
from .sequence import UNITS_SQL

R = Registry()
WORDS = dictionary.default()
TEMPLATES_SQL = "(values " + ", ".join(f"('{n}', '{u}', '{s}')" for s, (u, n) in WORDS.mutated.items()) + ") t(name, parent, seq)"

# A unit of each document, with an inserted C or a changed base in some.
PIECE = "case doc_id % 5 when 0 then substr(seq, 1, 59) || 'C' || substr(seq, 60) when 1 then 'T' || substr(seq, 2) else seq end"
PIECES = f"(select doc_id, {PIECE} as seq from (select doc_id, seq from documents join {UNITS_SQL} on ord = doc_id % 34))"


def _pieces(spark, sf):
    u = F.broadcast(WORDS.tables(spark)["units"].select(F.col("ord").alias("o"), "seq"))
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(u, F.col("doc_id") % 34 == F.col("o")).select("doc_id", F.expr(PIECE).alias("seq"))


@R.add(f"""select doc_id, coalesce(u.id, t.parent) as unit_id, case when u.id is null then t.name end as template, case when u.id is not null then 'exact' when t.name is not null then 'template' else 'none' end as match
 from {PIECES} p left join {UNITS_SQL} on p.seq = u.seq left join {TEMPLATES_SQL} on p.seq = t.seq""")
def unit_lookup(spark, sf):
    t = WORDS.tables(spark)
    return J.unit_lookup(_pieces(spark, sf), t["units"], t["templates"]).drop("seq")


@R.add(f"""select doc_id, id as unit_id, d as distance from (select doc_id, u.id, levenshtein(p.seq, u.seq)::int as d, row_number() over (partition by doc_id order by levenshtein(p.seq, u.seq), ord) as r
 from {PIECES} p, {UNITS_SQL}) where r = 1""")
def nearest_unit(spark, sf):
    return J.nearest_unit(_pieces(spark, sf), WORDS.tables(spark)["units"]).drop("seq")


SPANS = "(select l_suppkey as sample, l_orderkey, l_linenumber, (l_quantity * 60)::int as length from lineitem)"
PEAKS = "(select s_suppkey as sample, c * 60 as center, (30 + 0.6 * c)::double as half from supplier, (values (12), (30)) v(c))"


def _spans(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_orderkey", "l_linenumber", (F.col("l_quantity") * 60).cast("int").alias("length"))


def _peaks(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), F.explode(F.array(F.lit(12), F.lit(30))).alias("c"))
    return s.select("sample", (F.col("c") * 60).alias("center"), (30 + 0.6 * F.col("c")).alias("half"))


@R.add(f"""select sample, l_orderkey, l_linenumber, length, case when abs(length - center) <= half then center end::int as peak,
 case when abs(length - center) <= half then 'assigned' when 720 - length > 90 then 'short_product' else 'unassigned' end as class
 from (select s.*, p.center, p.half, row_number() over (partition by s.rid order by abs(length - center), center) as r from (select *, row_number() over () as rid from {SPANS}) s join {PEAKS} p using (sample)) where r = 1""")
def nearest_peak(spark, sf):
    return J.nearest_peak(_spans(spark, sf), _peaks(spark, sf))


READ, REF = f"substr({dna_sql('doc_id')}, 1, 20)", "case n when 0 then substr({a}, 1, 20) when 1 then substr({b}, 1, 20) else substr({a}, 1, 16) || 'ACGT' end"


@R.add(f"""with r as (select doc_id as read, lang as key, {READ} as seq from documents), f as (
 select lang as key, n, 'ref' || n as name, case n when 0 then {dna_sql("m")} else {dna_sql("m + 1")} end as ref from (select lang, min(doc_id) as m from documents group by lang), range(0, 2) q(n)),
d as (select r.*, name, n, levenshtein(seq, substr(ref, 1, 20)) as d, row_number() over (partition by read order by levenshtein(seq, substr(ref, 1, 20)), n) as k from r join f using (key)),
w as (select read, any_value(key) as key, any_value(seq) as seq, min(d) filter (k = 1) as d1, min(d) filter (k = 2) as d2, any_value(name) filter (k = 1) as name from d group by read)
select key, read, d1::int as distance, case when d1 > 0.6 * length(seq) then 'off_target' when d2 - d1 < 3 then 'undecided' else name end as assigned from w""")
def assign_reads_exact(spark, sf):
    d = table(spark, sf, "documents")
    reads = d.select(F.col("lang").alias("key"), F.col("doc_id").alias("read"), F.substring(dna("doc_id"), 1, 20).alias("seq"))
    refs = d.groupBy("lang").agg(F.min("doc_id").alias("m")).select(F.col("lang").alias("key"), F.posexplode(F.array(F.col("m"), F.col("m") + 1)).alias("ord", "m"))
    refs = refs.select("key", "ord", F.concat(F.lit("ref"), "ord").alias("name"), F.substring(dna("m"), 1, 20).alias("seq"))
    return J.argmin_assign(reads, refs, lambda a, b: F.levenshtein(a, b), error_rate=0.6).drop("seq")


@R.add("""with p as (select s_suppkey as sample, c as peak, c * 60 - 90 as low, c * 60 + 90 as high, c * 40 as support from supplier, (values (10), (14)) v(c)),
x as (select l_suppkey as sample, l_quantity * 60 as a, (l_partkey % 30) * 60 as b from lineitem)
select sample, least(l.peak, r.peak)::int as i, greatest(l.peak, r.peak)::int as j, count(*)::bigint as n, min(least(l.support, r.support))::int as parent, count(*) <= 0.05 * min(least(l.support, r.support)) as accepted
 from x join p l using (sample) join p r using (sample) where a between l.low and l.high and b between r.low and r.high group by 1, 2, 3""")
def dimer_pairs(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("read"), (F.col("l_quantity") * 60).alias("left_bp"), ((F.col("l_partkey") % 30) * 60).alias("right_bp"))
    peaks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), F.explode(F.array(F.lit(10), F.lit(14))).alias("peak"))
    return J.dimer_pairs(parts, peaks.select("sample", "peak", (F.col("peak") * 60 - 90).alias("low"), (F.col("peak") * 60 + 90).alias("high"), (F.col("peak") * 40).alias("support")))


@R.add(f"""with t as (select o_orderkey as k, n as t, {dna_sql("o_orderkey + n")} as v from orders, range(1, 3) r(n)), p as (select o_orderkey as k, n as p, {dna_sql("o_orderkey + 3 - n")} as v from orders, range(1, 3) r(n) where n = 1 or o_orderkey % 3 > 0),
plans as (select * from (values (0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 1)) x(alternative, t, p)),
c as (select t.k, alternative, t.t, p.p, levenshtein(t.v, p.v) as d from plans join t on t.t = plans.t join p on p.p = plans.p and p.k = t.k),
s as (select k, alternative, sum(d) as cost, dense_rank() over (partition by k order by count(*) desc, sum(d)) as r from c group by k, alternative)
select k, alternative::int as alternative, cost::bigint as cost, t::int as t, p::int as p from s join c using (k, alternative) where r = 1""")
def optimal_match(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    t = o.select("k", F.col("n").alias("t"), dna(F.col("k") + F.col("n")).alias("t_value"))
    p = o.where("n = 1 or k % 3 > 0").select("k", F.col("n").alias("p"), dna(F.col("k") + 3 - F.col("n")).alias("p_value"))
    return J.optimal_match(t, p, "k", lambda a, b: F.levenshtein(a, b).cast("long"))


@R.add("select o_orderkey, o_totalprice as a, o_totalprice * 2 as b from orders")
def paired_units(spark, sf):
    o = table(spark, sf, "orders")
    return J.paired(o.select("o_orderkey", F.col("o_totalprice").alias("a")), o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("b")), ["o_orderkey"])


@R.add("select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey")
def required_case(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return J.required(rows, cases, ["l_orderkey"])


@R.add("select distinct l_partkey as pos, l_suppkey as alt from lineitem a where l_linenumber > 2 and not exists (select 1 from lineitem b where b.l_linenumber <= 2 and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey)")
def anti_frameshift(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("alt"), "l_linenumber")
    return J.missing(t.where("l_linenumber > 2").select("pos", "alt").distinct(), t.where("l_linenumber <= 2"), ["pos", "alt"])


@R.add(f"""with m as (select doc_id as id, n as index, u.seq as parent, substr(u.seq, 1, (doc_id % 40)::int) || 'G' || substr(u.seq, (doc_id % 40)::int + 1) as seq from documents, range(1, 3) r(n) join {UNITS_SQL} on ord = n + 6 + doc_id % 2),
e as (select doc_id as id, n as edit, (doc_id % 40 + case when n = 0 then 1 when doc_id % 3 = 0 then 1 else 2 end)::int as s from documents, range(0, 2) r(n)),
x as (select m.id, m.index, count(*) over (partition by e.id, e.edit) as n from m join e using (id) where substr(parent, 1, s - 1) || 'G' || substr(parent, s) = seq)
select m.id, m.index::int as index, case when min(n) is null then 'unsupported' when min(n) > 1 then 'ambiguous' else 'supported' end as status from m left join x on m.id = x.id and m.index = x.index group by m.id, m.index""")
def edit_concordance(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    u = F.broadcast(WORDS.tables(spark)["units"].select("ord", F.col("seq").alias("parent_seq")))
    m = d.withColumn("index", F.explode(F.array(F.lit(1), F.lit(2)))).join(u, F.col("ord") == F.col("index") + 6 + F.col("id") % 2)
    m = m.selectExpr("id", "index", "parent_seq", "concat(substr(parent_seq, 1, cast(id % 40 as int)), 'G', substr(parent_seq, cast(id % 40 as int) + 1)) as seq")
    e = d.withColumn("edit", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("id", "edit", "'insert' as kind", "cast(id % 40 + case when edit = 0 then 1 when id % 3 = 0 then 1 else 2 end as int) as start", "cast(null as int) as end", "'G' as bases")
    return J.concordance(m, e).select("id", "index", "status")


@R.add("""select l_orderkey as id, l_linenumber as index, coalesce(sum(bp) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0)::bigint as start,
 sum(bp) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and current row)::bigint as "end" from (select l_orderkey, l_linenumber, case when l_partkey % 4 = 0 then 60 else 60 end as bp from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_partkey))""")
def display_shift(spark, sf):
    u = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("index")).agg(F.min("l_partkey").alias("p"))
    units = u.select("id", "index", (60 + (F.col("p") % 4 == 0).cast("int")).alias("bp"))
    return J.shift_by_changes(units, u.where("p % 4 = 0").select("id", "index", F.lit(1).alias("net"))).select("id", "index", "start", "end")


@R.add("select p_partkey, round(p_retailprice - case when p_partkey % 3 > 0 then p_retailprice * 0.9 end, 6) as delta from part")
def point_shift(spark, sf):
    p = table(spark, sf, "part")
    r = p.where("p_partkey % 3 > 0").select("p_partkey", (F.col("p_retailprice") * 0.9).alias("p_retailprice"))
    return J.delta(p.select("p_partkey", "p_retailprice"), r, "p_partkey", "p_retailprice").select("p_partkey", F.round("delta", 6).alias("delta"))


@R.add("""with e as (select p_partkey as id, p_size * 10 as length from part), s as (select 'span' || n as name, n * 40 as low, n * 40 + 60 as high from range(0, 12) r(n))
select id, length, array_to_string(list_sort(list_distinct(list(name) filter (name is not null))), ',') as candidates from e left join s on length between low - 15 and high + 15 group by id, length""")
def interval_overlap(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10).alias("length"))
    s = spark.range(12).select(F.concat(F.lit("span"), "id").alias("name"), (F.col("id") * 40).alias("low"), (F.col("id") * 40 + 60).alias("high"))
    return J.candidates_of_span(e, s, 15, 90).withColumn("candidates", F.array_join("candidates", ","))


@R.add("""with e as (select l_returnflag as g, l_linenumber as i, l_suppkey % 50 as s from lineitem where l_orderkey % 2 = 0), a as (select l_returnflag as g, l_linenumber as i, l_suppkey % 50 as s from lineitem where l_orderkey % 2 = 1),
ec as (select g, i, s, count(*) as e from e group by all), ac as (select g, i, s, count(*) as a from a group by all)
select g, sum(least(coalesce(e, 0), coalesce(a, 0)))::bigint as tp, sum(greatest(coalesce(e, 0) - coalesce(a, 0), 0))::bigint as fn, sum(greatest(coalesce(a, 0) - coalesce(e, 0), 0))::bigint as fp from ec full join ac using (g, i, s) group by g""")
def multiset_tp_fn_fp(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 50).alias("s"), "l_orderkey")
    return J.multiset_counts(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1"), ["g"], ["i", "s"])


@R.add("""select d.doc_id, l.quality, case when l.doc_id is null then 'not_attempted' when quality = 1 then 'completed' else 'failed' end as status, b.n as benchmark_hits
 from documents d left join labels l using (doc_id) left join (select item_id as doc_id, length(text)::bigint as n from benchmark) b using (doc_id)""")
def cohort_left_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("_l"))
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("benchmark_hits"))
    out = d.join(labels, "doc_id", "left").join(bench, "doc_id", "left")
    return out.select("doc_id", "quality", F.when(F.col("_l").isNull(), "not_attempted").when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"), "benchmark_hits")
