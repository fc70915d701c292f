"""Reads against their sources, cohorts against their truths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import profile as P
from ..operators.sweep import sweep
from . import Registry, dna, dna_sql, folder_of_its_own, table

R = Registry()


@R.add("""with e as (select case when o_custkey % 2 = 0 then '+' else '-' end as strand, o_orderkey % 4 as edit from orders),
s as (select strand, edit from e union all select 'all', edit from e),
k as (select strand, edit, unnest(['mismatch', 'deletion', 'insertion', 'error']) as kind from s)
select strand, kind, count_if(case kind when 'mismatch' then edit = 1 when 'deletion' then edit = 2 when 'insertion' then edit = 3 else edit > 0 end)::bigint as errors, (count(*) * 64)::bigint as bases,
 round(count_if(case kind when 'mismatch' then edit = 1 when 'deletion' then edit = 2 when 'insertion' then edit = 3 else edit > 0 end) / (count(*) * 64)::double, 9) as rate from k group by strand, kind""")
def read_errors(spark, sf):
    """Every order is a read of its customer's nation, with one letter changed, lost or put in within the interval, or none."""
    n = F.col("n_nationkey").cast("int")
    sources = table(spark, sf, "nation").select(F.lit("all").alias("case"), n.alias("hap"), F.concat(dna(n), dna(n + 1000), dna(n + 2000)).alias("seq"), F.lit(16).alias("lo"), F.lit(80).alias("hi"))
    place = F.col("o_custkey") % 40 + 25
    orders = table(spark, sf, "orders").withColumn("hap", (F.col("o_custkey") % 25).cast("int")).join(F.broadcast(sources.select("hap", "seq")), "hap")
    before, letter, after = F.substring("seq", F.lit(1), place - 1), F.substring("seq", place, F.lit(1)), F.substring("seq", place + 1, F.lit(96))
    edit = F.col("o_orderkey") % 4
    read = F.when(edit == 0, F.col("seq")).when(edit == 1, F.concat(before, F.translate(letter, "ACGT", "CGTA"), after)).when(edit == 2, F.concat(before, after)).otherwise(F.concat(before, F.translate(letter, "ACGT", "CGTA"), letter, after))
    strand = F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-")
    rows = orders.select(F.lit("all").alias("case"), F.col("o_orderkey").cast("string").alias("read_id"), F.lit("full").alias("kind"), "hap", strand.alias("strand"), F.lit(0).alias("src_start"), F.lit(96).alias("src_end"), read.alias("read"))
    reads = rows.select("case", F.col("read_id").alias("name"), F.when(F.col("strand") == "+", F.col("read")).otherwise(F.reverse(F.translate("read", "ACGT", "TGCA"))).alias("seq"))
    profile = P.read_profile(rows.drop("read"), reads, sources)
    return P.error_table(profile).withColumn("rate", F.round("rate", 9))


@R.add("""with l as (select l_suppkey as sample, l_suppkey % 7 * 60 + 900 as low, l_suppkey % 7 * 60 + 900 + (l_suppkey % 11 + 1) * 60 as high, case when l_quantity > 25 then 1 else 0 end as long, l_returnflag, l_partkey % 200 - 160 as d from lineitem),
s as (select *, case when long = 1 then high else low end + d as span from l), n as (select *, case when abs(span - low) <= abs(span - high) then low else high end as near from s)
select sample as "case", count(*)::bigint as products, round(avg((l_returnflag = 'R')::int), 9) as smear_frac, round(avg((abs(span - near) > 90)::int), 9) as off_frac, round(avg((span > low + 90 and span < high - 90)::int), 9) as between_frac, round(avg((span < low - 90)::int), 9) as below_frac from n group by sample""")
def span_fractions(spark, sf):
    return P.span_fractions(_products(spark, sf)).select("case", "products", *[F.round(c, 9).alias(c) for c in ("smear_frac", "off_frac", "between_frac", "below_frac")])


@R.add("""with l as (select l_suppkey as sample, l_suppkey % 7 * 60 + 900 as low, l_suppkey % 7 * 60 + 900 + (l_suppkey % 11 + 1) * 60 as high, case when l_quantity > 25 then 1 else 0 end as long, l_partkey % 200 - 160 as d from lineitem),
s as (select *, case when long = 1 then high else low end + d as span from l), n as (select *, case when abs(span - low) <= abs(span - high) then low else high end as near from s)
select sample as "case", round(delta_units, 9) as delta_units, n_short, n_long, round(ln(n_long / n_short::double), 9) as log_ratio, round(ln(n_long / n_short::double) / delta_units, 9) as slope
 from (select sample, max(high - low) / 60.0::double as delta_units, count_if(near = low)::bigint as n_short, count_if(near = high)::bigint as n_long from n where abs(span - near) <= greatest(30, 0.012 * near) group by sample) where delta_units >= 1 and n_short > 0 and n_long > 0""")
def allele_balance(spark, sf):
    return P.allele_balance(_products(spark, sf)).select("case", F.round("delta_units", 9).alias("delta_units"), "n_short", "n_long", F.round("log_ratio", 9).alias("log_ratio"), F.round("slope", 9).alias("slope"))


def _products(spark, sf):
    """Every line is a product of its supplier's short or long allele, off by some bases."""
    low = F.col("case") % 7 * 60 + 900
    high = low + (F.col("case") % 11 + 1) * 60
    lines = table(spark, sf, "lineitem").withColumn("case", F.col("l_suppkey"))
    rows = lines.select("case", F.when(F.col("l_returnflag") == "R", "smear").otherwise("full").alias("kind"), (F.when(F.col("l_quantity") > 25, high).otherwise(low) + F.col("l_partkey") % 200 - 160).cast("long").alias("span"), F.lit(None).cast("boolean").alias("several_anchors"))
    cases = lines.select("case").distinct()
    sources = cases.select("case", F.explode(F.array(low, high)).alias("hi")).withColumn("lo", F.lit(0))
    return P.placed(rows, sources)


@R.add(f"""with r as (select o_orderkey as run, o_custkey as sample, o_orderstatus <> 'P' as validated, o_orderstatus = 'F' as callable, o_orderkey % 5 as kind, o_orderkey % 11 = 0 as broken from orders),
t as (select c_custkey as sample, n as t, {dna_sql("c_custkey + n * 5000")} as v from customer, range(0, 2) x(n) where c_custkey % 9 > 0),
c as (select run, sample, p, case when kind = 0 then {dna_sql("sample + (1 - p) * 5000")} when kind = 2 then {dna_sql("sample")} when kind = 3 and p = 1 then substr({dna_sql("sample + 5000")}, 1, 20) else {dna_sql("sample + p * 5000")} end as v, not (kind = 2 and p = 1) as own
 from r, range(0, 2) x(p) where kind < 4 and (kind <> 1 or p = 0)),
e as (select sample, list_sort(list(v)) as expected from t group by sample), f as (select run, list_sort(list(v)) as seen, bool_and(own) as alone from c group by run),
w as (select r.*, expected, seen, alone, case when expected is null then 'no independent sequence truth' when not validated then 'run lacks validated completed artifacts' when kind = 4 then 'missing sequence observations' when broken then 'boundary anchors must occur exactly once (unique exact match)' end as reason from r left join e using (sample) left join f using (run)),
plans as (select * from (values (0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)) x(alternative, t, p)),
s as (select c.run, alternative, sum(levenshtein(t.v, c.v)) as cost, count_if(t.v = c.v) as literal, count_if(t.v = c.v and own) as mine from plans join t on t.t = plans.t join c on c.p = plans.p and c.sample = t.sample group by all),
b as (select run, cost, count(*) as ways, min(literal) as literal, min(mine) as mine from s group by run, cost qualify row_number() over (partition by run order by cost) = 1)
select run, reason, case when reason is null then seen = expected and alone and callable end as sequence_equal, case when reason is null then seen = expected end as literal_sequence_equal, case when reason is null then cost::bigint end as distance, case when reason is null then ways end as ways,
 case when reason is null then literal::int end as literal_exact, case when reason is null then case when callable then mine::int else 0 end end as independent_exact from w left join b using (run)""")
def cohort_compared(spark, sf):
    """Every order is a run of its customer, whose two sequences most customers know."""
    # longer than a sequence, and no end of either begins it or the other: whatever the keys, a sequence between them can't make another
    left, right = "G" + "AATT" * 8, "C" + "AGTA" * 8
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("sample"), (F.col("o_orderstatus") != "P").alias("validated"), (F.col("o_orderstatus") == "F").alias("callable"))
    known = table(spark, sf, "customer").where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("sample"))
    truths = known.select("sample", F.posexplode(F.array(dna(F.col("sample")), dna(F.col("sample") + 5000))).alias("t", "seq")).withColumn("seq", F.concat(F.lit(left), "seq", F.lit(right)))
    kind = F.col("run") % 5
    two = F.array(dna(F.col("sample")), dna(F.col("sample") + 5000))
    made = F.when(kind == 0, F.reverse(two)).when(kind == 1, F.slice(two, 1, 1)).when(kind == 2, F.array(two[0], two[0])).when(kind == 3, F.array(two[0], F.left(two[1], F.lit(20))))
    end = F.when(F.col("run") % 11 == 0, "").otherwise(right)
    calls = o.select("run", kind.alias("kind"), end.alias("end"), F.posexplode(made).alias("p", "seq")).select("run", "p", F.concat(F.lit("TT" + left), "seq", "end").alias("seq"), (F.col("kind") != 2).alias("independent"), F.concat(F.lit("h"), "p").alias("origin"))
    out = C.compared(o, truths, known.select("sample", F.lit(left).alias("left"), F.lit(right).alias("right")), calls)
    return out.select("run", "reason", "sequence_equal", "literal_sequence_equal", "distance", "ways", "literal_exact", "independent_exact")


@R.add("""select p_partkey as "case", case when p_size % 7 = 0 then 'failed' else 'completed' end as status, case when p_size % 7 > 0 then (1000 // (p_size % 7) + p_partkey)::bigint end as value, case when p_size % 7 = 0 then 'ZeroDivisionError: integer division or modulo by zero' end as error,
 case when p_size % 2 = 0 then 1 else 2 end::int as round from part""")
def sweep_results(spark, sf):
    """The parts of even size first, then all of them into the same folder."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("case"), (F.col("p_size") % 7).cast("long").alias("n"), F.col("p_partkey").alias("base"), "p_size")
    folder = folder_of_its_own(spark, "sweep")
    for asked in (p.where("p_size % 2 = 0"), p):
        out = sweep(asked, folder, ["n", "base"], lambda x: {"value": 1000 // x["n"] + x["base"]}, "value long", version="1")
    return out.select("case", "status", "value", "error", "round")
