"""Statuses of attempts, rebuilt truths, verified records, p-values of ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as T
from ..operators.aggregates import rank_sum
from ..sources import results as S
from . import Registry, dna, dna_sql, table
from .decision import WORDS

R = Registry()
RUNS = """select o_orderkey as id, case o_custkey % 4 when 0 then 'timeout' when 1 then 'not_attempted' when 2 then 'completed' end as recorded, case when o_orderkey % 5 < 4 then o_orderkey % 5 end as exit_code,
 case o_custkey % 7 when 0 then 'running' when 1 then 'completed' when 2 then 'insufficient_evidence' when 3 then 'interrupted' when 4 then 'what' end as sidecar,
 case o_orderkey % 3 when 0 then 'valid' when 1 then 'invalid' end as summary, o_custkey % 3 as predictions, o_custkey % 5 = 0 as unsettled from orders"""


@R.add(f"""with r as (select *, coalesce(exit_code <> 0, false) or coalesce(recorded = 'timeout', false) as failed from ({RUNS}))
select id, case when sidecar = 'what' then case when failed then 'execution_failed' else 'invalid_artifacts' end
 when sidecar is not null and (coalesce(recorded = 'timeout', false) or coalesce(exit_code not in (0, 1), false)) then 'execution_failed'
 when sidecar in ('insufficient_evidence', 'interrupted') then sidecar when failed then 'execution_failed' when sidecar = 'running' then 'invalid_artifacts'
 when recorded = 'not_attempted' then 'not_attempted' when summary is null then case when exit_code = 0 then 'invalid_artifacts' else 'not_attempted' end
 when summary <> 'valid' then 'invalid_artifacts' when unsettled then 'ambiguous_reconstruction' when predictions > 0 then 'completed' else 'insufficient_evidence' end as observed from r""")
def observation_status(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_results_orders")
    return S.observation_status(spark.sql(RUNS.replace("from orders", "from _results_orders"))).select("id", "observed")


@R.add("""select l_orderkey, l_linenumber, (l_suppkey % 3 = 0 or l_suppkey % 4 < 2) and l_partkey % 7 > 0 as settled from lineitem""")
def settled_alleles(spark, sf):
    t = table(spark, sf, "lineitem").withColumns({"phase_status": F.when(F.col("l_suppkey") % 4 < 2, "phased").otherwise("unknown"), "sequence": F.when(F.col("l_partkey") % 7 > 0, "ACGT").otherwise("ACNT")})
    return t.select("l_orderkey", "l_linenumber", S.settled({"phase_status": F.col("l_suppkey") % 3 > 0}).alias("settled"))


@R.add("select doc_id as sample, 1 as hap, doc_id % 5 > 0 and doc_id % 7 > 0 as valid from documents")
def rebuilt_truth(spark, sf):
    units = WORDS.tables(spark)["units"]
    names = F.array(*[F.lit(u) for u in WORDS.units])
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample"), F.lit(1).alias("hap"))
    unit = F.get(names, F.pmod(F.col("sample") * 3 + F.col("pos") * 5, F.lit(len(WORDS.units))).cast("int"))
    chains = d.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("unit", F.when((F.col("sample") % 7 == 0) & (F.col("pos") == 3), "nowhere").otherwise(unit))
    seqs = F.array(*[F.lit(s) for s in WORDS.units.values()])
    parts = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.get(seqs, F.pmod(F.col("sample") * 3 + k * 5, F.lit(len(WORDS.units))).cast("int")))
    seq = F.concat(F.lit("AA"), F.array_join(parts, ""), F.when(F.col("sample") % 5 > 0, "CC").otherwise("CG"))
    return S.checked_truth(chains, d.withColumn("seq", seq), units, "AA", "CC")


@R.add(f"""with d as (select doc_id, {dna_sql('doc_id')} as dna, case when doc_id % 2 = 0 then '+' else '-' end as strand from documents)
select doc_id, strand, case when strand = '+' then dna else reverse(translate(dna, 'ACGT', 'TGCA')) end as sequence, strand = '+' and doc_id % 3 > 0 as verified from d""")
def hydrated_truth(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", dna("doc_id").alias("dna"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    # the digest is that of the forward strand, and of some the length is wrong
    return S.hydrated(d.withColumns({"sha256": F.sha2("dna", 256), "length": F.when(F.col("doc_id") % 3 > 0, 32).otherwise(31)})).select("doc_id", "strand", "sequence", "verified")


@R.add("""with r as (select l_suppkey as g, l_returnflag = 'R' as x, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as rk, count(*) over (partition by l_suppkey, l_quantity) as t from lineitem),
s as (select g, sum(rk) filter (x) - count(*) filter (x) * (count(*) filter (x) + 1) / 2 as u, count(*) filter (x) as a, count(*) filter (not x) as b, sum(t * t - 1)::double as ties from r group by g),
z as (select g, (u - a * b / 2 + 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) as z from s)
select g, round(0.5 + z / 2000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2000), lambda i: exp(-pow((i + 0.5) * z / 2000, 2) / 2))), 6) as p from z""")
def rank_sum_p(spark, sf):
    r = rank_sum(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_returnflag") == "R").alias("x"), "l_quantity"), ["g"], "x", "l_quantity")
    return r.select("g", F.round(T.normal_below("z"), 6).alias("p"))
