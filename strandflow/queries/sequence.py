"""Scalar functions on sequences and names of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionary
from ..functions import nomenclature as N
from ..functions import sequence as S
from ..operators.joins import each_once
from . import Registry, dna, dna_sql, table

R = Registry()
WORDS = dictionary.default()
D, D7 = dna_sql("doc_id"), dna_sql("doc_id + 7")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", dna("doc_id").alias("a"), dna(F.col("doc_id") + 7).alias("b"))


@R.add(f"select doc_id, reverse(translate({D}, 'ACGTN', 'TGCAN')) as rc from documents")
def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", S.reverse_complement("a").alias("rc"))


@R.add(f"select doc_id, levenshtein({D}, {D7})::int as distance from documents")
def edit_distance(spark, sf):
    return _docs(spark, sf).select("doc_id", F.levenshtein("a", "b").alias("distance"))


CIGAR = "concat(l_orderkey % 50 + 1, '=', l_linenumber, 'I', l_partkey % 9 + 1, 'X', l_suppkey % 4 + 1, 'D')"


@R.add(f"select l_orderkey, l_linenumber, list_sum(list_transform(regexp_extract_all({CIGAR}, '([0-9]+)[ID]', 1), lambda x: x::bigint))::bigint as indel_bp, len(regexp_extract_all({CIGAR}, '[0-9]+[A-Z=]'))::int as ops from lineitem")
def cigar_indel_bp(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("cigar", F.expr(CIGAR))
    return t.select("l_orderkey", "l_linenumber", S.cigar_indel_bp("cigar").alias("indel_bp"), F.size(S.cigar_ops("cigar")).alias("ops"))


def _templates_sql() -> str:
    rows = [(t.name, u, WORDS.units[u], t.kind, t.start, t.end, t.bases) for t in WORDS.templates for u in t.allowed]
    listed = ", ".join(f"({i}, '{n}', '{u}', '{s}', '{k}', {a}, {'null::int' if b is None else b}, '{x}')" for i, (n, u, s, k, a, b, x) in enumerate(rows))
    return f"part join (values {listed}) t(ord, name, unit, seq, kind, s, e, bases) on ord = p_partkey % {len(rows)}"


def _templates(spark, sf):
    """A template and one of its units for each part."""
    rows = [(t.name, u, WORDS.units[u], t.kind, t.start, t.end, t.bases) for t in WORDS.templates for u in t.allowed]
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, name string, unit string, seq string, kind string, s int, e int, bases string")
    return table(spark, sf, "part").select("p_partkey").join(F.broadcast(listed), F.col("p_partkey") % len(rows) == F.col("ord"))


APPLY = """case kind when 'insert' then substr(seq, 1, s - 1) || bases || substr(seq, s)
 when 'delete' then substr(seq, 1, s - 1) || substr(seq, e + 1) else substr(seq, 1, s) || bases || substr(seq, e) end"""
NET = "case kind when 'insert' then length(bases) when 'delete' then s - e - 1 else length(bases) - (e - s - 1) end"


@R.add(f"select p_partkey, name, unit, {APPLY} as mutated, ({NET})::int as net from {_templates_sql()}")
def apply_template(spark, sf):
    return _templates(spark, sf).select("p_partkey", "name", "unit", S.apply_change("seq", "kind", "s", "e", "bases").alias("mutated"), S.net_change("kind", "s", "e", "bases").alias("net"))


@R.add(f"""with c as (select doc_id, i, substr(d, i, 1) as b, d from (select doc_id, {D} as d from documents), range(1, 33) r(i)),
m as (select *, case when b = lag(b) over (partition by doc_id order by i) then 0 else 1 end as new from c),
g as (select *, sum(new) over (partition by doc_id order by i) as k from m)
select doc_id, (min(i) - 1)::int as start, max(i)::int as "end", any_value(b) as base from g group by doc_id, k having count(*) >= 3""")
def homopolymer_runs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(S.runs("a", 3)).alias("r")).select("doc_id", "r.start", "r.end", "r.base")


@R.add(f"""select doc_id, hamming({D}, {D7})::int as hamming, levenshtein({D}, {D7}) = hamming({D}, {D7}) as substitutions_only from documents""")
def hamming_vs_edit(spark, sf):
    return _docs(spark, sf).select("doc_id", S.hamming("a", "b").alias("hamming"), S.substitutions_only("a", "b").alias("substitutions_only"))


INS = dna_sql("l_partkey")


@R.add(f"select l_orderkey, l_linenumber, regexp_replace(regexp_replace(substr({INS}, 1, 6), '^A+', ''), 'C+$', '') as stripped from lineitem")
def boundary_insertion(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", S.boundary_insert(F.substring(dna("l_partkey"), 1, 6), F.lit("A"), F.lit("C")).alias("stripped"))


@R.add("select doc_id, round((select avg(ascii(c) - 33) from (select unnest(string_split(md5(doc_id::varchar), '')) as c)), 6) as mean_q from documents")
def mean_quality(spark, sf):
    t = table(spark, sf, "documents")
    return t.select("doc_id", F.round(S.mean_quality(F.md5(F.col("doc_id").cast("string").cast("binary"))), 6).alias("mean_q"))


HEAD = "".join(WORDS.units[u] for u in "12345")
TAIL = "".join(WORDS.units[u] for u in "6789")


@R.add(f"select p_partkey, n::int as units, length(c)::int as bp, md5(c) as digest from (select p_partkey, p_partkey % 150 + 1 as n, '{WORDS.left[-30:]}{HEAD}' || repeat('{WORDS.units['X']}', (p_partkey % 150 + 1)::int) || '{TAIL}{WORDS.right[:30]}' as c from part)")
def reference_ladder(spark, sf):
    n = (F.col("p_partkey") % 150 + 1).cast("int")
    c = table(spark, sf, "part").select("p_partkey", n.alias("units"), S.contig(n, WORDS, 30).alias("c"))
    return c.select("p_partkey", "units", F.length("c").alias("bp"), F.md5(F.col("c").cast("binary")).alias("digest"))


@R.add(f"""with s as (select doc_id, {D} || 'ACGTTGCA' || {D7} as seq from documents)
select doc_id, case when p > 0 then p + greatest(30 - 5, 1) - 1 end::int as anchor_at from (select doc_id, instr(substr(seq, 25, 18), 'ACGTTGCA') as p from s)""")
def find_anchor(spark, sf):
    t = _docs(spark, sf).withColumn("seq", F.concat("a", F.lit("ACGTTGCA"), "b"))
    return t.select("doc_id", S.find_anchor("seq", F.lit("ACGTTGCA"), F.lit(30), 5).cast("int").alias("anchor_at"))


@R.add(f"""with s as (select doc_id, {D} as seq from documents), p as (select doc_id, seq, instr(seq, 'AC') as a, instr(seq, 'GG') as b from s),
q as (select *, instr(substr(seq, a + 1), 'AC') as a2, instr(substr(seq, b + 1), 'GG') as b2 from p)
select doc_id, case when a > 0 and a2 = 0 and b > 0 and b2 = 0 and b >= a + 2 then substr(seq, a + 2, b - a - 2) end as cropped, regexp_matches(seq, '^[ACGT]+$') as dna from q""")
def crop_anchors(spark, sf):
    return _docs(spark, sf).select("doc_id", S.crop("a", F.lit("AC"), F.lit("GG")).alias("cropped"), S.is_dna("a").alias("dna"))


AD = "concat(l_quantity::int, ',', l_partkey % 60, ',', l_suppkey % 40)"


@R.add(f"""with d as (select l_orderkey, l_linenumber, l_quantity::int as r, l_partkey % 60 as a, l_suppkey % 40 as b from lineitem)
select l_orderkey, l_linenumber, case when r + a + b > 0 and greatest(a, b) / (r + a + b)::double >= 0.5 then case when a >= b then '1/1' else '2/2' end
 when r + a + b > 0 and greatest(a, b) / (r + a + b)::double < 0.2 then '0/0' end as gt from d""")
def haploid_genotype(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("ad", F.concat_ws(",", F.col("l_quantity").cast("int"), F.col("l_partkey") % 60, F.col("l_suppkey") % 40))
    return t.select("l_orderkey", "l_linenumber", S.haploid_genotype("ad").alias("gt"))


@R.add(f"select doc_id, (length(r) - length(a)) % 3 <> 0 as frameshift from (select doc_id, substr({D}, 1, doc_id % 7 + 1) as r, substr({D7}, 1, doc_id % 5 + 1) as a from documents)")
def is_frameshift(spark, sf):
    t = _docs(spark, sf).selectExpr("doc_id", "substr(a, 1, cast(doc_id % 7 + 1 as int)) as r", "substr(b, 1, cast(doc_id % 5 + 1 as int)) as t")
    return t.select("doc_id", S.is_frameshift("r", "t").alias("frameshift"))


MERGE = "case doc_id % 5 when 0 then '0/1' when 1 then '1|1' when 2 then '0|0' when 3 then '1/2' else '1/3' end"


@R.add(f"""with v as (select doc_id, substr({D}, 1, 1) as r, substr({D7}, 1, (doc_id % 2 + 1)::int) as a, substr({D}, 5, 1) as b, {MERGE} as gt from documents),
p as (select *, case gt when '0/1' then r when '1|1' then a when '0|0' then r when '1/2' then a end as x, case gt when '0/1' then a when '1|1' then a when '0|0' then r when '1/2' then b end as y from v)
select doc_id, x as hap1, case when x = y then x when length(x) = 1 and length(y) = 1 then
 case least(x, y) || greatest(x, y) when 'AG' then 'R' when 'CT' then 'Y' when 'CG' then 'S' when 'AT' then 'W' when 'GT' then 'K' when 'AC' then 'M' end
 when (x <> r)::int + (y <> r)::int = 1 and length(case when x <> r then x else y end) <> 1 then case when x <> r then x else y end end as merged from p""")
def merged_allele(spark, sf):
    t = _docs(spark, sf).selectExpr("doc_id", "substr(a, 1, 1) as r", "concat(substr(b, 1, cast(doc_id % 2 + 1 as int)), ',', substr(a, 5, 1)) as t", f"{MERGE} as gt")
    return t.select("doc_id", S.selected_allele("r", "t", "gt", 1).alias("hap1"), S.selected_allele("r", "t", "gt", None).alias("merged"))


UNITS_SQL = "(values " + ", ".join(f"('{u}', {i}, '{s}', '{WORDS.role(u)}')" for i, (u, s) in enumerate(WORDS.units.items())) + ") u(id, ord, seq, class)"


@R.add(f"select doc_id, case when doc_id % 3 = 0 then id || ':dupC' else id end as id, case when doc_id % 3 = 0 then 'mutation' else class end as unit_class from documents join {UNITS_SQL} on ord = doc_id % 34")
def unit_class(spark, sf):
    u = F.broadcast(WORDS.tables(spark)["units"].select("ord", "id"))
    d = table(spark, sf, "documents").select("doc_id").join(u, F.col("ord") == F.col("doc_id") % 34)
    d = d.withColumn("id", F.when(F.col("doc_id") % 3 == 0, F.concat("id", F.lit(":dupC"))).otherwise(F.col("id")))
    return d.select("doc_id", "id", S.unit_category("id", WORDS).alias("unit_class"))


REASON = "concat('Allele_', l_linenumber, ': depth ', l_partkey, '.5 is below x', l_suppkey, '  for (dup at repeat ', l_orderkey, ') is inconclusive (few reads (', l_partkey, ' seen); None given.)')"


@R.add(f"""with k as (select l_orderkey, l_linenumber, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({REASON}, '\\s+', ' ', 'g'), '^Allele_[0-9]+: ', ''),
 '\\([^()]* at repeat [^()]*\\)', '(<variant>)'), '([ (])[0-9]+(\\.[0-9]+)? ', '\\1# ', 'g'), 'None', '#')) as key from lineitem)
select l_orderkey, l_linenumber, unnest(['depth # is below x' || split_part(split_part(key, ' is below x', 2), ' ', 1) || ' for (<variant>) is inconclusive: few reads (# seen)',
 'depth # is below x' || split_part(split_part(key, ' is below x', 2), ' ', 1) || ' for (<variant>) is inconclusive: # given.']) as key from k""")
def reason_key(spark, sf):
    return table(spark, sf, "lineitem").withColumn("r", F.expr(REASON)).select("l_orderkey", "l_linenumber", F.explode(S.reason_keys("r")).alias("key"))


@R.add("select c_custkey, (('0x' || substr(sha256('salt|' || c_custkey || '|reads'), 1, 16))::ubigint // 2)::bigint as seed from customer")
def derive_seed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.derive_seed("salt", F.col("c_custkey"), "reads").alias("seed"))


@R.add("select l_orderkey, l_linenumber, round(30 + 0.6 * l_quantity, 6) as half_width, case when l_quantity < 40 then '<40' when l_quantity < 60 then '<60' when l_quantity < 80 then '<80' when l_quantity < 120 then '<120' else '>=120' end as size_class from lineitem")
def length_window(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.window_half_width(F.col("l_quantity") * 60), 6).alias("half_width"), S.size_class("l_quantity").alias("size_class"))


@R.add("select l_orderkey, l_linenumber, round(case when l_quantity < 5 then 0.3 when l_quantity < 20 then 0.5 + 0.5 * (l_quantity - 5) / 15 else 1.0 end, 6) as weight from lineitem")
def qual_weight(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.quality_weight("l_quantity"), 6).alias("weight"))


@R.add("select o_orderkey, (o_orderkey % 97)::int as seed from orders")
def option_integer(spark, sf):
    t = table(spark, sf, "orders").withColumn("c", F.concat(F.lit("sim --out x --seed "), F.col("o_orderkey") % 97, F.lit(" --n 3")))
    return t.select("o_orderkey", S.option_integer("c", "--seed").alias("seed"))


@R.add(f"""with s as (select doc_id, {D} as seq from documents), p as (select doc_id, seq, instr(seq, 'ACG') as a, instr(seq, 'TTA') as b from s),
q as (select *, instr(substr(seq, a + 1), 'ACG') as a2, instr(substr(seq, b + 1), 'TTA') as b2 from p)
select doc_id, case when ok then a - 1 end::int as start, case when ok then b + 2 end::int as "end" from (select *, a > 0 and a2 = 0 and b > 0 and b2 = 0 and b >= a as ok from q)""")
def amplicon_interval(spark, sf):
    t = _docs(spark, sf).select("doc_id", S.amplicon("a", "ACG", "TAA").alias("x"))
    return t.select("doc_id", F.col("x.start").cast("int").alias("start"), F.col("x.end").cast("int").alias("end"))


# Edits for the nomenclature queries: every start in a unit, with a short insertion, deletion or both.
EDITS = f"""(select p_partkey as id, unit, s, case k when 0 then s - 1 when 1 then s + ord % 3 else s + ord % 2 end::int as e,
 case k when 0 then substr('CCGA', s % 3 + 1, s % 2 + 1) when 1 then '' else substr('ATCG', s % 3 + 1, 2) end as ins, k::int as k
 from (select p_partkey, u.seq as unit, u.ord, (p_partkey // 34 % 55 + 1)::int as s from part join {UNITS_SQL} on u.ord = p_partkey % 34), range(0, 3) q(k))"""
# The walk, base by base, as recursive SQL: independent of the closed forms.
WALK = f"""with recursive edits as {EDITS},
trimmed(id, k, s0, unit, s, d, i, side) as (
 select id, k, s, unit, s, substr(unit, s, greatest(e - s + 1, 0)), ins, 0 from edits
 union all
 select id, k, s0, unit, case when side = 0 and d <> '' and i <> '' and left(d, 1) = left(i, 1) then s + 1 else s end,
  case when side = 0 and d <> '' and i <> '' and left(d, 1) = left(i, 1) then substr(d, 2) when side = 0 then d when right(d, 1) = right(i, 1) then left(d, length(d) - 1) else d end,
  case when side = 0 and d <> '' and i <> '' and left(d, 1) = left(i, 1) then substr(i, 2) when side = 0 then i when right(d, 1) = right(i, 1) then left(i, length(i) - 1) else i end,
  case when side = 0 and d <> '' and i <> '' and left(d, 1) = left(i, 1) then 0 when side = 0 then 1 when right(d, 1) = right(i, 1) then 1 else 2 end
 from trimmed where side = 0 or side = 1 and d <> '' and i <> ''
), least_ as (
 select id, k, s0, unit, s, d, i from trimmed qualify row_number() over (partition by id, k, s0 order by length(d) + length(i), s desc) = 1
), moved(id, k, s0, unit, s, d, i) as (
 select * from least_
 union all
 select id, k, s0, unit, s + 1, case when d = '' then '' else substr(unit, s + 1, length(d)) end, case when i = '' then '' else substr(i, 2) || left(i, 1) end
 from moved where (d = '') <> (i = '') and s + length(d) <= length(unit) and substr(unit, s + length(d), 1) = left(d || i, 1)
), last_ as (select * from moved qualify row_number() over (partition by id, k, s0 order by s desc) = 1)
"""


#: What an edit is made of.
EDIT = ["unit", "s", "e", "ins"]


def _edits(spark, sf):
    """Three edits of a unit for each part."""
    u = F.broadcast(WORDS.tables(spark)["units"].select("ord", F.col("seq").alias("unit")))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("cast(p_partkey div 34 % 55 + 1 as int)").alias("s"))
    e = e.join(u, F.col("id") % 34 == F.col("ord")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return e.selectExpr("id", "unit", "s", "case k when 0 then s - 1 when 1 then s + ord % 3 else s + ord % 2 end as e",
                        "case k when 0 then substr('CCGA', s % 3 + 1, s % 2 + 1) when 1 then '' else substr('ATCG', s % 3 + 1, 2) end as ins", "k")


@R.add(WALK + """select id, k, s0 as s, case
 when k = 0 or d = '' then case when s - 1 >= length(i) and substr(unit, s - length(i), length(i)) = i then case when length(i) = 1 then (s - 1) || 'dup' || i else (s - length(i)) || '_' || (s - 1) || 'dup' || i end
  else (s - 1) || '_' || s || 'ins' || i end
 when i = '' then case when length(d) = 1 then s || 'del' || d else s || '_' || (s + length(d) - 1) || 'del' || d end
 when length(d) = 1 and length(i) = 1 then s || d || '>' || i
 else case when length(d) = 1 then s || '' else s || '_' || (s + length(d) - 1) end || 'delins' || i end as name from last_""")
def name_edit(spark, sf):
    return each_once(_edits(spark, sf), EDIT, {"name": N.name_edit("unit", "s", "e", "ins")["name"]}).select("id", "k", "s", "name")


@R.add(WALK + """, back(id, k, s0, unit, s, d, i) as (
 select * from least_ union all
 select id, k, s0, unit, s - 1, case when d = '' then '' else substr(unit, s - 1, length(d)) end, case when i = '' then '' else right(i, 1) || left(i, length(i) - 1) end
 from back where (d = '') <> (i = '') and s > 1 and substr(unit, s - 1, 1) = right(d || i, 1)
), first_ as (select * from back qualify row_number() over (partition by id, k, s0 order by s) = 1)
select a.id, a.k, a.s0 as s, case when ok then low end::int as low, case when ok then high end::int as high from (
 select l.id, l.k, l.s0, f.s as low, case when l.i <> '' then l.s - 1 else l.s + length(l.d) - 1 end as high,
  ((l.d = '') or (l.i = '')) and case when l.i <> '' then l.s - 1 else l.s + length(l.d) - 1 end > f.s as ok
 from last_ l join first_ f using (id, k, s0)) a""")
def ambiguity_interval(spark, sf):
    t = each_once(_edits(spark, sf), EDIT, {"x": N.ambiguity("unit", "s", "e", "ins")})
    return t.select("id", "k", "s", "x.low", "x.high")


@R.add(WALK + """select id, k, s0 as s, s::int as start, (s + length(d) - 1)::int as "end", i as inserted from last_""")
def normalise_edit(spark, sf):
    t = each_once(_edits(spark, sf), EDIT, {"x": N.normalise("unit", "s", "e", "ins")})
    return t.select("id", "k", "s", "x.start", "x.end", "x.inserted")


PLACE = f"(select p_partkey as id, u.seq as unit, (p_partkey // 34 % 60 + 1)::int as s from part join {UNITS_SQL} on u.ord = p_partkey % 34)"


def _places(spark, sf):
    """A unit and a place in it for each part."""
    u = F.broadcast(WORDS.tables(spark)["units"].select("ord", "seq"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("cast(p_partkey div 34 % 60 + 1 as int)").alias("s")).join(u, F.col("id") % 34 == F.col("ord"))


@R.add(f"""select id, s, (case when s > 1 and b = substr(unit, s - 1, 1) and f is not null then f end) as form from (
 select id, s, unit, b, case when bw + aw >= 2 then (s - 1 - bw + 1) || b || '[' || (bw + aw) || ']>' || (s - 1 - bw + 1) || b || '[' || (bw + aw + 1) || ']' end as f from (
  select id, s, unit, 'C' as b, length(left(unit, s - 1)) - length(rtrim(left(unit, s - 1), 'C')) as bw,
   length(substr(unit, s)) - length(ltrim(substr(unit, s), 'C')) as aw from {PLACE}))""")
def repeat_form(spark, sf):
    return each_once(_places(spark, sf), ["seq", "s"], {"form": N.repeat_form("seq", "s", F.col("s") - 1, F.lit("C"))}).select("id", "s", "form")


KNOWN_SQL = ", ".join(f"'{x}'" for x in N.KNOWN)


@R.add(f"""with v as (select l_orderkey, l_linenumber, case l_partkey % 3 when 0 then '59dupC' when 1 then '58_59insG' else '10delA' end as name, l_quantity::int as reads from lineitem)
select l_orderkey, l_linenumber, case when name in ({KNOWN_SQL}) and reads >= 5 then 'A' when reads >= 3 then 'B' else 'C' end as tier, 'repeat_' || l_linenumber || ':c.' || name as place from v""")
def variant_tier(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case l_partkey % 3 when 0 then '59dupC' when 1 then '58_59insG' else '10delA' end as name", "cast(l_quantity as int) as reads")
    return t.select("l_orderkey", "l_linenumber", N.tier("name", "reads", F.lit(1)).alias("tier"), N.repeat_relative("l_linenumber", "name").alias("place"))
