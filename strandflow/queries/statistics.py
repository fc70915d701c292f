"""Exact tests, intervals and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as T
from ..operators.aggregates import rank_sum
from ..operators.evaluate import holm_adjusted, interval
from . import Registry, table

R = Registry()
TAIL = "(select coalesce(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))), 0) from (select unnest(range({a}, {b})) as j))"
RATES = "(select l_suppkey as g, count_if(l_returnflag = 'R')::bigint as k, count(*)::bigint as n from lineitem group by 1)"


def _rates(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))


@R.add(f"""with recursive r as {RATES}, lo(g, k, n, a, b, i) as (select g, k, n, 0.0::double, 1.0::double, 0 from r union all select g, k, n, case when {TAIL.format(p='((a + b) / 2)', a='k', b='n + 1')} < 0.025 then (a + b) / 2 else a end, case when {TAIL.format(p='((a + b) / 2)', a='k', b='n + 1')} < 0.025 then b else (a + b) / 2 end, i + 1 from lo where i < 40),
hi(g, k, n, a, b, i) as (select g, k, n, 0.0::double, 1.0::double, 0 from r union all select g, k, n, case when {TAIL.format(p='((a + b) / 2)', a='0', b='k + 1')} > 0.025 then (a + b) / 2 else a end, case when {TAIL.format(p='((a + b) / 2)', a='0', b='k + 1')} > 0.025 then b else (a + b) / 2 end, i + 1 from hi where i < 40)
select l.g, l.k, l.n, round(case when l.k = 0 then 0 else (l.a + l.b) / 2 end, 6) as low, round(case when l.k = l.n then 1 else (h.a + h.b) / 2 end, 6) as high from lo l join hi h on l.g = h.g where l.i = 40 and h.i = 40""")
def clopper_pearson(spark, sf):
    return interval(_rates(spark, sf)).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@R.add("""with t as (select l_suppkey as g, count_if(l_returnflag = 'R' and l_linestatus <> 'O') as b, count_if(l_returnflag <> 'R' and l_linestatus = 'O') as c from lineitem group by 1)
select g, b::bigint as b, c::bigint as c, round(least(1, (select sum(exp(lgamma(b + c + 1) - lgamma(j + 1) - lgamma(b + c - j + 1) + (b + c) * ln(0.5))) from (select unnest(range(0, (b + c + 1)::bigint)) as j) where lgamma(b + c + 1) - lgamma(j + 1) - lgamma(b + c - j + 1) <= lgamma(b + c + 1) - lgamma(b + 1) - lgamma(c + 1) + 1e-9)), 6) as p from t where b + c > 0""")
def mcnemar(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.expr("count_if(l_returnflag = 'R' and l_linestatus <> 'O')").alias("b"), F.expr("count_if(l_returnflag <> 'R' and l_linestatus = 'O')").alias("c"))
    return t.where("b + c > 0").withColumn("p", F.round(T.mcnemar_exact("b", "c"), 6))


@R.add("""with p as (select o_orderpriority as f, o_orderstatus as m, (count(*) % 97 + 1) / 1000.0::double as p from orders group by 1, 2), o as (select *, row_number() over (partition by f order by p, m) as i, count(*) over (partition by f) as n from p)
select f, m, round(p, 6) as p, round(least(1, max((n - i + 1) * p) over (partition by f order by i rows unbounded preceding)), 6) as adjusted from o""")
def holm(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("f"), F.col("o_orderstatus").alias("m")).agg(((F.count("*") % 97 + 1) / 1000.0).alias("p"))
    return holm_adjusted(p, ["f"], "p", "m").withColumn("p", F.round("p", 6)).withColumn("adjusted", F.round("adjusted", 6))


Z = "1.6448536269514715"


@R.add(f"""with r as (select a.g, a.k::double as x1, a.n::double as n1, b.k::double as x0, b.n::double as n0 from {RATES} a join {RATES} b on b.g = a.g % 5 + 1),
w as (select *, x1 / n1 as p1, x0 / n0 as p0, (x1 / n1 + {Z}*{Z} / n1 / 2) / (1 + {Z}*{Z} / n1) + {Z} * sqrt(x1 / n1 * (1 - x1 / n1) / n1 + {Z}*{Z} / n1 / (4 * n1)) / (1 + {Z}*{Z} / n1) as u1,
 (x0 / n0 + {Z}*{Z} / n0 / 2) / (1 + {Z}*{Z} / n0) - {Z} * sqrt(x0 / n0 * (1 - x0 / n0) / n0 + {Z}*{Z} / n0 / (4 * n0)) / (1 + {Z}*{Z} / n0) as l0 from r)
select g, round(p1 - p0, 6) as difference, round(p1 - p0 + sqrt(pow(u1 - p1, 2) + pow(p0 - l0, 2)), 6) as upper, p1 - p0 + sqrt(pow(u1 - p1, 2) + pow(p0 - l0, 2)) < 0.05 as noninferior from w""")
def newcombe(spark, sf):
    r = _rates(spark, sf)
    ref = r.select(F.col("g").alias("h"), F.col("k").alias("k0"), F.col("n").alias("n0"))
    t = r.join(ref, F.col("h") == F.col("g") % 5 + 1).withColumn("x", T.newcombe("k", "n", "k0", "n0", 0.05))
    return t.select("g", F.round("x.difference", 6).alias("difference"), F.round("x.upper", 6).alias("upper"), "x.noninferior")


@R.add(f"select g, k, n, round(least(1, {TAIL.format(p='0.3', a='k', b='n + 1')}), 6) as upper, round(least(1, {TAIL.format(p='0.3', a='0', b='k + 1')}), 6) as lower from {RATES}")
def binom_sf(spark, sf):
    return _rates(spark, sf).select("g", "k", "n", F.round(T.binomial_upper_tail("k", "n", F.lit(0.3)), 6).alias("upper"), F.round(T.binomial_lower_tail("k", "n", F.lit(0.3)), 6).alias("lower"))


@R.add("""with t as (select l_suppkey as g, count_if(l_returnflag = 'R' and l_linestatus = 'O') as a, count_if(l_returnflag = 'R') as r, count_if(l_linestatus = 'O') as c, count(*) as n from lineitem group by 1)
select g, round(least(1, (select sum(exp(lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + lgamma(n - c + 1) - lgamma(r - j + 1) - lgamma(n - c - r + j + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1))) from (select unnest(range(greatest(0, r + c - n)::bigint, a::bigint + 1)) as j))), 6) as p from t""")
def fisher_tail(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.expr("count_if(l_returnflag = 'R' and l_linestatus = 'O')").alias("a"), F.expr("count_if(l_returnflag = 'R')").alias("r"), F.expr("count_if(l_linestatus = 'O')").alias("c"), F.count("*").alias("n"))
    return t.select("g", F.round(T.fisher_lower("a", "r", "c", "n"), 6).alias("p"))


@R.add("""with r as (select l_suppkey as g, l_returnflag = 'R' as x, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as rk, count(*) over (partition by l_suppkey, l_quantity) as t from lineitem),
s as (select g, sum(rk) filter (x) - count(*) filter (x) * (count(*) filter (x) + 1) / 2 as u, count(*) filter (x) as a, count(*) filter (not x) as b, sum(t * t - 1)::double as ties from r group by g)
select g, round(u, 3) as u, round((u - a * b / 2 + 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 6) as z from s""")
def rank_sum_z(spark, sf):
    return rank_sum(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_returnflag") == "R").alias("x"), "l_quantity"), ["g"], "x", "l_quantity").select("g", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@R.add("""with t as (select l_suppkey as g, count_if(l_returnflag = 'R' and l_linestatus = 'O')::double as a, count_if(l_returnflag = 'R' and l_linestatus <> 'O')::double as b, count_if(l_returnflag <> 'R' and l_linestatus = 'O')::double as c, count_if(l_returnflag <> 'R' and l_linestatus <> 'O')::double as d from lineitem group by 1)
select g, round(coalesce((a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0), 0), 6) as phi from t""")
def phi_linkage(spark, sf):
    x, y = "l_returnflag = 'R'", "l_linestatus = 'O'"
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(*[F.expr(f"count_if({p} and {q})").alias(n) for n, p, q in (("a", x, y), ("b", x, f"not {y}"), ("c", f"not {x}", y), ("d", f"not {x}", f"not {y}"))])
    return t.select("g", F.round(T.phi("a", "b", "c", "d"), 6).alias("phi"))


@R.add("""with h as (select event_type as s, least(floor(value / 10), 16)::int as l, count(*) as n from events group by all),
q as (select x.s, i::int as length, coalesce((select n from h where h.s = x.s and h.l = i), 0) + 0.5 as c from (select distinct s from h) x, range(0, 17) r(i)), z as (select s, length, c / sum(c) over (partition by s) as p from q),
w as (select a.s, a.length, a.p, b.p as q from z a join z b on b.s = a.s and b.length = greatest(a.length - 2, 0))
select s, length, round(p, 6) as p, round(q / sum(q) over (partition by s), 6) as shifted from w""")
def shift_profile(spark, sf):
    h = table(spark, sf, "events").groupBy(F.col("event_type").alias("s"), F.least(F.floor(F.col("value") / 10), F.lit(16)).cast("int").alias("l")).agg(F.count("*").alias("n"))
    m = h.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m")).withColumn("p", T.smoothed(F.col("m")))
    m = m.withColumn("q", T.shifted(F.col("p"), 2))
    return m.select("s", F.posexplode(F.arrays_zip("p", "q")).alias("length", "x")).select("s", "length", F.round("x.p", 6).alias("p"), F.round("x.q", 6).alias("shifted"))


@R.add("""with h as (select lang, least(floor(n_chars / 200), 20)::int as b, count(*) as n from documents group by all), p as (select lang, b, n / sum(n) over (partition by lang) as p from h),
k as (select a.lang as x, c.lang as y, b from (select distinct lang from h) a, (select distinct lang from h) c, (select distinct b from h) where a.lang < c.lang),
j as (select k.x, k.y, coalesce(p.p, 0) as p, coalesce(q.p, 0) as q from k left join p on p.lang = k.x and p.b = k.b left join p q on q.lang = k.y and q.b = k.b)
select x, y, round(sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)), 6) as distance from j group by x, y""")
def js_distance(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.least(F.floor(F.col("n_chars") / 200), F.lit(20)).alias("b"))
    return jensen_shannon(d, "lang", "b").withColumn("distance", F.round("distance", 6))


def jensen_shannon(rows, group, bin_):
    """Distance (base 2) of every two groups' histograms; groups are few, bins are joined by equality."""
    from pyspark.sql.window import Window as W

    n = rows.groupBy(group, bin_).agg(F.count("*").alias("n"))
    p = n.select(F.col(group).alias("g"), F.col(bin_).alias("b"), (F.col("n") / F.sum("n").over(W.partitionBy(group))).alias("p"))
    # a bin that one of a pair lacks gives p / 2 x log2(2): so shared bins and the shared mass are enough
    both = p.alias("a").join(p.alias("c"), F.expr("a.b = c.b and a.g < c.g"))
    mid = (F.col("a.p") + F.col("c.p")) / 2
    part = F.col("a.p") * F.log2(F.col("a.p") / mid) + F.col("c.p") * F.log2(F.col("c.p") / mid)
    s = both.groupBy(F.col("a.g").alias("x"), F.col("c.g").alias("y")).agg(F.sum(part).alias("s"), F.sum(F.col("a.p") + F.col("c.p")).alias("m"))
    names = p.select("g").distinct()
    pairs = names.alias("a").join(names.alias("c"), F.expr("a.g < c.g")).select(F.col("a.g").alias("x"), F.col("c.g").alias("y"))
    out = pairs.join(s, ["x", "y"], "left").fillna(0.0, ["s", "m"])
    return out.select("x", "y", F.sqrt(F.greatest(F.lit(0.0), (F.col("s") + 2 - F.col("m")) / 2)).alias("distance"))


@R.add("select l_orderkey, l_linenumber, round(greatest(0.05, least(0.5, 1 / (1 + exp(0.8 * (l_partkey % 5000 - l_quantity * 60) / 1000)))), 6) as share from lineitem")
def pcr_share(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.pcr_share(F.col("l_quantity") * 60, F.col("l_partkey") % 5000, 0.8), 6).alias("share"))


@R.add("""with h as (select l_returnflag as s, l_linenumber as l, count(*) as n from lineitem group by all), p as (select s, l, (n + 0.5) / (sum(n) over (partition by s) + 3.5) as p from h),
o as (select l_suppkey as g, l_returnflag as s, l_linenumber as l from lineitem)
select g, round(sum(ln(p.p / q.p)), 4) as llr from o join p using (s, l) join p q on q.s = o.s and q.l = 8 - o.l group by g""")
def llr_profile(spark, sf):
    from pyspark.sql.window import Window as W

    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("s"), F.col("l_linenumber").alias("l"))
    n = t.groupBy("s", "l").agg(F.count("*").alias("n"))
    p = n.select("s", "l", ((F.col("n") + 0.5) / (F.sum("n").over(W.partitionBy("s")) + 3.5)).alias("p"))
    q = p.select("s", (8 - F.col("l")).alias("l"), F.col("p").alias("q"))
    return log_likelihood_ratio(t, p.join(q, ["s", "l"]), ["g"], ["s", "l"]).withColumn("llr", F.round("llr", 4))


def log_likelihood_ratio(observed, profiles, keys, on):
    """Sum of ln(p / q) over observations; profiles(on.., p, q) is one row for each class."""
    return observed.join(profiles, on).groupBy(*keys).agg(F.sum(F.log(F.col("p") / F.col("q"))).alias("llr"))
