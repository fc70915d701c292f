"""The runnable jobs as queries: each runs twice into one new folder, and the result is what stands there after the second run."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import Registry, folder_of_its_own
from .statistics import TAIL

R = Registry()


LETTERS = ", ".join(f"length(t) - length(translate(t, '{b}{b.lower()}', '')) as {b.lower()}" for b in "ACGT")
COUNTS = ", ".join(f"count_if(status = '{s}')::bigint as {s}" for s in ("accepted", "no_id", "empty", "length_mismatch", "short"))
RANKS = ", ".join(f"min(length) filter (good and upto > (total - 1) * {p} // 100)::bigint as p{p}" for p in (5, 50, 95))


@R.add(f"""with d as (select coalesce(nullif(trim(source), ''), 'unassigned') as sample, coalesce(length(text), 0) as length, coalesce(text, '') as t, doc_id, n_chars from documents),
s as (select sample, length, {LETTERS}, case when doc_id is null then 'no_id' when length = 0 then 'empty' when n_chars <> length then 'length_mismatch' when length < 200 then 'short' else 'accepted' end as status from d),
r as (select *, status = 'accepted' as good, row_number() over (partition by sample, status order by length) as upto, count(*) over (partition by sample, status) as total,
 sum(length) over (partition by sample, status order by length desc range unbounded preceding) as down, sum(length) over (partition by sample, status) as size from s)
select sample, count(*)::bigint as reads, {COUNTS}, coalesce(sum(length) filter (good), 0)::bigint as bases, {RANKS}, max(length) filter (good and 2 * down >= size)::bigint as n50,
 round(sum(c + g) filter (good) / nullif(sum(a + c + g + t) filter (good), 0)::double, 6) as gc,
 case when count_if(good) >= 30 then 'adequate' when count_if(good) >= 10 then 'low' else 'insufficient' end as depth from r group by sample""")
def job1_read_intake(spark, sf):
    from jobs import read_intake

    folder = folder_of_its_own(spark, "job1")
    for _ in range(2):
        read_intake.run(spark, f"{sf}/documents.parquet", folder)
    return read_intake.profile(spark, folder)


P = "((a + b) / 2)"
LOW, HIGH = TAIL.format(p=P, a="k", b="n + 1"), TAIL.format(p=P, a="0", b="k + 1")
Z = "1.6448536269514715"


@R.add(f"""with recursive f as (select doc_id, min(coalesce(nullif(trim(lang), ''), 'unassigned')) as profile, min(coalesce(nullif(trim(source), ''), 'unassigned')) as stratum, bool_and(coalesce(n_chars >= 300, false)) as current,
  bool_and(coalesce(n_chars >= 300 and not contains(text, '***') and not contains(text, '!!'), false)) as candidate from documents where doc_id is not null group by doc_id),
y as (select doc_id, min(quality) = 1 as truth from labels where doc_id is not null group by doc_id having min(quality = 1) = max(quality = 1)),
c as (select * from f join y using (doc_id)),
e as (select profile, stratum, 'current' as caller, current <> truth as wrong, case when truth then 'missed' else 'false_call' end as metric from c union all select profile, stratum, 'candidate', candidate <> truth, case when truth then 'missed' else 'false_call' end from c),
q as (select profile, stratum, caller, metric, count_if(wrong)::bigint as k, count(*)::bigint as n from e group by grouping sets ((profile, caller, metric), (profile, caller, metric, stratum))),
kn as (select distinct k, n from q),
lo(k, n, a, b, i) as (select k, n, 0.0::double, 1.0::double, 0 from kn union all select k, n, case when {LOW} < 0.025 then {P} else a end, case when {LOW} < 0.025 then b else {P} end, i + 1 from lo where i < 40),
hi(k, n, a, b, i) as (select k, n, 0.0::double, 1.0::double, 0 from kn union all select k, n, case when {HIGH} > 0.025 then {P} else a end, case when {HIGH} > 0.025 then b else {P} end, i + 1 from hi where i < 40),
ci as (select l.k, l.n, case when l.k = 0 then 0 else (l.a + l.b) / 2 end as low, case when l.k = l.n then 1 else (h.a + h.b) / 2 end as high from lo l join hi h on l.k = h.k and l.n = h.n where l.i = 40 and h.i = 40),
w as (select profile, case when truth then 'missed' else 'false_call' end as metric, count_if(current <> truth and candidate = truth)::bigint as b, count_if(current = truth and candidate <> truth)::bigint as c,
  count_if(candidate <> truth)::double as x1, count_if(current <> truth)::double as x0, count(*)::double as m from c group by all),
t as (select *, case when b + c = 0 then 1 else least(1, (select sum(exp(lgamma(b + c + 1) - lgamma(j + 1) - lgamma(b + c - j + 1) + (b + c) * ln(0.5))) from (select unnest(range(0, b + c + 1)) as j)
  where lgamma(b + c + 1) - lgamma(j + 1) - lgamma(b + c - j + 1) <= lgamma(b + c + 1) - lgamma(b + 1) - lgamma(c + 1) + 1e-9)) end as p from w),
h as (select *, row_number() over (partition by profile order by p, metric) as i, count(*) over (partition by profile) as z from t),
a as (select *, least(1, max((z - i + 1) * p) over (partition by profile order by i rows unbounded preceding)) as adjusted, x1 / m as p1, x0 / m as p0,
  (x1 / m + {Z}*{Z} / m / 2) / (1 + {Z}*{Z} / m) + {Z} * sqrt(x1 / m * (1 - x1 / m) / m + {Z}*{Z} / m / (4 * m)) / (1 + {Z}*{Z} / m) as u1,
  (x0 / m + {Z}*{Z} / m / 2) / (1 + {Z}*{Z} / m) - {Z} * sqrt(x0 / m * (1 - x0 / m) / m + {Z}*{Z} / m / (4 * m)) / (1 + {Z}*{Z} / m) as l0 from h),
v as (select profile, metric, b, c, p, adjusted, p1 - p0 as difference, p1 - p0 + sqrt(pow(u1 - p1, 2) + pow(p0 - l0, 2)) as upper from a)
select q.profile, q.stratum, q.caller, q.metric, q.k, q.n, round(q.k / q.n::double, 6) as rate, round(ci.low, 6) as low, round(ci.high, 6) as high, v.b, v.c, round(v.p, 6) as p, round(v.adjusted, 6) as adjusted, round(v.difference, 6) as difference,
  round(v.upper, 6) as upper, v.upper < 0.05 as noninferior, v.b > v.c and v.adjusted < 0.05 as superior
 from q join ci using (k, n) left join v on v.profile = q.profile and v.metric = q.metric and q.caller = 'candidate' and q.stratum is null""")
def job2_call_report(spark, sf):
    from jobs import call_report

    folder = folder_of_its_own(spark, "job2")
    for _ in range(2):
        call_report.run(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet", folder)
    out = call_report.report(spark, folder)
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "low", "high", "p", "adjusted", "difference", "upper")})
