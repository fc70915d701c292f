"""Cases, cohorts, ratios, targets, provenance and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from . import Registry, table

R = Registry()


@R.add("select l_orderkey as case_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey)::int as allele, l_linenumber::int as number, l_partkey as length from lineitem")
def allele_rows(spark, sf):
    listed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("number"), F.col("l_partkey").alias("length")))).alias("alleles"))
    return S.allele_rows(listed)


def _cases(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderpriority as set", "o_custkey % 4 as profile", "o_orderkey as case_id", "o_custkey % 3 = 0 as pathogenic", "o_custkey % 3 = 1 as normal", "if(o_custkey % 7 = 0, null, o_custkey % 3 = 2) as benign",
        "if(o_orderstatus = 'F', 'PATHOGENIC', 'NEGATIVE') as decision", "o_orderstatus = 'P' as inconclusive", "o_orderstatus = 'F' and o_orderkey % 5 = 0 as false_positive",
    )


CASES = """(select o_orderpriority as set, o_custkey % 4 as profile, o_custkey % 3 = 0 as pathogenic, o_custkey % 3 = 1 as normal, case when o_custkey % 7 = 0 then null else o_custkey % 3 = 2 end as benign,
 case when o_orderstatus = 'F' then 'PATHOGENIC' else 'NEGATIVE' end as decision, o_orderstatus = 'P' as inconclusive, o_orderstatus = 'F' and o_orderkey % 5 = 0 as false_positive, o_orderkey as case_id from orders)"""


@R.add(f"""select 'all' as cohort, count(*)::bigint as n from {CASES} union all select 'negatives', count(*) filter (coalesce(normal or benign, false))::bigint from {CASES} union all select 'pathogenic', count(*) filter (pathogenic)::bigint from {CASES}""")
def metric_cohorts(spark, sf):
    rows = _cases(spark, sf)
    one = lambda name: S.cohort(rows, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("cohort"), "n")
    return one("all").union(one("negatives")).union(one("pathogenic"))


TARGETS = [("pathogenic_rate", "ge", 0.4, "pooled"), ("inconclusive_rate", "le", 0.03, "profile"), ("false_positive_rate", "le", 0.2, "pooled")]
TARGETS_SQL = "(values ('pathogenic_rate', 'ge', 0.4, 'pooled'), ('inconclusive_rate', 'le', 0.03, 'profile'), ('false_positive_rate', 'le', 0.2, 'pooled')) t(metric, comparator, threshold, scope)"
LONG = f"""(select set, profile, grouping(profile) = 1 as pooled, unnest([{{'metric': 'pathogenic_rate', 'k': count_if(pathogenic and decision = 'PATHOGENIC'), 'n': count_if(pathogenic)}},
 {{'metric': 'inconclusive_rate', 'k': count_if(inconclusive), 'n': count(*)}},
 {{'metric': 'false_positive_rate', 'k': count_if(coalesce(normal or benign, normal, benign, false) and false_positive), 'n': count_if(coalesce(normal, false) or coalesce(benign, false))}}], recursive := true)
 from {CASES} group by grouping sets ((set), (set, profile)))"""


@R.add(f"""select set, profile, metric, k::bigint as k, n::bigint as n, round(k / n::double, 6) as rate, pooled = (scope = 'pooled') as binding,
 coalesce(case when comparator = 'ge' then k / n::double >= threshold else k / n::double <= threshold end, false) as pass from {LONG} join {TARGETS_SQL} using (metric)""")
def judged_targets(spark, sf):
    targets = spark.createDataFrame(TARGETS, "metric string, comparator string, threshold double, scope string")
    return S.judged_targets(_cases(spark, sf), targets).select("set", "profile", "metric", "k", "n", F.round("rate", 6).alias("rate"), "binding", "pass")


@R.add(f"""select set, bool_and(pass) as pass from (select set, pooled = (scope = 'pooled') as binding, coalesce(case when comparator = 'ge' then k / n::double >= threshold else k / n::double <= threshold end, false) as pass from {LONG} join {TARGETS_SQL} using (metric)) where binding group by set""")
def set_passes(spark, sf):
    targets = spark.createDataFrame(TARGETS, "metric string, comparator string, threshold double, scope string")
    return S.set_passes(S.judged_targets(_cases(spark, sf), targets))


SITES = "select l_orderkey as id, l_linenumber as line, case l_partkey % 3 when 0 then 'run' when 1 then 'ins' else 'col' end as kind, substr('ACGT', (l_suppkey % 4 + 1)::int, 1) as base, case l_partkey % 3 when 0 then (l_suppkey % 5 + 3)::varchar when 1 then '' else substr('ACG-', (l_suppkey % 4 + 1)::int, 1) end as major, case l_partkey % 3 when 0 then (l_suppkey % 5 + 3 + l_linenumber % 3)::varchar when 1 then substr('ACGGT', 1, (l_linenumber % 4 + 1)::int) else substr('GT-A', (l_orderkey % 4 + 1)::int, 1) end as minor from lineitem"


def _sites(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("_scoring_lineitem")
    return spark.sql(SITES.replace("from lineitem", "from _scoring_lineitem").replace("::varchar", "::string"))


@R.add(f"select id, line, kind <> 'run' and (major = '-' or minor = '-' or length(major) <> length(minor)) as indel from ({SITES})")
def indel_sites(spark, sf):
    return _sites(spark, sf).select("id", "line", ((F.col("kind") != "run") & S.is_indel("major", "minor")).alias("indel"))


@R.add(f"select id, line, kind from ({SITES}) where (kind = 'run' and (base, major, minor) in (('C', '7', '8'), ('C', '7', '6'), ('G', '4', '5'))) or (kind = 'ins' and starts_with(minor, major) and substr(minor, length(major) + 1) in ('A', 'ACG'))")
def known_sites(spark, sf):
    runs = spark.createDataFrame([("C", "7", "8"), ("C", "7", "6"), ("G", "4", "5")], "base string, major string, minor string")
    inserted = spark.createDataFrame([("A",), ("ACG",)], "bases string")
    return S.known_sites(_sites(spark, sf), runs, inserted).select("id", "line", "kind")


@R.add("""with l as (select l_suppkey as sample, unnest(['kind', 'strand']) as "column", unnest([l_returnflag, l_linestatus]) as value from lineitem)
select *, round(n / sum(n) over (partition by sample, "column"), 6) as share from (select sample, "column", value, count(*)::bigint as n from l group by all)""")
def read_composition(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("strand"))
    return S.composition(rows, ["sample"], ["kind", "strand"]).withColumn("share", F.round("share", 6))


@R.add("""with t as (select o_orderkey as sample, unnest(range(0, o_custkey % 3)) as t from orders), p as (select o_orderkey as sample, unnest(range(0, o_custkey % 4)) as p from orders),
m as (select sample, count(*) as n from t where t > 0 group by 1), x as (select sample, count(*) as n from p where p > 0 or sample not in (select sample from t where t = 0) group by 1), s as (select sample from t union select sample from p),
m0 as (select sample, count(*) as n from t where t > 0 or sample not in (select sample from p where p = 0) group by 1)
select sample, coalesce(m0.n, 0)::bigint as missing, coalesce(x.n, 0)::bigint as extra from s left join m0 using (sample) left join x using (sample)""")
def missing_and_extra(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), "o_custkey")
    upto = lambda k: F.when(F.col("o_custkey") % k > 0, F.sequence(F.lit(0), (F.col("o_custkey") % k - 1).cast("int")))
    truth, predicted = o.select("sample", F.explode(upto(3)).alias("t")), o.select("sample", F.explode(upto(4)).alias("p"))
    chosen = truth.where("t = 0").join(predicted.where("p = 0"), "sample")
    return S.both_ways(truth, chosen, predicted)


FLAGS = {
    "truth_status": "case when o_custkey % 11 = 0 then 'invalid' else 'valid' end", "status": "case when o_orderstatus = 'F' then 'completed' else 'ambiguous' end",
    "mutation_positive_truth": "o_custkey % 3 = 0", "independent_haplotype_evidence": "o_custkey % 2 = 0",
    "predicted_alleles": "o_orderkey % 4", "truth_haplotypes": "o_custkey % 2 + 1", "truth_events": "o_custkey % 3", "missing_alleles": "o_orderkey % 2", "extra_alleles": "o_custkey % 5 % 2",
    "sequence_exact_min": "least(o_orderkey % 3, 2)", "structure_exact_min": "least(o_orderkey % 3, 1)", "independent_sequence_exact_min": "least(o_orderkey % 3, 1)", "independent_structure_exact_min": "o_orderkey % 2", "all_sequences_exact_min": "o_orderkey % 2",
}
for _k, _view in enumerate(S.VIEWS):
    FLAGS |= {
        f"{_view}event_tp_min": f"least(o_custkey % 3, o_orderkey % {3 + _k})", f"{_view}event_fp_max": f"o_orderkey % {2 + _k}", f"{_view}sample_alarm": f"o_orderkey % {2 + _k} = 0",
        f"{_view}normal_true_negative": f"o_custkey % 3 > 0 and o_orderkey % {2 + _k} > 0", f"{_view}normal_false_positive": f"o_custkey % 3 > 0 and o_orderkey % {2 + _k} = 0",
    }


def _ratios_sql() -> str:
    parts = {}
    for v in S.VIEWS:
        parts[f"{v}event_recall"] = (f"sum({v}event_tp_min)", "sum(truth_events)")
        parts[f"{v}event_precision"] = (f"sum({v}event_tp_min)", f"sum({v}event_tp_min) + sum({v}event_fp_max)")
        parts[f"{v}sample_alarm_precision"] = (f"count_if(mutation_positive_truth and {v}sample_alarm)", f"count_if({v}sample_alarm)")
        parts[f"{v}sample_alarm_sensitivity"] = (f"count_if(mutation_positive_truth and {v}sample_alarm)", "count_if(mutation_positive_truth)")
        parts[f"{v}normal_specificity"] = (f"count_if({v}normal_true_negative)", f"count_if({v}normal_true_negative or {v}normal_false_positive)")
    for w in ("sequence", "structure"):
        parts[f"literal_{w}_accuracy"] = (f"sum({w}_exact_min)", "sum(truth_haplotypes)")
        parts[f"{w}_accuracy"] = parts[f"independently_recovered_{w}_accuracy"] = (f"sum(independent_{w}_exact_min)", "sum(truth_haplotypes)")
    parts["literal_conditional_sequence_accuracy"] = ("sum(sequence_exact_min)", "sum(least(predicted_alleles, truth_haplotypes))")
    parts["conditional_sequence_accuracy"] = parts["independently_recovered_conditional_sequence_accuracy"] = ("sum(independent_sequence_exact_min)", "sum(least(predicted_alleles, truth_haplotypes))")
    parts["exact_sample_reconstruction"] = ("sum(all_sequences_exact_min)", "count(*)")
    parts["call_rate"], parts["no_call_rate"] = ("count_if(predicted_alleles > 0)", "count(*)"), ("count_if(predicted_alleles = 0)", "count(*)")
    parts["normal_confident_negative_rate"] = ("count_if(normal_true_negative)", "count_if(not mutation_positive_truth)")
    parts["resolved_reconstruction_call_rate"] = ("count_if(status = 'completed' and missing_alleles = 0 and extra_alleles = 0 and independent_haplotype_evidence)", "count(*)")
    one = " union all ".join(f"select '{k}' as name, ({a})::bigint as numerator, ({b})::bigint as denominator from s" for k, (a, b) in parts.items())
    rows = ", ".join(f"{v} as {k}" for k, v in FLAGS.items())
    return f"with s as (select * from (select {rows} from orders) where truth_status = 'valid') select name, numerator, denominator, round(numerator / nullif(denominator, 0)::double, 6) as value from ({one})"


@R.add(_ratios_sql())
def evaluation_ratios(spark, sf):
    samples = table(spark, sf, "orders").selectExpr(*[f"{v} as {k}" for k, v in FLAGS.items()])
    return S.ratios(samples).withColumn("value", F.round("value", 6))


@R.add("select l_orderkey, l_linenumber, round(greatest(l_discount * 5, 0.05), 6) as share, l_discount * 5 < 0.05 as capped, ceil(30 / (greatest(l_discount * 5, 0.05) * (1 - 0.12)))::bigint as templates from lineitem")
def templates_needed(spark, sf):
    out = table(spark, sf, "lineitem").withColumn("x", S.templates_needed(30, 0.12, F.col("l_discount") * 5))
    return out.select("l_orderkey", "l_linenumber", F.round("x.share", 6).alias("share"), "x.capped", "x.templates")


@R.add("select event_type as version, count(*)::bigint as cases, count(distinct d)::bigint as inputs, sha256(string_agg(distinct d, chr(10) order by d)) as inputs_sha256 from (select event_type, md5((user_id)::varchar) as d from events) group by 1")
def provenance(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("version"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("d"))
    return S.provenance(e, "version", "d")


@R.add("""with g as (select * from (select distinct o_orderpriority as set from orders), (values ('status', 'F'), ('status', 'O'), ('status', 'absent')) v(factor, level)), s as (select o_orderpriority as set, o_orderstatus as level, count_if(o_custkey % 2 = 0) as k, count(*) as n from orders group by all)
select set, factor, level, coalesce(k, 0)::bigint as k, coalesce(n, 0)::bigint as n, round(k / n::double, 6) as rate, set = '1-URGENT' as headline from g left join s using (set, level)""")
def level_tables(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("set"), F.lit("status").alias("factor"), F.col("o_orderstatus").alias("level"), (F.col("o_custkey") % 2 == 0).alias("hit"))
    return S.level_tables(rows, [("status", "F"), ("status", "O"), ("status", "absent")], "1-URGENT").select("set", "factor", "level", "k", "n", F.round("rate", 6).alias("rate"), "headline")


@R.add("select p_brand as reason, count(*)::bigint as n from part group by 1 order by n desc, reason limit 7")
def top_reasons(spark, sf):
    return S.top_reasons(table(spark, sf, "part").select(F.col("p_brand").alias("reason")), "reason", 7)


@R.add("select s_suppkey as design, mode, substr(sha256('7|' || s_suppkey || '|' || mode), 1, 16) as token from supplier, (values ('plain'), ('noisy')) m(mode)")
def blinded_inventory(spark, sf):
    return S.blinded(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("design")), ["plain", "noisy"], 7)


REPORT = """select 'R' || o_orderkey as run_accession, ' S' || o_custkey || case when o_custkey % 2 = 0 then '_PCR_' else '_WGS_' end || case when o_custkey % 5 = 0 then 'OTHER' else 'Locus' end as sample_alias, case when o_custkey % 2 = 0 then 'amplicon' else 'WGS' end as library_strategy,
 'h/a' || o_orderkey || ';ftp://h/b' as fastq_ftp, case when o_orderkey % 3 = 0 then '12' else '12;34' end as fastq_bytes, upper(md5(o_orderkey::varchar)) || ';' || md5('x') as fastq_md5 from orders"""


@R.add(f"""select run_accession as run, trim(sample_alias) as alias, split_part(split_part(trim(sample_alias), '_PCR_', 1), '_WGS_', 1) as biological_sample,
 case when not ends_with(sample_alias, 'Locus') then 'excluded' when upper(library_strategy) = 'AMPLICON' then 'primary_amplicon' else 'secondary_wgs' end as arm, fastq_bytes = '12;34' as aligned,
 case when fastq_bytes = '12;34' then 'https://' || split_part(fastq_ftp, ';', 1) end as first_url, case when fastq_bytes = '12;34' then lower(split_part(fastq_md5, ';', 1)) end as first_md5, case when fastq_bytes = '12;34' then 34 end::bigint as second_bytes from ({REPORT})""")
def archive_runs(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_scoring_orders")
    report = spark.sql(REPORT.replace("from orders", "from _scoring_orders").replace("::varchar", "::string"))
    return S.archive_runs(report, "LOCUS").select("run", "alias", "biological_sample", "arm", "aligned", F.col("files")[0]["url"].alias("first_url"), F.col("files")[0]["md5"].alias("first_md5"), F.col("files")[1]["bytes"].alias("second_bytes"))


@R.add("select s_suppkey, case when s_suppkey % 4 > 0 then 'chr' || s_suppkey % 23 end as contig, case when s_suppkey % 4 > 0 then s_suppkey * 1000 end as start, case when s_suppkey % 4 > 0 then s_suppkey * 1000 + 99 end as \"end\" from supplier")
def parse_region(spark, sf):
    key = F.col("s_suppkey")
    text = F.when(key % 4 > 0, F.concat(F.lit("chr"), key % 23, F.lit(":"), F.format_number(key * 1000, 0), F.lit("-"), key * 1000 + 99)).otherwise("chr1:5")
    return table(spark, sf, "supplier").withColumn("r", S.region(text)).select("s_suppkey", "r.contig", "r.start", "r.end")


@R.add("""with m as (select l_suppkey as sample, l_partkey as pos, l_linenumber as index, 7 as units, l_discount * 10 as confidence, l_orderkey from lineitem), c as (select s as sample, p as pos, max(q) as qual from (select l_suppkey as s, l_partkey as p, l_quantity as q from lineitem where l_returnflag = 'R') group by all)
select l_orderkey, index, pos, qual is not null as concordant, index <= 2 or index > 5 as at_border, round(confidence * case when index <= 2 or index > 5 then 0.5 else 1 end, 6) as weighted from m left join c using (sample, pos)""")
def checked_with_calls(spark, sf):
    t = table(spark, sf, "lineitem")
    m = t.selectExpr("l_suppkey as sample", "l_partkey as pos", "l_linenumber as index", "7 as units", "l_discount * 10 as confidence", "l_orderkey")
    c = t.where("l_returnflag = 'R'").selectExpr("l_suppkey as sample", "l_partkey as pos", "l_quantity as qual")
    return S.checked_with_calls(m, c).select("l_orderkey", "index", "pos", "concordant", "at_border", F.round("weighted", 6).alias("weighted"))


@R.add("select l_orderkey as sample, l_linenumber as pos, greatest(1, least(l_suppkey % 60 + 20, round(l_linenumber * (l_suppkey % 60 + 20) / 40.0)))::bigint as actual_pos from lineitem")
def scaled_targets(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey as sample", "l_linenumber as pos", "40 as design_units", "l_suppkey % 60 + 20 as actual_units")
    return S.scaled_targets(rows).select("sample", "pos", "actual_pos")


@R.add()
def rare_units(spark, sf):
    """Chains of 20 to 60 units with about a tenth of the interior replaced."""
    chains = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_repeat(F.lit("X"), (F.col("o_custkey") % 41 + 20).cast("int")).alias("units"))
    return S.with_rare_units(chains, ["Q", "R", "S"]).select("id", F.concat_ws("-", "units").alias("chain"))
