"""Functions called from SQL, broadcast checks, and runs that break off."""

import pytest
from pyspark.sql import functions as F

from strandflow.functions import tables
from strandflow.operators import joins, segment
from test_support import WORDS, allele, mutated


def test_segmentation_from_sql_is_that_of_the_operator(spark):
    rows = [("a", allele("X", mutated("X", "dupC"), "A")), ("b", allele(*"XXAB")), ("c", None), ("d", "ACGT" * 20)]
    df = spark.createDataFrame(rows, "id string, seq string")
    tables.register(spark, WORDS, "t_")
    df.createOrReplaceTempView("rows_of_test")
    got = spark.sql("select r.id, s.* from rows_of_test r, lateral t_segment(r.seq) s").collect()
    want = segment.segments(df.where("seq is not null"), WORDS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    one = spark.sql("select t_revcomp('ACGTNa') as r, t_is_frameshift(4) as f, t_is_frameshift(-3) as g, t_substitutions_only('ACGT', 'AGGA') as s, t_substitutions_only('AACG', 'ACGG') as u, t_substitutions_only('A', 'AA') as v").first()
    assert tuple(one) == ("tNACGT", True, False, True, True, False)


def test_small_looks_at_letters_too(spark):
    few = spark.createDataFrame([("a", "A" * 100)], "k string, seq string")
    wide = spark.range(40).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("A"), 500_000).alias("seq"))
    hinted = lambda df: "hint" in joins.small(df)._jdf.queryExecution().logical().toString().lower()
    assert hinted(few) and not hinted(wide)


def test_a_run_that_breaks_off_is_not_complete(spark, tmp_path):
    from strandflow.sources.writers import write_run

    good = {"alleles": spark.createDataFrame([("s", 1)], "sample string, n int")}
    write_run(good, str(tmp_path / "run"))
    assert (tmp_path / "run/summary.json").exists()
    bad = {"alleles": spark.createDataFrame([("s", 1)], "sample string, n int").withColumn("n", F.raise_error(F.lit("broken")).cast("int"))}
    with pytest.raises(Exception, match="broken"):
        write_run(bad, str(tmp_path / "run"))
    assert not (tmp_path / "run/summary.json").exists()


def test_costly_columns_are_worked_out_once_for_each_input(spark):
    from pyspark.sql import functions as F
    from strandflow.operators.joins import each_once

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(a, b):
        calls.add(1)
        return f"{a}{b}"

    rows = [(n, None if n % 3 == 0 else "xy"[n % 2], n % 2) for n in range(60)]
    out = each_once(spark.createDataFrame(rows, "id int, a string, b int"), ["a", "b"], {"c": costly("a", "b")})
    assert sorted(map(tuple, out.collect())) == sorted(((*r, f"{r[1]}{r[2]}") for r in rows), key=lambda r: r[0])
    assert calls.value == len({r[1:] for r in rows})


def test_signatures_are_worked_out_behind_the_grouping(spark):
    from strandflow.operators.records import run_signatures

    rows = spark.createDataFrame([("a", "ACCCT"), ("b", "ACCCT")], "parent string, seq string")
    out = run_signatures(rows.replace("ACCCT", "ACCCCT"), rows.withColumnRenamed("parent", "id"))
    assert [tuple(r) for r in out.collect()] == [("C", 3, 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[plan.rindex("Aggregate") :]
