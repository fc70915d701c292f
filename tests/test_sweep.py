import pytest
from pyspark.sql import functions as F

from strandflow.operators.sweep import keyed, results, sweep

RESULT = "value long, parts array<struct<a: int, b: string>>"
INPUTS = ["n", "name"]


def made():
    def work(x):  # within a function, so that it travels to the tasks as it is
        if x["name"] is None:
            return {"value": -1, "parts": None}
        return {"value": 100 // x["n"], "parts": [{"a": int(x["n"]), "b": x["name"]}]}

    return work


def cases(spark, rows):
    return spark.createDataFrame([(f"c{i}", n, name, "open") for i, (n, name) in enumerate(rows)], "case string, n long, name string, split string")


def run(df, folder, **more):
    rows = sweep(df, folder, INPUTS, made(), RESULT, version=more.pop("version", "1"), split="split", **more).collect()
    return {r["case"]: (r.status, r.value, r.error, r["round"]) for r in rows}


def test_second_run_works_out_only_what_is_new(spark, tmp_path):
    folder = f"{tmp_path}/results"
    first = run(cases(spark, [(1, "a"), (0, "b"), (4, None), (1, "a")]), folder)
    assert first == {"c0": ("completed", 100, None, 1), "c1": ("failed", None, "ZeroDivisionError: integer division or modulo by zero", 1), "c2": ("completed", -1, None, 1), "c3": ("completed", 100, None, 1)}
    assert results(spark, folder, RESULT).count() == 3  # equal inputs are one point
    files = sorted(p.name for p in (tmp_path / "results").iterdir())
    assert run(cases(spark, [(1, "a"), (0, "b"), (4, None), (1, "a")]), folder) == first
    assert sorted(p.name for p in (tmp_path / "results").iterdir()) == files
    more = run(cases(spark, [(1, "a"), (0, "b"), (5, "a")]), folder)
    assert more["c0"] == first["c0"] and more["c1"] == first["c1"] and more["c2"] == ("completed", 20, None, 2)
    assert run(cases(spark, [(1, "a")]), folder, version="2")["c0"][3] == 3
    assert run(cases(spark, []), folder) == {} and run(cases(spark, []), f"{tmp_path}/nothing") == {}


def test_retry_takes_failed_points_only(spark, tmp_path):
    folder = f"{tmp_path}/results"
    df = cases(spark, [(1, "a"), (0, "b")])
    run(df, folder)
    again = run(df, folder, retry=True)
    assert again["c0"][3] == 1 and again["c1"][0] == "failed" and again["c1"][3] == 2
    mended = {r["case"]: (r.status, r.value, r["round"]) for r in sweep(df, folder, INPUTS, lambda x: {"value": 7, "parts": None}, RESULT, version="1", retry=True).collect()}
    assert mended == {"c0": ("completed", 100, 1), "c1": ("completed", 7, 3)}


def test_sealed_cases_and_clashing_columns_are_refused(spark, tmp_path):
    df = cases(spark, [(1, "a")])
    with pytest.raises(ValueError, match="sealed"):
        run(df.withColumn("split", F.lit("sealed")), f"{tmp_path}/r")
    assert not (tmp_path / "r").exists()
    with pytest.raises(ValueError, match="value"):
        run(df.withColumn("value", F.lit(1)), f"{tmp_path}/r")


def test_results_of_another_shape_are_failures(spark, tmp_path):
    rows = sweep(cases(spark, [(1, "a")]), f"{tmp_path}/r", INPUTS, lambda x: {"other": 1}, RESULT, version="1").collect()
    assert rows[0].status == "failed" and "instead of" in rows[0].error


def test_keys_tell_null_from_text_and_ignore_order(spark):
    df = spark.createDataFrame([(1, None), (1, "null"), (1, "")], "n int, name string")
    assert keyed(df, ["n", "name"], "1").select("key").distinct().count() == 3
    assert keyed(df, ["n", "name"], "1").select("key").collect() == keyed(df, ["name", "n"], "1").select("key").collect()


def test_points_leave_together_with_large_numbers_whole(spark):
    from pyspark.sql import functions as F
    from strandflow.operators import sweep as module

    sizes = spark.sparkContext.accumulator(0)
    points = spark.range(2000, numPartitions=1).select(F.col("id").cast("string").alias("key"), "id")
    out = module.attempted(points, ["id"], lambda x: {"v": 2**53 + 1 + x["id"] if x["id"] % 7 else 1 // 0}, "v long")

    def count(batches):
        for batch in batches:
            sizes.add(1)
            yield batch

    rows = out.mapInArrow(count, out.schema).collect()
    assert [r.v for r in sorted(rows, key=lambda r: int(r.key))] == [2**53 + 1 + n if n % 7 else None for n in range(2000)]
    assert sizes.value < 50
