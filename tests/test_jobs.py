"""The runnable jobs: growing input, reruns, awkward rows, command lines."""

import json
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from jobs import call_report, common, read_intake
from strandflow.queries import catalog
from test_queries import rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = Path(__file__).resolve().parents[1]


def expected(rows, least=200):
    """Profiles by plain Python."""
    by = defaultdict(list)
    for doc_id, text, _, source, n in rows:
        text = text or ""
        status = "no_id" if doc_id is None else "empty" if not text else "length_mismatch" if n is not None and n != len(text) else "short" if len(text) < least else "accepted"
        by[(source or "").strip() or "unassigned"].append((status, text))
    out = {}
    for sample, reads in by.items():
        count = Counter(s for s, _ in reads)
        good = sorted((t for s, t in reads if s == "accepted"), key=len)
        total, down, n50 = sum(map(len, good)), 0, None
        for t in reversed(good):
            down += len(t)
            if 2 * down >= total:
                n50 = len(t)
                break
        letters = Counter("".join(good).upper())
        acgt = sum(letters[b] for b in "ACGT")
        rank = lambda p: len(good[(len(good) - 1) * p // 100]) if good else None  # noqa: B023, E731
        depth = "adequate" if len(good) >= 30 else "low" if len(good) >= 10 else "insufficient"
        out[sample] = (len(reads), *[count[s] for s in ("accepted", "no_id", "empty", "length_mismatch", "short")], total, rank(5), rank(50), rank(95), n50, round((letters["G"] + letters["C"]) / acgt, 6) if acgt else None, depth)
    return out


def profiles(spark, folder):
    return {r.sample: tuple(v for k, v in r.asDict().items() if k != "sample") for r in read_intake.profile(spark, folder).collect()}


def reads(seed, n):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice("ACGTacgtNxé ") for _ in range(rng.choice([150, 199, 200, 250, 900])))
        rows.append((seed * 10_000 + i, text, "en", rng.choice(["s1", "s1", "s1", "s2", " s3 ", "007"]), len(text)))
    return rows


AWKWARD = [(None, "A" * 300, "en", "s1", 300), (1, None, "en", "s1", 0), (2, "", "en", "s2", None), (3, "G" * 250, None, None, 250), (4, "C" * 220, "en", "  ", None), (5, "T" * 300, "en", "s2", 299), (5, "T" * 300, "en", "s2", 300), (6, "ab" * 400_000, "en", "long", 800_000)]


def test_intake_takes_only_what_is_new(spark, tmp_path):
    source, folder = str(tmp_path / "reads.parquet"), str(tmp_path / "out")
    rows = reads(1, 90)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(source)
    first = read_intake.run(spark, source, folder)
    assert first["read"] == first["reads"] == 90 and profiles(spark, folder) == expected(rows)
    # nothing new: nothing is read, the same profile stands
    again = read_intake.run(spark, source, folder)
    assert again["read"] == again["reads"] == 0 and profiles(spark, folder) == expected(rows)
    # only the new files are read; samples of old ones keep their counts
    more = reads(2, 70) + AWKWARD
    spark.createDataFrame(more, SCHEMA).coalesce(3).write.mode("append").parquet(source)
    third = read_intake.run(spark, source, folder)
    assert third["read"] == third["reads"] == len(more)
    assert profiles(spark, folder) == expected(rows + more)
    assert sorted(p.name for p in (tmp_path / "out/reads").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]
    assert spark.read.schema("read_id string, sample string").parquet(f"{folder}/reads").count() == len(rows + more)


def test_intake_repeats_a_batch_that_was_cut_off(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "reads.parquet"), str(tmp_path / "out")
    rows = reads(3, 60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    whole = read_intake.written

    def fails(df, where, *a, **b):
        n = whole(df, where, *a, **b)
        if "/lengths/" in where:
            raise RuntimeError("cut off")
        return n

    monkeypatch.setattr(read_intake, "written", fails)
    with pytest.raises(Exception, match="cut off"):
        read_intake.run(spark, source, folder)
    monkeypatch.setattr(read_intake, "written", whole)
    done = read_intake.run(spark, source, folder)
    assert done["reads"] == 60 and profiles(spark, folder) == expected(rows)
    # and one that ends before the profile is written
    more = reads(4, 30)
    spark.createDataFrame(more, SCHEMA).write.mode("append").parquet(source)
    monkeypatch.setattr(read_intake, "written", lambda df, where, *a, **b: 1 / 0 if where.endswith("/profile") else whole(df, where, *a, **b))
    with pytest.raises(ZeroDivisionError):
        read_intake.run(spark, source, folder)
    monkeypatch.setattr(read_intake, "written", whole)
    assert read_intake.run(spark, source, folder)["read"] == 0
    assert profiles(spark, folder) == expected(rows + more)


def test_intake_in_small_batches_and_of_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "reads.parquet"), str(tmp_path / "out")
    rows = reads(5, 80)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(source)
    read_intake.run(spark, source, folder, read_intake.Settings(max_bytes_per_batch=1))
    assert len(list((tmp_path / "out/reads").glob("batch=*"))) == 4 and profiles(spark, folder) == expected(rows)
    nothing = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(nothing)
    assert read_intake.run(spark, nothing, str(tmp_path / "none"))["profile"] == 0
    assert profiles(spark, str(tmp_path / "none")) == {}


def test_report_against_plain_counts(spark, tmp_path):
    docs = [(i, "x" * 400 if i % 3 else "y***" * 100, "en" if i % 2 else "de", f"s{i % 4}", 400) for i in range(200)]
    docs += [(0, "short", "en", "s0", 5), (None, "x" * 400, "en", "s0", 400), (500, None, None, "", None), (501, "x" * 400, "fr", None, 400)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(200)] + [(7, 0, 0), (None, 1, 0), (500, 1, 0), (501, 0, 0), (9, None, 0)]
    cases, truth, folder = (str(tmp_path / x) for x in ("docs.parquet", "labels.parquet", "out"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(cases)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(truth)
    done = call_report.run(spark, cases, truth, folder)
    assert done["cases"] == 201  # 7 has two truths
    rows = {(r.profile, r.stratum, r.caller, r.metric): r for r in call_report.report(spark, folder).collect()}
    known = [(i, lang, bool(i % 5)) for i, _, lang, _, _ in docs[:200] if i != 7]
    called = {"current": lambda i: i != 0, "candidate": lambda i: i != 0 and i % 3 > 0}
    for lang in ("en", "de"):
        for caller, f in called.items():
            for metric, t in (("missed", True), ("false_call", False)):
                own = [i for i, x, y in known if x == lang and y == t]
                r = rows[lang, None, caller, metric]
                assert (r.k, r.n) == (sum(f(i) != t for i in own), len(own)) and r.low <= r.rate <= r.high
        wrong = [(called["current"](i) != y, called["candidate"](i) != y) for i, x, y in known if x == lang and not y]
        r = rows[lang, None, "candidate", "false_call"]
        assert (r.b, r.c) == (wrong.count((True, False)), wrong.count((False, True))) and r.superior
    assert rows["unassigned", None, "current", "missed"].k == 1
    before = sorted(map(str, rows.values()))
    call_report.run(spark, cases, truth, folder)
    assert sorted(map(str, call_report.report(spark, folder).collect())) == before
    # one profile anew: the others stay as they are
    stamp = {f"{p.parent.name}/{p.name}": p.stat().st_mtime_ns for p in (tmp_path / "out/rates").glob("profile=*/*.parquet")}
    call_report.run(spark, cases, truth, folder, profiles=["de"])
    now = {f"{p.parent.name}/{p.name}": p.stat().st_mtime_ns for p in (tmp_path / "out/rates").glob("profile=*/*.parquet")}
    assert set(stamp) - set(now) and set(stamp) & set(now)
    assert sorted(map(str, call_report.report(spark, folder).collect())) == before


def test_report_of_nothing(spark, tmp_path):
    cases, truth = str(tmp_path / "docs.parquet"), str(tmp_path / "labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(cases)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(truth)
    assert call_report.run(spark, cases, truth, str(tmp_path / "out"))["cases"] == 0
    assert call_report.report(spark, str(tmp_path / "out")).collect() == []


@pytest.mark.parametrize("name", ["job1_read_intake", "job2_call_report"])
def test_queries_over_larger_tables(spark, name):
    folder = "/root/testdata/sf0.01"
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, folder)
    found = c.execute(catalog.oracle_sql()[name])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([d[0] for d in found.description], found.fetchall())
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_lines_and_configs(spark, tmp_path):
    assert common.settings(read_intake.Settings, str(ROOT / "jobs/read_intake.json")) == read_intake.Settings(percents=[5, 50, 95])
    assert common.settings(call_report.Settings, str(ROOT / "jobs/call_report.json")) == call_report.Settings()
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"least": 1}))
    with pytest.raises(ValueError, match="least"):
        common.settings(read_intake.Settings, str(bad))
    source = str(tmp_path / "reads.parquet")
    spark.createDataFrame(reads(6, 20), SCHEMA).write.parquet(source)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    run = subprocess.run([sys.executable, "-m", "jobs.read_intake", "--source", source, "--output", str(tmp_path / "out")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "read 20 new rows" in run.stderr and f"wrote {tmp_path}/out/reads/batch=0, now 20 rows" in run.stderr
    assert profiles(spark, str(tmp_path / "out")) == expected(reads(6, 20))
