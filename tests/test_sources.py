"""Readers, writers, settings and streams."""

import gzip

import pytest


def test_fastq(spark, tmp_path):
    from strandflow.sources.readers import fastq_summary, parse_fastq, read_fastq

    text = "@r1 x\nacgt\n+\n5555\n\n@r2\nAC\n+r2\n55\n"
    (tmp_path / "s1.fastq").write_text(text)
    (tmp_path / "s2.fq.gz").write_bytes(gzip.compress(text.encode()))
    got = sorted(map(tuple, read_fastq(spark, str(tmp_path)).collect()))
    assert got == [(s, i, n, q, "5" * len(q)) for s in ("s1", "s2") for i, (n, q) in enumerate((("r1", "ACGT"), ("r2", "AC")))]
    row = fastq_summary(read_fastq(spark, str(tmp_path / "s1.fastq"))).first()
    assert (row.reads, row.bases, row.p50) == (2, 6, 2)
    for bad in ("r1\nA\n+\n5\n", "@r1\nA\n5\n+\n", "@r1\nA\n+\n55\n", "@r1\nA\n+\n"):
        with pytest.raises(ValueError):
            list(parse_fastq(bad.splitlines()))


def test_fasta_sam_vcf(spark, tmp_path):
    from strandflow.sources import readers as R

    (tmp_path / "a.fa").write_text(">c1 note\nACGT\nAC\n>c2\nTT\n")
    assert {(r.name, r.seq) for r in R.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("c1", "ACGTAC"), ("c2", "TT")}
    for bad in (">a\nA\n>a\nC\n", ">a\n>b\nA\n", ">a\nA C\n", "ACGT\n"):
        with pytest.raises(ValueError):
            R.parse_fasta(bad.splitlines())
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr1\t0\tc_20\t5\t60\t4M\t*\t0\t0\tACGT\t5555\tAS:i:9\nr1\t16\tc_20\t9\t60\t4M\t*\t0\t0\tACGT\t5555\tAS:i:12\nr1\t2048\tc_20\t5\t60\t4M\t*\t0\t0\tACGT\t5555\tAS:i:99\n")
    assert [tuple(r) for r in R.best_scores(R.read_sam(spark, str(tmp_path / "x.sam"))).collect()] == [("r1", "c_20", 12)]
    (tmp_path / "i.txt").write_text("contig_20\t1200\t30\t0\ncontig_21\t1260\t5\t1\n*\t0\t0\t7\n")
    assert {tuple(r) for r in R.read_idxstats(spark, str(tmp_path / "i.txt")).collect()} == {(20, 30), (21, 5)}
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"
    (tmp_path / "v.vcf").write_text(head + "c\t5\t.\tA\tAC,G\t30\tPASS\t.\tGT:AD:DP\t1/2:1,6,3:10\n")
    v = R.read_vcf(spark, str(tmp_path / "v.vcf"))
    assert v.first().genotype == "1/2" and v.first().alt == ["AC", "G"]
    assert {(r.alt, r.af) for r in R.read_pileup(v).collect()} == {("AC", 0.6), ("G", 0.3)}
    (tmp_path / "w.vcf").write_text(head + "c\t5\t.\tA\tC\t30\tPASS\t.\tGT\t0/3\n")
    with pytest.raises(Exception, match="bad genotype"):
        R.read_vcf(spark, str(tmp_path / "w.vcf")).collect()


def test_strict_inputs(spark, tmp_path):
    from strandflow.config import DecisionSettings, ReadSettings, from_dict
    from strandflow.sources import readers as R

    assert R.strict_json('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            R.strict_json(bad)
    assert from_dict(DecisionSettings, {"legacy_reads": 20}).legacy_reads == 20
    for bad in ({"margin": True}, {"margin": -1}, {"nothing": 1}, {"least_units": 200}):
        with pytest.raises(ValueError):
            from_dict(ReadSettings, bad)
    rows = [("ERR1", "https://x/a", 5, "0" * 32, "AMPLICON"), ("ERR2", "ftp://x", 5, "0" * 32, "WGS"), ("bad", "https://x", 5, "0" * 32, "RNA")]
    got = R.inventory(spark.createDataFrame(rows, "run_accession string, url string, bytes long, md5 string, strategy string"))
    assert {(r.run_accession, r.problem, r.arm) for r in got.collect()} == {("ERR1", None, "primary_amplicon"), ("ERR2", "url", "secondary_wgs"), ("bad", "accession", "excluded")}
    (tmp_path / "chains.txt").write_text("h1\t1-2-Xm-9\n# note\nh2\t1-9\n")
    c = R.read_chains(spark, str(tmp_path / "chains.txt"))
    from strandflow.sources.writers import chains

    assert {r.value for r in chains(c).collect()} == {"h1\t1-2-X-9", "h2\t1-9"}


def test_sinks(spark, tmp_path):
    from strandflow.sources.readers import read_fasta
    from strandflow.sources.writers import Table, bed, canonical_sha256, public_view, write_fasta

    df = spark.createDataFrame([("a", "ACGT" * 40), ("b", "T")], "name string, seq string")
    write_fasta(df, str(tmp_path / "fa"))
    assert {(r.name, r.seq) for r in read_fasta(spark, str(tmp_path / "fa" / "*.txt")).collect()} == {("a", "ACGT" * 40), ("b", "T")}
    t = Table(spark, f"file://{tmp_path}/t", ["k"])
    t.merge(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"))
    now = t.merge(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"))
    assert {tuple(r) for r in now.collect()} == {(1, "x"), (2, "z"), (3, "w")} and t.versions() == [1, 2]
    assert canonical_sha256(now, "k", "v").select("sha256").distinct().count() == 3
    assert public_view(now, ["v"]).columns == ["k", "sealed_sha256"]
    f = spark.createDataFrame([("c", 0, 60, None)], "contig string, start int, end int, name string")
    assert bed(f, "name").first().value == "c\t0\t60\t."


def test_streaming_equals_batch(spark, tmp_path):
    from strandflow.operators.lengths import length_model
    from strandflow.streaming import watch

    rows = [("s", 1200 + (i % 7)) for i in range(60)] + [("s", 1800 + (i % 9)) for i in range(40)] + [("t", 900)] * 20
    spans = spark.createDataFrame(rows, "sample string, length long")
    folder = tmp_path / "in"
    spans.limit(50).coalesce(1).write.parquet(str(folder))
    got = {}
    q = watch(spark, str(folder), "sample string, length long", lambda m, i: got.update({i: {tuple(r) for r in m.collect()}}), str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        spans.exceptAll(spans.limit(50)).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    finally:
        q.stop()
    want = {tuple(r) for r in length_model(spark.read.parquet(str(folder))).collect()}
    assert got[max(got)] == want and sum(r[4] is None for r in want) == 3


def test_late_rows_are_left_out(spark, tmp_path):
    from strandflow.streaming import windowed_counts

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, 'a' as sample from range(30)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, sample string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [5] * 6


def test_preregistered_rules_and_files(spark, tmp_path):
    import pytest
    from strandflow.sources.writers import Files, Preregistration

    files = Files(spark, f"file://{tmp_path}/f")
    assert files.create("a", "one") and not files.create("a", "two") and files.read("a") == "one"
    files.replace("a", "zwei\u00e9")
    assert files.read("a") == "zwei\u00e9" and files.read("b") is None and files.names() == ["a"]
    ledger = Preregistration(spark, f"file://{tmp_path}/ledger")
    with pytest.raises(ValueError):
        ledger.require("rule 1")
    assert ledger.register("rule 1") == ledger.register("rule 1") == ledger.require("rule 1")
    ledger.register("rule 2")
    assert ledger.unlock("rule 1") == ledger.unlock("rule 1")
    with pytest.raises(ValueError):
        ledger.unlock("rule 2")


def test_runs_and_their_observations(spark, tmp_path):
    import json

    from strandflow.sources.results import observation_status, read_observations
    from strandflow.sources.writers import write_run

    df = spark.createDataFrame([("s1", "a"), ("s2", "b")], "sample string, seq string")
    write_run({"alleles": df}, f"file://{tmp_path}/run")
    assert json.loads((tmp_path / "run/summary.json").read_text()) == {"status": "completed", "rows": {"alleles": 2}}
    assert spark.read.parquet(f"file://{tmp_path}/run/alleles").where("sample = 's2'").first().seq == "b"
    for name, text in {"s1": {"classifications": {"a1": {}}, "alleles": {"a1": {}, "a2": {}}}, "s2": {"classifications": {"x": {}}, "alleles": {}}, "s3": []}.items():
        (tmp_path / "res" / name).mkdir(parents=True)
        (tmp_path / "res" / name / "summary.json").write_text(json.dumps(text))
    found = {r["sample"]: (r["summary"], r["predictions"]) for r in read_observations(spark, f"file://{tmp_path}/res").collect()}
    assert found == {"s1": ("valid", 1), "s2": ("invalid", 0), "s3": ("invalid", 0)}
    rows = [("timeout", None, "completed", "valid", 2, False), (None, 1, "insufficient_evidence", None, 0, False), (None, 0, None, "valid", 2, True), (None, None, None, None, 0, False)]
    got = observation_status(spark.createDataFrame(rows, "recorded string, exit_code int, sidecar string, summary string, predictions int, unsettled boolean")).collect()
    assert [r.observed for r in got] == ["execution_failed", "insufficient_evidence", "ambiguous_reconstruction", "not_attempted"]
