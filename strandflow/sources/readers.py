"""Sources: FASTQ, FASTA, SAM, VCF, idxstats, truth tables, inventories, structures, strict JSON."""

from __future__ import annotations

import gzip
import io
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SAMPLE_OF = r"([^/]+?)(?:\.fastq|\.fq|\.fasta|\.fa|\.bam)?(?:\.gz)?$"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files through Spark's file systems; one task a file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _lines(content: bytes, path: str):
    raw = gzip.decompress(content) if path.endswith(".gz") else content
    return io.TextIOWrapper(io.BytesIO(raw), encoding="utf-8", newline=None)


def parse_fastq(lines):
    """(name, seq, qual) of four-line records; blank lines before a header are passed over, anything else malformed is an error."""
    it = iter(lines)
    for head in it:
        head = head.rstrip("\r\n")
        if not head.strip():
            continue
        if not head.startswith("@") or not head[1:].split():
            raise ValueError(f"bad header: {head[:60]!r}")
        seq, plus, qual = (next(it, None) for _ in range(3))
        if qual is None:
            raise ValueError(f"truncated record: {head[:60]!r}")
        seq, plus, qual = seq.strip().upper(), plus.rstrip("\r\n"), qual.rstrip("\r\n")
        if not plus.startswith("+"):
            raise ValueError(f"no separator: {head[:60]!r}")
        if len(seq) != len(qual):
            raise ValueError(f"lengths differ: {head[:60]!r}")
        yield head[1:].split()[0], seq, qual


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """reads(sample, ord, name, seq, qual); the sample is the file's name."""

    def work(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                sample = re.search(SAMPLE_OF, p).group(1)
                rows: list[tuple] = []
                for i, r in enumerate(parse_fastq(_lines(content, p))):
                    rows.append((sample, i, *r))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["sample", "ord", "name", "seq", "qual"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["sample", "ord", "name", "seq", "qual"])

    return _files(spark, path).mapInPandas(work, "sample string, ord long, name string, seq string, qual string")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """reads(sample, ord, name, seq, qual) of FASTQ, plain or gzipped, or of BAM, as the file's ending says."""
    if path.endswith(".bam"):
        from .bam import read_bam

        return read_bam(spark, path)
    return read_fastq(spark, path)


def parse_fasta(lines) -> dict[str, str]:
    """Name to sequence; a name that repeats, an empty record or blanks within a sequence are errors."""
    out: dict[str, list[str]] = {}
    name = None
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            name = line[1:].split()[0] if line[1:].split() else ""
            if not name or name in out:
                raise ValueError(f"bad or repeated name: {line!r}")
            out[name] = []
        elif line.strip():
            if name is None or re.search(r"\s", line.strip()):
                raise ValueError(f"bad sequence line: {line[:60]!r}")
            out[name].append(line.strip().upper())
    if any(not x for x in out.values()):
        raise ValueError("empty record")
    return {n: "".join(x) for n, x in out.items()}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    def work(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = [(p, n, s) for n, s in parse_fasta(_lines(content, p)).items()]
                yield pd.DataFrame(rows, columns=["path", "name", "seq"])

    return _files(spark, path).mapInPandas(work, "path string, name string, seq string")


def read_idxstats(spark: SparkSession, path: str) -> DataFrame:
    """(units, mapped) per contig whose name ends in a number; unplaced records are left out."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, len int, mapped long, unmapped long")
    return rows.where("contig <> '*'").select(F.regexp_extract("contig", r"_(\d+)$", 1).try_cast("int").alias("units"), "mapped").where("units is not null")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: mandatory fields and the AS tag; headers and supplementary records (2048) left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    out = rows.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("pos"), f[5].alias("cigar"), f[9].alias("seq"),
        F.regexp_extract("value", r"\tAS:i:(-?\d+)", 1).try_cast("int").alias("score"),
    )
    return out.where(F.col("flag").bitwiseAND(2048) == 0)


def best_scores(sam: DataFrame) -> DataFrame:
    return sam.where("score is not null").groupBy("qname", "rname").agg(F.max("score").alias("score"))


def read_vcf(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Variant rows of one sample: chrom, pos, ref, alt (list), qual, filter, genotype, phase_set, ad, dp; bad genotypes are errors."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not header:
        raise ValueError("no header line")
    names = header[0][0].split("\t")[9:]
    if len(names) != len(set(names)) or (sample is None and len(names) != 1) or (sample is not None and sample not in names):
        raise ValueError(f"samples {names}, wanted {sample}")
    at = 9 + (names.index(sample) if sample else 0)
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(*[f[i].alias(n) for i, n in enumerate(("chrom", "pos", "id", "ref", "_alt", "qual", "filter", "info", "format"))], f[at].alias("_s"))
    keys, values = F.split("format", ":"), F.split("_s", ":")
    field = lambda n: F.get(values, F.array_position(keys, n).cast("int") - 1)
    gt, alts = field("GT"), F.split("_alt", ",")
    index = F.transform(F.split(gt, r"[/|]"), lambda x: F.when(x != ".", x.try_cast("int")))
    valid = gt.rlike(r"^(\d+|\.)([/|](\d+|\.))*$") & ~F.exists(index, lambda x: F.coalesce(x > F.size(alts), F.lit(False)))
    checked = F.when(F.coalesce(valid, F.lit(False)), gt).otherwise(F.raise_error(F.concat(F.lit("bad genotype at "), "pos")).cast("string"))
    return rows.select(
        "chrom", F.col("pos").cast("int").alias("pos"), "ref", alts.alias("alt"), F.col("qual").try_cast("double").alias("qual"), "filter", checked.alias("genotype"),
        F.when(F.array_contains(keys, "PS"), field("PS")).alias("phase_set"), F.when(F.array_contains(keys, "AD"), field("AD")).alias("ad"), F.when(F.array_contains(keys, "DP"), field("DP")).try_cast("int").alias("dp"),
    )


def read_pileup(vcf: DataFrame) -> DataFrame:
    """One row per alternative with its share of the depth; those without numbers are left out. ``vcf`` as of read_vcf."""
    d = F.split("ad", ",")
    each = vcf.select("chrom", "pos", "ref", F.posexplode("alt").alias("i", "alt"), d.alias("_d"), "dp")
    n = F.get("_d", F.col("i") + 1).try_cast("double")
    return each.withColumn("af", F.try_divide(n, F.col("dp").cast("double"))).where("af is not null").select("chrom", "pos", "ref", "alt", "af", "dp")


TRUTH = "read_id string, hap int, molecule long, kind string, strand string, src_start int, src_end int, n_hp_edits int, hp_edits string, detail string"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Simulated reads' truth (TSV, header checked); a read_id that repeats is an error."""
    head = spark.read.text(path).limit(1).collect()
    names = [c.split()[0] for c in TRUTH.split(", ")]
    if not head or head[0][0].split("\t") != names:
        raise ValueError("unexpected header")
    rows = spark.read.csv(path, sep="\t", header=True, schema=TRUTH)
    n = F.count("*").over(W.partitionBy("read_id"))
    unique = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated read: "), "read_id")).cast("boolean")).otherwise(F.lit(True))
    return rows.withColumn("_ok", unique).where("_ok").drop("_ok")


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """(hap, pos, unit) of structure lines ``name<tab>1-2-3...``; markers of mutated units are taken off."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(f[0].alias("hap"), F.posexplode(F.split(F.element_at(f, -1), "-")).alias("pos", "unit")).withColumn("unit", F.regexp_replace("unit", "m$", ""))


def strict_json(text: str):
    """JSON without repeated keys or numbers that aren't finite."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError(f"repeated keys: {sorted({k for k in keys if keys.count(k) > 1})}")
        return dict(items)

    def constant(name):
        raise ValueError(f"not finite: {name}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def inventory(rows: DataFrame) -> DataFrame:
    """Runs of an archive report, checked and sorted into arms: accession, https links, positive sizes, 32-digit digests, unique ids."""
    bad = (
        F.when(~F.coalesce(F.col("run_accession").rlike("^[A-Z]{3}[0-9]+$"), F.lit(False)), "accession")
        .when(~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "url")
        .when(~F.coalesce(F.col("bytes") > 0, F.lit(False)), "bytes")
        .when(~F.coalesce(F.col("md5").rlike("^[0-9a-f]{32}$"), F.lit(False)), "md5")
        .when(F.count("*").over(W.partitionBy("run_accession")) > 1, "repeated")
    )
    arm = F.when(F.col("strategy") == "AMPLICON", "primary_amplicon").when(F.col("strategy") == "WGS", "secondary_wgs").otherwise("excluded")
    return rows.withColumn("problem", bad).withColumn("arm", arm)


def fastq_summary(reads: DataFrame) -> DataFrame:
    """Per sample: reads, bases, nearest-rank length quantiles, digest of the names in order."""
    lengths = F.sort_array(F.collect_list(F.length("seq")))
    g = reads.groupBy("sample").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), lengths.alias("_l"), F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("_n"))
    q = lambda p: F.get("_l", F.floor((F.size("_l") - 1) * F.lit(p) / 100).cast("int"))
    return g.select("sample", "reads", "bases", q(5).alias("p5"), q(50).alias("p50"), q(95).alias("p95"), F.sha2(F.array_join(F.transform("_n", lambda x: x["name"]), "\n"), 256).alias("names_sha256"))
