"""Sinks: FASTA and BED text, keyed upserts, and a ledger whose entries are sealed by digests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import upsert


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60) -> None:
    """One record per row, lines of ``width`` bases."""
    lines = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), lines)).write.mode("overwrite").text(path)


def bed(df: DataFrame, *columns: str) -> DataFrame:
    """Tab-joined feature lines (contig, start, end and further columns), 0-based half-open; null is a dot."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("contig", "start", "end", *columns)]).alias("value"))


def chains(units: DataFrame) -> DataFrame:
    """Structure lines of (hap, pos, unit)."""
    listed = units.groupBy("hap").agg(F.sort_array(F.collect_list(F.struct("pos", "unit"))).alias("l"))
    return listed.select(F.concat(F.col("hap"), F.lit("\t"), F.array_join(F.transform("l", lambda x: x["unit"]), "-")).alias("value"))


def canonical_sha256(df: DataFrame, *columns: str) -> DataFrame:
    """Adds the digest of the named columns as JSON in order of their names."""
    return df.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


class Table:
    """A keyed table in a folder: each version is written beside the others and then named, so readers never see half of one."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.folder}/v={v[-1]}") if v else None

    def merge(self, new: DataFrame) -> DataFrame:
        """Upsert by key; the new version appears by one rename."""
        old, v = self.read(), self.versions()
        out = new if old is None else upsert(old, new, self.keys)
        draft, final = f"{self.folder}/_draft-{uuid.uuid4().hex}", f"{self.folder}/v={v[-1] + 1 if v else 1}"
        out.write.mode("overwrite").parquet(draft)
        jvm, fs = self._fs()
        # a rename into a version that another writer has made would put the draft inside it
        if fs.exists(jvm.org.apache.hadoop.fs.Path(final)) or not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(final)):
            raise RuntimeError(f"{final} exists")
        return self.read()


class Files:
    """Small texts in a folder of any file system that Spark writes: atomic replacement and creation that fails if the file is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false, and nothing is written, if it is there already."""
        draft = f"_{name}-{uuid.uuid4().hex}"
        self._write(draft, text)
        if not self.fs.exists(self._path(name)) and self.fs.rename(self._path(draft), self._path(name)):
            return True
        self.fs.delete(self._path(draft), False)
        return False

    def replace(self, name: str, text: str) -> None:
        """Readers see the old text, none for a moment, or the new one, never a part."""
        draft = f"_{name}-{uuid.uuid4().hex}"
        self._write(draft, text)
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(self._path(draft), self._path(name)):
            raise RuntimeError(f"{name} could not be put in place")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), False)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        found = [f.getPath().getName() for f in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []
        return sorted(n for n in found if not n.startswith(("_", ".")))


class Preregistration:
    """An append-only ledger of decision rules; the sealed data may be scored once, under the rule that unlocked them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def register(self, rule: str) -> str:
        """The rule's digest; a rule that is there already is not written again."""
        digest = hashlib.sha256(rule.encode()).hexdigest()
        self.files.create(f"rule-{digest}", rule)
        return digest

    def require(self, rule: str) -> str:
        digest = hashlib.sha256(rule.encode()).hexdigest()
        if self.files.read(f"rule-{digest}") != rule:
            raise ValueError("the rule was not registered before")
        return digest

    def unlock(self, rule: str) -> str:
        """Mark the first evaluation of the sealed data; only the rule that did it may do it again."""
        digest = self.require(rule)
        self.files.create("first-evaluation", digest)
        if self.files.read("first-evaluation") != digest:
            raise ValueError("the sealed data were scored under another rule")
        return digest


def write_run(tables: dict[str, DataFrame], folder: str) -> None:
    """A run's tables, each partitioned by sample, and a summary of counts written last: a run without it is not complete.

    The summary of an earlier run goes first, so a run that breaks off doesn't look complete.
    """
    Files(next(iter(tables.values())).sparkSession, folder).remove("summary.json")
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("sample") if "sample" in df.columns else out).parquet(f"{folder.rstrip('/')}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}").count() for name in sorted(tables)}
    Files(spark, folder).replace("summary.json", json.dumps({"status": "completed", "rows": counts}, sort_keys=True))


def public_view(ledger: DataFrame, secret: list[str]) -> DataFrame:
    """The ledger without its sealed columns, and a digest of what they hold."""
    sealed = F.sha2(F.to_json(F.struct(*sorted(secret))), 256)
    return ledger.withColumn("sealed_sha256", sealed).drop(*secret)
