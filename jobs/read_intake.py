"""Incremental intake of reads: takes the files of a table that are new, and keeps a profile of every sample up to date.

    python -m jobs.read_intake --source TABLE --output FOLDER [--config jobs/read_intake.json]

The file stream's checkpoint (FOLDER/checkpoint) says which files were taken; each call takes what has come since and ends. A batch
becomes FOLDER/reads/batch=N (a row for each read with its status, by sample) and FOLDER/lengths/batch=N (counts by
sample, status and length). FOLDER/profile, by sample, is made from the counts of all batches, so old reads aren't read again. A call
that is cut off does no harm: the next one repeats its last batch into the same folder, with the same files, and makes the profile anew.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strandflow.operators import intake

from .common import log, settings, to_console, written

PROFILE = "reads long, accepted long, no_id long, empty long, length_mismatch long, short long, bases long, {ranks}, n50 long, gc double, depth string, sample string"


@dataclass(frozen=True)
class Settings:
    #: Columns of the table that hold the read's id, its sample, its letters and, optionally, the length that the source states.
    columns: dict = field(default_factory=lambda: {"read_id": "doc_id", "sample": "source", "seq": "text", "length": "n_chars"})
    least_length: int = 200
    percents: tuple = (5, 50, 95)
    #: Input of a batch, so that a first call over a large table works in steps.
    max_bytes_per_batch: int = 64 << 30


def _pattern(source: str) -> str:
    """The same path as a pattern: a file stream takes a single file only by one."""
    source = source.rstrip("/")
    return f"{source[:-1]}[{source[-1]}]"


def run(spark: SparkSession, source: str, output: str, conf: Settings = Settings()) -> dict[str, int]:
    """One call of the job; returns the rows read and written."""
    done = {"read": 0, "reads": 0, "lengths": 0, "profile": 0}
    needed = [c for c in conf.columns.values() if c]
    stream = spark.readStream.schema(spark.read.parquet(source).select(*needed).schema).option("maxBytesPerTrigger", str(conf.max_bytes_per_batch)).parquet(_pattern(source))

    def each(batch: DataFrame, number: int) -> None:
        reads = f"{output}/reads/batch={number}"
        ledger = intake.checked(batch, conf.columns["read_id"], conf.columns["sample"], conf.columns["seq"], conf.columns.get("length"), conf.least_length)
        done["reads"] += written(ledger, reads, "sample")
        own = batch.sparkSession.read.schema(intake.LEDGER).parquet(reads)
        done["lengths"] += written(intake.counted(own), f"{output}/lengths/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{output}/checkpoint").foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    done["read"] = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new rows of %s in %d batches", done["read"], source, sum(p["numInputRows"] > 0 for p in query.recentProgress))
    counts = spark.read.schema(intake.COUNTS).option("recursiveFileLookup", "true").parquet(f"{output}/lengths")
    done["profile"] = written(intake.profile(counts, tuple(conf.percents)), f"{output}/profile", "sample", only_these=True)
    return done


def profile(spark: SparkSession, output: str, conf: Settings = Settings()) -> DataFrame:
    """The profiles of all samples as they stand."""
    return spark.read.schema(PROFILE.format(ranks=", ".join(f"p{p} long" for p in conf.percents))).parquet(f"{output}/profile")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("--source", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = args.parse_args()
    to_console()
    spark = SparkSession.builder.appName("read_intake").getOrCreate()
    try:
        run(spark, given.source, given.output, settings(Settings, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
