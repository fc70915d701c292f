"""Report on two callers against known truth: error rates by stratum with exact intervals, paired tests, and whether to adopt.

    python -m jobs.call_report --cases TABLE --truth TABLE --output FOLDER [--config jobs/call_report.json] [--profiles en,de]

Calls are SQL expressions over the cases' columns, given in the config; only their results are shuffled. FOLDER/rates and
FOLDER/paired are partitioned by profile. A call replaces the report; with --profiles it replaces those profiles and leaves the others,
so profiles can be worked out one by one or again. The same input gives the same report, however often.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import callers

from .common import log, settings, to_console, written

RATES = "stratum string, caller string, metric string, k long, n long, rate double, low double, high double, profile string"
PAIRED = "metric string, b long, c long, n long, p double, adjusted double, difference double, upper double, noninferior boolean, superior boolean, profile string"


@dataclass(frozen=True)
class Settings:
    key: str = "doc_id"
    profile: str = "lang"
    stratum: str = "source"
    #: What of a truth row makes a case positive.
    positive: str = "quality = 1"
    #: What of a case makes each caller call it.
    callers: dict = field(default_factory=lambda: {"current": "n_chars >= 300", "candidate": "n_chars >= 300 and not contains(text, '***') and not contains(text, '!!')"})
    margin: float = 0.05
    alpha: float = 0.05


def run(spark: SparkSession, cases: str, truth: str, output: str, conf: Settings = Settings(), profiles: list[str] | None = None) -> dict[str, int]:
    """One call of the job; returns the rows read and written."""
    found = callers.cases(spark.read.parquet(cases), conf.key, conf.profile, conf.stratum, conf.callers)
    counted = callers.cells(found, callers.truths(spark.read.parquet(truth), conf.key, conf.positive))
    some = F.col("profile").isin(profiles) if profiles else F.lit(True)
    # the cells are a few rows for each stratum: kept once, then read by both parts of the report
    done = {"cells": written(counted.where(some), f"{output}/cells", "profile", only_these=bool(profiles))}
    own = spark.read.schema("stratum string, truth boolean, current boolean, candidate boolean, n long, profile string").parquet(f"{output}/cells").where(some)
    done["cases"] = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log.info("read %d cases of %s with a truth in %s", done["cases"], cases, truth)
    done["rates"] = written(callers.rates(own, conf.alpha), f"{output}/rates", "profile", only_these=bool(profiles))
    done["paired"] = written(callers.paired(own, conf.margin, conf.alpha), f"{output}/paired", "profile", only_these=bool(profiles))
    return done


def report(spark: SparkSession, output: str) -> DataFrame:
    """The whole report as it stands: rates (of a profile where stratum is null) with, in the candidate's rows of whole profiles, the paired tests."""
    rates = spark.read.schema(RATES).parquet(f"{output}/rates")
    paired = spark.read.schema(PAIRED).parquet(f"{output}/paired").drop("n").withColumns({"caller": F.lit("candidate"), "whole": F.lit(True)})
    return rates.withColumn("whole", F.col("stratum").isNull()).join(paired, ["profile", "caller", "metric", "whole"], "left").drop("whole")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--cases", "--truth", "--output"):
        args.add_argument(name, required=True)
    args.add_argument("--profiles", help="comma-separated; only these are worked out and replaced")
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = args.parse_args()
    to_console()
    spark = SparkSession.builder.appName("call_report").getOrCreate()
    try:
        run(spark, given.cases, given.truth, given.output, settings(Settings, given.config), given.profiles.split(",") if given.profiles else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
