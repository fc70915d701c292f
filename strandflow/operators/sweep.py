"""Sweeps over cases and settings that can be taken up again: a point is worked out once, and what fails is a row.

A point's key is a hash of what goes into it, so a changed input or another version of the work is another point, and an
equal one isn't worked out again, whichever case asks for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import spread
from .records import pending

COMPLETED, FAILED = "completed", "failed"
#: Seconds, and rows, after which worked out points leave their task.
HAND_OUT, MOST = 1.0, 4096


def keyed(cases: DataFrame, inputs: list[str], version: str, name: str = "key") -> DataFrame:
    """``cases`` with a SHA-256 of the version and the inputs by name; null is a value of its own. The inputs' order doesn't matter."""
    whole = F.to_json(F.struct(F.lit(version).alias("version"), F.struct(*sorted(inputs)).alias("inputs")), {"ignoreNullFields": "false"})
    return cases.withColumn(name, F.sha2(whole, 256))


def attempted(points: DataFrame, inputs: list[str], work: Callable[[dict], dict], result: str) -> DataFrame:
    """(key, status, error, result...): ``work`` of each point's inputs. An exception makes a failed row of null results that says what it was.

    Rows are handed out every ``HAND_OUT`` seconds, so points that are done leave the task while others are still worked on.
    """
    names = [c.strip().split()[0].strip("`") for c in _columns(result)]

    def each(batches):
        rows, since = [], time.monotonic()
        for pdf in batches:
            for key, *values in pdf[["key", *inputs]].astype(object).where(pdf[["key", *inputs]].notna(), None).itertuples(index=False, name=None):
                try:
                    found, status, error = work(dict(zip(inputs, values))), COMPLETED, None
                    if set(found) != set(names):
                        raise ValueError(f"results {sorted(found)} instead of {sorted(names)}")
                except Exception as e:  # noqa: BLE001
                    found, status, error = dict.fromkeys(names), FAILED, f"{type(e).__name__}: {e}"
                rows.append({"key": key, "status": status, "error": error, **found})
                if len(rows) >= MOST or time.monotonic() - since >= HAND_OUT:
                    yield pd.DataFrame(rows, dtype=object)
                    rows, since = [], time.monotonic()
        if rows:
            yield pd.DataFrame(rows, dtype=object)

    return points.mapInPandas(each, f"key string, status string, error string, {result}")


def _columns(schema: str) -> list[str]:
    """A schema's columns, told apart by commas outside of brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[begin:i])
            begin = i + 1
    return [*out, schema[begin:]]


def results(spark: SparkSession, folder: str, result: str) -> DataFrame | None:
    """All rows of a sweep's folder, with the round that made each; null if there is none."""
    try:
        return spark.read.schema(f"key string, status string, error string, {result}, round int").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def sweep(cases: DataFrame, folder: str, inputs: list[str], work: Callable[[dict], dict], result: str, *, version: str, split: str | None = None, sealed: tuple[str, ...] = ("sealed",), retry: bool = False) -> DataFrame:
    """``cases`` with key, status, error, results and round, those worked out before taken from ``folder``.

    Only keys without a result are worked out, in tasks of any size, and appended as one more round; with ``retry`` failed ones are worked out
    again, and the latest round counts. A round that broke off leaves nothing and is made anew. Cases whose ``split`` is sealed are refused before any work is done.
    """
    spark = cases.sparkSession
    if split is not None and (found := cases.where(F.col(split).isin(*sealed)).select(split).first()):
        raise ValueError(f"the split {found[0]!r} is sealed")
    clash = {"key", "status", "error", "round", *(c.strip().split()[0].strip("`") for c in _columns(result))} & set(cases.columns)
    if clash:
        raise ValueError(f"columns of the cases that results need: {sorted(clash)}")
    asked = keyed(cases, inputs, version)
    before = results(spark, folder, result)
    open_ = asked.select("key", *inputs).dropDuplicates(["key"])
    last = 0
    if before is not None:
        last = before.agg(F.max("round")).first()[0] or 0
        open_ = pending(open_, before.where(F.col("status") == COMPLETED) if retry else before, "key")
    if not open_.isEmpty():
        attempted(spread(open_), inputs, work, result).withColumn("round", F.lit(last + 1)).write.mode("append").parquet(folder)
    made = results(spark, folder, result)
    if made is None:
        made = spark.createDataFrame([], f"key string, status string, error string, {result}, round int")
    row = F.struct(*[c for c in made.columns if c != "key"])
    latest = made.groupBy("key").agg(F.max_by(row, "round").alias("_row")).select("key", "_row.*")
    return asked.join(latest, "key", "left")
