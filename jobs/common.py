"""What the jobs share: configs, logs, writing."""

from __future__ import annotations

import json
import logging
import sys
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame

log = logging.getLogger("jobs")


def settings(kind, path: str | None):
    """A job's settings from its JSON config; unknown names are errors. The config lies with the job, not with the data."""
    values = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)


def written(df: DataFrame, folder: str, *partitions: str, only_these: bool = False) -> int:
    """Write ``df`` as Parquet; log and return the rows that the folder then holds, counted from the files' footers.

    ``only_these``: of a partitioned folder, only the partitions that occur in ``df`` are replaced. Rows of one partition come together in
    few files, and a large partition is split.
    """
    writer = df.hint("rebalance", *partitions).write.partitionBy(*partitions) if partitions else df.write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only_these else "static").parquet(folder)
    n = df.sparkSession.read.schema(df.schema).parquet(folder).count()
    log.info("wrote %s, now %d rows", folder, n)
    return n


def to_console() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(message)s")
