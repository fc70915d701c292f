"""Queries over the driver's tables, one for each operator, with their DuckDB SQL.

A query module has ``QUERIES`` (name to function of session and folder) and ``ORACLES``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases made from a number, alike in both engines.
BASES = ("0123456789abcdef", "ACGTACGTACGTACGT")


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folder_of_its_own(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; a local one only where none is named and all runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandflow-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keeper(spark: SparkSession, name: str):
    """Writes a plan's tables into a folder of its own and gives them back as read."""
    folder = folder_of_its_own(spark, name)

    def keep(df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(f"{folder}/{table}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{table}")

    return keep


def dna(number) -> Column:
    """32 bases from a number."""
    number = F.col(number) if isinstance(number, str) else number
    return F.translate(F.md5(number.cast("string").cast("binary")), *BASES)


def dna_sql(number: str) -> str:
    return f"translate(md5(({number})::varchar), '{BASES[0]}', '{BASES[1]}')"
