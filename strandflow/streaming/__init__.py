"""Structured Streaming: length histograms of samples kept up to date as read tables arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lengths import length_model


def length_counts(stream: DataFrame) -> DataFrame:
    """Running counts of (sample, length) over a stream of spans; use it with update or complete output."""
    return stream.groupBy("sample", "length").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, *, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts of (window, sample) by event time; rows later than ``late`` are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), "sample").agg(F.count("*").alias("n"))


def model_of(counts: DataFrame) -> DataFrame:
    """The length model of counted lengths, for use on each micro-batch's state."""
    return length_model(counts.select("sample", "length", "n"))


def watch(spark: SparkSession, folder: str, schema: str, sink, checkpoint: str):
    """Start: arriving parquet files of spans; ``sink(model, batch_id)`` gets the model of all lengths so far."""
    stream = spark.readStream.schema(schema).parquet(folder)
    counts = length_counts(stream)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(model_of(batch), batch_id)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).start()
