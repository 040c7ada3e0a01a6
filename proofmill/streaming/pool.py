"""Pooled tallies of a stream of score files: sums by key, which new rows only add to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TALLIES = "tag string, extraction_id string, key string, num long, den long, scored_at timestamp"


def read_tallies(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TALLIES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pooled(stream: DataFrame) -> DataFrame:
    """By tag and key, over all time: for output mode update or complete."""
    return stream.groupBy("tag", "key").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def pooled_by_window(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """By tag, key and time; a window is final once the watermark has passed it."""
    timed = stream.withWatermark("scored_at", late)
    found = timed.groupBy(F.window("scored_at", size), "tag", "key").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return found.select("tag", "key", F.col("window.start").alias("start"), "num", "den")
