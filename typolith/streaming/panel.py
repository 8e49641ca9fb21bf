"""Streams of facts into panel cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def panel_cells(events: DataFrame, late: str = "2 days", width: str = "7 days") -> DataFrame:
    """(period, entity, category, value): sums by window; rows later than the watermark are dropped, cells end with it."""
    cells = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("user_id"), F.col("event_type"))
    out = cells.agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("period"), F.col("user_id").alias("entity"), F.col("event_type").alias("category"), "value", "n")
