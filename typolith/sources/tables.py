"""Tables in files: Parquet, delimited text, JSON, Markdown; schemas are declared, never inferred."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANEL = "territory_id int, month timestamp, category string, value double, share double"
LABELS = "territory_id int, month string, label int"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="typolith-"))
        held = sc._jsc.sc().getCheckpointDir()
    return f"{held.get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = True) -> DataFrame:
    """Delimited text, gzip by its name; codes stay strings with their zeros."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").csv(path)


def geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """(properties, geometry type, coordinates as JSON text) of the features of a collection, or of a feature a line, which splits."""
    parts = T.StructType.fromDDL(f"type string, properties struct<{properties}>, geometry struct<type: string, coordinates: string>")
    if lines:
        rows = spark.read.schema(parts).json(path)
    else:
        whole = T.StructType([T.StructField("features", T.ArrayType(parts))])
        rows = spark.read.schema(whole).option("multiLine", True).json(path).select(F.inline("features"))
    return rows.select("properties.*", F.col("geometry.type").alias("geometry"), F.col("geometry.coordinates").alias("coordinates"))


def all_strings(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def filtered(df: DataFrame, years: Sequence[int], level: str, lower: str) -> DataFrame:
    """Rows of the years and above the lowest level, as a filter that reaches the scan."""
    return df.where(F.col("year").isin(*map(str, years)) & (F.col(level) != lower))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", compression: str = "none", files: int | None = 1) -> None:
    """One file, for small results, or as many as there are partitions."""
    out = df if files is None else df.coalesce(files)
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested(df: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """(key, json): each key's rows as a JSON array in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return df.groupBy(key).agg(F.to_json(rows).alias("json"))


def markdown(df: DataFrame, formats: Mapping[str, str] | None = None) -> DataFrame:
    """(line): a Markdown row for each row; formats are printf ones, a null is a dash."""
    formats = formats or {}

    def cell(c: str):
        x = F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), F.lit("—")).otherwise(x)

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def checksums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SHA-256 of each row's columns."""
    return df.withColumn("sha256", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256))
