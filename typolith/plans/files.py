"""Scans and sinks of files as queries: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel
from ..sources import tables
from .base import PY, query, table, with_, yearly


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def gzip_csv_scan(spark, sf):
    """Gzip text with semicolons; codes keep their zeros."""
    n = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    at = tables.scratch(spark, "gzip")
    tables.write_delimited(n, at, ";", "gzip")
    return tables.delimited(spark, at, tables.all_strings(n.columns))


@query("SELECT s_suppkey AS entity, s_name AS name, s_acctbal AS balance FROM supplier")
def csv_index_scan(spark, sf):
    """Text whose first column is an index without a name."""
    s = table(spark, sf, "supplier").select(F.monotonically_increasing_id().alias(" "), F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    at = tables.scratch(spark, "index")
    tables.write_delimited(s, at, files=None)
    kinds = ", ".join(f"{c} {t}" for c, t in s.dtypes[1:])
    return tables.delimited(spark, at, f"i long, {kinds}", ",").drop("i")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS level FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus <> 'P'")
def filtered_csv_scan(spark, sf):
    """Rows of some years and above the lowest level, chosen while the text is read."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("level"))
    at = tables.scratch(spark, "filter")
    tables.write_delimited(o, at, ";", files=None)
    return tables.filtered(tables.delimited(spark, at, tables.all_strings(o.columns)), range(1996, 1999), "level", "P")


@query(with_(PY) + "SELECT entity, period, category, value FROM py")
def parquet_sink(spark, sf):
    """The yearly panel, written and read again."""
    at = tables.scratch(spark, "panel")
    tables.write_parquet(yearly(spark, sf), at)
    return tables.parquet(spark, at, ["entity", "period", "category", "value"])


@query(with_(PY) + "SELECT entity, period, category, value FROM py")
def csv_sink(spark, sf):
    long = yearly(spark, sf).select("entity", "period", "category", "value")
    at = tables.scratch(spark, "csv")
    tables.write_delimited(long, at, files=None)
    return tables.delimited(spark, at, ", ".join(f"{c} {t}" for c, t in long.dtypes), ",")


@query("SELECT n_regionkey AS region, count(*) AS n, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def json_sink(spark, sf):
    """Nested rows as JSON lines, read again by a declared schema."""
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("n_name")).alias("names"))
    at = tables.scratch(spark, "json")
    tables.write_json(n, at)
    return spark.read.schema(n.schema).json(at)


@query("SELECT n_nationkey AS id, sha256(CAST(n_nationkey AS VARCHAR) || chr(1) || n_name) AS sha256 FROM nation")
def row_checksums(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return tables.checksums(n, ["id", "name"]).select("id", "sha256")


@query("SELECT o_orderkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def month_start(spark, sf):
    """Months as text, renamed and made the first day of the month."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    return o.select("entity", panel.month_start(F.col("date")).alias("month"))


_POINTS = "SELECT n_nationkey AS id, n_name AS name, 'Point' AS geometry, -170 + (n_nationkey * 83 % 340) AS lon, -60 + (n_nationkey * 37 % 120) AS lat FROM nation"


@query(_POINTS)
def geojson_scan(spark, sf):
    """Points of a feature collection, written as one file and as a feature a line, and read from both."""
    n = table(spark, sf, "nation")
    point = F.array(F.lit(-170) + F.col("n_nationkey") * 83 % 340, F.lit(-60) + F.col("n_nationkey") * 37 % 120)
    f = n.select(F.lit("Feature").alias("type"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"))
    one, each = tables.scratch(spark, "geo"), tables.scratch(spark, "geo-lines")
    f.agg(F.lit("FeatureCollection").alias("type"), F.collect_list(F.struct("*")).alias("features")).coalesce(1).write.json(one)
    f.write.json(each)
    kinds = f"id: {dict(n.dtypes)['n_nationkey']}, name: string"
    got = tables.geojson(spark, one, kinds).join(tables.geojson(spark, each, kinds, lines=True), ["id", "name", "geometry", "coordinates"])
    at = F.from_json("coordinates", "array<int>")
    return got.select("id", "name", "geometry", at[0].alias("lon"), at[1].alias("lat"))
