"""The registry of queries, and the panels they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dynamics, panel
from ..sources.tables import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PARTS = CATEGORIES[:5]


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return line.join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


#: Panels written by this application: (application, tables, name) to where they are.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A panel that many queries start from: written once to the shared folder, then read; the tables don't change meanwhile."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        df, at = make(), scratch(spark, f"panel-{name}")
        df.write.parquet(at)
        _WRITTEN[key] = at
    return spark.read.parquet(_WRITTEN[key])


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier, year, part type."""
    return written(spark, sf, "yearly", lambda: panel.long_panel(sales(spark, sf), F.col("l_suppkey"), F.year("l_shipdate"), F.col("p_type"), F.col("l_extendedprice")))


def quarter_number(ts: str = "l_shipdate") -> Column:
    return F.year(ts) * 4 + F.quarter(ts) - 1


def quarterly(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier, quarter (4 * year + quarter - 1), part type."""
    return written(spark, sf, "quarterly", lambda: panel.long_panel(sales(spark, sf), F.col("l_suppkey"), quarter_number(), F.col("p_type"), F.col("l_extendedprice")))


def wide_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, period, a column for each type, total)."""
    long = yearly(spark, sf)
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    return panel.pivot(long, CATEGORIES).join(long.groupBy("entity", "period").agg(total), ["entity", "period"])


def labels_quarterly(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's greatest type by quarter."""
    return dynamics.dominant_label(quarterly(spark, sf), CATEGORIES)


def labels_yearly(spark: SparkSession, sf: str) -> DataFrame:
    return dynamics.dominant_label(yearly(spark, sf), CATEGORIES)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vec, label) of the embeddings."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("long").alias("label"))


_CASE = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CATEGORIES)) + " END"


def _panel(name: str, period: str) -> str:
    return f"{name} AS (SELECT l_suppkey AS entity, CAST({period} AS INT) AS period, p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _labels(name: str, source: str) -> str:
    return f"{name} AS (SELECT entity, period, CAST({_CASE} AS INT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY value DESC, category) AS rn FROM {source}) WHERE rn = 1)"


PY = _panel("py", "year(l_shipdate)")
PQ = _panel("pq", "year(l_shipdate) * 4 + quarter(l_shipdate) - 1")
WY = "wy AS (SELECT entity, period, " + ", ".join(f"max(CASE WHEN category = '{c}' THEN value END) AS {c}" for c in CATEGORIES) + ", CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM py GROUP BY entity, period)"
LY = _labels("ly", "py")
LQ = _labels("lq", "pq")
EM = "em AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label FROM embeddings)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
