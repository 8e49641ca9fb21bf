"""Features of a wide panel: shares, levels, growth, trends, standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import avg_rank, table_ranks, zscore


def fill_from_sample(ids: DataFrame, attribute: DataFrame, name: str) -> DataFrame:
    """The attribute for the sample's ids; missing ones get the least of the sample's."""
    met = ids.join(attribute, "entity", "left")
    least = met.agg(F.min(name).alias("_m"))
    return met.crossJoin(F.broadcast(least)).withColumn(name, F.coalesce(name, "_m")).drop("_m")


def raw(wide: DataFrame, parts: Sequence[str], total: str = "total", static: str | None = None) -> DataFrame:
    """Shares of the parts, log of the total, its growth over the period before (0 at first)."""
    by = Window.partitionBy("entity").orderBy("period")
    level = F.log(total)
    out = wide.withColumn("level", level)
    growth = F.coalesce(F.col("level") - F.lag("level").over(by), F.lit(0.0))
    keep = [static] if static else []
    return out.select("entity", "period", *[(F.col(p) / F.col(total)).alias(f"share_{p}") for p in parts], "level", growth.alias("growth"), *keep)


def standardise(df: DataFrame, columns: Sequence[str], keys: Sequence[str], clip: float | None = 4.0) -> DataFrame:
    """Standard scores within keys."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: zscore(F.col(c), w, clip) for c in columns})


def standardise_all(df: DataFrame, columns: Sequence[str], clip: float | None = 4.0) -> DataFrame:
    """Standard scores over the whole table: its moments are one row, joined to all."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    met = df.crossJoin(F.broadcast(stats))

    def z(c: str):
        sd = F.col(f"_s_{c}")
        x = (F.col(c) - F.col(f"_m_{c}")) / F.when(sd == 0, 1.0).otherwise(sd)
        return x if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), x))

    return met.select(*[c for c in df.columns if c not in columns], *[z(c).alias(c) for c in columns])


def mean_and_trend(df: DataFrame, columns: Sequence[str], time) -> DataFrame:
    """Mean and least-squares slope per unit of time of each column, by entity."""
    df = df.withColumn("_t", time)
    return df.groupBy("entity").agg(*[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.regr_slope(c, "_t").alias(f"trend_{c}"))])


def share_series(long: DataFrame) -> DataFrame:
    """Shares of each category in period order, as an array."""
    rows = long.groupBy("entity", "category").agg(F.array_sort(F.collect_list(F.struct("period", "share"))).alias("s"))
    return rows.select("entity", "category", F.transform("s", lambda x: x["share"]).alias("series"))


def deseasonalised(long: DataFrame) -> DataFrame:
    """Log value minus the mean log of all entities in the same period and category."""
    x = F.log("value")
    return long.withColumn("x", x - F.avg(x).over(Window.partitionBy("period", "category")))


def series(long: DataFrame, value: str = "x") -> DataFrame:
    rows = long.groupBy("entity", "category").agg(F.array_sort(F.collect_list(F.struct("period", value))).alias("s"))
    return rows.select("entity", "category", F.transform("s", lambda p: p[value]).alias("series"))


def rank_percentile(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank over the whole table, as a share of its rows."""
    n = df.agg(F.count(column).alias("_rows"))
    return table_ranks(df, column, out).crossJoin(F.broadcast(n)).withColumn(out, F.col(out) / F.col("_rows")).drop("_rows")


def growth_autocorrelation(growth: DataFrame) -> DataFrame:
    """Spearman correlation of growth with the next period's, for each pair of periods; periods are consecutive numbers."""
    after = growth.select("entity", (F.col("period") - 1).alias("period"), F.col("growth").alias("after"))
    met = growth.join(after, ["entity", "period"])
    met = met.withColumns({"r": avg_rank(F.col("growth"), ["period"]), "s": avg_rank(F.col("after"), ["period"])})
    return met.groupBy("period").agg(F.corr("r", "s").alias("rho"), F.count(F.lit(1)).alias("n"))
