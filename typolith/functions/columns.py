"""Expressions over columns and windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def avg_rank(value: Column, keys: Sequence[str], descending: bool = False) -> Column:
    """Rank from 1 within keys, equal values sharing the mean of theirs; null for null.

    Every group of keys is one window partition; ranks over a whole table go through
    ``table_ranks`` instead.
    """
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), rank + (ties - 1) / 2.0)


def table_ranks(df: DataFrame, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Append the average rank of value over all rows, without a window over all rows.

    Distinct values are counted, cut into buckets at approximate quantiles and ranked
    within a bucket; a bucket's offset is the count of all before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.agg(F.percentile_approx("_v", [k / buckets for k in range(1, buckets)], 10_000).alias("_c"))
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_c", lambda c: c < F.col("_v")))).drop("_c")
    sizes = placed.groupBy("_b").agg(F.sum("_n").alias("_s"))
    # as many rows as there are buckets
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(sizes), "_b")
    ranks = ranks.select("_v", (F.col("_o") + F.col("_w") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def exact_quantile(df: DataFrame, value: str, q: float, width: float = 3e-4) -> float | None:
    """The quantile with linear interpolation, of all rows; null values don't count.

    Approximate quantiles a little below and above bound it; what lies below is counted, and only
    the rows between, a few of ten thousand, are ordered.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    n, ends = rows.agg(F.count(F.lit(1)), F.percentile_approx("x", [max(0.0, q - width), min(1.0, q + width)], 10_000)).first()
    if not n:
        return None
    at = (n - 1) * q
    low, high = math.floor(at), math.ceil(at)
    below, top = rows.agg(F.count_if(F.col("x") < ends[0]), F.count_if(F.col("x") <= ends[1])).first()
    between = rows.where(F.col("x").between(*ends)) if below <= low and high < top else rows
    first = below if below <= low and high < top else 0
    # as many rows as equal values and the width leave
    placed = between.withColumn("r", F.row_number().over(Window.orderBy("x")) - 1 + first)
    got = {r["r"]: r["x"] for r in placed.where(F.col("r").isin(low, high)).collect()}
    return got[low] + (at - low) * (got[high] - got[low])


def zscore(value: Column, window: WindowSpec, clip: float | None = None) -> Column:
    """Standard score by the population deviation; a deviation of 0 counts as 1."""
    sd = F.stddev_pop(value).over(window)
    z = (value - F.avg(value).over(window)) / F.when(sd == 0, 1.0).otherwise(sd)
    return z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def mode_largest(label: Column) -> Column:
    """Most frequent label, the largest of equals."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {_name(label)} DESC)")


def mode_smallest(label: Column) -> Column:
    """Most frequent label, the smallest of equals."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {_name(label)})")


def _name(c: Column) -> str:
    return c._jc.toString()


def haversine(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km from degrees."""
    a, b = F.radians(lat), F.radians(lat0)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon0) - F.radians(lon)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def norm_space(x: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def array_zscore(a: Column, floor: float = 1e-12) -> Column:
    """Standardised array; deviations below the floor count as the floor."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform(a, lambda x: x - mean)
    sd = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x) / n)
    return F.transform(centred, lambda x: x / F.greatest(sd, F.lit(floor)))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom exceeds x): closed form, by recurrence over df."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def chi2_tail_column(x: Column, df: Column, most: int = 64) -> Column:
    """The same for columns and even df, as a sum of built-in terms."""
    h = x / 2
    terms = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (df / 2).cast("int") - 1)), lambda i: F.exp(-h + i * F.log(h) - F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), i)), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
