"""What labels mean: profiles, examples, contributions, tests against outside facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import avg_rank, chi2_tail


def entity_table(wide: DataFrame, parts: Sequence[str], years: tuple[int, int], total: str = "total") -> DataFrame:
    """(entity, mean shares, spend, growth): spend is the geometric mean of the total, growth the ratio of two periods' means less 1."""
    a, b = years
    y = F.col("period")
    return wide.groupBy("entity").agg(
        *[F.avg(F.col(p) / F.col(total)).alias(f"share_{p}") for p in parts],
        F.exp(F.avg(F.log(total))).alias("spend"),
        (F.avg(F.when(y == b, F.col(total))) / F.avg(F.when(y == a, F.col(total))) - 1).alias("growth"),
    )


def profiles(table: DataFrame, parts: Sequence[str]) -> DataFrame:
    """A row for each label and one for all: size, mean shares in per cent and over the whole's, geometric spend, median growth in per cent."""
    stats = [F.count(F.lit(1)).alias("n"), *[(100 * F.avg(f"share_{p}")).alias(f"pct_{p}") for p in parts], F.exp(F.avg(F.log("spend"))).alias("spend_geo"), (100 * F.median("growth")).alias("growth_median")]
    each = table.groupBy(F.col("label").cast("string").alias("type")).agg(*stats)
    whole = table.agg(*stats).select(F.lit("all").alias("type"), "*")
    base = whole.select(*[F.col(f"pct_{p}").alias(f"_b_{p}") for p in parts])
    met = each.unionByName(whole).crossJoin(F.broadcast(base))
    return met.select("*", *[(F.col(f"pct_{p}") / F.col(f"_b_{p}")).alias(f"ratio_{p}") for p in parts]).drop(*[f"_b_{p}" for p in parts])


def top_regions(table: DataFrame, k: int = 3) -> DataFrame:
    """(label, regions): the k regions with most of a label, as 'name (n of total)'."""
    n = table.groupBy("label", "region").agg(F.count(F.lit(1)).alias("n"))
    total = table.groupBy("region").agg(F.count(F.lit(1)).alias("total"))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "region"))
    top = n.join(F.broadcast(total), "region").withColumn("r", rn).where(F.col("r") <= k)
    words = F.concat(F.col("region"), F.lit(" ("), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(")"))
    return top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", words.alias("w")))), lambda x: x["w"]), "; ").alias("regions"))


def examples(df: DataFrame, typical: int = 5, borderline: int = 3) -> DataFrame:
    """(label, kind, rank, id, value): rows nearest to their centre, and rows with the least margin to another."""
    long = df.select("id", "label", F.posexplode("vec").alias("f", "x"))
    centre = long.groupBy(F.col("label").alias("other"), "f").agg(F.avg("x").alias("c"))
    centre = centre.groupBy("other").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda x: x["c"]).alias("centre"))
    met = df.crossJoin(F.broadcast(centre))  # as many centres as labels
    d = F.sqrt(F.aggregate(F.zip_with("vec", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    own = F.col("label") == F.col("other")
    row = met.withColumn("d", d).groupBy("id", "label").agg(F.min(F.when(own, F.col("d"))).alias("own"), F.min(F.when(~own, F.col("d"))).alias("rest"))
    row = row.withColumn("margin", F.col("rest") - F.col("own"))

    def best(kind: str, value: str, k: int) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy("label").orderBy(F.round(value, 9), "id"))
        return row.withColumn("rank", rn).where(F.col("rank") <= k).select("label", F.lit(kind).alias("kind"), "rank", "id", F.col(value).alias("value"))

    return best("typical", "own", typical).unionByName(best("borderline", "margin", borderline))


def mirkin(long: DataFrame) -> DataFrame:
    """(label, f, dev, contrib) from (id, label, f, x): a label's share in the data scatter by feature, and its deviation in sigmas."""
    whole = long.groupBy("f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    total = whole.agg(F.sum(F.col("v") * F.col("n")).alias("t"))
    each = long.groupBy("label", "f").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("k"))
    met = each.join(F.broadcast(whole), "f").crossJoin(F.broadcast(total))
    gap = F.col("c") - F.col("m")
    return met.select("label", "f", F.try_divide(gap, F.col("sd")).alias("dev"), (F.col("k") * gap * gap / F.col("t")).alias("contrib"))


def kruskal_wallis(long: DataFrame) -> DataFrame:
    """(indicator, n, k, h, p, eta2) from (indicator, label, x); missing values go first, ties are corrected."""
    rows = long.where(F.col("x").isNotNull())
    ranked = rows.withColumn("r", avg_rank(F.col("x"), ["indicator"]))
    group = ranked.groupBy("indicator", "label").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("m"))
    sums = group.groupBy("indicator").agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    ties = rows.groupBy("indicator", "x").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy("indicator").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    met = sums.join(ties, "indicator").withColumn("h", h).withColumn("eta2", F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k")))
    # a row for each indicator reaches the function
    tail = F.udf(lambda x, d: None if x is None or d < 1 else chi2_tail(x, int(d)), "double")
    return met.select("indicator", "n", "k", "h", tail("h", F.col("k") - 1).alias("p"), "eta2")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation within keys of the rows that have both."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if keys:
        ranked = rows.withColumns({"_x": avg_rank(F.col(x), keys), "_y": avg_rank(F.col(y), keys)})
        return ranked.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))
    from ..functions.columns import table_ranks

    ranked = table_ranks(table_ranks(rows, x, "_x"), y, "_y")
    return ranked.agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def relative_to_median(df: DataFrame, value: str, region: str) -> DataFrame:
    """The value over its region's median."""
    middle = df.groupBy(F.col(region).alias("_g")).agg(F.median(value).alias("_m"))
    return df.join(F.broadcast(middle), F.col(region) == F.col("_g"), "left").withColumn("relative", F.try_divide(value, "_m")).drop("_g", "_m")


def place(df: DataFrame, lat: str, lon: str, other_lat: str, other_lon: str) -> DataFrame:
    """Coordinates, from a second pair where the first lacks one."""
    whole = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return df.withColumns({"lat": F.when(whole, F.col(lat)).otherwise(F.col(other_lat)), "lon": F.when(whole, F.col(lon)).otherwise(F.col(other_lon))})


def describe(found: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(type, text): each profile in words, by its most and least typical part."""
    ratios = F.array_sort(F.array(*[F.struct(F.round(f"ratio_{p}", 9).alias("r"), F.lit(p).alias("p")) for p in parts]))
    low, high = F.get(ratios, F.lit(0)), F.element_at(ratios, -1)
    words = F.format_string("%d entities; most typical %s (%.2f of the mean), least %s (%.2f)", F.col("n"), high["p"], high["r"], low["p"], low["r"])
    return found.select("type", words.alias("text"))
