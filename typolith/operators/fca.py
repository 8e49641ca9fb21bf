"""Formal concepts over objects with boolean attributes, held as bit masks of a BIGINT."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = ("<=Q1", "<=Me", ">Me", ">Q3")


def quartile_masks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, label, mask): four attributes for each feature, bit 4 * feature + level; quartiles by linear interpolation."""
    cuts = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(f"_{c}") for c in columns])
    met = df.crossJoin(F.broadcast(cuts))
    mask = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        q1, me, q3 = (F.get(f"_{c}", F.lit(i)) for i in range(3))
        for level, cond in enumerate((F.col(c) <= q1, F.col(c) <= me, F.col(c) > me, F.col(c) > q3)):
            mask = mask + F.when(cond, F.lit(1 << (4 * k + level))).otherwise(0)
    keep = [c for c in ("id", "label") if c in df.columns]
    return met.select(*keep, mask.alias("mask"))


def extent(objects: DataFrame, attributes: int) -> DataFrame:
    """The objects that have all attributes."""
    return objects.where(F.col("mask").bitwiseAND(F.lit(attributes)) == attributes)


def intent(objects: DataFrame, all_attributes: int) -> DataFrame:
    """The attributes that all objects have; all attributes if there are no objects."""
    return objects.agg(F.coalesce(F.bit_and("mask"), F.lit(all_attributes)).alias("intent"))


def generators(spark: SparkSession, n: int, most: int = 3, least: int = 0) -> DataFrame:
    """(g, len, pos) for every set of least to most attributes, in order."""
    rows = []
    for size in range(least, most + 1):
        rows += [(sum(1 << a for a in c), size) for c in combinations(range(n), size)]
    return spark.createDataFrame([(g, size, k) for k, (g, size) in enumerate(rows)], "g long, len int, pos int")


def concepts(objects: DataFrame, gens: DataFrame) -> DataFrame:
    """(intent, g, extent): closures with an extent, one for each intent, by its shortest and first generator.

    Masks that occur are counted first, so the join sees distinct masks, not objects.
    """
    masks = objects.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    met = masks.join(F.broadcast(gens), F.col("mask").bitwiseAND(F.col("g")) == F.col("g"))
    closed = met.groupBy("g", "len", "pos").agg(F.bit_and("mask").alias("intent"), F.sum("n").alias("extent"))
    best = closed.groupBy("intent").agg(F.min(F.struct("len", "pos", "g", "extent")).alias("b"))
    return best.select("intent", F.col("b.g").alias("g"), F.col("b.len").alias("len"), F.col("b.extent").alias("extent"))


def stability_bounds(found: DataFrame, objects: DataFrame, n: int) -> DataFrame:
    """Append delta (least), sigma_low and sigma_up to concepts."""
    masks = objects.groupBy("mask").agg(F.count(F.lit(1)).alias("_n"))
    bits = F.sequence(F.lit(0), F.lit(n - 1))
    # concepts are as many as generators at most; masks can be as many as objects
    met = masks.join(F.broadcast(found.select("intent", "extent")), F.col("mask").bitwiseAND(F.col("intent")) == F.col("intent"))
    one = met.select("intent", "extent", "mask", "_n", F.explode(bits).alias("m")).where(F.expr("shiftright(intent, m) & 1 = 0"))
    gap = one.groupBy("intent", "extent", "m").agg(F.sum(F.when(F.expr("shiftright(mask, m) & 1 = 0"), F.col("_n")).otherwise(0)).alias("d"))
    bounds = gap.groupBy("intent").agg(F.min("d").alias("delta"), F.sum(F.pow(F.lit(2.0), -F.col("d"))).alias("_s"))
    out = found.join(bounds, "intent", "left").withColumn("delta", F.coalesce("delta", "extent"))
    low = F.greatest(F.lit(0.0), 1 - F.coalesce("_s", F.lit(0.0)))
    return out.withColumns({"sigma_low": low, "sigma_up": 1 - F.pow(F.lit(2.0), -F.col("delta"))}).drop("_s")


def exact_stability(objects: list[int], attributes: int) -> list[tuple[int, int, float]]:
    """(intent, objects, stability) of every concept of a small context: the share of the extent's subsets with that intent."""
    n = len(objects)
    if n > 20:
        raise ValueError("exact stability takes 20 objects at most")
    closed: dict[int, int] = {}
    for sub in range(1 << n):
        common = attributes
        for k in range(n):
            if sub >> k & 1:
                common &= objects[k]
        closed[common] = closed.get(common, 0) + 1
    out = []
    for common, subsets in closed.items():
        size = sum((o & common) == common for o in objects)
        out.append((common, size, subsets / (1 << size)))
    return sorted(out)


def rules(found: DataFrame, objects: DataFrame, n: int, precision: float = 0.5, most: int = 200, sigma: float = 0.99, each: int = 3) -> DataFrame:
    """Concepts that tell a label: the best by F1 among those precise enough, then stable ones, ``each`` for a label."""
    masks = objects.groupBy("mask", "label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = objects.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = objects.agg(F.count(F.lit(1)).alias("total"))
    met = masks.join(F.broadcast(found), F.col("mask").bitwiseAND(F.col("intent")) == F.col("intent"))
    hits = met.groupBy("intent", "g", "len", "extent", "label").agg(F.sum("_n").alias("n_in")).join(F.broadcast(sizes), "label").crossJoin(F.broadcast(total))
    hits = hits.withColumns({"precision": F.col("n_in") / F.col("extent"), "coverage": F.col("n_in") / F.col("size")})
    hits = hits.withColumns({"f1": 2 * F.col("precision") * F.col("coverage") / (F.col("precision") + F.col("coverage")), "lift": F.col("precision") / (F.col("size") / F.col("total"))})
    hits = hits.where(F.col("precision") >= precision)
    order = [F.round("f1", 12).desc(), F.col("intent")]
    top = hits.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("_r") <= most)
    # a concept that tells two labels has one pair of bounds
    bounds = stability_bounds(top.select("intent", "extent").distinct(), objects, n).drop("extent")
    firm = top.join(bounds, "intent").where(F.col("sigma_low") >= sigma)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return firm.withColumn("rank", rank).where(F.col("rank") <= each).drop("_r", "total")


def readable(mask: Column, features: int) -> Column:
    """The mask without attributes that others imply: <=Me beside <=Q1, >Me beside >Q3."""
    out = mask
    for k in range(features):
        for strong, weak in ((4 * k, 4 * k + 1), (4 * k + 3, 4 * k + 2)):
            out = F.when(mask.bitwiseAND(F.lit(1 << strong)) != 0, out.bitwiseAND(F.lit(~(1 << weak)))).otherwise(out)
    return out
