"""Aggregates for a report or a client."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mode_largest


def method_table(indices: DataFrame, places: DataFrame, key: Sequence[str], digits: int = 4) -> DataFrame:
    """Indices beside places; a key that either side repeats is an error."""
    for df in (indices, places):
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"{list(key)} isn't unique")
    met = indices.join(places, list(key))
    return met.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in met.dtypes])


def dense(df: DataFrame, entities: DataFrame, periods: DataFrame, fill: dict) -> DataFrame:
    """A row for each entity and period; missing values are filled."""
    grid = entities.select("entity").distinct().crossJoin(F.broadcast(periods.select("period").distinct()))
    return grid.join(df, ["entity", "period"], "left").fillna(fill)


def growth_by_category(long: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Sum of one period over that of another, less 1."""
    a, b = (F.sum(F.when(F.col("period") == y, F.col("value"))) for y in years)
    return long.groupBy("category").agg((F.try_divide(b, a) - 1).alias("growth"))


def type_cards(table: DataFrame, parts: Sequence[str], k: int = 4) -> DataFrame:
    """For each label: most and least typical category, and the k biggest of the entities at least as steady as the median."""
    base = table.agg(*[F.avg(f"share_{p}").alias(f"_{p}") for p in parts])
    means = table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"share_{p}").alias(p) for p in parts]).crossJoin(F.broadcast(base))
    ratios = F.array_sort(F.array(*[F.struct(F.round(F.col(p) / F.col(f"_{p}"), 9).alias("r"), F.lit(p).alias("c")) for p in parts]))
    extremes = means.select("label", "n", F.get(ratios, F.lit(0))["c"].alias("least"), F.element_at(ratios, -1)["c"].alias("most"))
    steady = table.groupBy("label").agg(F.median("steadiness").alias("_m"))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("spend"), "entity"))
    best = table.join(F.broadcast(steady), "label").where("steadiness >= _m").withColumn("r", rn).where(F.col("r") <= k)
    names = best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"].cast("string")), ",").alias("examples"))
    return extremes.join(names, "label", "left")


def nodes_and_links(labels: DataFrame) -> DataFrame:
    """(kind, a_period, a, b_period, b, n): sizes of labels by period, and flows between successive periods."""
    nodes = labels.groupBy("period", "label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.col("period").alias("a_period"), F.col("label").alias("a"), F.lit(None).cast("int").alias("b_period"), F.lit(None).cast("int").alias("b"), "n")
    from .dynamics import transitions

    links = transitions(labels).select(F.lit("link").alias("kind"), F.col("from_period").alias("a_period"), F.col("from_type").alias("a"), F.col("to_period").cast("int").alias("b_period"), F.col("to_type").cast("int").alias("b"), "n")
    return nodes.unionByName(links)


def quantised(df: DataFrame, column: str, steps: int = 1000) -> DataFrame:
    """The column in whole steps, halves to the even one."""
    return df.withColumn(column, F.rint(F.col(column) * steps).cast("int"))


def period_profile(labels: DataFrame, shares: DataFrame) -> DataFrame:
    """(period, label, n, category, mean_share)."""
    return labels.join(shares, ["entity", "period"]).groupBy("period", "label", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("mean_share"))


def modal_label(labels: DataFrame) -> DataFrame:
    return labels.groupBy("entity").agg(mode_largest(F.col("label")).alias("label"))


def flow_pairs(flows: DataFrame) -> DataFrame:
    """Flows (from_type, to_type, n) rolled up to undirected pairs, with both directions and movers' share."""
    moved = flows.where("from_type <> to_type")
    pair = moved.groupBy(F.least("from_type", "to_type").alias("a"), F.greatest("from_type", "to_type").alias("b")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("from_type") < F.col("to_type"), F.col("n")).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("from_type") > F.col("to_type"), F.col("n")).otherwise(0)).alias("down"),
    )
    total = flows.agg(F.sum("n").alias("_t"))
    return pair.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def top_flows(flows: DataFrame, k: int = 3) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("from_type").orderBy(F.desc("n"), "to_type"))
    return flows.where("from_type <> to_type").withColumn("rank", rn).where(F.col("rank") <= k)


def best_by_index(table: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """For each index and key the best value by its direction, with the first method that has it."""
    from .ranking import direction

    one = table.select(*keys, "method", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.lit(direction(c)).alias("sign")) for c in columns])).alias("s")).select(*keys, "method", "s.*")
    rn = F.row_number().over(Window.partitionBy(*keys, "name").orderBy((F.col("value") * F.col("sign")).desc_nulls_last(), "method"))
    return one.withColumn("_r", rn).where("_r = 1").select(*keys, "name", "method", "value")
