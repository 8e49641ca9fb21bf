"""Choosing among labellings by several indices at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import avg_rank
from .validity import DIRECTION


def direction(column: str) -> int:
    """The sign of an index; a z score has that of its index."""
    return DIRECTION.get(column.removeprefix("z_"), 1)


def signed(column: str) -> Column:
    return F.col(column) * direction(column)


def borda_best(table: DataFrame, keys: Sequence[str], choice: str, columns: Sequence[str]) -> DataFrame:
    """The choice with the greatest sum of ascending ranks within keys; the least choice of equals."""
    points = sum((avg_rank(signed(c), keys) for c in columns[1:]), avg_rank(signed(columns[0]), keys))
    scored = table.withColumn("points", points)
    return scored.groupBy(*keys).agg(F.max(F.struct("points", (-F.col(choice)).alias("_c"))).alias("b")).select(*keys, (-F.col("b._c")).alias(choice), F.col("b.points").alias("points"))


def grades(table: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int = 3) -> DataFrame:
    """grade_X = ceil(n * rank / rows), best 1; a missing value has the worst rank."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))

    def grade(c: str) -> Column:
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(signed(c).desc_nulls_last()))
        return F.ceil(n * F.when(F.col(c).isNull(), rows).otherwise(rank) / rows).cast("int")

    return table.withColumns({f"grade_{c}": grade(c) for c in columns})


def threshold_places(table: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int = 3, out: str = "threshold_place") -> DataFrame:
    """Places by the count of worst grades, then of the next worse, and so on."""
    counts = {f"n_grade{g}": sum((F.when(F.col(f"grade_{c}") == g, 1).otherwise(0) for c in columns[1:]), F.when(F.col(f"grade_{columns[0]}") == g, 1).otherwise(0)) for g in range(1, n + 1)}
    order = [F.col(f"n_grade{g}") for g in range(n, 1, -1)]
    return table.withColumns(counts).withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(*order)))


def borda(table: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str = "borda") -> DataFrame:
    """Points: sum of ascending ranks less one; places by points, best first."""
    points = sum((avg_rank(signed(c), keys) - 1 for c in columns[1:]), avg_rank(signed(columns[0]), keys) - 1)
    df = table.withColumn(f"{out}_points", points)
    return df.withColumn(f"{out}_place", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(f"{out}_points").desc())))


def ranking(table: DataFrame, keys: Sequence[str], columns: Sequence[str], without: str, n: int = 3) -> DataFrame:
    """Grades, threshold and Borda places with all columns and without one, and whether the leaders agree."""
    fewer = [c for c in columns if c != without]
    df = threshold_places(grades(table, keys, columns, n), keys, fewer, n, "threshold_place_without")
    df = threshold_places(df, keys, columns, n)
    df = borda(borda(df, keys, fewer, "borda_without"), keys, columns)
    w = Window.partitionBy(*keys)
    lead = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) == 1, F.col("method"))).over(w))
    return df.withColumns({"same_threshold_leader": lead("threshold_place") == lead("threshold_place_without"), "same_leader": lead("threshold_place") == lead("borda_place")})


def index_summary(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each method the 'all' row beside the median of the others."""
    whole = F.col("period") == "all"
    return table.groupBy("method").agg(*[x for c in columns for x in (F.max(F.when(whole, F.col(c))).alias(f"{c}_all"), F.median(F.when(~whole, F.col(c))).alias(f"{c}_median"))])


def select_k(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(method, k_all, k_median): best k of each method on the 'all' rows, and on medians over the other periods."""
    whole = borda_best(table.where("period = 'all'"), ["method"], "k", columns).select("method", F.col("k").alias("k_all"))
    middle = table.where("period <> 'all'").groupBy("method", "k").agg(*[F.median(c).alias(c) for c in columns])
    return whole.join(borda_best(middle, ["method"], "k", columns).select("method", F.col("k").alias("k_median")), "method")


def final_labels(labels: DataFrame, method: str, k: int) -> DataFrame:
    """(entity, period, label) of one method and number of clusters."""
    return labels.where((F.col("method") == method) & (F.col("k") == k)).select("entity", "period", "label")
