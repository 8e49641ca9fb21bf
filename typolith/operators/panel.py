"""Panel building: long facts of (entity, period, category, value) to balanced panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_panel(facts: DataFrame, entity: Column, period: Column, category: Column, value: Column) -> DataFrame:
    """Facts summed to one row for each entity, period and category; decimals keep the sums exact."""
    keys = [entity.alias("entity"), period.alias("period"), category.alias("category")]
    return facts.groupBy(*keys).agg(F.sum(value.cast("decimal(18,2)")).cast("double").alias("value"))


def month_start(text: Column) -> Column:
    """'YYYY-MM' as the first day of the month."""
    return F.to_date(F.concat(text, F.lit("-01")))


def pivot(long: DataFrame, categories: Sequence[str], how: str = "first", keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    """Long to wide; ``first`` for unique keys, ``avg`` otherwise."""
    return long.groupBy(*keys).pivot("category", list(categories)).agg(F.expr(f"{how}(value)"))


def with_residual(wide: DataFrame, total: str, parts: Sequence[str], name: str = "other", missing: float | None = 0.0) -> DataFrame:
    """Total minus its parts as one more category; a missing part counts as ``missing``, and null makes the rest null."""
    left = F.col(total)
    for p in parts:
        left = left - (F.col(p) if missing is None else F.coalesce(F.col(p), F.lit(missing)))
    return wide.withColumn(name, left)


def unpivot(wide: DataFrame, categories: Sequence[str], keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    return wide.unpivot(list(keys), list(categories), "category", "value")


def shares(long: DataFrame, total: str | None = None) -> DataFrame:
    """value over the entity's total in the period: a named category, or the sum of all."""
    w = Window.partitionBy("entity", "period")
    base = F.sum("value").over(w) if total is None else F.max(F.when(F.col("category") == total, F.col("value"))).over(w)
    return long.withColumn("share", F.try_divide("value", base))


def versions(directory: DataFrame) -> DataFrame:
    """Versions of an entity (entity, year_from, year_to, code): span, number and sorted distinct codes."""
    return directory.groupBy("entity").agg(
        F.min("year_from").alias("year_from"),
        F.max("year_to").alias("year_to"),
        F.count(F.lit(1)).alias("n_versions"),
        F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def coverage(long: DataFrame, category: str | None = None) -> DataFrame:
    rows = long if category is None else long.where(F.col("category") == category)
    return rows.groupBy("entity").agg(F.countDistinct("period").alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def directory_flags(directory: DataFrame, cover: DataFrame, change_year: int) -> DataFrame:
    """Entities with their coverage, membership, balance and boundary changes."""
    most = cover.agg(F.max("n_periods").alias("_all"))
    df = directory.join(cover, "entity", "left").crossJoin(F.broadcast(most))
    n = F.coalesce("n_periods", F.lit(0))
    return df.select(
        *directory.columns,
        n.alias("n_periods"),
        "first_period",
        "last_period",
        F.col("n_periods").isNotNull().alias("in_panel"),
        (n == F.coalesce("_all", F.lit(-1))).alias("balanced"),
        F.coalesce((F.col("year_from") == change_year) | (F.col("year_to") == change_year), F.lit(False)).alias("boundary_change"),
    )


def balanced(long: DataFrame) -> DataFrame:
    """The rows of entities that have every period of the panel."""
    cover = coverage(long)
    most = cover.agg(F.max("n_periods").alias("_all"))
    full = cover.join(F.broadcast(most), F.col("n_periods") == F.col("_all")).select("entity")
    return long.join(full, "entity", "left_semi")


def interval_join(facts: DataFrame, directory: DataFrame) -> DataFrame:
    """Facts (code, year) with the entity whose version holds: year_from <= year < year_to."""
    d = directory.select(F.col("code").alias("_c"), "entity", "year_from", "year_to")
    met = facts.join(d, (F.col("code") == F.col("_c")) & (F.col("year") >= F.col("year_from")) & (F.col("year") < F.col("year_to")))
    return met.drop("_c", "year_from", "year_to")


def match_versions(facts: DataFrame, directory: DataFrame, key: Sequence[str]) -> DataFrame:
    """Matches by year first; for keys without one, by codes that only ever meant one entity."""
    exact = interval_join(facts, directory).withColumn("match", F.lit("year"))
    rest = facts.join(exact.select(*key), list(key), "left_anti")
    sure = directory.groupBy("code").agg(F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity")).where("_n = 1").drop("_n")
    loose = rest.join(sure, "code").withColumn("match", F.lit("any_version"))
    return exact.unionByName(loose)


def priority_dedup(df: DataFrame, key: Sequence[str], rank: Column, tiebreak: Sequence[str]) -> DataFrame:
    """One row for each key: the best rank, then the least of tiebreak."""
    return latest(df, key, [rank.asc(), *(F.col(t).asc() for t in tiebreak)])


def lenient_number(text: Column) -> Column:
    """A number, or null where the text isn't one."""
    return F.expr(f"try_cast({text._jc.toString()} AS double)")


def section_code(text: Column, pattern: str, look_alikes: tuple[str, str], default: str = "TOTAL") -> Column:
    """The code that the pattern's group takes from a text, with look-alike letters replaced."""
    got = F.translate(F.regexp_extract(text, pattern, 1), *look_alikes)
    return F.when(got == "", F.lit(default)).otherwise(F.coalesce(got, F.lit(default)))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: count, nulls, mean, population deviation, least, quartiles, greatest."""
    stats = [F.count("x").alias("n"), F.count_if(F.isnull("x")).alias("nulls"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least"), F.percentile("x", [0.25, 0.5, 0.75]).alias("q"), F.max("x").alias("greatest")]
    one = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    out = one.groupBy("column").agg(*stats)
    return out.select("column", "n", "nulls", "mean", "sd", "least", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "greatest")


def violations(long: DataFrame, total: str, parts: Sequence[str], directory: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Broken invariants of a panel: repeated keys, values that aren't positive, parts that miss the total, unknown entities."""
    repeated = long.groupBy("entity", "period", "category").count().where("count > 1").select(F.lit("repeated key").alias("rule"), "entity")
    signs = long.where((F.col("value") <= 0) | F.col("value").isNull()).select(F.lit("not positive").alias("rule"), "entity")
    sums = long.groupBy("entity", "period").agg(F.sum(F.when(F.col("category") == total, F.col("value")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("category").isin(*parts), F.col("value")).otherwise(0.0)).alias("p"))
    missed = sums.where(F.abs(F.col("t") - F.col("p")) > tolerance).select(F.lit("parts miss total").alias("rule"), "entity")
    unknown = long.select("entity").distinct().join(directory.select("entity"), "entity", "left_anti").select(F.lit("unknown entity").alias("rule"), "entity")
    return repeated.unionByName(signs).unionByName(missed).unionByName(unknown)
