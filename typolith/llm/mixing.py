"""Mixing sources to target weights by entropy balancing.

Targets: a budget of ``share`` times all tokens is dealt to the sources by weight; a
source takes at most ``limit`` times its size, and what is over goes to the others by
weight (water-filling).

Rates: of all document rates r in [0, limit], those with the least relative entropy
to 1 that meet every source's token constraint are ``min(limit, exp(lambda * x))``, x
being the document's tokens over the mean of its source and lambda the multiplier of
the source's constraint in the convex dual.  Newton steps on the logarithm of the
dual's gradient, kept in a bracket, solve it.  Documents enter only through the
histogram (source, size, count), so a step costs a pass over distinct sizes.

Copies: expected copies are rounded along ascending sizes with the error carried on,
then the copy whose change brings the source nearest its target is added or removed,
some times over.  Within a size the documents to get one copy more are the first by a
hash bucket and id, with quotas per bucket, so that no size is ever one task.

Sums that decide are of decimals, so reruns agree.  A null text has size 0, a null
source is a source (last in order).  A source without tokens has target 0.  Rows with
equal ids are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, packed

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(hist: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, sid, source_size, mean, least, target) from (source, size, n)."""
    src = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("small"),
    )
    # one row a source: these two windows see sources, never documents
    order = W.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("sid", F.row_number().over(order) - 1)
    src = src.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights)))
    cap = F.col("source_size") * limit
    rising = W.orderBy(cap / F.col("w"), "sid")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.withColumns({"cap": cap, "level": (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))})
    full = F.col("cap") <= F.col("w") * F.col("level")
    src = src.withColumn("common", F.min(F.when(~full, F.struct(cap / F.col("w"), "sid", "level"))).over(everything)["level"])
    return src.select("source", "sid", "source_size", F.try_divide("source_size", "filled").alias("mean"), F.col("small").alias("least"), F.when(full, F.col("cap")).otherwise(F.col("w") * F.col("common")).alias("target"))


def _exact(x: Column) -> Column:
    """Sums of these don't depend on the order of rows."""
    return F.sum(F.round(x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def multipliers(sizes: DataFrame, src: DataFrame, limit: float, chained: int = 3, most: int = 60) -> DataFrame:
    """(sid, lam) from (sid, size, n) and the targets."""
    top = math.log(limit)
    x_least = F.col("least") / F.col("mean")
    state = src.where(F.col("source_size") > 0).select(
        "sid", "mean", "target",
        F.when(F.col("target") >= F.col("source_size"), F.lit(0.0)).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")) / x_least).alias("lo"),
        (F.lit(top) / x_least).alias("hi"),
        (F.col("target") >= F.col("source_size") * limit).alias("done"),
    ).withColumn("lam", F.when(F.col("done"), F.col("hi")).otherwise(F.lit(0.0)))
    state = cut(state, "mix-state")
    for _ in range(0, most, chained):
        state_before = state
        for _ in range(chained):
            row = sizes.join(state, "sid")
            x = F.col("size") / F.col("mean")
            free = F.col("lam") * x < top
            rate = F.when(free, F.exp(F.col("lam") * x)).otherwise(F.lit(limit))
            mass = F.col("n") * F.col("size") * rate
            got = row.groupBy("sid", "mean", "target", "lo", "hi", "done", "lam").agg(_exact(mass).alias("g"), _exact(F.when(free, mass * x).otherwise(0.0)).alias("d"))
            off = F.log(F.col("g")) - F.log(F.col("target"))
            near = F.abs(F.col("g") - F.col("target")) <= 1e-7 * F.col("target") + 1e-3
            lo = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
            hi = F.when(F.col("g") < F.col("target"), F.col("hi")).otherwise(F.col("lam"))
            got = got.select("sid", "mean", "target", lo.alias("lo"), hi.alias("hi"), (F.col("done") | near).alias("done"), "lam", (F.col("lam") - F.try_divide(off * F.col("g"), F.col("d"))).alias("step"))
            inside = F.col("step").isNotNull() & ~F.isnan("step") & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
            state = got.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("step")
        state = cut(state, "mix-state", state_before)
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("sid", "lam")


def _copies(sizes: DataFrame, src: DataFrame, lam: DataFrame, limit: float, repairs: int) -> DataFrame:
    """(sid, size, n, m): m copies for the n documents of a size."""
    row = sizes.join(src.select("sid", "mean", "target"), "sid").join(lam, "sid", "left")
    rate = F.least(F.lit(limit), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(limit)))))
    row = row.withColumn("want", F.when((F.col("size") > 0) & F.col("lam").isNotNull(), F.col("n") * rate).otherwise(0.0))
    by_size = W.partitionBy("sid").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    cum = F.floor(F.sum("want").over(by_size) + 0.5)
    row = row.withColumn("cum", cum).withColumn("m", F.col("cum") - F.coalesce(F.lag("cum").over(W.partitionBy("sid").orderBy("size")), F.lit(0)))
    row = cut(row.select("sid", "size", "n", "target", "m"), "mix-copies")
    for _ in range(repairs):
        row_before = row
        left = row.groupBy("sid").agg((F.max("target") - F.sum(F.col("m") * F.col("size"))).alias("left"))
        one = row.join(left, "sid").where(F.col("size") > 0)
        more = F.when(F.col("m") < F.col("n") * int(limit), F.abs(F.col("left") - F.col("size")))
        less = F.when(F.col("m") > 0, F.abs(F.col("left") + F.col("size")))
        best = one.withColumn("off", F.least(more, less)).where(F.col("off") < F.abs("left")).groupBy("sid").agg(F.min(F.struct("off", "size", F.when(more <= less, 1).when(less.isNull(), 1).otherwise(-1).alias("by"))).alias("b"))
        best = best.select("sid", F.col("b.size").alias("size"), F.col("b.by").alias("by"))
        row = row.join(best, ["sid", "size"], "left").withColumn("m", F.col("m") + F.coalesce("by", F.lit(0))).drop("by")
        row = cut(row, "mix-copies", row_before)
    return row.select("sid", "size", "n", "m")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, repairs: int = 4) -> DataFrame:
    """The rows of docs with size, source_size, target, copies and taken in place of the text."""
    new = (text_col, "size", "source_size", "target", "copies", "taken")
    # texts are read once, to count their words
    rows = docs.select(packed(docs, *new).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows, "mix-rows")
    hist = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    src = cut(targets(hist, weights, share, float(limit)), "mix-targets")
    ids = hist.join(src.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s")))
    sizes = cut(ids.select("sid", "size", "n"), "mix-sizes")
    plan = _copies(sizes, src, multipliers(sizes, src, float(limit)), float(limit), repairs)
    plan = plan.join(src.select(F.col("source").alias("s"), "sid", "source_size", "target"), "sid").withColumnRenamed("size", "z")

    key = ["source", "size", "bucket"]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    quota = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    upto = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    quota = quota.withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0)))
    quota = quota.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    whole = F.floor(F.col("m") / F.col("n"))
    quota = quota.select("s", "z", F.col("bucket").alias("b"), "source_size", "target", whole.alias("whole"), (F.col("m") - whole * F.col("n") - F.col("before")).alias("extra"))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("id")))
    rows = rows.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    copies = (F.col("whole") + (F.col("rn") <= F.col("extra")).cast("int")).cast("long")
    return rows.select("row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
