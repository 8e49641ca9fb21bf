"""Labels over time: modes, runs, episodes, transitions, cluster events, agreement.

Labels are rows (entity, period, label) with periods that order; windows are per entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import mode_largest, mode_smallest

def _by() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("period")


def dominant_label(long: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The place of the greatest category of each entity and period; the first of equals."""
    at = F.array_position(F.array(*map(F.lit, categories)), F.col("category")).cast("int") - 1
    best = F.max_by(at, F.struct("value", -at))
    return long.groupBy("entity", "period").agg(best.alias("label"))


def modes(labels: DataFrame, keys: Sequence[str], largest: bool = True) -> DataFrame:
    pick = mode_largest if largest else mode_smallest
    return labels.groupBy(*keys).agg(pick(F.col("label")).alias("label"))


def by_size(labels: DataFrame) -> DataFrame:
    """Labels renumbered by frequency, the lower old one first among equals."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    # one row a label
    new = counts.select(F.col("label").alias("_l"), (F.row_number().over(Window.orderBy(F.desc("_n"), "label")) - 1).alias("new"))
    return labels.join(F.broadcast(new), F.col("label") == F.col("_l")).select("entity", "period", F.col("new").alias("label"))


def runs(labels: DataFrame) -> DataFrame:
    """(entity, run, label, start, length): maximal stretches of one label."""
    change = F.coalesce((F.col("label") != F.lag("label").over(_by())).cast("int"), F.lit(0))
    numbered = labels.withColumn("_c", change).withColumn("run", F.sum("_c").over(_by()))
    return numbered.groupBy("entity", "run").agg(F.min("label").alias("label"), F.min("period").alias("start"), F.count(F.lit(1)).alias("length"))


def episodes(labels: DataFrame, h: int) -> DataFrame:
    """Runs of h or more; successive ones of one label are one episode."""
    long = runs(labels).where(F.col("length") >= h)
    w = Window.partitionBy("entity").orderBy("run")
    change = F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(0))
    numbered = long.withColumn("_c", change).withColumn("episode", F.sum("_c").over(w))
    return numbered.groupBy("entity", "episode").agg(F.min("label").alias("label"), F.min("start").alias("start"), F.sum("length").alias("length"))


def switches(labels: DataFrame, holds: Sequence[int] = (2, 3)) -> DataFrame:
    """Raw label changes of each entity, and those between episodes for each h."""
    raw = labels.withColumn("_c", (F.col("label") != F.lag("label").over(_by())).cast("int")).groupBy("entity").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("raw"))
    for h in holds:
        n = episodes(labels, h).groupBy("entity").agg((F.count(F.lit(1)) - 1).alias(f"h{h}"))
        raw = raw.join(n, "entity", "left").withColumn(f"h{h}", F.coalesce(f"h{h}", F.lit(0)))
    return raw


def trajectories(labels: DataFrame) -> DataFrame:
    """stable, moved (one change, two periods or more on both sides) or other."""
    r = runs(labels).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least"))
    kind = F.when(F.col("n") == 1, "stable").when((F.col("n") == 2) & (F.col("least") >= 2), "moved").otherwise("other")
    return r.select("entity", kind.alias("trajectory"))


def transitions(labels: DataFrame) -> DataFrame:
    """(from_period, to_period, from_type, to_type, n) of successive periods, with the share of from_type."""
    step = labels.select("entity", F.col("period").alias("from_period"), F.lead("period").over(_by()).alias("to_period"), F.col("label").alias("from_type"), F.lead("label").over(_by()).alias("to_type")).where("to_period is not null")
    n = step.groupBy("from_period", "to_period", "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("from_period", "to_period", "from_type")
    return n.withColumn("share_of_from", F.col("n") / F.sum("n").over(w))


def dense_transitions(labels: DataFrame, periods: Sequence[str] = ("from_period", "to_period")) -> DataFrame:
    """Transitions with a zero for each pair of labels that doesn't occur."""
    t = transitions(labels)
    names = labels.select("label").distinct()
    steps = t.select(*periods).distinct()
    grid = steps.crossJoin(F.broadcast(names.select(F.col("label").alias("from_type")))).crossJoin(F.broadcast(names.select(F.col("label").alias("to_type"))))
    return grid.join(t.drop("share_of_from"), [*periods, "from_type", "to_type"], "left").fillna(0, ["n"])


def stay_share(labels: DataFrame) -> DataFrame:
    """The share of each label's entities that keep it, by pair of periods."""
    t = transitions(labels)
    return t.groupBy("from_period", "to_period", "from_type").agg((F.sum(F.when(F.col("from_type") == F.col("to_type"), F.col("n")).otherwise(0)) / F.sum("n")).alias("stay"))


def crosstab(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(x, y, n): rows of two labellings (entity, label) that meet."""
    y = b.select("entity", *keys, F.col("label").alias("y"))
    return a.select("entity", *keys, F.col("label").alias("x")).join(y, ["entity", *keys]).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))


def monic(cross: DataFrame, tau: float = 0.5, tau_split: float = 0.25, keys: Sequence[str] = ()) -> DataFrame:
    """Cluster events (event, source, target, overlap, size_ratio) between two labellings, from (x, y, n).

    survive and absorb: the best target has tau or more of x; split: two or more targets
    have tau_split or more each and tau together; disappear: neither; emerge: a target that
    nothing became.
    """
    k = list(keys)
    wx, wy = Window.partitionBy(*k, "x"), Window.partitionBy(*k, "y")
    m = cross.withColumns({"nx": F.sum("n").over(wx), "ny": F.sum("n").over(wy)}).withColumn("ov", F.col("n") / F.col("nx"))
    best = m.groupBy(*k, "x", "nx").agg(
        F.max(F.struct("ov", (-F.col("y")).alias("my"), "ny")).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("ov") >= tau_split, F.struct("y", "ov")))).alias("parts"),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["ov"])
    best = best.withColumns({"target": -F.col("b.my"), "matched": F.col("b.ov") >= tau, "splits": (F.size("parts") >= 2) & (total >= tau)})
    into = best.where("matched").select(*k, "x", "target", F.col("b.ov").alias("ov"), (F.col("b.ny") / F.col("nx")).alias("ratio"))
    w = Window.partitionBy(*k, "target")
    group = F.array_sort(F.collect_list("x").over(w))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), "|")
    met = into.withColumn("src", group).select(*k, F.when(F.size("src") == 1, "survive").otherwise("absorb").alias("event"), F.col("x"), text(F.col("src")).alias("source"), F.col("target").cast("string").alias("target"), F.round("ov", 3).cast("string").alias("overlap"), F.round("ratio", 3).alias("size_ratio"))
    split = best.where("not matched and splits").select(*k, F.lit("split").alias("event"), F.col("x"), F.col("x").cast("string").alias("source"), text(F.transform("parts", lambda p: p["y"])).alias("target"), text(F.transform("parts", lambda p: F.round(p["ov"], 3))).alias("overlap"), F.lit(None).cast("double").alias("size_ratio"))
    gone = best.where("not matched and not splits").select(*k, F.lit("disappear").alias("event"), F.col("x"), F.col("x").cast("string").alias("source"), F.lit("").alias("target"), F.round("b.ov", 3).cast("string").alias("overlap"), F.lit(None).cast("double").alias("size_ratio"))
    hit = into.select(*k, F.col("target").alias("y")).unionByName(best.where("not matched and splits").select(*k, F.explode(F.transform("parts", lambda p: p["y"])).alias("y"))).distinct()
    fresh = m.groupBy(*k, "y", "ny").agg(F.max("n").alias("most")).join(hit, [*k, "y"], "left_anti")
    new = fresh.select(*k, F.lit("emerge").alias("event"), F.lit(None).cast("int").alias("x"), F.lit("").alias("source"), F.col("y").cast("string").alias("target"), F.round(F.col("most") / F.col("ny"), 3).cast("string").alias("overlap"), F.lit(None).cast("double").alias("size_ratio"))
    return met.unionByName(split).unionByName(gone).unionByName(new)


def successive(labels: DataFrame) -> DataFrame:
    """(from_period, to_period, x, y, n): crosstabs of all successive periods."""
    return transitions(labels).select("from_period", "to_period", F.col("from_type").alias("x"), F.col("to_type").alias("y"), "n")


def cluster_jaccard(cross: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each label x the best Jaccard similarity with any y."""
    k = list(keys)
    m = cross.withColumns({"nx": F.sum("n").over(Window.partitionBy(*k, "x")), "ny": F.sum("n").over(Window.partitionBy(*k, "y"))})
    return m.groupBy(*k, "x").agg(F.max(F.col("n") / (F.col("nx") + F.col("ny") - F.col("n"))).alias("jaccard"))


def adjusted_rand(cross: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of (x, y, n); 1 where it would divide by 0."""
    k = list(keys)
    c2 = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    rows = cross.groupBy(*k, "x").agg(F.sum("n").alias("m")).groupBy(*k).agg(F.sum(c2("m")).alias("a"))
    cols = cross.groupBy(*k, "y").agg(F.sum("n").alias("m")).groupBy(*k).agg(F.sum(c2("m")).alias("b"))
    both = cross.groupBy(*k).agg(F.sum(c2("n")).alias("s"), F.sum("n").alias("n"))
    met = both.join(rows, k).join(cols, k) if k else both.crossJoin(rows).crossJoin(cols)
    expect = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2.0)
    room = (F.col("a") + F.col("b")) / 2 - expect
    return met.select(*k, F.when(room == 0, 1.0).otherwise((F.col("s") - expect) / F.when(room == 0, 1.0).otherwise(room)).alias("ari"))


def stability(labels: DataFrame) -> DataFrame:
    """One row: share of steps without change, median switches, mean modal share, mean ARI of neighbours, fewest labels."""
    step = labels.withColumn("_c", (F.col("label") != F.lag("label").over(_by())).cast("int"))
    each = step.groupBy("entity").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"), F.count("_c").alias("steps"), F.count(F.lit(1)).alias("n"), mode_smallest(F.col("label")).alias("modal"))
    share = labels.join(each.select("entity", "modal"), "entity").groupBy("entity").agg((F.sum((F.col("label") == F.col("modal")).cast("int")) / F.count(F.lit(1))).alias("modal_share"))
    base = each.agg((1 - F.sum("changes") / F.sum("steps")).alias("stay_share"), F.median("changes").alias("median_switches"))
    ari = adjusted_rand(successive(labels), ["from_period", "to_period"]).agg(F.avg("ari").alias("mean_ari"))
    few = labels.groupBy("period").agg(F.countDistinct("label").alias("k")).agg(F.min("k").alias("least_types"))
    return base.crossJoin(share.agg(F.avg("modal_share").alias("modal_share"))).crossJoin(ari).crossJoin(few)


def pattern_stability(labels: DataFrame) -> DataFrame:
    """(entity, changes, distinct, modal, modal_share); the smallest mode of equals."""
    step = labels.withColumn("_c", (F.col("label") != F.lag("label").over(_by())).cast("int"))
    each = step.groupBy("entity").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"), F.countDistinct("label").alias("distinct"), mode_smallest(F.col("label")).alias("modal"))
    share = labels.join(each.select("entity", "modal"), "entity").groupBy("entity").agg((F.sum((F.col("label") == F.col("modal")).cast("int")) / F.count(F.lit(1))).alias("modal_share"))
    return each.join(share, "entity")


def seasonal_shares(labels: DataFrame, year: Column, season: Column) -> DataFrame:
    """(label, period, year, season, n, share, dev): a label's share of the entities, and its deviation from its mean over periods."""
    n = labels.groupBy("period", "label").agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select("period").distinct().crossJoin(F.broadcast(labels.select("label").distinct()))
    size = labels.groupBy("period").agg(F.count(F.lit(1)).alias("size"))
    full = grid.join(n, ["period", "label"], "left").join(F.broadcast(size), "period").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("size"))
    dev = F.col("share") - F.avg("share").over(Window.partitionBy("label"))
    return full.select("label", "period", year.alias("year"), season.alias("season"), F.coalesce("n", F.lit(0)).alias("n"), "share", dev.alias("dev"))


def seasonality(shares: DataFrame, season: int, years: tuple[int, int]) -> DataFrame:
    """By label: deviation in a season minus the rest, correlation of two years, extreme periods (first of equals), range."""
    here = F.col("season") == season
    base = shares.groupBy("label").agg(
        (F.avg(F.when(here, F.col("dev"))) - F.avg(F.when(~here, F.col("dev")))).alias("season_minus_rest"),
        F.min_by("period", F.struct("share", "period")).alias("least_period"),
        F.max_by("period", F.struct("share", -F.col("period"))).alias("most_period"),
        (F.max("share") - F.min("share")).alias("range"),
    )
    a, b = (shares.where(F.col("year") == y).select("label", "season", F.col("dev").alias(f"d{i}")) for i, y in enumerate(years))
    yoy = a.join(b, ["label", "season"]).groupBy("label").agg(F.corr("d0", "d1").alias("yoy"))
    return base.join(yoy, "label", "left")


def recurrent_switchers(labels: DataFrame, year: Column, season: Column, target: int, years: tuple[int, int]) -> DataFrame:
    """Entities with one base label in both years and another, the same in both, in the season: (base, off, n)."""
    rows = labels.withColumns({"_y": year, "_s": season}).where(F.col("_y").isin(*years))
    base = rows.groupBy("entity", "_y").agg(mode_largest(F.col("label")).alias("base"))
    off = rows.where(F.col("_s") == target).groupBy("entity", "_y").agg(mode_largest(F.col("label")).alias("off"))
    met = base.join(off, ["entity", "_y"]).groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.min("base").alias("base"), F.max("base").alias("base2"), F.min("off").alias("off"), F.max("off").alias("off2"))
    return met.where("k = 2 and base = base2 and off = off2 and base <> off").groupBy("base", "off").agg(F.count(F.lit(1)).alias("n"))


def method_agreement(labels: DataFrame, other: DataFrame) -> DataFrame:
    """Mean ARI of two labellings (entity, period, label) over periods."""
    return adjusted_rand(crosstab(labels, other, ["period"]), ["period"]).agg(F.avg("ari").alias("mean_ari"), F.count(F.lit(1)).alias("n_periods"))


def triple_ties(labels: DataFrame, group: Column) -> DataFrame:
    """Groups of three periods in which an entity has three labels: (grp, n)."""
    t = labels.groupBy("entity", group.alias("grp")).agg(F.countDistinct("label").alias("k"), F.count(F.lit(1)).alias("m"))
    return t.groupBy("grp").agg(F.count_if((F.col("k") == 3) & (F.col("m") == 3)).alias("n_ties"))
