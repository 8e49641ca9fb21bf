"""Labels over time, and choosing among labellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dynamics, methods, ranking, serving
from .base import LQ, LY, PQ, PY, labels_quarterly, labels_yearly, query, r6, table, with_


def _mode(order: str, source: str = "lq") -> str:
    return f"SELECT entity, label FROM (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, label {order}) AS rn FROM {source} GROUP BY entity, label) WHERE rn = 1"


@query(with_(PQ, LQ) + "SELECT * FROM lq")
def dominant_label(spark, sf):
    return labels_quarterly(spark, sf)


@query(with_(PQ, LQ) + _mode("DESC"))
def mode_largest(spark, sf):
    return dynamics.modes(labels_quarterly(spark, sf), ["entity"])


@query(with_(PQ, LQ) + _mode("ASC"))
def mode_smallest(spark, sf):
    return dynamics.modes(labels_quarterly(spark, sf), ["entity"], largest=False)


@query(with_(PQ, LQ) + "SELECT entity, period, CAST(new AS INT) AS label FROM lq JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS new FROM lq GROUP BY label) USING (label)")
def size_relabel(spark, sf):
    return dynamics.by_size(labels_quarterly(spark, sf))


@query(with_(PQ, LQ) + "SELECT entity, year, label FROM (SELECT entity, CAST(period // 4 AS BIGINT) AS year, label, row_number() OVER (PARTITION BY entity, period // 4 ORDER BY count(*) DESC, label DESC) AS rn FROM lq GROUP BY entity, period // 4, label) WHERE rn = 1")
def period_modes(spark, sf):
    """Yearly modes of quarterly labels."""
    return dynamics.modes(labels_quarterly(spark, sf).withColumn("year", F.floor(F.col("period") / 4)), ["entity", "year"])


_RUNS = """rs AS (SELECT entity, run, min(label) AS label, min(period) AS start, count(*) AS length FROM (
  SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY period) AS run FROM (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY entity ORDER BY period) THEN 1 ELSE 0 END AS c FROM lq)) GROUP BY entity, run)"""


def _episodes(h: int) -> str:
    return f"""ep{h} AS (SELECT entity, episode, min(label) AS label, min(start) AS start, sum(length) AS length FROM (
  SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY run) AS episode FROM (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY entity ORDER BY run) THEN 1 ELSE 0 END AS c FROM rs WHERE length >= {h})) GROUP BY entity, episode)"""


@query(with_(PQ, LQ, _RUNS) + "SELECT entity, CAST(run AS BIGINT) AS run, label, start, length FROM rs")
def runs(spark, sf):
    return dynamics.runs(labels_quarterly(spark, sf))


@query(with_(PQ, LQ, _RUNS, _episodes(2), _episodes(3)) + "SELECT 2 AS h, entity, CAST(episode AS BIGINT) AS episode, label, start, CAST(length AS BIGINT) AS length FROM ep2 UNION ALL SELECT 3, entity, CAST(episode AS BIGINT), label, start, CAST(length AS BIGINT) FROM ep3")
def episodes_h2_h3(spark, sf):
    labels = labels_quarterly(spark, sf)
    return dynamics.episodes(labels, 2).withColumn("h", F.lit(2)).unionByName(dynamics.episodes(labels, 3).withColumn("h", F.lit(3)))


@query(with_(PQ, LQ, _RUNS, _episodes(2), _episodes(3)) + """SELECT entity, (SELECT count(*) - 1 FROM rs WHERE rs.entity = e.entity) AS raw,
  greatest(0, (SELECT count(*) - 1 FROM ep2 WHERE ep2.entity = e.entity)) AS h2, greatest(0, (SELECT count(*) - 1 FROM ep3 WHERE ep3.entity = e.entity)) AS h3 FROM (SELECT DISTINCT entity FROM lq) e""")
def confirmed_switches(spark, sf):
    return dynamics.switches(labels_quarterly(spark, sf))


_TRAJ = """SELECT entity, CASE WHEN count(*) = 1 THEN 'stable' WHEN count(*) = 2 AND min(length) >= 2 THEN 'moved' ELSE 'other' END AS trajectory FROM rs GROUP BY entity"""


@query(with_(PY, LY, _RUNS.replace("FROM lq", "FROM ly")) + _TRAJ)
def trajectory_class(spark, sf):
    return dynamics.trajectories(labels_yearly(spark, sf))


def _trans(source: str) -> str:
    return f"""tr AS (SELECT from_period, to_period, from_type, to_type, count(*) AS n FROM (SELECT period AS from_period, label AS from_type, lead(period) OVER w AS to_period, lead(label) OVER w AS to_type FROM {source} WINDOW w AS (PARTITION BY entity ORDER BY period))
  WHERE to_period IS NOT NULL GROUP BY ALL)"""


_TRANS = "SELECT from_period, to_period, from_type, to_type, n, round(n / sum(n) OVER (PARTITION BY from_period, to_period, from_type), 6) AS share_of_from FROM tr"


@query(with_(PQ, LQ, _trans("lq")) + _TRANS)
def transitions_quarter(spark, sf):
    return dynamics.transitions(labels_quarterly(spark, sf)).withColumn("share_of_from", r6("share_of_from"))


@query(with_(PY, LY, _trans("ly")) + "SELECT p.from_period, p.to_period, a.label AS from_type, b.label AS to_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT from_period, to_period FROM tr) p, (SELECT DISTINCT label FROM ly) a, (SELECT DISTINCT label FROM ly) b LEFT JOIN tr ON tr.from_period = p.from_period AND tr.to_period = p.to_period AND tr.from_type = a.label AND tr.to_type = b.label")
def transitions_year(spark, sf):
    """Yearly transitions with zeros."""
    return dynamics.dense_transitions(labels_yearly(spark, sf))


@query(with_(PQ, LQ, _trans("lq")) + "SELECT from_period, to_period, from_type, round(sum(CASE WHEN from_type = to_type THEN n ELSE 0 END) / sum(n), 6) AS stay FROM tr GROUP BY from_period, to_period, from_type")
def stay_share(spark, sf):
    return dynamics.stay_share(labels_quarterly(spark, sf)).withColumn("stay", r6("stay"))


def _monic(tau: float, split: float) -> str:
    return f"""m AS (SELECT from_period AS fp, to_period AS tp, from_type AS x, to_type AS y, n, sum(n) OVER (PARTITION BY from_period, to_period, from_type) AS nx, sum(n) OVER (PARTITION BY from_period, to_period, to_type) AS ny FROM tr),
o AS (SELECT *, n / nx AS ov FROM m),
b AS (SELECT fp, tp, x, max(ov) AS best, arg_max(y, (ov, -y)) AS target, arg_max(ny, (ov, -y)) AS tny, any_value(nx) AS nx, list(struct_pack(y := y, ov := ov) ORDER BY y) FILTER (ov >= {split}) AS parts, coalesce(sum(ov) FILTER (ov >= {split}), 0) AS total FROM o GROUP BY fp, tp, x),
k AS (SELECT *, CASE WHEN best >= {tau} THEN 'm' WHEN len(parts) >= 2 AND total >= {tau} THEN 's' ELSE 'd' END AS kind FROM b),
i AS (SELECT *, count(*) OVER w AS c, string_agg(CAST(x AS VARCHAR), '|') OVER (PARTITION BY fp, tp, target ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS src FROM k WHERE kind = 'm' WINDOW w AS (PARTITION BY fp, tp, target)),
hit AS (SELECT fp, tp, target AS y FROM i UNION SELECT fp, tp, unnest(list_transform(parts, lambda p: p.y)) FROM k WHERE kind = 's'),
mo AS (SELECT fp, tp, CASE WHEN c = 1 THEN 'survive' ELSE 'absorb' END AS event, x, src AS source, CAST(target AS VARCHAR) AS target, CAST(round(best, 3) AS VARCHAR) AS overlap, round(tny / nx, 3) AS size_ratio FROM i
UNION ALL SELECT fp, tp, 'split', x, CAST(x AS VARCHAR), array_to_string(list_transform(parts, lambda p: CAST(p.y AS VARCHAR)), '|'), array_to_string(list_transform(parts, lambda p: CAST(round(p.ov, 3) AS VARCHAR)), '|'), NULL FROM k WHERE kind = 's'
UNION ALL SELECT fp, tp, 'disappear', x, CAST(x AS VARCHAR), '', CAST(round(best, 3) AS VARCHAR), NULL FROM k WHERE kind = 'd'
UNION ALL SELECT fp, tp, 'emerge', NULL, '', CAST(y AS VARCHAR), CAST(round(max(n) / any_value(ny), 3) AS VARCHAR), NULL FROM o WHERE (fp, tp, y) NOT IN (SELECT fp, tp, y FROM hit) GROUP BY fp, tp, y)"""


@query(with_(PQ, LQ, _trans("lq"), _monic(0.25, 0.2)) + "SELECT fp AS from_period, tp AS to_period, event, x, source, target, overlap, size_ratio FROM mo")
def monic_events(spark, sf):
    return dynamics.monic(dynamics.successive(labels_quarterly(spark, sf)), 0.25, 0.2, ["from_period", "to_period"])


_TAUS = (0.2, 0.25, 0.3)


@query(" UNION ALL ".join(f"SELECT * FROM ({with_(PY, LY, _trans('ly'), _monic(t, 0.2))} SELECT CAST({t} AS DOUBLE) AS tau, event, count(*) AS n FROM mo GROUP BY event)" for t in _TAUS))
def monic_sensitivity(spark, sf):
    """Events for several thresholds."""
    cross = dynamics.successive(labels_yearly(spark, sf))
    out = None
    for t in _TAUS:
        n = dynamics.monic(cross, t, 0.2, ["from_period", "to_period"]).groupBy("event").agg(F.count(F.lit(1)).alias("n")).withColumn("tau", F.lit(t))
        out = n if out is None else out.unionByName(n)
    return out


@query(with_(PQ, LQ, _trans("lq"), "m AS (SELECT *, sum(n) OVER (PARTITION BY from_period, to_period, from_type) AS nx, sum(n) OVER (PARTITION BY from_period, to_period, to_type) AS ny FROM tr)") + "SELECT from_period, to_period, from_type AS x, round(max(n / (nx + ny - n)), 6) AS jaccard FROM m GROUP BY from_period, to_period, from_type")
def cluster_jaccard(spark, sf):
    return dynamics.cluster_jaccard(dynamics.successive(labels_quarterly(spark, sf)), ["from_period", "to_period"]).withColumn("jaccard", r6("jaccard"))


def _ari(keys: str, source: str, x: str, y: str) -> str:
    return f"""ar AS (SELECT {keys}, CASE WHEN (a + b) / 2 - e = 0 THEN 1 ELSE (s - e) / ((a + b) / 2 - e) END AS ari FROM (SELECT *, a * b / (n * (n - 1) / 2.0) AS e FROM
  (SELECT {keys}, sum(n * (n - 1) / 2.0)::DOUBLE AS s, sum(n)::DOUBLE AS n FROM {source} GROUP BY {keys}) JOIN (SELECT {keys}, sum(m * (m - 1) / 2.0)::DOUBLE AS a FROM (SELECT {keys}, {x}, sum(n) AS m FROM {source} GROUP BY {keys}, {x}) GROUP BY {keys}) USING ({keys})
  JOIN (SELECT {keys}, sum(m * (m - 1) / 2.0)::DOUBLE AS b FROM (SELECT {keys}, {y}, sum(n) AS m FROM {source} GROUP BY {keys}, {y}) GROUP BY {keys}) USING ({keys})))"""


@query(with_(PQ, LQ, _trans("lq"), _ari("from_period, to_period", "tr", "from_type", "to_type")) + "SELECT from_period, to_period, round(ari, 6) AS ari FROM ar")
def adjusted_rand(spark, sf):
    return dynamics.adjusted_rand(dynamics.successive(labels_quarterly(spark, sf)), ["from_period", "to_period"]).withColumn("ari", r6("ari"))


@query(with_(PQ, LQ, _trans("lq"), _ari("from_period, to_period", "tr", "from_type", "to_type"), "st AS (SELECT entity, sum(c) AS changes, count(c) AS steps FROM (SELECT entity, CAST(label <> lag(label) OVER (PARTITION BY entity ORDER BY period) AS INT) AS c FROM lq) GROUP BY entity)",
             f"md AS ({_mode('ASC')})") + """SELECT round(1 - (SELECT sum(changes) / sum(steps) FROM st), 6) AS stay_share, (SELECT median(changes) FROM st) AS median_switches,
  (SELECT round(avg(s), 6) FROM (SELECT avg(CAST(lq.label = md.label AS INT)) AS s FROM lq JOIN md USING (entity) GROUP BY entity)) AS modal_share, (SELECT round(avg(ari), 6) FROM ar) AS mean_ari, (SELECT min(k) FROM (SELECT count(DISTINCT label) AS k FROM lq GROUP BY period)) AS least_types""")
def stability_summary(spark, sf):
    s = dynamics.stability(labels_quarterly(spark, sf))
    return s.select(r6("stay_share").alias("stay_share"), "median_switches", r6("modal_share").alias("modal_share"), r6("mean_ari").alias("mean_ari"), "least_types")


@query(with_(PQ, LQ, f"md AS ({_mode('ASC')})", "st AS (SELECT entity, coalesce(sum(CAST(c AS INT)), 0) AS changes, count(DISTINCT label) AS d FROM (SELECT entity, label, label <> lag(label) OVER (PARTITION BY entity ORDER BY period) AS c FROM lq) GROUP BY entity)")
       + "SELECT lq.entity, CAST(any_value(changes) AS BIGINT) AS changes, any_value(d) AS \"distinct\", any_value(md.label) AS modal, round(avg(CAST(lq.label = md.label AS INT)), 6) AS modal_share FROM lq JOIN md USING (entity) JOIN st USING (entity) GROUP BY lq.entity")
def pattern_stability(spark, sf):
    return dynamics.pattern_stability(labels_quarterly(spark, sf)).withColumn("modal_share", r6("modal_share"))


_SEASON = """sh AS (SELECT l.label, p.period, p.period // 4 AS year, p.period % 4 AS season, coalesce(n, 0) AS n, coalesce(n, 0) / size AS share FROM (SELECT period, count(*) AS size FROM lq GROUP BY period) p, (SELECT DISTINCT label FROM lq) l
  LEFT JOIN (SELECT period, label, count(*) AS n FROM lq GROUP BY period, label) c ON c.period = p.period AND c.label = l.label),
sd AS (SELECT *, share - avg(share) OVER (PARTITION BY label) AS dev FROM sh)"""


def _year_season(c: str = "period"):
    return F.floor(F.col(c) / 4), F.col(c) % 4


@query(with_(PQ, LQ, _SEASON) + "SELECT label, period, n, round(share, 6) AS share, round(dev, 6) AS dev FROM sd")
def seasonal_shares(spark, sf):
    s = dynamics.seasonal_shares(labels_quarterly(spark, sf), *_year_season())
    return s.select("label", "period", "n", r6("share").alias("share"), r6("dev").alias("dev"))


@query(with_(PQ, LQ, _SEASON, "y AS (SELECT a.label, corr(a.dev, b.dev) AS yoy FROM sd a JOIN sd b ON a.label = b.label AND a.season = b.season AND a.year = 1998 AND b.year = 1999 GROUP BY a.label)") + """SELECT label, round(avg(dev) FILTER (season = 2) - avg(dev) FILTER (season <> 2), 6) AS season_minus_rest,
  round(max(share) - min(share), 6) AS "range", arg_min(period, share * 1e6 + period * 1e-6) AS least_period, arg_max(period, share * 1e6 - period * 1e-6) AS most_period, round(any_value(yoy), 6) AS yoy FROM sd JOIN y USING (label) GROUP BY label""")
def seasonality(spark, sf):
    s = dynamics.seasonality(dynamics.seasonal_shares(labels_quarterly(spark, sf), *_year_season()), 2, (1998, 1999))
    return s.select("label", r6("season_minus_rest").alias("season_minus_rest"), r6("range").alias("range"), "least_period", "most_period", r6("yoy").alias("yoy"))


@query(with_(PQ, LQ, """r AS (SELECT entity, period // 4 AS y, period % 4 AS s, label FROM lq WHERE period // 4 IN (1998, 1999)),
b AS (SELECT entity, y, label FROM (SELECT entity, y, label, row_number() OVER (PARTITION BY entity, y ORDER BY count(*) DESC, label DESC) AS rn FROM r GROUP BY entity, y, label) WHERE rn = 1),
o AS (SELECT entity, y, label FROM r WHERE s = 2),
g AS (SELECT b.entity, min(b.label) AS base, max(b.label) AS b2, min(o.label) AS off, max(o.label) AS o2 FROM b JOIN o USING (entity, y) GROUP BY b.entity HAVING count(*) = 2)""") + "SELECT base, off, count(*) AS n FROM g WHERE base = b2 AND off = o2 AND base <> off GROUP BY base, off")
def recurrent_switchers(spark, sf):
    return dynamics.recurrent_switchers(labels_quarterly(spark, sf), *_year_season(), 2, (1998, 1999))


_LEVEL = "lv AS (SELECT entity, period, CAST(ntile(4) OVER (PARTITION BY period ORDER BY sum(value), entity) - 1 AS INT) AS label FROM py GROUP BY entity, period)"


def _level_labels(spark, sf):
    from pyspark.sql import Window

    from .base import yearly

    total = yearly(spark, sf).groupBy("entity", "period").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("t"))
    return total.select("entity", "period", (F.ntile(4).over(Window.partitionBy("period").orderBy("t", "entity")) - 1).alias("label"))


_LEVEL = _LEVEL.replace("sum(value)", "sum(CAST(value AS DECIMAL(18,2)))")


@query(with_(PY, LY, _LEVEL, "ct AS (SELECT period, ly.label AS x, lv.label AS y, count(*) AS n FROM ly JOIN lv USING (entity, period) GROUP BY ALL)", _ari("period", "ct", "x", "y")) + "SELECT round(avg(ari), 6) AS mean_ari, count(*) AS n_periods FROM ar")
def method_agreement(spark, sf):
    """Greatest type against quartile of the level."""
    return dynamics.method_agreement(labels_yearly(spark, sf), _level_labels(spark, sf)).withColumn("mean_ari", r6("mean_ari"))


@query(with_(PQ, LQ) + "SELECT grp, count(*) FILTER (k = 3 AND m = 3) AS n_ties FROM (SELECT entity, CAST(period // 3 AS BIGINT) AS grp, count(DISTINCT label) AS k, count(*) AS m FROM lq GROUP BY entity, period // 3) GROUP BY grp")
def quarter_ties(spark, sf):
    return dynamics.triple_ties(labels_quarterly(spark, sf), F.floor(F.col("period") / 3))


#: Labels whose numbers turn with the year, and all ways to name them after those of 1998.
_ALIGN = """tl AS (SELECT entity, period, (label + period) % 6 AS label FROM ly), rf AS (SELECT entity, label FROM ly WHERE period = 1998),
ov AS (SELECT p.period, x.x, y.y, count(rf.entity) AS n FROM (SELECT DISTINCT period FROM tl) p, (SELECT unnest(range(6)) AS x) x, (SELECT unnest(range(6)) AS y) y LEFT JOIN tl ON tl.period = p.period AND tl.label = x.x LEFT JOIN rf ON rf.entity = tl.entity AND rf.label = y.y GROUP BY ALL),
w(period, path, n) AS (SELECT DISTINCT period, CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM ov UNION ALL SELECT w.period, list_append(path, y), w.n + ov.n FROM w JOIN ov ON ov.period = w.period AND ov.x = len(path) WHERE NOT list_contains(path, y)),
bp AS (SELECT period, path FROM w WHERE len(path) = 6 QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, path) = 1)"""


@query(with_(PY, LY, _ALIGN) + "SELECT entity, tl.period, CAST(path[label + 1] AS INT) AS label FROM tl JOIN bp ON bp.period = tl.period")
def aligned_types(spark, sf):
    """Each year's labels, whose numbers turn with the year, renamed by greatest overlap with 1998's."""
    labels = labels_yearly(spark, sf)
    turned = labels.select("entity", "period", ((F.col("label") + F.col("period")) % 6).cast("int").alias("label"))
    return methods.align(turned, labels.where("period = 1998").select("entity", "label"))


_IX = """ix AS (SELECT l_returnflag || l_linestatus AS method, CAST(year(l_shipdate) AS VARCHAR) AS period, round(avg(l_discount), 9) AS SW, round(avg(l_quantity), 9) AS CH, round(avg(l_tax), 9) AS S_Dbw, round(stddev_pop(l_quantity), 9) AS z_AVI, CASE WHEN l_returnflag = 'N' AND year(l_shipdate) = 1999 THEN NULL ELSE round(stddev_pop(l_discount), 9) END AS z_AVU FROM lineitem GROUP BY l_returnflag, l_linestatus, year(l_shipdate)
  UNION ALL SELECT l_returnflag || l_linestatus, 'all', round(avg(l_discount), 9), round(avg(l_quantity), 9), round(avg(l_tax), 9), round(stddev_pop(l_quantity), 9), round(stddev_pop(l_discount), 9) FROM lineitem GROUP BY l_returnflag, l_linestatus)"""
_COLS = ["SW", "CH", "S_Dbw", "z_AVI", "z_AVU"]
_SIGN = {"SW": "", "CH": "", "S_Dbw": "-", "z_AVI": "", "z_AVU": "-"}


def _indices(spark, sf):
    """A table of indices: groups of lines as methods, years as periods."""
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("method"), F.year("l_shipdate").cast("string").alias("period"), "l_discount", "l_quantity", "l_tax")
    stats = [F.round(F.avg("l_discount"), 9).alias("SW"), F.round(F.avg("l_quantity"), 9).alias("CH"), F.round(F.avg("l_tax"), 9).alias("S_Dbw"), F.round(F.stddev_pop("l_quantity"), 9).alias("z_AVI"), F.round(F.stddev_pop("l_discount"), 9).alias("z_AVU")]
    each = rows.groupBy("method", "period").agg(*stats)
    gap = F.col("method").startswith("N") & (F.col("period") == "1999")
    each = each.withColumn("z_AVU", F.when(~gap, F.col("z_AVU")))
    return each.unionByName(rows.groupBy("method").agg(*stats).withColumn("period", F.lit("all")))


def _grade(c: str) -> str:
    return f"CAST(ceil(3 * CASE WHEN {c} IS NULL THEN count(*) OVER (PARTITION BY period) ELSE rank() OVER (PARTITION BY period ORDER BY {_SIGN[c]}{c} DESC NULLS LAST) END / count(*) OVER (PARTITION BY period)) AS INT) AS grade_{c}"


def _count(g: int, cols: list[str]) -> str:
    return " + ".join(f"CAST(grade_{c} = {g} AS INT)" for c in cols)


_GRADES = "gr AS (SELECT *, " + ", ".join(map(_grade, _COLS)) + " FROM ix)"
_ARANK = lambda c: f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY period ORDER BY {_SIGN[c]}{c} NULLS LAST) + (count({c}) OVER (PARTITION BY period, {c}) - 1) / 2.0 END"


@query(with_(_IX, _GRADES) + f"SELECT method, period, {', '.join(f'grade_{c}' for c in _COLS)}, {_count(1, _COLS)} AS n_grade1, {_count(2, _COLS)} AS n_grade2, {_count(3, _COLS)} AS n_grade3, CAST(rank() OVER (PARTITION BY period ORDER BY {_count(3, _COLS)}, {_count(2, _COLS)}) AS INT) AS threshold_place FROM gr")
def grades_threshold(spark, sf):
    g = ranking.threshold_places(ranking.grades(_indices(spark, sf), ["period"], _COLS), ["period"], _COLS)
    return g.select("method", "period", *[f"grade_{c}" for c in _COLS], "n_grade1", "n_grade2", "n_grade3", "threshold_place")


_BORDA = "bo AS (SELECT *, " + " + ".join(f"({_ARANK(c)}) - 1" for c in _COLS) + " AS points FROM ix)"


@query(with_(_IX, _BORDA) + "SELECT method, period, CAST(points AS DOUBLE) AS borda_points, CAST(rank() OVER (PARTITION BY period ORDER BY points DESC NULLS LAST) AS INT) AS borda_place FROM bo")
def borda_places(spark, sf):
    return ranking.borda(_indices(spark, sf), ["period"], _COLS).select("method", "period", F.col("borda_points").cast("double").alias("borda_points"), "borda_place")


_FEW = _COLS[:-1]


@query(with_(_IX, _GRADES, f"t AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY {_count(3, _COLS)}, {_count(2, _COLS)}) AS p1, rank() OVER (PARTITION BY period ORDER BY {_count(3, _FEW)}, {_count(2, _FEW)}) AS p2 FROM gr)",
             "b AS (SELECT method, period, " + " + ".join(f"({_ARANK(c)})" for c in _COLS) + " AS s1, " + " + ".join(f"({_ARANK(c)})" for c in _FEW) + " AS s2 FROM ix)",
             "m AS (SELECT t.method, t.period, p1, p2, rank() OVER (PARTITION BY t.period ORDER BY s1 DESC NULLS LAST) AS b1, rank() OVER (PARTITION BY t.period ORDER BY s2 DESC NULLS LAST) AS b2 FROM t JOIN b USING (method, period))",
             "l AS (SELECT period, list(method ORDER BY method) FILTER (p1 = 1) = list(method ORDER BY method) FILTER (p2 = 1) AS same_threshold_leader, list(method ORDER BY method) FILTER (p1 = 1) = list(method ORDER BY method) FILTER (b1 = 1) AS same_leader FROM m GROUP BY period)")
       + "SELECT method, period, CAST(p1 AS INT) AS threshold_place, CAST(p2 AS INT) AS threshold_place_without, CAST(b1 AS INT) AS borda_place, CAST(b2 AS INT) AS borda_without_place, same_threshold_leader, same_leader FROM m JOIN l USING (period)")
def method_ranking(spark, sf):
    """Places with and without one index, and whether leaders agree."""
    r = ranking.ranking(_indices(spark, sf), ["period"], _COLS, "z_AVU")
    return r.select("method", "period", "threshold_place", "threshold_place_without", "borda_place", "borda_without_place", "same_threshold_leader", "same_leader")


@query(with_(_IX, _BORDA, "kk AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY method) + 3 AS k FROM bo)") + f"SELECT period, CAST(arg_max(k, points * 1e6 - k) AS BIGINT) AS k, round(CAST(max(points) + {len(_COLS)} AS DOUBLE), 6) AS points FROM kk GROUP BY period")
def borda_k(spark, sf):
    """The number of clusters with most points; the methods stand for numbers."""
    from pyspark.sql import Window

    ix = _indices(spark, sf).withColumn("k", (F.rank().over(Window.partitionBy("period").orderBy("method")) + 3).cast("long"))
    return ranking.borda_best(ix, ["period"], "k", _COLS).select("period", "k", r6(F.col("points").cast("double")).alias("points"))


@query(with_(_IX) + "SELECT method, " + ", ".join(f"max({c}) FILTER (period = 'all') AS {c}_all, round(median({c}) FILTER (period <> 'all'), 6) AS {c}_median" for c in _COLS) + " FROM ix GROUP BY method")
def index_summary(spark, sf):
    s = ranking.index_summary(_indices(spark, sf), _COLS)
    return s.select("method", *[F.col(f"{c}_all") for c in _COLS], *[r6(f"{c}_median").alias(f"{c}_median") for c in _COLS])


@query(with_(_IX) + " UNION ALL ".join(f"(SELECT period, '{c}' AS name, method, {c} AS value FROM ix QUALIFY row_number() OVER (PARTITION BY period ORDER BY {_SIGN[c]}{c} DESC NULLS LAST, method) = 1)" for c in _COLS))
def best_by_index(spark, sf):
    return serving.best_by_index(_indices(spark, sf), _COLS, ["period"])


@query(with_(_IX, _GRADES, f"t AS (SELECT method, period, CAST(rank() OVER (PARTITION BY period ORDER BY {_count(3, _COLS)}, {_count(2, _COLS)}) AS INT) AS threshold_place FROM gr)") + "SELECT method, period, " + ", ".join(f"round({c}, 4) AS {c}" for c in _COLS) + ", threshold_place FROM ix JOIN t USING (method, period)")
def method_table(spark, sf):
    """Indices beside places, one row for each method and period."""
    ix = _indices(spark, sf)
    places = ranking.threshold_places(ranking.grades(ix, ["period"], _COLS), ["period"], _COLS).select("method", "period", "threshold_place")
    return serving.method_table(ix, places, ["method", "period"])


@query(with_(PQ, LQ, _trans("lq"), "f AS (SELECT from_type, to_type, sum(n) AS n FROM tr GROUP BY from_type, to_type)") + """SELECT least(from_type, to_type) AS a, greatest(from_type, to_type) AS b, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (from_type < to_type), 0) AS BIGINT) AS up, CAST(coalesce(sum(n) FILTER (from_type > to_type), 0) AS BIGINT) AS down,
  round(sum(n) / (SELECT sum(n) FROM f), 6) AS share FROM f WHERE from_type <> to_type GROUP BY 1, 2""")
def flow_pairs(spark, sf):
    flows = dynamics.transitions(labels_quarterly(spark, sf)).groupBy("from_type", "to_type").agg(F.sum("n").alias("n"))
    return serving.flow_pairs(flows).withColumn("share", r6("share"))


@query(with_(PQ, LQ, _trans("lq"), "f AS (SELECT from_type, to_type, CAST(sum(n) AS BIGINT) AS n FROM tr GROUP BY from_type, to_type)") + "SELECT from_type, to_type, n, row_number() OVER (PARTITION BY from_type ORDER BY n DESC, to_type) AS rank FROM f WHERE from_type <> to_type QUALIFY rank <= 3")
def top_flows(spark, sf):
    flows = dynamics.transitions(labels_quarterly(spark, sf)).groupBy("from_type", "to_type").agg(F.sum("n").alias("n"))
    return serving.top_flows(flows).withColumn("rank", F.col("rank").cast("long"))


@query(with_(PQ, LQ, _trans("lq")) + "SELECT 'node' AS kind, period AS a_period, label AS a, NULL::INT AS b_period, NULL::INT AS b, count(*) AS n FROM lq GROUP BY period, label UNION ALL SELECT 'link', from_period, from_type, to_period, to_type, n FROM tr")
def quarter_nodes_links(spark, sf):
    return serving.nodes_and_links(labels_quarterly(spark, sf))


_KT = """kt AS (SELECT CAST(l_returnflag AS VARCHAR) AS method, CAST(l_linenumber AS BIGINT) AS k, CAST(year(l_shipdate) AS VARCHAR) AS period, round(avg(l_discount), 9) AS SW, round(avg(l_quantity), 9) AS CH, round(avg(l_tax), 9) AS S_Dbw FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_returnflag, l_linenumber, 'all', round(avg(l_discount), 9), round(avg(l_quantity), 9), round(avg(l_tax), 9) FROM lineitem GROUP BY ALL)"""


def _best(source: str, out: str) -> str:
    rank = lambda c: f"(rank() OVER (PARTITION BY method ORDER BY {_SIGN[c]}{c}) + (count(*) OVER (PARTITION BY method, {c}) - 1) / 2.0)"
    return f"(SELECT method, k AS {out} FROM (SELECT method, k, {' + '.join(map(rank, _COLS[:3]))} AS p FROM {source}) QUALIFY row_number() OVER (PARTITION BY method ORDER BY p DESC, k) = 1)"


@query(with_(_KT, "ka AS (SELECT * FROM kt WHERE period = 'all')", "km AS (SELECT method, k, median(SW) AS SW, median(CH) AS CH, median(S_Dbw) AS S_Dbw FROM kt WHERE period <> 'all' GROUP BY method, k)") + f"SELECT method, k_all, k_median FROM {_best('ka', 'k_all')} JOIN {_best('km', 'k_median')} USING (method)")
def select_k(spark, sf):
    """Best number for each method; line numbers stand for numbers of clusters."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("long").alias("k"), F.year("l_shipdate").cast("string").alias("period"), "l_discount", "l_quantity", "l_tax")
    stats = [F.round(F.avg(c), 9).alias(n) for c, n in (("l_discount", "SW"), ("l_quantity", "CH"), ("l_tax", "S_Dbw"))]
    both = rows.groupBy("method", "k", "period").agg(*stats).unionByName(rows.groupBy("method", "k").agg(*stats).withColumn("period", F.lit("all")))
    return ranking.select_k(both, _COLS[:3])


@query(with_(PY, LY, _LEVEL) + "SELECT entity, period, label FROM lv")
def final_labels(spark, sf):
    """One method's labels out of several."""
    a = labels_yearly(spark, sf).select(F.lit("greatest").alias("method"), F.lit(6).alias("k"), "entity", "period", "label")
    b = _level_labels(spark, sf).select(F.lit("level").alias("method"), F.lit(4).alias("k"), "entity", "period", "label")
    return ranking.final_labels(a.unionByName(b), "level", 4)
