"""Patterns, concepts, profiles, tests, serving aggregates and clustering methods."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import fca, features, graph, methods, panel, patterns, profiles, serving
from ..sources import tables
from .base import CATEGORIES, EM, LQ, LY, PARTS, PY, PQ, WY, labels_quarterly, labels_yearly, query, r6, table, vectors, wide_yearly, with_, yearly

_PAIRS = [(a, b) for i, a in enumerate(PARTS) for b in PARTS[i + 1 :]]
_CODE = "array_to_string([" + ", ".join(f"CAST(sign({a} - {b}) AS INT)" for a, b in _PAIRS) + "], ',')"


def _coded(spark, sf):
    return wide_yearly(spark, sf).select("entity", "period", patterns.codes(PARTS).alias("code"))


def _joined(c):
    """The signs there are as text; null if there are none."""
    return F.when(F.exists(c, lambda x: x.isNotNull()), F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


@query(with_(PY, WY) + f"SELECT entity, period, {_CODE} AS code FROM wy")
def pattern_codes(spark, sf):
    return _coded(spark, sf).select("entity", "period", _joined("code").alias("code"))


_LISTS = "[" + ", ".join(f"CAST(sign({a} - {b}) AS INT)" for a, b in _PAIRS) + "]"


@query(with_(PY, WY) + f"SELECT array_to_string(code, ',') AS code, n, row_number() OVER (ORDER BY n DESC, code) - 1 AS cluster FROM (SELECT {_LISTS} AS code, count(*) AS n FROM wy GROUP BY 1)")
def pattern_dictionary(spark, sf):
    return patterns.dictionary(_coded(spark, sf)).select(_joined("code").alias("code"), "n", F.col("cluster").cast("long").alias("cluster"))


@query(with_(PY, WY, "lw AS (SELECT entity, period, category, value FROM py WHERE category <> 'STANDARD')", "win AS (SELECT a.entity, a.period, a.category, sum(CAST(sign(a.value - b.value) AS INT)) AS net FROM lw a JOIN lw b USING (entity, period) WHERE a.category <> b.category GROUP BY ALL)",
             "ord AS (SELECT *, row_number() OVER w AS rn, lag(net) OVER w AS before FROM win WINDOW w AS (PARTITION BY entity, period ORDER BY net DESC, category))")
       + "SELECT entity, period, string_agg(CASE WHEN rn = 1 THEN '' WHEN net = before THEN ' = ' ELSE ' > ' END || category, '' ORDER BY rn) AS pattern FROM ord GROUP BY entity, period")
def pattern_text(spark, sf):
    """Orders in words, of the types there are; none where fewer than two are."""
    return _coded(spark, sf).select("entity", "period", patterns.text(F.col("code"), PARTS).alias("pattern")).where("pattern is not null")


@query(with_(PY, WY) + "SELECT entity, period, array_to_string([" + ", ".join(f"CASE WHEN abs({a} / total - {b} / total) <= 0.05 THEN 0 ELSE CAST(sign({a} / total - {b} / total) AS INT) END" for a, b in zip(PARTS, PARTS[1:])) + "], ',') AS code FROM wy")
def pattern_codes_adjacent(spark, sf):
    """Neighbouring features only, differences up to 0.05 as equal."""
    w = wide_yearly(spark, sf).select("entity", "period", *[(F.col(p) / F.col("total")).alias(p) for p in PARTS])
    return w.select("entity", "period", _joined(patterns.codes(PARTS, "adjacent", 0.05)).alias("code"))


@query()
def pattern_merge(spark, sf):
    """Clusters of codes for every number down to 4; codes are few, so they merge on the driver."""
    w = wide_yearly(spark, sf).select(patterns.codes(PARTS, "adjacent").alias("code"), *[(F.col(p) / F.col("total")).alias(p) for p in PARTS])
    rows = w.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(p) for p in PARTS]).orderBy("code").collect()
    merged = patterns.merge([(r["code"], r["n"], [r[p] for p in PARTS]) for r in rows], 4)
    out = [(k, ",".join(map(str, r["code"])), int(c)) for k, labels in merged.items() for r, c in zip(rows, labels, strict=True)]
    return spark.createDataFrame(out, "k int, code string, cluster int")


# -- profiles --------------------------------------------------------------

_ET = "et AS (SELECT entity, " + ", ".join(f"avg({p} / total) AS share_{p}" for p in PARTS) + ", exp(avg(ln(total))) AS spend, avg(total) FILTER (period = 1999) / avg(total) FILTER (period = 1998) - 1 AS growth FROM wy GROUP BY entity)"
_MODAL = "mo AS (SELECT entity, label FROM (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, label DESC) AS rn FROM ly GROUP BY entity, label) WHERE rn = 1)"
_TB = "tb AS (SELECT et.*, mo.label, s_nationkey AS region, s_acctbal AS balance FROM et JOIN mo USING (entity) JOIN supplier ON s_suppkey = entity)"


def _entities(spark, sf):
    """Entity features with the modal label, region and balance."""
    t = profiles.entity_table(wide_yearly(spark, sf), PARTS, (1998, 1999)).join(serving.modal_label(labels_yearly(spark, sf)), "entity")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("region"), F.col("s_acctbal").alias("balance"))
    return t.join(s, "entity")


@query(with_(PY, WY, _ET) + "SELECT entity, " + ", ".join(f"round(share_{p}, 6) AS share_{p}" for p in PARTS) + ", round(spend, 2) AS spend, round(growth, 6) AS growth FROM et")
def entity_table(spark, sf):
    t = profiles.entity_table(wide_yearly(spark, sf), PARTS, (1998, 1999))
    return t.select("entity", *[r6(f"share_{p}").alias(f"share_{p}") for p in PARTS], r6("spend", 2).alias("spend"), r6("growth").alias("growth"))


_STATS = "count(*) AS n, " + ", ".join(f"100 * avg(share_{p}) AS pct_{p}" for p in PARTS) + ", exp(avg(ln(spend))) AS spend_geo, 100 * median(growth) AS growth_median"


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, f"pr AS (SELECT CAST(label AS VARCHAR) AS type, {_STATS} FROM tb GROUP BY label UNION ALL SELECT 'all', {_STATS} FROM tb)")
       + "SELECT type, n, " + ", ".join(f"round(pct_{p}, 5) AS pct_{p}, round(pct_{p} / (SELECT pct_{p} FROM pr WHERE type = 'all'), 5) AS ratio_{p}" for p in PARTS) + ", round(spend_geo, 2) AS spend_geo, round(growth_median, 5) AS growth_median FROM pr")
def type_profiles(spark, sf):
    p = profiles.profiles(_entities(spark, sf), PARTS)
    return p.select("type", "n", *[r6(f"{k}_{x}", 5).alias(f"{k}_{x}") for x in PARTS for k in ("pct", "ratio")], r6("spend_geo", 2).alias("spend_geo"), r6("growth_median", 5).alias("growth_median"))


@query(with_(PY, LY, _MODAL, "rg AS (SELECT label, CAST(s_nationkey AS VARCHAR) AS region FROM mo JOIN supplier ON s_suppkey = entity)", "c AS (SELECT label, region, count(*) AS n FROM rg GROUP BY ALL)", "tt AS (SELECT region, count(*) AS total FROM rg GROUP BY region)")
       + "SELECT label, string_agg(region || ' (' || n || ' of ' || total || ')', '; ' ORDER BY r) AS regions FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, region) AS r FROM c JOIN tt USING (region)) WHERE r <= 3 GROUP BY label")
def top_regions(spark, sf):
    t = _entities(spark, sf).select("label", F.col("region").cast("string").alias("region"))
    return profiles.top_regions(t)


_LONG = "lv AS (SELECT id, label, unnest(range(0, len(vec))) AS f, unnest(vec) AS x FROM em)"
_CENTRE = "ce AS (SELECT other, list(c ORDER BY f) AS centre FROM (SELECT label AS other, f, avg(x) AS c FROM lv GROUP BY label, f) GROUP BY other)"


@query(with_(EM, _LONG, _CENTRE, """d AS (SELECT id, label, other, sqrt(list_sum(list_transform(list_zip(vec, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM em, ce),
g AS (SELECT id, label, min(d) FILTER (label = other) AS own, min(d) FILTER (label <> other) - min(d) FILTER (label = other) AS margin FROM d GROUP BY id, label)""")
       + """(SELECT label, 'typical' AS kind, row_number() OVER (PARTITION BY label ORDER BY round(own, 9), id) AS rank, id, round(own, 6) AS value FROM g QUALIFY rank <= 5)
UNION ALL (SELECT label, 'borderline', row_number() OVER (PARTITION BY label ORDER BY round(margin, 9), id) AS rank, id, round(margin, 6) FROM g QUALIFY rank <= 3)""")
def examples_margin(spark, sf):
    return profiles.examples(vectors(spark, sf)).select("label", "kind", F.col("rank").cast("long").alias("rank"), "id", r6("value").alias("value"))


@query(with_(EM, _LONG, "w AS (SELECT f, avg(x) AS m, stddev_pop(x) AS sd, var_pop(x) * count(*) AS t FROM lv GROUP BY f)", "e AS (SELECT label, f, avg(x) AS c, count(*) AS k FROM lv GROUP BY label, f)")
       + "SELECT label, CAST(e.f AS INT) AS f, round((c - m) / sd, 6) AS dev, round(k * pow(c - m, 2) / (SELECT sum(t) FROM w), 8) AS contrib FROM e JOIN w ON e.f = w.f")
def mirkin(spark, sf):
    from ..operators.validity import long_vectors

    m = profiles.mirkin(long_vectors(vectors(spark, sf)))
    return m.select("label", "f", r6("dev").alias("dev"), r6("contrib", 8).alias("contrib"))


_KW_COLS = ["spend", "growth", "balance"]
_KWL = "kl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS indicator, label, {c} AS x FROM tb" for c in _KW_COLS) + ")"


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _KWL, """rk AS (SELECT indicator, label, x, rank() OVER (PARTITION BY indicator ORDER BY x) + (count(*) OVER (PARTITION BY indicator, x) - 1) / 2.0 AS r FROM kl WHERE x IS NOT NULL),
gs AS (SELECT indicator, label, sum(r)::DOUBLE AS s, count(*)::DOUBLE AS m FROM rk GROUP BY ALL), gt AS (SELECT indicator, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT indicator, x, count(*)::DOUBLE AS t FROM rk GROUP BY ALL) GROUP BY indicator),
hh AS (SELECT indicator, sum(m) AS n, count(*) AS k, (12 / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1)) / (1 - any_value(ties) / (pow(sum(m), 3) - sum(m))) AS h FROM gs JOIN gt USING (indicator) GROUP BY indicator)""")
       + "SELECT indicator, CAST(n AS BIGINT) AS n, k, round(h, 6) AS h, round((h - k + 1) / (n - k), 6) AS eta2 FROM hh")
def kruskal_wallis(spark, sf):
    t = _entities(spark, sf)
    long = t.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("x")) for c in _KW_COLS])).alias("s")).select("label", "s.*")
    k = profiles.kruskal_wallis(long)
    return k.select("indicator", "n", "k", r6("h").alias("h"), r6("eta2").alias("eta2"))


@query(with_(PY, WY, LY, _ET, _MODAL, _TB) + "SELECT entity, round(balance / median(balance) OVER (PARTITION BY region), 6) AS relative FROM tb")
def relative_to_region_median(spark, sf):
    return profiles.relative_to_median(_entities(spark, sf), "balance", "region").select("entity", r6("relative").alias("relative"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf):
    """Ranks of a whole table, without a window over all of it."""
    return profiles.spearman(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(r6("rho").alias("rho"), "n")


@query("""WITH r AS (SELECT n_name, trim(regexp_replace('  ' || n_name || '  x', '\\s+', ' ', 'g')) AS name FROM nation), m AS (SELECT trim(n_name) || ' x' AS name, n_nationkey FROM nation)
SELECT n_nationkey AS nation, count(c_custkey) AS n, count(c_acctbal) FILTER (c_acctbal > 0) AS n_positive, round(median(c_acctbal) FILTER (c_acctbal > 0), 4) AS median_positive FROM r JOIN m USING (name) LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def external_check(spark, sf):
    """Outside facts joined by name, counts of what is there by group."""
    from ..functions.columns import norm_space

    n = table(spark, sf, "nation")
    left = n.select(norm_space(F.concat(F.lit("  "), "n_name", F.lit("  x"))).alias("name"))
    right = n.select(F.concat(F.trim("n_name"), F.lit(" x")).alias("name"), F.col("n_nationkey").alias("nation"))
    c = table(spark, sf, "customer")
    met = left.join(right, "name").join(c, F.col("c_nationkey") == F.col("nation"), "left")
    positive = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return met.groupBy("nation").agg(F.count("c_custkey").alias("n"), F.count(positive).alias("n_positive"), r6(F.median(positive), 4).alias("median_positive"))


@query(with_(PY, WY, LY, _ET) + """SELECT label, count(*) AS n, round(100 * avg(share_PROMO), 5) AS pct, round(exp(avg(ln(spend))), 2) AS spend_geo FROM ly JOIN et USING (entity) GROUP BY label""")
def aligned_profile(spark, sf):
    """Profile over every entity and period of a label."""
    t = profiles.entity_table(wide_yearly(spark, sf), PARTS, (1998, 1999))
    met = labels_yearly(spark, sf).join(t, "entity")
    return met.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(100 * F.avg("share_PROMO"), 5).alias("pct"), r6(F.exp(F.avg(F.log("spend"))), 2).alias("spend_geo"))


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, f"pr AS (SELECT CAST(label AS VARCHAR) AS type, {_STATS} FROM tb GROUP BY label UNION ALL SELECT 'all', {_STATS} FROM tb)",
             "ra AS (" + " UNION ALL ".join(f"SELECT type, n, '{p}' AS p, round(pct_{p} / (SELECT pct_{p} FROM pr WHERE type = 'all'), 9) AS r FROM pr" for p in PARTS) + ")")
       + "SELECT type, printf('%d entities; most typical %s (%.2f of the mean), least %s (%.2f)', any_value(n), first(p ORDER BY r DESC, p DESC), max(r), first(p ORDER BY r, p), min(r)) AS text FROM ra GROUP BY type")
def type_descriptions(spark, sf):
    return profiles.describe(profiles.profiles(_entities(spark, sf), PARTS), PARTS)


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN CAST(n_nationkey AS DOUBLE) ELSE s_acctbal / 1000 END AS lat, CASE WHEN s_acctbal < 0 THEN CAST(n_regionkey AS DOUBLE) ELSE 10.0 END AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def coordinates_fallback(spark, sf):
    """Coordinates of the entity, else of its region."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.col("s_acctbal") >= 0
    s = s.select(F.col("s_suppkey").alias("id"), F.when(own, F.col("s_acctbal") / 1000).alias("a"), F.when(own, F.lit(10.0)).alias("b"), F.col("n_nationkey").cast("double").alias("c"), F.col("n_regionkey").cast("double").alias("d"))
    return profiles.place(s, "a", "b", "c", "d").select("id", "lat", "lon")


# -- concepts --------------------------------------------------------------

_FCA = [f"share_{p}" for p in PARTS]
_N = 4 * len(_FCA)
_MASK = " + ".join(f"CASE WHEN {c} <= q_{c}[1] THEN {1 << (4 * k)} ELSE 0 END + CASE WHEN {c} <= q_{c}[2] THEN {1 << (4 * k + 1)} ELSE 0 END + CASE WHEN {c} > q_{c}[2] THEN {1 << (4 * k + 2)} ELSE 0 END + CASE WHEN {c} > q_{c}[3] THEN {1 << (4 * k + 3)} ELSE 0 END" for k, c in enumerate(_FCA))
_OB = "qs AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _FCA) + f" FROM rt), ob AS (SELECT entity AS id, label, CAST({_MASK} AS BIGINT) AS mask FROM rt, qs)"
#: Shares rounded, so that both engines put the same rows on either side of a quartile.
_RT = "rt AS (SELECT entity, label, " + ", ".join(f"round({c}, 9) AS {c}" for c in _FCA) + " FROM tb)"
_GEN = f"""ats AS (SELECT CAST(unnest(range(0, {_N})) AS BIGINT) AS a),
ge AS (SELECT CAST(0 AS BIGINT) AS g, 0 AS len, [CAST(0 AS BIGINT)] AS o UNION ALL SELECT 1 << a, 1, [a] FROM ats UNION ALL SELECT (1 << x.a) + (1 << y.a), 2, [x.a, y.a] FROM ats x, ats y WHERE x.a < y.a
  UNION ALL SELECT (1 << x.a) + (1 << y.a) + (1 << z.a), 3, [x.a, y.a, z.a] FROM ats x, ats y, ats z WHERE x.a < y.a AND y.a < z.a)"""
_CO = """cl AS (SELECT g, any_value(len) AS len, any_value(o) AS o, bit_and(mask) AS intent, count(*) AS extent FROM ge JOIN ob ON (mask & g) = g GROUP BY g),
co AS (SELECT intent, g, len, extent FROM cl QUALIFY row_number() OVER (PARTITION BY intent ORDER BY len, o) = 1)"""
_SB = f"""dl AS (SELECT intent, extent, a, (SELECT count(*) FROM ob WHERE (mask & intent) = intent AND (mask >> a) & 1 = 0) AS d FROM co, ats WHERE (intent >> a) & 1 = 0),
sb AS (SELECT co.intent, coalesce(min(d), any_value(co.extent)) AS delta, greatest(0, 1 - coalesce(sum(pow(2.0, -d)), 0)) AS sigma_low FROM co LEFT JOIN dl ON dl.intent = co.intent GROUP BY co.intent)"""


def _objects(spark, sf):
    t = _entities(spark, sf).select(F.col("entity").alias("id"), "label", *[F.round(c, 9).alias(c) for c in _FCA])
    return fca.quartile_masks(t, _FCA)


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _RT, _OB) + "SELECT * FROM ob")
def quartile_masks(spark, sf):
    return _objects(spark, sf)


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _RT, _OB) + "SELECT a AS attribute, id FROM ob, (SELECT unnest([1, 10, 68]) AS a) WHERE mask & a = a")
def fca_extent(spark, sf):
    """The objects that have all attributes of some sets."""
    ob, out = _objects(spark, sf), None
    for a in (1, 10, 68):
        part = fca.extent(ob, a).select(F.lit(a).alias("attribute"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _RT, _OB) + f"SELECT label, CAST(bit_and(mask) AS BIGINT) AS intent FROM ob GROUP BY label UNION ALL SELECT NULL, {(1 << _N) - 1}")
def fca_intent(spark, sf):
    """What the objects of each label have in common, and what no objects have: all attributes."""
    ob, every = _objects(spark, sf), (1 << _N) - 1
    each = ob.groupBy("label").agg(F.bit_and("mask").alias("intent"))
    return each.unionByName(fca.intent(ob.where("false"), every).select(F.lit(None).cast(dict(ob.dtypes)["label"]).alias("label"), "intent"))


_YEARS = """yc AS (SELECT period, category, sum(CAST(value AS DECIMAL(18,2))) AS v FROM py GROUP BY period, category),
ym AS (SELECT period, CAST(sum(CASE WHEN v >= m THEN 1 << k ELSE 0 END) AS BIGINT) AS mask FROM yc JOIN (SELECT category, avg(v) AS m, row_number() OVER (ORDER BY category) - 1 AS k FROM yc GROUP BY category) USING (category) GROUP BY period),
yk AS (SELECT mask, row_number() OVER (ORDER BY period) - 1 AS k FROM ym),
sb AS (SELECT s, coalesce(bit_and(mask), 63) AS intent FROM (SELECT unnest(range(CAST(pow(2, (SELECT count(*) FROM yk)) AS BIGINT))) AS s) LEFT JOIN yk ON (s >> k) & 1 = 1 GROUP BY s),
sc AS (SELECT CAST(intent AS BIGINT) AS intent, count(*) AS subsets FROM sb GROUP BY intent)"""


@query(with_(PY, _YEARS) + "SELECT intent, extent, subsets / pow(2, extent) AS stability FROM (SELECT intent, subsets, (SELECT count(*) FROM yk WHERE mask & intent = intent) AS extent FROM sc)")
def fca_exact(spark, sf):
    """All concepts and their stability, of years as objects and types above their mean as attributes."""
    total = yearly(spark, sf).groupBy("period", "category").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    mean = total.groupBy("category").agg(F.avg("v").alias("m"))
    bit = F.lit(0).cast("long")
    for k, c in enumerate(CATEGORIES):
        bit = bit + F.when((F.col("category") == c) & (F.col("v") >= F.col("m")), 1 << k).otherwise(0)
    masks = total.join(mean, "category").groupBy("period").agg(F.sum(bit).alias("mask")).orderBy("period").collect()
    rows = fca.exact_stability([int(r["mask"]) for r in masks], (1 << len(CATEGORIES)) - 1)
    return spark.createDataFrame(rows, "intent long, extent long, stability double")


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _RT, _OB, _GEN, _CO) + "SELECT intent, g, CAST(len AS INT) AS len, extent FROM co")
def fca_closures(spark, sf):
    return fca.concepts(_objects(spark, sf), fca.generators(spark, _N, 3))


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _RT, _OB, _GEN, _CO, _SB) + "SELECT intent, delta, round(sigma_low, 9) AS sigma_low, round(1 - pow(2.0, -delta), 9) AS sigma_up FROM sb")
def fca_stability_bounds(spark, sf):
    ob = _objects(spark, sf)
    b = fca.stability_bounds(fca.concepts(ob, fca.generators(spark, _N, 3)), ob, _N)
    return b.select("intent", "delta", r6("sigma_low", 9).alias("sigma_low"), r6("sigma_up", 9).alias("sigma_up"))


def _clear(mask: str) -> str:
    out = mask
    for k in range(len(_FCA)):
        for strong, weak in ((4 * k, 4 * k + 1), (4 * k + 3, 4 * k + 2)):
            out = f"({out} - CASE WHEN ({mask} >> {strong}) & 1 = 1 AND ({mask} >> {weak}) & 1 = 1 THEN {1 << weak} ELSE 0 END)"
    return out


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _RT, _OB, _GEN, _CO, _SB, "sz AS (SELECT label, count(*) AS size FROM ob GROUP BY label)", """hi AS (SELECT co.intent, g, extent, ob.label, count(*) AS n_in FROM co JOIN ob ON (mask & intent) = intent GROUP BY ALL),
pf AS (SELECT *, n_in / extent AS p, n_in / size AS c, (n_in / extent) / (size / (SELECT count(*) FROM ob)) AS lift FROM hi JOIN sz USING (label)),
tp AS (SELECT *, 2 * p * c / (p + c) AS f1 FROM pf WHERE p >= 0.3 QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(2 * p * c / (p + c), 12) DESC, intent) <= 200)""")
       + f"SELECT tp.label, tp.intent, g, extent, n_in, round(p, 6) AS precision, round(c, 6) AS coverage, round(f1, 6) AS f1, round(lift, 6) AS lift, row_number() OVER (PARTITION BY tp.label ORDER BY round(f1, 12) DESC, tp.intent) AS rank, CAST({_clear('tp.intent')} AS BIGINT) AS readable FROM tp JOIN sb ON sb.intent = tp.intent WHERE sigma_low >= 0.5 QUALIFY rank <= 3")
def fca_rules(spark, sf):
    ob = _objects(spark, sf)
    r = fca.rules(fca.concepts(ob, fca.generators(spark, _N, 3)), ob, _N, 0.3, 200, 0.5)
    return r.select("label", "intent", "g", "extent", "n_in", *[r6(c).alias(c) for c in ("precision", "coverage", "f1", "lift")], F.col("rank").cast("long").alias("rank"), fca.readable(F.col("intent"), len(_FCA)).alias("readable"))


# -- serving ---------------------------------------------------------------


@query(with_(PQ, LQ) + "SELECT e.entity, p.period, coalesce(label, -1) AS label FROM (SELECT DISTINCT entity FROM lq) e, (SELECT DISTINCT period FROM lq) p LEFT JOIN lq ON lq.entity = e.entity AND lq.period = p.period")
def dense_reindex(spark, sf):
    labels = labels_quarterly(spark, sf)
    return serving.dense(labels, labels, labels, {"label": -1})


@query(with_(PY) + "SELECT category, round(sum(value) FILTER (period = 1999) / sum(value) FILTER (period = 1998) - 1, 6) AS growth FROM py GROUP BY category")
def growth_by_category(spark, sf):
    return serving.growth_by_category(yearly(spark, sf), (1998, 1999)).withColumn("growth", r6("growth"))


_STEADY = "sy AS (SELECT ly.entity, avg(CAST(ly.label = mo.label AS INT)) AS steadiness FROM ly JOIN mo USING (entity) GROUP BY ly.entity)"
_EXT = "mn AS (SELECT label, count(*) AS n, " + ", ".join(f"avg(share_{p}) / (SELECT avg(share_{p}) FROM tb) AS r_{p}" for p in PARTS) + " FROM tb GROUP BY label), ul AS (" + " UNION ALL ".join(f"SELECT label, n, '{p}' AS c, round(r_{p}, 9) AS r FROM mn" for p in PARTS) + ")"


@query(with_(PY, WY, LY, _ET, _MODAL, _TB, _STEADY, _EXT, """ex AS (SELECT label, any_value(n) AS n, first(c ORDER BY r, c) AS least, first(c ORDER BY r DESC, c DESC) AS most FROM ul GROUP BY label),
pk AS (SELECT tb.*, steadiness, row_number() OVER (PARTITION BY label ORDER BY spend DESC, tb.entity) AS r FROM tb JOIN sy ON sy.entity = tb.entity JOIN (SELECT label, median(steadiness) AS m FROM tb JOIN sy ON sy.entity = tb.entity GROUP BY label) USING (label) WHERE steadiness >= m)""")
       + "SELECT label, n, least, most, (SELECT string_agg(CAST(pk.entity AS VARCHAR), ',' ORDER BY r) FROM pk WHERE pk.label = ex.label AND r <= 4) AS examples FROM ex")
def type_cards(spark, sf):
    labels = labels_yearly(spark, sf)
    modal = serving.modal_label(labels)
    steady = labels.join(modal.withColumnRenamed("label", "m"), "entity").groupBy("entity").agg(F.avg((F.col("label") == F.col("m")).cast("int")).alias("steadiness"))
    return serving.type_cards(_entities(spark, sf).join(steady, "entity"), PARTS)


@query(with_(PY) + "SELECT entity, period, category, CAST(round_even(share * 1000, 0) AS INT) AS share FROM (SELECT *, value / sum(value) OVER (PARTITION BY entity, period) AS share FROM py)")
def quantised_shares(spark, sf):
    return serving.quantised(panel.shares(yearly(spark, sf)), "share").select("entity", "period", "category", "share")


@query(with_(PY, LY) + "SELECT period, label, category, count(*) AS n, round(avg(share), 6) AS mean_share FROM ly JOIN (SELECT *, value / sum(value) OVER (PARTITION BY entity, period) AS share FROM py) USING (entity, period) GROUP BY ALL")
def month_counts(spark, sf):
    p = serving.period_profile(labels_yearly(spark, sf), panel.shares(yearly(spark, sf)).select("entity", "period", "category", "share"))
    return p.withColumn("mean_share", r6("mean_share"))


@query(with_(PY, LY, _MODAL) + "SELECT * FROM mo")
def modal_label(spark, sf):
    return serving.modal_label(labels_yearly(spark, sf))


@query(with_(PY, LY) + "SELECT entity, '[' || string_agg('{\"period\":' || period || ',\"label\":' || label || '}', ',' ORDER BY period) || ']' AS json FROM ly GROUP BY entity")
def nested_json(spark, sf):
    """Each entity's labels as a JSON array."""
    return tables.nested(labels_yearly(spark, sf), "entity", ["period", "label"], "period")


@query("SELECT '| ' || n_name || ' | ' || CASE WHEN n_regionkey = 0 THEN '—' ELSE printf('%.1f', CAST(n_regionkey AS DOUBLE)) END || ' |' AS line FROM nation")
def markdown_rows(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey").cast("double")).alias("r"))
    return tables.markdown(n, {"r": "%.1f"})


# -- methods ---------------------------------------------------------------


@query()
def kmeans(spark, sf):
    return methods.kmeans(vectors(spark, sf), 10)


@query()
def gmm_diag(spark, sf):
    return methods.gmm_diagonal(vectors(spark, sf), 6)


def _features(spark, sf):
    """(period, id, vec) of the yearly panel."""
    cols = [*[f"share_{p}" for p in PARTS], "level", "growth"]
    f = features.standardise(features.raw(wide_yearly(spark, sf), PARTS), cols, ["period"])
    return f.select("period", F.col("entity").alias("id"), F.array(*cols).alias("vec"))


@query()
def ward(spark, sf):
    return methods.sweep(_features(spark, sf), "ward", [4, 6])


@query()
def sweep(spark, sf):
    """k-means and Ward for every year and 4 to 12 types."""
    x, out = _features(spark, sf), None
    for name in ("kmeans", "ward"):
        part = methods.sweep(x, name, range(4, 13)).select(F.lit(name).alias("method"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def spectral(spark, sf):
    return methods.sweep(_features(spark, sf), "spectral", [4])


@query()
def leiden(spark, sf):
    return methods.sweep(_features(spark, sf), "leiden", [5])


@query()
def kefrin(spark, sf):
    return methods.sweep(_features(spark, sf), "kefrin", [5])


@query()
def canus(spark, sf):
    return methods.sweep(_features(spark, sf), "canus", [5])


@query()
def aligned_labels(spark, sf):
    """k-means labels of each year, renamed to agree with the entities' modes."""
    labels = methods.sweep(_features(spark, sf), "kmeans", [5]).select(F.col("id").alias("entity"), "period", "label")
    return methods.consensus(labels)


@query()
def bootstrap_stability(spark, sf):
    """KEFRiN with 7 types again on 80 %: 100 draws of the whole period's features, 10 of each of four years."""
    cols = [*[f"share_{p}" for p in PARTS], "level", "growth"]
    mean = features.mean_and_trend(features.raw(wide_yearly(spark, sf), PARTS), cols, F.col("period"))
    both = [f"{kind}_{c}" for c in cols for kind in ("mean", "trend")]
    # an entity seen once has no slope
    through = features.standardise_all(mean.fillna(0.0, both), both).select(F.col("entity").alias("id"), F.array(*both).alias("vec"))
    # draws, neighbours and references read the same rows
    through, v, out = graph.settled(through), graph.settled(_features(spark, sf)), None
    for name, x, runs in [("all", through, 100), *[(str(y), v.where(F.col("period") == y).select("id", "vec"), 10) for y in (1995, 1997, 1999, 2001)]]:
        ref = methods.sweep(x.select(F.lit(0).alias("period"), "id", "vec"), "kefrin", [7]).select(F.col("id").alias("entity"), "label")
        found = methods.subsample_stability(x, ref, "kefrin", 7, runs).select(F.lit(name).alias("period"), "*")
        out = found if out is None else out.unionByName(found)
    return methods.stability_summary(out, ["period"])


@query("SELECT CAST(m AS VARCHAR) AS method, CAST(p AS INT) AS period, CAST(k AS INT) AS k FROM (SELECT unnest(['kmeans', 'ward']) AS m), (SELECT unnest(range(1995, 2002)) AS p), (SELECT unnest([4, 5]) AS k) WHERE NOT (m = 'ward' AND k = 4)")
def label_cache(spark, sf):
    """What a cache of labels lacks."""
    p = labels_yearly(spark, sf).select("period").distinct()
    wanted = p.select("period", F.explode(F.array(F.lit("kmeans"), F.lit("ward"))).alias("method")).select("method", "period", F.explode(F.array(F.lit(4), F.lit(5))).alias("k"))
    cache = p.select(F.lit("ward").alias("method"), "period", F.lit(4).alias("k"))
    return methods.missing(wanted, cache)


