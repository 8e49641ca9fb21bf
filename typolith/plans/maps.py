"""Map geometry over places made of the suppliers' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from .base import query, r6, table

_PL = "pl AS (SELECT s_suppkey AS id, s_nationkey AS region, 41.0 + (s_suppkey * 37 % 3000) / 100.0 AS lat, 20.0 + (s_suppkey * 83 % 16000) / 100.0 AS lon, s_acctbal AS balance FROM supplier)"
_N = "((sin(radians(52.0)) + sin(radians(64.0))) / 2)"
_K = f"(pow(cos(radians(52.0)), 2) + 2 * {_N} * sin(radians(52.0)))"
_RHO = "(6371.0 * sqrt(greatest(0, {k} - 2 * {n} * sin(radians({lat})))) / {n})"
_XY = f"xy AS (SELECT id, region, {_RHO.format(k=_K, n=_N, lat='lat')} * sin({_N} * radians(lon - 100.0)) AS x, {_RHO.format(k=_K, n=_N, lat='0.0')} - {_RHO.format(k=_K, n=_N, lat='lat')} * cos({_N} * radians(lon - 100.0)) AS y FROM pl)"


def _places(spark, sf):
    """Projected suppliers: (id, region, x, y, value)."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("region"), (41.0 + (k * 37 % 3000) / 100.0).alias("lat"), (20.0 + (k * 83 % 16000) / 100.0).alias("lon"), F.greatest(F.lit(0.0), "s_acctbal").alias("value"))
    x, y = geometry.albers(F.col("lat"), F.col("lon"), 52.0, 64.0, 0.0, 100.0)
    return s.select("id", "region", x.alias("x"), y.alias("y"), "value")


@query(f"WITH {_PL}, {_XY} SELECT id, round(x, 5) AS x, round(y, 5) AS y, round_even(x / 50, 0) * 50 AS grid_x FROM xy")
def albers_projection(spark, sf):
    return _places(spark, sf).select("id", r6("x", 5).alias("x"), r6("y", 5).alias("y"), geometry.snap(F.col("x"), 50.0).alias("grid_x"))


@query(f"""WITH {_PL}, {_XY}, a AS (SELECT id, (sqrt(3.0) / 3 * x - y / 3) / 200 AS q, 2.0 / 3 * y / 200 AS r FROM xy),
b AS (SELECT id, q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM b)
SELECT id, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS INT) AS q, CAST(CASE WHEN dr >= dq AND dr > ds THEN -rq - rs ELSE rr END AS INT) AS r FROM c""")
def hex_cells(spark, sf):
    q, r = geometry.hex_cell(F.col("x"), F.col("y"), 200.0)
    return _places(spark, sf).select("id", q.alias("q"), r.alias("r"))


@query()
def circle_cartogram(spark, sf):
    c = geometry.circles(_places(spark, sf), "region", 1.0)
    return c.select("region", "id", *[r6(k, 3).alias(k) for k in ("x", "y", "r")])


@query()
def hexagon_cartogram(spark, sf):
    return geometry.hexagons(_places(spark, sf), "region", 100.0)


@query()
def simplified_lines(spark, sf):
    """Each region's places as a line in order of key, simplified."""
    rows = F.array_sort(F.collect_list(F.struct("id", "x", "y")))
    lines = _places(spark, sf).groupBy(F.col("region").cast("long").alias("region")).agg(rows.alias("p"))
    lines = lines.select(F.col("region").alias("id"), F.transform("p", lambda v: v["x"]).alias("x"), F.transform("p", lambda v: v["y"]).alias("y"))
    got = geometry.simplified(lines, 300.0)
    return got.select("id", F.size("x").alias("n"))
