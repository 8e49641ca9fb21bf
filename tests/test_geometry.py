import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from typolith.operators import geometry


def test_projection_keeps_area_and_centre(spark):
    df = spark.createDataFrame([(60.0, 100.0), (60.0, -179.0), (61.0, 101.0)], "lat double, lon double")
    x, y = geometry.albers(F.col("lat"), F.col("lon"), 52.0, 64.0, 60.0, 100.0)
    a, b, c = df.select(x.alias("x"), y.alias("y")).collect()
    assert (a.x, a.y) == pytest.approx((0, 0)) and b.x > 0  # the far side is east
    assert math.hypot(c.x, c.y) == pytest.approx(124, abs=3)


def test_snap_and_cells(spark):
    df = spark.createDataFrame([(0.25, 0.0), (0.75, 0.0)], "x double, y double")
    assert [r.s for r in df.select(geometry.snap(F.col("x"), 0.5).alias("s")).collect()] == [0.0, 1.0]
    rng = np.random.default_rng(0)
    pts = rng.normal(0, 5, (200, 2))
    q, r = geometry.hex_cell(F.col("x"), F.col("y"), 1.0)
    got = spark.createDataFrame(pts.tolist(), "x double, y double").select("x", "y", q.alias("q"), r.alias("r")).collect()
    for p in got:  # no neighbouring centre is nearer
        def d(q, r):
            return math.hypot(math.sqrt(3) * (q + r / 2) - p.x, 1.5 * r - p.y)

        assert all(d(p.q, p.r) <= d(p.q + i, p.r + j) + 1e-9 for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)))


def test_simplify():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float)
    assert geometry.simplify(line, 0.1).tolist() == [True, False, True, True, True]


def test_circles_part_and_hexagons_differ(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x), float(y), 4.0) for g in ("a", "b") for i, (x, y) in enumerate(rng.normal(0, 3, (12, 2)))]
    df = spark.createDataFrame([*rows, ("c", 0, 1.0, 1.0, 1.0), ("c", 1, 1.0, 1.0, 1.0)], "g string, id long, x double, y double, value double")
    got = geometry.circles(df, "g").collect()
    for g in "abc":
        own = [r for r in got if r.g == g]
        assert all(math.hypot(p.x - q.x, p.y - q.y) > 0.9 * (p.r + q.r) for p in own for q in own if p.id < q.id)
    cells = geometry.hexagons(df, "g").collect()
    assert len({(r.g, r.q, r.r) for r in cells}) == len(cells) == 26


def test_circles_are_compared_by_cells_as_by_all_pairs():
    rng = np.random.default_rng(8)
    x, y, r = rng.uniform(0, 60, 300), rng.uniform(0, 30, 300), rng.uniform(0.1, 2, 300)
    x[:3], y[:3] = 7.0, 7.0
    i, j = geometry.near_pairs(x, y, 2 * r.max())
    near = np.hypot(x[:, None] - x[None], y[:, None] - y[None]) <= 2 * r.max()
    assert {(a, b) for a, b in zip(*np.nonzero(near)) if a != b} <= set(zip(i, j, strict=True)) and len(i) == len(set(zip(i, j, strict=True))) < 300 * 299 / 2
    # one round by hand
    dx, dy = x[:, None] - x[None], y[:, None] - y[None]
    d, turn = np.hypot(dx, dy), np.arange(300)[:, None] - np.arange(300)[None]
    same = d < 1e-9
    gap = np.maximum(0, r[:, None] + r[None] - np.where(same, 0, d)) * (turn != 0)
    ux = np.where(same, np.cos(turn) * np.sign(turn), dx / np.where(same, 1, d))
    want = x + (gap * r[None] / (r[:, None] + r[None]) * ux).sum(axis=1) * 0.5
    assert geometry.relax(x, y, r, 1)[0] == pytest.approx(want)
