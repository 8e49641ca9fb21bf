"""Map geometry: projection, snapping, simplification, cartogram layouts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passes import dealt


def albers(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float, radius: float = 6371.0) -> tuple[Column, Column]:
    """Equal-area conic coordinates in km, on a sphere, from degrees and two standard parallels."""
    a, b, c = (math.radians(x) for x in (lat1, lat2, lat0))
    n = (math.sin(a) + math.sin(b)) / 2
    k = math.cos(a) ** 2 + 2 * n * math.sin(a)
    rho0 = radius * math.sqrt(k - 2 * n * math.sin(c)) / n
    rho = radius * F.sqrt(F.greatest(F.lit(0.0), k - 2 * n * F.sin(F.radians(lat)))) / n
    turn = F.pmod(lon - lon0 + 180.0, F.lit(360.0)) - 180.0  # the nearer way round
    theta = n * F.radians(turn)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def snap(x: Column, step: float) -> Column:
    """To the nearest multiple of step, halves to the even one."""
    return F.rint(x / step) * step


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the pointy hexagon with that side which a point is in."""
    q = (math.sqrt(3) / 3 * x - y / 3) / size
    r = 2 / 3 * y / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return (
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("int"),
        F.when((dr >= dq) & (dr > ds), -rq - rs).otherwise(rr).cast("int"),
    )


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line to keep: recursively the one farthest from the chord, while it is off by more than tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        size = float(np.hypot(*d))
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size > 0 else np.hypot(rest[:, 0], rest[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines (id, x, y), arrays of coordinates, with fewer points."""

    def run(it):
        for pdf in it:
            out = []
            for i, x, y in zip(pdf.id, pdf.x, pdf.y, strict=True):
                p = np.column_stack([np.asarray(x, float), np.asarray(y, float)])
                keep = simplify(p, tolerance) if len(p) > 2 else np.ones(len(p), bool)
                out.append((i, p[keep, 0].tolist(), p[keep, 1].tolist()))
            yield pd.DataFrame(out, columns=["id", "x", "y"])

    return lines.select("id", "x", "y").mapInPandas(run, "id long, x array<double>, y array<double>")


def near_pairs(x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of different points no farther apart than reach, and some that are, by cells of that size; by first, then second point."""
    cx, cy = (np.floor((v - v.min()) / reach).astype(np.int64) for v in (x, y))
    wide = int(cy.max()) + 3  # an empty column on either side
    cell = cx * wide + cy
    order = np.argsort(cell, kind="stable")
    held = cell[order]
    first, second = [], []
    for step in (a * wide + b for a in (-1, 0, 1) for b in (-1, 0, 1)):
        lo, hi = np.searchsorted(held, cell + step, "left"), np.searchsorted(held, cell + step, "right")
        n = hi - lo
        i = np.repeat(np.arange(len(x)), n)
        first.append(i)
        second.append(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(i))])
    i, j = np.concatenate(first), np.concatenate(second)
    i, j = i[i != j], j[i != j]
    by = np.lexsort((j, i))
    return i[by], j[by]


def relax(x: np.ndarray, y: np.ndarray, r: np.ndarray, rounds: int = 300, pull: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Circles pushed apart where they overlap and pulled back to where they began; only those in cells near each other are compared."""
    px, py = x.astype(float).copy(), y.astype(float).copy()
    n = len(px)
    for _ in range(rounds if n else 0):
        i, j = near_pairs(px, py, 2 * float(r.max()))
        dx, dy = px[i] - px[j], py[i] - py[j]
        d = np.hypot(dx, dy)
        gap = r[i] + r[j] - np.where(d < 1e-9, 0.0, d)
        over = gap > 0
        i, j, dx, dy, d, gap = i[over], j[over], dx[over], dy[over], d[over], gap[over]
        if gap.max(initial=0.0) < 1e-6:
            break
        # circles on one spot part along an angle of their own
        same, turn = d < 1e-9, i - j
        dx, dy, d = np.where(same, np.cos(turn) * np.sign(turn), dx), np.where(same, np.sin(turn) * np.sign(turn), dy), np.where(same, 1.0, d)
        push = gap * r[j] / (r[i] + r[j]) / d * 0.5  # the smaller one gives way
        free = np.bincount(i, minlength=n) == 0
        px += np.bincount(i, push * dx, n)
        py += np.bincount(i, push * dy, n)
        px += pull * (x - px) * free
        py += pull * (y - py) * free
    return px, py


def circles(df: DataFrame, group: str, scale: float = 1.0) -> DataFrame:
    """Cartogram of circles with area by value, for each group of (id, x, y, value): (group, id, x, y, r)."""
    kind = dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        r = scale * np.sqrt(pdf.value.to_numpy(float).clip(0))
        x, y = relax(pdf.x.to_numpy(float), pdf.y.to_numpy(float), np.maximum(r, 1e-9))
        return pd.DataFrame({group: pdf[group], "id": pdf.id, "x": x, "y": y, "r": r})

    return dealt(df.select(group, "id", "x", "y", "value"), group).groupBy(group).applyInPandas(run, f"{group} {kind}, id long, x double, y double, r double")


def hexagons(df: DataFrame, group: str, size: float = 1.0) -> DataFrame:
    """A hexagon for each entity of a group, the free one nearest to it; those in the middle choose first: (group, id, q, r)."""
    kind = dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, ids = pdf.x.to_numpy(float), pdf.y.to_numpy(float), pdf.id.to_numpy()
        order = np.lexsort((ids, np.round(np.hypot(x - x.mean(), y - y.mean()), 9)))
        taken, out = set(), []
        for k in order:
            q0, r0 = round((math.sqrt(3) / 3 * x[k] - y[k] / 3) / size), round(2 / 3 * y[k] / size)
            ring, best = 0, None
            while best is None:
                near = []
                for dq in range(-ring, ring + 1):
                    for dr in range(max(-ring, -dq - ring), min(ring, -dq + ring) + 1):
                        c = (q0 + dq, r0 + dr)
                        if max(abs(dq), abs(dr), abs(dq + dr)) == ring and c not in taken:
                            cx, cy = size * math.sqrt(3) * (c[0] + c[1] / 2), size * 1.5 * c[1]
                            near.append((round(math.hypot(cx - x[k], cy - y[k]), 9), c))
                best = min(near)[1] if near else None
                ring += 1
            taken.add(best)
            out.append((pdf[group].iloc[0], int(ids[k]), *best))
        return pd.DataFrame(out, columns=[group, "id", "q", "r"])

    return df.select(group, "id", "x", "y").groupBy(group).applyInPandas(run, f"{group} {kind}, id long, q int, r int")
