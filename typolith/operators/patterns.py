"""Order patterns: the signs of pairwise differences between features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(n: int, mode: str = "all") -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(n - 1)] if mode == "adjacent" else [(i, j) for i in range(n) for j in range(i + 1, n)]


def codes(columns: Sequence[str], mode: str = "all", eps: float = 0.0) -> Column:
    """An array with a sign for each pair; differences up to eps are 0."""

    def sign(i: int, j: int) -> Column:
        d = F.col(columns[i]) - F.col(columns[j])
        return F.when(F.abs(d) <= eps, 0).otherwise(F.signum(d)).cast("int")

    return F.array(*[sign(i, j) for i, j in pairs(len(columns), mode)])


def dictionary(coded: DataFrame) -> DataFrame:
    """(code, n, cluster): codes numbered by falling frequency, lexicographic among equals, a missing sign last."""
    counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are codes, which the number of features bounds
    order = F.transform("code", lambda x: F.coalesce(x, F.lit(2)))
    return counts.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), order)) - 1)


def clusters(coded: DataFrame) -> DataFrame:
    return coded.join(dictionary(coded).select("code", "cluster"), "code")


def text(code: Column, names: Sequence[str]) -> Column:
    """All-pairs code as 'a > b = c': features by net wins, '=' between equal ones; the first name first.

    Pairs without a sign don't count, names that have no other pairs are left out; null if that leaves none.
    """
    n = len(names)
    wins = []
    for f in range(n):
        own = [F.get(code, F.lit(k)) * (1 if f == i else -1) for k, (i, j) in enumerate(pairs(n)) if f in (i, j)]
        total = sum((F.coalesce(x, F.lit(0)) for x in own), F.lit(0))
        wins.append(F.when(F.coalesce(*own).isNotNull(), F.struct((-total).alias("s"), F.lit(f).alias("k"), F.lit(names[f]).alias("name"))))
    order = F.array_sort(F.array_compact(F.array(*wins)))
    start = F.struct(F.lit(None).cast("int").alias("s"), F.lit("").alias("t"))

    def step(acc: Column, x: Column) -> Column:
        sep = F.when(acc["s"].isNull(), "").when(acc["s"] == x["s"], " = ").otherwise(" > ")
        return F.struct(x["s"].alias("s"), F.concat(acc["t"], sep, x["name"]).alias("t"))

    return F.aggregate(order, start, step, lambda a: F.nullif(a["t"], F.lit("")))


def merge(table: list[tuple[list[int], int, list[float]]], least: int = 2) -> dict[int, list[int]]:
    """Labels of patterns (code, rows, sum of points) for every number of clusters down to least.

    Of the pairs at the least Hamming distance, single linkage, the one whose union adds the
    least within-cluster scatter joins; the first in order among equals.
    """
    n = np.array([t[1] for t in table], float)
    s = np.array([t[2] for t in table], float)
    code = np.array([t[0] for t in table])
    h = (code[:, None, :] != code[None, :, :]).sum(axis=2).astype(float)
    np.fill_diagonal(h, np.inf)
    label, alive, out = np.arange(len(table)), list(range(len(table))), {}

    def record() -> None:
        out[len(alive)] = [alive.index(x) for x in label]

    record()
    while len(alive) > least:
        sub = np.array(alive)
        part = h[np.ix_(sub, sub)]
        a, b = np.nonzero(np.triu(part == part.min(), 1))
        p, q = sub[a], sub[b]
        gap = s[p] / n[p][:, None] - s[q] / n[q][:, None]
        k = int(np.argmin(n[p] * n[q] / (n[p] + n[q]) * (gap * gap).sum(axis=1)))
        x, y = int(p[k]), int(q[k])
        n[x] += n[y]
        s[x] += s[y]
        h[x] = np.minimum(h[x], h[y])
        h[:, x] = h[x]
        h[x, x] = np.inf
        label[label == y] = x
        alive.remove(y)
        record()
    return out
