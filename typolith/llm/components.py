"""Connected components of an edge table, by alternating stars.

Each round every node passes its larger neighbours, then its smaller ones, on to the
least node it knows (large star, small star).  Both are a minimum per node and a join,
so no node's neighbours are ever gathered in one task; rounds end when nothing moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b); a node keeps its least neighbour and passes the others to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    # written, so that the join that follows can split the neighbours of one node
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "cc-least")
    if large:
        both = both.where("b > a")
    met = both.join(least, "a")
    out = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        now = cut(_star(_star(now, True), False), "cc", now)
        then, seen = seen, mark(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
