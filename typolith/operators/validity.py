"""Internal validity indices of a labelling, in feature space and on a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import Blocks, group_distance_sums, label_distances, load, put, raw

#: 1 where more is better, -1 where less is.
DIRECTION = {"SW": 1, "CH": 1, "S_Dbw": -1, "AVI": 1, "AVU": -1, "ANUI": 1, "MQ": 1}


def silhouettes(df: DataFrame) -> DataFrame:
    """(id, label, s) from (id, vec, label): plain Euclidean; 0 for a label's only row."""
    sums = group_distance_sums(df)
    sizes = df.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    met = sums.join(F.broadcast(sizes), "other")
    own = F.col("label") == F.col("other")
    row = met.groupBy("id", "label").agg(
        F.max(F.when(own, F.col("s"))).alias("_s"),
        F.max(F.when(own, F.col("n"))).alias("_n"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
    )
    a = F.when(F.col("_n") > 1, F.col("_s") / (F.col("_n") - 1)).otherwise(0.0)
    top = F.greatest(a, F.col("b"))
    return row.select("id", "label", F.when((F.col("_n") == 1) | (top == 0), 0.0).otherwise((F.col("b") - a) / top).alias("s"))


def silhouette(df: DataFrame) -> DataFrame:
    """The mean silhouette; null with fewer than two labels."""
    return silhouettes(df).agg(F.avg("s").alias("SW"))


def long_vectors(df: DataFrame) -> DataFrame:
    """(id, label, f, x): a row for each feature."""
    return df.select("id", "label", F.posexplode("vec").alias("f", "x")).withColumn("x", F.col("x").cast("double"))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """Between over within variance; null with one label or as many as rows, infinite without scatter within."""
    long = long_vectors(df)
    group = long.groupBy("label", "f").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = long.groupBy("f").agg(F.avg("x").alias("g"))
    met = group.join(F.broadcast(total), "f")
    sums = met.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.countDistinct("label").alias("k"))
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    bad = (F.col("k") < 2) | (F.col("k") >= F.col("n"))
    return sums.crossJoin(rows).select(F.when(bad, F.lit(None)).when(F.col("w") == 0, F.lit(float("inf"))).otherwise(ch).alias("CH"))


def s_dbw(df: DataFrame, variant: str = "paper") -> DataFrame:
    """Scatter plus density between centres; ``paper`` takes variances and both clusters, ``package`` deviations and the own one.

    Centres and their midpoints are as many as labels and pairs of labels; each row meets them once.
    """
    long = long_vectors(df)
    spread = F.var_pop("x") if variant == "paper" else F.stddev_pop("x")
    group = long.groupBy("label", "f").agg(F.avg("x").alias("c"), spread.alias("v"))
    size = group.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda x: x["c"]).alias("centre"))
    whole = long.groupBy("f").agg(spread.alias("v")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("all"))
    scale = size.agg((F.sqrt(F.sum("size")) / F.count(F.lit(1))).alias("radius"), F.avg("size").alias("mean_size"), F.count(F.lit(1)).alias("k")).crossJoin(whole)
    a, b = size.select(F.col("label").alias("k1"), F.col("centre").alias("c1")), size.select(F.col("label").alias("k2"), F.col("centre").alias("c2"))
    pairs = a.join(b, F.col("k1") < F.col("k2")).withColumn("mid", F.zip_with("c1", "c2", lambda x, y: (x + y) / 2)).crossJoin(scale.select("radius"))
    rows = df.select("label", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    met = rows.join(F.broadcast(pairs), (F.col("label") == F.col("k1")) | (F.col("label") == F.col("k2")))

    def near(c: str):
        return F.sqrt(F.aggregate(F.zip_with("vec", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) <= F.col("radius")

    in1 = near("c1") if variant == "paper" else near("c1") & (F.col("label") == F.col("k1"))
    in2 = near("c2") if variant == "paper" else near("c2") & (F.col("label") == F.col("k2"))
    dens = met.groupBy("k1", "k2").agg(F.count_if(near("mid")).alias("u"), F.count_if(in1).alias("d1"), F.count_if(in2).alias("d2"))
    top = F.greatest("d1", "d2")
    ratio = F.when(top == 0, 0.0).otherwise(F.col("u") / F.when(top == 0, F.lit(1)).otherwise(top))
    between = dens.agg(F.coalesce(F.sum(ratio), F.lit(0.0)).alias("r"))
    out = scale.crossJoin(between)
    k = F.col("k")
    return out.select(F.when(k < 2, F.lit(None)).otherwise(F.col("mean_size") / F.col("all") + 2 * F.col("r") / F.greatest(F.lit(1), k * (k - 1))).alias("S_Dbw"))


def block_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, s): weight between labels, both directions counted, from (src, dst, w) and (id, label)."""
    src = labels.select(F.col("id").alias("src"), F.col("label").alias("a"))
    dst = labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return edges.join(src, "src").join(dst, "dst").groupBy("a", "b").agg(F.sum("w").alias("s"))


def graph_indices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """AVI, AVU, ANUI, MQ; labels without edges count as clusters."""
    blocks = block_matrix(edges, labels)
    names = labels.select(F.col("label").alias("a")).distinct()
    totals = blocks.groupBy("a").agg(F.sum("s").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s")).otherwise(0.0)).alias("own"))
    totals = names.join(totals, "a", "left").select("a", F.coalesce("tot", F.lit(0.0)).alias("tot"), F.coalesce("own", F.lit(0.0)).alias("own"))
    out = totals.select(F.col("a"), (F.col("tot") - F.col("own")).alias("out"))
    met = blocks.where("a <> b").join(out, "a").join(out.select(F.col("a").alias("b"), F.col("out").alias("out_b")), "b")
    room = F.col("out") + F.col("out_b") - F.col("s")
    u = met.agg(F.coalesce(F.sum(F.when(room > 0, F.col("s") / F.when(room > 0, room).otherwise(1.0)).otherwise(0.0)), F.lit(0.0)).alias("u"))
    sums = totals.agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("tot") > 0, F.col("own") / F.when(F.col("tot") > 0, F.col("tot")).otherwise(1.0)).otherwise(0.0)).alias("i"), F.sum("tot").alias("m"), F.sum("own").alias("o"), F.sum(F.col("tot") * F.col("tot")).alias("sq"))
    avi, avu = F.col("i") / F.col("k"), F.col("u") / F.col("k")
    return sums.crossJoin(u).select(
        avi.alias("AVI"),
        avu.alias("AVU"),
        F.when(avi == 0, 0.0).otherwise(1 / (avu + 1 / F.when(avi == 0, F.lit(1.0)).otherwise(avi))).alias("ANUI"),
        F.try_divide("o", "m").__sub__(F.try_divide("sq", F.col("m") * F.col("m"))).alias("MQ"),
    )


def permutations(labels: DataFrame, n: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """(perm, id, label): shuffles of (id, label) that keep the sizes; perm 0 is the labelling itself.

    The i-th row by ``order`` (a hash of id and perm), then id, gets the label of the i-th by id, so a
    permutation is one window partition and nothing passes the driver.
    """
    base = labels.select("id", "label")
    perms = base.select("id", "label", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"))
    w = Window.partitionBy("perm")
    place = F.xxhash64("id", "perm", F.lit(seed)) if order is None else order
    ranked = perms.withColumns({"_i": F.row_number().over(w.orderBy("id")), "_j": F.row_number().over(w.orderBy(place, "id"))})
    taken = ranked.select("perm", F.col("_i").alias("_j"), "label").join(ranked.select("perm", "_j", "id"), ["perm", "_j"])
    return base.select(F.lit(0).alias("perm"), "id", "label").unionByName(taken.select("perm", "id", "label"))


def hashed(ids: np.ndarray, perm: int, seed: int, wide: bool = True) -> np.ndarray:
    """Spark's xxhash64(id, perm, seed) of ids that are bigint, or int where not wide."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def left(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def end(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    def of_int(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        h = h + p5 + np.uint64(4)
        return end(left(h ^ ((x & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3)

    def of_long(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        h = h + p5 + np.uint64(8)
        return end(left(h ^ (left(x * p2, 31) * p1), 27) * p1 + p4)

    x = ids.astype(np.int64).view(np.uint64)
    h = (of_long if wide else of_int)(x, np.full(len(x), 42, np.uint64))
    for c in (perm, seed):
        h = of_int(np.full(1, c, np.int64).view(np.uint64), h)
    return h.view(np.int64)


class Labellings:
    """Labellings of the same rows, each label a small number, in files of the shared folder.

    ``rows`` are blocks in the order of id, which hold each row's vector, too, where there is one, and beside
    it its labels in all labellings.  ``groups`` are files of a few labellings each, a row of labels for each row.
    """

    def __init__(self, df: DataFrame, group: int = 8):
        at = df.select("id", "label", *(["vec"] if "vec" in df.columns else []))
        self.names = [r[0] for r in df.select("label").distinct().orderBy("label").collect()]
        self.k, self.group = len(self.names), group
        self.kind = next(t for t in ("uint8", "uint16", "uint32") if self.k <= np.iinfo(t).max + 1)
        self.vectors = "vec" in df.columns
        self.id_type = dict(df.dtypes)["id"]
        own = self.number(at.withColumn("id", F.col("id").cast("long")))
        self.rows = Blocks(own, ["id", "c", *(["vec"] if self.vectors else [])], by="id")
        self.folder, self.n, self.p = self.rows.folder, self.rows.n, 0
        self.groups: list[str] = []

    def number(self, df: DataFrame) -> DataFrame:
        return df.withColumn("c", (F.array_position(F.array(*map(F.lit, self.names)), F.col("label")) - 1).cast("int"))

    def each_group(self, n: int, fn: Callable[[int], Iterator[dict[str, np.ndarray]]], schema: str) -> pa.Table:
        """What fn makes of each of n numbers, a task each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.column(0).to_pylist():
                    for made in fn(g):
                        yield pa.RecordBatch.from_arrays([pa.array(made[c.split()[0]]) for c in schema.split(", ")], names=[c.split()[0] for c in schema.split(", ")])

        return self.rows.spark.range(0, n, 1, max(n, 1)).mapInArrow(run, schema).toArrow()

    def kept(self, n: int, p: int, made: pa.Table) -> Labellings:
        """Labellings in groups that were written; beside each block of vectors its rows' labels are put together."""
        by = dict(zip(made.column("g").to_pylist(), made.column("file").to_pylist()))
        self.groups, self.p = [by[g] for g in range(n)], p
        if self.vectors:
            folder, kind, files, group, starts = self.folder, self.kind, self.groups, self.group, [*self.rows.starts, self.n]

            def beside(b: int) -> Iterator[dict[str, np.ndarray]]:
                lo, m = starts[b], starts[b + 1] - starts[b]
                wide = [min(group, p - g * group) for g in range(len(files))]
                labels = np.concatenate([raw(folder, f, kind, lo * w, m * w).reshape(m, w) for f, w in zip(files, wide)], axis=1)
                at = put(folder, "beside", lambda out: out.write(np.ascontiguousarray(labels).tobytes()))
                yield {"g": np.array([b]), "file": np.array([at])}

            made = self.each_group(len(self.rows.files), beside, "g long, file string")
            by = dict(zip(made.column("g").to_pylist(), made.column("file").to_pylist()))
            self.rows.beside, self.rows.shape = [by[b] for b in range(len(self.rows.files))], (p, kind)
        return self

    @staticmethod
    def shuffles(df: DataFrame, n: int, seed: int = 42, key: Callable[[np.ndarray, int], np.ndarray] | None = None, group: int = 8) -> Labellings:
        """(id, label), with vec or without, and n shuffles of its labels that keep the sizes.

        The i-th row by ``key`` of ids and number (a hash as in ``permutations``), then id, gets the label of the i-th by id.
        A task makes a few shuffles from all ids and labels, of which it holds some numbers a row.
        """
        out = Labellings(df, group)
        folder, files, kind, wide = out.folder, sum(out.rows.files, []), out.kind, out.id_type == "bigint"
        place = key or (lambda ids, perm: hashed(ids, perm, seed, wide))

        def make(g: int) -> Iterator[dict[str, np.ndarray]]:
            rows = load(folder, files, ["id", "c"])
            c = rows["c"].astype(kind)
            perms = range(g * group, min((g + 1) * group, n + 1))
            labels = np.empty((len(c), len(perms)), kind)
            for j, perm in enumerate(perms):
                order = np.argsort(place(rows["id"], perm), kind="stable") if perm else slice(None)
                labels[order, j] = c
            at = put(folder, "group", lambda file: file.write(labels.tobytes()))
            yield {"g": np.array([g]), "file": np.array([at])}

        m = -(-(n + 1) // group) if files else 0
        return out.kept(m, n + 1, out.each_group(m, make, "g long, file string"))

    @staticmethod
    def of(df: DataFrame, perms: DataFrame, group: int = 8) -> Labellings:
        """The labellings (perm, id, label), numbered from 0, of the rows of df."""
        own = perms.where("perm = 0").select("id", "label")
        out = Labellings(df.drop("label").join(own, "id") if "vec" in df.columns else own, group)
        folder, kind, n = out.folder, out.kind, out.n
        p = perms.agg(F.countDistinct("perm")).first()[0]

        def make(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["id", "perm"])
            labels = pdf.c.to_numpy().astype(kind)
            at = put(folder, "group", lambda file: file.write(labels.tobytes()))
            return pd.DataFrame({"g": [pdf.g.iloc[0]], "file": [at], "n": [len(pdf)]})

        told = out.number(perms).select(F.expr(f"cast(perm div {group} as long)").alias("g"), "perm", "id", "c")
        made = told.groupBy("g").applyInPandas(make, "g long, file string, n long").toArrow()
        if sum(made.column("n").to_pylist()) != p * n:
            raise ValueError("a labelling lacks some rows or has rows twice")
        return out.kept(-(-p // group), p, made)

    def total(self, fn: Callable[[int, int], np.ndarray], size: int) -> np.ndarray:
        """What fn makes of the labellings from one number up to another, as many numbers for each labelling, a task a group."""
        p, group = self.p, self.group

        def run(g: int) -> Iterator[dict[str, np.ndarray]]:
            first, last = g * group, min((g + 1) * group, p)
            x = fn(first, last).ravel()
            at = np.flatnonzero(x)
            yield {"at": at + first * size, "x": x[at]}

        got = self.each_group(len(self.groups), run, "at long, x double")
        out = np.zeros(p * size)
        out[got.column("at").to_numpy()] = got.column("x").to_numpy()
        return out.reshape(p, size)


def graph_scores(edges: DataFrame, told: Labellings, block: int = 1 << 18) -> dict[str, np.ndarray]:
    """AVI, AVU, ANUI and MQ of each labelling: a task reads the edges for a few labellings and looks their ends up."""
    p, k, group, kind, folder, groups, rows = told.p, told.k, told.group, told.kind, told.folder, told.groups, sum(told.rows.files, [])
    links = Blocks(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")), ["src", "dst", "w"], block)
    files, at = links.files, links.folder

    def sums(first: int, last: int) -> np.ndarray:
        ids = load(folder, rows, ["id"])["id"]
        labels = raw(folder, groups[first // group], kind).reshape(len(ids), last - first)
        out = np.zeros((last - first, k * k))
        for f in files:
            e = load(at, f, ["src", "dst", "w"])
            i, j = (np.minimum(np.searchsorted(ids, e[c]), len(ids) - 1) for c in ("src", "dst"))
            both = (ids[i] == e["src"]) & (ids[j] == e["dst"])
            i, j, w = i[both], j[both], e["w"][both]
            for q in range(last - first):
                own = labels[:, q].astype(np.int64)
                out[q] += np.bincount(own[i] * k + own[j], w, k * k)
        return out

    s = told.total(sums, k * k).reshape(p, k, k)
    own, tot = np.einsum("pkk->pk", s), s.sum(axis=2)
    m = tot.sum(axis=1)
    avi = np.divide(own, tot, out=np.zeros_like(own), where=tot > 0).mean(axis=1)
    out = tot - own
    room = out[:, :, None] + out[:, None, :] - s
    ratio = np.divide(s, room, out=np.zeros_like(s), where=room > 0) * (1 - np.eye(k))
    avu = ratio.sum(axis=(1, 2)) / k
    anui = np.where(avi > 0, 1 / (avu + 1 / np.where(avi > 0, avi, 1)), 0.0)
    mq = np.where(m > 0, own.sum(axis=1) / np.where(m > 0, m, 1) - (tot * tot).sum(axis=1) / np.where(m > 0, m * m, 1), np.nan)
    return {"AVI": avi, "AVU": avu, "ANUI": anui, "MQ": mq}


def feature_scores(told: Labellings, variant: str = "paper", density: bool = True) -> dict[str, np.ndarray]:
    """SW, CH and, where density is asked for, S_Dbw of each labelling of rows with vectors.

    For moments and densities a task reads the vectors for a few labellings; one pass goes over pairs of blocks.
    """
    p, k, group, kind, folder, groups, files = told.p, told.k, told.group, told.kind, told.folder, told.groups, told.rows.files
    if not files:
        return {c: np.full(p, np.nan) for c in ("SW", "CH", *(["S_Dbw"] if density else []))}
    d = load(folder, files[0][:1], ["vec"])["vec"].shape[1]

    def read(first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        labels, lo = raw(folder, groups[first // group], kind).reshape(-1, last - first), 0
        for f in files:
            x = load(folder, f, ["vec"])["vec"]
            yield x, labels[lo : lo + len(x)]
            lo += len(x)

    def moments(first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, k, 2 * d + 1))
        for x, lab in read(first, last):
            both = np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)
            for j in range(last - first):
                out[j] += np.eye(k)[lab[:, j]].T @ both
        return out

    got = told.total(moments, k * (2 * d + 1)).reshape(p, k, 2 * d + 1)
    n = got[:, :, -1]
    size = np.maximum(n, 1)[:, :, None]
    centre = got[:, :, :d] / size
    var = np.maximum(got[:, :, d : 2 * d] / size - centre * centre, 0)
    rows_n = n.sum(axis=1)
    mean = got[:, :, :d].sum(axis=1) / rows_n[:, None]
    between = (n[:, :, None] * (centre - mean[:, None, :]) ** 2).sum(axis=(1, 2))
    within = (n[:, :, None] * var).sum(axis=(1, 2))
    if 2 <= k < rows_n[0]:
        ch = np.where(within > 0, (between / (k - 1)) / np.where(within > 0, within / (rows_n - k), 1), np.inf)
    else:
        ch = np.full(p, np.nan)
    out = {"SW": np.full(p, np.nan), "CH": ch} | ({"S_Dbw": np.full(p, np.nan)} if density else {})
    if k < 2:
        return out

    if density:
        whole = np.maximum(got[:, :, d : 2 * d].sum(axis=1) / rows_n[:, None] - mean * mean, 0)
        if variant != "paper":
            var, whole = np.sqrt(var), np.sqrt(whole)
        spread = np.sqrt((var * var).sum(axis=2))
        radius = np.sqrt(spread.sum(axis=1)) / k
        a, b = np.triu_indices(k, 1)
        points = np.concatenate([centre, (centre[:, a] + centre[:, b]) / 2], axis=1)

        def densities(first: int, last: int) -> np.ndarray:
            found = np.zeros((last - first, k, points.shape[1]))
            for x, lab in read(first, last):
                for j in range(last - first):
                    gap = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in points[first + j]], axis=1)
                    found[j] += np.eye(k)[lab[:, j]].T @ (gap <= radius[first + j])
            return found

        near = told.total(densities, k * points.shape[1]).reshape(p, k, -1)
        ca, cb = near[:, a, a], near[:, b, b]
        if variant == "paper":
            ca, cb = ca + near[:, b, a], cb + near[:, a, b]
        mid = np.arange(len(a))
        u, top = near[:, a, k + mid] + near[:, b, k + mid], np.maximum(ca, cb)
        ratio = np.divide(u, top, out=np.zeros_like(u), where=top > 0).sum(axis=1)
        out["S_Dbw"] = spread.mean(axis=1) / np.sqrt((whole * whole).sum(axis=1)) + 2 * ratio / (k * (k - 1))

    count = n[0]

    def widths(own: SimpleNamespace, others: Iterator[tuple[SimpleNamespace, bool]]) -> Iterator[dict[str, np.ndarray]]:
        s, lab = label_distances(own, others, k), own.labels.astype(np.int64)[:, :, None]
        inner, m = np.take_along_axis(s, lab, axis=2)[:, :, 0], count[lab[:, :, 0]]
        avg = s / np.maximum(count, 1)
        np.put_along_axis(avg, lab, np.inf, axis=2)
        x, y = inner / np.maximum(m - 1, 1), avg.min(axis=2)
        high = np.maximum(x, y)
        yield {"perm": np.arange(p), "s": np.where((m == 1) | (high == 0), 0.0, (y - x) / np.where(high == 0, 1, high)).sum(axis=0)}

    got = told.rows.map(widths, "perm long, s double", True).groupBy("perm").agg(F.sum("s").alias("s")).toArrow()
    sw = np.zeros(p)
    sw[got.column("perm").to_numpy()] = got.column("s").to_numpy()
    out["SW"] = sw / rows_n
    return out


def scores(df: DataFrame, edges: DataFrame | None, perms: DataFrame | Labellings, variant: str = "paper", density: bool = True) -> DataFrame:
    """(perm, SW, CH, S_Dbw, AVI, AVU, ANUI, MQ) of each labelling, in the spaces there are, S_Dbw where density is asked for.

    The labellings are rows (perm, id, label) for the rows (id, vec) of df, or have been written with those.
    """
    told = perms if isinstance(perms, Labellings) else Labellings.of(df, perms)
    found: dict[str, np.ndarray] = {}
    if told.vectors:
        found |= feature_scores(told, variant, density)
    if edges is not None:
        found |= graph_scores(edges, told)
    rows = [(j, *(None if np.isnan(x[j]) else float(x[j]) for x in found.values())) for j in range(told.p)]
    return df.sparkSession.createDataFrame(rows, "perm int, " + ", ".join(f"{c} double" for c in found))


def permutation_z(table: DataFrame) -> DataFrame:
    """(name, observed, mean, sd, z) of each index, from the scores of a labelling (perm 0) and of its shuffles; z is null without scatter."""
    names = [c for c in table.columns if c != "perm"]
    long = table.select("perm", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in names])))
    rest = F.when(F.col("perm") > 0, F.col("x"))
    out = long.groupBy("name").agg(F.max(F.when(F.col("perm") == 0, F.col("x"))).alias("observed"), F.avg(rest).alias("mean"), F.stddev_pop(rest).alias("sd"))
    return out.withColumn("z", F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd")))


def evaluate(df: DataFrame, edges: DataFrame | None, method: str, period: str, k_target: int, n_perm: int = 200, seed: int = 42, variant: str = "paper") -> DataFrame:
    """One row: clusters wanted and found, the smallest one's size, the indices of the spaces there are, and their z scores.

    df has (id, vec, label), or (id, label) without features; edges may be missing.
    """
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("K"), F.min("n").alias("min_size"))
    row = row.select(F.lit(method).alias("method"), F.lit(period).alias("period"), F.lit(k_target).alias("K_target"), "K", "min_size")
    table = scores(df, edges, Labellings.shuffles(df, n_perm, seed), variant)
    z = permutation_z(table)
    at = lambda c, x: F.max(F.when(F.col("name") == c, F.col(x)))
    names = [c for c in table.columns if c != "perm"]
    return row.crossJoin(z.agg(*[at(c, "observed").alias(c) for c in names], *[at(c, "z").alias(f"z_{c}") for c in names]))


def gradient_norms(df: DataFrame) -> DataFrame:
    """(id, label, g): the norm of the gradient, by the own centre, of each row's cosine distance to it."""
    long = long_vectors(df)
    centre = long.groupBy("label", "f").agg(F.avg("x").alias("c"))
    met = long.join(F.broadcast(centre), ["label", "f"])
    row = met.groupBy("id", "label").agg(F.sum(F.col("x") * F.col("c")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("v"), F.sum(F.col("c") * F.col("c")).alias("w"))
    cos = F.col("d") / F.sqrt(F.col("v") * F.col("w"))
    # |u - cos * w| of unit vectors is sqrt(1 - cos^2)
    return row.select("id", "label", (F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos)) / F.sqrt("w")).alias("g"))
