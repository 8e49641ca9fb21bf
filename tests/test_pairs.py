"""All pairs by blocks in the shared folder, against whole matrices."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from typolith.functions.columns import haversine
from typolith.operators import graph, methods, similarity, validity


def table(spark, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def cosines(x):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return u @ u.T


@pytest.mark.parametrize("n", [1, 2, 45, 70])
def test_no_pairs_are_dealt_between_tasks(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    d = similarity.distance_pairs(table(spark, x), block=10)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.d for r in d.collect()}
    assert len(got) == n * (n - 1) // 2 and all(v == pytest.approx(np.linalg.norm(x[i] - x[j])) and i < j for (i, j), v in got.items())
    top = similarity.cosine_topk(table(spark, x), 4, block=10)
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    s = cosines(x)
    np.fill_diagonal(s, -np.inf)
    assert {(r.i, r["rank"]): r.j for r in top.collect()} == {(i, k + 1): int(j) for i in range(n) for k, j in enumerate(np.argsort(-s[i], kind="stable")[: min(4, n - 1)])}


def test_equal_vectors_are_ranked_by_id(spark):
    got = {(r.i, r["rank"]): r.j for r in similarity.cosine_topk(table(spark, np.ones((30, 2))), 3, block=7).collect()}
    assert all([got[i, k] for k in (1, 2, 3)] == [j for j in range(4) if j != i][:3] for i in range(30))


@pytest.mark.parametrize("copies", [1, 8])
def test_cut_and_what_is_above(spark, copies):
    x = np.repeat(np.random.default_rng(copies).normal(size=(96 // copies, 3)), copies, axis=0)
    s = cosines(x)
    i, j = np.triu_indices(len(x), 1)
    blocks = similarity.Blocks(table(spark, x), ["id", "vec"], 20)
    for q in (0.0, 0.5, 0.9, 0.99, 1.0):
        assert similarity.cosine_cut(blocks, q, bins=16, few=10) == pytest.approx(np.quantile(s[i, j], q), abs=1e-9)
    cut = 0.9 if copies == 1 else 0.95
    above = {(int(a), int(b)) for a, b in zip(i, j, strict=True) if s[a, b] > cut}
    edges = similarity.cosine_above(blocks, cut)
    assert {(r.src, r.dst) for r in edges.collect()} == above | {(b, a) for a, b in above} and edges.count() == 2 * len(above)
    nodes = table(spark, x).selectExpr("id as node")
    assert graph.linked_statistics(nodes, similarity.cosine_links(blocks, cut)).first() == graph.statistics(nodes, edges).first()


def test_sums_of_near_copies_keep_their_digits(spark):
    x = np.repeat(np.random.default_rng(3).normal(10, 1, size=(4, 3)), 5, axis=0)
    x[::5] += 1e-7
    d = similarity._distances(x, x)
    assert d == pytest.approx(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), rel=1e-9, abs=1e-15)


def shuffled_bytes(spark):
    """What the tasks have written to shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_shuffled_labels_are_not_dealt_between_tasks(spark):
    rng = np.random.default_rng(4)
    x, lab = rng.normal(size=(2000, 3)), rng.integers(0, 4, 2000)
    df = spark.createDataFrame([(int(i) * 7, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, lab, strict=True))], "id long, vec array<double>, label long").repartition(5)
    e = df.selectExpr("id as src", "(id + 7) % 14000 as dst", "1.0D as w")
    before = shuffled_bytes(spark)
    table = validity.scores(df, e, validity.Labellings.shuffles(df, 60))
    assert table.count() == 61 and 0 < shuffled_bytes(spark) - before < 500_000


@pytest.mark.parametrize("kind", ["long", "int"])
def test_labellings_in_files_are_the_permutations(spark, kind):
    ids = [*range(-20, 20), *range(10**6, 10**6 + 15)]
    df = spark.createDataFrame([(i, [float(i)], "abc"[i % 3]) for i in ids], f"id {kind}, vec array<double>, label string").repartition(3)
    told = validity.Labellings.shuffles(df, 5, seed=9, group=2)
    want = np.array([[told.names.index(r.label) for r in validity.permutations(df, 5, seed=9).where(f"perm = {p}").orderBy("id").collect()] for p in range(6)]).T
    got = np.concatenate([similarity.raw(told.folder, f, told.kind).reshape(-1, 2) for f in told.groups], axis=1)
    beside = np.concatenate([similarity.raw(told.folder, f, told.kind).reshape(-1, 6) for f in told.rows.beside])
    assert (got == want).all() and (beside == want).all()


def test_rows_in_order_and_precision(spark):
    x = np.random.default_rng(5).normal(size=(95, 4))
    for vec, wanted in ((x, "double"), (x.astype(np.float32), "float")):
        blocks = similarity.Blocks(table(spark, vec).repartition(6), ["id", "vec"], 20, by="id")
        assert [blocks.n, *blocks.starts][:2] == [95, 0] and sum(map(len, blocks.files)) >= 5
        held = similarity.load(blocks.folder, sum(blocks.files, []), ["id", "vec"])
        assert (held["id"] == np.arange(95)).all() and (held["vec"] == vec).all() and held["vec"].dtype == float
        assert str(pq.read_schema(blocks.files[0][0]).field("vec").type.value_type) == wanted


def test_evaluation_deals_no_labels_between_tasks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, vec array<double>, label long")
    e = df.selectExpr("id as src", "(id + 3) % 1500 as dst", "1.0D as w")
    before = shuffled_bytes(spark)
    row = validity.evaluate(df, e, "m", "all", 3, n_perm=60).first()
    assert row.K == 3 and row.min_size == 500 and row.AVI == pytest.approx(1) and shuffled_bytes(spark) - before < 500_000


def test_rows_that_are_settled_keep_no_constraints(spark):
    df = spark.range(10).where("id > 3").selectExpr("id as a", "id as b")
    kept = graph.settled(df)
    assert kept._jdf.queryExecution().optimizedPlan().constraints().size() == 0 and sorted(r.a for r in kept.collect()) == [*range(4, 10)]


def test_components_of_graphs_come_with_their_communities(spark):
    links = [("x", i, i + 1, 1.0) for i in range(40) if i != 19] + [("y", 2, 5, 1.0)]
    e = spark.createDataFrame([*links, *[(g, j, i, w) for g, i, j, w in links]], "graph string, src long, dst long, w double")
    nodes = spark.createDataFrame([("x", i) for i in range(41)] + [("y", i) for i in range(8)], "graph string, id long")
    got = {(r.graph, r.id): r.root for r in methods.leiden_graphs(e, nodes).collect()}
    assert got == {("x", i): 0 if i < 20 else 20 for i in range(41)} | {("y", i): 2 if i == 5 else i for i in range(8)}


def test_neighbours_and_cuts_by_other_measures(spark):
    rng = np.random.default_rng(8)
    series, lat, lon = rng.normal(size=(60, 2, 6)), rng.uniform(-60, 60, 60), rng.uniform(-170, 170, 60)
    df = spark.createDataFrame([(i, series[i].tolist(), float(lat[i]), float(lon[i])) for i in range(60)], "id long, vecs array<array<double>>, lat double, lon double")
    blocks = similarity.Blocks(df, ["id", "vecs", "lat", "lon"], 17)
    lag = lambda a, b: similarity.lagged(a.vecs, b.vecs)[0]
    pairs = similarity.lag_pairs(df.select("id", "vecs"), block=17)
    best = {(r.i, r.j): r.w for r in graph.best_neighbours(pairs, 4).collect()}
    assert {(r.i, r.j): r.w for r in similarity.topk(blocks, 4, lag).collect()} == pytest.approx(best)
    w = np.array([r.w for r in pairs.where("i < j").collect()])
    cut = similarity.cosine_cut(blocks, 0.9, bins=16, few=50, of=lag)
    assert cut == pytest.approx(np.quantile(w, 0.9)) and similarity.cosine_above(blocks, cut, lag).count() == 2 * (w > cut).sum()
    a, b = (df.selectExpr(f"id as {k}", f"lat as lat_{k}", f"lon as lon_{k}") for k in "ij")
    line = a.crossJoin(b).select("i", "j", haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")).alias("d"))
    near = {(r.i, r.j): -r.d for r in graph.best_neighbours(line.where("i <> j").withColumn("w", -F.col("d")), 3).collect()}
    got = similarity.topk(blocks, 3, lambda a, b: -similarity.great_circles(a, b))
    assert {(r.i, r.j): r.w for r in got.collect()} == pytest.approx(near)
