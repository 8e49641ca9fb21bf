"""Methods over graphs held by rows, against the same over whole matrices."""

import numpy as np
import pytest

from typolith.operators import methods


def points(n, seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.7, (n // 4, 5)) for c in rng.normal(0, 4, (4, 5))])


def same(a, b):
    """Whether two labellings are one partition."""
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def dense(a):
    return a.dot(np.eye(len(a)))


def test_neighbours_are_held_by_rows():
    x = points(1200)
    a = methods.knn_matrix(x)
    assert len(a) == 1200 and len(a.w) <= 2 * 10 * 1200
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    out = np.zeros_like(s)
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    np.put_along_axis(out, top, np.maximum(np.take_along_axis(s, top, axis=1), 0), axis=1)
    assert np.allclose(dense(a), np.maximum(out, out.T))
    # the first of equal rows
    assert {int(j) for i, j in zip(*np.nonzero(dense(methods.knn_matrix(np.ones((6, 2)), 2)))) if i > 2} == {0, 1}


def test_kefrin_takes_rows_or_a_matrix():
    x = points(400)
    a = methods.knn_matrix(x)
    assert same(methods.kefrin(x, a, 4), methods.kefrin(x, dense(a), 4)) and same(methods.kefrin(x, a, 4), np.arange(400) // 100)


def test_canus_takes_rows():
    x = points(400)
    a = methods.knn_matrix(x)
    assert same(methods.canus(x, a, 4, epochs=40), methods.canus(x, dense(a), 4, epochs=40))


def test_leiden_of_many_nodes_takes_rows():
    # 400 cliques of 5, each tied to the next by a light edge
    i, j = (np.concatenate([5 * c + x for c in range(400)]) for x in np.triu_indices(5, 1))
    i, j, w = np.r_[i, np.arange(0, 1995, 5)], np.r_[j, np.arange(5, 2000, 5)], np.r_[np.ones(4000), np.full(399, 0.01)]
    a = methods.Sparse(2000, np.r_[i, j], np.r_[j, i], np.r_[w, w])
    assert same(methods.leiden(a, 20.0), np.arange(2000) // 5)


def test_leading_vectors_are_the_whole_matrix_s():
    a = methods.knn_matrix(np.random.default_rng(4).normal(size=(1500, 4)))
    s = 1 / np.sqrt(np.bincount(a.row, a.w, len(a)))
    a = methods.Sparse(len(a), a.row, a.col, s[a.row] * a.w * s[a.col])
    got, want = methods.leading(a, 4), np.linalg.eigh(dense(a))[1][:, -4:]
    assert np.abs((got * want).sum(axis=0)) == pytest.approx(np.ones(4))


def test_ward_finds_all_numbers_of_clusters_at_once(monkeypatch):
    x, seen, joins = points(200), [], methods.ward_joins
    monkeypatch.setattr(methods, "ward_joins", lambda v: seen.append(1) or joins(v))
    got = methods.TOGETHER["ward"](x, [2, 4, 9])
    assert len(seen) == 1 and [len(set(v)) for v in got] == [2, 4, 9] and same(got[1], np.arange(200) // 50)
    assert all((methods.ward(x, k) == v).all() for k, v in zip([2, 4, 9], got, strict=True))


def test_lloyd_holds_no_row_by_centre_by_feature_array():
    import tracemalloc

    x = np.random.default_rng(7).normal(size=(4000, 60))
    tracemalloc.start()
    lab = methods.lloyd(x, 10, 1, n_init=1, rounds=5)
    assert tracemalloc.get_traced_memory()[1] < 3 * 4000 * 10 * 60 * 8 / 4 and len(set(lab)) == 10
    tracemalloc.stop()


def test_periods_are_tasks_of_their_own(spark):
    from pyspark.sql import functions as F

    rows = [(p, i, [float(v) for v in r]) for p in range(12) for i, r in enumerate(points(40, p))]
    got = methods.sweep(spark.createDataFrame(rows, "period int, id long, vec array<double>"), "ward", [2])
    tasks = got.select("period", F.spark_partition_id().alias("t")).distinct().collect()
    assert len(tasks) == 12 and len({r.t for r in tasks}) > 6


def test_neighbours_of_a_draw_come_from_those_of_all():
    from types import SimpleNamespace

    from typolith.operators import similarity

    x = points(600)
    x[40:80] = x[:40]
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    whole = (SimpleNamespace(id=np.arange(lo, lo + 150), vec=u[lo : lo + 150]) for lo in range(0, 600, 150))
    cos, near = similarity.nearest(SimpleNamespace(id=np.arange(600), vec=u), ((b, False) for b in whole), 25)
    drawn = np.sort(np.random.default_rng(2).choice(600, 300, replace=False))
    place = np.full(600, -1)
    place[drawn] = np.arange(300)
    # of a draw of half some rows hold fewer than ten of their 25
    assert ((place[near[drawn]] >= 0).sum(axis=1) < 10).any()
    got, want = methods.knn_among(x[drawn], place[near[drawn]], cos[drawn]), methods.knn_matrix(x[drawn])
    assert np.allclose(dense(got), dense(want))


def test_draws_share_one_search_for_neighbours(spark, monkeypatch):
    x = points(200)
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    ref = spark.createDataFrame([(i, i // 50) for i in range(200)], "entity long, label int")
    asked = []
    find = methods.neighbours
    monkeypatch.setattr(methods, "neighbours", lambda df, k: asked.append(k) or find(df, k))
    rows = methods.subsample_stability(v, ref, "kefrin", 4, 3).collect()
    assert asked == [25] and len(rows) == 12 and all(r.ari == r.jaccard == 1.0 for r in rows)


def test_kefrin_stands_still_where_plain_rounds_do():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6))
    a = methods.knn_matrix(x)
    lab, k, whole = methods.kefrin(x, a, 5, n_init=3), 5, dense(a)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    c, m = (unit(np.stack([t[lab == j].mean(axis=0) for j in range(k)])) for t in (x, whole))
    assert ((2 - unit(x) @ c.T - unit(whole) @ m.T).argmin(axis=1) == lab).all() and len(set(lab)) == k


def test_graphs_are_read_in_parts_and_held_once(spark):
    rng = np.random.default_rng(5)
    i, j, w = rng.integers(0, 50, 900), rng.integers(0, 50, 900), rng.random(900).round(1)
    want = methods.Sparse(50, i, j, w)
    got = methods.Sparse.read(50, lambda: ((i[k : k + 70], j[k : k + 70], w[k : k + 70]) for k in range(0, 900, 70)))
    assert all((getattr(got, c) == getattr(want, c)).all() for c in ("row", "col", "ends", "held")) and np.allclose(dense(got), dense(want))
    assert got.row.itemsize + got.col.itemsize + got.w.itemsize == 16
    spans = list(got.spans(100))
    assert len(spans) > 5 and spans[0].start == 0 and spans[-1].stop == len(got.w) and all(p.stop == q.start for p, q in zip(spans, spans[1:]))
    # cliques of five, in two graphs with names that paths don't hold, and a node alone
    i, j = np.nonzero(np.kron(np.eye(4), np.ones((5, 5))) - np.eye(20))
    e = spark.createDataFrame([(g, int(a) * 3, int(b) * 3, 1.0) for g in ("a/b", "c=d %") for a, b in zip(i, j)], "graph string, src long, dst long, w double")
    nodes = spark.createDataFrame([(g, 3 * n) for g in ("a/b", "c=d %") for n in range(21)], "graph string, id long")
    rows = methods.leiden_graphs(e, nodes).collect()
    assert {(r.graph, r.id): r.root for r in rows} == {(g, 3 * n): n // 5 * 15 for g in ("a/b", "c=d %") for n in range(21)}
    assert all(same([r.label for r in rows if r.graph == g], [r.root for r in rows if r.graph == g]) for g in ("a/b", "c=d %"))
