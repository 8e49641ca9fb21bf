import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from typolith.functions.columns import chi2_tail
from typolith.operators import fca, graph, methods, patterns, profiles, similarity, validity


def vectors(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label long")


def edges(spark, pairs):
    return spark.createDataFrame([(i, j, w) for i, j, w in pairs] + [(j, i, w) for i, j, w in pairs], "src long, dst long, w double")


def cliques(n=3, m=5):
    return [(c * m + i, c * m + j, 1.0) for c in range(n) for i in range(m) for j in range(i + 1, m)]


def test_graph_indices_of_cliques(spark):
    lab = spark.createDataFrame([(i, i // 5) for i in range(15)], "id long, label long")
    r = validity.graph_indices(edges(spark, cliques()), lab).first()
    assert r.AVI == pytest.approx(1) and r.AVU == 0 and r.MQ == pytest.approx(2 / 3) and r.ANUI == pytest.approx(1)


@pytest.mark.parametrize("k,avu", [(2, 1.0), (3, 2 / 3)])
def test_unifiability_is_degenerate_for_few_labels(spark, k, avu):
    rng = np.random.default_rng(1)
    e = edges(spark, [(i, j, float(rng.random())) for i in range(12) for j in range(i + 1, 12)])
    lab = spark.createDataFrame([(i, i % k) for i in range(12)], "id long, label long")
    assert validity.graph_indices(e, lab).first().AVU == pytest.approx(avu)


def test_statistics_and_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(17)], "node long")
    s = graph.statistics(nodes, edges(spark, cliques())).first()
    assert (s.n_edges, s.n_isolates, s.n_components) == (30, 2, 5)


def blobs(k=4, n=30, d=3, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(8 * c, 1, (n, d)) for c in range(k)]), np.repeat(np.arange(k), n)


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        a = d[i, y == y[i]].sum() / max(1, own - 1)
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append(0 if own == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


def test_indices_prefer_the_true_partition(spark):
    x, y = blobs()
    wrong = np.random.default_rng(3).permutation(y)
    a, b = vectors(spark, x, y), vectors(spark, x, wrong)
    assert validity.silhouette(a).first().SW == pytest.approx(brute_silhouette(x, y))
    assert validity.silhouette(b).first().SW == pytest.approx(brute_silhouette(x, wrong))
    assert validity.calinski_harabasz(a).first().CH > validity.calinski_harabasz(b).first().CH
    for variant in ("paper", "package"):
        assert validity.s_dbw(a, variant).first().S_Dbw < validity.s_dbw(b, variant).first().S_Dbw
    assert validity.calinski_harabasz(vectors(spark, x, np.zeros(len(x)))).first().CH is None


def test_blocks_don_t_change_pairs(spark):
    x, _ = blobs()
    v = vectors(spark, x).select("id", "vec")
    one = {(r.i, r.j): r.w for r in similarity.cosine_topk(v, 4, block=1000).collect()}
    many = {(r.i, r.j): r.w for r in similarity.cosine_topk(v, 4, block=17).collect()}
    assert one.keys() == many.keys() and len(one) == 4 * len(x)
    a = {(r.i, r.j): r.d for r in similarity.distance_pairs(v, block=17).collect()}
    assert len(a) == len(x) * (len(x) - 1) // 2 and a[0, 5] == pytest.approx(np.linalg.norm(x[0] - x[5]))


def test_lag_correlation_finds_the_shift(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(size=(2, 26))
    rows = [(0, [r[2:].tolist() for r in s]), (1, [r[:24].tolist() for r in s])]
    df = spark.createDataFrame(rows, "id long, vecs array<array<double>>")
    got = {(r.i, r.j): (r.w, r.lag) for r in similarity.lag_pairs(df).collect()}
    assert got[0, 1][0] > 0.8 and got[0, 1][1] == 2 and got[1, 0][1] == -2


def test_dtw_against_the_table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 10))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)

    def slow(a, b, w):
        d = np.full((11, 11), np.inf)
        d[0, 0] = 0
        for i in range(1, 11):
            for j in range(max(1, i - w), min(10, i + w) + 1):
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        return math.sqrt(d[10, 10])

    got = {(r.i, r.j): r.d for r in similarity.dtw_pairs(vectors(spark, x).select("id", "vec"), 3).collect()}
    assert got[0, 2] == pytest.approx(slow(z[0], z[2], 3))


def lattice(objects, full):
    """Closed sets of attributes with the numbers of their objects, by intersecting sets of objects."""
    out = {}
    for chosen in range(1 << len(objects)):
        own = full
        for k, o in enumerate(objects):
            if chosen >> k & 1:
                own &= o
        out[own] = sum(o & own == own for o in objects)
    return out


def subset_stability(objects, intent, full):
    """The share of subsets of a concept's objects that have its attributes and no more in common."""
    members = [o for o in objects if o & intent == intent]
    hit = 0
    for chosen in range(1 << len(members)):
        own = full
        for k, o in enumerate(members):
            if chosen >> k & 1:
                own &= o
        hit += own == intent
    return hit / (1 << len(members))


def test_concepts_against_all_intersections(spark):
    rng = np.random.default_rng(21)
    n, full = 5, 31
    objects = [int(x) for x in rng.integers(0, 32, 8)]
    want = lattice(objects, full)
    ob = spark.createDataFrame(list(enumerate(objects)), "id long, mask long")
    found = fca.concepts(ob, fca.generators(spark, n, n))
    got = {r.intent: r.extent for r in found.collect()}
    assert got == {i: c for i, c in want.items() if c}
    exact = {i: s for i, _, s in fca.exact_stability(objects, full)}
    assert exact == {i: subset_stability(objects, i, full) for i in want}
    for r in fca.stability_bounds(found, ob, n).collect():
        assert r.sigma_low <= exact[r.intent] + 1e-12 and (r.intent == full or exact[r.intent] <= r.sigma_up + 1e-12)
    assert fca.intent(ob.where("false"), full).first().intent == full
    for a in (1, 6, 20):
        assert fca.extent(ob, a).count() == sum(o & a == a for o in objects)


def test_readable_drops_what_is_implied(spark):
    # of two features' four levels each: the lowest quarter implies the lower half, the highest the upper
    masks = list(range(256))
    want = [m & ~(2 * (m & 0b00010001)) & ~((m & 0b10001000) >> 1) for m in masks]
    df = spark.createDataFrame([(m,) for m in masks], "m long")
    assert [r.r for r in df.select("m", fca.readable(F.col("m"), 2).alias("r")).orderBy("m").collect()] == want


def test_patterns(spark):
    rng = np.random.default_rng(22)
    rows = [tuple(float(v) for v in r) for r in rng.integers(1, 4, (40, 3))]
    df = spark.createDataFrame(rows, "x double, y double, z double").withColumn("code", patterns.codes(["x", "y", "z"]))
    sign = lambda v: (v > 0) - (v < 0)
    code = lambda r: (sign(r[0] - r[1]), sign(r[0] - r[2]), sign(r[1] - r[2]))
    got = patterns.clusters(df).select("x", "y", "z", "code", "cluster", patterns.text(F.col("code"), ["x", "y", "z"]).alias("t")).collect()
    size = {c: sum(code(r) == c for r in rows) for c in {code(r) for r in rows}}
    number = {c: k for k, c in enumerate(sorted(size, key=lambda c: (-size[c], c)))}
    for r in got:
        own = (r.x, r.y, r.z)
        assert tuple(r.code) == code(own) and r.cluster == number[code(own)]
        # names by falling values, equal ones joined by a sign of equality
        names = sorted("xyz", key=lambda c: (-own["xyz".index(c)], c))
        want = names[0] + "".join((" = " if own["xyz".index(p)] == own["xyz".index(q)] else " > ") + q for p, q in zip(names, names[1:]))
        assert r.t == want
    near = spark.createDataFrame([(7.0, 7.04, 2.0)], "x double, y double, z double")
    assert near.select(patterns.codes(["x", "y", "z"], "all", 0.05).alias("v")).first().v == [0, 1, 1]
    assert near.select(patterns.codes(["x", "y", "z"], "adjacent").alias("v")).first().v == [-1, 1]


def test_pattern_merge_joins_the_nearest():
    # the second and the fourth differ in one place and lie close; the others differ in more
    rows = [([1, 1, -1, 1], 4, [9.0]), ([-1, 1, 1, 0], 6, [2.0]), ([-1, -1, -1, -1], 3, [0.0]), ([-1, 1, 1, 1], 6, [2.2])]
    out = patterns.merge(rows, 3)
    same = {(a, b) for a in range(4) for b in range(a) if out[3][a] == out[3][b]}
    assert same == {(3, 1)}


def test_mirkin_sums_to_the_explained_share(spark):
    x, y = blobs()
    long = validity.long_vectors(vectors(spark, x, y))
    total = profiles.mirkin(long).agg(F.sum("contrib")).first()[0]
    within = sum(((x[y == c] - x[y == c].mean(axis=0)) ** 2).sum() for c in set(y))
    assert total == pytest.approx(1 - within / ((x - x.mean(axis=0)) ** 2).sum())


def test_kruskal_wallis_by_hand(spark):
    rows = [("i", 0, 1.0), ("i", 0, 2.0), ("i", 0, 3.0), ("i", 1, 4.0), ("i", 1, 5.0), ("i", 1, 6.0), ("i", 1, None)]
    r = profiles.kruskal_wallis(spark.createDataFrame(rows, "indicator string, label int, x double")).first()
    assert (r.n, r.k) == (6, 2) and r.h == pytest.approx(27 / 7) and r.p == pytest.approx(0.0495346, abs=1e-6)
    assert chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6) and chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)


def rand_index(a, b):
    n = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(n, (a, b), 1)
    c = lambda v: (v * (v - 1) / 2).sum()
    s, p, q = c(n), c(n.sum(axis=1)), c(n.sum(axis=0))
    e = p * q / (len(a) * (len(a) - 1) / 2)
    return 1.0 if (p + q) / 2 == e else (s - e) / ((p + q) / 2 - e)


@pytest.mark.parametrize("name", ["kmeans", "ward", "spectral", "kefrin", "canus"])
def test_methods_recover_blobs(spark, name):
    rng = np.random.default_rng(5)
    centres = np.array([[8, 0, 0], [0, 8, 0], [0, 0, 8]])
    x = np.concatenate([rng.normal(c, 0.5, (30, 3)) for c in centres])
    y = np.repeat(np.arange(3), 30)
    df = vectors(spark, x).select(F.lit(1).alias("period"), "id", "vec")
    got = np.array([r.label for r in methods.sweep(df, name, [3]).orderBy("id").collect()])
    assert rand_index(got, y) > 0.95
    again = np.array([r.label for r in methods.sweep(df, name, [3]).orderBy("id").collect()])
    assert (got == again).all()


def test_leiden_finds_cliques():
    a = np.zeros((15, 15))
    for i, j, w in cliques():
        a[i, j] = a[j, i] = w
    a[0, 5] = a[5, 0] = 0.1
    assert rand_index(methods.leiden(a), np.arange(15) // 5) == 1.0
    assert rand_index(methods.leiden_at(a, 3), np.arange(15) // 5) == 1.0


def test_methods_search_as_long_as_their_operators(monkeypatch):
    import inspect

    x = np.random.default_rng(6).normal(size=(24, 3))
    tried, norms, starts = [], [], []
    monkeypatch.setattr(methods, "leiden", lambda a, gamma, seed: tried.append((gamma, seed)) or np.zeros(len(a), int))
    methods.METHODS["leiden"](x, 3)
    assert len(tried) == 150 and len({s for _, s in tried}) == 5
    norm = methods.gradient_norm
    monkeypatch.setattr(methods, "gradient_norm", lambda v, c: norms.append(1) or norm(v, c))
    methods.METHODS["canus"](x, 2)
    assert len(norms) >= 600
    monkeypatch.setattr(methods, "lloyd", lambda x, k, seed, n_init=10: starts.append(n_init))
    methods.METHODS["kmeans"](x, 2)
    assert starts == [20]
    default = lambda f, p: inspect.signature(f).parameters[p].default
    assert default(methods.canus, "rate") == 1e-3 and len(default(methods.kmeans, "seeds")) == 20
    assert default(methods.gmm_diagonal, "starts") == 5 and default(methods.gmm_diagonal, "rounds") is None


def test_jobs_of_kmeans_and_mixture(spark):
    x, y = blobs(3, 40)
    v = vectors(spark, x)
    for found in (methods.kmeans(v, 3, [1, 2]), methods.gmm_diagonal(v, 3)):
        assert rand_index(np.array([r.label for r in found.orderBy("id").collect()]), y) == 1.0


def test_gradient_norm_is_the_gradient():
    rng = np.random.default_rng(0)
    v, c = rng.normal(size=(4, 5)), rng.normal(size=5)

    def cost(c):
        return 1 - v @ c / (np.linalg.norm(v, axis=1) * np.linalg.norm(c))

    g = np.stack([(cost(c + 1e-6 * e) - cost(c - 1e-6 * e)) / 2e-6 for e in np.eye(5)], axis=1)
    assert np.linalg.norm(g, axis=1) == pytest.approx(methods.gradient_norm(v, c), rel=1e-5)


def test_assignment_is_best():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for shape in ((4, 4), (3, 5), (5, 3)):
        m = rng.integers(0, 20, shape).astype(float)
        got = methods.assign(m)
        total = sum(m[r, c] for r, c in enumerate(got) if c >= 0)
        small = m if shape[0] <= shape[1] else m.T
        assert total == max(sum(small[r, p[r]] for r in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert len({c for c in got if c >= 0}) == min(shape)


def test_shuffles_keep_sizes_and_draws_are_without_replacement(spark):
    lab = spark.createDataFrame([(i, i // 5) for i in range(15)], "id long, label long")
    p = validity.permutations(lab, 6).collect()
    by = {k: sorted((r.id, r.label) for r in p if r.perm == k) for k in range(7)}
    assert by[0] == [(i, i // 5) for i in range(15)]
    assert all([i for i, _ in v] == list(range(15)) and sorted(x for _, x in v) == sorted(i // 5 for i in range(15)) for v in by.values())
    assert len({tuple(v) for v in by.values()}) == 7
    table = validity.scores(lab, edges(spark, cliques()), validity.permutations(lab, 30))
    z = {r["name"]: r for r in validity.permutation_z(table).collect()}
    assert z["MQ"].observed == pytest.approx(2 / 3) and z["MQ"].z > 3 and z["AVI"].z > 3
    draws = methods.subsamples(lab.select("id"), 4).collect()
    assert all(len({r.id for r in draws if r.run == k}) == 12 for k in range(4)) and len(draws) == 48


def test_subsamples_are_held_against_each_label(spark):
    x, y = blobs(3, 20)
    v = vectors(spark, x).select("id", "vec")
    ref = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "entity long, label int")
    runs = methods.subsample_stability(v, ref, "kmeans", 3, 4)
    got = runs.collect()
    assert len(got) == 12 and all(r.ari == r.jaccard == 1.0 for r in got)
    s = methods.stability_summary(runs.select(F.lit("all").alias("period"), "*"), ["period"]).collect()
    assert sorted((r.period, r.label, r.runs, r.ari_q05, r.jaccard_mean, r.jaccard_q95) for r in s) == [("all", k, 4, 1.0, 1.0, 1.0) for k in range(3)]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stability_covers_the_whole_period_and_four_years(spark, monkeypatch):
    from typolith.plans import meaning

    asked = []

    def found(df, ref, method, k, runs):
        asked.append((method, k, runs))
        return spark.createDataFrame([(0, 1.0, 0, 1.0)], "run int, ari double, label int, jaccard double")

    monkeypatch.setattr(methods, "subsample_stability", found)
    rows = meaning.bootstrap_stability(spark, "/root/testdata/sf0.001").collect()
    assert asked == [("kefrin", 7, 100)] + 4 * [("kefrin", 7, 10)]
    assert {r.period for r in rows} == {"all", "1995", "1997", "1999", "2001"}


def test_ward_joins_what_adds_least():
    rng = np.random.default_rng(31)
    x = rng.normal(size=(40, 3))
    for k in (2, 5, 11):
        groups = [[i] for i in range(len(x))]
        while len(groups) > k:
            def cost(a, b):
                p, q = x[a], x[b]
                return len(a) * len(b) / (len(a) + len(b)) * ((p.mean(axis=0) - q.mean(axis=0)) ** 2).sum()

            i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda t: cost(groups[t[0]], groups[t[1]]))
            groups[j] += groups.pop(i)
        want = np.zeros(len(x), int)
        for c, g in enumerate(sorted(groups, key=min)):
            want[g] = c
        assert (methods.ward(x, k) == want).all()


def test_mixture_climbs_to_a_standstill(spark):
    x, _ = blobs(2, 50, 2, seed=9)
    x[:50] *= 0.4
    rows = vectors(spark, x)
    got = {r.id: (r.label, r.p) for r in methods.gmm_diagonal(rows, 2, tolerance=1e-9).collect()}
    lab = np.array([got[i][0] for i in range(len(x))])
    # one more round by hand from the hard labels' neighbourhood changes no label
    r = np.stack([np.where(lab == j, [got[i][1] for i in range(len(x))], 1 - np.array([got[i][1] for i in range(len(x))])) for j in range(2)], axis=1)
    n = r.sum(axis=0)
    mean = r.T @ x / n[:, None]
    var = r.T @ (x * x) / n[:, None] - mean**2 + 1e-6
    new, _ = methods._densities(x, n / n.sum(), mean, var)
    assert np.allclose(new, r, atol=1e-4)


@pytest.mark.parametrize("variant", ["paper", "package"])
def test_scores_of_each_labelling_are_the_indices(spark, variant):
    x, y = blobs(3, 25, 2, seed=4)
    df = vectors(spark, x, y)
    rng = np.random.default_rng(2)
    e = edges(spark, [(int(i), int(j), float(rng.random())) for i in range(75) for j in range(i) if rng.random() < 0.2])
    perms = validity.permutations(df, 3).cache()
    got = {r.perm: r for r in validity.scores(df, e, perms, variant).collect()}
    for p in range(4):
        own = df.select("id", "vec").join(perms.where(F.col("perm") == p), "id").select("id", "vec", F.col("label").cast("long").alias("label"))
        want = validity.silhouette(own).first().asDict() | validity.calinski_harabasz(own).first().asDict() | validity.s_dbw(own, variant).first().asDict() | validity.graph_indices(e, own.select("id", "label")).first().asDict()
        assert {c: got[p][c] for c in want} == pytest.approx(want)
    row = validity.evaluate(df, e, "m", "all", 3, n_perm=20, variant=variant).first()
    assert row.K == 3 and row.min_size == 25 and row.z_SW > 3 and row.z_S_Dbw < 0 and row.MQ == pytest.approx(got[0].MQ)


def test_pattern_and_graph_labels_are_not_renamed(spark):
    rows = [(m, e, p, (e % 3 + (1 if p == "x" else 0)) % 3) for m in ("ward", "leiden", "patterns") for e in range(12) for p in ("all", "x")]
    df = spark.createDataFrame(rows, "method string, entity long, period string, label int")
    got = {(r.method, r.entity, r.period): r.label for r in methods.align_methods(df).collect()}
    assert got == {(m, e, p): (e % 3 if m == "ward" else x) for m, e, p, x in rows}
