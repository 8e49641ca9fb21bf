"""Labels over time, held against plain functions of their definitions on generated rows."""

import random
from collections import Counter, defaultdict
from itertools import groupby, product

import pytest

from typolith.operators import dynamics, methods, ranking


def labels(spark, rows, start=0):
    return spark.createDataFrame([(e, start + p, x) for e, r in enumerate(rows) for p, x in enumerate(r)], "entity long, period int, label int")


def sticky(seed, n, length, k, stay=0.7):
    """Rows of labels that keep the one before with a probability."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        row = [rng.randrange(k)]
        while len(row) < length:
            row.append(row[-1] if rng.random() < stay else rng.randrange(k))
        out.append(row)
    return out


def stretches(row):
    return [(x, len(list(g))) for x, g in groupby(row)]


def confirmed(row, h):
    """Changes between successive stretches of h or more."""
    return max(0, len(list(groupby(x for x, n in stretches(row) if n >= h))) - 1)


def test_runs_cover_each_row(spark):
    rows = sticky(11, 25, 9, 3)
    got = defaultdict(list)
    for r in dynamics.runs(labels(spark, rows, 40)).orderBy("entity", "start").collect():
        got[r.entity].append((r.label, r.length))
    assert [got[e] for e in range(25)] == [stretches(r) for r in rows]


def test_switches(spark):
    rows = sticky(12, 60, 11, 4)
    got = {r.entity: (r.raw, r.h2, r.h3) for r in dynamics.switches(labels(spark, rows)).collect()}
    assert got == {e: (len(stretches(r)) - 1, confirmed(r, 2), confirmed(r, 3)) for e, r in enumerate(rows)}
    assert len(set(got.values())) > 8


@pytest.mark.parametrize("largest", [True, False])
def test_modes_break_ties_both_ways(spark, largest):
    rows = sticky(13, 40, 6, 4, 0.3)
    got = {r.entity: r.label for r in dynamics.modes(labels(spark, rows), ["entity"], largest).collect()}
    pick = max if largest else min
    assert got == {e: pick(x for x, n in Counter(r).items() if n == max(Counter(r).values())) for e, r in enumerate(rows)}


def test_trajectories(spark):
    rows = [list(r) for r in product((4, 9), repeat=5)]

    def kind(row):
        s = stretches(row)
        return "stable" if len(s) == 1 else "moved" if len(s) == 2 and min(n for _, n in s) >= 2 else "other"

    got = [r.trajectory for r in dynamics.trajectories(labels(spark, rows)).orderBy("entity").collect()]
    assert got == [kind(r) for r in rows] and Counter(got) == {"stable": 2, "moved": 4, "other": 26}


def monic(before, after, tau, part):
    """Events by their definitions, from two labellings of the same entities."""
    n, size = Counter(zip(before, after)), Counter(before)
    into, out, hit = defaultdict(list), [], set()
    for x in sorted(size):
        shares = {y: n[x, y] / size[x] for y in set(after) if n[x, y]}
        best = min(shares, key=lambda y: (-shares[y], y))
        parts = sorted(y for y, s in shares.items() if s >= part)
        if shares[best] >= tau:
            into[best].append(x)
            hit.add(best)
        elif len(parts) >= 2 and sum(shares[y] for y in parts) >= tau:
            out.append(("split", str(x), "|".join(map(str, parts))))
            hit |= set(parts)
        else:
            out.append(("disappear", str(x), ""))
    for y, xs in into.items():
        out += [("survive" if len(xs) == 1 else "absorb", "|".join(map(str, xs)), str(y))] * len(xs)
    return sorted(out + [("emerge", "", str(y)) for y in set(after) - hit])


def test_monic(spark):
    rng = random.Random(14)
    seen = Counter()
    for tau, part in ((0.5, 0.25), (0.6, 0.2), (0.4, 0.3)):
        before = [rng.randrange(6) for _ in range(90)]
        # 0 and 1 stay mostly, 2 joins 1, 3 falls into three, 4 is scattered over many, 5 goes in two halves
        to = {0: [0], 1: [1], 2: [1], 3: [20, 21, 22], 4: list(range(30, 42)), 5: [50, 51]}
        after = [rng.choice(to[x]) if rng.random() < 0.95 else 0 for x in before]
        a, b = (spark.createDataFrame(list(enumerate(x)), "entity long, label int") for x in (before, after))
        got = sorted((r.event, r.source, r.target) for r in dynamics.monic(dynamics.crosstab(a, b), tau, part).collect())
        assert got == monic(before, after, tau, part)
        seen.update(e for e, _, _ in got)
    assert set(seen) == {"survive", "absorb", "split", "disappear", "emerge"}


def pairs_rand(a, b):
    """Adjusted Rand index from agreement on all pairs of entities."""
    both = one = other = 0
    for i in range(len(a)):
        for j in range(i):
            x, y = a[i] == a[j], b[i] == b[j]
            both, one, other = both + (x and y), one + x, other + y
    expect = one * other / (len(a) * (len(a) - 1) / 2)
    return (both - expect) / ((one + other) / 2 - expect)


def test_jaccard_and_rand(spark):
    rng = random.Random(15)
    a = [rng.randrange(5) for _ in range(70)]
    b = [x if rng.random() < 0.7 else 10 + rng.randrange(3) for x in a]
    x, y = (spark.createDataFrame(list(enumerate(v)), "entity long, label int") for v in (a, b))
    cross = dynamics.crosstab(x, y)
    sets = lambda v: {k: {i for i, z in enumerate(v) if z == k} for k in set(v)}
    want = {k: max(len(s & t) / len(s | t) for t in sets(b).values()) for k, s in sets(a).items()}
    assert {r.x: r.jaccard for r in dynamics.cluster_jaccard(cross).collect()} == pytest.approx(want)
    assert dynamics.adjusted_rand(cross).first().ari == pytest.approx(pairs_rand(a, b))
    assert dynamics.adjusted_rand(dynamics.crosstab(x, x)).first().ari == 1.0


def test_sizes_and_stability(spark):
    rows = sticky(16, 35, 7, 5, 0.8)
    df = labels(spark, rows)
    n = Counter(x for r in rows for x in r)
    new = {x: k for k, x in enumerate(sorted(n, key=lambda x: (-n[x], x)))}
    assert [r.label for r in dynamics.by_size(df).orderBy("entity", "period").collect()] == [new[x] for r in rows for x in r]
    s = dynamics.stability(df).first()
    moves = [len(stretches(r)) - 1 for r in rows]
    assert s.stay_share == pytest.approx(1 - sum(moves) / (35 * 6)) and s.median_switches == sorted(moves)[17]
    assert s.modal_share == pytest.approx(sum(max(Counter(r).values()) / 7 for r in rows) / 35)
    each = {r.entity: (r.changes, r["distinct"], r.modal) for r in dynamics.pattern_stability(df).collect()}
    assert each == {e: (moves[e], len(set(r)), min(x for x, c in Counter(r).items() if c == max(Counter(r).values()))) for e, r in enumerate(rows)}


def test_consensus_undoes_renumbering(spark):
    rng = random.Random(17)
    true = [[rng.randrange(4)] * 9 for _ in range(44)]
    for e in range(0, 44, 11):
        true[e][5:] = [(true[e][0] + 1) % 4] * 4
    turned = {3: [1, 2, 3, 0], 7: [3, 2, 1, 0]}
    rows = [[turned[p][x] if p in turned else x for p, x in enumerate(r)] for r in true]
    got = {(r.entity, r.period): r.label for r in methods.consensus(labels(spark, rows)).collect()}
    assert got == {(e, p): x for e, r in enumerate(true) for p, x in enumerate(r)}


def test_alignment_numbers_the_left_over():
    # 10 goes to 3 and 11 to 4 by overlap; 12 has no partner left and gets a number above all others
    assert methods.alignment([(10, 3, 7), (11, 3, 6), (11, 4, 2), (12, 4, 1)]) == {10: 3, 11: 4, 12: 13}


def table_of(seed, n):
    rng = random.Random(seed)
    return [(f"m{k:02}", round(rng.random(), 1), round(rng.random(), 1), rng.choice([None, 1.0, 2.0, 3.0])) for k in range(n)]


def test_grades_threshold_and_borda(spark):
    rows = table_of(18, 11)
    cols, signs = ["SW", "S_Dbw", "z_AVU"], (1, -1, -1)
    df = spark.createDataFrame([("p", *r) for r in rows], "period string, method string, SW double, S_Dbw double, z_AVU double")
    got = {r.method: r for r in ranking.threshold_places(ranking.grades(df, ["period"], cols), ["period"], cols).collect()}
    n, grade = len(rows), {}
    for r in rows:
        for c, sign in enumerate(signs, 1):
            rank = n if r[c] is None else 1 + sum(o[c] is not None and sign * o[c] > sign * r[c] for o in rows)
            grade[r[0], c] = -(-3 * rank // n)
    for r in rows:
        assert [got[r[0]][f"grade_{c}"] for c in cols] == [grade[r[0], c] for c in (1, 2, 3)]
    worst = {r[0]: [sum(grade[r[0], c] == g for c in (1, 2, 3)) for g in (3, 2)] for r in rows}
    assert {m: got[m].threshold_place for m in worst} == {m: 1 + sum(w < worst[m] for w in worst.values()) for m in worst}

    whole = df.fillna(2.5)
    full = [(r[0], r[1], r[2], 2.5 if r[3] is None else r[3]) for r in rows]
    points = {r[0]: sum(sum(s * o[c] < s * r[c] for o in full) + (sum(o[c] == r[c] for o in full) - 1) / 2 for c, s in enumerate(signs, 1)) for r in full}
    b = {r.method: (r.borda_points, r.borda_place) for r in ranking.borda(whole, ["period"], cols).collect()}
    assert b == {m: (p, 1 + sum(q > p for q in points.values())) for m, p in points.items()}


def test_threshold_rule_counts_the_worst_first(spark):
    grades = list(product((1, 2, 3), repeat=3))
    df = spark.createDataFrame([("p", i, *g) for i, g in enumerate(grades)], "period string, i int, grade_x int, grade_y int, grade_z int")
    key = [(g.count(3), g.count(2)) for g in grades]
    got = [r.threshold_place for r in ranking.threshold_places(df, ["period"], ["x", "y", "z"]).orderBy("i").collect()]
    assert got == [1 + sum(k < own for k in key) for own in key]
