"""Clustering methods over (period, id, vec) and graphs.

k-means and the diagonal mixture run as Spark jobs over any number of rows.  Ward,
spectral, Leiden, KEFRiN and CANUS take one period at a time, a grouped map whose group is
a period's entities; periods and numbers of clusters run in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import count
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .passes import by_vector, dealt, matrix, total
from .similarity import columns_of, load, nearest, neighbours, roots

LABELS = "period int, k int, id long, label int"


# -- jobs ------------------------------------------------------------------


def _passes(df: DataFrame) -> Callable[[Callable[[np.ndarray], np.ndarray], int], np.ndarray]:
    rows = df.select("vec")
    return lambda fn, size: total(rows, lambda b: fn(matrix(b.column("vec"))), size)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    return ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]).clip(0)


def _starts(df: DataFrame, k: int, seeds: Sequence[int], sample: int) -> np.ndarray:
    """First centres for each seed, drawn by distance from ``sample`` rows, the first by a hash of the id."""
    some = df.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    x, out = matrix(some), []
    for s in seeds:
        rng = np.random.default_rng(s)
        pick = [int(rng.integers(len(x)))]
        near = _squares(x, x[pick])[:, 0]
        while len(pick) < k:
            pick.append(int(rng.choice(len(x), p=near / near.sum())) if near.sum() > 0 else int(rng.integers(len(x))))
            near = np.minimum(near, _squares(x, x[pick[-1:]])[:, 0])
        out.append(x[pick])
    return np.stack(out)


def _lloyd(passes, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and cost of all starts, each until its centres stand still; a pass serves all of them."""
    centres = start.copy()
    cost, live = np.full(len(start), np.inf), np.arange(len(start))
    k, d = start.shape[1:]
    for _ in range(rounds):
        now = centres[live]

        def sums(x: np.ndarray, now=now) -> np.ndarray:
            out = np.zeros((len(now), k * (d + 1) + 1))
            for s, c in enumerate(now):
                gap = _squares(x, c)
                one = np.eye(k)[gap.argmin(axis=1)]
                out[s, : k * d] = (one.T @ x).ravel()
                out[s, k * d : -1], out[s, -1] = one.sum(axis=0), gap.min(axis=1).sum()
            return out.ravel()

        got = passes(sums, len(live) * (k * (d + 1) + 1)).reshape(len(live), -1)
        n = got[:, k * d : -1, None]
        new = np.where(n > 0, got[:, : k * d].reshape(-1, k, d) / np.maximum(n, 1), now)
        cost[live], centres[live] = got[:, -1], new
        live = live[~np.isclose(new, now, rtol=1e-9, atol=1e-9).all(axis=(1, 2))]
        if not len(live):
            break
    return centres, cost


def kmeans(df: DataFrame, k: int, seeds: Sequence[int] = range(20), rounds: int = 300, sample: int = 5000) -> DataFrame:
    """(id, label): the run of least cost among seeds; each round is one pass for all of them."""
    df = df.select("id", "vec").persist()
    if df.isEmpty():
        return df.select("id", F.lit(0).alias("label"))
    centres, cost = _lloyd(_passes(df), _starts(df, k, seeds, sample), rounds)
    best = centres[int(np.argmin(cost))]
    return by_vector(df, lambda x: (_squares(x, best).argmin(axis=1).astype(np.int32),), "label int")


def _densities(x: np.ndarray, pi: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each component, and log likelihood, of each row."""
    inv = 1 / var
    quad = (x * x) @ inv.T - 2 * x @ (mean * inv).T + (mean * mean * inv).sum(axis=1)
    l = np.log(np.maximum(pi, 1e-300)) - 0.5 * np.log(2 * np.pi * var).sum(axis=1) - 0.5 * quad
    top = l.max(axis=1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(l - top).sum(axis=1))
    return np.exp(l - ll[:, None]), ll


def gmm_diagonal(df: DataFrame, k: int, rounds: int | None = None, seed: int = 42, floor: float = 1e-6, starts: int = 5, tolerance: float = 1e-3, sample: int = 5000) -> DataFrame:
    """(id, label, p) of a mixture with diagonal covariances: the most likely of some starts, each until the mean
    log likelihood of a row rises by less than ``tolerance``, or for ``rounds``.

    Starts are k-means runs of one seed each; a round is one pass for all starts.
    """
    df = df.select("id", "vec").persist()
    if df.isEmpty():
        return df.select("id", F.lit(0).alias("label"), F.lit(1.0).alias("p"))
    passes = _passes(df)
    centres, _ = _lloyd(passes, _starts(df, k, range(seed, seed + starts), sample), 300)
    d = centres.shape[2]
    width = k * (2 * d + 1) + 2

    def moments(weigh: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], live: np.ndarray) -> np.ndarray:
        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(live), width))
            for j, s in enumerate(live):
                r, ll = weigh(int(s), x)
                out[j, :k], out[j, k : k + k * d], out[j, k + k * d : -2] = r.sum(axis=0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel()
                out[j, -2:] = ll.sum(), len(x)
            return out.ravel()

        return passes(sums, len(live) * width).reshape(len(live), width)

    def model(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = row[:k, None] + 1e-9
        mean = row[k : k + k * d].reshape(k, d) / n
        return row[:k] / row[:k].sum(), mean, np.maximum(row[k + k * d : -2].reshape(k, d) / n - mean * mean, 0) + floor

    live = np.arange(starts)
    got = moments(lambda s, x: (np.eye(k)[_squares(x, centres[s]).argmin(axis=1)], np.zeros(1)), live)
    models, seen = [model(r) for r in got], np.full(starts, -np.inf)
    for _ in count() if rounds is None else range(rounds):
        held = list(models)
        got = moments(lambda s, x, held=held: _densities(x, *held[s]), live)
        ll = got[:, -2] / got[:, -1]
        for s, row in zip(live, got):
            models[s] = model(row)
        still = ll - seen[live] >= tolerance
        seen[live], live = ll, live[still]
        if not len(live):
            break
    best = models[int(np.argmax(seen))]

    def name(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = _densities(x, *best)[0]
        return r.argmax(axis=1).astype(np.int32), r.max(axis=1)

    return by_vector(df, name, "label int, p double")


# -- one period ------------------------------------------------------------


class Sparse:
    """A square matrix of weights that holds only those that aren't 0, by rows."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, w: np.ndarray):
        keep = w != 0
        row, col, w = row[keep], col[keep], w[keep]
        order = np.lexsort((col, row))
        self._hold(n, row[order], col[order], w[order].astype(float))

    def _hold(self, n: int, row: np.ndarray, col: np.ndarray, w: np.ndarray) -> None:
        self.n, self.row, self.col, self.w = n, row, col, w
        self.ends = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
        self.held = np.flatnonzero(np.diff(self.ends))

    @classmethod
    def read(cls, n: int, parts: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> Sparse:
        """From parts (row, col, w), which are gone through twice, so that only the weights are held, 16 bytes each."""
        ends = np.zeros(n + 1, np.int64)
        for row, _, w in parts():
            ends[1:] += np.bincount(row[w != 0], minlength=n)
        ends = np.cumsum(ends)
        at, col, weight = ends[:-1].copy(), np.zeros(ends[-1], np.int32), np.zeros(ends[-1])
        for row, other, w in parts():
            order = np.flatnonzero(w != 0)
            order = order[np.argsort(row[order], kind="stable")]
            met = np.bincount(row[order], minlength=n)
            to = at[row[order]] + np.arange(len(order)) - (np.cumsum(met) - met)[row[order]]
            col[to], weight[to] = other[order], w[order]
            at += met
        for p, q in zip(ends, ends[1:]):
            order = np.argsort(col[p:q], kind="stable")
            col[p:q], weight[p:q] = col[p:q][order], weight[p:q][order]
        self = cls.__new__(cls)
        self._hold(n, np.repeat(np.arange(n, dtype=np.int32), np.diff(ends)), col, weight)
        return self

    def spans(self, most: int = 1 << 20) -> Iterator[slice]:
        """Whole rows, of about so many weights."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.ends[lo] + most, side="right")) - 1)
            yield slice(self.ends[lo], self.ends[hi])
            lo = hi

    def degrees(self) -> np.ndarray:
        """Sums of the rows."""
        return sum((np.bincount(self.row[at], self.w[at], self.n) for at in self.spans()), np.zeros(self.n))

    def __len__(self) -> int:
        return self.n

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where the weights of the rows stand, one row after the other."""
        n = self.ends[rows + 1] - self.ends[rows]
        return np.repeat(self.ends[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def dot(self, m: np.ndarray) -> np.ndarray:
        """Times a matrix of n rows, a column at a time."""
        out = np.zeros((m.shape[1], self.n))
        if len(self.held):
            for at, column in zip(out, m.T):
                at[self.held] = np.add.reduceat(self.w * np.ascontiguousarray(column).take(self.col), self.ends[self.held])
        return out.T

    def sums(self, lab: np.ndarray, k: int) -> np.ndarray:
        """Sums of the rows of each label."""
        return np.bincount(lab[self.row] * self.n + self.col, self.w, k * self.n).reshape(k, self.n)

    def take(self, i: int) -> np.ndarray:
        out, at = np.zeros(self.n), slice(self.ends[i], self.ends[i + 1])
        out[self.col[at]] = self.w[at]
        return out

    def squares(self) -> np.ndarray:
        return np.bincount(self.row, self.w * self.w, self.n)

    def unit(self) -> Sparse:
        return Sparse(self.n, self.row, self.col, self.w / np.maximum(np.sqrt(self.squares()), 1e-12)[self.row])

    def merged(self, lab: np.ndarray) -> Sparse:
        """Weights between labels 0, 1, ..."""
        k, key, w = int(lab.max()) + 1, np.zeros(0, np.int64), np.zeros(0)
        for span in self.spans():
            more = lab[self.row[span]].astype(np.int64) * k + lab[self.col[span]]
            key, at = np.unique(np.concatenate([key, more]), return_inverse=True)
            w = np.bincount(at, np.concatenate([w, self.w[span]]), len(key))
        return Sparse(k, key // k, key % k, w)


def sparse(a: np.ndarray | Sparse) -> Sparse:
    if isinstance(a, Sparse):
        return a
    row, col = np.nonzero(a)
    return Sparse(len(a), row, col, a[row, col])


def lloyd(x: np.ndarray, k: int, seed: int, n_init: int = 10, rounds: int = 300) -> np.ndarray:
    """k-means of one period, seeded by distance."""
    rng, best, cost = np.random.default_rng(seed), None, np.inf
    x = x - x.mean(axis=0)  # distances from products lose the least
    for _ in range(n_init):
        c = x[[rng.integers(len(x))]]
        near = _squares(x, c)[:, 0]
        while len(c) < min(k, len(x)):
            c = np.vstack([c, x[rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))]])
            near = np.minimum(near, _squares(x, c[-1:])[:, 0])
        for _ in range(rounds):
            d = _squares(x, c)
            lab = d.argmin(axis=1)
            n = np.bincount(lab, minlength=len(c))[:, None]
            new = np.where(n > 0, np.eye(len(c))[lab].T @ x / np.maximum(n, 1), c)
            if np.allclose(new, c):
                break
            c = new
        if d.min(axis=1).sum() < cost:
            best, cost = lab, d.min(axis=1).sum()
    return best


def ward_joins(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All joins of least added scatter as (cost, first rows of both clusters), by chains of nearest neighbours.

    Two clusters that are each other's nearest join whatever else does, so a chain finds all joins in quadratic
    time and linear memory.  The clusters there are stand first in the arrays, in order of their first rows.
    """
    n = len(x)
    size, centre, name = np.ones(n), np.ascontiguousarray(x.T, dtype=float).copy(), np.arange(n)
    at, alive, m, gone = np.arange(n), np.ones(n, bool), n, 0
    joins: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(joins) < n - 1:
        if gone * 8 > m:
            # those that are left close ranks
            left = np.flatnonzero(alive[name[:m]])
            size, centre, name = size[left], np.ascontiguousarray(centre[:, left]), name[left]
            at[name], m, gone = np.arange(len(left)), len(left), 0
        if not chain:
            chain.append(int(name[np.argmax(alive[name])]))
        i = at[chain[-1]]
        gap = np.zeros(m)
        for row in centre:
            d = row - row[i]
            d *= d
            gap += d
        gap *= size * size[i] / (size + size[i])
        gap[i] = np.inf
        j = int(np.argmin(gap))
        if len(chain) > 1 and gap[at[chain[-2]]] <= gap[j]:
            a, b = min(chain[-1], chain[-2]), max(chain[-1], chain[-2])
            cost = float(gap[at[chain[-2]]])
            del chain[-2:]
            joins.append((cost, a, b))
            p, q = at[a], at[b]
            centre[:, p] = (size[p] * centre[:, p] + size[q] * centre[:, q]) / (size[p] + size[q])
            size[p] += size[q]
            alive[b] = False
            centre[:, q] = np.inf
            gone += 1
        else:
            chain.append(int(name[j]))
    return joins


def ward_labels(n: int, joins: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Labels by the cheapest n - k joins, the first found of equals; clusters are numbered by their first rows."""
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for _, a, b in sorted(joins, key=lambda t: t[0])[: max(0, n - k)]:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Agglomeration that adds the least scatter each time."""
    return ward_labels(len(x), ward_joins(x), k)


def leading(a: Sparse, k: int, seed: int = 42, most: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Eigenvectors of the k greatest eigenvalues of a symmetric matrix, the greatest last: blocks of a Krylov space, restarted with the best vectors."""
    n, b = len(a), k + 4
    if n <= 1024:
        return np.linalg.eigh(a.dot(np.eye(n)))[1][:, -k:]
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(n, b)))[0]
    aq = a.dot(q)
    for _ in range(most):
        last = q[:, -b:]
        new = aq[:, -b:]
        while q.shape[1] < 12 * b:
            for _ in range(2):
                new = new - q @ (q.T @ new)
            last = np.linalg.qr(new)[0]
            last = np.linalg.qr(last - q @ (q.T @ last))[0]
            new = a.dot(last)
            q, aq = np.hstack([q, last]), np.hstack([aq, new])
        t = q.T @ aq
        val, y = np.linalg.eigh((t + t.T) / 2)
        y, val = y[:, -3 * b :], val[-3 * b :]
        x, ax = q @ y, aq @ y
        rest = ax - x * val
        if np.sqrt((rest[:, -k:] ** 2).sum(axis=0)).max() < tolerance:
            break
        # the residuals of all vectors lie in one block, the next of the space
        more = np.linalg.qr(rest[:, -b:] - x @ (x.T @ rest[:, -b:]))[0]
        more = np.linalg.qr(more - x @ (x.T @ more))[0]
        q, aq = np.hstack([x, more]), np.hstack([ax, a.dot(more)])
    return x[:, -k:]


def spectral(a: np.ndarray | Sparse, k: int, seed: int = 42) -> np.ndarray:
    """k-means on the leading eigenvectors of the random walk."""
    a = sparse(a)
    s = 1 / np.sqrt(np.maximum(np.bincount(a.row, a.w, len(a)), 1e-12))
    v = s[:, None] * leading(Sparse(len(a), a.row, a.col, s[a.row] * a.w * s[a.col]), k, seed)
    return lloyd(v / np.abs(v).max(axis=0), k, seed)


def leiden(a: np.ndarray | Sparse, gamma: float = 1.0, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """Communities of weighted modularity with resolution: local moves, refinement within communities, aggregation.

    A node moves to the community of a neighbour, or to one of its own, that gains most; then those of its neighbours
    that are elsewhere are looked at again, until none moves.
    """
    rng = np.random.default_rng(seed)
    w = sparse(a)
    total = float(w.w.sum())
    member = np.arange(len(w))
    if total <= 0:
        return member

    def move(g: Sparse, deg: list[float], group: list[int] | None) -> np.ndarray:
        n = len(g)
        lab, mass, size = list(range(n)), list(deg), [1] * n
        free: list[int] = []
        col, w, ends = g.col, g.w, g.ends.tolist()
        queue, waits = deque(rng.permutation(n).tolist()), bytearray(b"\1" * n)
        while queue:
            i = queue.popleft()
            waits[i] = 0
            own = lab[i]
            links = {own: 0.0}
            # a node's own links only: those of all as lists would take many times the graph's memory
            js = col[ends[i] : ends[i + 1]].tolist()
            for j, x in zip(js, w[ends[i] : ends[i + 1]].tolist()):
                if j != i and (group is None or group[j] == group[i]):
                    c = lab[j]
                    links[c] = links.get(c, 0.0) + x
            pay = gamma * deg[i] / total
            mass[own] -= deg[i]
            best, most = own, links[own] - pay * mass[own] + 1e-12
            for c, x in links.items():
                gain = x - pay * mass[c]
                if gain > most:
                    best, most = c, gain
            if most < 0 and size[own] > 1:
                best = free.pop()
            mass[best] += deg[i]
            if best != own:
                lab[i] = best
                size[best] += 1
                size[own] -= 1
                if not size[own]:
                    free.append(own)
                for j in js:
                    if not waits[j] and lab[j] != best:
                        waits[j] = 1
                        queue.append(j)
        return np.array(lab)

    for _ in range(rounds):
        deg = w.degrees().tolist()
        coarse = move(w, deg, None)
        _, fine = np.unique(move(w, deg, coarse.tolist()), return_inverse=True)
        if fine.max() + 1 == len(w):
            _, coarse = np.unique(coarse, return_inverse=True)
            return coarse[member]
        w, member = w.merged(fine), fine[member]
    return member


def leiden_at(a: np.ndarray | Sparse, k: int, seed: int = 42, steps: int = 30, seeds: int = 5) -> np.ndarray:
    """The resolution that gives k communities, by bisection of its logarithm; else the nearest number."""
    lo, hi, best = np.log(0.01), np.log(100.0), None
    for _ in range(steps):
        mid = (lo + hi) / 2
        got = None
        for s in range(seeds):
            got = leiden(a, float(np.exp(mid)), seed + s)
            n = got.max() + 1
            if best is None or abs(n - k) < abs(best.max() + 1 - k):
                best = got
            if n == k:
                return got
        if got.max() + 1 < k:
            lo = mid
        else:
            hi = mid
    return best


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def kefrin(y: np.ndarray, a: np.ndarray | Sparse, k: int, rho: float = 1.0, xi: float = 1.0, n_init: int = 10, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """k-means over features and adjacency rows, cosine distance in either space; the run of least cost.

    Sums of labels, and their products with adjacency rows, take up what the rows that moved change.  A row whose nearest
    centre leads by more than all centres have moved since is not looked at; a standstill is checked with sums made anew.
    """
    rng, best, cost = np.random.default_rng(seed), None, np.inf
    a = sparse(a)
    yu, au, every = _unit(y), a.unit(), np.arange(len(y))
    turned = Sparse(len(a), au.col, au.row, au.w)
    for _ in range(n_init):
        pick, near = [int(rng.integers(len(y)))], np.full(len(y), np.inf)
        while len(pick) < k:
            near = np.minimum(near, rho * (1 - yu @ yu[pick[-1]]) + xi * (1 - au.dot(au.take(pick[-1])[:, None])[:, 0]))
            d = near.clip(0)
            pick.append(int(rng.choice(len(y), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(y))))
        m, lab, fresh, room = np.stack([a.take(i) for i in pick]), None, True, np.zeros(len(y))
        # unit centres of features, lengths of the adjacency's, products of unit adjacency rows with those
        cu, size, p = yu[pick], np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-12), au.dot(m.T).T

        def look(rows: np.ndarray) -> tuple[np.ndarray, float]:
            full = len(rows) == len(y)
            d = rho * (1 - cu @ (yu if full else yu[rows]).T) + xi * (1 - (p if full else p[:, rows]) / size[:, None])
            at, low = d.argmin(axis=0), d.min(axis=0)
            d[at, np.arange(len(rows))] = np.inf
            room[rows] = d.min(axis=0) - low - 1e-12
            return at, float(low.sum())

        def anew() -> None:
            nonlocal n, c, m, cu, size, p
            n, c, m = np.bincount(lab, minlength=k), np.eye(k)[lab].T @ y, a.sums(lab, k)
            centre(au.dot(m.T).T)

        def centre(products: np.ndarray) -> None:
            """Centres from sums; those of empty labels stay."""
            nonlocal cu, size, p
            full = n > 0
            cu = np.where(full[:, None], _unit(c / np.maximum(n, 1)[:, None]), cu)
            size = np.where(full, np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-12 * np.maximum(n, 1)), size)
            p = products if full.all() else np.where(full[:, None], products, p)

        n, c = np.zeros(k, int), np.zeros((k, y.shape[1]))
        for r in range(rounds):
            if not fresh and r == rounds - 1:
                anew()
                fresh = True
            rows = every if fresh else np.flatnonzero(room <= 0)
            new, total = look(rows)
            if not fresh and (new == lab[rows]).all():
                anew()
                fresh, rows = True, every
                new, total = look(rows)
            if lab is None:
                moved, was = every, new
            else:
                moved = rows[new != lab[rows]]
                was = lab[moved]
            if lab is not None and not len(moved):
                break
            lab = new if lab is None else lab.copy()
            lab[rows] = new
            fresh = 4 * len(moved) > len(y) or not n.all() or not np.bincount(lab, minlength=k).all()
            if fresh:
                anew()
                continue
            held, long, into = cu, size, lab[moved]
            n = np.bincount(lab, minlength=k)
            c = c + (np.eye(k)[into] - np.eye(k)[was]).T @ y[moved]
            at = a.places(moved)
            each = np.repeat(np.arange(len(moved)), a.ends[moved + 1] - a.ends[moved])
            was, into, most = was[each], into[each], np.zeros(len(y))
            for j in range(k):
                plus, less = at[into == j], at[was == j]
                if not len(plus) and not len(less):
                    continue
                change = np.bincount(a.col[plus], a.w[plus], len(a)) - np.bincount(a.col[less], a.w[less], len(a))
                cols = np.flatnonzero(change != 0)
                met = turned.places(cols)
                more = np.bincount(turned.col[met], turned.w[met] * change[turned.row[met]], len(a))
                m[j] += change
                p[j] += more
                np.maximum(most, np.abs(more) / long[j], out=most)
            centre(p)
            far = abs(rho) * np.sqrt(((cu - held) ** 2).sum(axis=1)) + abs(xi) * np.abs(p).max(axis=1) * np.abs(1 / size - 1 / long)
            room -= 2 * abs(xi) * most + (far + [max(np.delete(far, j), default=0.0) for j in range(k)] + 1e-12)[lab]
        if total < cost:
            best, cost = lab, total
    return best


def gradient_norm(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Norm of the gradient, by the centre, of each row's cosine distance: |v/|v| - cos * c/|c|| / |c|."""
    size = max(float(np.sqrt((c * c).sum())), 1e-12)
    u, w = _unit(v), c / size
    return np.sqrt(((u - (u @ w)[:, None] * w[None, :]) ** 2).sum(axis=1)) / size


def canus(y: np.ndarray, a: np.ndarray | Sparse, k: int, zeta: float = 1.0, tau: float = 1.0, epochs: int = 300, rate: float = 1e-3, seed: int = 42) -> np.ndarray:
    """Centres by gradient steps; only rows whose gradient norm is within tau deviations of the mean take part."""
    a = sparse(a)
    lab = kefrin(y, a, k, 1.0, zeta, 1, 20, seed)
    n = np.bincount(lab, minlength=k)[:, None]
    c = np.stack([y[lab == j].mean(axis=0) if (lab == j).any() else y[j] for j in range(k)])
    m = np.where(n > 0, a.sums(lab, k) / np.maximum(n, 1), np.stack([a.take(j) for j in range(k)]))
    yu, au = _unit(y), a.unit()
    long = au.squares()
    for _ in range(epochs):
        along = au.dot(_unit(m).T)
        lab = ((1 - yu @ _unit(c).T) + zeta * (1 - along)).argmin(axis=1)
        used = np.full(len(y), k)
        for j in range(k):
            own = np.flatnonzero(lab == j)
            if not len(own):
                continue
            # of adjacency rows the part of the unit row that is square to the centre, by Pythagoras
            size = max(float(np.sqrt((m[j] ** 2).sum())), 1e-12)
            norm = gradient_norm(y[own], c[j]) + np.sqrt((long[own] - along[own, j] ** 2).clip(0)) / size
            use = own[np.abs(norm - norm.mean()) <= tau * norm.std() + 1e-12]
            used[use] = j
            size = max(float(np.sqrt((c[j] ** 2).sum())), 1e-12)
            w = c[j] / size
            pull = yu[use] - (yu[use] @ w)[:, None] * w[None, :]
            c[j] += rate * pull.mean(axis=0) / size if len(use) else 0
        sums = au.sums(used, k + 1)
        for j in range(k):
            use = used == j
            if use.any():
                size = max(float(np.sqrt((m[j] ** 2).sum())), 1e-12)
                m[j] += rate * (sums[j] / use.sum() - along[use, j].mean() * m[j] / size) / size
    return lab


def _top(x: np.ndarray, k: int, rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, cosine) of the k most similar rows of some rows, the first of equals."""
    n, u = len(x), _unit(x)
    made = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for lo in range(0, len(rows) if k > 0 else 0, block):
        own = rows[lo : lo + block]
        blocks = ((SimpleNamespace(id=np.arange(at, min(at + block, n)), unit=u[at : at + block]), False) for at in range(0, n, block))
        w, j = nearest(SimpleNamespace(id=own, unit=u[own]), blocks, k, lambda a, b: a.unit @ b.unit.T)
        made.append((np.repeat(own, k), j.ravel(), w.ravel()))
    row, col, w = (np.concatenate(parts) for parts in zip(*made))
    return row, col, w


def _both_ways(n: int, row: np.ndarray, col: np.ndarray, w: np.ndarray) -> Sparse:
    """The positive cosines; the greater of both ways."""
    row, col, w = np.concatenate([row, col])[(both := np.tile(w > 0, 2))], np.concatenate([col, row])[both], np.tile(w, 2)[both]
    key, at = np.unique(row.astype(np.int64) * n + col, return_inverse=True)
    best = np.zeros(len(key))
    np.maximum.at(best, at, w)
    return Sparse(n, key // max(n, 1), key % max(n, 1), best)


def knn_matrix(x: np.ndarray, k: int = 10, block: int = 1024) -> Sparse:
    """Cosines of the k most similar rows of each row, the first of equals, where they are positive; the greater of both ways."""
    return _both_ways(len(x), *_top(x, min(k, len(x) - 1), np.arange(len(x)), block))


def knn_among(x: np.ndarray, near: np.ndarray, cos: np.ndarray, k: int = 10, block: int = 1024) -> Sparse:
    """The same of some rows of a table, from each one's most similar rows in all of it, the most similar first: their places in x, -1 for those that aren't there.

    Rows of which fewer than k are there meet all others.
    """
    k = min(k, len(x) - 1)
    there = near >= 0
    short = there.sum(axis=1) < k
    keep = there & (there.cumsum(axis=1) <= k) & ~short[:, None]
    found = np.nonzero(keep)[0], near[keep], cos[keep]
    return _both_ways(len(x), *map(np.concatenate, zip(found, _top(x, k, np.flatnonzero(short), block))))


#: Methods over a graph of the nearest neighbours.
GRAPHS: dict[str, Callable[[np.ndarray, Sparse, int], np.ndarray]] = {
    "spectral": lambda x, a, k: spectral(a, k),
    "leiden": lambda x, a, k: leiden_at(a, k),
    "kefrin": lambda x, a, k: kefrin(x, a, k),
    "canus": lambda x, a, k: canus(x, a, k),
}

METHODS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "kmeans": lambda x, k: lloyd(x, k, 42, n_init=20),
    "ward": ward,
    **{name: lambda x, k, fn=fn: fn(x, knn_matrix(x), k) for name, fn in GRAPHS.items()},
}


#: Methods that find the labels for all numbers of clusters at once.
TOGETHER: dict[str, Callable[[np.ndarray, Sequence[int]], list[np.ndarray]]] = {
    "ward": lambda x, ks: [ward_labels(len(x), joins, k) for joins in [ward_joins(x)] for k in ks],
}


def sweep(df: DataFrame, method: str, ks: Sequence[int]) -> DataFrame:
    """(period, k, id, label) for each period of (period, id, vec) and each k, one task for each, or for all k of a period where the method finds them together."""
    if method in TOGETHER:
        many = TOGETHER[method]

        def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            found = many(np.stack(pdf.vec).astype(float), ks)
            return pd.concat([pd.DataFrame({"period": pdf.period, "k": k, "id": pdf.id, "label": np.asarray(lab, int)}) for k, lab in zip(ks, found, strict=True)])

        return dealt(df.select("period", "id", "vec"), "period").groupBy("period").applyInPandas(all_of, LABELS)
    fn = METHODS[method]
    jobs = df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        lab = fn(np.stack(pdf.vec).astype(float), int(pdf.k.iloc[0]))
        return pd.DataFrame({"period": pdf.period, "k": pdf.k, "id": pdf.id, "label": np.asarray(lab, int)})

    return dealt(jobs, "period", "k").groupBy("period", "k").applyInPandas(run, LABELS)


def leiden_graphs(edges: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """(graph, id, label, root): communities of each graph of (graph, src, dst, w) over its nodes (graph, id), at resolution 1 or at k of them,
    and the least node that each is joined to, one task a graph."""
    at = {name: scratch(nodes.sparkSession, name) for name in ("edges", "nodes")}
    names = sorted(r[0] for r in nodes.select("graph").distinct().collect())
    # a task reads its graph from files, by number, some rows at a time
    each = nodes.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "graph string, part int")
    for name, df in (("edges", edges.select("graph", "src", "dst", "w")), ("nodes", nodes.select("graph", "id"))):
        df.join(F.broadcast(each), "graph").drop("graph").write.partitionBy("part").parquet(at[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.unique(np.concatenate([c[0] for c in columns_of(f"{at['nodes']}/part={part}", ["id"])]))

                def parts(part: int = part, ids: np.ndarray = ids) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                    for src, dst, w in columns_of(f"{at['edges']}/part={part}", ["src", "dst", "w"]):
                        yield np.searchsorted(ids, src), np.searchsorted(ids, dst), w

                u = v = np.zeros(0, np.int64)
                for row, col, _ in parts():
                    u, v = roots(np.r_[u, row], np.r_[v, col])
                root = ids.copy()
                root[u] = ids[v]
                a = Sparse.read(len(ids), parts)
                label = leiden(a) if k is None else leiden_at(a, k)
                made = pa.array([name] * len(ids), pa.string()), pa.array(ids), pa.array(label.astype(np.int32)), pa.array(root)
                yield pa.RecordBatch.from_arrays(list(made), names=["graph", "id", "label", "root"])

    return dealt(each, "graph").mapInArrow(run, "graph string, id long, label int, root long")


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The keys (method, period, k) that a cache of labels hasn't got."""
    return wanted.join(cache.select("method", "period", "k").distinct(), ["method", "period", "k"], "left_anti")


# -- alignment -------------------------------------------------------------


def assign(overlap: np.ndarray) -> list[int]:
    """For each row a column of its own (or -1) so that the overlap is greatest; by subsets of columns, the first in order among equals."""
    rows, cols = overlap.shape
    free = max(0, rows - cols)
    best = {(0, 0): (0.0, ())}
    for r in range(rows):
        new: dict = {}
        for (mask, skipped), (total, path) in best.items():
            tries = [(mask | 1 << c, skipped, total + overlap[r, c], c) for c in range(cols) if not mask >> c & 1]
            if skipped < free:
                tries.append((mask, skipped + 1, total, -1))
            for m, s, t, c in tries:
                if (m, s) not in new or t > new[m, s][0]:
                    new[m, s] = (t, (*path, c))
        best = new
    return list(max(best.values(), key=lambda x: x[0])[1])


def alignment(cross: Sequence[tuple[int, int, int]]) -> dict[int, int]:
    """Old to reference labels from (old, ref, n); old ones left over get numbers above both, ascending."""
    old, ref = sorted({x for x, _, _ in cross}), sorted({y for _, y, _ in cross})
    m = np.zeros((len(old), len(ref)))
    for x, y, n in cross:
        m[old.index(x), ref.index(y)] = n
    got = assign(m)
    out = {x: ref[c] for x, c in zip(old, got, strict=True) if c >= 0}
    top = max([*old, *ref])
    for x in old:
        if x not in out:
            top += 1
            out[x] = top
    return out


#: Methods whose labels mean the same in every period, or nothing across periods: they aren't renamed.
UNALIGNED = ("leiden", "spectral", "patterns")


def align_methods(labels: DataFrame, reference: str = "all") -> DataFrame:
    """(method, entity, period, label): each method's periods renamed to its period ``reference``, but for UNALIGNED ones."""
    fixed = labels.where(F.col("method").isin(*UNALIGNED)).select("method", "entity", "period", "label")
    rest = labels.where(~F.col("method").isin(*UNALIGNED)).withColumn("key", F.struct("method", "entity"))
    base = rest.where(F.col("period") == reference).select(F.col("key").alias("entity"), "label")
    told = rest.select(F.col("key").alias("entity"), F.concat_ws("\x01", "method", "period").alias("period"), "label")
    named = align(told, base)
    at = F.split("period", "\x01")
    return fixed.unionByName(named.select("entity.method", "entity.entity", at[1].alias("period"), "label"))


def align(labels: DataFrame, reference: DataFrame) -> DataFrame:
    """Each period's labels (entity, period, label) renamed to the reference's (entity, label)."""
    wide = labels.join(reference.select("entity", F.col("label").alias("y")), "entity").groupBy("period", F.col("label").alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = alignment(list(zip(pdf.x, pdf.y, pdf.n, strict=True)))
        return pd.DataFrame([(pdf.period.iloc[0], x, y) for x, y in names.items()], columns=["period", "label", "new"])

    kind = dict(labels.dtypes)
    names = wide.groupBy("period").applyInPandas(run, f"period {kind['period']}, label {kind['label']}, new {kind['label']}")
    return labels.join(F.broadcast(names), ["period", "label"]).select("entity", "period", F.col("new").alias("label"))


def consensus(labels: DataFrame, most: int = 20) -> DataFrame:
    """Periods aligned to each entity's modal label until nothing changes."""
    from .dynamics import modes

    now = labels
    for _ in range(most):
        new = align(now, modes(now, ["entity"])).cache()
        moved = now.join(new.withColumnRenamed("label", "_l"), ["entity", "period"]).where("label <> _l").isEmpty()
        now = new
        if moved:
            break
    return now


def subsamples(ids: DataFrame, runs: int, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(run, id): draws without replacement, the first by a hash of id and run."""
    size = ids.agg(F.floor(F.count(F.lit(1)) * share).alias("_m"))
    each = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.xxhash64("id", "run", F.lit(seed)), "id"))
    return each.withColumn("_r", rank).crossJoin(F.broadcast(size)).where("_r <= _m").select("run", "id")


def _drawn(df: DataFrame, draws: DataFrame, method: str, k: int, share: float, runs: int, near: int = 10) -> DataFrame:
    """(period, id, label) of each draw (period, id) by a method over the nearest neighbours: those of all rows are found once, more of them than
    a draw needs, and a task reads the table and picks those that were drawn."""
    base = neighbours(df, int(np.ceil(2 * near / share)))
    folder, files, columns, fn = base.folder, [f for b in base.files for f in b], base.columns, GRAPHS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = load(folder, files, columns)
        order = np.argsort(t["id"])
        ids = t["id"][order]
        drawn = np.searchsorted(ids, np.sort(pdf.id.to_numpy()))
        place = np.full(len(ids), -1)
        place[drawn] = np.arange(len(drawn))
        x, to, cos = (t[c][order[drawn]] for c in ("vec", "near", "cos"))
        del t
        lab = fn(x, knn_among(x, place[np.searchsorted(ids, to)], cos, near), k)
        return pd.DataFrame({"period": pdf.period.iloc[0], "id": ids[drawn], "label": np.asarray(lab, int)})

    # a draw is long work: more partitions than draws, so that few share one
    return dealt(draws.select("period", "id"), "period", parts=4 * runs).groupBy("period").applyInPandas(run, "period int, id long, label int")


def subsample_stability(df: DataFrame, reference: DataFrame, method: str, k: int, runs: int = 10, share: float = 0.8) -> DataFrame:
    """(run, ari, label, jaccard): agreement of labels found on subsamples of (id, vec) with the reference (entity, label), in a row for each of its labels."""
    from .dynamics import adjusted_rand, cluster_jaccard

    draws = subsamples(df.select("id"), runs, share).withColumnRenamed("run", "period")
    if method in GRAPHS:
        found = _drawn(df, draws, method, k, share, runs).withColumnRenamed("label", "y")
    else:
        found = sweep(draws.join(df, "id").select("period", "id", "vec"), method, [k]).withColumnRenamed("label", "y")
    met = found.join(reference.select(F.col("entity").alias("id"), F.col("label").alias("x")), "id")
    cross = met.groupBy("period", "x", "y").agg(F.count(F.lit(1)).alias("n")).cache()
    out = adjusted_rand(cross, ["period"]).join(cluster_jaccard(cross, ["period"]), "period")
    return out.select(F.col("period").alias("run"), "ari", F.col("x").alias("label"), "jaccard")


def stability_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By keys: number of runs, mean and 5/95 % quantiles of ARI, and for each label those of Jaccard."""
    k = list(keys)

    def stats(c: str) -> list:
        return [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.05)).alias(f"{c}_q05"), F.percentile(c, F.lit(0.95)).alias(f"{c}_q95")]

    whole = runs.select(*k, "run", "ari").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("runs"), *stats("ari"))
    return whole.join(runs.groupBy(*k, "label").agg(*stats("jaccard")), k)
