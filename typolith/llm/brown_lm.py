"""Brown class-based bigram model of a corpus.

Tokens: words, lower-cased A-Z, then one end of text.  Training counts of all tokens are
a table keyed by word (64-bit hash).  Words that train ``least`` times are units of their
own, up to the ``head`` most frequent, so the units grow with the corpus and their broadcast
is bounded; every other word belongs to the unit of its shape (length, ending, letters
beyond ASCII).  Exchange clustering moves units between classes while the likelihood of the
class bigrams rises: one at a time for the first ``seeds`` words and the shapes, then for
all units, in rounds over a table of unit bigrams, to convergence.  So each word has a class.  The probability of a token is that of its class after
the class before it (add-``alpha``) times that of the word in its class (add-``delta``,
with one unknown word).

Counts of frequent words (up to ``head`` of them) go to every executor; the rest of each
text's words meet their counts in a join, so no vocabulary has to fit a task.

Null and empty texts are one end.  A null id trains.  Rows with equal ids are scored each.
Without training texts every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import Chunk, chunks, mix
from .rowmap import emit_text
from .shared import cut

SHAPES = 256
#: Distinct words that a counting task holds before it passes them on.
HELD = 1_500_000


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, Chunk]:
    c = c.lowered()
    ws, we, wr = c.words()
    return c.span_hash(ws, we).view(np.int64), _shape(c.buf, ws, we), wr, c


def _shape(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """The shape of each word, below SHAPES."""
    if not len(ws):
        return np.zeros(0, np.int16)
    last = buf[we - 1]
    letter = ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57)) | (last >= 128)
    mark = np.where(letter, 0, np.where(last == 44, 1, np.where(last == 46, 2, 3)))
    at = np.maximum(ws, we - 1 - ~letter)
    suffix = mix((buf[at].astype(np.uint64) << np.uint64(8)) | buf[np.maximum(ws, at - 1)].astype(np.uint64)) & np.uint64(7)
    high = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf >= 128, out=high[1:])
    length = np.searchsorted([4, 7, 11], we - ws, side="right")
    return (((mark * 2 + (high[we] > high[ws])) * 4 + length) * 8 + suffix.astype(np.int64)).astype(np.int16)


def training(id_col: str, folds: int = 7, out: int = 2) -> Column:
    """Whether a document trains: crc32 of its id as text, modulo folds, is not the fold held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != out


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, shape, c) of all words of the texts."""
    kinds = pa.schema([("h", pa.int64()), ("shape", pa.int16()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, n = (np.concatenate(x) for x in zip(*held))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, s[at], np.bincount(inv, n, len(u)).astype(np.int64)

        for batch in batches:
            for c in chunks(batch.column(0)):
                h, s, _, _ = tokens(c)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, s[at], n))
                size += len(u)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema=kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], schema=kinds)

    made = texts.select(text_col).mapInArrow(run, "h long, shape short, c long")
    return made.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Units:
    """Frequent words, sorted by hash, with their counts and units; shapes are the units from ``words`` on, the end is the last."""

    h: np.ndarray
    c: np.ndarray
    shape: np.ndarray
    unit: np.ndarray
    words: int
    #: Tokens of the corpus.
    tokens: int = 0

    def __post_init__(self) -> None:
        self.bits = max(1, int(len(self.h)).bit_length())
        top = (self.h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bits)
        self.start = np.searchsorted(top, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    @property
    def n(self) -> int:
        return self.words + SHAPES + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        top = ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out, at, end = np.full(len(h), -1, np.int32), self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.h[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def of(self, place: np.ndarray, shape: np.ndarray) -> np.ndarray:
        known = place >= 0
        unit = self.words + shape.astype(np.int64)
        own = np.where(known, self.unit[place] if len(self.unit) else -1, -1)
        return np.where(own >= 0, own, unit)


def frequent(counts: DataFrame, head: int, words: int | None, least: int = 50, tokens: int = 0) -> Units:
    """The words of the least count that no more than head words reach; the first ``words`` of them are units, or those with ``least``."""
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    # distinct counts up to c sum to at most the tokens, so these rows are few: their number grows as the root of the corpus
    seen, low = 0, 1 << 62
    for r in by_count.orderBy(F.col("c").desc()).toLocalIterator():
        seen += r["k"]
        if seen > head:
            break
        low = r["c"]
    top = counts.where(F.col("c") >= low).select("h", "c", "shape").toArrow()
    h, c, shape = (top.column(n).to_numpy().astype(np.int64) for n in ("h", "c", "shape"))
    order = np.argsort(h)
    h, c, shape = h[order], c[order], shape[order]
    if words is None:
        words = int((c >= least).sum())
    unit = np.full(len(h), -1, np.int32)
    unit[np.lexsort((h, -c))[:words]] = np.arange(min(words, len(h)))
    return Units(h, c, shape, unit, words, tokens)


def _sequence(c: Chunk, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and rows of the words; units of words and ends in order; where the ends stand."""
    h, s, row, _ = tokens(c)
    place = u.find(h)
    ends = np.cumsum(np.bincount(row, minlength=c.n) + 1) - 1
    seq = np.full(len(h) + c.n, u.n - 1, np.int64)
    at = np.arange(len(h)) + row
    seq[at] = u.of(place, s)
    return place, h, row, seq


_CODEC = pa.Codec("zstd")


def _packed(x: np.ndarray, kind: str) -> bytes:
    """Numbers by planes of bytes, compressed; most planes are zeros."""
    raw = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(x).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _numbers(x: pa.Scalar, kind: str) -> np.ndarray:
    raw, width = x.as_buffer(), np.dtype(kind).itemsize
    size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(_CODEC.decompress(raw.slice(8), size * width), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def _counted(pair: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    p, at, inv = np.unique(np.concatenate(pair), return_index=True, return_inverse=True)
    return p, np.bincount(inv, np.concatenate(n), len(p)).astype(np.int64)


#: A row of the table of neighbours: for units of a bucket, what follows them (0) and what goes before (1).
SIDES = ("0", "1")
TABLE = "bucket int, " + ", ".join(f"v{k} binary, o{k} binary, n{k} binary" for k in SIDES)


def neighbours(texts: DataFrame, u: Units, tokens_of_bucket: int = 1_000_000, text_col: str = "text") -> DataFrame:
    """Counts of adjacent units over all texts, an end before each, packed by bucket of units.

    Unit v is in bucket v % buckets; o0 follows v0 n0 times, o1 goes before v1 n1 times, each sorted by v and o.
    Buckets follow the tokens, so a row stays about as large; a hot unit has at most as many neighbours as there are units.
    """
    n = u.n
    buckets = max(24, int(u.tokens // tokens_of_bucket))
    shared = texts.sparkSession.sparkContext.broadcast(u)
    kinds = pa.schema([("bucket", pa.int32()), ("side", pa.int8()), *((x, pa.binary()) for x in "von")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            before, after = (np.concatenate(x) for x in zip(*held))
            for side, (v, o) in enumerate(((before, after), (after, before))):
                key, times = np.unique((v % buckets) * (n * n) + v * n + o, return_counts=True)
                bucket, pair = key // (n * n), key % (n * n)
                edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                rows = [(int(bucket[x]), _packed(pair[x:y] // n, "<i4"), _packed(pair[x:y] % n, "<i4"), _packed(times[x:y], "<i8")) for x, y in zip(edge[:-1], edge[1:])]
                for lo in range(0, len(rows), 64):
                    part = list(zip(*rows[lo : lo + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array([side] * len(part[0]), pa.int8()), *(pa.array(x, pa.binary()) for x in part[1:])], schema=kinds)

        for batch in batches:
            for c in chunks(batch.column(0)):
                seq = _sequence(c, shared.value)[3].astype(np.int64)
                held.append((np.concatenate([[n - 1], seq[:-1]]), seq))
                size += len(seq)
                if size > HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bucket: int, held: list[list]) -> pa.RecordBatch:
            out = []
            for part in held:
                pair, times = _counted(*zip(*part)) if part else (np.zeros(0, np.int64),) * 2
                out += [_packed(pair // n, "<i4"), _packed(pair % n, "<i4"), _packed(times, "<i8")]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in out)], names=["bucket", *(f"{x}{k}" for k in SIDES for x in "von")])

        now, held, size = None, [[], []], [0, 0]
        for batch in batches:
            for k, bucket, side in zip(range(batch.num_rows), batch.column("bucket").to_pylist(), batch.column("side").to_pylist()):
                if now is not None and bucket != now:
                    yield row(now, held)
                    held, size = [[], []], [0, 0]
                now = bucket
                v, o, times = (_numbers(batch.column(x)[k], t) for x, t in (("v", "<i4"), ("o", "<i4"), ("n", "<i8")))
                held[side].append((v.astype(np.int64) * n + o, times))
                size[side] += len(v)
                if size[side] > 4 * HELD:
                    held[side] = [_counted(*zip(*held[side]))]
                    size[side] = len(held[side][0][0])
        if now is not None:
            yield row(now, held)

    dealt = texts.select(text_col).mapInArrow(deal, "bucket int, side byte, v binary, o binary, n binary")
    table = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, TABLE)
    out = cut(table, "lm-pairs")
    shared.unpersist()
    return out


def _unpacked(batch: pa.RecordBatch, k: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(_numbers(batch.column(f"{x}{side}")[k], t) for x, t in (("v", "<i4"), ("o", "<i4"), ("n", "<i8")))


def between(table: DataFrame, labels: list[np.ndarray], classes: int) -> np.ndarray:
    """Counts of adjacent classes for each of the labellings, in one pass."""
    shared = table.sparkSession.sparkContext.broadcast(labels)
    cells = classes * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        total = np.zeros((len(held), cells))
        for batch in batches:
            for k in range(batch.num_rows):
                v, o, n = _unpacked(batch, k, "0")
                for j, lab in enumerate(held):
                    total[j] += np.bincount(lab[v].astype(np.int64) * classes + lab[o], n, cells)
        total = total.ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    made = table.select("v0", "o0", "n0").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(labels) * cells)
    out[made.column("pair").to_numpy()] = made.column("n").to_numpy()
    shared.unpersist()
    return out.reshape(len(labels), classes, classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(big: np.ndarray) -> float:
    """Log likelihood of class bigrams over that of the classes apart, but for what no exchange changes."""
    return float(_f(big).sum() - _f(big.sum(axis=1)).sum() - _f(big.sum(axis=0)).sum() + _f(big.sum()))


def least_gain(big: np.ndarray) -> float:
    """Gains below it are rounding."""
    return 1e-9 + 1e-13 * float(_f(big.sum()))


def move_gain(big: np.ndarray, r: np.ndarray, l: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the likelihood gains if one unit moves from class a to b while the others stay, for each unit.

    r and l: counts of the unit before and after each class, itself among class a; own: of the unit before itself.
    """
    k, classes = np.arange(len(a)), len(big)
    r, l = r.copy(), l.copy()
    r[k, a] -= own
    l[k, a] -= own
    # rows and columns of both classes; the four cells where they cross are counted by the rows
    ra, rb, ca, cb = big[a], big[b], big[:, a].T, big[:, b].T
    ra2, rb2, ca2, cb2 = ra - r, rb + r, ca - l, cb + l
    ra2[k, a] -= l[k, a] + own
    ra2[k, b] += l[k, a]
    rb2[k, a] -= l[k, b]
    rb2[k, b] += l[k, b] + own
    other = np.ones((len(a), classes), bool)
    other[k, a] = other[k, b] = False
    gain = (_f(ra2) - _f(ra) + _f(rb2) - _f(rb)).sum(axis=1) + (np.where(other, _f(ca2) - _f(ca) + _f(cb2) - _f(cb), 0.0)).sum(axis=1)
    rows, cols = big.sum(axis=1), big.sum(axis=0)
    out, into = r.sum(axis=1) + own, l.sum(axis=1) + own
    gain -= _f(rows[a] - out) - _f(rows[a]) + _f(rows[b] + out) - _f(rows[b])
    gain -= _f(cols[a] - into) - _f(cols[a]) + _f(cols[b] + into) - _f(cols[b])
    return np.where(a == b, 0.0, gain)


def best_moves(big: np.ndarray, r: np.ndarray, l: np.ndarray, own: np.ndarray, a: np.ndarray, tried: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A better class for each unit while the others stay, and what the move there gains.

    The first derivative of the gain ranks the classes; the gain itself is taken for the ``tried`` first.
    """
    classes = len(big)
    some = big + 0.5
    rows, cols = np.log(some.sum(axis=1)), np.log(some.sum(axis=0))
    slope = r @ (np.log(some) - rows[:, None]).T + l @ (np.log(some) - cols[None, :])
    slope[:, classes - 1] = -np.inf
    best, at = a.copy(), np.arange(len(a))
    most = np.zeros(len(a))
    for _ in range(min(tried, classes - 1)):
        b = slope.argmax(axis=1)
        slope[at, b] = -np.inf
        gain = move_gain(big, r, l, own, a, b)
        best, most = np.where(gain > most, b, best), np.maximum(gain, most)
    return best, most


def proposals(table: DataFrame, label: np.ndarray, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that gain by a move, those that gain most first, and the classes they go to."""
    classes, end, least = len(big), len(label) - 1, least_gain(big)
    shared = table.sparkSession.sparkContext.broadcast((label, big))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab, whole = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [_unpacked(batch, k, side) for side in SIDES]
                units = np.unique(np.concatenate([s[0] for s in sides]))
                both = []
                for v, o, n in sides:
                    # v is sorted: the place of each unit is the number of changes before
                    place = np.searchsorted(units, v[np.flatnonzero(np.diff(v, prepend=-1))]) if len(v) else np.zeros(0, np.int64)
                    at = np.repeat(place, np.diff(np.append(np.flatnonzero(np.diff(v, prepend=-1)), len(v))))
                    both.append(np.bincount(at * classes + lab[o], n, len(units) * classes).reshape(len(units), classes))
                v, o, n = sides[0]
                own = np.bincount(np.searchsorted(units, v[v == o]), n[v == o], len(units))
                b, gain = best_moves(whole, both[0], both[1], own, lab[units].astype(np.int64))
                on = (gain > least) & (units != end)
                yield pa.RecordBatch.from_arrays([pa.array(units[on].astype(np.int64)), pa.array(b[on]), pa.array(gain[on])], names=["v", "b", "gain"])

    made = table.mapInArrow(run, "v long, b long, gain double").toArrow()
    shared.unpersist()
    v, b, gain = (made.column(k).to_numpy() for k in ("v", "b", "gain"))
    order = np.lexsort((v, -gain))
    return v[order], b[order]


def climb(table: DataFrame, label: np.ndarray, classes: int, tolerance: float = 1e-4, shares: tuple[float, ...] = (1.0, 0.5, 0.2, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Exchange of all units over the table of neighbours, from given classes until no move gains or a round
    raises the log likelihood by less than ``tolerance`` of itself; classes and their bigrams.

    In a round every unit names a better class.  Moves made together can spoil each other, so the ``shares``
    of them that gain most are tried in one pass and the best is kept, or if none gains the first half of the least share.
    """
    label = label.astype(np.int16)
    big = between(table, [label], classes)[0]
    while True:
        v, b = proposals(table, label, big)
        if not len(v):
            return label, big
        before = likelihood(big)
        tries = sorted({max(1, int(len(v) * x)) for x in shares}, reverse=True)
        while tries:
            made = []
            for k in tries:
                new = label.copy()
                new[v[:k]] = b[:k]
                made.append(new)
            found = between(table, made, classes)
            best = int(np.argmax([likelihood(x) for x in found]))
            if likelihood(found[best]) > before:
                label, big = made[best], found[best]
                break
            tries = sorted({k // 4 for k in tries if k // 4}, reverse=True)
        if likelihood(big) - before < tolerance * abs(before):
            return label, big


def exchange(n: np.ndarray, classes: int, start: np.ndarray | None = None, free: int | None = None) -> np.ndarray:
    """The class of each unit, from ``start`` where given, until no move gains; the last unit, the end, has the last class alone.

    With ``free``, only so many first units move.
    """
    units = len(n)
    freq = n.sum(axis=0)
    order = np.lexsort((np.arange(units), -freq))
    order = order[(order != units - 1) & (freq[order] > 0) & (order < (units if free is None else free))]
    if start is None:
        label = np.zeros(units, np.int64)
        label[order] = np.arange(len(order)) % (classes - 1)
        label[units - 1] = classes - 1
    else:
        label = start.copy()
    f = _f
    one = np.zeros((units, classes))
    one[np.arange(units), label] = 1
    big = one.T @ n @ one
    here = n @ one  # from each unit to each class
    there = n.T @ one
    least, moved = least_gain(big), 1
    while moved:
        moved = 0
        for v in order:
            a = label[v]
            r, l, own = here[v].copy(), there[v].copy(), float(n[v, v])
            r[a] -= own
            l[a] -= own
            big[a] -= r
            big[:, a] -= l
            big[a, a] -= own
            rows, cols = big.sum(axis=1) + l, big.sum(axis=0) + r
            gain = (f(big + r[None, :]) - f(big)).sum(axis=1) + (f(big + l[:, None]) - f(big)).sum(axis=0)
            d = np.diag(big)
            gain += f(d + r + l + own) - f(d) - (f(d + r) - f(d)) - (f(d + l) - f(d))
            gain -= f(rows + r.sum() + own) - f(rows) + f(cols + l.sum() + own) - f(cols)
            gain[classes - 1] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            big[b] += r
            big[:, b] += l
            big[b, b] += own
            if b != a:
                label[v] = b
                moved += 1
                here[:, a] -= n[:, v]
                here[:, b] += n[:, v]
                there[:, a] -= n[v]
                there[:, b] += n[v]
    return label


@dataclass
class Model:
    """Broadcast to score: its size depends on ``head``, the words that are units and ``classes``."""

    units: Units
    label: np.ndarray
    after: np.ndarray
    room: np.ndarray
    delta: float
    total: int
    types: int
    ends: int

    def emit(self, c: Chunk) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sums of each row without the words that aren't frequent; those words (row, hash, times)."""
        u, n = self.units, c.n
        place, h, row, seq = _sequence(c, u)
        label = self.label[seq]
        before = np.concatenate([[self.label[-1]], label[:-1]])
        words = np.bincount(row, minlength=n)
        of = np.repeat(np.arange(n), words + 1)
        score = np.bincount(of, self.after[before, label] - self.room[label], n) + np.log10(self.ends + self.delta)
        known = place >= 0
        count = u.c[place[known]] if known.any() else np.zeros(0, np.int64)
        score += np.bincount(row[known], np.log10(count + self.delta), n)
        base = np.bincount(row[known], np.log10(count + 1.0), n) + np.log10(self.ends + 1.0)
        base -= (words + 1) * np.log10(self.total + self.types + 1.0)
        out = {"n_tokens": words + 1, "n_known": np.bincount(row[known], minlength=n) + (self.ends > 0), "base": base, "score": score}
        r, x = row[~known], h[~known]
        order = np.lexsort((x, r))
        r, x = r[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])) if len(r) else np.zeros(0, np.int64)
        return out, (r[first], x[first], np.diff(np.append(first, len(r))))


def fit(texts: DataFrame, text_col: str = "text", head: int = 400_000, words: int | None = None, classes: int = 48, alpha: float = 0.5, delta: float = 0.5, least: int = 50, seeds: int = 500) -> tuple[Model, DataFrame]:
    """The model of all texts, and the table of their word counts."""
    counts = cut(word_counts(texts, text_col), "lm-counts")
    ends = texts.count()
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    u = frequent(counts, head, words, least, int(total) + ends)
    own = np.flatnonzero(u.unit >= 0)
    table = neighbours(texts, u, text_col=text_col)
    # units are numbered by falling counts: the first stay alone at the start, the others are with their shape
    first = min(seeds, u.words)
    coarse = np.concatenate([np.arange(u.words), first + np.arange(SHAPES + 1)])
    late = own[u.unit[own] >= first]
    coarse[u.unit[late]] = first + u.shape[late]
    coarse[max(first, len(own)) : u.words] = first
    small = exchange(between(table, [coarse], first + SHAPES + 1)[0], classes)
    label, big = climb(table, small[coarse], classes)
    after = np.log10((big + alpha) / (big.sum(axis=1, keepdims=True) + alpha * classes))

    # tokens and distinct words of each unit
    by_shape = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).toArrow().to_pylist()
    size, kinds = np.zeros(u.n), np.zeros(u.n)
    for r in by_shape:
        size[u.words + r["shape"]], kinds[u.words + r["shape"]] = r["c"], r["k"]
    np.subtract.at(size, u.words + u.shape[own], u.c[own])
    np.subtract.at(kinds, u.words + u.shape[own], 1)
    size[u.unit[own]], kinds[u.unit[own]] = u.c[own], 1
    size[u.n - 1], kinds[u.n - 1] = ends, 1 if ends else 0
    size, kinds = (np.bincount(label, x, classes) for x in (size, kinds))
    room = np.log10(size + delta * (kinds + 1))
    return Model(u, label, after, room, delta, int(total) + ends, int(types) + (1 if ends else 0), ends), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"rid long, id {dict(docs.dtypes)[id_col]}, h long, tf long, n_tokens long, n_known long, base double, score double"

    def run(c: Chunk, part: pa.RecordBatch) -> Iterator[dict]:
        got, (r, h, tf) = shared.value.emit(c)
        rid = part.column("rid").to_numpy()
        # a text's own row goes with a key that spreads and weighs nothing
        yield {"rid": rid, "id": part.column("id"), "h": mix(rid.astype(np.uint64)).view(np.int64), "tf": np.zeros(c.n, np.int64)} | got
        none = pa.nulls(len(r))
        yield {"rid": rid[r], "id": none, "h": h, "tf": tf, "n_tokens": none, "n_known": none, "base": none, "score": none}

    made = emit_text(rows, "text", schema, run)
    c = F.coalesce("c", F.lit(0))
    met = made.join(counts.select("h", "c"), "h", "left")
    out = met.groupBy("rid").agg(
        F.max("id").alias(id_col),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.col("tf") * F.log10(c + 1.0))).alias("base_score"),
        (F.max("score") + F.sum(F.col("tf") * F.log10(c + F.lit(model.delta)))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).drop("rid")
