"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased (A-Z) and shingled by five.  Windows of a text that hold as many
words as an item, at every start from which they reach a shingle of an item, get a
64-bit SimHash of their shingles, each weighing as often as it occurs.  An index of eight
8-bit blocks finds every item fingerprint within the radius: of fingerprints that differ
in at most 23 bits, some block differs in at most two.  Exact similarity then decides:
sum of least over sum of greatest shingle counts, 0.8 or more.

Other windows share no shingle with any item, so their similarity is 0.  At 0.8 two
fingerprints differ in 10 bits on average and in over 23 less than once in 10,000.
A text shorter than an item is compared whole.  Items of fewer than five words, or null,
match nothing; null and empty texts are clean; equal rows and equal items each count.
Ids of either table can be of any type, and null.  Of windows equally similar to an item
the first counts.  Other columns don't matter to ``matches`` and pass ``clean`` whatever
their names.

Items are a stated query set: they go to the executors in blocks of bounded bytes, and
each block is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Chunk, chunks, grams
from .rowmap import emit_text, map_text

N, RADIUS = 5, 23
#: Bytes of item shingles that are broadcast at once.
BLOCK_BYTES = 32 << 20
_BITS = np.arange(64, dtype=np.uint64)
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of signs, a row of 64 for each window."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def signs(g: np.ndarray) -> np.ndarray:
    return (((g[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) << 1) - 1


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    both, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(inv[: len(a)], minlength=len(both)), np.bincount(inv[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Index:
    """Items by their length in words; blocks of their fingerprints; who has which shingle."""

    def __init__(self, ids: list, shingles: list[np.ndarray]):
        self.ids, self.shingles = ids, shingles
        self.table = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.table & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        prints = np.array([simhash(signs(s).sum(axis=0, dtype=np.int64)[None, :])[0] for s in shingles], np.uint64)
        self.prints = prints
        pairs = [(np.searchsorted(self.table, np.unique(s)), k) for k, s in enumerate(shingles)]
        at = np.concatenate([p for p, _ in pairs]) if pairs else np.zeros(0, np.int64)
        who = np.concatenate([np.full(len(p), k) for p, k in pairs]) if pairs else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        self.who, self.edge = who[order], np.searchsorted(at[order], np.arange(len(self.table) + 1))
        self.sizes = np.array([len(s) + N - 1 for s in shingles], np.int64)
        self._near: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of a size, and for each block and value those within two bits of it."""
        if size not in self._near:
            who = np.flatnonzero(self.sizes == size)
            value = np.arange(256, dtype=np.uint8)
            blocks = np.stack([(self.prints[who] >> np.uint64(8 * b)).astype(np.uint8) for b in range(8)])
            self._near[size] = who, _ONES[value[None, :, None] ^ blocks[:, None, :]] <= RADIUS // 8
        return self._near[size]

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in g of shingles that items have, and which ones they are."""
        at = np.flatnonzero(self.bloom[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.table, g[at]), max(0, len(self.table) - 1))
        ok = self.table[k] == g[at]
        return at[ok], k[ok]

    def search(self, g: np.ndarray, at: np.ndarray, k: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window of a text for each item it has; g: all its shingles."""
        best: dict[int, tuple[float, int]] = {}
        who = np.unique(np.concatenate([self.who[self.edge[x] : self.edge[x + 1]] for x in np.unique(k)]))
        for size in np.unique(self.sizes[who]):
            m = int(size) - N + 1
            last = max(0, len(g) - m)
            cover = np.zeros(last + 2, np.int64)
            np.add.at(cover, np.clip(at - m + 1, 0, last), 1)
            np.add.at(cover, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            items, table = self.near(int(size))
            for lo in range(0, len(starts), 4096):
                part = starts[lo : lo + 4096]
                low, high = part[0], min(len(g), part[-1] + m)
                sums = np.zeros((high - low + 1, 64), np.int32)
                np.cumsum(signs(g[low:high]), axis=0, out=sums[1:], dtype=np.int32)
                f = simhash(sums[np.minimum(part + m, len(g)) - low] - sums[part - low])
                ok = np.zeros((len(part), len(items)), bool)
                for b in range(8):
                    ok |= table[b, (f >> np.uint64(8 * b)).astype(np.uint8)]
                x, y = np.nonzero(ok)
                ok = np.bitwise_count(f[x] ^ self.prints[items[y]]) <= RADIUS
                for i, j in zip(x[ok], y[ok], strict=True):
                    s, item = int(part[i]), int(items[j])
                    got = similarity(g[s : s + m], self.shingles[item])
                    if got >= threshold - 1e-12 and got > best.get(item, (0.0, 0))[0]:
                        best[item] = got, s
        return [(item, s, at) for item, (s, at) in sorted(best.items())]


def _shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all rows, the row of each, and where each row's begin."""
    c = c.lowered()
    ws, we, wr = c.words()
    g, at = grams(c.span_hash(ws, we), wr, N)
    row = wr[at]
    return g, row, np.searchsorted(row, np.arange(c.n + 1))


def indexes(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of all items, each of bounded bytes."""
    ids, held, size = [], [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        for c in chunks(pa.array([r["t"]], pa.string())):
            g = _shingles(c)[0]
            if len(g):
                ids.append(r["i"])
                held.append(g)
                size += 40 * len(g) + 2048
        if size >= limit:
            yield Index(ids, held)
            ids, held, size = [], [], 0
    if held:
        yield Index(ids, held)


def _found(c: Chunk, index: Index, threshold: float) -> Iterator[tuple[int, list[tuple[int, float, int]]]]:
    g, row, edge = _shingles(c)
    at, k = index.hits(g)
    rows = np.unique(row[at])
    for r in rows:
        lo, hi = edge[r], edge[r + 1]
        x, y = np.searchsorted(at, [lo, hi])
        if got := index.search(g[lo:hi], at[x:y] - lo, k[x:y], threshold):
            yield int(r), got


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, limit: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, similarity, first_word, n_words): the best window of each text for each item that it holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, item {dict(items.dtypes)[item_col]}, similarity double, first_word long, n_words long"
    out = None
    for index in indexes(items, item_col, item_text_col, limit):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def emit(c: Chunk, part: pa.RecordBatch, held=held) -> Iterator[dict]:
            index = held.value
            ids = part.column("id")
            hit = [(r, *x) for r, got in _found(c, index, threshold) for x in got]
            yield {"id": ids.take(pa.array([h[0] for h in hit], pa.int64())), "item": [index.ids[h[1]] for h in hit], "similarity": [h[2] for h in hit], "first_word": [h[3] for h in hit], "n_words": [int(index.sizes[h[1]]) for h in hit]}

        part = emit_text(rows, "text", schema, emit)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item."""
    leak = "leak"
    while leak in docs.columns:
        leak += "_"
    for index in indexes(items, item_col, item_text_col, limit):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def judge(c: Chunk, held=held) -> dict:
            bad = np.zeros(c.n, bool)
            bad[[r for r, _ in _found(c, held.value, threshold)]] = True
            return {leak: bad}

        docs = map_text(docs, text_col, f"{leak} boolean", judge).where(f"not {leak}").drop(leak)
    return docs
