"""Jaccard join of word n-gram sets with Bayesian pruning of candidates.

A document is its set of word n-grams (five words; a shorter text with a word is one
gram; a text without words, null or empty, links to nothing).  Documents with equal sets
are one class.  Classes that agree in a band of MinHash values are joined to the least
class of that band, and components of those joins hold every candidate pair.  A
component is cut by set size, each step a ratio of 1.26, and then into blocks; a task gets a
pair of blocks of the same or the next size, so that a large component is many tasks and
each pair of classes whose sizes allow the threshold meets in one.  There MinHash values are compared
step by step: a pair is dropped when, under a uniform prior, the posterior probability
that its similarity reaches the threshold falls below the tolerance.  Pairs that are
left are verified on the whole sets.  Nothing is capped: a task returns counts and a
spanning star for each of its classes, never the pairs.

With 32 bands of six a pair at the threshold of 0.8 shares no band once in 16,000.
Sets are told apart by 64-bit hashes.  Rows with equal ids are rows of their own; ids can
be of any type, and null.  Other columns don't matter, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Chunk, grams, mix
from .components import components
from .rowmap import emit_text, map_text
from .shared import cut

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
STEP = 32
BLOCK = 512
#: Sets whose sizes differ by more than 1.25 times can't reach 0.8; a step above that keeps all others in neighbouring steps.
STEP_RATIO = 1.26

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def gram_sets(c: Chunk, n: int) -> list[np.ndarray]:
    """The sorted n-gram hashes of each row."""
    ws, we, wr = c.words()
    h = c.span_hash(ws, we)
    g, at = grams(h, wr, n)
    words = np.searchsorted(wr, np.arange(c.n + 1))
    edge = np.searchsorted(wr[at], np.arange(c.n + 1)) if len(at) else np.zeros(c.n + 1, np.int64)
    out = []
    for k in range(c.n):
        a, b = words[k], words[k + 1]
        if 0 < b - a < n:
            out.append(grams(h[a:b], wr[a:b], int(b - a))[0] ^ np.uint64(b - a))
        else:
            out.append(np.unique(g[edge[k] : edge[k + 1]]))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 2048):
        out = np.minimum(out, (_MUL[:, None] * low[None, lo : lo + 2048] + _ADD[:, None]).min(axis=1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band, which no two bands share."""
    v = sig.reshape(BANDS, ROWS).astype(np.uint64)
    k = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        k = mix(k ^ v[:, r]) + np.uint64(0x9E3779B97F4A7C15)
    return k.view(np.int64)


def set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, the matches below which the posterior of reaching the threshold is under the tolerance."""
    out = []
    for h in range(STEP, HASHES + 1, STEP):
        tail, least = 0.0, h + 1
        for m in range(h + 1):  # Beta(m + 1, h - m + 1) beyond t is a binomial sum
            tail += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if tail >= tolerance:
                least = m
                break
        out.append(least)
    return out


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common grams of the pairs (a[k], b[k])."""
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    num = np.full(len(sets), -1)
    num[used] = np.arange(len(used))
    flat = np.concatenate([sets[i] for i in used])
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    col, row = col[shared], row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    _, col = np.unique(col, return_inverse=True)
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        x, y = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(used), width), np.float32)
        m[row[x:y], col[x:y] - lo] = 1
        total += m @ m.T
    return total[num[a], num[b]].astype(np.int64)


def links(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, few: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left x right (of left's own pairs, if right is left) that reach the threshold."""
    size = np.array([len(s) for s in sets])
    found = []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        same = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(STEP):
            same += sigs[rows, k][:, None] == sigs[right, k][None, :]
        ok = same >= few[0]
        ok &= np.minimum(size[rows][:, None], size[right][None, :]) >= threshold * np.maximum(size[rows][:, None], size[right][None, :]) - 1e-9
        if left is right:
            ok &= (np.arange(lo, lo + len(rows))[:, None] < np.arange(len(right))[None, :])
        i, j = np.nonzero(ok)
        a, b, n = rows[i], right[j], same[i, j].astype(np.int64)
        for s, least in enumerate(few[1:], 1):
            n = n + (sigs[a, s * STEP : (s + 1) * STEP] == sigs[b, s * STEP : (s + 1) * STEP]).sum(axis=1)
            ok = n >= least
            a, b, n = a[ok], b[ok], n[ok]
        if len(a):
            both = overlaps(sets, a, b)
            ok = both * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-9
            found.append((a[ok], b[ok]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by hooking and shortcuts."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_pairs(batches: Iterator[pa.RecordBatch], threshold: float, few: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (comp, i, j); a group's rows are held until it ends."""
    kinds = pa.schema([("key", pa.int64()), ("n_links", pa.int64()), ("n_docs", pa.int64()), ("root", pa.int64())])

    def judge(t: pa.Table) -> pa.RecordBatch | None:
        key = t.column("key").to_numpy()
        first = np.unique(key, return_index=True)[1]
        t = t.take(pa.array(first))
        key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
        copies = t.column("copies").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sigs = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("sig")])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")]
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        a, b = links(sigs, sets, left, right, threshold, few)
        if not len(a):
            return None
        n = np.bincount(a, minlength=len(key)) + np.bincount(b, minlength=len(key))
        docs = np.bincount(a, copies[b], len(key)) + np.bincount(b, copies[a], len(key))
        root = _roots(len(key), a, b)
        has = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(n[has]), pa.array(docs[has].astype(np.int64)), pa.array(key[root[has]])], schema=kinds)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(n).to_numpy() for n in ("comp", "i", "j")])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(names[:, lo])
            if now != last and held:
                if out := judge(pa.Table.from_batches(held)):
                    yield out
                held = []
            last = now
            held.append(batch.slice(lo, hi - lo))
    if held and (out := judge(pa.Table.from_batches(held))):
        yield out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """A row for each document: id, class_id, n_links, n_text_links, n_copies.

    class_id is the least id of the documents that links connect it to, its own included;
    n_links the other documents of similarity threshold or more, n_text_links the
    different sets among them, n_copies the documents with an equal set.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign(c: Chunk) -> dict:
        sets = gram_sets(c, n)
        return {"key": [set_key(s) if len(s) else None for s in sets], "bands": [band_keys(signature(s)) if len(s) else None for s in sets], "step": [int(np.log(len(s)) / ratio) if len(s) else None for s in sets]}

    ratio = np.log(max(1.0, 1 / threshold) * (STEP_RATIO / 1.25))
    signed = cut(map_text(rows, "text", "key long, bands array<long>, step int", sign).drop("text"), "join-signed")
    classes = cut(signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("step").alias("step")), "join-classes")

    entries = classes.select("key", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("low")).where("k > 1").drop("k")
    near = components(entries.join(buckets, "band").select(F.col("key").alias("a"), F.col("low").alias("b")))
    near = cut(near.withColumnsRenamed({"node": "key", "root": "comp"}), "join-comps")

    # written, so that the joins that follow can split a large component
    active = cut(near.join(classes.drop("bands"), "key"), "join-active")
    sizes = active.groupBy("comp", "step").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    # the steps that each one meets: its own, and those before and after it that there are
    beside = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))
    beside = sizes.select("comp", beside.alias("step"), F.struct("step", "nb").alias("met")).groupBy("comp", "step").agg(F.collect_list("met").alias("met"))
    steps = cut(sizes.join(beside, ["comp", "step"]), "join-steps")
    number = lambda step, k: step.cast("long") * (1 << 32) + k
    active = active.join(steps, ["comp", "step"]).select("key", "rep", "copies", "comp", number(F.col("step"), F.pmod(F.xxhash64("key"), F.col("nb"))).alias("block"), F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.lit(0), m["nb"] - 1), lambda k: number(m["step"], k)))).alias("others"))

    def payload(c: Chunk, part: pa.RecordBatch) -> Iterator[dict]:
        sets = gram_sets(c, n)
        want = part.column("key").to_pylist()
        ok = [k for k in range(c.n) if len(sets[k]) and set_key(sets[k]) == want[k]]
        take = part.take(pa.array(ok, pa.int64()))
        yield {x: take.column(x) for x in ("key", "copies", "comp", "others", "block")} | {"sig": [signature(sets[k]).tobytes() for k in ok], "grams": [sets[k].tobytes() for k in ok]}

    held = rows.join(active, rows["id"].eqNullSafe(active["rep"])).select("key", "copies", "comp", "others", "block", "text")
    loaded = emit_text(held, "text", "key long, copies long, comp long, others array<long>, block long, sig binary, grams binary", payload)
    met = loaded.select("*", F.explode("others").alias("other"))
    met = met.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "copies", "sig", "grams")
    few = fewest_matches(threshold, tolerance)
    found = met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(lambda it: _block_pairs(it, threshold, few), "key long, n_links long, n_docs long, root long")
    found = cut(found, "join-links")

    linked = found.groupBy("key").agg(F.sum("n_links").alias("n_text_links"), F.sum("n_docs").alias("n_docs"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "key"})
    named = classes.select("key", "rep", "copies").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "root").join(linked, "key", "left")
    named = cut(named.select("key", "class_id", (F.col("copies") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.col("copies").alias("n_copies")), "join-named")
    out = signed.select("id", "key").join(named, "key", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
