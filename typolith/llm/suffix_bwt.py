"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in
the texts.  Texts are UTF-8; matches never cross texts.

1. Anchors.  Each window of ``length`` bytes picks the least hash of the grams (half its
   length) in it.  Windows in a row that pick one place are a run.  Equal windows pick
   equal grams at equal offsets, so both lie in runs with the same anchor; runs whose
   anchor no other run has hold no repeat and go no further.
2. Contents.  Runs with equal bytes are counted, where they stand, before any shuffle.
   Of a content that occurs twice every window is a repeat.
3. Transforms.  Different contents with a common anchor meet in a task.  They are dealt
   to shards; a shard's suffixes are sorted and its transform holds, for each suffix, the
   symbol before it.  Symbols are blocks of ``length / 4`` bytes, so four of them are a
   window.  The transforms are merged by refining the interleave of the shards: a pass
   reads every shard's transform in the present order and deals its symbols to their
   buckets, which orders all suffixes by one symbol more; no suffix is sorted anew.  The
   pass in which two neighbours part is their common prefix; what has not parted after
   four passes shares ``length`` bytes and is a repeated interval.
4. Spans go back to the runs with that content, and from runs to their texts.

An anchor with very many contents is split before: windows go to pieces of 16 by their
offset from the anchor, keyed by the bytes that all of the piece share.  Of pieces with
equal bytes one goes on, so what meets in a task are a key's different strings.

Texts shorter than ``length``, null and empty ones keep all bytes.  Equal rows repeat
each other.  Grams, blocks and contents are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Chunk, mix
from .rowmap import emit_text
from .shared import cut

LENGTH, DEPTH = 400, 4
#: Bytes of text whose grams are hashed at once.
CHUNK = 1 << 20
#: Bytes that a task merges at once, bytes of a shard, contents beyond which an anchor is split, windows of a piece.
MERGE_BYTES, SHARD_BYTES, MANY, PIECE = 1 << 20, 1 << 17, 300, 16


# -- anchors ---------------------------------------------------------------


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = v
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(c: Chunk, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, place of the anchor and its hash of each run; places count from the buffer's start."""
    k = length // 2
    n = len(c.buf)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    at = np.arange(n - k + 1)
    h = c.span_hash(at, at + k)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = _sliding_min(((h >> bits) << bits) | at.astype(np.uint64), length - k + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(c.offs)
    valid = np.zeros(n + 1, np.int32)
    long = size >= length
    valid[c.offs[:-1][long]] += 1
    valid[c.offs[1:][long] - length + 1] -= 1
    ok = np.cumsum(valid)[: len(anchor)] > 0
    start = ok.copy()
    start[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(start)
    if not len(first):
        return none
    total = np.cumsum(ok)
    windows = np.diff(np.append(total[first] - 1, total[-1]))
    return c.per_row(first), first, windows, anchor[first], h[anchor[first]]


# -- transforms ------------------------------------------------------------


class Shard:
    """Suffixes of some strings by blocks of b bytes: their order, and the transform.

    A node is a place in a string.  One with a whole block after it has that block for
    its symbol and the place behind the block for its successor; the others are ends.
    """

    def __init__(self, strings: list[bytes], b: int):
        size = np.array([len(s) for s in strings], np.int64)
        nodes = size + 1
        self.base = np.concatenate([[0], np.cumsum(nodes)])
        self.string = np.repeat(np.arange(len(strings)), nodes)
        self.at = np.arange(self.base[-1]) - np.repeat(self.base[:-1], nodes)
        offs = np.concatenate([[0], np.cumsum(size)])
        c = Chunk(np.frombuffer(b"".join(strings), np.uint8), offs, np.arange(len(strings)))
        whole = self.at + b <= size[self.string]
        place = offs[:-1][self.string] + self.at
        self.symbol = np.zeros(int(self.base[-1]), np.uint64)
        self.symbol[whole] = c.span_hash(place[whole], place[whole] + b)
        self.whole, self.b = whole, b

    def sort(self, codes: np.ndarray) -> None:
        """Order all suffixes by doubling; codes: each node's symbol as a number shared by all shards, 0 for ends."""
        n, b = len(codes), self.b
        rank = codes.astype(np.int64)
        # ends differ, by string and place, so that the order is total
        ends = np.flatnonzero(~self.whole)
        rank += len(ends)
        rank[ends] = np.arange(len(ends))
        step = self.b
        to = np.arange(n)
        left = self.base[1:][self.string] - to  # nodes from each one to its string's last
        while True:
            ahead = np.zeros(n, np.int64)
            inside = np.flatnonzero(left > step)
            ahead[inside] = rank[inside + step] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            self.order = np.argsort(key)
            s = key[self.order]
            rank[self.order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            if rank[self.order[-1]] == n - 1:
                break
            step *= 2
        # the transform: the symbol before each suffix, -1 at a string's first block
        before = self.order - self.b
        has = self.at[self.order] >= self.b
        self.bwt = np.where(has, codes[np.where(has, before, 0)], -1)
        # where the transform's symbols go when they are dealt to their buckets in order
        keep = np.flatnonzero(has)
        self.dealt = keep[np.argsort(self.bwt[keep], kind="stable")]
        self.ends = len(ends)


def repeated(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string, whether the window at each place also starts elsewhere in the strings."""
    b = length // DEPTH
    shards, part, size, where = [], [], 0, []
    for k, s in enumerate(strings):
        where.append((len(shards), len(part)))
        part.append(s)
        size += len(s)
        if size >= shard_bytes or k == len(strings) - 1:
            shards.append(Shard(part, b))
            part, size = [], 0
    symbols = np.concatenate([s.symbol[s.whole] for s in shards])
    codes = np.unique(symbols, return_inverse=True)[1] + 1
    at = 0
    for s in shards:
        n = int(s.whole.sum())
        own = np.zeros(len(s.whole), np.int64)
        own[s.whole] = codes[at : at + n]
        at += n
        s.sort(own)

    # the interleave, as the place of each shard's r-th suffix among all; every shard in turn at first
    count = np.array([len(s.bwt) for s in shards])
    base = np.concatenate([[0], np.cumsum(count)])
    total = int(base[-1])
    place = np.arange(total)
    block = np.zeros(total, np.int64)
    source = np.concatenate([s.dealt + base[k] for k, s in enumerate(shards)])
    symbol = np.concatenate([s.bwt[s.dealt] for s in shards])
    target = np.concatenate([np.arange(s.ends, len(s.bwt)) + base[k] for k, s in enumerate(shards)])
    lead = np.concatenate([np.arange(s.ends) + base[k] for k, s in enumerate(shards)])
    for _ in range(DEPTH):
        # each shard's part of a bucket is in order already: the stable sort merges runs
        order = np.argsort(symbol * total + place[source], kind="stable")
        sym, old = symbol[order], block[source[order]]
        # ends come first and are one block; a new block begins where symbol or old block change
        new = np.ones(len(order), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
        place[lead] = np.arange(len(lead))
        place[target[order]] = np.arange(len(lead), total)
        block[lead] = 0
        block[target[order]] = np.cumsum(new)

    window = np.concatenate([(s.base[1:][s.string] - 1 - np.arange(len(s.at)) >= length)[s.order] for s in shards])
    hit = window & (np.bincount(block, window) > 1)[block]
    flags = []
    for k, s in enumerate(shards):
        f = np.zeros(len(s.whole), bool)
        f[s.order[hit[base[k] : base[k + 1]]]] = True
        flags.append(f)
    return [flags[k][shards[k].base[j] : shards[k].base[j + 1]] for k, j in where]


def _spans(flag: np.ndarray, length: int) -> np.ndarray:
    """Bytes that flagged windows cover, as (from, to) pairs in one flat array."""
    at = np.flatnonzero(flag)
    if not len(at):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], at[1:] - at[:-1] > length])
    lo = at[first]
    hi = at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)] + length
    return np.stack([lo, hi], axis=1).ravel()


# -- Spark -----------------------------------------------------------------


def _emit_runs(length: int):
    def emit(c: Chunk, part: pa.RecordBatch) -> Iterator[dict]:
        row, first, windows, anchor, f = runs(c, length)
        text = c.span_hash(c.offs[:-1], c.offs[1:], 1).view(np.int64)
        content = c.span_hash(first, first + windows + length - 1).view(np.int64)
        # the anchor's place within the run is part of the content
        content = (content.view(np.uint64) + mix((anchor - first).astype(np.uint64))).view(np.int64)
        # a text that has a content many times repeats it: one row, with the bytes that all its places cover in ``own``
        key = mix(content.view(np.uint64) ^ mix(row.astype(np.uint64) + np.uint64(1)))
        _, one, group, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[group] > 1)
        many = many[np.lexsort((first[many], group[many]))]
        lo, g = first[many] - c.offs[row[many]], group[many]
        hi = lo + windows[many] + length - 1
        new = np.ones(len(many), bool)
        new[1:] = (g[1:] != g[:-1]) | (lo[1:] > hi[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(many)) - 1 if len(many) else many
        ends = 2 * np.searchsorted(g[new], np.arange(len(one) + 1))
        offsets = pa.array(ends.astype(np.int32), mask=np.append(np.diff(ends) == 0, False))
        own = pa.ListArray.from_arrays(offsets, pa.array(np.stack([lo[new], hi[last]], axis=1).ravel()))
        yield {"f": f.view(np.int64)[one], "content": content[one], "id": part.column("id").take(pa.array(row[one])), "t": text[row[one]], "start": first[one] - c.offs[row[one]], "n": windows[one], "a": (anchor - first)[one], "own": own}

    return emit


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, same, bytes, twice) come ordered by key; groups are merged together up to MERGE_BYTES."""
    kinds = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("spans", pa.list_(pa.int64()))])

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated([r[2] for r in rows], length)
        out = [(r[0], r[1], np.array([0, len(r[2])]) if r[3] else _spans(f, length)) for r, f in zip(rows, flags, strict=True) if r[3] or f.any()]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], schema=kinds)

    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for key, same, bytes_, twice in zip(*(batch.column(n).to_pylist() for n in ("key", "same", "bytes", "twice")), strict=True):
            if size >= MERGE_BYTES and key != last:
                yield judge(held)
                held, size = [], 0
            held.append((key, same, bytes_, twice))
            size += len(bytes_)
            last = key
    if held:
        yield judge(held)


def spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, t, spans): the parts of each text that repeat, from rows (id, text); t is a hash of the text."""
    id_type = dict(rows.dtypes)["id"]
    found = emit_text(rows, "text", f"f long, content long, id {id_type}, t long, start long, n int, a int, own array<long>", _emit_runs(length), CHUNK)
    times = F.sum(F.when(F.col("own").isNull(), 1).otherwise(2))
    # written, as are kinds and cover below, so that Spark can split an anchor that many runs have
    twice = cut(found.groupBy("f").agg(times.alias("k")).where("k > 1").select("f"), "bwt-anchors")
    shared = cut(found.join(twice, "f", "left_semi"), "bwt-runs")
    # a content stands for all its runs; one of them says where to find its bytes
    one = F.min(F.struct("id", "t", "start", "n", "a")).alias("one")
    contents = cut(shared.groupBy("f", "content").agg(times.alias("times"), one), "bwt-contents")
    kinds = cut(contents.groupBy("f").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "bwt-kinds")
    wanted = contents.join(kinds, "f").select("f", "content", (F.col("kinds") > MANY).alias("many"), "one.*")
    wanted = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("f", "content", "many", "start", "n", "a")).alias("runs"))
    texts = rows.withColumnRenamed("id", "_id").join(wanted, F.col("_id").eqNullSafe(F.col("id"))).select("text", "t", "runs")

    def load(c: Chunk, part: pa.RecordBatch) -> Iterator[dict]:
        same = c.span_hash(c.offs[:-1], c.offs[1:], 1).view(np.int64) == part.column("t").to_numpy()
        out: dict[str, list] = {k: [] for k in ("key", "f", "content", "off", "piece", "bytes")}

        def add(*row) -> None:
            for k, v in zip(out, row, strict=True):
                out[k].append(v)

        for r in np.flatnonzero(same):
            text = c.text(r)
            for x in part.column("runs")[int(r)].as_py():
                s, n, a = x["start"], x["n"], x["a"]
                if not x["many"]:
                    add(x["f"], x["f"], x["content"], 0, False, text[s : s + n + length - 1])
                    continue
                for j in range((0 - a) // PIECE, (n - 1 - a) // PIECE + 1):
                    lo, hi = max(0, a + PIECE * j), min(n - 1, a + PIECE * j + PIECE - 1)
                    core = text[s + a + PIECE * j + PIECE - 1 : s + a + PIECE * j + length]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=f"{x['f']}:{j}".encode()).digest(), "big", signed=True)
                    add(key, x["f"], x["content"], lo, True, text[s + lo : s + hi + length])
        yield out

    loaded = emit_text(texts, "text", "key long, f long, content long, off long, piece boolean, bytes binary", load)
    loaded = cut(loaded.withColumn("same", F.xxhash64("bytes")), "bwt-loaded")
    # strings of two contents are repeats as they are, and stand once for others to meet
    strings = loaded.groupBy("key", "same").agg(F.first("bytes").alias("bytes"), (F.min(F.struct("f", "content")) != F.max(F.struct("f", "content"))).alias("twice"))
    merged = strings.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _merge(it, length), "key long, same long, spans array<long>")
    met = loaded.select("key", "same", "f", "content", "off").distinct().join(merged, ["key", "same"])
    parts = met.groupBy("f", "content").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("off")))).alias("spans"))
    whole = F.array(F.lit(0).cast("long"), (F.col("one.n") + length - 1).cast("long"))
    cover = contents.join(parts, ["f", "content"], "left").select("f", "content", F.when(F.col("times") > 1, whole).otherwise(F.col("spans")).alias("spans"))
    cover = cut(cover.where("spans is not null"), "bwt-cover")
    there = F.when(F.col("own").isNull(), F.transform("spans", lambda x: x + F.col("start"))).otherwise(F.col("own"))
    back = shared.join(cover, ["f", "content"]).select("id", "t", there.alias("spans"))
    return back.groupBy("id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of docs; spans are (from, to) byte offsets."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = spans(rows, length).withColumnsRenamed({"id": "_id", "t": "_t"})
    # an id can stand for several texts: the hash tells which spans are whose
    keyed = emit_text(rows, "text", f"id {dict(rows.dtypes)['id']}, t long, text string", lambda c, part: iter([{"id": part.column("id"), "t": c.span_hash(c.offs[:-1], c.offs[1:], 1).view(np.int64), "text": part.column("text")}]))
    met = keyed.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("id", "text", "spans")
    schema = f"{id_col} {dict(rows.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"

    def finish(c: Chunk, part: pa.RecordBatch) -> Iterator[dict]:
        n_removed, n_spans, sha, out = [], [], [], []
        for k, flat in enumerate(part.column("spans")):
            text = c.text(k)
            if flat.is_valid:
                s = flat.values.to_numpy().reshape(-1, 2)
                s = s[np.argsort(s[:, 0], kind="stable")]
                top = np.maximum.accumulate(s[:, 1])
                new = np.concatenate([[True], s[1:, 0] > top[:-1]])
                lo = s[new, 0]
                hi = top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
            else:
                lo = hi = np.zeros(0, np.int64)
            digest, at = hashlib.sha256(), 0
            for a, b in zip(lo, hi, strict=True):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            n_removed.append(int((hi - lo).sum()))
            n_spans.append(len(lo))
            sha.append(digest.hexdigest())
            out.append(np.stack([lo, hi], axis=1).ravel())
        yield {id_col: part.column("id"), "n_bytes": np.diff(c.offs), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": sha, "spans": out}

    return emit_text(met, "text", schema, finish)
