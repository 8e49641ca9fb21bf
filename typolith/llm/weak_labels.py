"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text (see LABELLERS).  The votes of
all texts are counted by pattern, of which there are at most three to the power of the
labellers.  Expectation-maximisation on those counts estimates each labeller's votes on
good and on bad texts, and the share of good ones; each pattern then has a posterior.

The posterior labels of a sample (``train_rows`` texts by hash of their id, a bound that
doesn't grow with the corpus) train a logistic regression over hashed features: words,
their shapes (runs of letters, capitals, digits and marks), pairs of shapes and repeats,
each as a share of the text's words.  The regression scores every text; score 0 or more
is kept.

Null and empty texts get the votes and the score of a text without words.  Equal texts
get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Chunk, counts_per_row, mix
from .line_rules import _judge, _within
from .rowmap import emit_text, map_text

LABELLERS = ("symbols", "repeats", "duplicate lines", "length", "lines lost", "word length", "capitals", "stutter", "sentence marks")
DIMS = 1 << 16

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def votes(c: Chunk) -> np.ndarray:
    """A row of votes (2 good, 1 none, 0 bad) for each text."""
    q = _judge(c, 20, 30, 0.5, False)
    ws, we, wr = c.words()
    n = np.maximum(q["n_words"], 1).astype(float)
    h = c.span_hash(ws, we)
    upper = (_within((c.buf >= 65) & (c.buf <= 90), ws, we) >= 2) & (_within((c.buf >= 97) & (c.buf <= 122), ws, we) == 0)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wr[1:] == wr[:-1])
    marks = _within((c.buf == 46) | (c.buf == 33) | (c.buf == 63), c.offs[:-1], c.offs[1:]) / n
    length = q["word_chars"] / n

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 2, 1))

    symbols, repeats = q["n_symbols"] / n, q["n_repeat_words"] / n
    dup, lost = q["n_dup_lines"] / np.maximum(q["n_lines"], 1), q["lost_chars"] / np.maximum(q["word_chars"], 1)
    caps, stutter = counts_per_row(wr[upper], c.n) / n, counts_per_row(wr[again], c.n) / n
    return np.stack([
        vote(symbols < 0.02, symbols > 0.1), vote(repeats < 0.1, repeats > 0.3), vote(dup < 0.1, dup > 0.3),
        vote(q["n_words"] >= 50, q["n_words"] < 5), vote(lost < 0.05, lost > 0.5), vote((length > 2) & (length < 9), (length < 1.5) | (length > 12)),
        vote(caps < 0.1, caps > 0.3), vote(stutter < 0.02, stutter > 0.1), vote((marks > 0.01) & (marks < 0.4), (marks < 0.003) | (marks > 0.8)),
    ], axis=1)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


@dataclass
class LabelModel:
    """P(good), and each labeller's distribution of votes on bad and good texts."""

    prior: float
    table: np.ndarray  # class, labeller, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = patterns[:, None] // 3 ** np.arange(self.table.shape[1]) % 3
        like = np.log(self.table[:, np.arange(v.shape[1])[None, :], v]).sum(axis=2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation; it starts from the majority of votes, so the second class is good."""
    m = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(m) % 3
    lean = (v - 1).sum(axis=1) - 3 * (v == 0).sum(axis=1)
    good = np.where(lean > 0, 0.95, 0.05)
    total = max(1.0, counts.sum())
    model = LabelModel(0.5, np.full((2, m, 3), 1 / 3))
    for _ in range(rounds):
        w = np.stack([(1 - good) * counts, good * counts])
        table = np.stack([[np.bincount(v[:, k], w[y], 3) + 0.5 for k in range(m)] for y in (0, 1)])
        table /= table.sum(axis=2, keepdims=True)
        prior = float(np.clip(w[1].sum() / total, 1e-4, 1 - 1e-4))
        still = abs(prior - model.prior) < 1e-9 and np.abs(table - model.table).max() < 1e-9
        model = LabelModel(prior, table)
        good = model.posterior(patterns)
        if still:
            break
    return model


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of each hit, and the words of each row."""
    ws, we, wr = c.words()
    n = counts_per_row(wr, c.n)
    low = c.lowered().span_hash(ws, we, 1)
    # shapes: letters, capitals and digits stand for their kind, and runs of one byte for one
    kind = _SHAPE[c.buf]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[ws] = True
    to = np.concatenate([[0], np.cumsum(new)])
    folded = Chunk(kind[new], np.array([0, int(new.sum())]), np.array([0]))
    shape = folded.span_hash(to[ws], to[we], 2)
    pair = mix(shape[1:] * np.uint64(3) + shape[:-1])
    again = low[1:] == low[:-1]
    same = wr[1:] == wr[:-1] if len(wr) else np.zeros(0, bool)
    row = np.concatenate([wr, wr, wr[1:][same], wr[1:][same & again]])
    feature = np.concatenate([low, shape, pair[same], np.full(int((same & again).sum()), 12345, np.uint64)])
    return row, (feature & np.uint64(DIMS - 1)).astype(np.int32), n


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, c: Chunk) -> np.ndarray:
        row, feature, n = features(c)
        return self.bias + np.bincount(row, self.weights[feature], c.n) / np.maximum(n, 1)


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = 150, rate: float = 0.5, l2: float = 1e-6) -> Scorer:
    """Logistic regression on (label, features, values), by Adam."""
    w, bias = np.zeros(DIMS), 0.0
    if not rows:
        return Scorer(w, bias)
    y = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at, val = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(float)
    weight = np.full(len(rows), 1 / len(rows))
    m, v, mb, vb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = bias + np.bincount(row, w[at] * val, len(rows))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g, gb = np.bincount(at, val * err[row], DIMS) + l2 * w, err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        bias -= rate * 0.1 * fix * mb / (np.sqrt(vb) + 1e-8)
    return Scorer(w, bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000) -> DataFrame:
    """The rows of docs with posterior, score and keep; columns of these names are replaced."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    voted = map_text(texts, "text", "p int", lambda c: {"p": pattern(votes(c))}).groupBy("p").agg(F.count(F.lit(1)).alias("n")).toArrow()
    patterns, counts = voted.column("p").to_numpy().astype(np.int64), voted.column("n").to_numpy().astype(float)
    labels = estimate(patterns, counts)

    share = min(1.0, train_rows / max(1.0, counts.sum()))
    # about train_rows by a hash of id and text; rows equal in both are picked together, and count once
    picked = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def load(c: Chunk, part: pa.RecordBatch) -> Iterator[dict]:
        row, feature, n = features(c)
        p = pattern(votes(c))
        key, times = np.unique(row.astype(np.int64) * DIMS + feature, return_counts=True)
        edge = np.searchsorted(key // DIMS, np.arange(c.n + 1))
        yield {"p": p, "f": [(key[a:b] % DIMS).astype(np.int32).tobytes() for a, b in zip(edge, edge[1:])], "v": [(times[a:b] / max(1, n[k])).astype(np.float32).tobytes() for k, (a, b) in enumerate(zip(edge, edge[1:]))]}

    sample = emit_text(picked, "text", "p int, f binary, v binary", load).distinct().toArrow().to_pylist()
    sample.sort(key=lambda r: (r["p"], r["f"], r["v"]))
    good = labels.posterior(np.array([r["p"] for r in sample], np.int64)) if sample else []
    scorer = train([(float(y), np.frombuffer(r["f"], np.int32), np.frombuffer(r["v"], np.float32)) for y, r in zip(good, sample, strict=True)])

    shared = spark.sparkContext.broadcast((labels, scorer))

    def judge(c: Chunk) -> dict:
        labels, scorer = shared.value
        s = scorer.score(c)
        return {"posterior": labels.posterior(pattern(votes(c))), "score": s, "keep": s >= 0}

    return map_text(docs, text_col, "posterior double, score double, keep boolean", judge)
