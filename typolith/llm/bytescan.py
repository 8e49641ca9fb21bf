"""Vectorised scanning of text batches as UTF-8 bytes.

Every operator that walks whole texts (words, shingles, lines, byte windows)
works on one flat byte buffer per chunk of rows, so a row costs no Python
object.  White space is ASCII only: a word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _pw(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        out = []
        for base in (_BASE, _INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        if n > 4 * CHUNK_BYTES:  # one very long text: don't keep its tables
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Chunk:
    """Some rows of a batch: ``rows`` are their indexes, row k spans ``buf[offs[k]:offs[k+1]]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, rows: np.ndarray):
        self.buf, self.offs, self.rows = buf, offs, rows
        self._sums: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.rows)

    def text(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()

    def sums(self) -> np.ndarray:
        """Prefix sums of a polynomial over the bytes, modulo 2**64."""
        if self._sums is None:
            s = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _pw(len(self.buf) + 1)[0][: len(self.buf)], out=s[1:])
            self._sums = s
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
        s = self.sums()
        return mix((s[end] - s[start]) * _pw(len(self.buf) + 1)[1][start] + np.uint64(salt))

    def per_row(self, at: np.ndarray) -> np.ndarray:
        """The row of each ascending byte offset."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.offs)))

    def spans(self, sep: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of the maximal runs of bytes not marked in sep, within rows."""
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        first = np.zeros(n + 1, bool)
        first[self.offs] = True
        keep = ~sep
        before = first[:n].copy()
        before[1:] |= sep[:-1]
        after = first[1:].copy()
        after[:-1] |= sep[1:]
        start = np.flatnonzero(keep & before)
        return start, np.flatnonzero(keep & after) + 1, self.per_row(start)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(IS_SPACE[self.buf])

    def lowered(self) -> Chunk:
        """The same rows with A-Z lower-cased."""
        return Chunk(LOWER[self.buf], self.offs, self.rows)


def chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A text column, cut into chunks of rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(pc.cast(col, pa.large_binary()), b"")
    _, offsets, data = col.buffers()
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield Chunk(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], np.arange(lo, hi))
        lo = hi


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, and the index of their first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for j in range(1, n):
        g *= _GRAM
        g += h[j : j + m]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(g[at]), at


def counts_per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(row, weights=weights, minlength=n)
    return out if weights is not None and weights.dtype.kind == "f" else out.astype(np.int64)
