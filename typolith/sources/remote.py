"""Files from elsewhere: retried downloads, range reads of remote archives, checksums.

Nothing here runs in a query; it fills the folders that queries read.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import os
import tarfile
import time
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

Opener = Callable[[str, dict], io.BufferedIOBase]


def open_url(url: str, headers: dict):
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60)  # noqa: S310


def fetch(url: str, to: str | Path, tries: int = 4, pause: float = 2.0, opener: Opener = open_url) -> Path:
    """Download to a file that appears whole or not at all; each new try waits a step longer."""
    to = Path(to)
    part = to.with_name(to.name + ".part")
    for n in range(1, tries + 1):
        try:
            with opener(url, {}) as got, part.open("wb") as out:
                while block := got.read(1 << 20):
                    out.write(block)
            os.replace(part, to)
            return to
        except OSError:
            part.unlink(missing_ok=True)
            if n == tries:
                raise
            time.sleep(pause * n)
    raise AssertionError("not reached")


class RangeFile(io.RawIOBase):
    """A remote file that seeks: blocks are read by HTTP ranges and kept."""

    def __init__(self, url: str, size: int, block: int = 8 << 20, opener: Opener = open_url):
        self.url, self.size, self.block, self.opener = url, size, block, opener
        self.at, self.kept = 0, {}

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        self.at = to + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def _part(self, k: int) -> bytes:
        if k not in self.kept:
            last = min((k + 1) * self.block, self.size) - 1
            with self.opener(self.url, {"Range": f"bytes={k * self.block}-{last}"}) as got:
                self.kept[k] = got.read()
        return self.kept[k]

    def readinto(self, into) -> int:
        n = max(0, min(len(into), self.size - self.at))
        done = 0
        while done < n:
            k, off = divmod(self.at + done, self.block)
            piece = self._part(k)[off : off + n - done]
            into[done : done + len(piece)] = piece
            done += len(piece)
        self.at += n
        return n


def member_rows(file, member: str, keep: Callable[[dict], bool], sep: str = ";") -> Iterator[dict]:
    """Rows of a delimited member of a ZIP archive that pass a filter, as they stream by."""
    with zipfile.ZipFile(file) as z, z.open(member) as raw:
        for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8"), delimiter=sep):
            if keep(row):
                yield row


def write_rows(rows: Iterable[dict], names: list[str], to: str | Path, sep: str = ";") -> int:
    """Rows as gzip text with a header; how many."""
    n = 0
    with gzip.open(to, "wt", encoding="utf-8", newline="") as out:
        w = csv.DictWriter(out, names, delimiter=sep, extrasaction="ignore")
        w.writeheader()
        for n, row in enumerate(rows, 1):
            w.writerow(row)
    return n


def unpack(archive: str | Path, to: str | Path) -> list[str]:
    """The names in a ZIP or TAR archive, unpacked; members that would leave the folder are refused."""
    to = Path(to)
    to.mkdir(parents=True, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            names = z.namelist()
            if any(not (to / n).resolve().is_relative_to(to.resolve()) for n in names):
                raise ValueError(f"{archive} has a member outside of its folder")
            z.extractall(to)
    else:
        with tarfile.open(archive) as t:
            names = t.getnames()
            t.extractall(to, filter="data")
    return names


def checksums(folder: str | Path) -> dict[str, str]:
    """SHA-256 of every file below a folder."""
    out = {}
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file():
            h = hashlib.sha256()
            with p.open("rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            out[str(p.relative_to(folder))] = h.hexdigest()
    return out
