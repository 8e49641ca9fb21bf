import io
import zipfile

import pytest

from typolith.sources import remote


def test_fetch_retries_and_leaves_nothing_half(tmp_path):
    tries = []

    def flaky(url, headers):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("gone")
        return io.BytesIO(b"data")

    assert remote.fetch("u", tmp_path / "f", pause=0, opener=flaky).read_bytes() == b"data" and len(tries) == 3

    def broken(url, headers):
        raise OSError("gone")

    with pytest.raises(OSError):
        remote.fetch("u", tmp_path / "g", pause=0, opener=broken)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]


def test_range_reads_of_a_remote_archive(tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("pad", bytes(range(256)) * 4000)
        z.writestr("t.csv", "year;level;v\n2021;a;1\n2020;a;2\n2022;low;3\n2023;b;4\n")
    data, ranges = raw.getvalue(), []

    def opener(url, headers):
        a, b = map(int, headers["Range"].removeprefix("bytes=").split("-"))
        ranges.append((a, b))
        return io.BytesIO(data[a : b + 1])

    file = io.BufferedReader(remote.RangeFile("u", len(data), 512, opener))
    rows = list(remote.member_rows(file, "t.csv", lambda r: r["year"] >= "2021" and r["level"] != "low"))
    assert [r["v"] for r in rows] == ["1", "4"] and sum(b - a + 1 for a, b in ranges) < len(data)
    assert remote.write_rows(rows, ["year", "v"], tmp_path / "t.csv.gz") == 2
    (tmp_path / "a.zip").write_bytes(data)
    assert remote.unpack(tmp_path / "a.zip", tmp_path / "out") == ["pad", "t.csv"]
    assert set(remote.checksums(tmp_path / "out")) == {"pad", "t.csv"}


def test_gzip_text_reads_as_strings(spark, tmp_path):
    from typolith.sources import tables

    remote.write_rows([{"code": "007", "year": "2021", "level": "a"}, {"code": "01", "year": "2019", "level": "low"}], ["code", "year", "level"], tmp_path / "t.csv.gz")
    df = tables.delimited(spark, str(tmp_path / "t.csv.gz"), tables.all_strings(["code", "year", "level"]))
    assert [r.code for r in tables.filtered(df, [2021], "level", "low").collect()] == ["007"]
