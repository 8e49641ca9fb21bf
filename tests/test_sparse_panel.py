"""Queries over panels in which some cells are missing, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

#: (supplier, type, price) of the lines of one year: all types, one missing, two missing in either way, one type alone, none of the five.
LINES = [(1, "ECONOMY", 5), (1, "LARGE", 4), (1, "MEDIUM", 4), (1, "PROMO", 2), (1, "SMALL", 1), (1, "STANDARD", 7),
         (2, "ECONOMY", 5), (2, "LARGE", 4), (2, "MEDIUM", 3), (2, "PROMO", 2), (2, "STANDARD", 1),
         (3, "LARGE", 4), (3, "MEDIUM", 4), (3, "SMALL", 9),
         (4, "ECONOMY", 4), (4, "LARGE", 3), (4, "MEDIUM", 2),
         (5, "PROMO", 4), (5, "STANDARD", 4), (6, "STANDARD", 3)]


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """A folder of tables, and a connection that reads them."""
    at, c = tmp_path_factory.mktemp("sparse"), duckdb.connect()
    kinds = sorted({t for _, t, _ in LINES})
    part = ", ".join(f"({k}, '{t}')" for k, t in enumerate(kinds))
    line = ", ".join(f"({kinds.index(t)}, {s}, TIMESTAMP '1998-05-0{k % 9 + 1}', {p}.5::DOUBLE)" for k, (s, t, p) in enumerate(LINES))
    c.execute(f"CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, t AS p_type FROM (VALUES {part}) v(k, t)")
    c.execute(f"CREATE TABLE lineitem AS SELECT p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, d AS l_shipdate, x AS l_extendedprice FROM (VALUES {line}) v(p, s, d, x)")
    for t in ("part", "lineitem"):
        c.execute(f"COPY {t} TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at), c


@pytest.mark.parametrize("name", ["panel_residual_share", "pattern_text", "pattern_dictionary"])
def test_missing_cells_as_in_sql(spark, sparse, tmp_path, name):
    sf, c = sparse
    got = entry.queries()[name](spark, sf)
    got.write.parquet(str(tmp_path / "out"))
    cols = ", ".join(f'"{x}"' for x in sorted(got.columns))
    want = c.execute(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()
    have = c.execute(f"SELECT {cols} FROM '{tmp_path}/out/*.parquet'").fetchall()
    assert sorted(map(repr, have)) == sorted(map(repr, want))
