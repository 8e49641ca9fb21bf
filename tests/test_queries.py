import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAST = ["panel_residual_share", "balanced_entities", "anti_join_fallback", "monthly_features", "trend_slope", "rank_percentile", "cosine_topk", "threshold_graph", "silhouette", "block_matrix_avi_avu_q", "episodes_h2_h3", "confirmed_switches", "transitions_quarter", "monic_events", "adjusted_rand", "seasonality", "grades_threshold", "borda_places", "pattern_dictionary", "type_profiles", "mirkin", "kruskal_wallis", "quantised_shares"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_sql(spark, duck, tmp_path, name):
    entry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TABLE a AS {entry.oracle_sql()[name]}")
    duck.execute(f"CREATE OR REPLACE TABLE b AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    cols = ", ".join(f'"{r[0]}"' for r in sorted(duck.execute("DESCRIBE a").fetchall()))
    assert sorted(r[0] for r in duck.execute("DESCRIBE a").fetchall()) == sorted(r[0] for r in duck.execute("DESCRIBE b").fetchall())
    assert not duck.execute(f"(SELECT {cols} FROM a EXCEPT ALL SELECT {cols} FROM b) UNION ALL (SELECT {cols} FROM b EXCEPT ALL SELECT {cols} FROM a)").fetchall()


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
