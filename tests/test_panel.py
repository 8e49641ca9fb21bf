from pyspark.sql import functions as F

from typolith.operators import features, panel
from typolith.sources import tables


def test_interval_upper_bound_is_exclusive(spark):
    d = spark.createDataFrame([(1, "A", 2000, 2005), (2, "A", 2005, 2010)], "entity long, code string, year_from long, year_to long")
    f = spark.createDataFrame([(1, "A", 2004), (2, "A", 2005), (3, "A", 2010)], "fact long, code string, year long")
    assert {(r.fact, r.entity) for r in panel.interval_join(f, d).collect()} == {(1, 1), (2, 2)}


def test_fallback_takes_only_codes_of_one_entity(spark):
    d = spark.createDataFrame([(1, "A", 2000, 2001), (2, "B", 2000, 2001), (3, "B", 2001, 2002)], "entity long, code string, year_from long, year_to long")
    f = spark.createDataFrame([(1, "A", 2000), (2, "A", 2005), (3, "B", 2005)], "fact long, code string, year long")
    got = {(r.fact, r.entity, r.match) for r in panel.match_versions(f, d, ["fact"]).collect()}
    assert got == {(1, 1, "year"), (2, 1, "any_version")}


def test_priority_dedup_and_lenient_numbers(spark):
    df = spark.createDataFrame([("k", "b", 1, "2"), ("k", "a", 1, "x"), ("k", "a", 0, None)], "k string, t string, p int, s string")
    r = panel.priority_dedup(df, ["k"], F.col("p"), ["t"]).first()
    assert (r.t, r.p) == ("a", 0)
    assert [x.v for x in df.select(panel.lenient_number(F.col("s")).alias("v")).collect()] == [2.0, None, None]


def test_shares_residual_and_violations(spark):
    wide = spark.createDataFrame([(1, 1, 10.0, 4.0, None), (1, 2, 0.0, 0.0, 0.0)], "entity long, period int, total double, a double, b double")
    long = panel.unpivot(panel.with_residual(wide, "total", ["a", "b"]), ["a", "b", "other", "total"])
    got = {(r.period, r.category): r.share for r in panel.shares(long, "total").collect()}
    assert got[1, "other"] == 0.6 and got[1, "b"] is None and got[2, "a"] is None
    d = spark.createDataFrame([(2,)], "entity long")
    rules = {r.rule for r in panel.violations(long, "total", ["a", "b", "other"], d).collect()}
    assert rules == {"not positive", "unknown entity"}


def test_zscore_of_constant_is_zero_and_clips(spark):
    df = spark.createDataFrame([(i, 1.0, float(i == 0) * 100) for i in range(30)], "entity long, c double, x double")
    got = features.standardise_all(df, ["c", "x"], 4.0).collect()
    assert all(r.c == 0 for r in got) and max(r.x for r in got) == 4.0


def test_table_ranks_match_average_ranks(spark):
    values = [5, 1, 1, 3, None, 3, 3, 9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    got = {r.i: r.p for r in features.rank_percentile(df, "v", "p").collect()}
    want = [6, 1.5, 1.5, 4, None, 4, 4, 7]
    assert got == {i: (None if w is None else w / 7) for i, w in enumerate(want)}


def test_fill_uses_the_samples_least(spark):
    ids = spark.createDataFrame([(1,), (2,)], "entity long")
    attr = spark.createDataFrame([(1, 5.0), (3, 1.0)], "entity long, a double")
    assert {r.entity: r.a for r in features.fill_from_sample(ids, attr, "a").collect()} == {1: 5.0, 2: 5.0}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("01", "2021", 1.5), ("02", "2022", None)], "code string, year string, v double")
    tables.write_delimited(df, str(tmp_path / "c"), ";")
    back = tables.delimited(spark, str(tmp_path / "c"), tables.all_strings(df.columns))
    assert [tuple(r) for r in back.orderBy("code").collect()] == [("01", "2021", "1.5"), ("02", "2022", None)]
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.parquet(spark, str(tmp_path / "p"), ["code"]).columns == ["code"]
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [r.line for r in tables.markdown(df, {"v": "%.2f"}).collect()] == ["| 01 | 2021 | 1.50 |", "| 02 | 2022 | — |"]
    assert len(tables.checksums(df, ["code", "v"]).select("sha256").distinct().collect()) == 2
    assert tables.nested(df, "year", ["code"], "code").count() == 2


def test_stream_fills_panel_cells(spark, tmp_path):
    from typolith.streaming.panel import panel_cells, read_events

    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1, "a", 2.0), ("2024-01-02 00:00:00", 1, "a", 3.0), ("2024-02-01 00:00:00", 2, "b", 1.0)], "t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    q = panel_cells(read_events(spark, str(tmp_path / "in"), rows.schema, 10)).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.entity, r.category): r.value for r in spark.sql("select * from cells").collect()} == {(1, "a"): 5.0, (2, "b"): 1.0}


def test_quantiles_are_exact(spark):
    import numpy as np

    from typolith.functions.columns import exact_quantile

    rng = np.random.default_rng(1)
    for x in (rng.normal(size=5000), rng.integers(0, 7, 4001).astype(float), np.array([2.5]), np.repeat(3.0, 100)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        for q in (0.0, 0.01, 0.5, 0.989, 1.0):
            assert abs(exact_quantile(df, "v", q) - np.quantile(x, q)) < 1e-12
    assert exact_quantile(df.where("v is null"), "v", 0.5) is None


def test_residual_of_a_missing_part_can_be_unknown(spark):
    wide = spark.createDataFrame([(10.0, 4.0, None), (10.0, 4.0, 1.0)], "total double, a double, b double")
    assert [r.other for r in panel.with_residual(wide, "total", ["a", "b"], missing=None).collect()] == [None, 5.0]
