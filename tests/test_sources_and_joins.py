"""Readers, writers, keyed joins, segments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalar as C
from barloom.operators import joins as J
from barloom.operators.segments import Segments, segment_integrity
from barloom.session import attach_row, cut_lineage, ensure_checkpoint_dir
from barloom.sources import bars as SRC
from barloom.sources import tables as T
from barloom.streaming.jobs import scratch


def d(day):
    return dt.date(2020, 1, day)


def test_csv_with_foreign_header_is_read_by_position(spark, tmp_path):
    for code, close in (("600000", 10.5), ("000001", 7.25)):
        (tmp_path / f"{code}.SH.csv").write_bytes(f"交易日期,收盘价\n20200102,{close}\n20200103,11\nbad,1\n".encode("gb2312"))
    out = T.read_csv_bars(spark, str(tmp_path), "day string, close double", "day", "2020-01-01", "2020-01-02").orderBy("sym").collect()
    assert [(r["sym"], r["d"], r["close"]) for r in out] == [("000001", d(2), 7.25), ("600000", d(2), 10.5)]


def test_to_day_accepts_both_text_forms_and_nulls_bad_text(spark):
    df = spark.createDataFrame([("20200103",), ("2020-01-04",), ("x",), (None,)], "t string")
    assert [r["x"] for r in df.select(C.to_day("t").alias("x")).collect()] == [d(3), d(4), None, None]


def test_cleaning_drops_missing_close_and_keeps_the_first(spark):
    rows = [("a", d(1), 5.0, 2), ("a", d(1), 4.0, 1), ("a", d(2), None, 1), ("a", d(3), float("nan"), 1)]
    out = SRC.clean_bars(spark.createDataFrame(rows, "sym string, d date, close double, k int"), keep_first=["k"]).collect()
    assert [(r["d"], r["close"]) for r in out] == [(d(1), 4.0)]


def test_normalised_columns(spark):
    raw = spark.createDataFrame([("20200101", 1.0, 2.0)], "trade_date string, volume double, close double")
    out = SRC.normalise_columns(raw, {"d": ["d", "trade_date"], "vol": ["vol", "volume"], "close": ["close"], "pct": ["pct_chg"]}, "d").first()
    assert (out["d"], out["vol"], out["close"], out["pct"]) == (d(1), 1.0, 2.0, None)


def test_adjustment_ignores_a_missing_change(spark, series):
    bars = series({"a": [10, 11, 11]}, "close").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    out = SRC.adjust(bars).orderBy("d").collect()
    assert [r["cf"] for r in out] == pytest.approx([1.0, 1.1, 1.1])
    assert out[0]["pct"] is None and out[1]["pct"] == pytest.approx(10.0)


def test_day_writes_replace_only_their_days(spark):
    path = scratch(spark, "daywrite")
    first = spark.createDataFrame([(d(1), 1), (d(2), 2)], "d date, v int")
    T.write_by_day(first, path)
    T.write_by_day(spark.createDataFrame([(d(2), 20)], "d date, v int"), path)
    T.write_by_day(spark.createDataFrame([(d(2), 20)], "d date, v int"), path)
    assert sorted((r["d"], r["v"]) for r in spark.read.parquet(path).collect()) == [(d(1), 1), (d(2), 20)]


def test_many_to_one_refuses_repeated_keys(spark):
    left = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError, match="not unique"):
        J.join_many_to_one(left, spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"])


def test_intervals_latest_start_wins_and_ends_close(spark):
    iv = [("a", d(1), d(20), "x"), ("a", d(5), d(8), "y"), ("b", d(3), None, "z")]
    intervals = spark.createDataFrame(iv, "sym string, start date, end date, v string")
    panel = spark.createDataFrame([("a", d(k)) for k in (1, 5, 8, 9)] + [("b", d(2)), ("b", d(30))], "sym string, d date")
    out = J.interval_value(panel, intervals, ["sym"], "d", "v", "got", F.lit("none")).orderBy("sym", "d").collect()
    assert [r["got"] for r in out] == ["x", "y", "y", "none", "none", "z"]


def test_as_of_strict_excludes_the_same_day(spark):
    left = spark.createDataFrame([("a", d(3))], "sym string, d date")
    right = spark.createDataFrame([("a", d(1), 1.0), ("a", d(3), 3.0)], "sym string, d date, v double")
    assert J.as_of(left, right, ["sym"], "d", ["v"]).first()["v"] == 3.0
    assert J.as_of(left, right, ["sym"], "d", ["v"], strict=True).first()["v"] == 1.0


def test_neighbour_day_is_a_calendar_day_not_a_row(spark):
    panel = spark.createDataFrame([("a", d(1), 1.0), ("a", d(3), 3.0), ("b", d(2), 9.0)], "sym string, d date, v double")
    out = J.neighbour_day(panel, SRC.calendar(panel), ["v"], -1, "p_").orderBy("sym", "d").collect()
    assert [r["p_v"] for r in out] == [None, None, None]


def test_nearest_prefers_the_earlier_of_two(spark):
    ev = spark.createDataFrame([("a", 1, 10), ("a", 2, 3), ("b", 3, 5)], "sym string, id int, pos int")
    low = spark.createDataFrame([("a", 8), ("a", 12)], "sym string, low_pos int")
    out = {r["id"]: (r["low_pos"], r["gap"]) for r in J.nearest_by_position(ev, low, "sym", "id", "pos", "low_pos").collect()}
    assert out == {1: (8, 2), 2: (8, -5), 3: (None, None)}


def test_band_matches_equal_the_plain_condition(spark):
    a = spark.range(40).select(F.lit("s").alias("sym"), (F.col("id") * 3).alias("p"), F.col("id").alias("ia"))
    b = spark.range(40).select(F.lit("s").alias("sym"), (F.col("id") * 5 % 101).alias("p"), F.col("id").alias("ib"))
    got = J.band_matches(a, b, "sym", "p", 2, "ia", "ib").select("ia", "ib").collect()
    want = [(x["ia"], y["ib"]) for x in a.collect() for y in b.collect() if abs(x["p"] - y["p"]) <= 2]
    assert sorted(map(tuple, got)) == sorted(want)


def test_merged_sources_must_agree(spark):
    spine = spark.createDataFrame([("a", 1)], "sym string, d int")
    one = spark.createDataFrame([("a", 1, 2.0)], "sym string, d int, x double")
    same = spark.createDataFrame([("a", 1, 2.0 + 1e-12, 5.0)], "sym string, d int, x double, y double")
    assert J.merge_sources(spine, {"one": one, "same": same}, ["sym", "d"]).first().asDict() == {"sym": "a", "d": 1, "x": 2.0, "y": 5.0}
    with pytest.raises(ValueError, match="disagree"):
        J.merge_sources(spine, {"one": one, "other": one.withColumn("x", F.lit(3.0))}, ["sym", "d"])
    with pytest.raises(ValueError, match="disagree"):
        J.merge_sources(spine, {"one": one, "other": one.withColumn("x", F.lit(None).cast("double"))}, ["sym", "d"])


def test_symmetric_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted((r["x"], r["only_in"]) for r in J.symmetric_difference(a, b, ["x"]).collect()) == [(1, "a"), (3, "b")]


def test_segments_and_their_integrity(spark):
    rule = Segments.of(embargo=("2020-01-10", "2020-01-12"), train=(None, "2020-01-15"), test=("2020-01-16", None))
    days = spark.createDataFrame([(d(k),) for k in range(1, 21)], "d date")
    tagged = days.withColumn("seg", rule.column("d"))
    row = segment_integrity(tagged, SRC.calendar(days), rule, (("train", "test"),), 1).first()
    assert (row["wrong_segment"], row["in_embargo"], row["gap_train_test"], row["gaps_ok"]) == (0, 3, 0, False)
    wrong = tagged.withColumn("seg", F.when(F.col("d") == F.lit(d(1)), "test").otherwise(F.col("seg")))
    assert segment_integrity(wrong, SRC.calendar(days), rule, (("train", "test"),), 1).first()["wrong_segment"] == 1


def test_attach_row_and_lineage_cut(spark):
    df = spark.range(5)
    out = attach_row(df, df.agg(F.max("id").alias("top"), F.count("*").alias("n"))).orderBy("id").collect()
    assert [(r["id"], r["top"], r["n"]) for r in out][-1] == (4, 4, 5)
    assert ensure_checkpoint_dir(spark) and cut_lineage(df).count() == 5
