"""Statistics against numpy, model discipline, streams over several batches."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import random_bars
from pyspark.sql import functions as F

from barloom.operators import model as K
from barloom.operators import sequential as Q
from barloom.operators import stats as G
from barloom.sources.bars import adjust
from barloom.streaming import jobs as ST


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(1)
    start = dt.date(2020, 1, 1)
    rows = []
    for day in range(60):
        for s in range(12):
            p = float(np.round(rng.uniform(), 2))
            x = float(rng.normal())
            y = float(rng.uniform() < 0.2 + 0.6 * p)
            rows.append((f"s{s}", start + dt.timedelta(days=day), p, x, y, f"e{day}_{s}", "train" if day < 40 else "val"))
    return spark.createDataFrame(rows, "sym string, d date, p double, x double, y double, event_id string, seg string").cache()


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.8, 1.0), (0.1, 0.0), (0.05, 1.0)], "s double, y double")
    # steps: .9 -> 1/1; .8 -> 2/3; .05 -> 3/5, each adding a third of the recall
    assert G.average_precision(df, "s", "y").first()["ap"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_precision_at_k_breaks_ties_by_key(spark):
    rows = [("b", dt.date(2020, 1, 1), 0.5, 1.0, "1"), ("a", dt.date(2020, 1, 1), 0.5, 0.0, "2"), ("a", dt.date(2020, 1, 2), 0.1, 1.0, "3")]
    df = spark.createDataFrame(rows, "sym string, d date, p double, y double, event_id string")
    r = G.precision_at_k(df, "p", "y", 1).first()
    assert (r["precision_day"], r["precision_event"], r["days"]) == (0.5, 0.5, 2)


def test_cluster_t_equals_the_residual_formula(scores):
    pdf = scores.toPandas()
    x = pdf["x"].to_numpy()
    res = pdf.assign(r=x - x.mean()).groupby("d")["r"].sum().to_numpy()
    g, n = len(res), len(x)
    want = x.mean() / np.sqrt(g / (g - 1) * (res**2).sum() / n**2)
    assert G.cluster_t(scores, "x", "d").first()["t"] == pytest.approx(want)


def test_normal_tail_is_close():
    from math import erfc, sqrt

    # The column formula evaluated in Python with the same coefficients.
    for z in (0.0, 0.5, 1.96, 3.0):
        t = 1 / (1 + 0.2316419 * z)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        assert 0.3989422804014327 * np.exp(-z * z / 2) * poly == pytest.approx(erfc(z / sqrt(2)) / 2, abs=1e-7)


def test_pair_sums_ignore_incomplete_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    x[:, 2] += x[:, 0]
    rows = [tuple(None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    got = {(r["a"], r["b"]): r["corr"] for r in G.pairwise_corr(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    want = pd.DataFrame(rows, columns=list("abc")).astype(float).corr()
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b])


def test_column_dedup_clusters_and_components(spark):
    corr = spark.createDataFrame([("a", "b", 0.9999), ("b", "c", 0.93), ("a", "d", 0.2), ("d", "e", -0.95)], "a string, b string, corr double")
    assert G.drop_duplicated_columns(corr, ["a", "b", "c", "d"]) == (["a", "c", "d"], {"b": "a"})
    assert G.representative_clusters(corr, ["b", "a", "c", "e", "d"]) == {"b": "b", "a": "b", "c": "b", "e": "e", "d": "e"}
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    parts = {r["node"]: r["component"] for r in G.linked_components(corr.where("abs(corr) > 0.85"), nodes).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_elbow_prefers_the_bend_and_the_smaller_k():
    assert G.elbow([(5, 0.1), (10, 0.5), (20, 0.55), (40, 0.6)]) == 10
    assert G.elbow([(4, 0.0), (8, 1.0), (16, 2.0)]) == 4


def test_yearly_signs(spark):
    rows = [(y, float(i), float(i if y != 2021 else -i), float(i)) for y in (2020, 2021) for i in range(5)]
    df = spark.createDataFrame(rows, "y int, a double, b double, t double")
    got = {r["name"]: r["consistent"] for r in G.yearly_signs(df, {"a": ("a", "t"), "b": ("b", "t")}, "y").collect()}
    assert got == {"a": True, "b": False}


def test_folds_never_train_on_later_days(scores):
    folded = K.date_folds(scores, 5).groupBy("fold").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_distinct("d").alias("days")).orderBy("fold").collect()
    assert [r["fold"] for r in folded] == [0, 1, 2, 3, 4, 5]
    assert all(a["hi"] < b["lo"] for a, b in zip(folded, folded[1:]))
    assert [r["days"] for r in folded] == [10] * 6


def test_out_of_fold_is_deterministic_and_aligned(scores):
    train = scores.where("seg = 'train'")
    runs = []
    for _ in range(2):
        oof, best = K.out_of_fold(train, ["p", "x"], "y", 2, K.TreeParams(3, 2))
        runs.append((sorted((r["event_id"], r["oof"]) for r in oof.where("oof is not null").collect()), best))
    assert runs[0] == runs[1]
    assert oof.where("fold = 0 and oof is not null").isEmpty() and oof.count() == train.count()


def test_calibration_is_a_plain_column_and_checks_its_input(scores):
    cal = K.SquaredLogit.fit(scores, "p", "y")
    out = scores.select("p", cal.column("p").alias("q")).toPandas()
    assert out["q"].between(0, 1).all()
    assert out.groupby(out["p"] > 0.5)["q"].mean().is_monotonic_increasing
    with pytest.raises(ValueError, match="finite"):
        K.SquaredLogit.fit(scores.withColumn("p", F.col("p") + 1.0), "p", "y")


# ---------------------------------------------------------------- streams
@pytest.fixture(scope="module")
def daily_files(spark, tmp_path_factory):
    """Bars in three files of consecutive days."""
    bars = random_bars(spark, 3, 120, seed=9).select("sym", "d", "close")
    folder = str(tmp_path_factory.mktemp("bars") / "files")
    for lo, hi in ((0, 30), (30, 75), (75, 120)):
        a, b = (dt.date(2019, 1, 1) + dt.timedelta(days=k) for k in (lo, hi))
        bars.where((F.col("d") >= F.lit(a)) & (F.col("d") < F.lit(b))).repartition(1).write.mode("append").parquet(folder)
    return bars, folder


def test_streaming_macd_equals_batch(spark, daily_files):
    bars, folder = daily_files
    got = ST.run_available(ST.streaming_macd(ST.parquet_stream(spark, folder, "*.parquet", bars.schema, 1)), "t-macd")
    want = Q.add_recursions(bars, [Q.macd("close")])
    a, b = (df.select("sym", "d", "dif", "dea").orderBy("sym", "d").toPandas() for df in (got, want))
    np.testing.assert_allclose(a["dif"].astype(float), b["dif"].astype(float), rtol=1e-9)
    np.testing.assert_allclose(a["dea"].astype(float), b["dea"].astype(float), rtol=1e-9)


def test_streaming_zigzag_equals_batch(spark, daily_files):
    bars, folder = daily_files
    got = ST.run_available(ST.streaming_zigzag(ST.parquet_stream(spark, folder, "*.parquet", bars.schema, 1), 0.03), "t-zz")
    want = Q.zigzag_lows(adjust(bars.withColumns({c: F.col("close") for c in ("open", "high", "low")})), "close", 0.03)
    assert sorted((r["sym"], r["low_pos"], r["sig_pos"]) for r in got.collect()) == sorted((r["sym"], r["low_pos"], r["sig_pos"]) for r in want.collect())


@pytest.fixture(scope="module")
def tick_files(spark, tmp_path_factory):
    base = dt.datetime(2024, 1, 1)
    folder = str(tmp_path_factory.mktemp("ticks") / "files")
    batches = [
        [(1, 0, "a", 1.0), (2, 10, "a", 3.0), (3, 65, "a", 2.0)],
        [(4, 200, "a", 5.0), (5, 210, "b", 6.0)],
        [(8, 230, "b", 1.0)],  # late rows are judged by the watermark of the batch before
        [(6, 20, "a", 9.0), (7, 400, "a", 7.0)],  # event 6 is hours late
    ]
    for rows in batches:
        data = [(i, base + dt.timedelta(minutes=m), k, v) for i, m, k, v in rows]
        spark.createDataFrame(data, "event_id long, ts timestamp, user string, value double").repartition(1).write.mode("append").parquet(folder)
    return folder, "event_id long, ts timestamp, user string, value double"


def test_late_ticks_do_not_reopen_an_emitted_bar(spark, tick_files):
    folder, schema = tick_files
    stream = ST.parquet_stream(spark, folder, "*.parquet", schema, 1)
    bars = ST.run_available(ST.tick_bars(stream, "user", F.col("value"), ["event_id"], "1 hour", "30 minutes"), "t-bars")
    first = bars.where("sym = 'a'").orderBy("start").first()
    assert (first["open"], first["high"], first["close"], first["n"]) == (1.0, 3.0, 3.0, 2)


def test_unmatched_events_are_emitted_once_mature(spark, tick_files):
    folder, schema = tick_files
    one = ST.parquet_stream(spark, folder, "*.parquet", schema, 1).where("event_id in (1, 3, 5)").select("user", "ts", "event_id")
    two = ST.parquet_stream(spark, folder, "*.parquet", schema, 1).where("event_id in (2, 4, 7)").select("user", "ts", "value")
    out = ST.run_available(ST.matured_pairs(one, two, "user", "15 minutes", "10 minutes", "leftOuter"), "t-pairs")
    got = sorted((r["event_id"], r["value"]) for r in out.collect())
    assert (1, 3.0) in got and (3, None) in got


def test_neutral_long_short_has_every_day_with_its_phase(spark):
    from barloom.plans import CATALOG
    from barloom.plans.stats import scored

    sf = "/root/testdata/sf0.001"
    every = [r.asDict() for r in CATALOG["neutral_long_short_by_phase"].run(spark, sf).collect()]
    days = sorted(str(r["d"]) for r in scored(spark, sf).where("fwd is not null and prob is not null").select("d").distinct().collect())
    assert sorted(str(r["d"]) for r in every) == days and {r["phase"] for r in every} == {0, 1, 2, 3}
    first = {(str(r["d"]), r["long_short"], r["top_minus_universe"]) for r in every}
    assert first == {(str(r["d"]), r["long_short"], r["top_minus_universe"]) for r in CATALOG["neutral_long_short"].run(spark, sf).collect()}
