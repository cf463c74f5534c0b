"""Recursions and events against plain loops, and against themselves on cut series."""

import numpy as np
import pytest
from helpers import random_bars
from pyspark.sql import functions as F

from barloom.operators import events as E
from barloom.operators import sequential as Q
from barloom.sources.bars import adjust


@pytest.fixture(scope="module")
def panel(spark):
    return Q.add_recursions(adjust(random_bars(spark, 3, 260, seed=5)), [Q.macd("close")]).cache()


def closes(panel):
    pdf = panel.orderBy("sym", "d").toPandas()
    return {s: g["close"].to_numpy() for s, g in pdf.groupby("sym")}


def loop_macd(c):
    """Row by row from the seed rules."""
    n = len(c)
    fast, slow, dif, dea = (np.full(n, np.nan) for _ in range(4))
    fast[25], slow[25] = c[14:26].mean(), c[:26].mean()
    for i in range(26, n):
        fast[i] = fast[i - 1] + 2 / 13 * (c[i] - fast[i - 1])
        slow[i] = slow[i - 1] + 2 / 27 * (c[i] - slow[i - 1])
    dif = fast - slow
    dea[33] = dif[25:34].mean()
    for i in range(34, n):
        dea[i] = dea[i - 1] + 0.2 * (dif[i] - dea[i - 1])
    dif[:33] = np.nan
    return dif, dea


def test_macd_follows_the_seed_rules(panel):
    pdf = panel.orderBy("sym", "d").toPandas()
    for s, c in closes(panel).items():
        dif, dea = loop_macd(c)
        got = pdf[pdf["sym"] == s]
        np.testing.assert_allclose(got["dif"].astype(float), dif, rtol=1e-9)
        np.testing.assert_allclose(got["dea"].astype(float), dea, rtol=1e-9)


def test_rsi_is_zero_without_moves_and_hundred_without_losses(spark, series):
    df = series({"flat": [5.0] * 20, "up": list(range(1, 21))})
    out = Q.add_recursions(df, [Q.rsi("x", 14, "rsi")]).orderBy("sym", "d").toPandas()
    flat, up = out[out["sym"] == "flat"]["rsi"], out[out["sym"] == "up"]["rsi"]
    assert flat.isna().sum() == 14 and set(flat.dropna()) == {0.0}
    assert set(up.dropna()) == {100.0}


def test_short_series_give_nulls(spark, series):
    out = Q.add_recursions(series({"a": [1, 2, 3]}, "close"), [Q.macd("close"), Q.rsi("close", 14, "r"), Q.ema("close", 2, "e")]).orderBy("d").toPandas()
    assert out["dif"].isna().all() and out["r"].isna().all()
    assert out["e"].tolist()[1:] == pytest.approx([1 + 2 / 3, 1 + 2 / 3 + 2 / 3 * (3 - 1 - 2 / 3)])


def brute_fractals(c, k):
    return [(i + 1, i + 1 + k) for i in range(k, len(c) - k) if all(c[i] < c[j] for j in range(i - k, i + k + 1) if j != i)]


def test_fractal_lows_equal_brute_force(panel):
    got = E.fractal_lows(panel, "close", 4).toPandas()
    for s, c in closes(panel).items():
        rows = sorted(got[got["sym"] == s][["low_pos", "sig_pos"]].itertuples(index=False, name=None))
        assert rows == brute_fractals(c, 4)


def test_min_separation_is_greedy(spark):
    lows = spark.createDataFrame([("a", p, p + 3) for p in (1, 4, 6, 7, 12, 14)], "sym string, low_pos long, sig_pos long")
    assert sorted(r["low_pos"] for r in E.min_separation(lows, 5).collect()) == [1, 6, 12]


def test_zigzag_on_a_known_path(spark, series):
    df = series({"a": [100, 95, 90, 96, 99, 92, 88, 93]}, "close")
    got = sorted((r["low_pos"], r["sig_pos"]) for r in Q.zigzag_lows(df, "close", 0.05).collect())
    assert got == [(3, 4), (7, 8)]


def test_v_lows_need_both_sides(spark, series):
    df = series({"a": [5, 4, 3, 2, 3, 4, 1]}, "close")
    assert [(r["low_pos"], r["sig_pos"]) for r in E.v_shape_lows(df).collect()] == [(4, 6)]


def test_grid_lows_take_the_earliest_tie(spark, series):
    df = series({"a": [3, 1, 1, 2, 5, 4, 9]}, "close")
    got = sorted((r["low_pos"], r["avail_pos"]) for r in E.grid_lows(df).collect())
    assert got == [(2, 6), (4, 9), (7, 12)]


def test_events_do_not_change_when_the_future_is_cut(spark):
    """Every detector: events signalled by row 180 are the same on the full and on the cut series."""
    bars = random_bars(spark, 3, 240, seed=11)
    cut = bars.where(F.col("d") < F.lit("2019-01-01").cast("date") + F.expr("interval 180 days"))

    def known(b):
        p = E.cross_flags(Q.add_recursions(adjust(b), [Q.macd("close")])).withColumn("pos", F.col("pos").cast("long"))
        detectors = {
            "fractal": E.divergences(p, E.fractal_lows(p, "close", 3), E.DivergenceRule()).select("sym", "sig_pos", "low_pos"),
            "zigzag": Q.zigzag_lows(p, "close", 0.03).select("sym", "sig_pos", "low_pos"),
            "v": E.v_shape_lows(p).select("sym", "sig_pos", "low_pos"),
            "cross": E.cross_divergence_simple(p).select("sym", "sig_pos", F.col("anchor_pos").alias("low_pos")),
            "grid": E.grid_divergences_causal(p).select("sym", "sig_pos", F.col("prev_pos").alias("low_pos")),
            "early": E.early_events(p).where("flavor = 'b1'").select("sym", "sig_pos", F.col("anchor_pos").alias("low_pos")),
        }
        out = None
        for name, df in detectors.items():
            one = df.where("sig_pos <= 178").select(F.lit(name).alias("kind"), *[F.col(c).cast("string").alias(c) for c in df.columns])
            out = one if out is None else out.unionByName(one)
        return sorted(map(tuple, out.collect()))

    full = known(bars)
    assert full == known(cut)
    assert {k for k, *_ in full} >= {"fractal", "zigzag", "v", "cross"}


def test_triple_divergence_needs_two_pairs(spark):
    lows = spark.createDataFrame([("a", p, p + 1) for p in (40, 50, 60)], "sym string, low_pos long, sig_pos long")
    rows = [("a", 40, 10.0, -3.0, 1.0), ("a", 50, 9.0, -2.0, 1.0), ("a", 60, 8.0, -1.0, 1.0)]
    bars = spark.createDataFrame(rows, "sym string, pos long, close double, dif double, vol double")
    hit = E.divergences(bars, lows, E.DivergenceRule(triple=True)).collect()
    assert [(r["sig_pos"], r["low_pos"], r["prev_pos"]) for r in hit] == [(61, 60, 50)]
    assert E.divergences(bars, lows, E.DivergenceRule(volume_ratio=0.9)).count() == 0
    assert E.divergences(bars, lows, E.DivergenceRule(min_decline=0.15)).collect()[0]["rank"] == 2
