"""Window primitives on small literal series."""

import math

import pytest
from helpers import column
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.rolling import frac_weights


def test_strict_window_needs_every_row_known(series):
    df = series({"a": [1, 2, None, 4, 5, 6], "b": [10, 20]})
    got = column(df.withColumn("m", B.agg("mean", "x", 3)), "m")
    assert got == [None, None, None, None, None, 5.0, None, None]


def test_minimum_periods_and_symbol_isolation(series):
    df = series({"a": [1, 2, 3], "b": [100, 200, 300]})
    got = column(df.withColumn("s", B.agg("sum", "x", 3, 2)), "s")
    assert got == [None, 3.0, 6.0, None, 300.0, 600.0]


def test_rank_counts_ties_half_and_includes_itself(series):
    df = series({"a": [1, 2, 2, 3]})
    assert column(df.withColumn("r", B.ts_rank("x", 3)), "r") == [None, None, (1 + 1.0) / 3, (2 + 0.5) / 3]


def test_known_rank_skips_missing_and_gates(series):
    df = series({"a": [1, None, 3, 2]})
    assert column(df.withColumn("r", B.ts_rank_known("x", 4, 2)), "r") == [None, None, 1.5 / 2, 1.5 / 3]


def test_extreme_ties_take_the_oldest(series):
    df = series({"a": [5, 7, 7, 1, 1]})
    assert column(df.withColumn("k", B.since_extreme("x", 3, "max")), "k") == [None, None, 1.0, 2.0, 2.0]
    assert column(df.withColumn("k", B.since_extreme("x", 3, "min")), "k") == [None, None, 2.0, 0.0, 1.0]


def test_streaks_with_and_without_missing(series):
    df = series({"a": [1, 1, 0, 1, None, 1]})
    assert column(df.withColumn("k", B.streak(F.col("x") == 1)), "k") == [1, 2, 0, 1, 0, 1]
    assert column(df.withColumn("k", B.streak_known("x")), "k") == [1, 2, 0, 1, None, 1]


def test_constant_window_gives_no_correlation_and_no_r2(series):
    df = series({"a": [3, 3, 3, 3]}).withColumn("y", F.col("pos") * 1.0)
    out = df.withColumns({"c": B.corr("x", "y", 3), "r2": B.rsquare("x", 3), "s": B.slope("x", 3)}).orderBy("d").collect()
    assert [r["c"] for r in out] == [None] * 4
    assert [r["r2"] for r in out] == [None] * 4
    assert [r["s"] for r in out] == [None, None, 0.0, 0.0]


def test_decay_mean_and_slope(series):
    df = series({"a": [1, 2, 4]})
    row = df.withColumns({"w": B.decay_mean("x", 3), "s": B.slope("x", 3)}).orderBy("d").collect()[-1]
    assert row["w"] == pytest.approx((1 + 4 + 12) / 6)
    assert row["s"] == pytest.approx(1.5)


def test_fractional_weights():
    w = frac_weights(0.5, 0.05)
    assert w[:3] == [1.0, -0.5, -0.125]
    assert w[3] == pytest.approx(-0.0625) and len(w) == 4


def test_forward_window_is_null_when_not_complete(series):
    df = series({"a": [1, 5, 2, 4]})
    assert column(df.withColumn("f", B.forward("max", "x", 1, 2)), "f") == [5.0, 4.0, None, None]


def test_unbiased_moments_match_pandas(series):
    import pandas as pd

    vals = [math.sin(i) * i for i in range(12)]
    df = series({"a": vals}).withColumns({"s": B.skew_unbiased("x", 8), "k": B.kurt_unbiased("x", 8)}).orderBy("d").collect()
    s = pd.Series(vals)
    for i in range(7, 12):
        assert df[i]["s"] == pytest.approx(s[i - 7 : i + 1].skew())
        assert df[i]["k"] == pytest.approx(s[i - 7 : i + 1].kurt())
