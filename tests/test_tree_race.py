"""Models grown together equal fits of their own, and their passes follow depth and rounds only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cross_section as X
from barloom.operators import model as K
from barloom.operators import stats as G
from barloom.operators import tree_race as T
from barloom.plans import models as M

GRID = (K.TreeParams(max_rounds=3, depth=1, step=0.3), K.TreeParams(max_rounds=2, depth=3, step=0.1))


@pytest.fixture(scope="module")
def panel(spark):
    """Codes 0..32 with missing values, two labels (one with unknown rows), 60 days of train and 20 of val."""
    i = F.col("id")
    code = lambda seed: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(33)).cast("double")
    df = spark.range(3200).select(i.alias("sym"), F.date_add(F.lit("2020-01-01"), (i % 80).cast("int")).alias("d"), code(1).alias("a"), F.when(i % 5 > 0, code(2)).alias("b"), F.when(i % 11 > 0, F.floor(code(3) / 8)).alias("c"))
    noise = F.pmod(F.xxhash64(F.lit(9), "sym"), F.lit(30))
    signal = F.col("a") + F.coalesce(F.col("b"), F.lit(25)) * F.when(F.col("a") > 12, 1).otherwise(-1) + noise
    df = df.withColumns({"up": (signal > 30).cast("double"), "far": F.when(F.col("sym") % 7 > 0, (signal + 5 * F.col("c") > 45).cast("double"))})
    df = df.withColumn("seg", F.when(F.col("d") < F.lit("2020-03-01").cast("date"), "train").otherwise("val")).localCheckpoint()
    return df.where("seg = 'train'"), df.where("seg = 'val'")


def test_race_on_codes_equals_single_fits(panel):
    args = (*panel, ("a", "b", "c"), ("up", "far"), GRID, 3, ["sym"])
    key = ["candidate", "config_id", "seg"]
    want, got = (df.toPandas().sort_values(key).reset_index(drop=True) for df in (K.race(*args), T.race_on_codes(*args)))
    assert list(got.columns) == list(want.columns) and len(got) == 8
    assert (got[key] == want[key]).all().all() and want["ap"].nunique() > 4
    for name in want.columns.drop(key):
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-3 if name.startswith("calib") else 1e-9, err_msg=name)


def test_codes_out_of_range_are_refused(panel):
    train, val = panel
    with pytest.raises(ValueError, match="codes"):
        T.race_on_codes(train, val.withColumn("a", F.col("a") + 0.5), ("a", "b"), ("up",), GRID[:1], 2, ["sym"])


def test_label_race_grid_makes_no_fit_of_its_own(spark, monkeypatch):
    passes, cells = [], T.CodeTable.cells

    def counted(self, add, size):
        passes.append(size)
        return cells(self, add, size)

    def no_fit(*_):
        raise AssertionError("a fit per candidate and fold")

    monkeypatch.setattr(K, "fit_trees", no_fit)
    monkeypatch.setattr(T.CodeTable, "cells", counted)
    assert M.label_race_grid(spark, "/root/testdata/sf0.001").count() == 12
    # Counts of codes, two rounds of three levels, validation errors: whatever the number of labels, settings and folds.
    assert len(passes) == 1 + 2 * 3 + 1


def test_rounds_stop_like_the_library():
    assert T.stopped([1.0, 0.9, 0.8]) == 3
    assert T.stopped([1.0, 0.9, 0.8999, 0.1]) == 2
    assert T.stopped([1.0, 1.1]) == 1 and T.stopped([float("nan"), 0.5]) == 1


def test_split_points_of_many_values_share_the_rows():
    counts = np.full(64, 10)
    assert T.thresholds(np.arange(20.0), np.full(20, 2)).tolist() == [i + 0.5 for i in range(19)]
    assert T.thresholds(np.arange(64.0), counts).tolist() == [2 * i + 1.5 for i in range(31)]


def test_average_precision_is_the_same_in_both_forms(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(300).select(F.when(i % 4 > 0, i % 2).alias("g"), (F.when(i % 9 > 0, i * 37 % 50) / 7.0).alias("s"), F.when(i % 13 > 0, (i * 31 % 3 == 0).cast("double")).alias("y"))
    small = {r["g"]: r["ap"] for r in G.average_precision(df, "s", "y", ["g"]).collect()}
    monkeypatch.setattr(X, "WINDOW_GROUP_ROWS", -1)
    big = {r["g"]: r["ap"] for r in G.average_precision(df, "s", "y", ["g"]).collect()}
    assert len(small) == 3 and small == pytest.approx(big)


def test_calibration_of_rows_and_of_counted_pairs_agree(spark):
    i = F.col("id")
    df = spark.range(500).select((i % 10 / 10.0).alias("p"), (i * 7 % 10 < i % 10).cast("double").alias("y"))
    a = K.SquaredLogit.fit(df, "p", "y")
    b = K.SquaredLogit.fit(df.groupBy("p", "y").count(), "p", "y", weight="count")
    assert (*a.coef, a.intercept) == pytest.approx((*b.coef, b.intercept), rel=1e-6)
