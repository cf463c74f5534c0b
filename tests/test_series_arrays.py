"""Windows of whole series as arrays: against plain loops, over cut batches, and without frames or grouped calls in the plan."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import random_bars

from barloom.features import factory as FX
from barloom.functions.series_arrays import whole_series, window_values
from barloom.sources.bars import adjust


def test_batches_are_cut_between_series():
    rows = [1, 2, 3, 1, 1, 2, 3, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"_row": pa.array(rows[a:b], pa.int32())}) for a, b in ((0, 2), (2, 5), (5, 7), (7, 9))]
    assert [t.column("_row").to_pylist() for t in whole_series(batches)] == [[1, 2, 3, 1], [1, 2, 3, 4, 5]]
    assert list(whole_series([])) == []


def test_window_values_equal_plain_loops():
    rng = np.random.default_rng(1)
    series = [rng.normal(0, 1, 12), np.array([2.0, 2.0, 2.0, np.nan, 1.0, 3.0, 3.0, 1.0]), rng.integers(0, 3, 9).astype(float)]
    x, row = np.concatenate(series), np.concatenate([np.arange(1, len(s) + 1) for s in series])
    w = 3
    with np.errstate(all="ignore"):
        got = window_values(x, row, w, FX.OPS)
    at = 0
    for s in series:
        for i, last in enumerate(s):
            v, k = s[max(0, i - w + 1) : i + 1], np.arange(w)
            value = {op: got[op][at] for op in got}
            at += 1
            assert value["REF"] == pytest.approx(s[i - w] if i >= w else np.nan, nan_ok=True)
            if len(v) < w or np.isnan(v).any():
                assert all(np.isnan(value[op]) for op in value if op not in ("REF", "DELTA"))
                continue
            slope, mid = np.polyfit(k, v, 1) if v.std() else (0.0, v[0])
            want = {
                "MEAN": v.mean(), "STD": v.std(), "MAX": v.max(), "MIN": v.min(), "MED": np.median(v), "Q20": np.quantile(v, 0.2), "Q80": np.quantile(v, 0.8),
                "TSRANK": ((v < last).sum() + (v == last).sum() / 2) / w, "IDXMAX": (w - 1 - v.argmax()) / w, "IDXMIN": (w - 1 - v.argmin()) / w,
                "SLOPE": slope, "RESI": last - (v.mean() + slope), "WMA": (v * (k + 1)).sum() / 6, "SUM": v.sum(), "COUNT": (v > 0).mean(),
                "SKEW": ((v - v.mean()) ** 3).mean() / v.std() ** 3 if v.std() else np.nan, "KURT": ((v - v.mean()) ** 4).mean() / v.std() ** 4 - 3 if v.std() else np.nan,
                "RSQ": np.corrcoef(k, v)[0, 1] ** 2 if v.std() else np.nan,
            }
            assert {op: value[op] for op in want} == pytest.approx(want, nan_ok=True, abs=1e-9)


def test_generated_features_walk_no_frame_per_row(spark):
    """One row number sorts the series; a frame per operator, or a Python call per series, would cost more than the rows."""
    wide = FX.field_features(FX.base_fields(adjust(random_bars(spark, 3, 70))), "R")
    text = wide._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 2 and "FlatMapGroups" not in text and "collect_list" not in text and "regr_" not in text
    rows = wide.orderBy("sym", "d").collect()
    assert len(rows) == 210 and [r["MEAN_R_60"] is None for r in rows[:70]] == [True] * 60 + [False] * 10
