"""Configurations as rows against one run per configuration, and truncation tests that find what looks ahead."""

import pytest
from helpers import random_bars
from pyspark.sql import functions as F

from barloom.operators import configured as K
from barloom.operators import events as E
from barloom.operators import sequential as Q
from barloom.sources.bars import adjust, calendar


@pytest.fixture(scope="module")
def panel(spark):
    bars = adjust(random_bars(spark, 3, 260, 11)).select("sym", "d", "pos", "close", "vol")
    return Q.add_recursions(bars, [Q.macd("close")]).cache()


def test_configured_events_equal_single_runs(spark, panel):
    rows = [("a", f"o{o}s{s}", "fractal", o, None, s, None, 0.001, 2) for o in (2, 4) for s in (1, 9)]
    rows += [("b", f"z{i}", "zigzag", None, p, s, None, c, look) for i, (p, s, c, look) in enumerate([(0.03, 0, 0.001, 2), (0.05, 12, 0.05, 1)])]
    settings = spark.createDataFrame(rows, K.SETTINGS)
    got = K.configured_divergences(panel, K.configured_lows(panel, settings)).collect()
    for pool, config, method, order, pct, sep, _, change, look in rows:
        lows = E.fractal_lows(panel, "close", order) if method == "fractal" else Q.zigzag_lows(panel, "close", pct)
        want = E.divergences(panel, E.min_separation(lows, sep), E.DivergenceRule(min_change=change, lookback=look))
        own = sorted((r["sym"], r["sig_pos"], r["low_pos"], r["prev_pos"], r["rank"], r["formation"]) for r in got if r["config"] == config)
        assert own == sorted(tuple(r) for r in want.collect()), config
    assert len(got) > 30


def test_recalls(spark):
    rows = [("p", "base", "A", 1), ("p", "base", "A", 2), ("p", "x", "A", 2), ("p", "x", "A", 2), ("p", "x", "B", 2), ("q", "x", "A", 1)]
    got = {(r["pool"], r["config"]): tuple(r)[2:] for r in K.recalls(spark.createDataFrame(rows, "pool string, config string, sym string, k int"), "base", ["sym", "k"]).collect()}
    assert got == {("p", "x"): (2, 2, 1, 0.5, 0.5), ("q", "x"): (0, 1, 0, None, 0.0)}


def detect(lows):
    def run(rows):
        panel = Q.add_recursions(rows.select("sym", "d", "pos", "close", "vol"), [Q.macd("close")])
        return E.divergences(panel, lows(panel), E.DivergenceRule())

    return run


COLUMNS = ["sig_pos", "low_pos", "prev_pos", "rank"]


def test_causal_detectors_agree_at_every_cut(spark, panel):
    cuts = K.cut_days(calendar(panel), 20).cache()
    bars = panel.drop("dif", "dea")
    got = K.truncation_test(bars, cuts, detect(lambda p: E.fractal_lows(p, "close", 3)), COLUMNS).collect()
    assert len(got) == 20 and all(r["n_whole"] == r["n_prefix"] == r["n_both"] for r in got) and sum(r["n_whole"] for r in got) > 5


def test_a_detector_that_looks_ahead_is_found(spark, panel):
    """Lows that are announced on their own row use rows after it."""
    cuts = K.cut_days(calendar(panel), 130).cache()
    early = lambda p: E.fractal_lows(p, "close", 3).withColumn("sig_pos", F.col("low_pos"))
    got = K.truncation_test(panel.drop("dif", "dea"), cuts, detect(early), COLUMNS).collect()
    assert sum(r["n_whole"] - r["n_both"] for r in got) > 0


def test_bounded_lookback_replays_fewer_rows(spark, panel):
    cuts = K.cut_days(calendar(panel), 20).cache()
    bars = panel.select("sym", "d", "pos", "close")
    whole, near = K.seen_by_cuts(bars, cuts), K.seen_by_cuts(bars, cuts, 30)
    assert whole.count() == sum(min(260, 13 * (i + 1)) for i in range(20)) * 3
    assert near.count() <= 3 * 260 + 20 * 3 * 30 and near.join(whole, ["sym", "pos"], "left_anti").count() == 0
    own = near.join(cuts, "cut").where("d <= cut_d AND (after_d IS NULL OR d > after_d)")
    assert own.count() == 3 * 260
