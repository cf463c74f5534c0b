"""Forward labels and outcomes on literal bars."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import labels as L


def make(spark, rows):
    """rows: (open, high, low, close, up, down) of one symbol."""
    start = dt.date(2022, 1, 1)
    data = [("a", i + 1, start + dt.timedelta(days=i), *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "sym string, pos long, d date, open double, high double, low double, close double, up_limit double, down_limit double")


FLAT = (10, 10, 10, 10, None, None)


@pytest.fixture
def event(spark):
    return spark.createDataFrame([("a", 1)], "sym string, sig_pos long")


def outcome(bars, event, rule):
    return L.outcomes(L.market_entries(event, bars), bars, rule).collect()[0]


def test_horizon_exit_counts_the_entry_row(spark, event):
    r = outcome(make(spark, [FLAT] * 10), event, L.ExitRule(3))
    assert (r["status"], r["entry_pos"], r["exit_pos"], r["held"], r["exit_reason"]) == ("closed", 2, 4, 3, "horizon")
    assert r["net_ret"] < 0


def test_both_barriers_on_one_row_is_a_stop(spark, event):
    bars = make(spark, [FLAT, FLAT, (10, 14, 7, 10, None, None), FLAT, FLAT])
    r = outcome(bars, event, L.ExitRule(5, 0.2, -0.2))
    assert (r["exit_pos"], r["exit_reason"]) == (3, "sl")
    assert r["exit_price"] == pytest.approx(10 * 1.001 * 0.8 * 0.999)


def test_open_beyond_the_barrier_is_the_price(spark, event):
    bars = make(spark, [FLAT, FLAT, (13, 14, 12.5, 13, None, None), FLAT, FLAT])
    r = outcome(bars, event, L.ExitRule(5, 0.2, -0.2))
    assert (r["exit_reason"], r["exit_price"]) == ("tp", pytest.approx(13 * 0.999))


def test_exit_waits_while_locked_at_the_down_limit(spark, event):
    locked = (9, 9, 9, 9, 11, 9)
    r = outcome(make(spark, [FLAT, FLAT, FLAT, locked, locked, FLAT]), event, L.ExitRule(3))
    assert (r["exit_pos"], r["status"]) == (6, "closed")
    r = outcome(make(spark, [FLAT, FLAT, FLAT, locked, locked, locked]), event, L.ExitRule(3))
    assert (r["exit_pos"], r["status"]) == (None, "incomplete")


def test_entries_that_cannot_happen(spark, event):
    assert outcome(make(spark, [FLAT]), event, L.ExitRule(3))["status"] == "dropped_no_next"
    assert outcome(make(spark, [FLAT, (11, 11, 11, 11, 11, 9), FLAT]), event, L.ExitRule(2))["status"] == "dropped_limitup"
    assert outcome(make(spark, [FLAT] * 4), event, L.ExitRule(2, budget=900.0))["status"] == "dropped_cash"


def test_share_count_leaves_room_for_the_fee(spark):
    # 10 lots cost 10,000 and the fee would exceed the budget; 9 lots fit.
    row = spark.range(1).select(L.whole_lots(F.lit(10.0), 10_000.0).alias("n"), L.whole_lots(F.lit(10.0), 10_005.0).alias("m")).first()
    assert (row["n"], row["m"]) == (900, 1000)


def test_limit_order_fills_at_the_better_price(spark):
    bars = make(spark, [FLAT, (12, 12, 11, 12, None, None), (9, 10, 8, 9, None, None), FLAT, FLAT, FLAT])
    ev = spark.createDataFrame([("a", 1, 9.5)], "sym string, sig_pos long, anchor_close double")
    r = L.limit_order_entries(ev, bars, 0.0).collect()[0]
    assert (r["status"], r["entry_pos"], r["entry_price"]) == ("entered", 3, pytest.approx(9 * 1.001))
    assert L.limit_order_entries(ev.withColumn("anchor_close", F.lit(1.0)), bars, 0.0).collect()[0]["status"] == "no_fill"


def test_breakout_and_not_breached(spark, event):
    bars = make(spark, [FLAT, FLAT, FLAT, (10, 12, 10, 11, None, None), FLAT, FLAT])
    r = L.breakout_entries(event, bars, 2).collect()[0]
    assert (r["status"], r["trigger_pos"], r["entry_pos"]) == ("entered", 4, 5)
    dip = make(spark, [FLAT, (10, 10, 8, 10, None, None), FLAT, FLAT, FLAT])
    assert L.not_breached_entries(event, dip, 2, 0.1).collect()[0]["status"] == "skipped_breach"
    assert L.not_breached_entries(event, dip, 2, 0.3).collect()[0]["entry_pos"] == 4


def test_capped_return_order_on_one_row(spark, event):
    path = [FLAT, FLAT, (6, 20, 5, 10, None, None), FLAT, FLAT]
    r = L.capped_returns(event, make(spark, path), 3).collect()[0]
    assert r["take_profit"] == pytest.approx(0.15) and r["stop_profit"] == pytest.approx(-0.4)
    above = [FLAT, (12, 12, 11, 12, None, None), FLAT, FLAT, FLAT]
    assert L.capped_returns(event, make(spark, above), 3).collect()[0]["take_profit"] is None


def test_labels_stay_null_until_mature(spark):
    bars = make(spark, [FLAT] * 4).withColumn("cf", F.lit(1.0))
    got = bars.withColumns({"y": L.sign_labels(("cur",), (2,))["cur_h2"], "c": L.chain_return(3)}).orderBy("pos").collect()
    assert [r["y"] for r in got] == [0.0, None, None, None]
    assert [r["c"] for r in got] == [0.0, None, None, None]


def test_dynamic_horizon_rounds_half_to_even(spark):
    bars = make(spark, [FLAT] * 8).withColumn("cf", F.col("pos") * 1.0)
    ev = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", 1, 1)], "sym string, sig_pos long, formation long")
    got = {r["formation"]: (r["h"], r["dyn"]) for r in L.dynamic_return(ev, bars, 0.5).collect()}
    assert got == {5: (2, 2.0), 7: (4, 4.0), 1: (1, 1.0)}
