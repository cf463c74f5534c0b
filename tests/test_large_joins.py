"""Joins of tables that grow with the input go through no broadcast."""

from pyspark.sql import functions as F

from barloom.operators import calendar_outcomes as C
from barloom.operators import joins as J
from barloom.operators.labels import ExitRule
from barloom.session import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_steps_of_small_files_are_not_broadcast(spark):
    """A stored event table looks small to the planner, its steps are twenty times as many."""
    events = stored(spark.range(200).select(F.lit("a").alias("sym"), F.col("id").alias("sig_pos")), "few-events")
    bars = stored(spark.range(300).select(F.lit("a").alias("sym"), F.col("id").alias("pos"), F.col("id").cast("double").alias("low")), "few-bars")
    out = J.bars_after(events, bars, ["low"], 1, 20)
    assert "Broadcast" not in plan(out)
    assert out.count() == 200 * 20 and out.where("x_low <> sig_pos + step").count() == 0


def test_limit_orders_on_the_calendar_are_not_broadcast(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    price = (F.lit(100.0) - F.col("id")).alias
    bars = stored(
        spark.range(30).select(
            F.lit("a").alias("sym"), day.alias("d"), (F.col("id") + 1).alias("cal_pos"), *[price(c) for c in ("open", "high", "low", "close")],
            F.lit(0.0).alias("down_limit"), F.lit(False).alias("locked"),
        ), "falling",
    )
    events = stored(spark.createDataFrame([("a", 1, 100.0), ("a", 30, 71.0)], "sym string, sig_pos long, anchor_close double"), "two-events")
    entries = C.limit_order_entries(events, bars, 30, -0.1)
    out = C.outcomes(stored(entries, "entries"), bars, ExitRule(5, 0.25, -0.14, 100_000.0))
    assert "Broadcast" not in plan(entries) and "Broadcast" not in plan(out)
    got = {r["sig_pos"]: (r["status"], r["entry_pos"], r["exit_pos"]) for r in out.collect()}
    assert got == {1: ("closed", 11, 15), 30: ("dropped_no_next_day", None, None)}


def test_merged_sources_read_one_table_of_bars(spark, monkeypatch):
    """The fills are aggregated once for the spine, three sources and all checks, and no source is broadcast."""
    from barloom.plans import joins as P
    from barloom.session import stored as store

    written = []
    monkeypatch.setattr(P, "stored", lambda df, name: written.append(name) or store(df, name))
    text = plan(P.feature_sources_merged(spark, "/root/testdata/sf0.001"))
    assert written == ["merged-bars"] and "lineitem" not in text and "Broadcast" not in text
