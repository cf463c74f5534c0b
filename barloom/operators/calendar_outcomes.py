"""Outcomes that run on the calendar: a day without a quote passes like any other.

Bars carry ``cal_pos``, the number of their day in the calendar, and the number of days is known. Horizons, order
validity and watch windows are RANGE frames and steps over ``cal_pos``; a symbol without a quote on a day simply has no
row there, so nothing is filled in. What must be sold on a day without a quote, or on one locked at its down limit,
waits for the first day that has a free one: an as-of search forward over the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import SLIPPAGE
from barloom.operators.joins import bars_after, shuffled_join
from barloom.operators.labels import TOL, ExitRule, _entered, _exit_price, settled

# Fixed values of the stand-in rule on days without a limit table.
NEAR_LIMIT_OPEN, NEAR_LIMIT_CLOSE = 1.098, 0.098


def on_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars (sym, d, open, high, low, close, up_limit, down_limit, limits_known) with ``cal_pos`` and ``locked``.

    ``locked``: the open stands at the up limit. On a day whose limit table is missing (``limits_known`` false) a
    stand-in rule holds against the close of the calendar day before, if there is one.
    """
    placed = bars.join(calendar.select("d", F.col("cal_pos").cast("long").alias("cal_pos")), "d")
    order = Window.partitionBy("sym").orderBy("cal_pos")
    yesterday = F.when(F.lag("cal_pos").over(order) == F.col("cal_pos") - 1, F.lag("close").over(order))
    one_price = (F.col("low") == F.col("high")) & (F.col("close") / yesterday - 1.0 >= NEAR_LIMIT_CLOSE)
    stand_in = F.coalesce((F.col("open") >= yesterday * NEAR_LIMIT_OPEN) | one_price, F.lit(False))
    locked = F.when(F.col("up_limit").isNotNull(), F.col("open") >= F.col("up_limit") - TOL).otherwise(~F.col("limits_known") & stand_in)
    return placed.withColumn("locked", locked)


def _days(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bars keyed by calendar position, in the shape that ``bars_after`` steps over."""
    return bars.select("sym", F.col("cal_pos").alias("pos"), *columns)


def _range(first: int, last: int):
    return Window.partitionBy("sym").orderBy("cal_pos").rangeBetween(first, last)


def quote_entries(events: DataFrame, bars: DataFrame, n_days: int, day: Column) -> DataFrame:
    """Buy at the open of the calendar day ``day``: dropped without that day, without a quote, or locked."""
    side = bars.select("sym", F.col("cal_pos").alias("entry_pos"), F.col("open").alias("_open"), F.col("locked").alias("_locked"))
    out = shuffled_join(events.withColumn("entry_pos", day.cast("long")), side, ["sym", "entry_pos"], "left")
    status = (
        F.when(F.col("entry_pos") > n_days, "dropped_no_next_day").when(F.col("_open").isNull(), "dropped_no_quote")
        .when(F.col("_locked"), "dropped_limitup").otherwise("entered")
    )
    return out.withColumns({"status": status, "entry_price": F.col("_open") * (1.0 + SLIPPAGE)}).drop("_open", "_locked")


def with_event_close(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``_ref``: the close of the event's day, NULL when the symbol has no quote then."""
    return shuffled_join(events, bars.select("sym", F.col("cal_pos").alias("sig_pos"), F.col("close").alias("_ref")), ["sym", "sig_pos"], "left")


def next_day_entries(events: DataFrame, bars: DataFrame, n_days: int) -> DataFrame:
    """Buy at the next calendar day's open; the event's own close must exist."""
    out = quote_entries(with_event_close(events, bars), bars, n_days, F.col("sig_pos") + 1)
    missing = (F.col("status") == "entered") & F.col("_ref").isNull()
    return out.withColumn("status", F.when(missing, "dropped_no_close_T").otherwise(F.col("status"))).drop("_ref")


def limit_order_entries(events: DataFrame, bars: DataFrame, n_days: int, margin: float, valid: int = 20) -> DataFrame:
    """A limit order at anchor_close * (1 + margin), good for ``valid`` calendar days. Days without a quote and locked
    days pass without a fill; an open below the limit fills at the open."""
    limit = F.col("anchor_close") * (1.0 + margin)
    path = bars_after(events.select("sym", "sig_pos", "anchor_close"), _days(bars, ["open", "low", "locked"]), ["open", "low", "locked"], 1, valid)
    hit = ~F.col("x_locked") & (F.col("x_low") <= limit)
    first = path.groupBy("sym", "sig_pos").agg(F.min(F.when(hit, F.struct("step", F.least("x_open", limit).alias("raw")))).alias("_f"))
    out = shuffled_join(with_event_close(events, bars), first, ["sym", "sig_pos"], "left")
    status = (
        F.when(F.col("sig_pos") + 1 > n_days, "dropped_no_next_day").when(F.col("_ref").isNull(), "dropped_no_close_T")
        .when(F.col("_f").isNull(), "no_fill").otherwise("entered")
    )
    return out.withColumns(
        {"status": status, "entry_pos": F.col("sig_pos") + F.col("_f.step"), "entry_price": F.col("_f.raw") * (1.0 + SLIPPAGE)}
    ).drop("_f", "_ref")


def not_breached_entries(events: DataFrame, bars: DataFrame, n_days: int, k: int, drop: float) -> DataFrame:
    """Enter k + 1 calendar days on if no low of the k days between falls below the event's close by more than ``drop``."""
    ahead = bars.select("sym", F.col("cal_pos").alias("sig_pos"), F.min("low").over(_range(1, k)).alias("_low"))
    out = quote_entries(shuffled_join(with_event_close(events, bars), ahead, ["sym", "sig_pos"], "left"), bars, n_days, F.col("sig_pos") + k + 1)
    status = (
        F.when(F.col("sig_pos") + k + 1 > n_days, "dropped_no_next_day").when(F.col("_ref").isNull(), "dropped_no_close_T")
        .when(F.col("_low").isNull(), "skipped_no_window_data").when(F.col("_low") < F.col("_ref") * (1.0 - drop) - TOL, "skipped_breach")
        .otherwise(F.col("status"))
    )
    return out.withColumn("status", status).drop("_ref", "_low")


def breakout_entries(events: DataFrame, bars: DataFrame, n_days: int, k: int, watch: int = 5) -> DataFrame:
    """Enter the calendar day after the first close above the high of the next k days, watched for ``watch`` days.

    The event's day needs no quote, so the days are looked up by equality for each event.
    """
    path = bars_after(events.select("sym", "sig_pos"), _days(bars, ["high", "close"]), ["high", "close"], 1, k + watch)
    later = F.when(F.col("step") > k, F.struct("step", F.col("x_close").alias("close")))
    seen = path.groupBy("sym", "sig_pos").agg(F.max(F.when(F.col("step") <= k, F.col("x_high"))).alias("_high"), F.collect_list(later).alias("_later"))
    above = F.array_min(F.transform(F.filter("_later", lambda x: x["close"] > F.col("_high") + TOL), lambda x: x["step"]))
    out = shuffled_join(events, seen, ["sym", "sig_pos"], "left").withColumn("_step", above)
    out = quote_entries(out, bars, n_days, F.col("sig_pos") + F.col("_step") + 1)
    status = (
        F.when(F.col("sig_pos") + k > n_days, "dropped_no_next_day").when(F.col("_high").isNull(), "skipped_no_window_data")
        .when(F.col("_step").isNull(), "skipped_no_trigger").otherwise(F.col("status"))
    )
    return out.withColumn("status", status).drop("_high", "_later", "_step")


def first_free_from(points: DataFrame, bars: DataFrame, at: str, out: str) -> DataFrame:
    """``points`` (sym, at) with the first bar at or after calendar position ``at`` that closes above its down limit.

    Points and bars share one series per symbol, read from its end; a point comes before the bar of its own day.
    """
    free = ~F.coalesce(F.col("close") <= F.col("down_limit") + TOL, F.lit(False))
    row = F.struct("d", F.col("cal_pos").alias("pos"), "open", "high", "low", "close")
    series = bars.select("sym", F.col("cal_pos").alias(at), F.when(free, row).alias(out), F.lit(0).alias("_point"))
    asked = points.select("sym", at).distinct()
    series = series.unionByName(asked.select("sym", at, F.lit(None).cast(series.schema[out].dataType).alias(out), F.lit(1).alias("_point")))
    backward = Window.partitionBy("sym").orderBy(F.desc(at), F.asc("_point")).rowsBetween(Window.unboundedPreceding, 0)
    found = series.withColumn(out, F.last(out, ignorenulls=True).over(backward)).where("_point = 1").drop("_point")
    return shuffled_join(points, found, ["sym", at], "left")


def outcomes(entries: DataFrame, bars: DataFrame, rule: ExitRule, keys: tuple[str, ...] = ("sym", "sig_pos")) -> DataFrame:
    """Exit of every entry on the calendar; ``rule.horizon`` counts calendar days, the entry day is the first.

    Looked at are the days after the entry that have a quote. The first one with a trigger (a barrier, or the horizon
    reached) that is not locked at its down limit is the exit; a trigger on a locked day is passed over. Adds what
    ``labels.outcomes`` adds; exit_pos and held are calendar positions.
    """
    sized = _entered(entries, rule)
    tp, sl = (None if x is None else F.lit(x) for x in (rule.tp, rule.sl))
    live = sized.where("status = 'entered'").withColumn("_due", F.greatest(F.col("entry_pos") + rule.horizon - 1, F.col("entry_pos") + 1))
    live = first_free_from(live, bars, "_due", "nf")
    price, reason = _exit_price("nf.", F.col("entry_price"), tp, sl, F.lit(True))
    live = live.withColumns({"_lp": F.when(F.col("nf").isNotNull(), price), "_lr": F.when(F.col("nf").isNotNull(), reason)})
    found = "cast(null as struct<step:int,d:date,p:double,why:string>)"
    if (tp is not None or sl is not None) and rule.horizon > 2:
        columns = ["d", "open", "high", "low", "close", "down_limit"]
        wanted = live.select(*dict.fromkeys(["sym", *keys, "entry_pos", "entry_price"]))
        path = bars_after(wanted, _days(bars, columns), columns, 1, rule.horizon - 2, sig="entry_pos")
        p, why = _exit_price("x_", F.col("entry_price"), tp, sl, F.lit(False))
        free = ~F.coalesce(F.col("x_close") <= F.col("x_down_limit") + TOL, F.lit(False))
        path = path.withColumns({"_p": p, "_why": why})
        early = F.struct("step", F.col("x_d").alias("d"), F.col("_p").alias("p"), F.col("_why").alias("why"))
        first = path.groupBy(*keys).agg(F.min(F.when(F.col("_p").isNotNull() & free, early)).alias("_early"))
        live = shuffled_join(live, first, list(keys), "left")
    else:
        live = live.withColumn("_early", F.expr(found))
    e = F.col("_early")
    exits = live.select(
        *keys, F.coalesce(F.col("entry_pos") + e["step"], F.col("nf.pos")).alias("exit_pos"), F.coalesce(e["d"], F.col("nf.d")).alias("exit_d"),
        F.coalesce(e["why"], F.col("_lr")).alias("exit_reason"), (F.coalesce(e["p"], F.col("_lp")) * (1.0 - SLIPPAGE)).alias("exit_price"),
    )
    return settled(sized, exits, keys)


def densify_all(bars: DataFrame, calendar: DataFrame, key: str = "sym", day: str = "d") -> DataFrame:
    """Every key on every calendar day; absent days have NULL columns.

    The grid is made of day numbers, exploded per key; days are looked up by number, so no tables are crossed.
    """
    n_days = calendar.agg(F.max("cal_pos")).first()[0] or 0
    grid = bars.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(n_days))).alias("cal_pos")) if n_days else bars.select(key).distinct().withColumn("cal_pos", F.lit(0))
    grid = grid.join(calendar.select(day, F.col("cal_pos").cast("int").alias("cal_pos")), "cal_pos")
    return grid.join(bars, [key, day], "left")

