"""Outcomes on the calendar clock, over daily bars with days without a quote."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalar import rnd
from barloom.operators import calendar_outcomes as C
from barloom.operators.labels import ExitRule
from barloom.plans import sqltext as S
from barloom.plans.events import longs, longs_sql
from barloom.plans.labels import BUDGET, entry_sql, outcome_sql
from barloom.plans.registry import query
from barloom.plans.sqltext import r
from barloom.session import stored
from barloom.sources import bars as SRC

# Bars by calendar position; limits stand in at +-25 % of the last close and are missing on every 7th day.
CLOCK_SQL = f"""cal AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT DISTINCT d FROM bars)),
q0 AS (SELECT bars.*, cal.pos, lag(close) OVER w AS pre_close, CASE WHEN lag(cal.pos) OVER w = cal.pos - 1 THEN lag(close) OVER w END AS yesterday, cal.pos % 7 <> 0 AS limits_known
 FROM bars JOIN cal USING (d) WINDOW w AS (PARTITION BY sym ORDER BY d)),
q1 AS (SELECT *, CASE WHEN limits_known THEN pre_close * 1.25 END AS up_limit, CASE WHEN limits_known THEN pre_close * 0.75 END AS down_limit FROM q0),
pb AS (SELECT *, coalesce(CASE WHEN up_limit IS NOT NULL THEN open >= up_limit - 0.005 ELSE NOT limits_known AND (open >= yesterday * 1.098 OR (low = high AND close / yesterday - 1.0 >= 0.098)) END, false) AS locked FROM q1),
nd AS (SELECT max(pos) AS n_days FROM cal),
ev AS (SELECT sym, pos + CASE WHEN sym % 3 = 0 THEN 1 ELSE 0 END AS sig_pos, close AS anchor_close FROM pb, nd WHERE close < pre_close AND pos + CASE WHEN sym % 3 = 0 THEN 1 ELSE 0 END <= n_days),
ec AS (SELECT ev.*, b.close AS ref FROM ev LEFT JOIN pb b ON b.sym = ev.sym AND b.pos = ev.sig_pos)"""


def clock(spark, sf_dir):
    """Daily bars of users on the calendar, its number of days, and events: closes below the last one, a third of them noted a day later."""
    bars = SRC.adjust(SRC.bars_user_day(spark, sf_dir))
    calendar = SRC.calendar(bars)
    known = F.pmod("cal_pos", F.lit(7)) != 0
    dated = bars.join(calendar, "d").select("sym", "d", "open", "high", "low", "close", "pre_close", known.alias("limits_known"))
    dated = dated.withColumns({"up_limit": F.when(F.col("limits_known"), F.col("pre_close") * 1.25), "down_limit": F.when(F.col("limits_known"), F.col("pre_close") * 0.75)})
    placed = stored(C.on_calendar(dated, calendar), "clock-bars")
    n_days = placed.agg(F.max("cal_pos")).first()[0] or 0
    noted = F.col("cal_pos") + F.when(F.col("sym") % 3 == 0, 1).otherwise(0)
    events = placed.where("close < pre_close").select("sym", noted.cast("long").alias("sig_pos"), F.col("close").alias("anchor_close")).where(F.col("sig_pos") <= n_days)
    return placed, n_days, stored(events, "clock-events")


def clock_entry_sql(src: str, offset: str, name: str = "en", checks: str = "") -> str:
    """Entries at the open of calendar day sig_pos + offset; ``checks`` are the WHEN parts before the quote's own."""
    return f"""{name} AS (SELECT e.*, e.sig_pos + {offset} AS entry_pos, b.open * (1.0 + 0.001) AS entry_price,
 CASE {checks} WHEN e.sig_pos + {offset} > n_days THEN 'dropped_no_next_day' WHEN b.open IS NULL THEN 'dropped_no_quote' WHEN b.locked THEN 'dropped_limitup' ELSE 'entered' END AS status
 FROM {src} e CROSS JOIN nd LEFT JOIN pb b ON b.sym = e.sym AND b.pos = e.sig_pos + {offset})"""


CLOCK_OUT = f"SELECT sym, {longs_sql('sig_pos')}, status, CAST(exit_pos AS DOUBLE) AS exit_pos, CAST(exit_pos - entry_pos + 1 AS DOUBLE) AS held, exit_reason, {r('net_ret')} AS net_ret FROM oc"


def closed(entries, bars, rule):
    out = C.outcomes(stored(entries, "clock-entries"), bars, rule)
    return out.select("sym", *longs(out, "sig_pos"), "status", *[F.col(c).cast("double").alias(c) for c in ("exit_pos", "held")], "exit_reason", rnd("net_ret").alias("net_ret"))


# The control's order of checks: quote and lock first, the event's own close last.
CONTROL_SQL = clock_entry_sql("ec", "1", "e0") + ",\nen AS (SELECT * REPLACE (CASE WHEN status = 'entered' AND ref IS NULL THEN 'dropped_no_close_T' ELSE status END AS status) FROM e0)"


@query("clock_horizon_exit", "L11 J23 J24", S.with_bars(S.USER_DAY, CLOCK_SQL, CONTROL_SQL, outcome_sql("en", 6)) + CLOCK_OUT)
def clock_horizon_exit(spark, sf_dir):
    """Next calendar day's open, sold after six calendar days."""
    bars, n_days, events = clock(spark, sf_dir)
    return closed(C.next_day_entries(events, bars, n_days), bars, ExitRule(6, budget=BUDGET))


@query("clock_barrier_exit", "L11 J23", S.with_bars(S.USER_DAY, CLOCK_SQL, CONTROL_SQL, outcome_sql("en", 12, 0.25, -0.14)) + CLOCK_OUT)
def clock_barrier_exit(spark, sf_dir):
    bars, n_days, events = clock(spark, sf_dir)
    return closed(C.next_day_entries(events, bars, n_days), bars, ExitRule(12, 0.25, -0.14, BUDGET))


@query(
    "clock_pullback_order", "E21 L17",
    S.with_bars(S.USER_DAY, CLOCK_SQL,
                """pf AS (SELECT e.sym, e.sig_pos, min(x.pos) AS fp FROM ec e JOIN pb x ON x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 20 WHERE NOT x.locked AND x.low <= anchor_close * (1.0 - 0.4) GROUP BY 1, 2),
en AS (SELECT e.*, fp AS entry_pos, least(b.open, anchor_close * (1.0 - 0.4)) * (1.0 + 0.001) AS entry_price,
 CASE WHEN e.sig_pos + 1 > n_days THEN 'dropped_no_next_day' WHEN ref IS NULL THEN 'dropped_no_close_T' WHEN fp IS NULL THEN 'no_fill' ELSE 'entered' END AS status
 FROM ec e CROSS JOIN nd LEFT JOIN pf USING (sym, sig_pos) LEFT JOIN pb b ON b.sym = e.sym AND b.pos = fp)""",
                outcome_sql("en", 12, 0.25, -0.14)) + CLOCK_OUT,
)
def clock_pullback_order(spark, sf_dir):
    """A limit order 40 % below the anchor, good for 20 calendar days."""
    bars, n_days, events = clock(spark, sf_dir)
    return closed(C.limit_order_entries(events, bars, n_days, -0.4), bars, ExitRule(12, 0.25, -0.14, BUDGET))


@query(
    "clock_not_breached", "E20 L17",
    S.with_bars(S.USER_DAY, CLOCK_SQL,
                "br AS (SELECT e.*, (SELECT min(x.low) FROM pb x WHERE x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 3) AS wl FROM ec e)",
                clock_entry_sql("br", "4", checks="WHEN e.sig_pos + 4 > n_days THEN 'dropped_no_next_day' WHEN ref IS NULL THEN 'dropped_no_close_T' WHEN wl IS NULL THEN 'skipped_no_window_data' WHEN wl < ref * (1.0 - 0.5) - 0.005 THEN 'skipped_breach'"),
                outcome_sql("en", 5)) + CLOCK_OUT,
)
def clock_not_breached(spark, sf_dir):
    bars, n_days, events = clock(spark, sf_dir)
    return closed(C.not_breached_entries(events, bars, n_days, 3, 0.5), bars, ExitRule(5, budget=BUDGET))


@query(
    "clock_breakout", "E20 L17",
    S.with_bars(S.USER_DAY, CLOCK_SQL,
                """bo AS (SELECT e.*, (SELECT max(x.high) FROM pb x WHERE x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 2) AS hr FROM ec e),
bt AS (SELECT bo.*, (SELECT min(x.pos) FROM pb x WHERE x.sym = bo.sym AND x.pos BETWEEN bo.sig_pos + 3 AND bo.sig_pos + 7 AND x.close > bo.hr + 0.005) - bo.sig_pos AS trig FROM bo)""",
                clock_entry_sql("bt", "trig + 1", checks="WHEN e.sig_pos + 2 > n_days THEN 'dropped_no_next_day' WHEN hr IS NULL THEN 'skipped_no_window_data' WHEN trig IS NULL THEN 'skipped_no_trigger'"),
                outcome_sql("en", 5)) + CLOCK_OUT,
)
def clock_breakout(spark, sf_dir):
    bars, n_days, events = clock(spark, sf_dir)
    return closed(C.breakout_entries(events, bars, n_days, 2), bars, ExitRule(5, budget=BUDGET))


@query(
    "clock_statuses", "L17 L11",
    S.with_bars(S.USER_DAY, CLOCK_SQL, CONTROL_SQL, outcome_sql("en", 6)) + f"SELECT status, count(*) AS n, {r('avg(net_ret)')} AS mean_ret FROM oc GROUP BY 1",
)
def clock_statuses(spark, sf_dir):
    """How many events end in which status."""
    out = clock_horizon_exit(spark, sf_dir)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("net_ret")).alias("mean_ret"))


@query(
    "calendar_aligned_bars", "J23",
    S.with_bars(S.USER_DAY, "c AS (SELECT DISTINCT d FROM bars)", "s AS (SELECT DISTINCT sym FROM bars)")
    + f"SELECT s.sym, CAST(c.d AS VARCHAR) AS d, {r('b.close', 4)} AS close FROM s CROSS JOIN c LEFT JOIN bars b ON b.sym = s.sym AND b.d = c.d",
)
def calendar_aligned_bars(spark, sf_dir):
    """Every symbol on every calendar day, before its first and after its last bar as well."""
    bars = stored(SRC.bars_user_day(spark, sf_dir).select("sym", "d", "close"), "user-days")
    out = C.densify_all(bars, SRC.calendar(bars))
    return out.select("sym", F.col("d").cast("string").alias("d"), rnd("close", 4).alias("close"))
