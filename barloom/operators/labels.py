"""Forward labels and per-event outcomes.

Fixed horizons are ``lead`` columns on the bars. Outcomes with barriers join each event to a bounded number of
following rows by (symbol, position); what can lie arbitrarily far ahead (the first sellable row after the
horizon) is one running column on the bars, looked up by equality. Events never see each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import LOT, COMMISSION_MIN, COMMISSION_RATE, SLIPPAGE, commission, sdiv, stamp_rate
from barloom.operators.joins import bars_after, shuffled_join

TOL = 0.005

# ---------------------------------------------------------------- fixed horizons (columns on bars)


def close_to_close(h: int) -> Column:
    """close[t+h+1] / close[t] - 1."""
    return sdiv(B.lead("close", h + 1), "close") - 1.0


def open_to_close(h: int) -> Column:
    """close[t+1+h] / open[t+1] - 1."""
    return sdiv(B.lead("close", h + 1), B.lead("open", 1)) - 1.0


def best_forward(h: int) -> Column:
    """max(high[t+1 .. t+1+h]) / open[t+1] - 1."""
    return sdiv(B.forward("max", "high", 1, h + 1), B.lead("open", 1)) - 1.0


def chain_return(h: int) -> Column:
    """Adjusted return over h rows, entry at the close."""
    return sdiv(B.lead("cf", h), "cf") - 1.0


def chain_return_from_open(h: int) -> Column:
    """Adjusted return over h rows after the next row, entry at its open."""
    return sdiv(B.lead("close", 1), B.lead("open", 1)) * sdiv(B.lead("cf", h + 1), B.lead("cf", 1)) - 1.0


def sniper_hit(n: int, k: float, atr: str = "atr14") -> Column:
    """1 if the next n highs reach next open + k * ATR of the signal row."""
    target = B.lead("open", 1) + k * F.col(atr)
    best = B.forward("max", "high", 1, n)
    return F.when(best.isNotNull() & target.isNotNull(), (best >= target).cast("double"))


def favourable_excursion(w: int, entry: str = "open") -> Column:
    base = B.lead("open", 1) if entry == "open" else F.col("close")
    return sdiv(B.forward("max", "high", 1, w), base) - 1.0


def adverse_excursion(w: int, entry: str = "open") -> Column:
    base = B.lead("open", 1) if entry == "open" else F.col("close")
    return sdiv(B.forward("min", "low", 1, w), base) - 1.0


FAMILIES: dict[str, Callable[[int], Column]] = {
    "cur": close_to_close,
    "open_exec": open_to_close,
    "max_fwd": best_forward,
}
# Fixed values.
HORIZONS = (3, 5, 10, 15, 20, 25, 30, 45, 60)


def sign_labels(families: tuple[str, ...] = ("cur", "open_exec"), horizons: tuple[int, ...] = HORIZONS) -> dict[str, Column]:
    """1.0 / 0.0 by the sign of the forward return, NULL where it is not yet known."""
    out = {}
    for fam in families:
        for h in horizons:
            ret = FAMILIES[fam](h)
            out[f"{fam}_h{h}"] = F.when(ret.isNotNull(), (ret > 0).cast("double"))
    return out


def dynamic_return(events: DataFrame, bars: DataFrame, scale: float, cap: int = 60) -> DataFrame:
    """Adjusted return over a horizon tied to the event's formation length: clip(round_half_even(c*f), 1, cap)."""
    h = F.greatest(F.lit(1), F.least(F.lit(cap), F.bround(F.lit(scale) * F.col("formation"), 0))).cast("long")
    now = bars.select("sym", F.col("pos").cast("long").alias("sig_pos"), F.col("cf").alias("_cf0"))
    later = bars.select("sym", F.col("pos").cast("long").alias("_at"), F.col("cf").alias("_cf1"))
    out = events.withColumn("h", h).withColumn("_at", F.col("sig_pos") + F.col("h"))
    out = shuffled_join(shuffled_join(out, now, ["sym", "sig_pos"]), later, ["sym", "_at"], "left")
    return out.withColumn("dyn", sdiv("_cf1", "_cf0") - 1.0).drop("_at", "_cf0", "_cf1")


def capped_returns(events: DataFrame, bars: DataFrame, h: int, gain: float = 1.15, loss: float = 0.65) -> DataFrame:
    """Take-profit and stop/take-profit returns over rows t+2 .. t+1+h, bought at the signal close.

    NULL when the next low stays above the signal close or the window is not complete. On one row the order is:
    open through the stop, low through the stop, high through the target.
    """
    at = bars.select(
        "sym", F.col("pos").cast("long").alias("sig_pos"), F.col("close").alias("buy"), B.lead("low", 1).alias("next_low"),
        B.lead("close", h + 1).alias("last_close"), B.lead("d", h + 1).alias("last_d"),
    )
    base = shuffled_join(events, at, ["sym", "sig_pos"])
    base = base.where((F.col("next_low") <= F.col("buy")) & F.col("last_close").isNotNull())
    path = bars_after(base.select("sym", "sig_pos", "buy"), bars, ["d", "open", "high", "low"], 2, h + 1)
    buy = F.col("buy")
    code = (
        F.when(F.col("x_open") <= buy * loss, sdiv("x_open", buy) - 1.0)
        .when(F.col("x_low") <= buy * loss, F.lit(loss - 1.0))
        .when(F.col("x_high") >= buy * gain, F.lit(gain - 1.0))
    )
    first = path.groupBy("sym", "sig_pos").agg(
        F.min(F.when(F.col("x_high") >= buy * gain, F.struct(F.col("step"), F.col("x_d").alias("d")))).alias("_tp"),
        F.min(F.when(code.isNotNull(), F.struct(F.col("step"), F.col("x_d").alias("d"), code.alias("r")))).alias("_sl"),
    )
    final = sdiv("last_close", buy) - 1.0
    out = shuffled_join(events, base.select("sym", "sig_pos", "buy", "last_close", "last_d"), ["sym", "sig_pos"], "left")
    out = shuffled_join(out, first, ["sym", "sig_pos"], "left")
    known = F.col("buy").isNotNull()
    return out.select(
        *events.columns,
        F.when(known, F.when(F.col("_tp").isNotNull(), F.lit(gain - 1.0)).otherwise(final)).alias("take_profit"),
        F.when(known, F.coalesce(F.col("_tp.d"), F.col("last_d"))).alias("take_profit_d"),
        F.when(known, F.coalesce(F.col("_sl.r"), final)).alias("stop_profit"),
        F.when(known, F.coalesce(F.col("_sl.d"), F.col("last_d"))).alias("stop_profit_d"),
    )


# ---------------------------------------------------------------- outcomes with barriers
@dataclass(frozen=True)
class ExitRule:
    """Horizon in rows held (entry row is row 1) and optional barriers around the entry price."""

    horizon: int
    tp: float | None = None
    sl: float | None = None
    budget: float = 100_000.0


def whole_lots(price: Column, budget: float) -> Column:
    """Most whole lots whose cost with commission stays within the budget (0 when not even one fits)."""
    room = budget + 1e-6
    spend = F.lit(min(room - COMMISSION_MIN, room / (1.0 + COMMISSION_RATE)))
    return F.floor(spend / price / LOT) * LOT


def _entered(entries: DataFrame, rule: ExitRule) -> DataFrame:
    """Size every entry that has status 'entered' and an execution price."""
    shares = whole_lots(F.col("entry_price"), rule.budget)
    out = entries.withColumn("shares", F.when(F.col("status") == "entered", shares))
    status = F.when((F.col("status") == "entered") & (F.col("shares") <= 0), "dropped_cash").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn(
        "buy_fee", F.when(F.col("status") == "entered", commission(F.col("shares") * F.col("entry_price")))
    )


def market_entries(events: DataFrame, bars: DataFrame, offset: int = 1, sig: str = "sig_pos") -> DataFrame:
    """Buy at the open ``offset`` rows after the signal unless there is no row or the open is limit-locked."""
    side = bars.select(
        "sym", F.col("pos").cast("long").alias("entry_pos"), F.col("open").alias("_open"), F.col("up_limit").alias("_up")
    )
    out = shuffled_join(events.withColumn("entry_pos", (F.col(sig) + offset).cast("long")), side, ["sym", "entry_pos"], "left")
    locked = F.coalesce(F.col("_open") >= F.col("_up") - TOL, F.lit(False))
    status = F.when(F.col("_open").isNull(), "dropped_no_next").when(locked, "dropped_limitup").otherwise("entered")
    return out.withColumns({"status": status, "entry_price": F.col("_open") * (1.0 + SLIPPAGE)}).drop("_open", "_up")


def limit_order_entries(events: DataFrame, bars: DataFrame, margin: float, valid: int = 20) -> DataFrame:
    """Fill on the first of the next ``valid`` rows that trades at anchor*(1+margin) and is not limit-locked."""
    path = bars_after(events.select("sym", "sig_pos", "anchor_close"), bars, ["open", "low", "up_limit"], 1, valid)
    limit = F.col("anchor_close") * (1.0 + margin)
    open_to_trade = ~F.coalesce(F.col("x_open") >= F.col("x_up_limit") - TOL, F.lit(False))
    hit = open_to_trade & (F.col("x_low") <= limit)
    first = path.groupBy("sym", "sig_pos").agg(
        F.min(F.when(hit, F.struct(F.col("step"), F.least("x_open", limit).alias("raw")))).alias("_f"), F.count(F.lit(1)).alias("_rows")
    )
    out = shuffled_join(events, first, ["sym", "sig_pos"], "left")
    status = F.when(F.col("_rows").isNull(), "dropped_no_next").when(F.col("_f").isNull(), "no_fill").otherwise("entered")
    return out.withColumns(
        {"status": status, "entry_pos": F.col("sig_pos") + F.col("_f.step"), "entry_price": F.col("_f.raw") * (1.0 + SLIPPAGE)}
    ).drop("_f", "_rows")


def not_breached_entries(events: DataFrame, bars: DataFrame, k: int, drop: float) -> DataFrame:
    """Enter k+1 rows on if none of the next k lows falls below the signal close by more than ``drop``."""
    at = bars.select(
        "sym", F.col("pos").cast("long").alias("sig_pos"), F.col("close").alias("_ref"), F.min("low").over(B.rows(1, k)).alias("_low"),
        B.lead("pos", k + 1).alias("_next"),
    )
    out = shuffled_join(events, at, ["sym", "sig_pos"])
    entered = market_entries(out, bars, k + 1)
    status = (
        F.when(F.col("_next").isNull(), "dropped_no_next").when(F.col("_low") < F.col("_ref") * (1.0 - drop) - TOL, "skipped_breach")
        .otherwise(F.col("status"))
    )
    return entered.withColumn("status", status).drop("_ref", "_low", "_next")


def breakout_entries(events: DataFrame, bars: DataFrame, k: int, watch: int = 5) -> DataFrame:
    """Enter the row after the first close above the high of the next k rows, watched for ``watch`` rows."""
    at = bars.select(
        "sym", F.col("pos").cast("long").alias("sig_pos"), F.max("high").over(B.rows(1, k)).alias("_high"), B.lead("pos", k).alias("_kth")
    )
    out = shuffled_join(events, at, ["sym", "sig_pos"])
    path = bars_after(out.select("sym", "sig_pos", "_high"), bars, ["close"], k + 1, k + watch)
    first = path.groupBy("sym", "sig_pos").agg(F.min(F.when(F.col("x_close") > F.col("_high") + TOL, F.col("step"))).alias("_step"))
    out = shuffled_join(out, first, ["sym", "sig_pos"], "left").withColumn("trigger_pos", F.col("sig_pos") + F.col("_step"))
    entered = market_entries(out, bars, 1, "trigger_pos")
    status = (
        F.when(F.col("_kth").isNull(), "dropped_no_next").when(F.col("_step").isNull(), "skipped_no_trigger").otherwise(F.col("status"))
    )
    return entered.withColumn("status", status).drop("_high", "_kth", "_step")


def sellable_ahead(bars: DataFrame) -> DataFrame:
    """Per row the first row at or after it whose close is above the down limit (one running column).

    Barrier columns ``tp`` and ``sl`` of the bars, if any, travel along.
    """
    free = ~F.coalesce(F.col("close") <= F.col("down_limit") + TOL, F.lit(False))
    kept = ["pos", "d", "open", "high", "low", "close", *[c for c in ("tp", "sl") if c in bars.columns]]
    backward = Window.partitionBy("sym").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct(*[F.col(c) for c in kept])
    return bars.select(
        "sym", *[F.col(c).cast("long").alias(c) if c == "pos" else F.col(c) for c in kept], free.alias("free"),
        F.last(F.when(free, row), ignorenulls=True).over(backward).alias("next_free"),
    )


def _exit_price(row: str, entry: Column, tp: Column | None, sl: Column | None, timed: Column) -> tuple[Column, Column]:
    """(raw exit price or NULL, reason) of one row; either barrier may be missing. Both on one row count as the stop."""
    o, h, lo, c = (F.col(row + x) for x in ("open", "high", "low", "close"))
    price = F.when(timed, c)
    reason = F.when(timed, F.lit("horizon"))
    if tp is not None:
        up = entry * (1.0 + tp)
        price = F.when(h >= up - TOL, F.when(o >= up - TOL, o).otherwise(up)).otherwise(price)
        reason = F.when(h >= up - TOL, "tp").otherwise(reason)
    if sl is not None:
        down = entry * (1.0 + sl)
        price = F.when(lo <= down + TOL, F.when(o <= down + TOL, o).otherwise(down)).otherwise(price)
        reason = F.when(lo <= down + TOL, "sl").otherwise(reason)
    return price, reason


def outcomes(entries: DataFrame, bars: DataFrame, rule: ExitRule, keys: tuple[str, ...] = ("sym", "sig_pos")) -> DataFrame:
    """Exit of every entry: first row with a trigger that is not locked at its down limit, else incomplete.

    ``entries`` needs keys, status, entry_pos and entry_price (NULL unless entered). Columns ``tp`` and ``sl`` of
    the bars replace the rule's barriers row by row. Adds exit_pos, exit_reason, exit_price, net_ret, held, and final status.
    """
    sized = _entered(entries, rule)
    has_bands = "tp" in bars.columns

    def barrier(name: str, prefix: str) -> Column | None:
        if has_bands:
            return F.col(prefix + name)
        level = getattr(rule, name)
        return None if level is None else F.lit(level)

    ahead = sellable_ahead(bars)
    live = sized.where("status = 'entered'")
    # At the horizon: the first free row from there on.
    late = ahead.select("sym", F.col("pos").alias("_due"), F.col("next_free").alias("nf"))
    live = shuffled_join(live.withColumn("_due", F.col("entry_pos") + rule.horizon - 1), late, ["sym", "_due"], "left")
    price, reason = _exit_price("nf.", F.col("entry_price"), barrier("tp", "nf."), barrier("sl", "nf."), F.lit(True))
    live = live.withColumns({"_lp": F.when(F.col("nf").isNotNull(), price), "_lr": F.when(F.col("nf").isNotNull(), reason)})
    if (has_bands or rule.tp is not None or rule.sl is not None) and rule.horizon > 2:
        cols = ["d", "open", "high", "low", "close", "free", *(["tp", "sl"] if has_bands else [])]
        wanted = live.select(*dict.fromkeys(["sym", *keys, "entry_pos", "entry_price"]))
        path = bars_after(wanted, ahead, cols, 1, rule.horizon - 2, sig="entry_pos")
        p, why = _exit_price("x_", F.col("entry_price"), barrier("tp", "x_"), barrier("sl", "x_"), F.lit(False))
        path = path.withColumns({"_p": p, "_why": why})
        found = F.struct(F.col("step"), F.col("x_d").alias("d"), F.col("_p").alias("p"), F.col("_why").alias("why"))
        first = path.groupBy(*keys).agg(F.min(F.when(F.col("_p").isNotNull() & F.col("x_free"), found)).alias("_early"))
        live = shuffled_join(live, first, list(keys), "left")
    else:
        live = live.withColumn("_early", F.expr("cast(null as struct<step:int,d:date,p:double,why:string>)"))
    e = F.col("_early")
    live = live.select(
        *keys,
        F.coalesce(F.col("entry_pos") + e["step"], F.col("nf.pos")).alias("exit_pos"),
        F.coalesce(e["d"], F.col("nf.d")).alias("exit_d"),
        F.coalesce(e["why"], F.col("_lr")).alias("exit_reason"),
        (F.coalesce(e["p"], F.col("_lp")) * (1.0 - SLIPPAGE)).alias("exit_price"),
    )
    return settled(sized, live, keys)


def settled(sized: DataFrame, exits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Fees, net result and final status of sized entries with their exits (exit_pos, exit_d, exit_reason, exit_price)."""
    out = shuffled_join(sized, exits, list(keys), "left")
    amount = F.col("shares") * F.col("exit_price")
    fees = F.col("buy_fee") + commission(amount) + amount * stamp_rate("exit_d")
    paid = F.col("shares") * F.col("entry_price") + F.col("buy_fee")
    pnl = F.when(F.col("exit_pos").isNotNull(), amount - F.col("shares") * F.col("entry_price") - fees)
    status = (
        F.when(F.col("status") != "entered", F.col("status")).when(F.col("exit_pos").isNotNull(), "closed").otherwise("incomplete")
    )
    return out.withColumns(
        {"status": status, "net_pnl": pnl, "net_ret": pnl / paid, "held": F.col("exit_pos") - F.col("entry_pos") + 1}
    )


def next_open_exit(entries: DataFrame, bars: DataFrame, rule: ExitRule, keys: tuple[str, ...]) -> DataFrame:
    """Sell at the open of the first later row that does not close at its down limit."""
    sized = _entered(entries, rule)
    late = sellable_ahead(bars).select("sym", F.col("pos").alias("_due"), F.col("next_free").alias("nf"))
    live = shuffled_join(sized.where("status = 'entered'").withColumn("_due", F.col("entry_pos") + 1), late, ["sym", "_due"], "left")
    live = live.withColumns(
        {"exit_pos": F.col("nf.pos"), "exit_d": F.col("nf.d"), "exit_price": F.col("nf.open") * (1.0 - SLIPPAGE), "exit_reason": F.lit("next_open")}
    )
    amount = F.col("shares") * F.col("exit_price")
    pnl = amount - F.col("shares") * F.col("entry_price") - F.col("buy_fee") - commission(amount) - amount * stamp_rate("exit_d")
    paid = F.col("shares") * F.col("entry_price") + F.col("buy_fee")
    status = F.when(F.col("exit_pos").isNotNull(), "closed").otherwise("incomplete")
    return live.withColumns({"status": status, "net_pnl": pnl, "net_ret": F.when(F.col("exit_pos").isNotNull(), pnl / paid)}).drop("nf", "_due")


def eve_entries(candidates: DataFrame, bars: DataFrame, design: str) -> DataFrame:
    """Enter on the target row of an eve candidate, at the open or by a limit at the cross price.

    ``confirmed`` tells whether that row's close really crossed.
    """
    at = bars.select("sym", F.col("pos").cast("long").alias("target_pos"), "open", "low", "close", "up_limit")
    out = shuffled_join(candidates.withColumn("target_pos", F.col("target_pos").cast("long")), at, ["sym", "target_pos"], "left")
    locked = F.coalesce(F.col("open") >= F.col("up_limit") - TOL, F.lit(False))
    if design == "open":
        price = F.col("open") * (1.0 + SLIPPAGE)
        status = F.when(F.col("open").isNull(), "dropped_no_quote").when(locked, "dropped_limitup").otherwise("entered")
    else:
        price = F.when(F.col("open") <= F.col("c_star"), F.col("open")).when(F.col("low") <= F.col("c_star"), F.col("c_star"))
        status = F.when(F.col("open").isNull(), "dropped_no_quote").when(locked | price.isNull(), "unfilled").otherwise("entered")
    return out.withColumns(
        {"status": status, "entry_price": price, "entry_pos": F.col("target_pos"), "confirmed": F.col("close") > F.col("c_star")}
    ).drop("open", "low", "close", "up_limit")


def volatility_bands(bars: DataFrame, rule: ExitRule, low: float, high: float, low_tp: float, high_tp: float, high_sl: float) -> DataFrame:
    """Barrier columns per row from the row before: the symbol's ATR over the market's mean ATR that day.

    At or above ``high`` both barriers widen, at or below ``low`` only the target changes, else the rule holds.
    """
    market = bars.where("atr > 0").groupBy("d").agg(F.avg("atr").alias("_mkt"))
    out = bars.join(F.broadcast(market), "d", "left").withColumn("_k", sdiv(F.when(F.col("atr") > 0, F.col("atr")), "_mkt"))
    k = F.coalesce(B.ref("_k", 1), F.lit(1.0))
    return out.withColumns(
        {
            "tp": F.when(k >= high, rule.tp * high_tp).when(k <= low, rule.tp * low_tp).otherwise(rule.tp),
            "sl": F.when(k >= high, rule.sl * high_sl).otherwise(rule.sl),
        }
    ).drop("_k", "_mkt")


def benchmark_excess(outcome: DataFrame, bench: DataFrame, entry_d: str, exit_d: str, ret: str) -> DataFrame:
    """Return minus the benchmark's over the same days; the benchmark has one row per calendar day."""
    start = bench.select(F.col("d").alias(entry_d), F.col("close").alias("_b0"))
    stop = bench.select(F.col("d").alias(exit_d), F.col("close").alias("_b1"))
    out = outcome.join(F.broadcast(start), entry_d, "left").join(F.broadcast(stop), exit_d, "left")
    return out.withColumn("excess", F.col(ret) - (sdiv("_b1", "_b0") - 1.0)).drop("_b0", "_b1")
