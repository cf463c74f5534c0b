"""Date-level features: breadth, regime, index state, exposure rules.

Panels are aggregated to one row per day first; the windows without a key that follow see at most one row per
calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.rolling import Layout
from barloom.functions.scalar import flag, sdiv
from barloom.operators.cross_section import group_quantiles
from barloom.operators.joins import as_of
from barloom.operators.sequential import add_recursions, rsi

DAYS = Layout(keys=(), order="d")


def market_returns(panel: DataFrame) -> DataFrame:
    """(d, sum_r, n_r): sums that any prefix of days can reuse; the first row of a symbol has no return."""
    r = F.when(F.col("pos") > 1, F.coalesce("r", F.lit(0.0)))
    return panel.select("d", r.alias("_r")).groupBy("d").agg(F.sum("_r").alias("sum_r"), F.count("_r").alias("n_r"))


def regime(returns: DataFrame, window: int = 120, threshold: float = 0.10) -> DataFrame:
    """Equal-weight index and its phase: 1 up, 2 down, 0 sideways, -1 while the window is not full."""
    mean = F.when(F.col("n_r") > 0, F.col("sum_r") / F.col("n_r")).otherwise(0.0)
    out = returns.withColumn("eq_index", F.product(1.0 + mean).over(DAYS.past()))
    move = F.col("eq_index") / DAYS.ref("eq_index", window) - 1.0
    code = F.when(move.isNull(), -1.0).when(move > threshold, 1.0).when(move < -threshold, 2.0).otherwise(0.0)
    return out.withColumn("regime", code)


def breadth(panel: DataFrame, limit_pct: float = 10.0) -> DataFrame:
    """One row per day: advance share, share above the 20-row mean, new lows, limit-ups, amount rank, median return."""
    mean20, low250 = B.agg("mean", "ac", 20), B.agg("min", "al", 250)
    marked = panel.withColumns(
        {
            "_ret5": B.pct_change("cf", 5), "_ret20": B.pct_change("cf", 20), "_above": flag(F.col("ac") > mean20),
            "_low": flag(F.col("al") == low250), "_lu": flag(F.col("pct") >= limit_pct - 0.1),
        }
    )
    daily = marked.groupBy("d").agg(
        F.avg(flag(F.col("_ret5") > 0)).alias("BREADTH_ADV5"), F.avg("_above").alias("BREADTH_ABOVE_MA20"), F.avg("_low").alias("BREADTH_NEWLOW"),
        F.coalesce(F.sum("_lu"), F.lit(0.0)).alias("LIMITUP_N_MKT"), F.sum("amount").alias("_amt"),
    )
    medians = group_quantiles(marked.select("d", "_ret20"), ["d"], "_ret20", {"MKT_MEDIAN_RET20": 0.5})
    daily = daily.join(medians, "d", "left")
    daily = daily.withColumns({"LIMITUP_N_MKT_MA20": DAYS.agg("mean", "LIMITUP_N_MKT", 20), "_amt20": DAYS.agg("mean", "_amt", 20)})
    return daily.withColumn("MKT_AMT_PCT", DAYS.ts_rank("_amt20", 250)).drop("_amt", "_amt20")


def _mood(change: Column, amplitude: Column) -> Column:
    score = F.when((change > 0.01) & (amplitude < 0.02), 2.0).when((change < -0.01) & (amplitude > 0.03), 0.0).otherwise(1.0)
    return F.when(change.isNotNull() & amplitude.isNotNull(), score)


def index_day(index: DataFrame, name: str) -> DataFrame:
    """Day columns of one index, prefixed with its name."""
    change = sdiv(F.col("close") - F.col("open"), "open")
    amplitude = sdiv(F.col("high") - F.col("low"), "low")
    ratio = sdiv("vol", DAYS.agg("mean", "vol", 20))
    out = index.select("d", change.alias("pc"), amplitude.alias("amp"), ratio.alias("vr"))
    pc, amp, vr = F.col("pc"), F.col("amp"), F.col("vr")
    p = f"MKT_{name}_"
    return out.select(
        "d", pc.alias(p + "PRICE_CHANGE"), amp.alias(p + "AMPLITUDE"), vr.alias(p + "VOLUME_RATIO"), F.abs(pc).alias(p + "PRICE_CHANGE_ABS"),
        amp.alias(p + "PRICE_WAVE_ABS"), _mood(pc, amp).alias(p + "SENTIMENT"), flag(vr > 1.2).alias(p + "VOLUME_SIGNAL"),
    )


def two_index_days(first: DataFrame, second: DataFrame, a: str, b: str) -> DataFrame:
    """Both index families on all days of either, plus how far they move together."""
    both = index_day(first, a).join(index_day(second, b), "d", "full")
    pa, pb = F.col(f"MKT_{a}_PRICE_CHANGE"), F.col(f"MKT_{b}_PRICE_CHANGE")
    wa, wb = F.col(f"MKT_{a}_AMPLITUDE"), F.col(f"MKT_{b}_AMPLITUDE")
    change, amplitude, apart = (pa + pb) / 2.0, (wa + wb) / 2.0, F.abs(pa - pb)
    return both.withColumns(
        {
            "MKT_SYNC_DIRECTION": F.when(pa * pb > 0, 1.0).otherwise(0.0),
            "MKT_SYNC_STRENGTH": apart,
            "MKT_SENTIMENT": _mood(change, amplitude),
            "MKT_AVG_CHANGE": change,
            "MKT_AVG_AMP": amplitude,
            "MKT_SYNC_SCORE": F.when(apart.isNotNull(), 1.0 - F.least(apart / 0.02, F.lit(1.0))),
        }
    )


def index_state(index: DataFrame) -> DataFrame:
    """Momentum, distance to the 60-day mean, volatility rank, drawdown and RSI of one index."""
    one = index.select("d", "high", "close").withColumn("sym", F.lit("index"))
    out = add_recursions(one, [rsi("close", 14, "MKT_RSI14")]).drop("sym")
    out = out.withColumn("_r", DAYS.pct_change("close"))
    out = out.withColumn("_vol20", DAYS.agg("std", "_r", 20))
    return out.select(
        "d", (sdiv("close", DAYS.ref("close", 20)) - 1.0).alias("MKT_RET20"), (sdiv("close", DAYS.agg("mean", "close", 60)) - 1.0).alias("MKT_MA60"),
        DAYS.ts_rank("_vol20", 250).alias("MKT_VOL20_PCT"), (sdiv("close", DAYS.agg("max", "high", 120)) - 1.0).alias("MKT_DD120"), "MKT_RSI14",
    )


def market_gates(index: DataFrame) -> DataFrame:
    """Conditions of the index usable as gates: distance to means, slope, volatility tercile in history, drawdown bucket."""
    out = index.select("d", "close").withColumns({f"ma{w}": DAYS.agg("mean", "close", w) for w in (20, 60, 250)})
    out = out.withColumn("_r", DAYS.pct_change("close"))
    out = out.withColumns({"_vol": DAYS.agg("std", "_r", 20), "_peak": F.max("close").over(DAYS.past())})
    seen = F.collect_list("_vol").over(DAYS.past())
    share = F.size(F.filter(seen, lambda v: v <= F.col("_vol"))) / F.size(seen)
    dd = F.col("close") / F.col("_peak") - 1.0
    return out.select(
        "d", *[flag(F.col("close") > F.col(f"ma{w}")).alias(f"above_ma{w}") for w in (20, 60, 250)],
        flag(F.col("ma20") > DAYS.ref("ma20", 5)).alias("ma20_rising"),
        F.when(F.col("_vol").isNotNull(), F.when(share <= 1 / 3, "calm").when(share >= 2 / 3, "wild").otherwise("mid")).alias("vol_tercile"),
        F.when(dd > -0.05, "shallow").when(dd > -0.15, "middle").otherwise("deep").alias("drawdown_bucket"),
    )


def exposure(calendar: DataFrame, index: DataFrame) -> DataFrame:
    """Exposure per calendar day by four rules, using index closes strictly before the day.

    Too short a history means full exposure and is flagged. t1/t2: close above its 200/60-day mean; t3: drawdown
    from the 250-day high; t4: volatility above its own 90% quantile of 250 days.
    """
    rules = index.select("d", "close", DAYS.pos().alias("_n"), DAYS.pct_change("close").alias("_r"))
    rules = rules.withColumn("_vol", DAYS.agg("std", "_r", 20))
    dd = 1.0 - F.col("close") / F.max("close").over(DAYS.last(250))
    q90 = F.when(F.count("_vol").over(DAYS.last(250)) == 250, F.percentile("_vol", F.lit(0.9)).over(DAYS.last(250)))
    rules = rules.select(
        "d",
        F.when(F.col("_n") >= 200, F.when(F.col("close") > F.avg("close").over(DAYS.last(200)), 1.0).otherwise(0.0)).alias("t1"),
        F.when(F.col("_n") >= 60, F.when(F.col("close") > F.avg("close").over(DAYS.last(60)), 1.0).otherwise(0.0)).alias("t2"),
        F.when(F.col("_n") >= 250, F.when(dd < 0.10, 1.0).when(dd <= 0.20, 0.5).otherwise(0.0)).alias("t3"),
        F.when(q90.isNotNull(), F.when(F.col("_vol") > q90, 0.5).otherwise(1.0)).alias("t4"),
    ).withColumn("_k", F.lit(1))
    days = calendar.select("d").withColumn("_k", F.lit(1))
    out = as_of(days, rules, ["_k"], "d", ["t1", "t2", "t3", "t4"], right_day="source_d", strict=True)
    short = [F.col(t).isNull().cast("double").alias(f"{t}_short") for t in ("t1", "t2", "t3", "t4")]
    return out.select("d", "source_d", *[F.coalesce(t, F.lit(1.0)).alias(t) for t in ("t1", "t2", "t3", "t4")], *short)
