"""The daily indicator pipeline with its lags and cross-section columns, computed over the whole history at once.

``indicators`` adds the base indicators, ``advanced``, ``alpha``, ``structure`` and ``lags`` build on them, and
``cross_section`` ranks any chosen columns by date. All windows are per symbol and look back only. The pipeline's
conventions on short windows (0, 1 or NULL) are kept per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.features.indicators import stochastic
from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import sdiv
from barloom.operators.cross_section import add_pct_rank, largest_group, robust_z
from barloom.operators.sequential import add_recursions, atr, ema, macd, rsi
from barloom.session import by_series

# Fixed values of the pipeline.
LAGS = (3, 5, 10, 15, 20, 25, 30)
VOLATILITY_WINDOWS = (3, 5, 10, 15, 20, 25, 30)
MIN_ROWS = 35
EPS = 1e-9
LN2 = math.log(2.0)


def c(name: str) -> Column:
    return F.col(name)


def one(cond: Column) -> Column:
    """1 where the condition is known to hold, else 0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def loose_slope(x: Column | str, w: int) -> Column:
    """Slope over up to ``w`` rows once two are there, 0 before."""
    frame = B.last(w)
    return F.coalesce(F.regr_slope(c(x) if isinstance(x, str) else x, c("pos").cast("double")).over(frame), F.lit(0.0))


def full_slope(x: str, w: int) -> Column:
    return F.coalesce(B.slope(x, w), F.lit(0.0))


def indicators(adj: DataFrame) -> DataFrame:
    """MACD (hist not doubled), RSI 6/14/24, means, bands, volume mean, OBV, ATR, stochastic; NULL for short series."""
    panel = add_recursions(
        adj,
        [macd("close", "_"), rsi("close", 6, "rsi_6"), rsi("close", 14, "rsi_14"), rsi("close", 24, "rsi_24"), atr("high", "low", "close", 14, "atr"),
         ema("close", 10, "close_smooth_10", 1)],
    )
    panel = by_series(panel).withColumns({"_size": F.count(F.lit(1)).over(Window.partitionBy(*B.keys))})
    enough = c("_size") >= MIN_ROWS
    panel = stochastic(panel)
    mid, spread = B.agg("mean", "close", 5), B.agg("pstd", "close", 5)
    made = {
        "macd": c("_dif"), "macd_signal": c("_dea"), "macd_hist": c("_dif") - c("_dea"),
        "rsi_6": c("rsi_6"), "rsi_14": c("rsi_14"), "rsi_24": c("rsi_24"),
        "ma_5": B.agg("mean", "close", 5), "ma_20": B.agg("mean", "close", 20), "ma_60": B.agg("mean", "close", 60),
        "bb_upper": mid + 2.0 * spread, "bb_middle": mid, "bb_lower": mid - 2.0 * spread,
        "volume_ma_20": B.agg("mean", "vol", 20), "obv": B.obv("close", "vol"), "atr": c("atr"),
        "slowk": F.when(c("pos") >= 9, c("slowk")), "slowd": F.when(c("pos") >= 9, c("slowd")),
    }
    panel = panel.withColumns({n: F.when(enough, e) for n, e in made.items()})
    return panel.drop("_dif", "_dea", "_e12", "_e26", "_size", "fastk")


def macd_columns(df: DataFrame) -> DataFrame:
    """Trend, crosses, amplitude, direction and convergence of the MACD; unknown values count as 0."""
    df = df.withColumns({"_h": F.coalesce("macd_hist", F.lit(0.0)), "_m": F.coalesce("macd", F.lit(0.0)), "_s": F.coalesce("macd_signal", F.lit(0.0))})
    pm, ps = B.ref("_m", 1), B.ref("_s", 1)
    df = df.withColumn("macd_signal_convergence", c("_m") - c("_s"))
    up, down = (pm <= 0) & (c("_m") > 0), (pm >= 0) & (c("_m") < 0)
    return df.withColumns(
        {
            "macd_hist_trend_5": F.when(c("pos") >= 2, loose_slope("_h", 6)).otherwise(0.0),
            "macd_golden_cross": one((pm < ps) & (c("_m") > c("_s"))),
            "macd_death_cross": one((pm > ps) & (c("_m") < c("_s"))),
            "macd_zero_cross_up": one(up), "macd_zero_cross_down": one(down), "macd_zero_cross": one(up | down),
            "macd_hist_amplitude": F.max("_h").over(B.last(20)) - F.min("_h").over(B.last(20)),
            "macd_hist_direction": F.signum("_h"),
            "macd_hist_acceleration": B.diff2("_h"),
            "macd_signal_convergence_trend": F.when(c("pos") >= 2, loose_slope("macd_signal_convergence", 5)).otherwise(0.0),
        }
    ).drop("_h", "_m", "_s")


def volume_columns(df: DataFrame) -> DataFrame:
    # Volumes of a short window give 0 here; a zero mean gives 0 as well.
    mean6 = B.agg("mean", "vol", 6)
    return df.withColumns(
        {
            "volume_trend_5": full_slope("vol", 6), "volume_trend_10": full_slope("vol", 11), "price_trend_5": full_slope("close", 6),
            "volume_consistency": F.coalesce(F.when(mean6 > 0, B.agg("std", "vol", 6) / mean6), F.lit(0.0)),
            "volume_ma_ratio": F.coalesce(
                F.when(
                    (F.count("vol").over(B.rows(-10, -1)) == 10) & (F.avg("vol").over(B.rows(-10, -1)) > 0),
                    F.avg("vol").over(B.rows(-5, -1)) / F.avg("vol").over(B.rows(-10, -1)),
                ),
                F.lit(1.0),
            ),
            "obv_trend": full_slope("obv", 6),
        }
    )


def rsi_columns(df: DataFrame) -> DataFrame:
    df = df.withColumn("_d1", B.delta("rsi_14", 1))
    p1, p2 = B.ref("rsi_14", 1), B.ref("rsi_14", 2)
    turned = ((p1 > p2) & (c("rsi_14") < p1)) | ((p1 < p2) & (c("rsi_14") > p1))
    df = df.withColumns(
        {"rsi_momentum": F.coalesce("_d1", F.lit(0.0)), "rsi_turning_simple": one(B.ref("_d1", 1) * c("_d1") < 0), "rsi_turning": one(turned)}
    )
    for n in (6, 14, 24):
        df = df.withColumns({f"rsi_oversold_{n}": one(c(f"rsi_{n}") < 30), f"rsi_overbought_{n}": one(c(f"rsi_{n}") > 70)})
    return df.drop("_d1")


def volatility_columns(df: DataFrame) -> DataFrame:
    """Annualised standard deviation of log returns over several windows, 0 while a window is short."""
    df = df.withColumn("_lr", F.log(sdiv("close", B.ref("close", 1))))
    df = df.withColumns({f"volatility_{w}d": F.coalesce(B.agg("std", "_lr", w) * math.sqrt(252.0), F.lit(0.0)) for w in VOLATILITY_WINDOWS})
    return df.drop("_lr")


def advanced(df: DataFrame) -> DataFrame:
    """Distances to means and bands, spikes, candles, liquidity columns."""
    df = rsi_columns(volatility_columns(volume_columns(macd_columns(df))))
    o, h, lo, cl, v = (c(x) for x in ("open", "high", "low", "close", "vol"))
    body, span = F.abs(cl - o), h - lo
    lower, upper = F.least(o, cl) - lo, h - F.greatest(o, cl)
    ma20v = F.avg("vol").over(B.last(20))
    width = c("bb_upper") - c("bb_lower")
    support, resist = F.min("low").over(B.last(20)), F.max("high").over(B.last(20))
    pc, po = B.ref("close", 1), B.ref("open", 1)
    engulf = ((pc < po) & (cl > o) & (o <= pc) & (cl >= po)) | ((pc > po) & (cl < o) & (o >= pc) & (cl <= po))
    hammer = (span != 0) & (lower >= 2.0 * body) & (upper <= 0.5 * body) & (lower >= 0.6 * span)
    falling = B.agg("mean", "close", 5) < B.agg("mean", "close", 10)
    df = df.withColumns({"volume_ma20": ma20v, "_peak": F.max("close").over(B.last(20)), "_dv": B.delta("vol", 1), "_dc": B.delta("close", 1), "_v5": F.avg("vol").over(B.last(5))})
    ratio = F.when(c("volume_ma20") > 0, v / c("volume_ma20")).otherwise(1.0)
    df = df.withColumn("volume_ratio", ratio)
    return df.withColumns(
        {
            **{f"price_vs_ma{n}": sdiv("close", f"ma_{n}") - 1.0 for n in (5, 20, 60)},
            "ma_arrangement": F.when((c("ma_5") > c("ma_20")) & (c("ma_20") > c("ma_60")), 1.0).when((c("ma_5") < c("ma_20")) & (c("ma_20") < c("ma_60")), -1.0).otherwise(0.0),
            "bb_position": F.when(width > 0, (cl - c("bb_lower")) / width).otherwise(0.5),
            "bb_squeeze": one(sdiv(width, cl) < 0.05),
            "macd_signal_distance": c("macd") - c("macd_signal"), "macd_above_signal": one(c("macd") - c("macd_signal") > 0),
            "volume_spike": one(c("volume_ratio") > 2.0), "volume_dryup": one(c("volume_ratio") < 0.5),
            "atr_ratio": F.when(cl > 0, c("atr") / cl).otherwise(0.0),
            "hammer_pattern": one(hammer), "doji_pattern": one((span != 0) & (body < 0.1 * span)), "engulfing_pattern": one(engulf),
            "downtrend": one(falling), "hammer_signal": one(hammer & falling),
            "distance_to_support": F.when(cl > 0, (cl - support) / cl).otherwise(0.0), "distance_to_resistance": F.when(cl > 0, (resist - cl) / cl).otherwise(0.0),
            "stoch_oversold": one(c("slowk") < 20), "stoch_overbought": one(c("slowd") > 80),
            "macd_percentile": B.percentile_of_previous("macd", 100),
            "signed_volume_strength": c("volume_ratio") * sdiv(cl - o, o),
            "close_vs_high": sdiv(h - cl, span),
            "amihud_illiq_intraday": F.when(v * cl > 0, F.abs(cl / o - 1.0) / (v * cl)).otherwise(0.0),
            "hl_spread": F.when(h + lo > 0, span / ((h + lo) / 2.0)).otherwise(0.0),
            "effective_spread": F.when(cl > 0, span / cl).otherwise(0.0),
            "alpha12": F.signum("_dv") * (-1.0 * c("_dc")),
            "price_volume_divergence": one((cl == c("_peak")) & (v < c("volume_ma20"))),
            "volume_momentum": F.when(c("volume_ma20") > 0, (c("_v5") - c("volume_ma20")) / c("volume_ma20")).otherwise(0.0),
            "price_impact": F.when(v > 0, F.abs(cl - o) / F.sqrt(v)).otherwise(0.0),
        }
    ).drop("_peak", "_dv", "_dc", "_v5")


def alpha(df: DataFrame, ranks: bool = True, day_rows: int | None = None) -> DataFrame:
    """Candle position, signed strength, price-volume correlation, distance to the 60-row high, same-date ranks.

    ``day_rows`` is the largest number of symbols on one date, if known (else it is counted here).
    """
    o, h, lo, cl, v = (c(x) for x in ("open", "high", "low", "close", "vol"))
    span = h - lo
    df = df.withColumns(
        {
            "pct_change": sdiv(cl, B.ref("close", 1)) - 1.0,
            "clv": (cl - lo) / (span + EPS),
            "upper_shadow_ratio": F.when(h == lo, 0.0).otherwise((h - F.greatest(o, cl)) / (span + EPS)),
            "body_strength": (cl - o) / (span + EPS),
            "signed_vol_strength": v * F.signum(cl - o),
            "pv_corr_10": F.when(c("pos") > 10, B.corr("close", "vol", 10)),
            "dist_to_high_60": cl / (B.agg("max", "close", 60) + EPS),
            "_sd5": B.agg("std", "close", 5), "_sd60": B.agg("std", "close", 60),
        }
    )
    df = df.withColumn("vol_divergence", c("_sd5") / (F.avg("_sd60").over(B.last(60)) + EPS)).drop("_sd5", "_sd60")
    if ranks:
        day_rows = largest_group(df, ["d"]) if day_rows is None else day_rows
        df = add_pct_rank(df, ["d"], "pct_change", "rank_return", group_rows=day_rows)
        df = add_pct_rank(df, ["d"], "vol", "rank_volume", group_rows=day_rows)
    names = ["pct_change", "clv", "upper_shadow_ratio", "body_strength", "signed_vol_strength", "pv_corr_10", "dist_to_high_60", "vol_divergence"]
    names += ["rank_return", "rank_volume"] if ranks else []
    return df.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def structure(df: DataFrame) -> DataFrame:
    """Range volatility, illiquidity, efficiency, overnight and intraday returns, robust z of RSI and MACD."""
    o, h, lo, cl, v = (c(x) for x in ("open", "high", "low", "close", "vol"))
    lhl, lco = F.log(h / (lo + EPS)), F.log(cl / (o + EPS))
    gk = 0.5 * lhl * lhl - (2.0 * LN2 - 1.0) * lco * lco
    flat = h == lo
    df = df.withColumns(
        {
            "vol_gk": F.sqrt(F.when(gk >= 0, gk)), "_pc": sdiv(cl, B.ref("close", 1)) - 1.0, "_move": F.abs(B.delta("close", 1)),
            "ret_overnight": sdiv(o, B.ref("close", 1)) - 1.0, "ret_intraday": sdiv(cl, o) - 1.0,
            "high_mean_20": B.agg("mean", "high", 20), "low_mean_20": B.agg("mean", "low", 20),
        }
    )
    return df.withColumns(
        {
            "vol_gk_ratio": sdiv("vol_gk", B.agg("mean", "vol_gk", 20)),
            "illiq": F.log(F.abs("_pc") / (cl * v + EPS) + 1.0),
            "efficiency_ratio": F.abs(cl - B.ref("close", 10)) / (B.agg("sum", "_move", 10) + EPS),
            "intraday_pos": F.when(flat, F.when(cl >= o, 1.0).otherwise(0.0)).otherwise((cl - lo) / (h - lo + EPS)),
            "smart_money_diff": c("ret_intraday") - c("ret_overnight"),
            "support_resistance_ratio": sdiv("high_mean_20", "low_mean_20"),
            "log_volume": F.log1p(v), "boxcox_atr": F.log1p(F.when(c("atr") < EPS, EPS).otherwise(c("atr"))),
            "rsi_robust": B.robust_z("rsi_14", 100), "macd_robust": B.robust_z("macd", 100),
        }
    ).drop("_pc", "_move")


def lags(df: DataFrame) -> DataFrame:
    """Shifted prices, returns, amplitudes and structure columns."""
    df = df.withColumns({"daily_return": sdiv("close", B.ref("close", 1)) - 1.0, "amplitude": sdiv(c("high") - c("low"), "low")})
    plan: dict[str, Sequence[int]] = {x: LAGS for x in ("close", "open", "high", "low", "vol")}
    plan |= {"amplitude": (1, 3, 5), "vol_gk": (1, 3, 5, 10), "vol_gk_ratio": (1, 3, 5, 10), "intraday_pos": (1, 2, 3)}
    plan |= {x: (1, 3, 5) for x in ("illiq", "efficiency_ratio", "smart_money_diff", "ret_overnight", "ret_intraday", "support_resistance_ratio")}
    made = {f"{x}_lag_{k}": B.ref(x, k) for x, ks in plan.items() for k in ks}
    made |= {f"return_lag_{k}": B.ref("daily_return", k) for k in (1, 2, 3, 5, 10, 20)}
    return df.withColumns(made)


def pipeline(adj: DataFrame, min_rows: int = 100) -> DataFrame:
    """The whole chain per symbol; symbols with fewer than ``min_rows`` rows are left out."""
    long_enough = adj.groupBy("sym").count().where(F.col("count") >= min_rows).select("sym")
    kept = adj.join(long_enough, "sym", "left_semi")
    return lags(structure(alpha(advanced(indicators(kept)), day_rows=largest_group(adj, ["d"]))))


def cross_section(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """cs_n and, per chosen column, its percent rank and robust z on the date. Call it in column chunks."""
    rows = largest_group(df, ["d"])
    sizes = df.groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("cs_n"))
    out = df.join(sizes, "d")
    for x in columns:
        out = robust_z(add_pct_rank(out, ["d"], x, f"{x}_rankpct", group_rows=rows), ["d"], x, f"{x}_z", rows)
    return out


# Values used on days without an index row.
MARKET_DEFAULTS = {"price_change": 0.0, "amplitude": 0.02, "volume_ratio": 1.0, "price_change_abs": 0.0, "price_wave_abs": 0.02, "sentiment": 1.0, "volume_signal": 0.0}


def market_columns(days: DataFrame, first: DataFrame, second: DataFrame, a: str, b: str) -> DataFrame:
    """Two index families on the wanted days with defaults for missing rows, and their joint mood."""
    out = days.select("d")
    for index, p in ((first, a), (second, b)):
        pc, amp = sdiv(c("close") - c("open"), "open"), sdiv(c("high") - c("low"), "low")
        mean = F.avg("vol").over(B.last(20))
        full = F.count("vol").over(B.last(20)) == 20
        one_index = index.select("sym", "d", pc.alias("pc"), amp.alias("amp"), F.when(full, F.coalesce(sdiv("vol", mean), F.lit(1.0))).otherwise(1.0).alias("vr"))
        mood = F.when((c("pc") > 0.01) & (c("amp") < 0.02), 2.0).when((c("pc") < -0.01) & (c("amp") > 0.03), 0.0).otherwise(1.0)
        cols = {
            "price_change": c("pc"), "amplitude": c("amp"), "volume_ratio": c("vr"), "price_change_abs": F.abs("pc"), "price_wave_abs": c("amp"),
            "sentiment": mood, "volume_signal": (c("vr") > 1.2).cast("double"),
        }
        out = out.join(one_index.select("d", *[e.alias(f"{p}_{n}") for n, e in cols.items()]), "d", "left")
        out = out.withColumns({f"{p}_{n}": F.coalesce(f"{p}_{n}", F.lit(v)) for n, v in MARKET_DEFAULTS.items()})
    pa, pb, wa, wb = c(f"{a}_price_change"), c(f"{b}_price_change"), c(f"{a}_amplitude"), c(f"{b}_amplitude")
    change, amplitude = (pa + pb) / 2.0, (wa + wb) / 2.0
    return out.withColumns(
        {
            "sync_direction": (pa * pb > 0).cast("double"), "sync_strength": F.abs(pa - pb),
            "market_sentiment": F.when((change > 0.01) & (amplitude < 0.02), 2.0).when((change < -0.01) & (amplitude > 0.03), 0.0).otherwise(1.0),
            "market_avg_change": change, "market_avg_amplitude": amplitude, "market_sync_score": 1.0 - F.least(F.lit(1.0), F.abs(pa - pb) / 0.02),
        }
    )
