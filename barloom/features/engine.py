"""Daily features of one symbol: returns, volatility, liquidity, volume, moments, indicators, trend, limits, candles.

``prepare`` adds the intermediate series every family shares (one pass of windows, one grouped pass for the
recursions), ``REGISTRY`` turns them into features. All of it reads rows up to the current one only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.registry import FeatureRegistry
from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import board_limit, clip, flag, positive, safe_log, safe_log1p, safe_sqrt, sdiv
from barloom.operators.events import candle_flags
from barloom.operators.sequential import add_recursions, atr, kdj, macd, rsi
from barloom.session import by_series

LN2 = math.log(2.0)


def c(name: str) -> Column:
    return F.col(name)


# Families that read a recursion (average true range, MACD, RSI, KDJ).
RECURSIVE = frozenset({"volatility", "indicators"})


def prepare(adj: DataFrame, index_returns: DataFrame | None = None, families=None) -> DataFrame:
    """Adjusted bars plus shared series. ``index_returns`` is (d, RIDX) with one row per calendar day.

    Recursions go first, while rows are narrow, and only when a wanted family reads them; the window columns
    after them that no wanted feature uses are pruned by the optimizer.
    """
    panel = adj
    if families is None or RECURSIVE & set(families):
        panel = panel.withColumns({"low9": B.agg("min", "al", 9), "high9": B.agg("max", "ah", 9)})
        panel = panel.withColumn("rsv9", sdiv(c("ac") - c("low9"), c("high9") - c("low9")))
        panel = by_series(
            add_recursions(panel, [atr("ah", "al", "ac", 14, "atr14"), macd("ac"), rsi("ac", 6, "rsi6"), rsi("ac", 14, "rsi14"), kdj("rsv9")])
        )
        panel = panel.withColumns({"atrp": sdiv("atr14", "ac"), "hist": 2.0 * (c("dif") - c("dea"))})
    if index_returns is None:
        panel = panel.withColumn("RIDX", F.lit(None).cast("double"))
    else:
        panel = panel.join(F.broadcast(index_returns), "d", "left")
    log_hl, log_co = safe_log(sdiv("high", "low")), safe_log(sdiv("close", "open"))
    gk = 0.5 * log_hl * log_hl - (2.0 * LN2 - 1.0) * log_co * log_co
    r = c("r")
    panel = panel.withColumns(
        {
            "ret_on": sdiv("open", "pre_close") - 1.0,
            "ret_id": sdiv("close", "open") - 1.0,
            "amp": sdiv(c("high") - c("low"), "pre_close"),
            "log_hl": log_hl,
            "gk_day": F.when(gk.isNotNull(), F.sqrt(F.greatest(gk, F.lit(0.0)))),
            "illiq_day": sdiv(F.abs("r"), c("amount") * 1000.0),
            "vwap": sdiv("amount", "vol"),
            "hl_ratio": sdiv("high", "low"),
            "vol_chg": sdiv("vol", B.ref("vol", 1)) - 1.0,
            "obv": B.obv("ac", "vol"),
            "is_up": F.coalesce((r > 0).cast("double"), F.lit(0.0)),
            "is_down": F.coalesce((r < 0).cast("double"), F.lit(0.0)),
            "move": B.delta("ac", 1),
            "rr": r * r,
            "lim": board_limit("sym", "d"),
            "mean_c20": B.agg("mean", "ac", 20), "std_c20": B.agg("std", "ac", 20),
            "mv5": B.agg("mean", "vol", 5), "mv20": B.agg("mean", "vol", 20), "mv60": B.agg("mean", "vol", 60),
            "vol5": B.agg("std", "r", 5), "vol60": B.agg("std", "r", 60),
            "ma_amt5": B.agg("mean", "amount", 5),
            "known20": F.count("r").over(B.last(20)) == 20,
            "cpv10": B.corr("ac", "vol", 10),
            "log_ac": safe_log("ac"),
        }
    )
    theta = 2.0 * c("vol60")
    panel = panel.withColumns(
        {
            "bbw": sdiv(4.0 * c("std_c20"), "mean_c20"),
            "gk20": B.agg("mean", "gk_day", 20),
            "lu": flag(c("pct") >= c("lim") - 0.1), "ld": flag(c("pct") <= -(c("lim") - 0.1)),
            "gap_hit": F.coalesce(B.ref("ret_id", 1) < -0.02, F.lit(False)),
            "jump_up": F.when(theta.isNotNull(), F.when(c("r") > theta, c("rr")).otherwise(0.0)),
            "jump_dn": F.when(theta.isNotNull(), F.when(c("r") < -theta, c("rr")).otherwise(0.0)),
            "jump": flag(F.abs("r") > theta),
        }
    )
    return candle_flags(panel)


REGISTRY = FeatureRegistry()
PRICE, PRICE_VOL = "open high low close pre_close pct", "open high low close pre_close pct vol amount"


def _z(x: str, mean: Column, std: Column) -> Column:
    return sdiv(c(x) - mean, std)


def _returns() -> dict:
    def since_gap() -> Column:
        hits = B.agg("sum", c("gap_hit").cast("double"), 20)
        return sdiv(B.conditional("sum", c("gap_hit"), "ret_on", 20), positive(hits))

    ret20 = lambda: B.pct_change("cf", 20)
    up, dn = lambda: B.agg("sum", "is_up", 20), lambda: B.agg("sum", "is_down", 20)
    return {
        "RET1": lambda: c("r"),
        **{f"RET{w}": (lambda w=w: B.pct_change("cf", w)) for w in (5, 10, 20, 60)},
        "RET120_20": lambda: sdiv(B.ref("cf", 20), B.ref("cf", 240)) - 1.0,
        "RET_ON": lambda: c("ret_on"),
        "RET_ID": lambda: c("ret_id"),
        "CUMON20": lambda: B.agg("sum", safe_log1p("ret_on"), 20),
        "CUMID20": lambda: B.agg("sum", safe_log1p("ret_id"), 20),
        "GAP_MEAN20": lambda: B.agg("mean", "ret_on", 20),
        "GAP_VOL20": lambda: B.agg("std", "ret_on", 20),
        "INFO_DISC20": lambda: F.when(c("known20"), F.signum(ret20()) * (dn() - up()) / 20.0),
        "CNTD20": lambda: F.when(c("known20"), (up() - dn()) / 20.0),
        "T1_GAP": since_gap,
    }


def _volatility() -> dict:
    return {
        **{f"VOL{w}": (lambda w=w: B.agg("std", "r", w)) for w in (5, 15, 20, 60)},
        "DVOL": lambda: c("vol5") - c("vol60"),
        "AMP1": lambda: c("amp"),
        "AMP20": lambda: B.agg("mean", "amp", 20),
        "ATRN": lambda: c("atrp"),
        "VOL_CONTRACTION60": lambda: sdiv("atrp", B.ref("atrp", 60)),
        "PARK20": lambda: safe_sqrt(B.agg("sum", c("log_hl") * c("log_hl"), 20) / (4.0 * LN2 * 20.0)),
        "GK_VOL": lambda: c("gk20"),
        "GK_VOL_RATIO": lambda: sdiv("gk20", B.agg("mean", "gk20", 20)),
        "BOLL_SQUEEZE": lambda: flag(c("bbw") < 0.05),
        "BBW_PCTILE250": lambda: B.ts_rank("bbw", 250),
        "IVOL60": lambda: B.residual_std("r", "RIDX", 60),
    }


def _liquidity() -> dict:
    return {
        "ILLIQ20": lambda: F.log(B.agg("mean", "illiq_day", 20) + 1e-30),
        "AMT20": lambda: safe_log(B.agg("mean", "amount", 20)),
        "AMIHUD_INTRADAY": lambda: sdiv(F.abs("ret_id"), c("vol") * c("close")),
        "HL_SPREAD": lambda: sdiv(c("high") - c("low"), (c("high") + c("low")) / 2.0),
        "PRICE_IMPACT": lambda: sdiv(F.abs(c("close") - c("open")), F.sqrt(positive("vol"))),
        "LOG_PRICE": lambda: safe_log("close"),
    }


def _volume() -> dict:
    def up_down() -> Column:
        n_up = B.conditional("count", c("r") > 0, "vol", 20)
        n_dn = B.conditional("count", c("r") < 0, "vol", 20)
        ratio = sdiv(B.conditional("mean", c("r") > 0, "vol", 20), B.conditional("mean", c("r") < 0, "vol", 20))
        return F.when((n_up >= 5) & (n_dn >= 1) & c("known20"), ratio)

    def shrink() -> Column:
        down_vol = F.when(c("r") < 0, c("vol"))
        return sdiv(F.avg(down_vol).over(B.last(10)), F.avg(down_vol).over(B.rows(-19, -10)))

    def dryup() -> Column:
        q10 = B.quantile("mv5", 250, 0.1)
        return flag(c("mv5") < q10)

    return {
        "VR5_60": lambda: sdiv("mv5", "mv60"),
        "VR1_20": lambda: sdiv("vol", "mv20"),
        "VOL_MOM": lambda: sdiv(c("mv5") - c("mv20"), "mv20"),
        "VMA5": lambda: sdiv("vol", "mv5"),
        "VSTD20": lambda: sdiv(B.agg("std", "vol", 20), c("mv20") + 1.0),
        "VOLUME_TREND10": lambda: sdiv(B.slope("vol", 10), "mv20"),
        "OBV_TREND": lambda: sdiv(B.slope("obv", 5), "mv20"),
        "OBV_DIV": lambda: _z("ac", c("mean_c20"), c("std_c20")) - _z("obv", B.agg("mean", "obv", 20), B.agg("std", "obv", 20)),
        "PVR20": up_down,
        "VSHRINK": shrink,
        "VOL_DRYUP_EXTREME": dryup,
        "AMT_SHRINK_PEAK": lambda: sdiv("ma_amt5", B.agg("max", "ma_amt5", 120)),
    }


def _price_volume() -> dict:
    return {
        "CPV10": lambda: c("cpv10"),
        "CPV20": lambda: B.corr("ac", "vol", 20),
        "CPV_VWAP10": lambda: -B.corr("vwap", "vol", 10),
        "HLV_DIV10": lambda: -B.corr("hl_ratio", "vol", 10),
        "RVC20": lambda: B.corr("r", "vol_chg", 20),
        "CPV_TREND": lambda: B.slope("cpv10", 10),
    }


def _moments() -> dict:
    return {
        "MAX20": lambda: B.agg("max", "r", 20),
        "MIN20": lambda: B.agg("min", "r", 20),
        "MAX5_20": lambda: B.topk_mean("r", 20, 5),
        "SKEW60": lambda: B.skew_unbiased("r", 60),
        "KURT60": lambda: B.kurt_unbiased("r", 60),
        "IVOV60": lambda: B.agg("std", "vol5", 60),
        "DSR20": lambda: sdiv(B.agg("sum", F.when(c("r") < 0, c("rr")).otherwise(0.0), 20), B.agg("sum", "rr", 20)),
        "SJV60": lambda: B.agg("sum", "jump_up", 60) - B.agg("sum", "jump_dn", 60),
        "JUMPFREQ60": lambda: B.agg("mean", "jump", 60),
    }


def _indicators() -> dict:
    prev_dif, prev_dea = lambda: B.ref("dif", 1), lambda: B.ref("dea", 1)

    def zero_cross() -> Column:
        p = prev_dif()
        cross = F.when((c("dif") > 0) & (p <= 0), 1.0).when((c("dif") < 0) & (p >= 0), -1.0).otherwise(0.0)
        return F.when(c("dif").isNotNull() & p.isNotNull(), cross)

    def golden() -> Column:
        hit = F.coalesce((c("dif") > c("dea")) & (prev_dif() <= prev_dea()), F.lit(False))
        return F.when(c("dif").isNotNull() & c("dea").isNotNull(), hit.cast("double"))

    def balance() -> Column:
        up = B.agg("sum", F.when(c("r") > 0, c("r")).otherwise(0.0), 20)
        dn = B.agg("sum", F.when(c("r") < 0, -c("r")).otherwise(0.0), 20)
        return F.when(c("known20"), sdiv(up - dn, B.agg("sum", F.abs("r"), 20)))

    since_low, since_high = lambda: B.since_extreme("al", 20, "min"), lambda: B.since_extreme("ah", 20, "max")
    return {
        "MACD_DIF_NORM": lambda: sdiv("dif", c("ac") * c("atrp")),
        "MACD_HIST": lambda: c("hist"),
        "MACD_HIST_SLOPE5": lambda: B.slope("hist", 5),
        "MACD_ZERO_CROSS": zero_cross,
        "MACD_GOLDEN_CROSS": golden,
        "MACD_HIST_AMP20": lambda: B.agg("max", "hist", 20) - B.agg("min", "hist", 20),
        "RSI6": lambda: c("rsi6"),
        "RSI14": lambda: c("rsi14"),
        "RSI_OVERSOLD_DAYS": lambda: B.streak(c("rsi14") < 30),
        "BIAS20": lambda: sdiv("ac", "mean_c20") - 1.0,
        "BIAS60": lambda: sdiv("ac", B.agg("mean", "ac", 60)) - 1.0,
        "PCTB": lambda: sdiv(c("ac") - c("mean_c20"), 2.0 * c("std_c20")),
        "RSV9": lambda: c("rsv9"),
        "KDJ_K": lambda: c("kdj_k"),
        "KDJ_D": lambda: c("kdj_d"),
        "KDJ_J": lambda: c("kdj_j"),
        "TSRANK20": lambda: B.ts_rank("ac", 20),
        "IMIN20": lambda: since_low() / 20.0,
        "IMXD20": lambda: (since_high() - since_low()) / 20.0,
        "SUMD20": balance,
    }


def _trend() -> dict:
    low20, high20 = lambda: B.agg("min", "al", 20), lambda: B.agg("max", "ah", 20)
    low250, high250 = lambda: B.agg("min", "al", 250), lambda: B.agg("max", "ah", 250)
    ma = lambda w: B.agg("mean", "ac", w)
    return {
        "DIST_SUPPORT20": lambda: sdiv(c("ac") - low20(), "ac"),
        "DIST_RESIST20": lambda: sdiv(high20() - c("ac"), "ac"),
        "SR_RATIO20": lambda: sdiv(B.agg("mean", "ah", 20), B.agg("mean", "al", 20)),
        "EFF_RATIO10": lambda: sdiv(F.abs(c("ac") - B.ref("ac", 10)), B.agg("sum", F.abs("move"), 10)),
        "DIST_HIGH60": lambda: sdiv("ac", B.agg("max", "ah", 60)),
        "PRICE_TREND5": lambda: sdiv(B.slope("ac", 5), "ac"),
        "MA_STACK": lambda: F.signum(c("ac") - ma(60)) + F.signum(ma(60) - ma(120)) + F.signum(ma(120) - ma(250)),
        "TREND_SLOPE_120": lambda: sdiv(B.slope("log_ac", 120) * 120.0, B.agg("std", "r", 120) * math.sqrt(120.0)),
        "POS_52W": lambda: sdiv(c("ac") - low250(), high250() - low250()),
        "DIST_52W_LOW": lambda: sdiv("ac", low250()) - 1.0,
        "DIST_52W_HIGH": lambda: sdiv("ac", high250()) - 1.0,
        "MA200_RATIO": lambda: sdiv("ac", ma(200)) - 1.0,
        "MA200_ABOVE": lambda: flag(c("ac") > ma(200)),
    }


def _limits() -> dict:
    return {
        "LIMITCNT20": lambda: B.agg("sum", "lu", 20),
        "LIMITDOWN_CNT20": lambda: B.agg("sum", "ld", 20),
        "DIST_LIMIT": lambda: clip(sdiv("pct", "lim"), -1.0, 1.0),
        "DISPOSAL60": lambda: sdiv("close", sdiv(B.agg("sum", "amount", 60), B.agg("sum", "vol", 60))) - 1.0,
        "NEW_LISTING": lambda: (c("pos") <= 250).cast("double"),
    }


def _candles() -> dict:
    down = lambda: c("close") < c("open")
    return {
        "CLOSE_VS_HIGH": lambda: c("close_vs_high"),
        "UPPER_SHADOW_RATIO": lambda: c("upper_shadow"),
        "BODY_STRENGTH": lambda: sdiv(c("close") - c("open"), c("high") - c("low") + 1e-12),
        "HAMMER": lambda: c("hammer"),
        "DOJI": lambda: c("doji"),
        "ENGULFING": lambda: c("engulfing"),
        "DOWN_STREAK": lambda: B.streak(down()),
        "DOWN_DAY_PCT10": lambda: B.agg("mean", down().cast("double"), 10),
    }


REGISTRY.family("returns", PRICE, _returns())
REGISTRY.family("volatility", PRICE + " index_return", _volatility())
REGISTRY.family("liquidity", PRICE_VOL, _liquidity())
REGISTRY.family("volume", PRICE_VOL, _volume())
REGISTRY.family("price_volume", PRICE_VOL, _price_volume())
REGISTRY.family("moments", PRICE, _moments())
REGISTRY.family("indicators", PRICE, _indicators())
REGISTRY.family("trend", PRICE, _trend())
REGISTRY.family("limits", PRICE_VOL, _limits())
REGISTRY.family("candles", PRICE, _candles())


def symbol_features(adj: DataFrame, index_returns: DataFrame | None = None, families=None) -> DataFrame:
    return REGISTRY.compute(prepare(adj, index_returns, families), families=families)
