"""The daily indicator pipeline, family by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.features import legacy as LG
from barloom.functions.scalar import rnd
from barloom.operators.cross_section import largest_group
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sequential import _fold, macd_sql
from barloom.plans.sqltext import full, last, past, r, ref, strict
from barloom.plans.util import shown, shown_sql
from barloom.plans.windows import corr_sql, slope_sql
from barloom.sources import bars as SRC

BASE_SQL = (
    S.BRAND_WEEK, S.adjusted(), "big AS (SELECT * FROM adj)", macd_sql("close", "big"),
    f"b10 AS (SELECT *, greatest(close - {ref('close', 1)}, 0.0) AS up, greatest({ref('close', 1)} - close, 0.0) AS dn, greatest(high - low, abs(high - pre_close), abs(low - pre_close)) AS tr, "
    f"CASE WHEN count(low) {last(5)} = 5 THEN 100.0 * coalesce((close - min(low) {last(5)}) / nullif(max(high) {last(5)} - min(low) {last(5)}, 0), 0) END AS fk, CASE WHEN pre_close IS NULL THEN vol ELSE sign(close - pre_close) * vol END AS sv, list(close) {past()} AS cl FROM mc)",
    f"b11 AS (SELECT *, {full('avg', 'fk', 3)} AS sk, list(up) FILTER (WHERE pos > 1) {past()} AS ul, list(dn) FILTER (WHERE pos > 1) {past()} AS nl, list(tr) FILTER (WHERE pos > 1) {past()} AS tl FROM b10)",
    "b12 AS (SELECT *, " + ", ".join(
        f"CASE WHEN pos > {n} THEN 100 * {_fold(f'list_avg(ul[1:{n}])', f'ul[{n + 1}:]', 1 / n)} / ({_fold(f'list_avg(ul[1:{n}])', f'ul[{n + 1}:]', 1 / n)} + {_fold(f'list_avg(nl[1:{n}])', f'nl[{n + 1}:]', 1 / n)}) END AS rsi_{n}" for n in (6, 14, 24))
    + f", CASE WHEN pos > 14 THEN {_fold('list_avg(tl[1:14])', 'tl[15:]', 1 / 14)} END AS atr, sum(sv) {past()} AS obv, {full('avg', 'sk', 3)} AS sd3, list_reduce(cl, lambda ee, zz: ee * {9 / 11!r}::DOUBLE + zz * {2 / 11!r}::DOUBLE) AS smooth FROM b11)",
    f"lg AS (SELECT * EXCLUDE (ul, nl, tl, cl), dif - dea AS hist, {full('avg', 'close', 5)} AS ma_5, {full('avg', 'close', 20)} AS ma_20, {full('avg', 'close', 60)} AS ma_60, {full('stddev_pop', 'close', 5)} AS p5 FROM b12)",
)
INDICATORS = {
    "macd": "dif", "macd_signal": "dea", "macd_hist": "hist", "rsi_6": "rsi_6", "rsi_14": "rsi_14", "rsi_24": "rsi_24", "ma_5": "ma_5", "ma_20": "ma_20", "ma_60": "ma_60", "bb_upper": "ma_5 + 2 * p5", "bb_middle": "ma_5",
    "bb_lower": "ma_5 - 2 * p5", "volume_ma_20": full("avg", "vol", 20), "obv": "obv", "atr": "atr", "slowk": "CASE WHEN pos >= 9 THEN sk END", "slowd": "CASE WHEN pos >= 9 THEN sd3 END",
}


def _register(name, covers, cols, build, digits, extra=(), src="lg"):
    @query(name, covers, S.with_bars(*BASE_SQL, *extra) + shown_sql(src, cols, digits))
    def run(spark, sf_dir):
        bars = SRC.bars_brand_week(spark, sf_dir)
        panel = LG.indicators(SRC.adjust(bars))
        out = build(panel, largest_group(bars, ["d"])) if name == "pipeline_alpha_columns" else build(panel)
        return shown(out, {n: F.col(n) for n in cols}, digits)


_register("pipeline_base_indicators", "F6.1 Q1 Q2 Q3 Q5 Q6 UF4", INDICATORS, lambda p: p, 3)

MACD_EXTRA = (
    "q0 AS (SELECT *, coalesce(hist, 0) AS h, coalesce(dif, 0) AS m, coalesce(dea, 0) AS s FROM lg)",
    f"q1 AS (SELECT *, m - s AS cv, {ref('m', 1)} AS pm, {ref('s', 1)} AS ps FROM q0)",
)
MACD = {
    "macd_hist_trend_5": f"CASE WHEN pos >= 2 THEN regr_slope(h, pos) {last(6)} ELSE 0 END", "macd_golden_cross": "CAST(coalesce(pm < ps AND m > s, false) AS INT)", "macd_death_cross": "CAST(coalesce(pm > ps AND m < s, false) AS INT)",
    "macd_zero_cross_up": "CAST(coalesce(pm <= 0 AND m > 0, false) AS INT)", "macd_zero_cross_down": "CAST(coalesce(pm >= 0 AND m < 0, false) AS INT)", "macd_zero_cross": "CAST(coalesce((pm <= 0 AND m > 0) OR (pm >= 0 AND m < 0), false) AS INT)",
    "macd_hist_amplitude": f"max(h) {last(20)} - min(h) {last(20)}", "macd_hist_direction": "sign(h)", "macd_hist_acceleration": f"h - 2 * {ref('h', 1)} + {ref('h', 2)}", "macd_signal_convergence": "cv",
    "macd_signal_convergence_trend": f"CASE WHEN pos >= 2 THEN regr_slope(cv, pos) {last(5)} ELSE 0 END",
}
_register("pipeline_macd_columns", "F6.2 E9 W2 W10", MACD, LG.macd_columns, 3, MACD_EXTRA, "q1")


def _slope0(x: str, w: int) -> str:
    return f"coalesce({slope_sql(x, w)}, 0)"


_P10 = "OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
VOLUME = {
    "volume_trend_5": _slope0("vol", 6), "volume_trend_10": _slope0("vol", 11), "price_trend_5": _slope0("close", 6), "volume_consistency": f"coalesce({strict(f'CASE WHEN avg(vol) {last(6)} > 0 THEN stddev_samp(vol) {last(6)} / avg(vol) {last(6)} END', 'vol', 6)}, 0)",
    "volume_ma_ratio": f"CASE WHEN count(vol) {_P10.format(10)} = 10 THEN avg(vol) {_P10.format(5)} / avg(vol) {_P10.format(10)} ELSE 1.0 END", "obv_trend": _slope0("obv", 6),
}
_register("pipeline_volume_columns", "F6.3 F6.5 F6.7 W51", VOLUME, LG.volume_columns, 4)

RSI_EXTRA = (f"q0 AS (SELECT *, rsi_14 - {ref('rsi_14', 1)} AS d1, {ref('rsi_14', 1)} AS p1, {ref('rsi_14', 2)} AS p2 FROM lg)", f"q1 AS (SELECT *, {ref('d1', 1)} AS pd1 FROM q0)")
RSI = {
    "rsi_momentum": "coalesce(d1, 0)", "rsi_turning_simple": "CAST(coalesce(pd1 * d1 < 0, false) AS INT)", "rsi_turning": "CAST(coalesce((p1 > p2 AND rsi_14 < p1) OR (p1 < p2 AND rsi_14 > p1), false) AS INT)",
    **{f"rsi_oversold_{n}": f"CAST(coalesce(rsi_{n} < 30, false) AS INT)" for n in (6, 14, 24)}, **{f"rsi_overbought_{n}": f"CAST(coalesce(rsi_{n} > 70, false) AS INT)" for n in (6, 14, 24)},
}
_register("pipeline_rsi_columns", "F6.4", RSI, LG.rsi_columns, 4, RSI_EXTRA, "q1")

VOLAT_EXTRA = (f"q0 AS (SELECT *, ln(close / {ref('close', 1)}) AS lr FROM lg)",)
_register("pipeline_volatility_columns", "F6.6 W6", {f"volatility_{w}d": f"coalesce(({full('stddev_samp', 'lr', w)}) * sqrt(252.0::DOUBLE), 0)" for w in LG.VOLATILITY_WINDOWS}, LG.volatility_columns, 5, VOLAT_EXTRA, "q0")

_b = lambda e: f"CAST(coalesce({e}, false) AS INT)"
ADV_EXTRA = (
    f"q0 AS (SELECT *, abs(close - open) AS body, high - low AS span, least(open, close) - low AS ls, high - greatest(open, close) AS us, avg(vol) {last(20)} AS v20, avg(vol) {last(5)} AS v5, {ref('close', 1)} AS pc, {ref('open', 1)} AS po, {ref('vol', 1)} AS pv, max(close) {last(20)} AS pk, "
    f"{full('avg', 'close', 10)} AS m10, 4 * p5 AS wd, list(dif) FILTER (WHERE dif IS NOT NULL) {_P10.format(100)} AS dl FROM lg)",
    "q1 AS (SELECT *, vol / v20 AS vr, span <> 0 AND ls >= 2 * body AND us <= 0.5 * body AND ls >= 0.6 * span AS ham FROM q0)",
)
ADV = {
    "price_vs_ma5": "close / ma_5 - 1", "price_vs_ma20": "close / ma_20 - 1", "price_vs_ma60": "close / ma_60 - 1", "ma_arrangement": "CASE WHEN ma_5 > ma_20 AND ma_20 > ma_60 THEN 1 WHEN ma_5 < ma_20 AND ma_20 < ma_60 THEN -1 ELSE 0 END",
    "bb_position": "CASE WHEN wd > 0 THEN (close - (ma_5 - 2 * p5)) / wd ELSE 0.5 END", "bb_squeeze": _b("wd / close < 0.05"), "macd_signal_distance": "hist", "macd_above_signal": _b("hist > 0"), "volume_ratio": "vr", "volume_spike": _b("vr > 2"), "volume_dryup": _b("vr < 0.5"),
    "atr_ratio": "atr / close", "hammer_pattern": _b("ham"), "doji_pattern": _b("span <> 0 AND body < 0.1 * span"), "engulfing_pattern": _b("(pc < po AND close > open AND open <= pc AND close >= po) OR (pc > po AND close < open AND open >= pc AND close <= po)"), "downtrend": _b("ma_5 < m10"), "hammer_signal": _b("ham AND ma_5 < m10"),
    "distance_to_support": f"(close - min(low) {last(20)}) / close", "distance_to_resistance": f"(max(high) {last(20)} - close) / close", "stoch_oversold": _b("pos >= 9 AND sk < 20"), "stoch_overbought": _b("pos >= 9 AND sd3 > 80"),
    "macd_percentile": "CASE WHEN len(dl) = 100 THEN (len(list_filter(dl, lambda zz: zz < dif)) + 0.5 * len(list_filter(dl, lambda zz: zz = dif))) END", "signed_volume_strength": "vr * ((close - open) / open)", "close_vs_high": "(high - close) / nullif(span, 0)",
    "amihud_illiq_intraday": "abs(close / open - 1) / (vol * close)", "hl_spread": "span / ((high + low) / 2)", "effective_spread": "span / close", "alpha12": "sign(vol - pv) * (-1 * (close - pc))", "price_volume_divergence": _b("close = pk AND vol < v20"), "volume_momentum": "(v5 - v20) / v20", "price_impact": "abs(close - open) / sqrt(vol)",
}
_register("pipeline_advanced_columns", "F6.8 F6.9 F6.10 F6.11 E16 W14", ADV, LG.advanced, 3, ADV_EXTRA, "q1")

ALPHA_EXTRA = (
    f"q0 AS (SELECT *, close / {ref('close', 1)} - 1 AS pch, {full('stddev_samp', 'close', 5)} AS s5, {full('stddev_samp', 'close', 60)} AS s60 FROM lg)",
    f"q1 AS (SELECT *, avg(s60) {last(60)} AS ms60, CASE WHEN pch IS NOT NULL THEN (rank() OVER (PARTITION BY d, pch IS NULL ORDER BY pch) - 1 + (count(*) OVER (PARTITION BY d, pch) + 1) / 2.0) / count(pch) OVER (PARTITION BY d) END AS rr, (rank() OVER (PARTITION BY d ORDER BY vol) - 1 + (count(*) OVER (PARTITION BY d, vol) + 1) / 2.0) / count(*) OVER (PARTITION BY d) AS rv FROM q0)",
)
ALPHA = {
    "pct_change": "coalesce(pch, 0)", "clv": "(close - low) / (high - low + 1e-9::DOUBLE)", "upper_shadow_ratio": "CASE WHEN high = low THEN 0 ELSE (high - greatest(open, close)) / (high - low + 1e-9::DOUBLE) END", "body_strength": "(close - open) / (high - low + 1e-9::DOUBLE)",
    "signed_vol_strength": "vol * sign(close - open)", "pv_corr_10": f"coalesce(CASE WHEN pos > 10 THEN {corr_sql('close', 'vol', 10)} END, 0)", "dist_to_high_60": f"coalesce(close / (({full('max', 'close', 60)}) + 1e-9::DOUBLE), 0)", "vol_divergence": "coalesce(s5 / (ms60 + 1e-9::DOUBLE), 0)",
    "rank_return": "coalesce(rr, 0)", "rank_volume": "rv",
}
_register("pipeline_alpha_columns", "F6.12 W3 W20 W30 C2", ALPHA, lambda p, rows: LG.alpha(p, day_rows=rows), 5, ALPHA_EXTRA, "q1")

_RZ = lambda x: f"CASE WHEN count({x}) {last(100)} >= 50 THEN ({x} - quantile_cont({x}, 0.5) {last(100)}) / ((quantile_cont({x}, 0.75) {last(100)} - quantile_cont({x}, 0.25) {last(100)}) / 1.34896) END"
STRUCT_EXTRA = (
    f"q0 AS (SELECT *, ln(high / (low + 1e-9::DOUBLE)) AS lh, ln(close / (open + 1e-9::DOUBLE)) AS lc, abs(close - {ref('close', 1)}) AS mvv, open / {ref('close', 1)} - 1 AS ro, close / open - 1 AS ri, close / {ref('close', 1)} - 1 AS pch, {full('avg', 'high', 20)} AS hm, {full('avg', 'low', 20)} AS lm FROM lg)",
    "q1 AS (SELECT *, CASE WHEN 0.5 * lh * lh - (2 * ln(2.0::DOUBLE) - 1) * lc * lc >= 0 THEN sqrt(0.5 * lh * lh - (2 * ln(2.0::DOUBLE) - 1) * lc * lc) END AS gk FROM q0)",
)
STRUCT = {
    "vol_gk": "gk", "vol_gk_ratio": f"gk / ({full('avg', 'gk', 20)})", "illiq": "ln(abs(pch) / (close * vol + 1e-9::DOUBLE) + 1)", "efficiency_ratio": f"abs(close - {ref('close', 10)}) / (({full('sum', 'mvv', 10)}) + 1e-9::DOUBLE)",
    "intraday_pos": "CASE WHEN high = low THEN CASE WHEN close >= open THEN 1 ELSE 0 END ELSE (close - low) / (high - low + 1e-9::DOUBLE) END", "ret_overnight": "ro", "ret_intraday": "ri", "smart_money_diff": "ri - ro", "high_mean_20": "hm", "low_mean_20": "lm", "support_resistance_ratio": "hm / lm",
    "log_volume": "ln(1 + vol)", "boxcox_atr": "ln(1 + atr)", "rsi_robust": _RZ("rsi_14"), "macd_robust": _RZ("dif"), "close_smooth_10": "smooth",
}
_register("pipeline_structure_columns", "F6.13 F6.19 W21 W26", STRUCT, LG.structure, 5, STRUCT_EXTRA, "q1")

_register("pipeline_lag_columns", "F6.14 W1", {
    **{f"{x}_lag_{k}": ref(x, k) for x in ("close", "open", "high", "low", "vol") for k in LG.LAGS}, **{f"return_lag_{k}": f"{ref('close', k)} / {ref('close', k + 1)} - 1" for k in (1, 2, 3, 5, 10, 20)},
    **{f"amplitude_lag_{k}": f"({ref('high', k)} - {ref('low', k)}) / {ref('low', k)}" for k in (1, 3, 5)}, **{f"vol_gk_lag_{k}": ref("gk", k) for k in (1, 3, 5, 10)},
    **{f"ret_overnight_lag_{k}": ref("ro", k) for k in (1, 3, 5)}, **{f"ret_intraday_lag_{k}": ref("ri", k) for k in (1, 3, 5)}, **{f"smart_money_diff_lag_{k}": f"{ref('ri', k)} - {ref('ro', k)}" for k in (1, 3, 5)},
}, lambda p: LG.lags(LG.structure(p)), 4, STRUCT_EXTRA, "q1")


@query(
    "pipeline_cross_section", "F6.17 W30 W32 W34",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), "q AS (SELECT sym, d, amount, pct, high / low AS hl FROM adj)") + "SELECT sym, CAST(d AS VARCHAR) AS d, CAST(count(*) OVER (PARTITION BY d) AS DOUBLE) AS cs_n, " + ", ".join(
        f"CASE WHEN {x} IS NOT NULL THEN {r(f'(rank() OVER (PARTITION BY d, {x} IS NULL ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY d, {x}) + 1) / 2.0) / count({x}) OVER (PARTITION BY d)')} END AS {x}_rankpct, {r(f'({x} - median({x}) OVER (PARTITION BY d)) / (stddev_pop({x}) OVER (PARTITION BY d) + 1e-9)', 5)} AS {x}_z" for x in ("amount", "pct", "hl")) + " FROM q",
)
def pipeline_cross_section(spark, sf_dir):
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir)).select("sym", "d", "amount", "pct", (F.col("high") / F.col("low")).alias("hl"))
    out = LG.cross_section(adj, ["amount", "pct", "hl"])
    return out.select("sym", F.col("d").cast("string").alias("d"), "cs_n", *[rnd(f"{x}_rankpct").alias(f"{x}_rankpct") for x in ("amount", "pct", "hl")], *[rnd(f"{x}_z", 5).alias(f"{x}_z") for x in ("amount", "pct", "hl")])


def _idx(src, p):
    vr = "CASE WHEN count(vol) OVER w = 20 THEN vol / avg(vol) OVER w ELSE 1.0 END"
    return f"(SELECT d, (close - open) / open AS {p}pc, (high - low) / low AS {p}am, {vr} AS {p}vr FROM {src} WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


_mood = lambda a, b: f"CASE WHEN {a} > 0.01 AND {b} < 0.02 THEN 2 WHEN {a} < -0.01 AND {b} > 0.03 THEN 0 ELSE 1 END"
MKT_COLS = {}
for _p in ("x", "y"):
    MKT_COLS |= {f"{_p}_price_change": f"{_p}pc", f"{_p}_amplitude": f"{_p}am", f"{_p}_volume_ratio": f"{_p}vr", f"{_p}_price_change_abs": f"abs({_p}pc)", f"{_p}_price_wave_abs": f"{_p}am", f"{_p}_sentiment": f"CASE WHEN {_p}miss THEN 1 ELSE {_mood(_p + 'pc', _p + 'am')} END", f"{_p}_volume_signal": f"CAST({_p}vr > 1.2 AS INT)"}
MKT_COLS |= {"sync_direction": "CAST(xpc * ypc > 0 AS INT)", "sync_strength": "abs(xpc - ypc)", "market_sentiment": _mood("(xpc + ypc) / 2", "(xam + yam) / 2"), "market_avg_change": "(xpc + ypc) / 2", "market_avg_amplitude": "(xam + yam) / 2", "market_sync_score": "1 - least(1.0, abs(xpc - ypc) / 0.02)"}


@query(
    "pipeline_market_columns", "F6.15 F6.16 J4",
    S.with_bars(S.INDEX_WEEK, f"b2 AS (SELECT * FROM ({S.index_of('PROMO')}) WHERE d >= DATE '1997-01-06')", f"j0 AS (SELECT b.d, xpc, xam, xvr, ypc, yam, yvr FROM bars b LEFT JOIN {_idx('bars', 'x')} i USING (d) LEFT JOIN {_idx('b2', 'y')} k USING (d))",
                "j AS (SELECT d, coalesce(xpc, 0) AS xpc, coalesce(xam, 0.02) AS xam, coalesce(xvr, 1) AS xvr, xpc IS NULL AS xmiss, coalesce(ypc, 0) AS ypc, coalesce(yam, 0.02) AS yam, coalesce(yvr, 1) AS yvr, ypc IS NULL AS ymiss FROM j0)")
    + f"SELECT CAST(d AS VARCHAR) AS d, {', '.join(f'{r(e)} AS {n}' for n, e in MKT_COLS.items())} FROM j",
)
def pipeline_market_columns(spark, sf_dir):
    first = SRC.index_bars(spark, sf_dir)
    second = SRC.index_bars(spark, sf_dir, "PROMO").where(F.col("d") >= F.lit("1997-01-06").cast("date"))
    out = LG.market_columns(first.select("d"), first, second, "x", "y")
    return out.select(F.col("d").cast("string").alias("d"), *[rnd(n).alias(n) for n in MKT_COLS])
