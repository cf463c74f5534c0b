"""Per-symbol window primitives, checked one family at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.features.indicators import stochastic
from barloom.functions.rolling import BARS as B
from barloom.functions.rolling import frac_weights
from barloom.functions.scalar import flag, sdiv
from barloom.plans.sqltext import full, last, past, ref, strict, whole
from barloom.plans.util import panel_query

panel_query(
    "adjusted_price_chain", "P1 C10 W23 S6", "brand_week",
    lambda: {"pct": F.col("pct"), "cf": F.col("cf"), "ao": F.col("ao"), "ah": F.col("ah"), "al": F.col("al")},
    {"pct": "pct", "cf": "cf", "ao": "ao", "ah": "ah", "al": "al"},
)

panel_query(
    "shift_and_difference", "W1 W2 W3", "supp_month",
    lambda: {
        "ref1": B.ref("close", 1), "ref20": B.ref("close", 20), "delta5": B.delta("close", 5),
        "diff2": B.diff2("close"), "pct1": B.pct_change("close"),
    },
    {
        "ref1": ref("close", 1), "ref20": ref("close", 20), "delta5": f"close - {ref('close', 5)}",
        "diff2": f"close - 2.0 * {ref('close', 1)} + {ref('close', 2)}", "pct1": f"close / {ref('close', 1)} - 1.0",
    },
    digits=4,
)

panel_query(
    "rolling_mean_sum_strict", "W4 C3 C4", "supp_month",
    lambda: {"mean5": B.agg("mean", "r", 5), "mean20": B.agg("mean", "r", 20), "sum60": B.agg("sum", "r", 60)},
    {"mean5": full("avg", "r", 5), "mean20": full("avg", "r", 20), "sum60": full("sum", "r", 60)},
)

panel_query(
    "rolling_min_periods", "W5", "user_day",
    lambda: {
        "mean": B.agg("mean", "r", 20, 5), "std": B.agg("std", "r", 20, 5), "min": B.agg("min", "r", 20, 5),
        "max": B.agg("max", "r", 20, 5), "n": B.agg("count", "r", 20, 1).cast("double"),
    },
    {
        **{n: f"CASE WHEN count(r) {last(20)} >= 5 THEN {f}(r) {last(20)} END"
           for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))},
        "n": f"CASE WHEN count(r) {last(20)} >= 1 THEN CAST(count(r) {last(20)} AS DOUBLE) END",
    },
)

panel_query(
    "rolling_std_both_ddof", "W6 C5", "supp_month",
    lambda: {"sample20": B.agg("std", "r", 20), "population20": B.agg("pstd", "r", 20)},
    {"sample20": full("stddev_samp", "r", 20), "population20": full("stddev_pop", "r", 20)},
)

panel_query(
    "rolling_extremes", "W7", "brand_week",
    lambda: {"max60": B.agg("max", "ah", 60), "min60": B.agg("min", "al", 60), "max250": B.agg("max", "ah", 250)},
    {"max60": full("max", "ah", 60), "min60": full("min", "al", 60), "max250": full("max", "ah", 250)},
)

panel_query(
    "rolling_quantiles", "W8", "supp_month",
    lambda: {"med": B.quantile("r", 20, 0.5), "q20": B.quantile("r", 20, 0.2), "q80": B.quantile("r", 20, 0.8),
             "q10": B.quantile("r", 60, 0.1)},
    {"med": strict(f"quantile_cont(r, 0.5) {last(20)}", "r", 20),
     "q20": strict(f"quantile_cont(r, 0.2) {last(20)}", "r", 20),
     "q80": strict(f"quantile_cont(r, 0.8) {last(20)}", "r", 20),
     "q10": strict(f"quantile_cont(r, 0.1) {last(60)}", "r", 60)},
)


def _skew_pop(x: str, w: int) -> str:
    m1, m2, m3 = (f"(avg({x}) {last(w)})", f"(avg({x}*{x}) {last(w)})", f"(avg({x}*{x}*{x}) {last(w)})")
    return strict(
        f"({m3} - 3*{m1}*{m2} + 2*{m1}*{m1}*{m1}) / pow({m2} - {m1}*{m1}, 1.5)", x, w
    )


panel_query(
    "rolling_skew_kurtosis", "W9 C6", "brand_week",
    lambda: {
        "skew_pop": B.skew_pop("r", 60), "kurt_pop": B.kurt_pop("r", 60),
        "skew_unbiased": B.skew_unbiased("r", 60), "kurt_unbiased": B.kurt_unbiased("r", 60),
    },
    {
        "skew_pop": _skew_pop("r", 60), "kurt_pop": strict(f"kurtosis_pop(r) {last(60)}", "r", 60),
        "skew_unbiased": strict(f"skewness(r) {last(60)}", "r", 60),
        "kurt_unbiased": strict(f"kurtosis(r) {last(60)}", "r", 60),
    },
    digits=5,
)


def slope_sql(x: str, w: int) -> str:
    """Closed form: window sums of x and x*pos against the fixed spread of 0..w-1."""
    spread = w * (w * w - 1) / 12.0
    return strict(
        f"(sum({x} * pos) {last(w)} - (pos - {(w - 1) / 2.0}::DOUBLE) * sum({x}) {last(w)}) / {spread}::DOUBLE", x, w
    )


panel_query(
    "rolling_line_fit", "W10 W11", "brand_week",
    lambda: {"slope10": B.slope("cf", 10), "rsq20": B.rsquare("cf", 20), "resi20": B.end_residual("cf", 20)},
    {
        "slope10": slope_sql("cf", 10),
        "rsq20": strict(f"CASE WHEN var_pop(cf) {last(20)} > 0 THEN regr_r2(cf, pos) {last(20)} END", "cf", 20),
        "resi20": f"cf - (({full('avg', 'cf', 20)}) + ({slope_sql('cf', 20)}) * 9.5)",
    },
)


def ts_rank_sql(x: str, w: int) -> str:
    """Counts the smaller and equal values of the window kept as a list."""
    vals = f"list({x}) {last(w)}"
    return strict(
        f"(len(list_filter({vals}, lambda zz: zz < {x})) + len(list_filter({vals}, lambda zz: zz = {x})) * 0.5::DOUBLE)"
        f" / {w}::DOUBLE", x, w,
    )


panel_query(
    "time_rank_strict", "W12 C7", "supp_month",
    lambda: {"rank20": B.ts_rank("r", 20), "rank60": B.ts_rank("close", 60)},
    {"rank20": ts_rank_sql("r", 20), "rank60": ts_rank_sql("close", 60)},
)

KNOWN = f"list(rr) {last(50)}"
panel_query(
    "time_rank_known_values", "W13", "brand_week",
    lambda: {"rank50": B.ts_rank_known("rr", 50, 20)},
    {"rank50": "CASE WHEN rr IS NOT NULL AND len(v) >= 20 THEN (len(list_filter(v, lambda a: a < rr)) "
               "+ len(list_filter(v, lambda a: a = rr)) * 0.5::DOUBLE) / len(v) END"},
    pre=lambda p: p.withColumn("rr", F.when(F.pmod("pos", F.lit(7)) != 0, F.col("r"))),
    pre_sql=("nn AS (SELECT *, CASE WHEN pos % 7 <> 0 THEN r END AS rr FROM adj)",
             f"nv AS (SELECT *, list(rr) FILTER (WHERE rr IS NOT NULL) {last(50)} AS v FROM nn)"),
    last_cte="nv",
)

panel_query(
    "percentile_of_previous", "W14 F6.8", "brand_week",
    lambda: {"pct100": B.percentile_of_previous("close", 100)},
    {"pct100": "CASE WHEN len(v) = 100 THEN (len(list_filter(v, lambda a: a < close)) "
               "+ len(list_filter(v, lambda a: a = close)) * 0.5::DOUBLE) / 100::DOUBLE * 100 END"},
    pre_sql=("pv AS (SELECT *, list(close) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 100 PRECEDING AND "
             "1 PRECEDING) AS v FROM adj)",),
    last_cte="pv",
)

panel_query(
    "bars_since_extreme", "W15 C8", "supp_month",
    lambda: {"since_max": B.since_extreme("qq", 20, "max"), "since_min": B.since_extreme("qq", 20, "min")},
    {
        "since_max": strict(f"CAST(pos - arg_max(pos, row(qq, -pos)) {last(20)} AS DOUBLE)", "qq", 20),
        "since_min": strict(f"CAST(pos - arg_min(pos, row(qq, pos)) {last(20)} AS DOUBLE)", "qq", 20),
    },
    pre=lambda p: p.withColumn("qq", F.col("n").cast("double")),
    pre_sql=("q AS (SELECT *, CAST(n AS DOUBLE) AS qq FROM adj)",),
    last_cte="q",
)

panel_query(
    "top_k_mean", "W16", "supp_month",
    lambda: {"max5of20": B.topk_mean("r", 20, 5)},
    {"max5of20": strict(f"list_avg(list_slice(list_reverse_sort(list(r) {last(20)}), 1, 5))", "r", 20)},
)

panel_query(
    "true_streaks", "W17 W18", "supp_month",
    lambda: {"down": B.streak(F.col("close") < F.col("open")), "ones": B.streak_known("f")},
    {
        "down": f"CAST(pos - coalesce(max(CASE WHEN close < open THEN NULL ELSE pos END) {past()}, 0) AS DOUBLE)",
        "ones": f"CASE WHEN f IS NOT NULL THEN CAST(pos - coalesce(max(CASE WHEN f = 1 THEN NULL ELSE pos END) "
                f"{past()}, 0) AS DOUBLE) END",
    },
    pre=lambda p: p.withColumn("f", F.when(F.pmod("pos", F.lit(11)) != 0, flag(F.col("r") > 0))),
    pre_sql=("fl AS (SELECT *, CASE WHEN pos % 11 <> 0 AND r IS NOT NULL THEN CASE WHEN r > 0 THEN 1 ELSE 0 END END "
             "AS f FROM adj)",),
    last_cte="fl",
)

panel_query(
    "decay_weighted_mean", "W19", "supp_month",
    lambda: {"wma10": B.decay_mean("cf", 10)},
    {"wma10": strict(
        "list_sum(list_transform(list(cf) " + last(10) + ", lambda zz, ii: zz * ii)) / 55.0::DOUBLE", "cf", 10)},
)


def corr_sql(x: str, y: str, w: int, kind: str = "corr") -> str:
    px, py = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    cov = f"covar_pop({px}, {py}) {last(w)}"
    full_pair = f"count({px}) {last(w)} = {w}" if x != y else f"count({px}) {last(w)} = {w}"
    full_pair = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {last(w)} = {w}"
    if kind == "cov":
        return f"CASE WHEN {full_pair} THEN {cov} END"
    sx, sy = f"stddev_pop({px}) {last(w)}", f"stddev_pop({py}) {last(w)}"
    return f"CASE WHEN {full_pair} AND {sx} > 0 AND {sy} > 0 THEN {cov} / ({sx} * {sy}) END"


panel_query(
    "rolling_covariance_correlation", "W20", "supp_month",
    lambda: {"cov20": B.cov_pop("r", "lv", 20), "corr20": B.corr("r", "lv", 20), "corr10": B.corr("cf", "vol", 10)},
    {"cov20": corr_sql("r", "lv", 20, "cov"), "corr20": corr_sql("r", "lv", 20), "corr10": corr_sql("cf", "vol", 10)},
    pre=lambda p: p.withColumn("lv", F.log(F.col("vol") + 1.0)),
    pre_sql=("lg AS (SELECT *, ln(vol + 1.0) AS lv FROM adj)",),
    last_cte="lg",
)

panel_query(
    "conditional_rolling_mean", "W24", "supp_month",
    lambda: {
        "gap_after_drop": sdiv(B.conditional("sum", F.col("hit"), "ret_on", 20),
                               B.agg("sum", F.col("hit").cast("double"), 20)),
        "down_vol_ratio": F.when(
            B.conditional("count", F.col("r") > 0, "vol", 20) >= 5,
            sdiv(B.conditional("mean", F.col("r") > 0, "vol", 20), B.conditional("mean", F.col("r") < 0, "vol", 20))),
    },
    {
        "gap_after_drop": f"sum(CASE WHEN hit THEN ret_on END) {last(20)} / "
                          f"nullif({full('sum', 'CAST(hit AS INT)', 20)}, 0)",
        "down_vol_ratio": f"CASE WHEN count(CASE WHEN r > 0 THEN vol END) {last(20)} >= 5 THEN "
                          f"avg(CASE WHEN r > 0 THEN vol END) {last(20)} / avg(CASE WHEN r < 0 THEN vol END) {last(20)} END",
    },
    pre=lambda p: p.withColumns({"ret_on": sdiv("open", "pre_close") - 1.0, "ret_id": sdiv("close", "open") - 1.0})
    .withColumn("hit", F.coalesce(B.ref("ret_id", 1) < -0.02, F.lit(False))),
    pre_sql=("c1 AS (SELECT *, open / pre_close - 1.0 AS ret_on, close / open - 1.0 AS ret_id FROM adj)",
             f"c2 AS (SELECT *, coalesce({ref('ret_id', 1)} < -0.02, false) AS hit FROM c1)"),
    last_cte="c2",
)

panel_query(
    "forward_rolling_max", "W25 L3", "supp_month",
    lambda: {"fmax5": B.forward("max", "high", 1, 6),
             "max_ret5": sdiv(B.forward("max", "high", 1, 6), B.lead("open", 1)) - 1.0},
    {
        "fmax5": "CASE WHEN count(high) OVER f = 6 THEN max(high) OVER f END".replace(
            "OVER f", "OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)"),
        "max_ret5": ("CASE WHEN count(high) OVER f = 6 THEN max(high) OVER f END / " + "lead(open, 1) OVER (PARTITION "
                     "BY sym ORDER BY d) - 1.0").replace(
            "OVER f", "OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)"),
    },
    digits=4,
)

_RZ = f"quantile_cont(r, 0.75) {last(40)} - quantile_cont(r, 0.25) {last(40)}"
panel_query(
    "rolling_robust_z", "W26 F6.19", "supp_month",
    lambda: {"z": B.robust_z("r", 40)},
    {"z": f"CASE WHEN count(r) {last(40)} >= 20 THEN (r - quantile_cont(r, 0.5) {last(40)}) / "
          f"(CASE WHEN ({_RZ}) = 0 THEN 1e-9 ELSE ({_RZ}) / 1.34896 END) END"},
)

_FW = frac_weights(0.4, 0.02)
panel_query(
    "fractional_difference", "W27 F6.19", "supp_month",
    lambda: {"fd": B.frac_diff("cf", 0.4, 0.02)},
    {"fd": strict(
        " + ".join(f"({w!r}::DOUBLE) * lag(cf, {k}) {whole()}" for k, w in enumerate(_FW)), "cf", len(_FW))},
)

panel_query(
    "position_and_drawdown", "W28 W29 P9", "supp_month",
    lambda: {"pos": F.col("pos").cast("double"), "is_new": flag(F.col("pos") <= 20), "dd": B.drawdown("cf"),
             "max_dd": F.min("ddv").over(B.past())},
    {"pos": "CAST(pos AS DOUBLE)", "is_new": "CASE WHEN pos <= 20 THEN 1.0 ELSE 0.0 END",
     "dd": "ddv", "max_dd": f"min(ddv) {past()}"},
    pre=lambda p: p.withColumn("ddv", B.drawdown("cf")),
    pre_sql=(f"dd AS (SELECT *, cf / max(cf) {past()} - 1.0 AS ddv FROM adj)",),
    last_cte="dd",
)

panel_query(
    "residual_volatility", "W38", "brand_week",
    lambda: {"ivol60": B.residual_std("r", "m", 60)},
    {"ivol60": f"CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) {last(60)} = 60 THEN "
               f"sqrt(var_pop(r) {last(60)} - (covar_pop(r, m) {last(60)}) ** 2 / var_pop(m) {last(60)}) END"},
    pre=lambda p: p.withColumn("m", F.when(F.col("r").isNotNull(), F.col("vol") / 1000.0)),
    pre_sql=("mm AS (SELECT *, CASE WHEN r IS NOT NULL THEN vol / 1000.0::DOUBLE END AS m FROM adj)",),
    last_cte="mm",
)

panel_query(
    "coefficient_of_variation", "W51", "supp_month",
    lambda: {"cv6": B.cv("vol", 6)},
    {"cv6": strict(f"CASE WHEN avg(vol) {last(6)} > 0 THEN stddev_samp(vol) {last(6)} / avg(vol) {last(6)} "
                   "ELSE 0.0 END", "vol", 6)},
)

panel_query(
    "true_range_and_simple_atr", "Q4", "supp_month",
    lambda: {"tr": F.col("tr"), "atr14": B.agg("mean", "tr", 14)},
    {"tr": "tr", "atr14": full("avg", "tr", 14)},
    digits=4,
    pre=lambda p: p.withColumn("tr", B.true_range("high", "low", "close")),
    pre_sql=("t AS (SELECT *, CASE WHEN pre_close IS NULL THEN high - low ELSE greatest(high - low, "
             "abs(high - pre_close), abs(low - pre_close)) END AS tr FROM adj)",),
    last_cte="t",
)

panel_query(
    "on_balance_volume", "Q5", "supp_month",
    lambda: {"obv": B.obv("close", "vol")},
    {"obv": f"sum(CASE WHEN pre_close IS NULL THEN vol ELSE sign(close - pre_close) * vol END) {past()}"},
)

panel_query(
    "moving_bands_and_stochastic", "Q6", "supp_month",
    lambda: {
        "sma20": B.agg("mean", "close", 20),
        "bb_up": B.agg("mean", "close", 5) + 2.0 * B.agg("pstd", "close", 5),
        "bb_low": B.agg("mean", "close", 5) - 2.0 * B.agg("pstd", "close", 5),
        "slowk": F.when(F.col("pos") >= 9, B.agg("mean", "fastk", 3)),
        "slowd": F.when(F.col("pos") >= 9, F.col("slowd")),
    },
    {
        "sma20": full("avg", "close", 20),
        "bb_up": f"({full('avg', 'close', 5)}) + 2.0 * ({full('stddev_pop', 'close', 5)})",
        "bb_low": f"({full('avg', 'close', 5)}) - 2.0 * ({full('stddev_pop', 'close', 5)})",
        "slowk": "CASE WHEN pos >= 9 THEN slowk END",
        "slowd": f"CASE WHEN pos >= 9 THEN {full('avg', 'slowk', 3)} END",
    },
    digits=4,
    pre=stochastic,
    pre_sql=(f"k1 AS (SELECT *, CASE WHEN count(low) {last(5)} = 5 THEN 100.0 * coalesce((close - min(low) {last(5)}) / "
             f"nullif(max(high) {last(5)} - min(low) {last(5)}, 0), 0) END AS fastk FROM adj)",
             f"k2 AS (SELECT *, {full('avg', 'fastk', 3)} AS slowk FROM k1)"),
    last_cte="k2",
)
