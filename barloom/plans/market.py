"""Date-level features, event-row features, run and interval windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.features import calendar as CAL
from barloom.features import engine as EN
from barloom.features import event_row as ER
from barloom.features import market as MK
from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd, sdiv
from barloom.operators import events as E
from barloom.operators import labels as L
from barloom.plans import sqltext as S
from barloom.plans.events import BASE, MAIN_SQL, V1_SQL, V2_SQL, crossed_bars, divergence_sql, longs, main_pool
from barloom.plans.registry import query
from barloom.plans.sequential import FRACTAL_SQL, _fold, macd_bars, macd_sql
from barloom.plans.sqltext import full, last, past, r, ref, whole
from barloom.plans.util import shown, shown_sql
from barloom.session import stored
from barloom.sources import bars as SRC

OVER_D = "OVER (ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def dlast(w: int) -> str:
    return OVER_D.format(w - 1)


def dfull(fn: str, x: str, w: int) -> str:
    return f"CASE WHEN count({x}) {dlast(w)} = {w} THEN {fn}({x}) {dlast(w)} END"


def d_rank(x: str, w: int) -> str:
    vals = f"list({x}) {dlast(w)}"
    return (f"CASE WHEN count({x}) {dlast(w)} = {w} THEN (len(list_filter({vals}, lambda zz: zz < {x})) + len(list_filter({vals}, lambda zz: zz = {x})) * 0.5) / {w} END")


def by_day(df, *names, digits=6):
    return df.select(F.col("d").cast("string").alias("d"), *[rnd(n, digits).alias(n) for n in names])


def by_day_sql(src: str, cols: dict[str, str], digits: int = 6) -> str:
    return f"SELECT CAST(d AS VARCHAR) AS d, {', '.join(f'{S.r(e, digits)} AS {n}' for n, e in cols.items())} FROM {src}"


REGIME_SQL = """rg0 AS (SELECT d, sum(CASE WHEN pos > 1 THEN coalesce(r, 0) END) AS s, count(CASE WHEN pos > 1 THEN 1 END) AS n FROM adj GROUP BY 1),
rg1 AS (SELECT *, product(1.0::DOUBLE + CASE WHEN n > 0 THEN s / n ELSE 0.0 END) OVER (ORDER BY d) AS ix FROM rg0),
rg AS (SELECT *, CASE WHEN lag(ix, 60) OVER (ORDER BY d) IS NULL THEN -1.0 WHEN ix / lag(ix, 60) OVER (ORDER BY d) - 1 > 0.1 THEN 1.0 WHEN ix / lag(ix, 60) OVER (ORDER BY d) - 1 < -0.1 THEN 2.0 ELSE 0.0 END AS regime FROM rg1)"""


@query("market_regime", "W36 A10 A25", S.with_bars(S.BRAND_WEEK, S.adjusted(), REGIME_SQL) + by_day_sql("rg", {"sum_r": "s", "n_r": "n", "regime": "regime"}, 5))
def market_regime(spark, sf_dir):
    out = MK.regime(MK.market_returns(SRC.adjust(SRC.bars_brand_week(spark, sf_dir))), 60)
    return by_day(out, "sum_r", "n_r", "regime", digits=5)


@query(
    "market_breadth_frame", "F3 A5 A6 A10 W35 W12",
    S.with_bars(S.BRAND_WEEK, S.adjusted(),
                f"m0 AS (SELECT *, cf / {ref('cf', 5)} - 1 AS ret5, cf / {ref('cf', 20)} - 1 AS ret20, {full('avg', 'cf', 20)} AS mc, {full('min', 'al', 250)} AS lo FROM adj)",
                "m1 AS (SELECT d, avg(CASE WHEN ret5 IS NOT NULL THEN CAST(ret5 > 0 AS INT) END) AS adv, avg(CASE WHEN mc IS NOT NULL THEN CAST(cf > mc AS INT) END) AS above, "
                "avg(CASE WHEN lo IS NOT NULL THEN CAST(al = lo AS INT) END) AS nl, coalesce(sum(CASE WHEN pct >= 9.9 THEN 1 ELSE 0 END), 0) AS lu, sum(amount) AS amt, median(ret20) AS med FROM m0 GROUP BY 1)",
                f"m2 AS (SELECT *, {dfull('avg', 'lu', 20)} AS lu20, {dfull('avg', 'amt', 20)} AS amt20 FROM m1)")
    + by_day_sql("m2", {"BREADTH_ADV5": "adv", "BREADTH_ABOVE_MA20": "above", "BREADTH_NEWLOW": "nl", "LIMITUP_N_MKT": "lu", "LIMITUP_N_MKT_MA20": "lu20", "MKT_AMT_PCT": d_rank("amt20", 250), "MKT_MEDIAN_RET20": "med"}, 5),
)
def market_breadth_frame(spark, sf_dir):
    out = MK.breadth(SRC.adjust(SRC.bars_brand_week(spark, sf_dir)))
    return by_day(out, *[c for c in out.columns if c != "d"], digits=5)


def _index_sql(src: str, p: str) -> str:
    return f"""(SELECT d, (close - open) / open AS {p}pc, (high - low) / low AS {p}amp, vol / ({dfull('avg', 'vol', 20)}) AS {p}vr FROM {src})"""


def _mood_sql(c: str, a: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND {a} IS NOT NULL THEN CASE WHEN {c} > 0.01 AND {a} < 0.02 THEN 2.0 WHEN {c} < -0.01 AND {a} > 0.03 THEN 0.0 ELSE 1.0 END END"


def _one_sql(n: str, p: str) -> dict[str, str]:
    k = f"MKT_{n}_"
    return {k + "PRICE_CHANGE": f"{p}pc", k + "AMPLITUDE": f"{p}amp", k + "VOLUME_RATIO": f"{p}vr", k + "PRICE_CHANGE_ABS": f"abs({p}pc)", k + "PRICE_WAVE_ABS": f"{p}amp",
            k + "SENTIMENT": _mood_sql(f"{p}pc", f"{p}amp"), k + "VOLUME_SIGNAL": f"CASE WHEN {p}vr > 1.2 THEN 1.0 WHEN {p}vr IS NOT NULL THEN 0.0 END"}


@query(
    "two_index_frame", "F3 J2 F6.15",
    S.with_bars(S.INDEX_WEEK, f"b2 AS ({S.index_of('PROMO')})", f"j AS (SELECT * FROM {_index_sql('bars', 'a')} FULL JOIN {_index_sql('b2', 'b')} USING (d))")
    + by_day_sql("j", {**_one_sql("A", "a"), **_one_sql("B", "b"), "MKT_SYNC_DIRECTION": "CASE WHEN apc * bpc > 0 THEN 1.0 ELSE 0.0 END", "MKT_SYNC_STRENGTH": "abs(apc - bpc)",
                       "MKT_SENTIMENT": _mood_sql("(apc + bpc) / 2", "(aamp + bamp) / 2"), "MKT_AVG_CHANGE": "(apc + bpc) / 2", "MKT_AVG_AMP": "(aamp + bamp) / 2",
                       "MKT_SYNC_SCORE": "CASE WHEN apc IS NOT NULL AND bpc IS NOT NULL THEN 1 - least(abs(apc - bpc) / 0.02, 1.0) END"}),
)
def two_index_frame(spark, sf_dir):
    out = MK.two_index_days(SRC.index_bars(spark, sf_dir), SRC.index_bars(spark, sf_dir, "PROMO"), "A", "B")
    return by_day(out, *[c for c in out.columns if c != "d"])


@query(
    "index_state_frame", "F3 W12 Q2",
    S.with_bars(S.INDEX_WEEK, "x0 AS (SELECT *, close / lag(close) OVER (ORDER BY d) - 1 AS rr, row_number() OVER (ORDER BY d) AS pos, greatest(close - lag(close) OVER (ORDER BY d), 0) AS up, greatest(lag(close) OVER (ORDER BY d) - close, 0) AS dn FROM bars)",
                f"x1 AS (SELECT *, {dfull('stddev_samp', 'rr', 20)} AS v20, list(up) FILTER (WHERE pos > 1) OVER (ORDER BY d) AS ul, list(dn) FILTER (WHERE pos > 1) OVER (ORDER BY d) AS nl FROM x0)",
                f"x2 AS (SELECT *, CASE WHEN pos > 14 THEN {_fold('list_avg(ul[1:14])', 'ul[15:]', 1 / 14)} END AS g, CASE WHEN pos > 14 THEN {_fold('list_avg(nl[1:14])', 'nl[15:]', 1 / 14)} END AS o FROM x1)")
    + by_day_sql("x2", {"MKT_RET20": "close / lag(close, 20) OVER (ORDER BY d) - 1", "MKT_MA60": f"close / ({dfull('avg', 'close', 60)}) - 1", "MKT_VOL20_PCT": d_rank("v20", 250),
                        "MKT_DD120": f"close / ({dfull('max', 'high', 120)}) - 1", "MKT_RSI14": "100 * g / (g + o)"}, 5),
)
def index_state_frame(spark, sf_dir):
    out = MK.index_state(SRC.index_bars(spark, sf_dir))
    return by_day(out, *[c for c in out.columns if c != "d"], digits=5)


LUNAR = ", ".join(f"DATE '{x}'" for x in CAL.LUNAR_NEW_YEAR)
# Working days are listed one by one; the window around each holiday is found by counting them.
HOLIDAY_SQL = f"""days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
wd AS (SELECT w, row_number() OVER (ORDER BY w) AS k FROM (SELECT CAST(unnest(generate_series(DATE '1989-12-01', DATE '2028-12-31', INTERVAL 1 DAY)) AS DATE) AS w) WHERE isodow(w) <= 5),
hol AS (SELECT unnest([{LUNAR}]) AS h UNION SELECT make_date(y, 10, 1) FROM (SELECT unnest(generate_series(1990, 2027)) AS y)),
hb AS (SELECT h, (SELECT max(k) FROM wd WHERE w <= h) - 10 AS kb, (SELECT min(k) FROM wd WHERE w >= h + 7) AS ka FROM hol),
hw AS (SELECT h, b.w AS lo, a.w AS alo, z.w AS ahi FROM hb JOIN wd b ON b.k = kb JOIN wd a ON a.k = ka JOIN wd z ON z.k = ka + 5)"""


@query(
    "calendar_flags", "F3",
    "WITH " + HOLIDAY_SQL + "\nSELECT CAST(d AS VARCHAR) AS d, " + ", ".join(f"CAST(isodow(d) = {i + 1} AS BIGINT) AS CAL_DOW_{i}" for i in range(5)) + ", "
    + ", ".join(f"CAST(month(d) = {m} AS BIGINT) AS CAL_MONTH_{m}" for m in range(1, 13))
    + ", (SELECT count(*) FROM wd WHERE w > d AND w <= last_day(d)) AS CAL_MONTH_POS, CAST(EXISTS (SELECT 1 FROM hw WHERE (d >= lo AND d < h) OR (d >= alo AND d < ahi)) AS BIGINT) AS CAL_HOLIDAY FROM days",
)
def calendar_flags(spark, sf_dir):
    days = SRC.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    out = CAL.calendar_flags(days)
    return out.select(F.col("d").cast("string").alias("d"), *[F.col(c).cast("long").alias(c) for c in out.columns if c != "d"])


@query(
    "index_gate_conditions", "P17 W49 W29",
    S.with_bars(S.INDEX_WEEK, f"g0 AS (SELECT *, {dfull('avg', 'close', 20)} AS m20, {dfull('avg', 'close', 60)} AS m60, {dfull('avg', 'close', 250)} AS m250, close / lag(close) OVER (ORDER BY d) - 1 AS rr, max(close) OVER (ORDER BY d) AS pk FROM bars)",
                f"g1 AS (SELECT *, {dfull('stddev_samp', 'rr', 20)} AS vv FROM g0)", "g2 AS (SELECT *, lag(m20, 5) OVER (ORDER BY d) AS m20b, list(vv) FILTER (WHERE vv IS NOT NULL) OVER (ORDER BY d) AS vl FROM g1)",
                "g3 AS (SELECT *, len(list_filter(vl, lambda zz: zz <= vv)) / len(vl) AS sh, close / pk - 1 AS dd FROM g2)")
    + """SELECT CAST(d AS VARCHAR) AS d, CAST(close > m20 AS DOUBLE) AS above_ma20, CAST(close > m60 AS DOUBLE) AS above_ma60, CAST(close > m250 AS DOUBLE) AS above_ma250, CAST(m20 > m20b AS DOUBLE) AS ma20_rising,
 CASE WHEN vv IS NOT NULL THEN CASE WHEN sh <= 1.0::DOUBLE / 3 THEN 'calm' WHEN sh >= 2.0::DOUBLE / 3 THEN 'wild' ELSE 'mid' END END AS vol_tercile, CASE WHEN dd > -0.05 THEN 'shallow' WHEN dd > -0.15 THEN 'middle' ELSE 'deep' END AS drawdown_bucket FROM g3""",
)
def index_gate_conditions(spark, sf_dir):
    out = MK.market_gates(SRC.index_bars(spark, sf_dir))
    return out.withColumn("d", F.col("d").cast("string"))


@query(
    "index_exposure_rules", "W48 J8",
    S.with_bars(S.BRAND_WEEK, f"ix AS ({S.INDEX_WEEK})", "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)",
                "q0 AS (SELECT *, row_number() OVER (ORDER BY d) AS rno, close / lag(close) OVER (ORDER BY d) - 1 AS rr FROM ix)", f"q1 AS (SELECT *, {dfull('stddev_samp', 'rr', 20)} AS vv FROM q0)",
                f"q2 AS (SELECT d, CASE WHEN rno >= 200 THEN CASE WHEN close > avg(close) {dlast(200)} THEN 1.0 ELSE 0.0 END END AS t1, CASE WHEN rno >= 60 THEN CASE WHEN close > avg(close) {dlast(60)} THEN 1.0 ELSE 0.0 END END AS t2, "
                f"CASE WHEN rno >= 250 THEN CASE WHEN 1 - close / max(close) {dlast(250)} < 0.1 THEN 1.0 WHEN 1 - close / max(close) {dlast(250)} <= 0.2 THEN 0.5 ELSE 0.0 END END AS t3, "
                f"CASE WHEN count(vv) {dlast(250)} = 250 THEN CASE WHEN vv > quantile_cont(vv, 0.9) {dlast(250)} THEN 0.5 ELSE 1.0 END END AS t4 FROM q1)",
                "x AS (SELECT cal.d, q2.d AS sd, t1, t2, t3, t4 FROM cal ASOF LEFT JOIN q2 ON cal.d > q2.d)")
    + "SELECT CAST(d AS VARCHAR) AS d, CAST(sd AS VARCHAR) AS source_d, " + ", ".join(f"CAST(coalesce({t}, 1.0) AS DOUBLE) AS {t}, CAST({t} IS NULL AS DOUBLE) AS {t}_short" for t in ("t1", "t2", "t3", "t4")) + " FROM x",
)
def index_exposure_rules(spark, sf_dir):
    cal = SRC.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    out = MK.exposure(cal, SRC.index_bars(spark, sf_dir))
    return out.withColumns({"d": F.col("d").cast("string"), "source_d": F.col("source_d").cast("string")})


# ---------------------------------------------------------------- runs and event rows
CYCLE_SQL = f"""cy0 AS (SELECT *, last_value(nullif(sign(dif), 0) IGNORE NULLS) {past()} AS sg FROM mc),
cy1 AS (SELECT *, CASE WHEN sg IS NOT NULL AND sg IS DISTINCT FROM {ref('sg', 1)} THEN 1 ELSE 0 END AS fresh FROM cy0),
cy2 AS (SELECT *, sum(fresh) {past()} AS run FROM cy1),
cy3 AS (SELECT sym, run, count(*) AS len FROM cy2 WHERE sg IS NOT NULL GROUP BY 1, 2),
cy4 AS (SELECT sym, run, lag(len, 1) OVER (PARTITION BY sym ORDER BY run) + lag(len, 2) OVER (PARTITION BY sym ORDER BY run) AS cyc FROM cy3),
cyc AS (SELECT cy2.*, cyc FROM cy2 LEFT JOIN cy4 USING (sym, run))"""
# The stretch at row i: walk back to the nearest row with hist < 0, then to the row after the last one with hist >= 0 or unknown.
GREEN_SQL = f"""gr0 AS (SELECT *, 2.0 * (dif - dea) AS hist FROM cyc),
gr1 AS (SELECT *, max(CASE WHEN hist < 0 THEN pos END) {past()} AS j, max(CASE WHEN hist < 0 THEN NULL ELSE pos END) {past()} AS nz FROM gr0),
gr2 AS (SELECT a.sym, a.pos, sum(b.hist) AS area, min(b.hist) AS trough FROM gr1 a JOIN gr1 jr ON jr.sym = a.sym AND jr.pos = a.j JOIN gr0 b ON b.sym = a.sym AND b.pos BETWEEN coalesce(jr.nz, 0) + 1 AND a.j GROUP BY 1, 2),
gr AS (SELECT gr0.*, area, trough FROM gr0 LEFT JOIN gr2 USING (sym, pos))"""


@query("sign_run_cycle_and_stretch", "W39 W40", S.with_bars(*BASE, CYCLE_SQL, GREEN_SQL) + shown_sql("gr", {"cycle": "cyc", "area": "area", "trough": "trough"}, 3))
def sign_run_cycle_and_stretch(spark, sf_dir):
    panel = macd_bars(spark, sf_dir).withColumn("hist", 2.0 * (F.col("dif") - F.col("dea")))
    out = ER.negative_stretch(ER.sign_cycle(panel, "dif", "cycle"), "hist", "area", "trough")
    return shown(out, {"cycle": F.col("cycle"), "area": F.col("area"), "trough": F.col("trough")}, 3)


AMACD = (S.BRAND_WEEK, S.adjusted(), macd_sql("ac"), CYCLE_SQL, GREEN_SQL)
EVENT_ROW_SQL = (
    f"""ef0 AS (SELECT *, coalesce({ref('dif', 1)} <= {ref('dea', 1)} AND dif > dea, false) AS golden, greatest(ac - {ref('ac', 1)}, 0.0) AS up, greatest({ref('ac', 1)} - ac, 0.0) AS dn,
 greatest(ah - al, abs(ah - {ref('ac', 1)}), abs(al - {ref('ac', 1)})) AS tr, (least(open, close) - low) * (cf / close) AS lsh,
 CASE WHEN least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.5 * abs(close - open) AND least(open, close) - low >= 0.6 * (high - low) AND high > low THEN 1.0 ELSE 0.0 END AS hammer FROM gr),
ef1 AS (SELECT *, max(CAST(golden AS INT)) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rg, list(up) FILTER (WHERE pos > 1) {past()} AS ul, list(dn) FILTER (WHERE pos > 1) {past()} AS nl, list(tr) FILTER (WHERE pos > 1) {past()} AS tl FROM ef0),
ef2 AS (SELECT *, CASE WHEN pos > 14 THEN {_fold('list_avg(ul[1:14])', 'ul[15:]', 1 / 14)} END AS g14, CASE WHEN pos > 14 THEN {_fold('list_avg(nl[1:14])', 'nl[15:]', 1 / 14)} END AS o14, CASE WHEN pos > 14 THEN {_fold('list_avg(tl[1:14])', 'tl[15:]', 1 / 14)} END AS atr FROM ef1),
ef AS (SELECT sym, pos, ac, ao, al, dif, dea, 100 * g14 / (g14 + o14) AS rsi, atr, hammer, lsh, cyc, area, trough, golden, rg FROM ef2)""",
    FRACTAL_SQL, divergence_sql("fl", "ev").replace("vol AS v FROM fl l JOIN mc ON", "vol AS v FROM fl l JOIN mc ON"),
    "er AS (SELECT e.sym, e.sig_pos, e.low_pos, e.prev_pos, a AS a, b AS b, t AS t FROM ev e JOIN ef a ON a.sym = e.sym AND a.pos = e.prev_pos JOIN ef b ON b.sym = e.sym AND b.pos = e.low_pos JOIN ef t ON t.sym = e.sym AND t.pos = e.sig_pos)",
)
EVENT_COLS = {
    "RSI_DIV": "CASE WHEN a.rsi IS NOT NULL AND b.rsi IS NOT NULL THEN CASE WHEN b.al < a.al AND b.rsi > a.rsi THEN 1.0 ELSE 0.0 END END",
    "DIV_COUNT_120": "count(*) OVER (PARTITION BY sym ORDER BY sig_pos RANGE BETWEEN 119 PRECEDING AND CURRENT ROW)", "REBOUND_FROM_L2": "(t.ac - b.al) / t.atr",
    "DIV_PRICE_NEWLOW_DEPTH": "b.al / a.al - 1", "DIV_DIF_LIFT": "(b.dif - a.dif) / t.atr", "DIV_SPAN_BARS": "low_pos - prev_pos", "DAYS_SINCE_L2": "sig_pos - low_pos",
    "DIV_SPAN_VS_CYCLE": "(low_pos - prev_pos) / t.cyc", "DIV_DIF_SLOPE": "(b.dif - a.dif) / (low_pos - prev_pos) / t.atr", "DIV_ZERO_AXIS_DEPTH": "greatest(t.dif, t.dea) / t.atr",
    "DIV_DIF_LEVEL_L1": "a.dif / a.atr", "REBOUND_DAY_T": "(t.ac - t.ao) / t.atr", "HAMMER_L2": "b.hammer", "LOWER_SHADOW_L2": "b.lsh / b.atr",
    "DIV_HIST_AREA_SHRINK": "b.area / a.area", "DIV_HIST_TROUGH_SHRINK": "b.trough / a.trough",
    "DIV_GOLDEN_CROSS_STATE": "CASE WHEN t.golden THEN 2.0 WHEN t.rg > 0 THEN 1.0 ELSE 0.0 END",
}


@query("event_row_features", "F2 J12 W41 W42", S.with_bars(*AMACD, *EVENT_ROW_SQL) + shown_sql("er", EVENT_COLS, 4, keys=("sym", "sig_pos", "low_pos")))
def event_row_features(spark, sf_dir):
    panel = stored(ER.event_panel(EN.prepare(SRC.adjust(SRC.bars_brand_week(spark, sf_dir)))), "event-panel")
    out = ER.event_features(main_pool(panel).select("sym", "sig_pos", "low_pos", "prev_pos"), panel)
    return shown(out, {n: F.col(n) for n in EVENT_COLS}, 4, keys=("sym", "sig_pos", "low_pos"))


FACTOR_SQL = (
    f"""fa0 AS (SELECT *, close / {ref('close', 1)} - 1 AS pc1 FROM mc),
fa1 AS (SELECT *, {full('min', 'close', 250)} AS lo, {full('max', 'close', 250)} AS hi, {ref('close', 20)} AS c20, CASE WHEN count(vol) OVER p = 20 THEN avg(vol) OVER p END AS v20, {full('stddev_samp', 'pc1', 20)} AS s20 FROM fa0
 WINDOW p AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
fj AS (SELECT v.*, x.close AS c, x.vol, x.amount, lo, hi, c20, v20, s20, (SELECT max(y.close) FROM mc y WHERE y.sym = v.sym AND y.pos BETWEEN v.sig_pos - 60 AND v.anchor_pos) AS mx FROM v2 v JOIN fa1 x ON x.sym = v.sym AND x.pos = v.sig_pos)""",
)
FACTORS = {
    "f1": "dif_lift", "f2": "cross_dif", "f3": "cross_dif / c", "f4": "sig_pos - prev_cross_pos", "f5": "sig_pos - anchor_pos", "f6": "c / anchor_close - 1", "f7": "CASE WHEN hi > lo THEN (anchor_close - lo) / (hi - lo) END",
    "f8": "anchor_close / mx - 1", "f9": "c / c20 - 1", "f10": "vol / v20", "f11": "s20", "f12": "amount", "f13": "anchor_close / prev_anchor_close - 1",
}


@query("event_ranking_factors", "F7", S.with_bars(*BASE, *V2_SQL, *FACTOR_SQL) + shown_sql("fj", FACTORS, 4, keys=("sym", "sig_pos")))
def event_ranking_factors(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    events = E.cross_divergence_confirmed(df)
    out = ER.ranking_factors(events.withColumn("sig_pos", F.col("sig_pos").cast("long")), df.withColumn("pc1", B.pct_change("close")))
    return shown(out, {n: F.col(n) for n in FACTORS}, 4, keys=("sym", "sig_pos"))


@query(
    "event_recognizer_factors_and_seeds", "F7 P15",
    S.with_bars(*BASE, *V1_SQL, f"rc AS (SELECT v.sym, v.sig_pos, x.close / x.m120 - 1 AS g1, x.close / x.n60 - 1 AS g2, x.close / x.n120 - 1 AS g3, x.close / anchor_close - 1 AS g4, cross_dif AS g5, dif_lift AS g6, x.close / x.m21 - 1 AS dd20 FROM v1 v "
                f"JOIN (SELECT *, max(close) {last(120)} AS m120, min(close) {last(60)} AS n60, min(close) {last(120)} AS n120, max(close) {last(21)} AS m21 FROM mc) x ON x.sym = v.sym AND x.pos = v.sig_pos)")
    + shown_sql("rc", {**{f"g{i}": f"g{i}" for i in range(1, 7)}, "dd20": "dd20", "sel_S1": "CAST(dd20 <= -0.15 AND g4 > 0.02 AND g4 <= 0.08 AS INT)", "sel_S2": "CAST(dd20 <= -0.2 AND g4 > 0.02 AND g4 <= 0.08 AS INT)",
                       "sel_S3": "CAST(dd20 <= -0.25 AND g4 > 0.02 AND g4 <= 0.08 AS INT)", "sel_S4": "CAST(dd20 <= -0.15 AS INT)", "sel_S5": "CAST(dd20 <= -0.25 AS INT)"}, 4, keys=("sym", "sig_pos")),
)
def event_recognizer_factors_and_seeds(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    out = ER.seed_flags(ER.recognizer_factors(E.cross_divergence_simple(df), df)).withColumn("sig_pos", F.col("sig_pos").cast("long"))
    names = [*[f"g{i}" for i in range(1, 7)], "dd20", *[f"sel_S{i}" for i in range(1, 6)]]
    return shown(out, {n: F.col(n) for n in names}, 4, keys=("sym", "sig_pos"))


@query(
    "event_regime_filter", "P14 W36",
    S.with_bars(*MAIN_SQL, REGIME_SQL, f"m6 AS (SELECT *, {full('avg', 'close', 60)} AS ma FROM mc)")
    + "SELECT e.sym, CAST(e.sig_pos AS BIGINT) AS sig_pos, CAST(e.low_pos AS BIGINT) AS low_pos, rg.regime::DOUBLE AS regime, CAST(m6.close > m6.ma AS DOUBLE) AS above FROM main_ev e JOIN m6 ON m6.sym = e.sym AND m6.pos = e.sig_pos JOIN rg ON rg.d = m6.d WHERE rg.regime = 1 AND m6.close <= m6.ma",
)
def event_regime_filter(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    phases = MK.regime(MK.market_returns(panel), 60).select("d", "regime")
    at = panel.withColumn("ma", B.agg("mean", "close", 60)).select("sym", F.col("pos").cast("long").alias("sig_pos"), "d", "close", "ma")
    tagged = main_pool(panel).join(at, ["sym", "sig_pos"]).join(F.broadcast(phases), "d")
    kept = E.drop_outside(tagged, F.col("regime") == 1, F.col("close") <= F.col("ma"))
    return kept.select("sym", "sig_pos", "low_pos", "regime", (F.col("close") > F.col("ma")).cast("double").alias("above"))


# ---------------------------------------------------------------- event timing
def pool_with_days(spark, sf_dir):
    """Main-pool events with their day and calendar position; exits five rows later."""
    panel = macd_bars(spark, sf_dir)
    cal = SRC.calendar(panel)
    at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d", B.lead("d", 5).alias("exit_d"), L.chain_return(5).alias("ret5"))
    days = F.broadcast(cal)
    ev = main_pool(panel).join(at, ["sym", "sig_pos"]).join(days, "d")
    exits = F.broadcast(cal.select(F.col("d").alias("exit_d"), F.col("cal_pos").alias("exit_pos")))
    return stored(ev.join(exits, "exit_d", "left"), "pool-days"), cal


TIMING_SQL = (*MAIN_SQL, "cal AS (SELECT d, row_number() OVER (ORDER BY d) AS cal_pos FROM (SELECT DISTINCT d FROM mc))",
              "x5 AS (SELECT *, lead(d, 5) OVER (PARTITION BY sym ORDER BY d) AS exit_d FROM mc)",
              "te AS (SELECT e.*, x.d, c.cal_pos, x.exit_d, z.cal_pos AS exit_pos FROM main_ev e JOIN x5 x ON x.sym = e.sym AND x.pos = e.sig_pos JOIN cal c ON c.d = x.d LEFT JOIN cal z ON z.d = x.exit_d)")


@query(
    "event_gaps_and_overlaps", "W44 W45 W50",
    S.with_bars(*TIMING_SQL) + """SELECT sym, CAST(sig_pos AS BIGINT) AS sig_pos, CAST(low_pos AS BIGINT) AS low_pos, CAST(cal_pos - lag(cal_pos) OVER w AS DOUBLE) AS gap,
 CAST(cal_pos <= max(exit_pos) OVER (PARTITION BY sym ORDER BY cal_pos, low_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS overlaps, CAST(sig_pos - low_pos AS DOUBLE) AS anchor_gap FROM te WINDOW w AS (PARTITION BY sym ORDER BY cal_pos, low_pos)""",
)
def event_gaps_and_overlaps(spark, sf_dir):
    ev, _ = pool_with_days(spark, sf_dir)
    order = Window.partitionBy("sym").orderBy("cal_pos", "low_pos")
    latest = F.max("exit_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ev.select(
        "sym", "sig_pos", "low_pos", (F.col("cal_pos") - F.lag("cal_pos").over(order)).cast("double").alias("gap"),
        (F.col("cal_pos") <= latest).cast("double").alias("overlaps"), (F.col("sig_pos") - F.col("low_pos")).cast("double").alias("anchor_gap"),
    )


SEGMENT_SQL = """dc AS (SELECT cal_pos, count(*) AS c FROM te GROUP BY 1), sg0 AS (SELECT *, cal_pos - row_number() OVER (ORDER BY cal_pos) AS isl FROM dc),
sg AS (SELECT min(cal_pos) AS seg_start, max(cal_pos) AS seg_end, count(*) AS days, CAST(sum(c) AS BIGINT) AS events FROM sg0 GROUP BY isl)"""


@query(
    "event_burst_segments", "W46 T7 G21",
    S.with_bars(*TIMING_SQL, SEGMENT_SQL) + "SELECT CAST(seg_start AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end, days, events, CAST(lead(seg_start) OVER (ORDER BY seg_start) - seg_end - 1 AS DOUBLE) AS idle_after FROM sg",
)
def event_burst_segments(spark, sf_dir):
    from barloom.operators.timing import burst_segments

    ev, _ = pool_with_days(spark, sf_dir)
    out = burst_segments(ev)
    return out.select(*longs(out, "seg_start", "seg_end", "days", "events"), F.col("idle_after").cast("double").alias("idle_after"))


@query(
    "event_concurrency_curve", "W47 T7",
    S.with_bars(*TIMING_SQL, "cc AS (SELECT cal.d, cal.cal_pos, (SELECT count(*) FROM te WHERE te.cal_pos <= cal.cal_pos AND te.exit_pos >= cal.cal_pos) AS open_events FROM cal)")
    + "SELECT CAST(d AS VARCHAR) AS d, open_events FROM cc",
)
def event_concurrency_curve(spark, sf_dir):
    from barloom.operators.timing import concurrency

    ev, cal = pool_with_days(spark, sf_dir)
    out = concurrency(ev.where("exit_pos is not null"), cal)
    return out.select(F.col("d").cast("string").alias("d"), F.col("open_events").cast("long").alias("open_events"))


@query(
    "longest_bursts_and_peaks", "T7",
    S.with_bars(*TIMING_SQL, SEGMENT_SQL) + "SELECT CAST(seg_start AS BIGINT) AS seg_start, days, events FROM sg ORDER BY days DESC, seg_start LIMIT 5",
)
def longest_bursts_and_peaks(spark, sf_dir):
    from barloom.operators.timing import burst_segments

    ev, _ = pool_with_days(spark, sf_dir)
    out = burst_segments(ev).orderBy(F.desc("days"), "seg_start").limit(5)
    return out.select(*longs(out, "seg_start", "days", "events"))


@query(
    "burst_start_market_context", "G22 A15 J10",
    S.with_bars(*TIMING_SQL, SEGMENT_SQL, f"ib AS ({S.INDEX_WEEK})", "ic AS (SELECT d, close, lag(close, 1) OVER (ORDER BY d) / lag(close, 21) OVER (ORDER BY d) - 1 AS r20 FROM ib)")
    + f"SELECT CAST(seg_start AS BIGINT) AS seg_start, {r('r20')} AS ret20_before, CAST(r20 <= -0.05 AS DOUBLE) AS fell5 FROM sg JOIN cal ON cal.cal_pos = seg_start JOIN ic ON ic.d = cal.d",
)
def burst_start_market_context(spark, sf_dir):
    from barloom.operators.timing import burst_segments

    ev, cal = pool_with_days(spark, sf_dir)
    starts = burst_segments(ev).select(F.col("seg_start").alias("cal_pos"))
    index = SRC.index_bars(spark, sf_dir).withColumn("r20", sdiv(B.ref("close", 1), B.ref("close", 21)) - 1.0).select("d", "r20")
    out = starts.join(cal, "cal_pos").join(index, "d")
    return out.select(F.col("cal_pos").cast("long").alias("seg_start"), rnd("r20").alias("ret20_before"), (F.col("r20") <= -0.05).cast("double").alias("fell5"))


@query(
    "daily_signal_percentiles", "G21 A15",
    S.with_bars(*TIMING_SQL, "dc AS (SELECT d, count(*) AS c FROM te GROUP BY 1)") + "SELECT count(*) AS signal_days, CAST(sum(c) AS BIGINT) AS events, " + ", ".join(f"{r(f'quantile_cont(c, {q / 100})')} AS p{q}" for q in (25, 50, 75, 90, 95, 99)) + ", CAST(max(c) AS BIGINT) AS top FROM dc",
)
def daily_signal_percentiles(spark, sf_dir):
    ev, _ = pool_with_days(spark, sf_dir)
    daily = ev.groupBy("d").agg(F.count(F.lit(1)).alias("c"))
    qs = (25, 50, 75, 90, 95, 99)
    return daily.agg(
        F.count(F.lit(1)).alias("signal_days"), F.sum("c").alias("events"), *[rnd(F.percentile("c", F.lit(q / 100))).alias(f"p{q}") for q in qs], F.max("c").alias("top")
    )


@query(
    "phase_split_days", "W43",
    S.with_bars(*TIMING_SQL, f"ph AS (SELECT cal_pos % 6 AS phase, te.sym, mc.cf, f.cf AS cf5 FROM te JOIN mc ON mc.sym = te.sym AND mc.pos = te.sig_pos JOIN mc f ON f.sym = te.sym AND f.pos = te.sig_pos + 5)")
    + f"SELECT CAST(phase AS BIGINT) AS phase, count(*) AS n, {r('avg(cf5 / cf - 1)')} AS mean, {r('avg(cf5 / cf - 1) / stddev_samp(cf5 / cf - 1) * sqrt(10.0)', 4)} AS sharpe FROM ph GROUP BY 1",
)
def phase_split_days(spark, sf_dir):
    ev, _ = pool_with_days(spark, sf_dir)
    kept = ev.where("ret5 is not null").withColumn("phase", F.pmod("cal_pos", F.lit(6)).cast("long"))
    return kept.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("ret5")).alias("mean"), rnd(F.avg("ret5") / F.stddev_samp("ret5") * (10.0**0.5), 4).alias("sharpe")
    )
