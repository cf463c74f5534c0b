"""Forward labels, event outcomes, matched controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd
from barloom.operators import controls as M
from barloom.operators import events as E
from barloom.operators import joins as J
from barloom.operators import labels as L
from barloom.operators import sequential as Q
from barloom.plans import sqltext as S
from barloom.plans.events import BASE, EVE_SQL, MAIN_SQL, V1_SQL, crossed_bars, longs, main_pool, truth_sql
from barloom.plans.registry import query
from barloom.plans.sequential import _fold, macd_bars
from barloom.plans.sqltext import lead, past, r, whole
from barloom.plans.util import panel_query
from barloom.session import attach_row, stored
from barloom.sources import bars as SRC


def fwd(fn: str, x: str, lo: int, hi: int) -> str:
    over = f"OVER ({S.W} ROWS BETWEEN {lo} FOLLOWING AND {hi} FOLLOWING)"
    return f"CASE WHEN count({x}) {over} = {hi - lo + 1} THEN {fn}({x}) {over} END"


panel_query(
    "forward_returns_fixed", "L1 L2 L3 L4 UF3", "supp_month",
    lambda: {"cur5": L.close_to_close(5), "open5": L.open_to_close(5), "best5": L.best_forward(5), "chain10": L.chain_return(10),
             "chain_open10": L.chain_return_from_open(10), "mfe10": L.favourable_excursion(10), "mfe10_close": L.favourable_excursion(10, "close")},
    {"cur5": f"{lead('close', 6)} / close - 1", "open5": f"{lead('close', 6)} / {lead('open', 1)} - 1",
     "best5": f"({fwd('max', 'high', 1, 6)}) / {lead('open', 1)} - 1", "chain10": f"{lead('cf', 10)} / cf - 1",
     "chain_open10": f"{lead('close', 1)} / {lead('open', 1)} * ({lead('cf', 11)} / {lead('cf', 1)}) - 1",
     "mfe10": f"({fwd('max', 'high', 1, 10)}) / {lead('open', 1)} - 1", "mfe10_close": f"({fwd('max', 'high', 1, 10)}) / close - 1"},
)

panel_query(
    "sign_labels_two_families", "L8 UF3", "supp_month",
    lambda: {n: c for n, c in L.sign_labels().items()},
    {**{f"cur_h{h}": f"CASE WHEN {lead('close', h + 1)} IS NOT NULL THEN CASE WHEN {lead('close', h + 1)} / close - 1 > 0 THEN 1.0 ELSE 0.0 END END" for h in (3, 5, 10, 15, 20, 25, 30, 45, 60)},
     **{f"open_exec_h{h}": f"CASE WHEN {lead('close', h + 1)} IS NOT NULL THEN CASE WHEN {lead('close', h + 1)} / {lead('open', 1)} - 1 > 0 THEN 1.0 ELSE 0.0 END END" for h in (3, 5, 10, 15, 20, 25, 30, 45, 60)}},
)

ATR_SQL = ("at0 AS (SELECT *, greatest(high - low, abs(high - pre_close), abs(low - pre_close)) AS tr FROM adj)",
           f"at1 AS (SELECT *, list(tr) FILTER (WHERE pos > 1) {past()} AS tl FROM at0)",
           f"at2 AS (SELECT *, CASE WHEN pos > 14 THEN {_fold('list_avg(tl[1:14])', 'tl[15:]', 1 / 14)} END AS atr14 FROM at1)")

panel_query(
    "sniper_hits", "L6 L7 RP2 RP3", "supp_month",
    lambda: {"hit_n5_k1": L.sniper_hit(5, 1.0), "hit_n10_k2": L.sniper_hit(10, 2.0), "mae10": L.adverse_excursion(10, "close"),
             "clean10": F.when(L.favourable_excursion(10, "close").isNotNull() & F.col("atrn").isNotNull(),
                               ((L.favourable_excursion(10, "close") > 2.0 * F.col("atrn")) & (L.adverse_excursion(10, "close") > -1.0 * F.col("atrn"))).cast("double")),
             "mfe10_n": L.favourable_excursion(10) / F.col("atrn")},
    {"hit_n5_k1": f"CASE WHEN atr14 IS NOT NULL AND ({fwd('max', 'high', 1, 5)}) IS NOT NULL THEN CASE WHEN ({fwd('max', 'high', 1, 5)}) >= {lead('open', 1)} + 1.0 * atr14 THEN 1.0 ELSE 0.0 END END",
     "hit_n10_k2": f"CASE WHEN atr14 IS NOT NULL AND ({fwd('max', 'high', 1, 10)}) IS NOT NULL THEN CASE WHEN ({fwd('max', 'high', 1, 10)}) >= {lead('open', 1)} + 2.0 * atr14 THEN 1.0 ELSE 0.0 END END",
     "mae10": f"({fwd('min', 'low', 1, 10)}) / close - 1",
     "clean10": f"CASE WHEN atr14 IS NOT NULL AND ({fwd('min', 'low', 1, 10)}) IS NOT NULL THEN CASE WHEN ({fwd('max', 'high', 1, 10)}) / close - 1 > 2.0 * (atr14 / close) AND ({fwd('min', 'low', 1, 10)}) / close - 1 > -1.0 * (atr14 / close) THEN 1.0 ELSE 0.0 END END",
     "mfe10_n": f"(({fwd('max', 'high', 1, 10)}) / {lead('open', 1)} - 1) / (atr14 / close)"},
    pre=lambda p: Q.add_recursions(p, [Q.atr("high", "low", "close", 14, "atr14")]).withColumn("atrn", F.col("atr14") / F.col("close")),
    pre_sql=ATR_SQL, last_cte="at2",
)


@query(
    "dynamic_horizon_returns", "L5 J20",
    S.with_bars(*MAIN_SQL, "dy AS (SELECT *, CAST(greatest(1, least(60, round_even(0.5::DOUBLE * formation, 0))) AS BIGINT) AS h FROM main_ev)")
    + f"SELECT dy.sym, CAST(dy.sig_pos AS BIGINT) AS sig_pos, dy.h, {r('b.cf / a.cf - 1')} AS dyn FROM dy JOIN mc a ON a.sym = dy.sym AND a.pos = dy.sig_pos LEFT JOIN mc b ON b.sym = dy.sym AND b.pos = dy.sig_pos + dy.h",
)
def dynamic_horizon_returns(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    out = L.dynamic_return(main_pool(panel), panel, 0.5)
    return out.select("sym", "sig_pos", "h", rnd("dyn").alias("dyn"))


CAP_H = 10
CAP_SQL = f"""ca AS (SELECT e.sym, e.sig_pos, b.close AS buy, n.low AS nl, f.close AS fc, f.d AS fd FROM main_ev e JOIN mc b ON b.sym = e.sym AND b.pos = e.sig_pos
 LEFT JOIN mc n ON n.sym = e.sym AND n.pos = e.sig_pos + 1 LEFT JOIN mc f ON f.sym = e.sym AND f.pos = e.sig_pos + {CAP_H + 1}),
cb AS (SELECT ca.*, (nl <= buy AND fc IS NOT NULL) AS ok FROM ca),
cp AS (SELECT cb.sym, cb.sig_pos, x.pos, x.d, x.high >= buy * 1.15 AS tp, CASE WHEN x.open <= buy * 0.65 THEN x.open / buy - 1 WHEN x.low <= buy * 0.65 THEN 0.65 - 1.0 WHEN x.high >= buy * 1.15 THEN 1.15 - 1.0 END AS rr
 FROM cb JOIN mc x ON x.sym = cb.sym AND x.pos BETWEEN cb.sig_pos + 2 AND cb.sig_pos + {CAP_H + 1} WHERE ok),
cq AS (SELECT sym, sig_pos, min(d) FILTER (WHERE tp) AS td, min(d) FILTER (WHERE rr IS NOT NULL) AS sd, arg_min(rr, d) FILTER (WHERE rr IS NOT NULL) AS sr FROM cp GROUP BY 1, 2)"""


@query(
    "capped_forward_returns", "L9 L10 L19",
    S.with_bars(*MAIN_SQL, CAP_SQL) + f"""SELECT cb.sym, CAST(cb.sig_pos AS BIGINT) AS sig_pos, CASE WHEN ok THEN {r('CASE WHEN td IS NOT NULL THEN 0.15 ELSE fc / buy - 1 END')} END AS take_profit,
 CASE WHEN ok THEN CAST(coalesce(td, fd) AS VARCHAR) END AS take_profit_d, CASE WHEN ok THEN {r('coalesce(sr, fc / buy - 1)')} END AS stop_profit,
 CASE WHEN ok THEN CAST(coalesce(sd, fd) AS VARCHAR) END AS stop_profit_d FROM cb LEFT JOIN cq USING (sym, sig_pos)""",
)
def capped_forward_returns(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    out = L.capped_returns(main_pool(panel).select("sym", "sig_pos"), panel, CAP_H)
    return out.select("sym", "sig_pos", rnd("take_profit").alias("take_profit"), F.col("take_profit_d").cast("string").alias("take_profit_d"),
                      rnd("stop_profit").alias("stop_profit"), F.col("stop_profit_d").cast("string").alias("stop_profit_d"))


# ---------------------------------------------------------------- outcomes
BUDGET = 10_000_000.0
PRICED_SQL = """pc0 AS (SELECT *, dense_rank() OVER (ORDER BY d) AS cal_pos FROM mc),
pb AS (SELECT *, CASE WHEN cal_pos % 17 <> 0 THEN pre_close * 1.25 END AS up_limit, CASE WHEN cal_pos % 17 <> 0 THEN pre_close * 0.75 END AS down_limit FROM pc0)"""
ROOM = min(BUDGET + 1e-6 - 5.0, (BUDGET + 1e-6) / 1.00025)


def priced(panel):
    """Weekly bars with stand-in +-25% limits (absent on every 17th calendar day)."""
    placed = panel.join(F.broadcast(SRC.calendar(panel)), "d")
    has = F.pmod("cal_pos", F.lit(17)) != 0
    limited = placed.withColumns({"up_limit": F.when(has, F.col("pre_close") * 1.25), "down_limit": F.when(has, F.col("pre_close") * 0.75)})
    return stored(limited, "priced-bars")


def outcome_sql(entries: str, horizon: int, tp: float | None = None, sl: float | None = None, keys: str = "sym, sig_pos", bands: bool = False, bars: str = "pb") -> str:
    """CTE oc over entries(keys, status, entry_pos, entry_price): scan all later rows of the symbol, take the first exit."""
    if bands or tp is not None:
        t, s = ("x.tp", "x.sl") if bands else (f"{tp}::DOUBLE", f"{sl}::DOUBLE")
        up, dn = f"entry_price * (1.0 + {t})", f"entry_price * (1.0 + {s})"
        trig = f"""CASE WHEN x.low <= {dn} + 0.005 THEN CASE WHEN x.open <= {dn} + 0.005 THEN x.open ELSE {dn} END
 WHEN x.high >= {up} - 0.005 THEN CASE WHEN x.open >= {up} - 0.005 THEN x.open ELSE {up} END WHEN x.pos - entry_pos + 1 >= {horizon} THEN x.close END"""
        why = f"CASE WHEN x.low <= {dn} + 0.005 THEN 'sl' WHEN x.high >= {up} - 0.005 THEN 'tp' ELSE 'horizon' END"
    else:
        trig, why = f"CASE WHEN x.pos - entry_pos + 1 >= {horizon} THEN x.close END", "'horizon'"
    on = " AND ".join(f"e.{k.strip()} = z.{k.strip()}" for k in keys.split(","))
    ek = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""oe AS (SELECT *, CASE WHEN status = 'entered' THEN floor({ROOM!r}::DOUBLE / entry_price / 100) * 100 END AS shares FROM {entries}),
os AS (SELECT * EXCLUDE (status), CASE WHEN status = 'entered' AND shares <= 0 THEN 'dropped_cash' ELSE status END AS status FROM oe),
ox AS (SELECT {ek}, x.pos, x.d, {trig} AS raw, {why} AS why, NOT coalesce(x.close <= x.down_limit + 0.005, false) AS free
 FROM os e JOIN {bars} x ON x.sym = e.sym AND x.pos > e.entry_pos WHERE e.status = 'entered'),
oz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn FROM ox WHERE raw IS NOT NULL AND free) WHERE rn = 1),
o1 AS (SELECT e.*, z.pos AS exit_pos, z.d AS exit_d, CASE WHEN z.pos IS NOT NULL THEN z.why END AS exit_reason, z.raw * (1.0 - 0.001) AS exit_price, greatest(5.0, shares * entry_price * 0.00025) AS buy_fee FROM os e LEFT JOIN oz z ON {on}),
oc AS (SELECT * EXCLUDE (status), CASE WHEN status <> 'entered' THEN status WHEN exit_pos IS NOT NULL THEN 'closed' ELSE 'incomplete' END AS status,
 (shares * exit_price - shares * entry_price - buy_fee - greatest(5.0, shares * exit_price * 0.00025) - shares * exit_price * CASE WHEN exit_d < DATE '2023-08-28' THEN 0.001 ELSE 0.0005 END) / (shares * entry_price + buy_fee) AS net_ret FROM o1)"""


def entry_sql(src: str, offset: str = "1", name: str = "en", sig: str = "sig_pos") -> str:
    return f"""{name} AS (SELECT e.*, e.{sig} + {offset} AS entry_pos, CASE WHEN b.open IS NULL THEN 'dropped_no_next' WHEN b.open >= b.up_limit - 0.005 THEN 'dropped_limitup' ELSE 'entered' END AS status,
 b.open * (1.0 + 0.001) AS entry_price FROM {src} e LEFT JOIN pb b ON b.sym = e.sym AND b.pos = e.{sig} + {offset})"""


OUT_COLS = f"sym, CAST(sig_pos AS BIGINT) AS sig_pos, status, CAST(exit_pos AS DOUBLE) AS exit_pos, exit_reason, {r('net_ret')} AS net_ret"


def _outcome_cols(out, *more):
    return out.select("sym", *longs(out, "sig_pos"), *more, "status", F.col("exit_pos").cast("double").alias("exit_pos"), "exit_reason", rnd("net_ret").alias("net_ret"))


@query(
    "outcome_horizon_exit", "L11 J24 S19",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL, entry_sql("v1"), outcome_sql("en", 5)) + f"SELECT {OUT_COLS} FROM oc",
)
def outcome_horizon_exit(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    entries = stored(L.market_entries(E.cross_divergence_simple(df).select("sym", "sig_pos"), bars), "entries")
    return _outcome_cols(L.outcomes(entries, bars, L.ExitRule(5, budget=BUDGET)))


@query(
    "outcome_barrier_exit", "L11 J20",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL, entry_sql("v1"), outcome_sql("en", 12, 0.25, -0.14)) + f"SELECT {OUT_COLS} FROM oc",
)
def outcome_barrier_exit(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    entries = stored(L.market_entries(E.cross_divergence_simple(df).select("sym", "sig_pos"), bars), "entries")
    return _outcome_cols(L.outcomes(entries, bars, L.ExitRule(12, 0.25, -0.14, BUDGET)))


BAND_SQL = f"""vb0 AS (SELECT *, CASE WHEN pre_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END AS tr FROM pb),
vb1 AS (SELECT *, {S.full('avg', 'tr', 14)} AS atr FROM vb0), vm AS (SELECT d, avg(atr) AS mkt FROM vb1 WHERE atr > 0 GROUP BY 1),
vb2 AS (SELECT vb1.*, coalesce(lag(CASE WHEN atr > 0 THEN atr / mkt END) {whole().replace('sym', 'vb1.sym').replace('ORDER BY d', 'ORDER BY vb1.d')}, 1.0) AS kk FROM vb1 LEFT JOIN vm ON vm.d = vb1.d),
vb AS (SELECT *, CASE WHEN kk >= 1.2 THEN 0.25 * 1.5 WHEN kk <= 0.8 THEN 0.25 * 0.7 ELSE 0.25 END::DOUBLE AS tp, CASE WHEN kk >= 1.2 THEN -0.14 * 1.3 ELSE -0.14 END::DOUBLE AS sl FROM vb2)"""


@query(
    "outcome_volatility_bands", "L11 Q4 A11 J8",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL, BAND_SQL, entry_sql("v1"), outcome_sql("en", 12, bands=True, bars="vb")) + f"SELECT {OUT_COLS} FROM oc",
)
def outcome_volatility_bands(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df).withColumn("_tr", B.true_range("high", "low", "close"))
    rule = L.ExitRule(12, 0.25, -0.14, BUDGET)
    bars = L.volatility_bands(bars.withColumn("atr", B.agg("mean", "_tr", 14)), rule, 0.8, 1.2, 0.7, 1.5, 1.3)
    entries = stored(L.market_entries(E.cross_divergence_simple(df).select("sym", "sig_pos"), bars), "entries")
    return _outcome_cols(L.outcomes(entries, bars, rule))


@query(
    "outcome_pullback_order", "E21 L17",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL,
                """pf AS (SELECT e.sym, e.sig_pos, count(*) AS seen, min(x.pos) FILTER (WHERE NOT coalesce(x.open >= x.up_limit - 0.005, false) AND x.low <= anchor_close * 1.05) AS fp
 FROM v1 e JOIN pb x ON x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 20 GROUP BY 1, 2),
en AS (SELECT e.sym, e.sig_pos, fp AS entry_pos, CASE WHEN seen IS NULL THEN 'dropped_no_next' WHEN fp IS NULL THEN 'no_fill' ELSE 'entered' END AS status,
 least(b.open, anchor_close * 1.05) * (1.0 + 0.001) AS entry_price FROM v1 e LEFT JOIN pf USING (sym, sig_pos) LEFT JOIN pb b ON b.sym = e.sym AND b.pos = fp)""",
                outcome_sql("en", 12, 0.25, -0.14)) + f"SELECT {OUT_COLS} FROM oc",
)
def outcome_pullback_order(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    events = E.cross_divergence_simple(df).select("sym", F.col("sig_pos").cast("long").alias("sig_pos"), "anchor_close")
    entries = stored(L.limit_order_entries(events, bars, 0.05), "entries")
    return _outcome_cols(L.outcomes(entries, bars, L.ExitRule(12, 0.25, -0.14, BUDGET)))


@query(
    "outcome_not_breached", "E20 L17",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL,
                """br AS (SELECT e.sym, e.sig_pos, any_value(b.close) AS ref, min(x.low) AS wl FROM v1 e JOIN pb b ON b.sym = e.sym AND b.pos = e.sig_pos LEFT JOIN pb x ON x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 3 GROUP BY 1, 2)""",
                entry_sql("br", "4", "e0"),
                "en AS (SELECT * EXCLUDE (status), CASE WHEN status = 'dropped_no_next' THEN status WHEN wl < ref * (1.0 - 0.9) - 0.005 THEN 'skipped_breach' ELSE status END AS status FROM e0)",
                outcome_sql("en", 5)) + f"SELECT {OUT_COLS} FROM oc",
)
def outcome_not_breached(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    events = E.cross_divergence_simple(df).select("sym", F.col("sig_pos").cast("long").alias("sig_pos"))
    return _outcome_cols(L.outcomes(stored(L.not_breached_entries(events, bars, 3, 0.9), "entries"), bars, L.ExitRule(5, budget=BUDGET)))


@query(
    "outcome_breakout", "E20 L17",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL,
                """bo AS (SELECT e.sym, e.sig_pos, max(x.high) AS hr, count(x.pos) AS k FROM v1 e LEFT JOIN pb x ON x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 2 GROUP BY 1, 2),
bt AS (SELECT bo.*, (SELECT min(x.pos) FROM pb x WHERE x.sym = bo.sym AND x.pos BETWEEN bo.sig_pos + 3 AND bo.sig_pos + 7 AND x.close > bo.hr + 0.005) AS trig FROM bo)""",
                entry_sql("bt", "1", "e0", "trig"),
                "en AS (SELECT * EXCLUDE (status), CASE WHEN k < 2 THEN 'dropped_no_next' WHEN trig IS NULL THEN 'skipped_no_trigger' ELSE status END AS status FROM e0)",
                outcome_sql("en", 5)) + f"SELECT {OUT_COLS} FROM oc",
)
def outcome_breakout(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    events = E.cross_divergence_simple(df).select("sym", F.col("sig_pos").cast("long").alias("sig_pos"))
    return _outcome_cols(L.outcomes(stored(L.breakout_entries(events, bars, 2), "entries"), bars, L.ExitRule(5, budget=BUDGET)))


@query(
    "outcome_eve_entries", "L16 E12",
    S.with_bars(*BASE, *EVE_SQL, PRICED_SQL,
                """ee AS (SELECT e.variant, e.sym, e.eve_pos, e.eve_pos AS sig_pos, e.c_star, b.close, e.eve_pos + 1 AS entry_pos,
 CASE WHEN b.open <= c_star THEN b.open WHEN b.low <= c_star THEN c_star END AS entry_price, coalesce(b.open >= b.up_limit - 0.005, false) AS locked FROM eve e JOIN pb b ON b.sym = e.sym AND b.pos = e.eve_pos + 1),
en AS (SELECT *, CASE WHEN locked OR entry_price IS NULL THEN 'unfilled' ELSE 'entered' END AS status FROM ee)""",
                outcome_sql("en", 12, 0.25, -0.14, keys="variant, sym, eve_pos"),
                """nx AS (SELECT e.variant, e.sym, e.eve_pos, min(x.pos) AS np FROM en e JOIN pb x ON x.sym = e.sym AND x.pos > e.entry_pos AND NOT coalesce(x.close <= x.down_limit + 0.005, false) GROUP BY 1, 2, 3)""")
    + """SELECT oc.variant, oc.sym, CAST(oc.eve_pos AS BIGINT) AS eve_pos, CASE WHEN oc.status IN ('unfilled', 'dropped_cash') THEN oc.status WHEN oc.close > c_star THEN 'confirmed_' || oc.status ELSE 'failed_' || CASE WHEN np IS NULL THEN 'incomplete' ELSE 'closed' END END AS status,
 CAST(CASE WHEN oc.status IN ('unfilled', 'dropped_cash') THEN NULL WHEN oc.close > c_star THEN oc.exit_pos ELSE np END AS DOUBLE) AS exit_pos FROM oc LEFT JOIN nx USING (variant, sym, eve_pos)""",
)
def outcome_eve_entries(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    keys, rule = ("variant", "sym", "eve_pos"), L.ExitRule(12, 0.25, -0.14, BUDGET)
    entries = stored(L.eve_entries(E.eve_candidates(df).select(*keys, "target_pos", "c_star"), bars, "limit"), "entries")
    done = L.outcomes(entries, bars, rule, keys).select(*keys, "status", "confirmed", "exit_pos")
    failed = L.next_open_exit(entries, bars, rule, keys).select(*keys, F.col("status").alias("fail_status"), F.col("exit_pos").alias("fail_pos"))
    out = done.join(failed, list(keys), "left")
    idle = F.col("status").isin("unfilled", "dropped_cash", "dropped_no_quote")
    return out.select(
        "variant", "sym", *longs(out, "eve_pos"),
        F.when(idle, F.col("status")).when(F.col("confirmed"), F.concat(F.lit("confirmed_"), "status")).otherwise(F.concat(F.lit("failed_"), "fail_status")).alias("status"),
        F.when(~idle, F.when(F.col("confirmed"), F.col("exit_pos")).otherwise(F.col("fail_pos"))).cast("double").alias("exit_pos"),
    )


@query(
    "benchmark_excess_returns", "L13 L14 J4",
    S.with_bars(*MAIN_SQL, f"ib AS ({S.INDEX_WEEK})")
    + f"""SELECT e.sym, CAST(e.sig_pos AS BIGINT) AS sig_pos, {r('y.close / x.close - 1')} AS ret10, {r('(y.close / x.close - 1) - (j.close / i.close - 1)')} AS excess FROM main_ev e
 JOIN mc x ON x.sym = e.sym AND x.pos = e.sig_pos JOIN mc y ON y.sym = e.sym AND y.pos = e.sig_pos + 10 LEFT JOIN ib i ON i.d = x.d LEFT JOIN ib j ON j.d = y.d""",
)
def benchmark_excess_returns(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d", B.lead("d", 10).alias("exit_d"), (B.lead("close", 10) / F.col("close") - 1.0).alias("ret10"))
    out = main_pool(panel).join(at, ["sym", "sig_pos"]).where("ret10 is not null")
    out = L.benchmark_excess(out, SRC.index_bars(spark, sf_dir), "d", "exit_d", "ret10")
    return out.select("sym", "sig_pos", rnd("ret10").alias("ret10"), rnd("excess").alias("excess"))


# ---------------------------------------------------------------- controls (checked by their law)
@query(
    "controls_same_symbol", "M1 J17",
    S.with_bars(*MAIN_SQL, "e AS (SELECT sym, count(*) AS k, count(DISTINCT sig_pos) AS s FROM main_ev GROUP BY 1)", "n AS (SELECT sym, count(*) - 33 AS pool FROM mc GROUP BY 1)")
    + "SELECT e.sym, CAST(k AS BIGINT) AS controls, CAST(0 AS BIGINT) AS on_signal, CAST(0 AS BIGINT) AS in_warmup, CAST(least(k, pool - s) AS BIGINT) AS distinct_rows FROM e JOIN n USING (sym) WHERE pool > s",
)
def controls_same_symbol(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    events = main_pool(panel).withColumn("event_id", F.concat_ws("_", "sym", "sig_pos", "low_pos"))
    drawn = M.same_symbol_controls(events, panel, 7, 33)
    signal = events.select("sym", F.col("sig_pos").alias("ctrl_pos"), F.lit(1).alias("_s")).distinct()
    checked = drawn.join(signal, ["sym", "ctrl_pos"], "left")
    return checked.groupBy("sym").agg(
        F.count(F.lit(1)).alias("controls"), F.count("_s").alias("on_signal"), F.count_if(F.col("ctrl_pos") <= 33).alias("in_warmup"),
        F.count_distinct("ctrl_pos").alias("distinct_rows"),
    )


@query(
    "controls_same_day", "M2 J17",
    S.with_bars(*MAIN_SQL, "e AS (SELECT m.sym, mc.d FROM main_ev m JOIN mc ON mc.sym = m.sym AND mc.pos = m.sig_pos)",
                "p AS (SELECT d, count(*) AS pool FROM mc WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.sym = mc.sym AND e.d = mc.d) GROUP BY 1)")
    + "SELECT CAST(e.d AS VARCHAR) AS d, count(*) AS controls, CAST(0 AS BIGINT) AS with_event FROM e JOIN p ON p.d = e.d GROUP BY 1",
)
def controls_same_day(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d")
    events = main_pool(panel).join(at, ["sym", "sig_pos"]).withColumn("event_id", F.concat_ws("_", "sym", "sig_pos", "low_pos"))
    drawn = M.same_day_controls(events, panel, 11)
    same = events.select(F.col("sym").alias("ctrl_sym"), "d", F.lit(1).alias("_s")).distinct()
    return drawn.join(same, ["ctrl_sym", "d"], "left").groupBy(F.col("d").cast("string").alias("d")).agg(
        F.count(F.lit(1)).alias("controls"), F.count("_s").alias("with_event")
    )


@query(
    "random_anchor_coverage", "M3",
    S.with_bars(*BASE, *V1_SQL, truth_sql(20, "t20"),
                "m AS (SELECT sym, count(*) AS m FROM v1 GROUP BY 1)", "n AS (SELECT sym, max(pos) AS n FROM mc GROUP BY 1)",
                "j AS (SELECT t.sym, low_pos, coalesce(m, 0) AS m, n FROM t20 t LEFT JOIN m USING (sym) JOIN n USING (sym))")
    + f"""SELECT {r('avg(1 - pow(1 - (least(low_pos + 5, n) - greatest(low_pos - 5, 1) + 1) / n::DOUBLE, m))')} AS cover_le5, {r('avg(1 - pow(1 - (least(low_pos + 10, n) - greatest(low_pos - 10, 1) + 1) / n::DOUBLE, m))')} AS cover_le10 FROM j""",
)
def random_anchor_coverage(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    anchors = E.cross_divergence_simple(df).groupBy("sym").agg(F.count(F.lit(1)).alias("m"))
    rows = df.groupBy("sym").agg(F.max("pos").alias("n"))
    out = M.random_anchor_coverage(E.truth_lows(df, 20), anchors, rows, (5, 10))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("random_anchor_repetitions", "M3 UF6")
def random_anchor_repetitions(spark, sf_dir):
    """Mean share of truth lows within 5 rows of random anchors over 200 seeded draws, with its spread."""
    df = crossed_bars(spark, sf_dir)
    anchors = E.cross_divergence_simple(df).groupBy("sym").agg(F.count(F.lit(1)).alias("m"))
    rows = df.groupBy("sym").agg(F.max("pos").alias("n"))
    draws = M.random_anchor_draws(anchors, rows, 200, 5)
    truth = E.truth_lows(df, 20).select("sym", "low_pos")
    near = J.band_matches(
        truth.withColumn("lid", F.col("low_pos")), draws.select("sym", F.col("anchor_pos").alias("low_pos"), "rep"), "sym", "low_pos", 5, "lid", "rep"
    )
    hits = near.select("rep", "sym", "lid").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("hit"))
    total = truth.agg(F.count(F.lit(1)).alias("lows"))
    share = attach_row(hits, total).select((F.col("hit") / F.col("lows")).alias("s"))
    return share.agg(F.count(F.lit(1)).alias("draws"), rnd(F.avg("s")).alias("mean_cover"), rnd(F.stddev_samp("s")).alias("sd_cover"))


@query("spot_check_cells", "M4")
def spot_check_cells(spark, sf_dir):
    bars = SRC.bars_user_day(spark, sf_dir)
    return M.spot_sample(bars.select("sym", "d"), 25, 3, ["sym", "d"]).select("sym", F.col("d").cast("string").alias("d"))


@query("day_block_bootstrap", "M5")
def day_block_bootstrap(spark, sf_dir):
    """Mean event return with a 90% interval from 5,000 and from 20,000 day-resampled draws."""
    panel = macd_bars(spark, sf_dir).withColumn("ret", L.chain_return(5))
    at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d", "ret")
    events = main_pool(panel).join(at, ["sym", "sig_pos"]).where("ret is not null")
    per_day = stored(events.groupBy("d").agg(F.sum("ret").alias("s"), F.count(F.lit(1)).alias("c")), "per-day")
    out = None
    for n in (5_000, 20_000):
        one = M.day_bootstrap(per_day, "s", "c", n, 17).agg(
            F.count("mean").alias("draws"), rnd(F.avg("mean")).alias("mean"), rnd(F.percentile("mean", F.lit(0.05))).alias("lo"), rnd(F.percentile("mean", F.lit(0.95))).alias("hi")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("shuffled_column_same_multiset", "RP13 M2", S.with_bars(S.SUPP_MONTH) + f"SELECT CAST(d AS VARCHAR) AS d, count(*) AS members, {r('sum(vol)')} AS total, {r('max(vol)')} AS top FROM bars GROUP BY 1")
def shuffled_column_same_multiset(spark, sf_dir):
    bars = SRC.bars_supp_month(spark, sf_dir).select("sym", "d", "vol")
    out = M.shuffled_within(bars, ["d"], "vol", ["sym"], 5, "shuffled")
    return out.groupBy(F.col("d").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("members"), rnd(F.sum("shuffled")).alias("total"), rnd(F.max("shuffled")).alias("top"))
