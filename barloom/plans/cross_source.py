"""Cross-source features on weekly brand bars with stand-in side tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.features import cross_source as CS
from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import sdiv
from barloom.operators import events as E
from barloom.operators import joins as J
from barloom.plans import sqltext as S
from barloom.plans.events import LIMIT_FLAG_SQL
from barloom.plans.market import by_day, by_day_sql, dlast
from barloom.plans.registry import query
from barloom.plans.sqltext import full, last, past, ref
from barloom.plans.util import shown, shown_sql
from barloom.session import stored
from barloom.sources import bars as SRC

EXACT_FROM, RULE_FROM, SPLICE = "1998-01-05", "1995-02-06", "1998-06-01"
SWITCH = "1998-07-06"

# Stand-in side columns: turnover from volume, ratios from price and volume, industry from the brand digits (switched mid-way).
SIDE_SQL = f"""s0 AS (SELECT adj.*, dense_rank() OVER (ORDER BY d) AS cal_pos, amount / 100000.0::DOUBLE AS turnover, vol / (avg(vol) {last(5)}) AS volume_ratio, CASE WHEN n % 11 <> 0 THEN (vol + 50.0) / 100.0::DOUBLE END AS pb,
 CASE WHEN n % 7 <> 0 THEN close / (vol + 1.0) END AS pe, CASE WHEN n % 3 = 0 THEN n / 10.0::DOUBLE END AS dv, CASE WHEN n % 13 <> 0 THEN vol * 10.0 END AS free_share, close * (vol + 100.0) AS circ_mv,
 CASE WHEN d < DATE '{SWITCH}' THEN CAST(substr(sym, 7) AS BIGINT) % 2 ELSE (CAST(substr(sym, 7) AS BIGINT) // 2) % 2 END AS ind, CASE WHEN CAST(substr(sym, 7) AS BIGINT) % 5 = 3 AND d >= DATE '{SWITCH}' THEN 1.0 ELSE 0.0 END AS status FROM adj),
s1 AS (SELECT *, CAST(cal_pos - min(cal_pos) OVER (PARTITION BY sym) AS DOUBLE) AS age, CASE WHEN cal_pos % 17 <> 0 THEN pre_close * 1.3 END AS up_limit, CASE WHEN cal_pos % 17 <> 0 THEN pre_close * 0.7 END AS down_limit FROM s0),
mk AS (SELECT d, 100 * (close / lag(close) OVER (ORDER BY d) - 1) AS mkt_ret FROM ({S.INDEX_WEEK})),
pn AS (SELECT s1.*, mk.mkt_ret FROM s1 LEFT JOIN mk ON mk.d = s1.d)"""


def panel(spark, sf_dir):
    """Weekly bars with turnover, valuation, size, industry (by intervals), status, limits, age and market return."""
    adj = SRC.adjust(SRC.bars_brand_week(spark, sf_dir))
    cal = SRC.calendar(adj)
    n = F.col("n")
    out = adj.join(F.broadcast(cal), "d")
    first = adj.groupBy("sym").agg(F.min("d").alias("d")).join(F.broadcast(cal), "d").select("sym", F.col("cal_pos").alias("_listed"))
    brands = adj.select("sym").distinct()
    number = F.substring("sym", 7, 3).cast("long")
    early = brands.select("sym", F.lit("1900-01-01").cast("date").alias("start"), F.date_sub(F.lit(SWITCH).cast("date"), 1).alias("end"), (number % 2).alias("ind"))
    late = brands.select("sym", F.lit(SWITCH).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), (F.floor(number / 2) % 2).alias("ind"))
    special = brands.where(number % 5 == 3).select("sym", F.lit(SWITCH).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(1.0).alias("status"))
    out = J.interval_value(out, early.unionByName(late), ["sym"], "d", "ind", "ind")
    out = J.interval_value(out, special, ["sym"], "d", "status", "status", F.lit(0.0))
    index = SRC.index_bars(spark, sf_dir)
    market = index.select("d", (100.0 * (sdiv("close", B.ref("close", 1)) - 1.0)).alias("mkt_ret"))
    out = out.join(F.broadcast(market), "d", "left").join(first, "sym")
    has = F.pmod("cal_pos", F.lit(17)) != 0
    return out.withColumns(
        {
            "turnover": F.col("amount") / 100000.0, "volume_ratio": sdiv("vol", F.avg("vol").over(B.last(5))),
            "pb": F.when(n % 11 != 0, (F.col("vol") + 50.0) / 100.0), "pe": F.when(n % 7 != 0, F.col("close") / (F.col("vol") + 1.0)),
            "dv": F.when(n % 3 == 0, n / 10.0), "free_share": F.when(n % 13 != 0, F.col("vol") * 10.0), "circ_mv": F.col("close") * (F.col("vol") + 100.0),
            "age": (F.col("cal_pos") - F.col("_listed")).cast("double"),
            "up_limit": F.when(has, F.col("pre_close") * 1.3), "down_limit": F.when(has, F.col("pre_close") * 0.7),
        }
    ).drop("_listed").transform(stored, "panel")


def _mp(fn: str, x: str, w: int, mp: int) -> str:
    return f"CASE WHEN count({x}) {last(w)} >= {mp} THEN {fn}({x}) {last(w)} END"


def _known_rank(x: str, vals: str) -> str:
    return f"(len(list_filter({vals}, lambda zz: zz < {x})) + len(list_filter({vals}, lambda zz: zz = {x})) * 0.5) / len({vals})"


TV_SQL = f"""t0 AS (SELECT *, abs(pct) / greatest(turnover, 0.01) AS ami, 1 / pb AS bp, 1 / pe AS ep FROM pn),
t1 AS (SELECT *, list(ep) FILTER (WHERE ep IS NOT NULL) {last(500)} AS epl, avg(bp) OVER (PARTITION BY d, ind) AS mu, stddev_samp(bp) OVER (PARTITION BY d, ind) AS sd, count(bp) OVER (PARTITION BY d, ind) AS bn FROM t0)"""
TV = {
    "TURN_F20": _mp("avg", "turnover", 20, 15), "STR20": _mp("stddev_samp", "turnover", 20, 15), "ABN_TURN_21_252": f"ln(({_mp('avg', 'turnover', 21, 15)}) / ({_mp('avg', 'turnover', 252, 126)}))",
    "VOLUME_RATIO_T": "volume_ratio", "VOLUME_RATIO_MA5": _mp("avg", "volume_ratio", 5, 3), "AMIHUD_TURN20": _mp("avg", "ami", 20, 15), "LN_FREE_MV": "coalesce(ln(close * free_share), ln(circ_mv))",
    "EP_TSRANK_500": f"CASE WHEN ep IS NOT NULL AND len(epl) >= 250 THEN {_known_rank('ep', 'epl')} END", "DV_TTM": "coalesce(dv, 0)", "BP_IND_Z": "CASE WHEN bn >= 10 AND sd > 0 THEN (bp - mu) / sd END",
}


@query("turnover_and_valuation", "F5.1 W5 W13 W33", S.with_bars(S.BRAND_WEEK, S.adjusted(), SIDE_SQL, TV_SQL) + shown_sql("t1", TV, 5))
def turnover_and_valuation(spark, sf_dir):
    return shown(CS.turnover_valuation(panel(spark, sf_dir)), {n: F.col(n) for n in TV}, 5)


IND_SQL = f"""i0 AS (SELECT *, {full('avg', 'cf', 60)} AS ma60, {full('min', 'cf', 120)} AS mn120 FROM pn),
i1 AS (SELECT d, ind, CASE WHEN count(pct) >= 5 THEN avg(pct) END AS ind_ret, CASE WHEN count(ma60) >= 5 THEN avg(CASE WHEN ma60 IS NOT NULL THEN CAST(cf > ma60 AS INT) END) END AS brd,
 CASE WHEN count(mn120) >= 5 THEN avg(CASE WHEN mn120 IS NOT NULL THEN CAST(cf <= mn120 * 1.02 AS INT) END) END AS cap FROM i0 GROUP BY 1, 2),
i2 AS (SELECT *, CASE WHEN count(ind_ret) OVER w >= 15 THEN (exp(sum(ln(1 + ind_ret / 100)) OVER w) - 1) * 100 END AS mom FROM i1 WINDOW w AS (PARTITION BY ind ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ij AS (SELECT pn.*, i2.ind_ret, brd, cap, mom FROM pn LEFT JOIN i2 ON i2.d = pn.d AND i2.ind = pn.ind),
ik AS (SELECT *, ln(1 + pct / 100) AS lr, CASE WHEN mkt_ret IS NOT NULL THEN pct - mkt_ret - coalesce(ind_ret, 0) END AS rs, CASE WHEN mkt_ret IS NOT NULL THEN CAST(ind_ret IS NULL AS DOUBLE) END AS na, CASE WHEN mkt_ret IS NOT NULL THEN CAST(d >= DATE '{SPLICE}' AS DOUBLE) END AS sc FROM ij),
il AS (SELECT *, {_mp('sum', 'rs', 60, 45)} AS s60, {_mp('max', 'na', 60, 45)} AS n60, ({_mp('sum', 'sc', 60, 45)}) / nullif({_mp('count', 'sc', 60, 45)}, 0) AS sh FROM ik),
im AS (SELECT *, {ref('s60', 5)} AS rm, {ref('n60', 5)} AS rn5, {ref('sh', 5)} AS rsh, CASE WHEN count(pct) {last(20)} >= 15 THEN (exp(sum(lr) {last(20)}) - 1) * 100 END - mom AS ex FROM il)"""
IND = {
    "IND_MOM20_EQW": "ln(1 + mom / 100)", "IND_BREADTH_MA60": "brd", "IND_CAPIT_PCT120": "cap", "IND_EXCESS_RET20": "sign(ex) * ln(1 + abs(ex))",
    "RESID_MOM60": "rm", "RESID_MOM60_MKSRC": "CASE WHEN rm IS NOT NULL THEN CASE WHEN rsh >= 1 THEN 2.0 WHEN rsh <= 0 THEN 0.0 ELSE 1.0 END END", "RESID_MOM60_INDNA": "CASE WHEN rm IS NOT NULL THEN rn5 END",
}


def with_industry(p):
    return p.join(CS.industry_days(p), ["d", "ind"], "left")


@query("industry_and_residual_momentum", "F5.6 F5.7 F5.8 A9", S.with_bars(S.BRAND_WEEK, S.adjusted(), SIDE_SQL, IND_SQL) + shown_sql("im", IND, 3))
def industry_and_residual_momentum(spark, sf_dir):
    out = CS.excess_and_residual(with_industry(panel(spark, sf_dir)), SPLICE)
    # Weekly returns of this data compound to astronomic sums; logs keep the comparison within double precision.
    ex = F.col("IND_EXCESS_RET20")
    logs = {"IND_MOM20_EQW": F.log1p(F.col("IND_MOM20_EQW") / 100.0), "IND_EXCESS_RET20": F.signum(ex) * F.log1p(F.abs(ex))}
    return shown(out, {n: logs.get(n, F.col(n)) for n in IND}, 3)



FLAGS = LIMIT_FLAG_SQL.replace("FROM l1)", "FROM pn)").replace("1998-01-01", EXACT_FROM).replace("1995-06-01", RULE_FROM)
MKT_SQL = f"""tr AS (SELECT * FROM lf WHERE age >= 5),
pv AS (SELECT t.*, p.consec_limitup AS pc, p.sealed AS ps FROM tr t LEFT JOIN tr p ON p.sym = t.sym AND p.cal_pos = t.cal_pos - 1),
hl AS (SELECT *, {full('max', 'cf', 250)} AS mx, {full('min', 'cf', 250)} AS mn FROM tr),
dh AS (SELECT d, sum(CASE WHEN mx IS NOT NULL THEN CAST(cf >= mx AS INT) END) AS nh, sum(CASE WHEN mn IS NOT NULL THEN CAST(cf <= mn AS INT) END) AS nl, count(*) AS nt FROM hl GROUP BY 1),
dm AS (SELECT d, count(*) FILTER (WHERE sealed = 1) AS ns, count(*) FILTER (WHERE touched = 1) AS tc, count(*) FILTER (WHERE down_sealed = 1) AS nd, sum(amount) / sum(circ_mv) AS tow, avg(turnover) AS mto, count(*) FILTER (WHERE pc >= 1) AS pden,
 count(*) FILTER (WHERE pc >= 1 AND sealed = 1) AS pnum, avg(CASE WHEN ps = 1 THEN pct END) AS prem FROM pv GROUP BY 1),
dd AS (SELECT c.d, dm.* EXCLUDE (d), coalesce(nh, 0) AS nh, coalesce(nl, 0) AS nl, nt FROM (SELECT DISTINCT d FROM adj) c LEFT JOIN dm ON dm.d = c.d LEFT JOIN dh ON dh.d = c.d),
de AS (SELECT *, CASE WHEN d >= DATE '{RULE_FROM}' THEN CAST(nd AS DOUBLE) END AS dn, CASE WHEN count(tow) {dlast(5)} >= 3 THEN avg(tow) {dlast(5)} END AS tw5, CASE WHEN count(mto) {dlast(5)} >= 3 THEN avg(mto) {dlast(5)} END AS eq5 FROM dd),
df AS (SELECT *, list(tw5) FILTER (WHERE tw5 IS NOT NULL) {dlast(750)} AS l1, list(eq5) FILTER (WHERE eq5 IS NOT NULL) {dlast(750)} AS l2 FROM de)"""
MKT = {
    "MKT_SEAL_RATIO": f"CASE WHEN d >= DATE '{RULE_FROM}' AND tc >= 10 THEN ns / tc END", "MKT_PROMOTE_RATE": f"CASE WHEN d >= DATE '{RULE_FROM}' THEN pnum / nullif(pden, 0) END",
    "MKT_DOWNLIMIT_Z": f"CASE WHEN count(dn) {dlast(250)} >= 126 THEN (dn - avg(dn) {dlast(250)}) / nullif(stddev_samp(dn) {dlast(250)}, 0) END", "MKT_LIMITUP_PREM": "prem", "MKT_LIMITUP_PREM_MA5": f"CASE WHEN count(prem) {dlast(5)} >= 3 THEN avg(prem) {dlast(5)} END",
    "MKT_NH_NL_DIFF": "(nh - nl) / nt", "MKT_NH_NL_RATIO": "nh / nullif(nh + nl, 0)", "MKT_TURNOVER_PCTL": f"CASE WHEN tw5 IS NOT NULL AND len(l1) >= 250 THEN {_known_rank('tw5', 'l1')} END",
    "MKT_TURNOVER_PCTL_EQW": f"CASE WHEN eq5 IS NOT NULL AND len(l2) >= 250 THEN {_known_rank('eq5', 'l2')} END",
}


@query("market_mood_days", "F5.3 F5.4 F5.5 J9 A7 A8 W37", S.with_bars(S.BRAND_WEEK, S.adjusted(), SIDE_SQL, FLAGS, MKT_SQL) + by_day_sql("df", MKT, 4))
def market_mood_days(spark, sf_dir):
    p = stored(E.limit_flags(panel(spark, sf_dir), EXACT_FROM, RULE_FROM), "limit-flags")
    out = CS.market_days(p, SRC.calendar(p), RULE_FROM)
    return by_day(out, *MKT, digits=4)


@query(
    "style_relative_strength", "F5.9",
    S.with_bars(S.INDEX_WEEK, f"a AS ({S.index_of('PROMO')})", f"b AS ({S.index_of('SMALL')})",
                *[f"{n}l AS (SELECT d, ln(close / lag(close, 59) OVER (ORDER BY d)) AS v FROM {n})" for n in ("bars", "a", "b")])
    + f"SELECT CAST(z.d AS VARCHAR) AS d, {S.r('al.v - z.v')} AS STYLE_SIZE_RS60, {S.r('bl.v - z.v')} AS STYLE_GV_RS60 FROM barsl z LEFT JOIN al ON al.d = z.d LEFT JOIN bl ON bl.d = z.d",
)
def style_relative_strength(spark, sf_dir):
    out = CS.style_strength(SRC.index_bars(spark, sf_dir), {"STYLE_SIZE_RS60": SRC.index_bars(spark, sf_dir, "PROMO"), "STYLE_GV_RS60": SRC.index_bars(spark, sf_dir, "SMALL")})
    return by_day(out, "STYLE_SIZE_RS60", "STYLE_GV_RS60")


LISTING = {
    "ST_STATUS": "status", "PAR_VALUE_GAP": "ln(close)", "DAYS_BELOW_PAR": f"CAST(pos - coalesce(max(CASE WHEN close < 1500 THEN NULL ELSE pos END) {past()}, 0) AS DOUBLE)", "LIST_AGE": "ln(1 + age)",
}


@query("listing_and_status", "F5.10 J6 W18 W28", S.with_bars(S.BRAND_WEEK, S.adjusted(), SIDE_SQL) + shown_sql("pn", LISTING))
def listing_and_status(spark, sf_dir):
    return shown(CS.listing(panel(spark, sf_dir), par=1500.0), {n: F.col(n) for n in LISTING})


SECOND_SQL = f"""c0 AS (SELECT *, {full('avg', 'turnover', 20)} AS t20, {full('avg', 'turnover', 5)} AS t5, {full('avg', 'turnover', 60)} AS t60, cf / {ref('cf', 20)} - 1 AS r20, cf / {ref('cf', 5)} - 1 AS r5, {full('avg', 'cf', 20)} AS m20 FROM pn),
c1 AS (SELECT d, ind, avg(r20) AS im, avg(CASE WHEN m20 IS NOT NULL THEN CAST(cf > m20 AS INT) END) AS ib, avg(r5) AS i5 FROM c0 GROUP BY 1, 2),
c2 AS (SELECT *, CASE WHEN im IS NOT NULL THEN (rank() OVER (PARTITION BY d, im IS NULL ORDER BY im) - 1 + (count(*) OVER (PARTITION BY d, im) + 1) / 2.0) / count(im) OVER (PARTITION BY d) END AS irk,
 CASE WHEN i5 IS NOT NULL THEN (rank() OVER (PARTITION BY d, i5 IS NULL ORDER BY i5) - 1 + (count(*) OVER (PARTITION BY d, i5) + 1) / 2.0) / count(i5) OVER (PARTITION BY d) END AS i5k FROM c1),
c3 AS (SELECT c0.*, im, ib, irk, i5k FROM c0 LEFT JOIN c2 ON c2.d = c0.d AND c2.ind = c0.ind)"""
SECOND = {
    "TURN20": "t20", "ABTURN_5_60": "t5 / t60 - 1", "STDTURN20": full("stddev_samp", "turnover", 20), "FLOAT_MCAP": "ln(circ_mv)",
    "RETAIL_SENT": f"avg(CASE WHEN pct > 0 THEN turnover END) {last(20)} / avg(CASE WHEN pct < 0 THEN turnover END) {last(20)} - 1", "IND_REL_STR": "r20 - im", "IND_MOM20": "im", "IND_RS_RANK": "irk", "IND_BREADTH_MA20": "ib", "IND_RET5_RANK": "i5k", "ST_FLAG": "status",
}


@query("second_cross_source_set", "RP11", S.with_bars(S.BRAND_WEEK, S.adjusted(), SIDE_SQL, SECOND_SQL) + shown_sql("c3", SECOND, 5))
def second_cross_source_set(spark, sf_dir):
    return shown(CS.second_set_industry(panel(spark, sf_dir)), {n: F.col(n) for n in SECOND}, 5)


