"""Pattern events and event-set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd
from barloom.operators import events as E
from barloom.operators import joins as J
from barloom.operators import sequential as Q
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sequential import FRACTAL_SQL, ZIGZAG_SQL, macd_bars, macd_sql, spaced_sql
from barloom.plans.sqltext import past, r, ref, whole
from barloom.plans.util import shown, shown_sql
from barloom.session import stored
from barloom.sources import bars as SRC

BASE = (S.BRAND_WEEK, S.adjusted(), macd_sql())


def longs(df, *names):
    return [F.col(n).cast("long").alias(n) for n in names]


def longs_sql(*names):
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# ---------------------------------------------------------------- divergence between lows
def divergence_sql(lows: str, name: str = "ev", decline=0.0, change=0.001, lookback=2, below_zero=False, volume=None, triple=False, warmup=33) -> str:
    def ok(k: int) -> str:
        parts = [f"c < c{k} * (1.0 - {decline})", f"m > m{k} + {change}"]
        if below_zero:
            parts += ["z < 0", f"z{k} < 0"]
        if volume is not None:
            parts.append(f"v < v{k} * {volume}")
        return " AND ".join(parts)

    lags = ", ".join(
        f"lag({c}, {k}) OVER (PARTITION BY sym ORDER BY low_pos) AS {c}{k}" for k in (1, 2) for c in ("low_pos", "c", "m", "z", "v")
    )
    if triple:
        body = (f"{name}2 AS (SELECT *, coalesce({ok(1)}, false) AS ok1 FROM {name}1), "
                f"{name}3 AS (SELECT *, CASE WHEN ok1 AND lag(ok1) OVER (PARTITION BY sym ORDER BY low_pos) THEN 1 END AS rank FROM {name}2)")
    else:
        cases = " ".join(f"WHEN {ok(k)} THEN {k}" for k in range(1, lookback + 1))
        body = f"{name}3 AS (SELECT *, CASE {cases} END AS rank FROM {name}1)"
    return (
        f"{name}0 AS (SELECT l.sym, l.low_pos, l.sig_pos, close AS c, dif AS m, dif AS z, vol AS v FROM {lows} l JOIN mc ON mc.sym = l.sym AND mc.pos = l.low_pos), "
        f"{name}1 AS (SELECT *, {lags} FROM {name}0), {body}, "
        f"{name} AS (SELECT sym, sig_pos, low_pos, CASE rank WHEN 1 THEN low_pos1 ELSE low_pos2 END AS prev_pos, rank, "
        f"low_pos - CASE rank WHEN 1 THEN low_pos1 ELSE low_pos2 END AS formation FROM {name}3 WHERE rank IS NOT NULL AND sig_pos > {warmup})"
    )


ZZ_LOWS = "zl AS (SELECT sym, found AS low_pos, pos AS sig_pos FROM zz WHERE found IS NOT NULL)"
MAIN_SQL = (*BASE, FRACTAL_SQL, divergence_sql("fl", "main_ev"))
BACKUP_SQL = (ZIGZAG_SQL.replace("PCT", "0.05"), ZZ_LOWS, divergence_sql("zl", "backup_ev"))
EVENT_COLS = "sym, " + longs_sql("sig_pos", "low_pos", "prev_pos", "rank", "formation")


def main_pool(panel):
    return stored(E.divergences(panel, E.fractal_lows(panel, "close", 3), E.DivergenceRule()), "main-pool")


def backup_pool(panel):
    return stored(E.divergences(panel, Q.zigzag_lows(panel, "close", 0.05), E.DivergenceRule()), "backup-pool")


@query("fractal_divergence_events", "E6 E26 UF7", S.with_bars(*MAIN_SQL) + f"SELECT {EVENT_COLS} FROM main_ev")
def fractal_divergence_events(spark, sf_dir):
    return main_pool(macd_bars(spark, sf_dir))


@query("zigzag_divergence_events", "E6 E2", S.with_bars(*BASE, *BACKUP_SQL) + f"SELECT {EVENT_COLS} FROM backup_ev")
def zigzag_divergence_events(spark, sf_dir):
    return backup_pool(macd_bars(spark, sf_dir))


@query(
    "strict_divergence_events", "E6 Q9 UF7",
    S.with_bars(*BASE, FRACTAL_SQL, spaced_sql("fl", 5),
                divergence_sql("kept", "ev", decline=0.02, below_zero=True, volume=1.2))
    + f"SELECT {EVENT_COLS} FROM ev",
)
def strict_divergence_events(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    lows = E.min_separation(E.fractal_lows(panel, "close", 3), 5)
    return E.divergences(panel, lows, E.DivergenceRule(min_decline=0.02, below_zero=True, volume_ratio=1.2))


@query("triple_divergence_events", "E7", S.with_bars(*BASE, FRACTAL_SQL, divergence_sql("fl", "ev", triple=True)) + f"SELECT {EVENT_COLS} FROM ev")
def triple_divergence_events(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    return E.divergences(panel, E.fractal_lows(panel, "close", 3), E.DivergenceRule(triple=True))


# ---------------------------------------------------------------- grid and V lows, pair comparison
GRID_SQL = """g0 AS (SELECT sym, pos, close, unnest([(pos - 1) // 3, (pos - 1) // 3 - 1]) AS slot FROM SRC),
g1 AS (SELECT sym, slot, arg_min(pos, row(close, pos)) AS low_pos, count(*) AS members FROM g0 WHERE slot >= 0 GROUP BY 1, 2),
gl AS (SELECT sym, low_pos, min(slot) * 3 + 6 AS avail_pos FROM g1 COND GROUP BY 1, 2)"""


@query(
    "grid_lows", "E3", S.with_bars(S.BRAND_WEEK, S.adjusted(), GRID_SQL.replace("SRC", "adj").replace("COND", ""))
    + f"SELECT sym, {longs_sql('low_pos', 'avail_pos')} FROM gl",
)
def grid_lows(spark, sf_dir):
    return E.grid_lows(SRC.adjust(SRC.bars_brand_week(spark, sf_dir)))


V_FLAG = """vf AS (SELECT *, coalesce(count(close) OVER a = 3 AND count(close) OVER b = 2 AND close <= min(close) OVER a AND close < min(close) OVER b, false) AS is_low
 FROM SRC WINDOW a AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))"""
V_SQL = (V_FLAG.replace("SRC", "mc"), "vl AS (SELECT sym, pos AS low_pos, pos + 2 AS sig_pos FROM vf WHERE is_low)", spaced_sql("vl", 3, "vk"))


@query("v_shape_lows", "E5 Q9", S.with_bars(*BASE, *V_SQL) + f"SELECT sym, {longs_sql('low_pos', 'sig_pos')} FROM vk")
def v_shape_lows(spark, sf_dir):
    return E.v_shape_lows(SRC.adjust(SRC.bars_brand_week(spark, sf_dir)))


def pair_sql(lows: str) -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for k in (1, 2) for c in ("low_pos", "d", "close", "dif", "vol"))
    one = lambda k: (
        f"SELECT sym, low_pos, d, low_pos_{k} AS prev_pos, d_{k} AS prev_d, {k} AS rank, close, close_{k} AS pc, dif, dif_{k} AS pm, vol, vol_{k} AS pv FROM pc1 WHERE rn >= 3"
    )
    return f"""pc1 AS (SELECT l.sym, l.low_pos, mc.d, close, dif, vol, row_number() OVER w AS rn, {lags} FROM {lows} l JOIN mc ON mc.sym = l.sym AND mc.pos = l.low_pos
 WINDOW w AS (PARTITION BY l.sym ORDER BY l.low_pos)),
pc2 AS ({one(1)} UNION ALL {one(2)}),
pc3 AS (SELECT *, (close - pc) / pc AS decline, CASE WHEN pm = 0 THEN 0 ELSE (dif - pm) / abs(pm) END AS rise, low_pos - prev_pos AS formation FROM pc2
 WHERE low_pos - prev_pos >= 5 AND close < pc AND dif > pm + 0.001),
pairs AS (SELECT *, least(1.0, abs(decline) / 0.1) * 0.4 + least(1.0, rise / 0.1) * 0.6 AS strength,
 CASE WHEN vol < pv THEN 'bullish' WHEN vol > pv * 1.5 THEN 'bearish' ELSE 'neutral' END AS volume_signal,
 abs(rise / CASE WHEN abs(decline) > 1e-6 THEN decline ELSE 1e-6 END) AS ratio, (abs(decline) + abs(rise)) / 2.0 AS magnitude,
 CAST(decline < -0.02 AND rise > 0.01 AS BIGINT) AS confirmed, CAST(formation < 3 AS BIGINT) AS is_quick, CAST(formation <= 3 AS BIGINT) AS quick_pair FROM pc3)"""


PAIR_COLS = (f"sym, CAST(d AS VARCHAR) AS d, CAST(prev_d AS VARCHAR) AS prev_d, {longs_sql('low_pos', 'prev_pos', 'rank', 'formation')}, "
             f"{r('decline')} AS decline, {r('rise', 4)} AS rise, {r('strength', 4)} AS strength, volume_signal, {r('magnitude', 4)} AS magnitude, confirmed, is_quick, quick_pair")


def _pairs_out(pairs):
    return pairs.select(
        "sym", F.col("d").cast("string").alias("d"), F.col("prev_d").cast("string").alias("prev_d"), *longs(pairs, "low_pos", "prev_pos", "rank", "formation"),
        rnd("decline").alias("decline"), rnd("rise", 4).alias("rise"), rnd("strength", 4).alias("strength"), "volume_signal",
        rnd("magnitude", 4).alias("magnitude"), "confirmed", "is_quick", "quick_pair",
    )


@query("low_pair_comparison", "E8 E24 F6.20", S.with_bars(*BASE, *V_SQL, pair_sql("vk")) + f"SELECT {PAIR_COLS} FROM pairs")
def low_pair_comparison(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    return _pairs_out(E.pairwise_low_comparison(panel, E.v_shape_lows(panel)))


@query(
    "detections_by_day", "E23 E8 F6.20 J3",
    S.with_bars(*BASE, GRID_SQL.replace("SRC", "adj").replace("COND", ""), pair_sql("gl"),
                f"ln AS (SELECT sym, count(*) AS k FROM adj GROUP BY 1)")
    + f"SELECT {PAIR_COLS}, CAST(count(*) OVER (PARTITION BY d) AS BIGINT) AS found_that_day FROM pairs JOIN ln USING (sym) WHERE k >= 100",
)
def detections_by_day(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    long_enough = panel.groupBy("sym").count().where("count >= 100").select("sym")
    pairs = stored(E.pairwise_low_comparison(panel, E.grid_lows(panel)).join(long_enough, "sym", "left_semi"), "pairs")
    per_day = pairs.groupBy("d").agg(F.count(F.lit(1)).alias("found_that_day"))
    out = pairs.join(per_day, "d")
    return _pairs_out(out).join(out.select("sym", "low_pos", "rank", "found_that_day"), ["sym", "low_pos", "rank"])


LEGACY_SQL = (
    GRID_SQL.replace("SRC", "adj").replace("COND", "WHERE members = 6"),
    f"""lg0 AS (SELECT *, (pos - 1) % 3 AS ph, {ref('close', 1)} AS b1, {ref('close', 2)} AS b2 FROM mc),
lg1 AS (SELECT * FROM lg0 WHERE pos >= 100 AND (ph = 0 OR (ph = 1 AND close < b1) OR (ph = 2 AND close < least(b1, b2)))),
lq AS (SELECT t.sym, t.pos, arg_min(x.pos, row(x.close, x.pos)) AS q FROM lg1 t JOIN mc x ON x.sym = t.sym AND x.pos BETWEEN t.pos - t.ph - 3 AND t.pos GROUP BY 1, 2),
lk AS (SELECT t.sym, t.pos, g.low_pos FROM lg1 t JOIN gl g ON g.sym = t.sym AND g.avail_pos <= t.pos AND g.low_pos <> t.pos),
lc AS (SELECT sym, pos, low_pos FROM (SELECT *, row_number() OVER (PARTITION BY sym, pos ORDER BY low_pos DESC) AS rn FROM lk) WHERE rn <= 2
 UNION SELECT sym, pos, q FROM lq WHERE q < pos),
lr AS (SELECT *, row_number() OVER (PARTITION BY sym, pos ORDER BY low_pos DESC) AS rank, count(*) OVER (PARTITION BY sym, pos) AS members FROM lc),
lh AS (SELECT lr.sym, lr.pos AS sig_pos, t.d, lr.rank, lr.low_pos AS prev_pos FROM lr JOIN lg1 t ON t.sym = lr.sym AND t.pos = lr.pos
 JOIN mc p ON p.sym = lr.sym AND p.pos = lr.low_pos WHERE rank <= 2 AND members >= 2 AND lr.pos - lr.low_pos >= 5 AND t.close < p.close AND t.dif > p.dif + 0.001),
le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym, sig_pos ORDER BY rank) AS rn FROM lh) WHERE rn = 1)""",
)


@query(
    "grid_divergences_as_of_each_day", "E4",
    S.with_bars(*BASE, *LEGACY_SQL) + f"SELECT sym, CAST(d AS VARCHAR) AS d, {longs_sql('sig_pos', 'rank', 'prev_pos')} FROM le",
)
def grid_divergences_as_of_each_day(spark, sf_dir):
    out = E.grid_divergences_causal(macd_bars(spark, sf_dir))
    return out.select("sym", F.col("d").cast("string").alias("d"), *longs(out, "sig_pos", "rank", "prev_pos"))


# ---------------------------------------------------------------- crosses
CROSS_SQL = f"""cr AS (SELECT *, coalesce({ref('dif', 1)} <= {ref('dea', 1)} AND dif > dea, false) AS golden,
 coalesce({ref('dif', 1)} >= {ref('dea', 1)} AND dif < dea, false) AS death, coalesce({ref('dif', 1)} <= 0 AND dif > 0, false) AS zero_up,
 coalesce({ref('dif', 1)} >= 0 AND dif < 0, false) AS zero_down FROM mc)"""
LEG_SQL = """lgs AS (SELECT *, coalesce(sum(CAST(golden AS INT)) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leg FROM cr)"""


@query(
    "macd_cross_flags", "E9 W42",
    S.with_bars(*BASE, CROSS_SQL) + "SELECT sym, CAST(d AS VARCHAR) AS d, CAST(golden AS BIGINT) AS golden, CAST(death AS BIGINT) AS death, "
    "CAST(zero_up AS BIGINT) AS zero_up, CAST(zero_down AS BIGINT) AS zero_down, CAST(max(CAST(golden AS INT)) OVER (PARTITION BY sym ORDER BY d "
    "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS crossed_recently FROM cr",
)
def macd_cross_flags(spark, sf_dir):
    flags = E.cross_flags(macd_bars(spark, sf_dir))
    flags = flags.withColumn("crossed_recently", F.max(F.col("golden").cast("double")).over(B.rows(-5, -1)))
    return flags.select(
        "sym", F.col("d").cast("string").alias("d"), *longs(flags, "golden", "death", "zero_up", "zero_down"), "crossed_recently"
    )


def crossed_bars(spark, sf_dir):
    return stored(E.cross_flags(macd_bars(spark, sf_dir)), "crossed-bars")


V1_SQL = (
    CROSS_SQL, LEG_SQL,
    """lt AS (SELECT sym, leg, min(close) AS low, arg_min(pos, row(close, pos)) AS low_pos, max(CASE WHEN golden THEN pos END) AS cross_pos,
 max(CASE WHEN golden THEN dif END) AS cross_dif FROM lgs GROUP BY 1, 2),
lp AS (SELECT *, lag(low) OVER w AS prev_low, lag(low_pos) OVER w AS prev_low_pos, lag(cross_pos) OVER w AS prev_cross_pos, lag(cross_dif) OVER w AS prev_cross_dif,
 lag(cross_pos, 2) OVER w AS c2 FROM lt WINDOW w AS (PARTITION BY sym ORDER BY leg)),
v1 AS (SELECT sym, cross_pos AS sig_pos, low_pos AS anchor_pos, low AS anchor_close, prev_cross_pos, prev_cross_dif, cross_pos, cross_dif, cross_dif - prev_cross_dif AS dif_lift
 FROM lp WHERE leg >= 2 AND cross_pos IS NOT NULL AND cross_dif - prev_cross_dif >= 0.001 AND low < prev_low)""",
)


@query(
    "cross_divergence_simple", "E10 C8 E25",
    S.with_bars(*BASE, *V1_SQL) + f"SELECT sym, {longs_sql('sig_pos', 'anchor_pos', 'prev_cross_pos')}, {r('anchor_close', 4)} AS anchor_close, {r('dif_lift', 4)} AS dif_lift FROM v1",
)
def cross_divergence_simple(spark, sf_dir):
    out = E.cross_divergence_simple(crossed_bars(spark, sf_dir))
    return out.select("sym", *longs(out, "sig_pos", "anchor_pos", "prev_cross_pos"), rnd("anchor_close", 4).alias("anchor_close"), rnd("dif_lift", 4).alias("dif_lift"))


V2_SQL = (
    CROSS_SQL, V_FLAG.replace("SRC", "cr"),
    """cx0 AS (SELECT sym, pos AS cross_pos, dif AS cross_dif, row_number() OVER (PARTITION BY sym ORDER BY pos) AS k FROM cr WHERE golden),
cx AS (SELECT *, lag(cross_pos) OVER w AS prev_cross_pos, lag(cross_dif) OVER w AS prev_cross_dif FROM cx0 WINDOW w AS (PARTITION BY sym ORDER BY k)),
wr AS (SELECT cx.sym, cx.k, vf.pos, vf.close, vf.is_low FROM cx JOIN vf ON vf.sym = cx.sym AND vf.pos > cx.prev_cross_pos AND vf.pos <= cx.cross_pos + 5),
wl AS (SELECT sym || '#' || k AS sym, k, pos AS low_pos, close FROM wr WHERE is_low)""",
    spaced_sql("wl", 3, "wk", "close"),
    """an0 AS (SELECT sym, arg_min(low_pos, row(close, low_pos)) AS pos, min(close) AS close FROM wk GROUP BY 1),
an AS (SELECT w.sym, w.k, coalesce(any_value(a.pos), arg_min(w.pos, row(w.close, w.pos))) AS apos, coalesce(any_value(a.close), min(w.close)) AS aclose
 FROM wr w LEFT JOIN an0 a ON a.sym = w.sym || '#' || w.k GROUP BY 1, 2),
ap AS (SELECT an.*, lag(apos) OVER w AS prev_apos, lag(aclose) OVER w AS prev_aclose, cross_pos, cross_dif, prev_cross_pos, prev_cross_dif
 FROM an JOIN cx USING (sym, k) WINDOW w AS (PARTITION BY an.sym ORDER BY an.k)),
v2 AS (SELECT ap.sym, greatest(cross_pos, apos + 2) AS sig_pos, apos AS anchor_pos, aclose AS anchor_close, prev_cross_pos, cross_pos, cross_dif, cross_dif - prev_cross_dif AS dif_lift,
 prev_apos AS prev_anchor_pos, prev_aclose AS prev_anchor_close FROM ap JOIN (SELECT sym, max(pos) AS n FROM cr GROUP BY 1) USING (sym)
 WHERE k >= 3 AND cross_dif - prev_cross_dif >= 0.001 AND aclose < prev_aclose AND apos + 2 <= n)""",
)


@query(
    "cross_divergence_confirmed", "E11 Q9",
    S.with_bars(*BASE, *V2_SQL) + f"SELECT sym, {longs_sql('sig_pos', 'anchor_pos', 'prev_cross_pos', 'prev_anchor_pos')}, {r('anchor_close', 4)} AS anchor_close, {r('dif_lift', 4)} AS dif_lift FROM v2",
)
def cross_divergence_confirmed(spark, sf_dir):
    out = E.cross_divergence_confirmed(crossed_bars(spark, sf_dir))
    return out.select("sym", *longs(out, "sig_pos", "anchor_pos", "prev_cross_pos", "prev_anchor_pos"), rnd("anchor_close", 4).alias("anchor_close"), rnd("dif_lift", 4).alias("dif_lift"))


EVE_SQL = (
    *V1_SQL, V_FLAG.replace("SRC", "lgs"),
    f"""ev0 AS (SELECT s.sym, s.pos AS t, s.close, s.dea, s.leg, lp.prev_cross_pos AS c1, lp.prev_cross_dif AS c1d, lp.c2, lp.prev_low,
 (s.dea - (s.e12 * 11.0::DOUBLE / 13.0::DOUBLE - s.e26 * 25.0::DOUBLE / 27.0::DOUBLE)) / (2.0::DOUBLE / 13.0::DOUBLE - 2.0::DOUBLE / 27.0::DOUBLE) AS c_star
 FROM (SELECT *, lead(pos) {whole()} AS nx FROM lgs) s JOIN lp ON lp.sym = s.sym AND lp.leg = s.leg WHERE s.dif <= s.dea AND nx IS NOT NULL AND s.leg >= 2),
ev1 AS (SELECT * FROM ev0 WHERE dea - c1d >= 0.001),
span AS (SELECT sym, t, 'cur' AS side, c1 AS lo, t AS hi FROM ev1 UNION ALL SELECT sym, t, 'prev', c2, least(c1 + 5, t) FROM ev1),
srow AS (SELECT span.sym, t, side, vf.pos, vf.close, vf.is_low AND vf.pos + 2 <= t AS ok FROM span JOIN vf ON vf.sym = span.sym AND vf.pos > lo AND vf.pos <= hi),
sl AS (SELECT sym || '#' || t || '#' || side AS sym, pos AS low_pos, close FROM srow WHERE ok)""",
    spaced_sql("sl", 3, "sk", "close"),
    """sa0 AS (SELECT sym, arg_min(low_pos, row(close, low_pos)) AS pos, min(close) AS close FROM sk GROUP BY 1),
sa AS (SELECT s.sym, s.t, s.side, coalesce(any_value(a.pos), arg_min(s.pos, row(s.close, s.pos))) AS apos, coalesce(any_value(a.close), min(s.close)) AS aclose
 FROM srow s LEFT JOIN sa0 a ON a.sym = s.sym || '#' || s.t || '#' || s.side GROUP BY 1, 2, 3),
cur_low AS (SELECT sym, t, min(close) AS lo FROM srow WHERE side = 'cur' GROUP BY 1, 2),
eve AS (SELECT 'v1' AS variant, e.sym, e.t AS eve_pos, e.c_star, e.close, e.dea - e.c1d AS lift, e.c1, e.c2, NULL::BIGINT AS a FROM ev1 e JOIN cur_low c ON c.sym = e.sym AND c.t = e.t WHERE c.lo < e.prev_low
 UNION ALL SELECT 'v2', e.sym, e.t, e.c_star, e.close, e.dea - e.c1d, e.c1, e.c2, x.apos FROM ev1 e JOIN sa x ON x.sym = e.sym AND x.t = e.t AND x.side = 'cur'
 JOIN sa y ON y.sym = e.sym AND y.t = e.t AND y.side = 'prev' WHERE x.aclose < y.aclose)""",
)


@query(
    "eve_of_cross_candidates", "E12 E13 Q11",
    S.with_bars(*BASE, *EVE_SQL) + f"SELECT variant, sym, {longs_sql('eve_pos')}, CAST(c1 AS BIGINT) AS cross1_pos, CAST(c2 AS BIGINT) AS cross2_pos, {r('c_star', 2)} AS c_star, "
    f"{r('lift', 4)} AS dif_lift_star, CAST(a AS DOUBLE) AS anchor FROM eve",
)
def eve_of_cross_candidates(spark, sf_dir):
    out = E.eve_candidates(crossed_bars(spark, sf_dir))
    return out.select(
        "variant", "sym", *longs(out, "eve_pos", "cross1_pos", "cross2_pos"), rnd("c_star", 2).alias("c_star"), rnd("dif_lift_star", 4).alias("dif_lift_star"),
        F.when(F.col("variant") == "v2", F.col("anchor_pos").cast("double")).alias("anchor"),
    )


EARLY_SQL = (
    *V1_SQL, V_FLAG.replace("SRC", "lgs"),
    f"""ru AS (SELECT *, pos - coalesce(max(CASE WHEN up THEN NULL ELSE pos END) {past()}, 0) AS up_run FROM (SELECT *, coalesce(dif > {ref('dif', 1)}, false) AS up FROM vf)),
rl AS (SELECT *, min(dif) OVER w AS wd, arg_min(pos, row(dif, pos)) FILTER (WHERE dif IS NOT NULL) OVER w AS wp, min(close) OVER w AS cc, arg_min(pos, row(close, pos)) OVER w AS cp FROM ru
 WINDOW w AS (PARTITION BY sym, leg ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fr AS (SELECT rl.*, prev_cross_pos AS c_prev, lp.cross_pos AS next_cross, j FROM rl JOIN lp ON lp.sym = rl.sym AND lp.leg = rl.leg, (VALUES (1), (2), (3)) js(j)
 WHERE rl.leg >= 2 AND NOT golden AND wd >= prev_cross_dif + 0.001 AND cc < prev_low AND wp = pos - j AND up_run >= j),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym, leg, j ORDER BY pos) AS rn FROM fr) WHERE rn = 1),
el AS (SELECT sym || '#' || leg AS sym, pos AS low_pos, close FROM vf WHERE is_low)""",
    spaced_sql("el", 3, "ek", "close"),
    """ea AS (SELECT f1.sym, f1.leg, f1.j, arg_min(ek.low_pos, row(ek.close, ek.low_pos)) AS apos FROM f1 JOIN ek ON ek.sym = f1.sym || '#' || f1.leg AND ek.low_pos <= f1.pos GROUP BY 1, 2, 3),
early AS (SELECT 'b1' AS flavor, sym, j, pos AS fire_pos, wp AS tau_pos, c_prev, next_cross, pos AS sig_pos, cp AS anchor_pos FROM f1
 UNION ALL SELECT * FROM (SELECT 'b2', f1.sym, f1.j, f1.pos, wp, c_prev, next_cross, greatest(f1.pos, coalesce(apos, cp) + 2) AS sp, coalesce(apos, cp) FROM f1 LEFT JOIN ea USING (sym, leg, j)
 JOIN (SELECT sym, max(pos) AS endp FROM mc GROUP BY 1) m ON m.sym = f1.sym WHERE greatest(f1.pos, coalesce(apos, cp) + 2) <= endp))""",
)


@query(
    "early_turn_events", "E14 Q10 W17",
    S.with_bars(*BASE, *EARLY_SQL) + f"SELECT flavor, sym, {longs_sql('j', 'fire_pos', 'tau_pos', 'sig_pos', 'anchor_pos')}, CAST(next_cross AS DOUBLE) AS next_cross FROM early",
)
def early_turn_events(spark, sf_dir):
    out = E.early_events(crossed_bars(spark, sf_dir))
    return out.select("flavor", "sym", *longs(out, "j", "fire_pos", "tau_pos", "sig_pos", "anchor_pos"), F.col("next_cross").cast("double").alias("next_cross"))


# ---------------------------------------------------------------- truth lows, candles, limits, rules
def truth_sql(half: int, name: str = "tl", src: str = "adj") -> str:
    return f"""{name} AS (SELECT sym, pos AS low_pos, d, close FROM (SELECT *, count(close) OVER a AS na, min(close) OVER a AS ma, count(close) OVER b AS nb, min(close) OVER b AS mb FROM {src}
 WINDOW a AS (PARTITION BY sym ORDER BY d ROWS BETWEEN {half} PRECEDING AND 1 PRECEDING), b AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {half} FOLLOWING))
 WHERE na = {half} AND nb = {half} AND close < ma AND close <= mb)"""


@query(
    "truth_lows_two_scales", "E15",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), truth_sql(20, "t20"), truth_sql(60, "t60"))
    + "SELECT 'local' AS scale, sym, CAST(low_pos AS BIGINT) AS low_pos, CAST(d AS VARCHAR) AS d FROM t20 UNION ALL SELECT 'stage', sym, CAST(low_pos AS BIGINT), CAST(d AS VARCHAR) FROM t60",
)
def truth_lows_two_scales(spark, sf_dir):
    adj = SRC.adjust(SRC.bars_brand_week(spark, sf_dir))
    both = E.truth_lows(adj, 20).withColumn("scale", F.lit("local")).unionByName(E.truth_lows(adj, 60).withColumn("scale", F.lit("stage")))
    return both.select("scale", "sym", "low_pos", F.col("d").cast("string").alias("d"))


@query(
    "candle_flags", "E16 F6.10 F1.10",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), f"c0 AS (SELECT *, {ref('close', 1)} AS pc, {ref('open', 1)} AS po, high - low AS span, abs(close - open) AS body, "
                "least(open, close) - low AS lsh, high - greatest(open, close) AS ush FROM adj)")
    + shown_sql("c0", {
        "hammer": "CASE WHEN lsh >= 2 * body AND ush <= 0.5 * body AND lsh >= 0.6 * span AND span > 0 THEN 1.0 ELSE 0.0 END",
        "doji": "CASE WHEN body < 0.1 * span THEN 1.0 ELSE 0.0 END",
        "engulfing": "CASE WHEN pc IS NULL THEN NULL WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1.0 WHEN close < open AND pc > po AND close <= po AND open >= pc THEN -1.0 ELSE 0.0 END",
        "upper_shadow": "CASE WHEN span <= 0 THEN 0.0 ELSE ush / span END", "close_vs_high": "CASE WHEN span <= 0 THEN 0.5 ELSE (high - close) / span END",
    }),
)
def candle_flags(spark, sf_dir):
    out = E.candle_flags(SRC.adjust(SRC.bars_supp_month(spark, sf_dir)))
    return shown(out, {c: F.col(c) for c in ("hammer", "doji", "engulfing", "upper_shadow", "close_vs_high")})


EXACT_FROM, RULE_FROM = "1998-01-01", "1995-06-01"
LIMIT_PANEL_SQL = """l0 AS (SELECT *, dense_rank() OVER (ORDER BY d) AS cal_pos FROM adj),
l1 AS (SELECT *, cal_pos - min(cal_pos) OVER (PARTITION BY sym) AS age, CASE WHEN sym % 7 = 0 THEN 1.0 ELSE 0.0 END AS status,
 CASE WHEN cal_pos % 17 <> 0 THEN pre_close * 1.1 END AS up_limit, CASE WHEN cal_pos % 17 <> 0 THEN pre_close * 0.9 END AS down_limit FROM l0)"""
LIMIT_FLAG_SQL = f"""l2 AS (SELECT *, coalesce(d >= DATE '{EXACT_FROM}' AND up_limit IS NOT NULL, false) AS ex, CASE WHEN status >= 1 THEN 5.0 ELSE 10.0 END AS lim,
 coalesce(age >= 5 AND ((d >= DATE '{EXACT_FROM}' AND up_limit IS NOT NULL) OR (d < DATE '{EXACT_FROM}' AND d >= DATE '{RULE_FROM}' AND pre_close IS NOT NULL)), false) AS ok FROM l1),
l3 AS (SELECT *, lim - 0.5 AS thr, CASE WHEN ex THEN up_limit ELSE pre_close * (1 + lim / 100.0) END AS ue, CASE WHEN ex THEN down_limit ELSE pre_close * (1 - lim / 100.0) END AS de FROM l2),
l4 AS (SELECT *, CASE WHEN ok THEN CAST(CASE WHEN ex THEN close >= up_limit - 0.005 ELSE pct >= thr END AS DOUBLE) END AS sealed,
 CASE WHEN ok THEN CAST(CASE WHEN ex THEN high >= up_limit - 0.005 ELSE (high / pre_close - 1) * 100 >= thr END AS DOUBLE) END AS tch,
 CASE WHEN ok AND ex THEN CAST(abs(open - up_limit) <= 0.005 AND abs(high - up_limit) <= 0.005 AND abs(low - up_limit) <= 0.005 AND abs(close - up_limit) <= 0.005 AS DOUBLE) END AS oneword,
 CASE WHEN ok AND de IS NOT NULL THEN CAST(CASE WHEN ex THEN low <= down_limit + 0.005 ELSE (low / pre_close - 1) * 100 <= -thr END AS DOUBLE) END AS dt,
 CASE WHEN ok AND de IS NOT NULL THEN CAST(CASE WHEN ex THEN close <= down_limit + 0.005 ELSE pct <= -thr END AS DOUBLE) END AS down_sealed,
 CASE WHEN ok AND ex THEN 2.0 WHEN ok THEN 1.0 ELSE 0.0 END AS sealed_src FROM l3),
l5 AS (SELECT *, CASE WHEN ok THEN CAST(sealed = 1 OR tch = 1 AS DOUBLE) END AS touched, CASE WHEN ok THEN CAST(tch = 1 AND sealed = 0 AS DOUBLE) END AS touch_fail,
 CASE WHEN tch = 1 AND ue > 0 THEN (ue - close) / ue END AS touch_fail_depth, CASE WHEN ok AND de IS NOT NULL THEN CAST(dt = 1 AND down_sealed = 0 AS DOUBLE) END AS down_unsealed,
 CASE WHEN dt = 1 AND de > 0 THEN (close - de) / de END AS down_recover,
 CASE WHEN sealed IS NOT NULL THEN CAST(pos - coalesce(max(CASE WHEN sealed = 1 THEN NULL ELSE pos END) {past()}, 0) AS DOUBLE) END AS consec_limitup,
 coalesce(CAST(cal_pos - {ref('cal_pos', 1)} > 1 AS DOUBLE), 0.0) AS gp FROM l4),
lf AS (SELECT *, CASE WHEN consec_limitup IS NOT NULL THEN CASE WHEN consec_limitup > 0 THEN gp ELSE 0.0 END END AS consec_gap FROM l5)"""
LIMIT_COLS = ("sealed", "sealed_src", "oneword", "touched", "touch_fail", "touch_fail_depth", "down_sealed", "down_unsealed", "down_recover", "consec_limitup", "consec_gap")


def limit_panel(spark, sf_dir):
    """Monthly supplier bars with stand-in limits (+-10%), listing age and status."""
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir))
    cal = SRC.calendar(adj)
    placed = adj.join(F.broadcast(cal), "d")
    listed = placed.groupBy("sym").agg(F.min("cal_pos").alias("_listed"))
    placed = placed.join(listed, "sym").withColumn("age", F.col("cal_pos") - F.col("_listed")).drop("_listed")
    has = F.pmod("cal_pos", F.lit(17)) != 0
    return placed.withColumns(
        {
            "status": F.when(F.col("sym") % 7 == 0, 1.0).otherwise(0.0),
            "up_limit": F.when(has, F.col("pre_close") * 1.1), "down_limit": F.when(has, F.col("pre_close") * 0.9),
        }
    )


@query(
    "limit_flags_two_eras", "E17 W18 F5.2 C10",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), LIMIT_PANEL_SQL, LIMIT_FLAG_SQL) + shown_sql("lf", {c: c for c in LIMIT_COLS}),
)
def limit_flags_two_eras(spark, sf_dir):
    out = E.limit_flags(limit_panel(spark, sf_dir), EXACT_FROM, RULE_FROM)
    return shown(out, {c: F.col(c) for c in LIMIT_COLS})


def _m(k: int) -> str:
    return f"lag(m20, {k}) {whole()}"


@query(
    "rejection_rules", "E19",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), f"""z0 AS (SELECT *, pre_close * 0.9 AS dl, {S.full('min', 'close', 20)} AS m20, {S.full('max', 'high', 20)} - {S.full('min', 'low', 20)} AS span FROM adj),
z1 AS (SELECT *, {_m(0)} AS a0, {_m(20)} AS a1, {_m(40)} AS a2, {_m(60)} AS a3, {_m(80)} AS a4, {_m(100)} AS a5, lag(span, 60) {whole()} AS span60,
 CAST(coalesce(close <= dl + 0.005, false) OR coalesce(open / pre_close - 1 <= -0.05, false) AS INT) AS shock, {S.full('min', 'close', 60)} AS m60 FROM z0)""")
    + f"""SELECT sym, CAST(d AS VARCHAR) AS d, CAST(CAST(a0 < a1 AS INT) + CAST(a1 < a2 AS INT) + CAST(a2 < a3 AS INT) + CAST(a3 < a4 AS INT) + CAST(a4 < a5 AS INT) >= 4 AS DOUBLE) AS r1,
 CAST(span < 0.6 * span60 AND close = m60 AS DOUBLE) AS r2, CASE WHEN pos > 60 THEN CAST(max(shock) {S.last(60)} = 1 AS DOUBLE) END AS r3 FROM z1""",
)
def rejection_rules(spark, sf_dir):
    adj = SRC.adjust(SRC.bars_brand_week(spark, sf_dir)).withColumn("down_limit", F.col("pre_close") * 0.9)
    out = E.reject_rules(adj)
    return out.select("sym", F.col("d").cast("string").alias("d"), *[F.col(f"reject_{x}").cast("double").alias(x) for x in ("r1", "r2", "r3")])


# ---------------------------------------------------------------- joins over events
@query(
    "events_in_both_pools", "J13 J14 U2",
    S.with_bars(*MAIN_SQL, *BACKUP_SQL, "bl AS (SELECT sym, low_pos, min(sig_pos) AS s FROM backup_ev GROUP BY 1, 2)")
    + """SELECT 'same_day' AS kind, sym, CAST(sig_pos AS BIGINT) AS sig_pos, CAST(low_pos AS BIGINT) AS low_pos FROM main_ev m WHERE EXISTS (SELECT 1 FROM backup_ev b WHERE b.sym = m.sym AND b.sig_pos = m.sig_pos)
 UNION ALL SELECT 'same_low', m.sym, CAST(m.sig_pos AS BIGINT), CAST(m.low_pos AS BIGINT) FROM main_ev m JOIN bl ON bl.sym = m.sym AND bl.low_pos = m.low_pos AND bl.s <= m.sig_pos""",
)
def events_in_both_pools(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    main, backup = main_pool(panel), backup_pool(panel)
    day, low = E.in_both(main, backup, "sig"), E.in_both(main, backup, "low")
    return day.select(F.lit("same_day").alias("kind"), "sym", "sig_pos", "low_pos").unionByName(low.select(F.lit("same_low").alias("kind"), "sym", "sig_pos", "low_pos"))


@query(
    "pool_union_with_source", "U1 L15 U3 J21",
    S.with_bars(*MAIN_SQL, *BACKUP_SQL) + f"""SELECT 'main_' || sym || '_' || CAST(sig_pos AS BIGINT) AS event_id, 'main' AS pool, {EVENT_COLS},
 CAST(NOT EXISTS (SELECT 1 FROM backup_ev b WHERE b.sym = m.sym AND b.low_pos = m.low_pos) AS BIGINT) AS alone FROM main_ev m
 UNION ALL SELECT 'backup_' || sym || '_' || CAST(sig_pos AS BIGINT), 'backup', {EVENT_COLS}, CAST(NOT EXISTS (SELECT 1 FROM main_ev b WHERE b.sym = m.sym AND b.low_pos = m.low_pos) AS BIGINT) FROM backup_ev m""",
)
def pool_union_with_source(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    pools = {"main": main_pool(panel), "backup": backup_pool(panel)}
    both = None
    for name, other in (("main", "backup"), ("backup", "main")):
        seen = pools[other].select("sym", "low_pos").distinct().withColumn("_seen", F.lit(1))
        one = pools[name].join(seen, ["sym", "low_pos"], "left").select(
            F.concat_ws("_", F.lit(name), "sym", "sig_pos").alias("event_id"), F.lit(name).alias("pool"), *pools[name].columns,
            F.col("_seen").isNull().cast("long").alias("alone"),
        )
        both = one if both is None else both.unionByName(one)
    return both


@query(
    "pool_cluster_matches", "J16 E18",
    S.with_bars(*MAIN_SQL, *BACKUP_SQL) + "SELECT m.sym, CAST(m.sig_pos AS BIGINT) AS main_pos, CAST(b.sig_pos AS BIGINT) AS other_pos FROM main_ev m JOIN backup_ev b ON b.sym = m.sym AND abs(m.sig_pos - b.sig_pos) <= 1",
)
def pool_cluster_matches(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    main = main_pool(panel).withColumn("mid", F.col("sig_pos"))
    other = backup_pool(panel).withColumn("bid", F.col("sig_pos"))
    return J.band_matches(main, other, "sym", "sig_pos", 1, "mid", "bid").select("sym", "main_pos", "other_pos")


@query(
    "event_consensus_clusters", "E18",
    S.with_bars(*MAIN_SQL, *BACKUP_SQL, """u AS (SELECT DISTINCT sym, sig_pos AS pos, 'main' AS run FROM main_ev UNION ALL SELECT DISTINCT sym, sig_pos, 'backup' FROM backup_ev),
u1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY sym ORDER BY pos, run)),
u2 AS (SELECT *, sum(fresh) OVER (PARTITION BY sym ORDER BY pos, run ROWS UNBOUNDED PRECEDING) AS cluster FROM u1)""")
    + "SELECT sym, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, CAST(count(DISTINCT run) AS BIGINT) AS runs, count(*) AS events FROM u2 GROUP BY sym, cluster",
)
def event_consensus_clusters(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    return E.consensus({"main": main_pool(panel), "backup": backup_pool(panel)}).drop("cluster")


@query(
    "pool_overlap_recalls", "U5 J22 G20",
    S.with_bars(*MAIN_SQL, *BACKUP_SQL, "a AS (SELECT DISTINCT sym, low_pos FROM main_ev)", "b AS (SELECT DISTINCT sym, low_pos FROM backup_ev)",
                "i AS (SELECT count(*) AS k FROM a JOIN b USING (sym, low_pos))")
    + f"SELECT (SELECT count(*) FROM a) AS n_base, (SELECT count(*) FROM b) AS n_other, k AS n_both, {r('k / (SELECT count(*) FROM a)')} AS recall_base, {r('k / (SELECT count(*) FROM b)')} AS recall_other FROM i",
)
def pool_overlap_recalls(spark, sf_dir):
    panel = macd_bars(spark, sf_dir)
    out = J.overlap(main_pool(panel), backup_pool(panel), ["sym", "low_pos"])
    return out.select("n_base", "n_other", "n_both", rnd("recall_base").alias("recall_base"), rnd("recall_other").alias("recall_other"))


@query(
    "nearest_truth_low", "J15 A19 E22",
    S.with_bars(*BASE, *V1_SQL, truth_sql(20), "nl AS (SELECT v.sym, v.sig_pos, v.anchor_pos, t.low_pos, abs(v.anchor_pos - t.low_pos) AS g, row_number() OVER (PARTITION BY v.sym, v.sig_pos ORDER BY abs(v.anchor_pos - t.low_pos), t.low_pos) AS rn "
                "FROM v1 v LEFT JOIN tl t ON t.sym = v.sym)", "nn AS (SELECT sym, max(pos) AS n FROM mc GROUP BY 1)")
    + """SELECT nl.sym, CAST(sig_pos AS BIGINT) AS sig_pos, CAST(low_pos AS DOUBLE) AS low_pos, CAST(g AS DOUBLE) AS gap,
 CASE WHEN sig_pos > n - 20 THEN 'truncated' WHEN low_pos IS NULL THEN 'no_truth' WHEN g <= 10 THEN 'near' ELSE 'far' END AS status FROM nl JOIN nn ON nn.sym = nl.sym WHERE rn = 1""",
)
def nearest_truth_low(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    events = E.cross_divergence_simple(df)
    near = J.nearest_by_position(
        events.select("sym", F.col("anchor_pos").cast("long").alias("anchor_pos"), F.col("sig_pos").cast("long").alias("sig_pos")),
        E.truth_lows(df, 20), "sym", "sig_pos", "anchor_pos", "low_pos",
    )
    n = df.groupBy("sym").agg(F.max("pos").alias("n"))
    gap = F.abs("gap")
    status = F.when(F.col("sig_pos") > F.col("n") - 20, "truncated").when(F.col("low_pos").isNull(), "no_truth").when(gap <= 10, "near").otherwise("far")
    return near.join(n, "sym").select("sym", "sig_pos", F.col("low_pos").cast("double").alias("low_pos"), gap.cast("double").alias("gap"), status.alias("status"))


@query(
    "truth_low_cross_table", "A18 A19",
    S.with_bars(*BASE, *V1_SQL, truth_sql(20, "t20"), truth_sql(60, "t60"),
                "x AS (SELECT v.sym, v.sig_pos, (SELECT min(abs(v.anchor_pos - t.low_pos)) FROM t20 t WHERE t.sym = v.sym) AS dl, (SELECT min(abs(v.anchor_pos - t.low_pos)) FROM t60 t WHERE t.sym = v.sym) AS ds FROM v1 v)")
    + f"""SELECT count(*) AS scored, count(*) FILTER (WHERE dl <= 5 AND ds <= 10) AS both_near, count(*) FILTER (WHERE dl <= 5 AND ds > 10) AS local_only, count(*) FILTER (WHERE dl > 5 AND ds <= 10) AS stage_only,
 count(*) FILTER (WHERE dl > 5 AND ds > 10) AS neither, {r('avg(CASE WHEN dl <= 3 THEN 1.0 ELSE 0.0 END)')} AS local_le3, {r('avg(CASE WHEN dl <= 10 THEN 1.0 ELSE 0.0 END)')} AS local_le10 FROM x WHERE dl IS NOT NULL AND ds IS NOT NULL""",
)
def truth_low_cross_table(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    ev = E.cross_divergence_simple(df).select("sym", F.col("anchor_pos").cast("long").alias("anchor_pos"), F.col("sig_pos").cast("long").alias("sig_pos"))

    def gaps(half, out):
        near = J.nearest_by_position(ev, E.truth_lows(df, half), "sym", "sig_pos", "anchor_pos", "low_pos")
        return near.select("sym", "sig_pos", F.abs("gap").alias(out))

    x = gaps(20, "dl").join(gaps(60, "ds"), ["sym", "sig_pos"]).where("dl is not null and ds is not null")
    return x.agg(
        F.count(F.lit(1)).alias("scored"), F.count_if((F.col("dl") <= 5) & (F.col("ds") <= 10)).alias("both_near"),
        F.count_if((F.col("dl") <= 5) & (F.col("ds") > 10)).alias("local_only"), F.count_if((F.col("dl") > 5) & (F.col("ds") <= 10)).alias("stage_only"),
        F.count_if((F.col("dl") > 5) & (F.col("ds") > 10)).alias("neither"),
        rnd(F.avg((F.col("dl") <= 3).cast("double"))).alias("local_le3"), rnd(F.avg((F.col("dl") <= 10).cast("double"))).alias("local_le10"),
    )


@query(
    "scan_skip_reasons", "E25 A22 P9",
    S.with_bars(S.USER_DAY, "c AS (SELECT sym, count(*) AS k, max(n) AS mn FROM bars GROUP BY 1)")
    + """SELECT CASE WHEN k < 25 THEN 'short' WHEN mn < 5 THEN 'thin' ELSE 'scanned' END AS reason, count(*) AS symbols, CAST(sum(k) AS BIGINT) AS n_rows FROM c GROUP BY 1""",
)
def scan_skip_reasons(spark, sf_dir):
    per_key = SRC.bars_user_day(spark, sf_dir).groupBy("sym").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("mn"))
    reason = F.when(F.col("k") < 25, "short").when(F.col("mn") < 5, "thin").otherwise("scanned")
    return per_key.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("symbols"), F.sum("k").alias("n_rows"))
