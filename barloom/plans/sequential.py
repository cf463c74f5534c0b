"""Recursive indicators and lows, checked against list folds and a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import sdiv
from barloom.operators import events as E
from barloom.operators import sequential as Q
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sqltext import full, past, r, ref
from barloom.plans.util import shown, shown_sql
from barloom.session import stored
from barloom.sources.bars import adjust, bars_brand_week, bars_supp_month


def _fold(seed: str, rest: str, alpha: float) -> str:
    return f"list_reduce(list_concat([{seed}], {rest}), lambda ee, zz: ee * {1 - alpha!r}::DOUBLE + zz * {alpha!r}::DOUBLE)"


def macd_sql(x: str = "close", src: str = "adj", name: str = "mc") -> str:
    """CTEs up to ``name`` with e12, e26, dif, dea (dif and dea from position 34)."""
    return f"""mc0 AS (SELECT *, list({x}) {past()} AS l FROM {src}),
mc1 AS (SELECT *, CASE WHEN pos >= 26 THEN {_fold('list_avg(l[15:26])', 'l[27:]', 2 / 13)} END AS e12,
 CASE WHEN pos >= 26 THEN {_fold('list_avg(l[1:26])', 'l[27:]', 2 / 27)} END AS e26 FROM mc0),
mc2 AS (SELECT *, e12 - e26 AS dif0, list(e12 - e26) FILTER (WHERE e12 IS NOT NULL) {past()} AS dl FROM mc1),
{name} AS (SELECT * EXCLUDE (l, dl, dif0), CASE WHEN pos >= 34 THEN dif0 END AS dif,
 CASE WHEN pos >= 34 THEN {_fold('list_avg(dl[1:9])', 'dl[10:]', 0.2)} END AS dea FROM mc2)"""


def macd_bars(spark, sf_dir, build=bars_brand_week):
    """Adjusted weekly bars with the MACD of the raw close, stored: lows, pairs and labels all read it."""
    return stored(Q.add_recursions(adjust(build(spark, sf_dir)), [Q.macd("close")]), "macd-bars")


@query(
    "macd_seeded", "Q1 UF4",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), macd_sql()) + shown_sql(
        "mc", {"dif": "dif", "dea": "dea", "hist": "2.0 * (dif - dea)", "e12": "e12", "e26": "e26"}, 4),
)
def macd_seeded(spark, sf_dir):
    out = macd_bars(spark, sf_dir)
    return shown(out, {"dif": F.col("dif"), "dea": F.col("dea"), "hist": 2.0 * (F.col("dif") - F.col("dea")),
                       "e12": F.col("e12"), "e26": F.col("e26")}, 4)


def wilder_sql(n: int, x: str = "close") -> tuple[str, ...]:
    return (
        f"w0 AS (SELECT *, greatest({x} - {ref(x, 1)}, 0.0) AS up, greatest({ref(x, 1)} - {x}, 0.0) AS dn FROM adj)",
        f"w1 AS (SELECT *, list(up) FILTER (WHERE pos > 1) {past()} AS ul, list(dn) FILTER (WHERE pos > 1) {past()} AS nl FROM w0)",
        f"w2 AS (SELECT *, CASE WHEN pos > {n} THEN {_fold(f'list_avg(ul[1:{n}])', f'ul[{n + 1}:]', 1 / n)} END AS g, "
        f"CASE WHEN pos > {n} THEN {_fold(f'list_avg(nl[1:{n}])', f'nl[{n + 1}:]', 1 / n)} END AS o FROM w1)",
    )


@query(
    "wilder_rsi", "Q2",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), *wilder_sql(14)) + shown_sql("w2", {"rsi14": "100.0 * coalesce(g / nullif(g + o, 0), 0) + 0 * g"}, 5),
)
def wilder_rsi(spark, sf_dir):
    out = Q.add_recursions(adjust(bars_supp_month(spark, sf_dir)), [Q.rsi("close", 14, "rsi14")])
    return shown(out, {"rsi14": F.col("rsi14")}, 5)


@query(
    "wilder_atr", "Q3",
    S.with_bars(S.SUPP_MONTH, S.adjusted(),
                "a0 AS (SELECT *, greatest(high - low, abs(high - pre_close), abs(low - pre_close)) AS tr FROM adj)",
                f"a1 AS (SELECT *, list(tr) FILTER (WHERE pos > 1) {past()} AS tl FROM a0)",
                f"a2 AS (SELECT *, CASE WHEN pos > 14 THEN {_fold('list_avg(tl[1:14])', 'tl[15:]', 1 / 14)} END AS atr14 FROM a1)")
    + shown_sql("a2", {"atr14": "atr14"}, 4),
)
def wilder_atr(spark, sf_dir):
    out = Q.add_recursions(adjust(bars_supp_month(spark, sf_dir)), [Q.atr("high", "low", "close", 14, "atr14")])
    return shown(out, {"atr14": F.col("atr14")}, 4)


@query(
    "kdj_double_smoothing", "W22 Q7",
    S.with_bars(S.SUPP_MONTH, S.adjusted(),
                f"k0 AS (SELECT *, (close - {full('min', 'low', 9)}) / nullif({full('max', 'high', 9)} - {full('min', 'low', 9)}, 0) AS rsv FROM adj)",
                f"k1 AS (SELECT *, list(rsv) FILTER (WHERE rsv IS NOT NULL) {past()} AS rl FROM k0)",
                f"k2 AS (SELECT *, list_reduce(rl, lambda ee, zz: ee * {2 / 3!r}::DOUBLE + zz * {1 / 3!r}::DOUBLE) AS k FROM k1)",
                f"k3 AS (SELECT *, list(k) FILTER (WHERE k IS NOT NULL) {past()} AS kl FROM k2)",
                f"k4 AS (SELECT *, list_reduce(kl, lambda ee, zz: ee * {2 / 3!r}::DOUBLE + zz * {1 / 3!r}::DOUBLE) AS dd FROM k3)")
    + shown_sql("k4", {"k": "k", "dk": "dd", "j": "3.0 * k - 2.0 * dd"}),
)
def kdj_double_smoothing(spark, sf_dir):
    adj = adjust(bars_supp_month(spark, sf_dir))
    low, high = B.agg("min", "low", 9), B.agg("max", "high", 9)
    out = Q.add_recursions(adj.withColumn("rsv9", sdiv(F.col("close") - low, high - low)), [Q.kdj()])
    return shown(out, {"k": F.col("kdj_k"), "dk": F.col("kdj_d"), "j": F.col("kdj_j")})


ZIGZAG_SQL = """zz AS (
 SELECT sym, pos, close AS lo, pos AS lo_i, close AS hi, pos AS hi_i, 0 AS leg, NULL::BIGINT AS found FROM adj WHERE pos = 1
 UNION ALL
 SELECT sym, pos, CASE WHEN confirm THEN lo1 WHEN turn THEN x ELSE lo1 END, CASE WHEN confirm THEN lo1_i WHEN turn THEN pos ELSE lo1_i END,
  CASE WHEN confirm THEN x ELSE hi1 END, CASE WHEN confirm THEN pos ELSE hi1_i END,
  CASE WHEN confirm THEN 1 WHEN turn THEN -1 ELSE leg END, CASE WHEN confirm THEN lo1_i END
 FROM (SELECT *, (leg <= 0 AND lo1_i < pos AND x >= lo1 * (1.0 + PCT::DOUBLE)) AS confirm,
   (NOT (leg <= 0 AND lo1_i < pos AND x >= lo1 * (1.0 + PCT::DOUBLE)) AND leg >= 0 AND hi1_i < pos AND x <= hi1 * (1.0 - PCT::DOUBLE)) AS turn
  FROM (SELECT b.sym, b.pos, b.close AS x, leg,
    CASE WHEN leg <= 0 AND b.close < lo THEN b.close ELSE lo END AS lo1, CASE WHEN leg <= 0 AND b.close < lo THEN b.pos ELSE lo_i END AS lo1_i,
    CASE WHEN leg >= 0 AND b.close > hi THEN b.close ELSE hi END AS hi1, CASE WHEN leg >= 0 AND b.close > hi THEN b.pos ELSE hi_i END AS hi1_i
   FROM zz JOIN adj b ON b.sym = zz.sym AND b.pos = zz.pos + 1)))"""


@query(
    "zigzag_lows", "Q8 E2",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), ZIGZAG_SQL.replace("PCT", "0.05"))
    + "SELECT sym, CAST(found AS BIGINT) AS low_pos, CAST(pos AS BIGINT) AS sig_pos FROM zz WHERE found IS NOT NULL",
)
def zigzag_lows(spark, sf_dir):
    return Q.zigzag_lows(adjust(bars_brand_week(spark, sf_dir)), "close", 0.05)


FRACTAL_SQL = """fl AS (SELECT sym, pos AS low_pos, pos + 3 AS sig_pos FROM (SELECT *, count(close) OVER a AS na, min(close) OVER a AS ma,
 count(close) OVER b AS nb, min(close) OVER b AS mb FROM adj
 WINDOW a AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
 WHERE na = 3 AND nb = 3 AND close < ma AND close < mb)"""


@query(
    "fractal_lows", "E1",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), FRACTAL_SQL)
    + "SELECT sym, CAST(low_pos AS BIGINT) AS low_pos, CAST(sig_pos AS BIGINT) AS sig_pos FROM fl",
)
def fractal_lows(spark, sf_dir):
    return E.fractal_lows(adjust(bars_brand_week(spark, sf_dir)), "close", 3)


def spaced_sql(src: str, gap: int, name: str = "kept", extra: str = "sig_pos") -> str:
    """CTEs that keep a point when it is ``gap`` after the last kept one, by recursion over numbered points."""
    return f"""{name}_n AS (SELECT sym, low_pos, {extra}, row_number() OVER (PARTITION BY sym ORDER BY low_pos) AS rn FROM {src}),
{name}_r AS (SELECT sym, low_pos, {extra}, rn, low_pos AS last_kept, true AS keep FROM {name}_n WHERE rn = 1
 UNION ALL SELECT n.sym, n.low_pos, n.{extra}, n.rn, CASE WHEN n.low_pos - p.last_kept >= {gap} THEN n.low_pos ELSE p.last_kept END,
 n.low_pos - p.last_kept >= {gap} FROM {name}_r p JOIN {name}_n n ON n.sym = p.sym AND n.rn = p.rn + 1),
{name} AS (SELECT sym, low_pos, {extra} FROM {name}_r WHERE keep)"""


@query(
    "spaced_fractal_lows", "Q9",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), FRACTAL_SQL, spaced_sql("fl", 12))
    + "SELECT sym, CAST(low_pos AS BIGINT) AS low_pos, CAST(sig_pos AS BIGINT) AS sig_pos FROM kept",
)
def spaced_fractal_lows(spark, sf_dir):
    return E.min_separation(E.fractal_lows(adjust(bars_brand_week(spark, sf_dir)), "close", 3), 12)


@query(
    "macd_cross_price", "Q11",
    S.with_bars(S.BRAND_WEEK, S.adjusted(), macd_sql(),
                f"cs AS (SELECT *, (dea - (e12 * 11.0::DOUBLE / 13.0::DOUBLE - e26 * 25.0::DOUBLE / 27.0::DOUBLE)) / (2.0::DOUBLE / 13.0::DOUBLE - 2.0::DOUBLE / 27.0::DOUBLE) AS c_star, "
                f"{S.lead('close', 1)} AS nc, {S.lead('dif', 1)} AS nd, {S.lead('dea', 1)} AS ne FROM mc)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('c_star', 2)} AS c_star, CAST(nd > ne AS BIGINT)::DOUBLE AS crossed, "
      f"CAST(nc > c_star AS BIGINT)::DOUBLE AS foretold FROM cs WHERE dif <= dea",
)
def macd_cross_price(spark, sf_dir):
    panel = macd_bars(spark, sf_dir).withColumns(
        {"c_star": E.cross_price(), "nc": B.lead("close", 1), "nd": B.lead("dif", 1), "ne": B.lead("dea", 1)}
    )
    from barloom.functions.scalar import rnd

    return panel.where("dif <= dea").select(
        "sym", F.col("d").cast("string").alias("d"), rnd("c_star", 2).alias("c_star"),
        (F.col("nd") > F.col("ne")).cast("double").alias("crossed"), (F.col("nc") > F.col("c_star")).cast("double").alias("foretold"),
    )
