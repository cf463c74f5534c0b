"""Same-date operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd
from barloom.operators import cross_section as X
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sqltext import r, ref
from barloom.plans.util import shown
from barloom.session import attach_row
from barloom.sources.bars import adjust, bars_supp_month, bars_user_day, table

RET_SQL = f"fe AS (SELECT *, cf / {ref('cf', 5)} - 1.0 AS ret5 FROM adj)"


def _returns(spark, sf_dir):
    adj = adjust(bars_supp_month(spark, sf_dir))
    return adj.withColumn("ret5", B.pct_change("cf", 5))


@query(
    "percent_rank_by_date", "W30 W34 C7",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), RET_SQL) + f"""
SELECT sym, CAST(d AS VARCHAR) AS d, CASE WHEN ret5 IS NOT NULL THEN {r('''(rank() OVER (PARTITION BY d, ret5 IS NULL ORDER BY ret5) - 1
 + (count(*) OVER (PARTITION BY d, ret5) + 1) / 2.0) / count(ret5) OVER (PARTITION BY d)''')} END AS rank_avg,
 {r('''(rank() OVER (PARTITION BY d ORDER BY n) - 1 + (count(*) OVER (PARTITION BY d, n) + 1) / 2.0) / count(n) OVER (PARTITION BY d)''')} AS rank_n,
 CAST(count(*) OVER (PARTITION BY d) AS DOUBLE) AS cs_n FROM fe""",
)
def percent_rank_by_date(spark, sf_dir):
    panel = _returns(spark, sf_dir).select("sym", "d", "ret5", "n")
    rows = X.largest_group(panel, ["d"])
    ranked = X.add_pct_rank(panel, ["d"], "ret5", "rank_avg", group_rows=rows)
    ranked = X.add_pct_rank(ranked, ["d"], "n", "rank_n", group_rows=rows)
    sizes = ranked.groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("cs_n"))
    out = ranked.join(sizes, "d")
    return shown(out, {"rank_avg": F.col("rank_avg"), "rank_n": F.col("rank_n"), "cs_n": F.col("cs_n")})


@query(
    "rank_against_universe", "W31",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), RET_SQL,
                "u AS (SELECT d, ret5 FROM fe WHERE ret5 IS NOT NULL)",
                "q AS (SELECT sym, d, ret5 FROM fe WHERE close < open AND ret5 IS NOT NULL)",
                "j AS (SELECT q.sym, q.d, sum(CASE WHEN u.ret5 < q.ret5 THEN 1.0 WHEN u.ret5 = q.ret5 THEN 0.5 ELSE 0.0 END) "
                "/ count(*) AS csr FROM q JOIN u ON q.d = u.d GROUP BY 1, 2)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('csr')} AS csr FROM j",
)
def rank_against_universe(spark, sf_dir):
    panel = _returns(spark, sf_dir)
    events = panel.where("close < open and ret5 is not null").select("sym", "d", "ret5")
    out = X.rank_against(events, panel.where("ret5 is not null"), ["d"], "ret5", "csr")
    return shown(out, {"csr": F.col("csr")})


@query(
    "robust_z_by_date", "W32",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), RET_SQL) + f"""SELECT sym, CAST(d AS VARCHAR) AS d,
 {r('(ret5 - median(ret5) OVER (PARTITION BY d)) / (stddev_pop(ret5) OVER (PARTITION BY d) + 1e-9)')} AS z,
 {r('(vol - median(vol) OVER (PARTITION BY d)) / (stddev_pop(vol) OVER (PARTITION BY d) + 1e-9)')} AS z_vol FROM fe""",
)
def robust_z_by_date(spark, sf_dir):
    panel = _returns(spark, sf_dir)
    rows = X.largest_group(panel, ["d"])
    out = X.robust_z(X.robust_z(panel, ["d"], "ret5", "z", rows), ["d"], "vol", "z_vol", rows)
    return shown(out, {"z": F.col("z"), "z_vol": F.col("z_vol")})


@query(
    "group_neutral_z", "W33",
    S.with_bars(S.SUPP_MONTH, "g AS (SELECT bars.*, s_nationkey % 5 AS ind FROM bars JOIN supplier ON sym = s_suppkey)",
                "m AS (SELECT d, ind, avg(close) AS mu, stddev_samp(close) AS sd, count(close) AS c FROM g GROUP BY 1, 2)")
    + f"""SELECT g.sym, CAST(g.d AS VARCHAR) AS d, CASE WHEN c >= 10 AND sd > 0 THEN {r('(close - mu) / sd')} END AS z
 FROM g JOIN m ON g.d = m.d AND g.ind = m.ind""",
)
def group_neutral_z(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sym"), (F.col("s_nationkey") % 5).alias("ind")
    )
    panel = bars_supp_month(spark, sf_dir).join(supplier, "sym")
    return shown(X.group_z(panel, ["d", "ind"], "close", "z"), {"z": F.col("z")})


@query(
    "date_breadth_and_medians", "A5 A6 A7 A8 A10 A12 UF5",
    S.with_bars(S.USER_DAY, S.adjusted()) + f"""SELECT CAST(d AS VARCHAR) AS d,
 {r('avg(CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END END)')} AS breadth,
 {r('median(r)')} AS median_r, {r('coalesce(avg(r), 0)')} AS mean_r, {r('sum(amount)', 2)} AS amount,
 CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS eq1, CAST(sum(CASE WHEN r >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS ge1,
 CAST(count(DISTINCT sym) AS BIGINT) AS syms FROM adj GROUP BY d""",
)
def date_breadth_and_medians(spark, sf_dir):
    adj = adjust(bars_user_day(spark, sf_dir))
    daily = adj.groupBy("d").agg(
        rnd(F.avg((F.col("r") > 0).cast("double"))).alias("breadth"),
        rnd(F.coalesce(F.avg("r"), F.lit(0.0))).alias("mean_r"),
        rnd(F.sum("amount"), 2).alias("amount"),
        F.count_if(F.col("n") == 1).alias("eq1"),
        F.count_if(F.col("r") >= 1).alias("ge1"),
        F.count("sym").alias("syms"),
    )
    medians = X.group_quantiles(adj, ["d"], "r", {"median_r": 0.5})
    return daily.join(medians, "d").select(
        F.col("d").cast("string").alias("d"), "breadth", rnd("median_r").alias("median_r"), "mean_r", "amount", "eq1",
        "ge1", "syms",
    )


@query(
    "top_and_bottom_by_date", "T1 T2 T3 T6",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), RET_SQL,
                "k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ret5 DESC NULLS LAST, sym) AS hi, "
                "row_number() OVER (PARTITION BY d ORDER BY ret5 NULLS LAST, sym) AS lo FROM fe)")
    + f"SELECT sym, CAST(d AS VARCHAR) AS d, {r('ret5')} AS ret5, CAST(hi AS DOUBLE) AS place, 'top' AS side FROM k WHERE hi <= 3 "
      f"UNION ALL SELECT sym, CAST(d AS VARCHAR), {r('ret5')}, CAST(lo AS DOUBLE), 'bottom' FROM k WHERE lo <= 3",
)
def top_and_bottom_by_date(spark, sf_dir):
    panel = _returns(spark, sf_dir).select("sym", "d", "ret5")
    top = X.top_k(panel, ["d"], [F.desc_nulls_last("ret5"), F.asc("sym")], 3, "place").withColumn("side", F.lit("top"))
    low = X.top_k(panel, ["d"], [F.asc_nulls_last("ret5"), F.asc("sym")], 3, "place").withColumn("side", F.lit("bottom"))
    out = top.unionByName(low)
    return out.select(
        "sym", F.col("d").cast("string").alias("d"), rnd("ret5").alias("ret5"), F.col("place").cast("double").alias("place"), "side"
    )


@query(
    "last_dates_and_target_day", "P7 P18",
    S.with_bars(S.USER_DAY, "x AS (SELECT *, dense_rank() OVER (ORDER BY d DESC) AS age, max(d) OVER () AS mx FROM bars)")
    + f"""SELECT sym, CAST(d AS VARCHAR) AS d, {r('close', 4)} AS close, CAST(d = mx AS BIGINT) AS is_target FROM x WHERE age <= 10""",
)
def last_dates_and_target_day(spark, sf_dir):
    bars = bars_user_day(spark, sf_dir)
    # Ten days at most: the semi side is a handful of rows, safe to broadcast.
    days = bars.select("d").distinct().orderBy(F.desc("d")).limit(10)
    newest = days.agg(F.max("d").alias("newest"))
    kept = attach_row(bars.join(F.broadcast(days), "d", "left_semi"), newest)
    return kept.select(
        "sym", F.col("d").cast("string").alias("d"), rnd("close", 4).alias("close"),
        (F.col("d") == F.col("newest")).cast("long").alias("is_target"),
    )
