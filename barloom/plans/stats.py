"""Event-study and ranking statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd, sdiv
from barloom.operators import controls as M
from barloom.operators import cross_section as X
from barloom.operators import events as E
from barloom.operators import labels as L
from barloom.operators import stats as G
from barloom.operators.segments import Segments, segment_integrity
from barloom.plans import sqltext as S
from barloom.plans.events import BASE, MAIN_SQL, V1_SQL, crossed_bars, main_pool
from barloom.plans.labels import BUDGET, PRICED_SQL, entry_sql, outcome_sql, priced
from barloom.plans.market import TIMING_SQL, pool_with_days
from barloom.plans.registry import query
from barloom.plans.sequential import macd_bars
from barloom.plans.sqltext import full, lead, r, ref
from barloom.session import attach_row, cut_lineage, stored
from barloom.sources import bars as SRC

# ---------------------------------------------------------------- the scored panel used below
SCORED_SQL = S.with_bars(
    S.SUPP_MONTH, S.adjusted(),
    f"sc0 AS (SELECT sym, d, year(d) AS y, ((CAST(d - DATE '1970-01-01' AS BIGINT) * 7919 + CAST(vol AS BIGINT)) % 1000) / 1000.0::DOUBLE AS prob, {lead('cf', 3)} / cf - 1 AS fwd, "
    f"cf / {ref('cf', 5)} - 1 AS mom, {full('stddev_samp', 'r', 10)} AS vol10, amount, vol, close, n FROM adj)",
    "sc AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS lab, CASE WHEN d < DATE '1998-01-01' THEN 'train' WHEN d < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS seg FROM sc0)",
)


def scored(spark, sf_dir):
    """Monthly supplier panel with a deterministic score, momentum, volatility and the 3-row forward return."""
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir))
    prob = F.pmod(F.unix_date("d").cast("long") * 7919 + F.col("vol").cast("long"), F.lit(1000)) / 1000.0
    out = adj.select(
        "sym", "d", F.year("d").cast("long").alias("y"), prob.alias("prob"), L.chain_return(3).alias("fwd"), B.pct_change("cf", 5).alias("mom"),
        B.agg("std", "r", 10).alias("vol10"), "amount", "vol", "close", "n",
    )
    seg = F.when(F.col("d") < F.lit("1998-01-01").cast("date"), "train").when(F.col("d") < F.lit("2000-01-01").cast("date"), "val").otherwise("test")
    out = out.withColumn("lab", F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("double"))).withColumn("seg", seg)
    return stored(out, "scored")


def rounded(df, digits=6, **special):
    """All double columns rounded."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(rnd(f.name, special.get(f.name, digits)).alias(f.name) if kind == "double" else F.col(f.name).cast("string").alias(f.name) if kind == "date" else F.col(f.name).cast("long").alias(f.name) if kind in ("int", "boolean") else F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- summaries
@query(
    "summary_by_year", "A1 A3",
    SCORED_SQL + f"SELECT CAST(y AS BIGINT) AS y, count(fwd) AS n, {r('avg(CAST(fwd > 0 AS INT))')} AS win, {r('avg(fwd)')} AS mean, {r('median(fwd)')} AS median FROM sc WHERE fwd IS NOT NULL GROUP BY y",
)
def summary_by_year(spark, sf_dir):
    return rounded(G.summary(scored(spark, sf_dir), ["y"], "fwd"))


@query(
    "summary_grouping_sets", "A2 A3",
    SCORED_SQL + f"""SELECT label, seg, CAST(y AS DOUBLE) AS y, count(x) AS n, {r('avg(CAST(x > 0 AS INT))')} AS win, {r('avg(x)')} AS mean
 FROM (SELECT 'fwd' AS label, seg, y, fwd AS x FROM sc UNION ALL SELECT 'mom', seg, y, mom FROM sc) WHERE x IS NOT NULL GROUP BY GROUPING SETS ((label, seg), (label, y), (label)) HAVING count(x) >= 100""",
)
def summary_grouping_sets(spark, sf_dir):
    out = G.summaries_by(scored(spark, sf_dir), [["seg"], ["y"], []], ["fwd", "mom"], 100)
    return out.select("label", "seg", F.col("y").cast("double").alias("y"), "n", rnd("win").alias("win"), rnd("mean").alias("mean"))


@query(
    "excess_over_control_groups", "A4",
    SCORED_SQL + f"""SELECT seg, count(CASE WHEN prob >= 0.8 THEN fwd END) AS n, {r('avg(CASE WHEN prob >= 0.8 THEN fwd END)')} AS mean, {r('avg(CASE WHEN prob >= 0.8 THEN fwd END) - avg(CASE WHEN prob < 0.4 THEN fwd END)')} AS mean_vs_c1,
 {r('avg(CASE WHEN prob >= 0.8 THEN fwd END) - avg(CASE WHEN prob >= 0.4 AND prob < 0.8 THEN fwd END)')} AS mean_vs_c2, {r('avg(CASE WHEN prob >= 0.8 THEN lab END) - avg(CASE WHEN prob < 0.4 THEN lab END)')} AS win_vs_c1,
 {r('avg(CASE WHEN prob >= 0.8 THEN lab END) - avg(CASE WHEN prob >= 0.4 AND prob < 0.8 THEN lab END)')} AS win_vs_c2 FROM sc GROUP BY seg""",
)
def excess_over_control_groups(spark, sf_dir):
    grp = F.when(F.col("prob") >= 0.8, "div").when(F.col("prob") < 0.4, "c1").otherwise("c2")
    return rounded(G.excess_vs_controls(scored(spark, sf_dir).withColumn("grp", grp), "fwd", "grp", "div", ["c1", "c2"], ["seg"]))


@query(
    "month_counts_and_frequency", "A12 A13 A14",
    SCORED_SQL + f"""SELECT strftime(d, '%Y-%m') AS ym, count(*) AS n, count(DISTINCT sym) AS syms, {r('count(*) / (SELECT sum(span) FROM (SELECT date_diff(\'day\', min(d), max(d)) / 365.25 AS span FROM sc GROUP BY sym))')} AS per_symbol_year FROM sc WHERE prob >= 0.9 GROUP BY 1""",
)
def month_counts_and_frequency(spark, sf_dir):
    df = scored(spark, sf_dir)
    years = df.groupBy("sym").agg((F.date_diff(F.max("d"), F.min("d")) / 365.25).alias("s")).agg(F.sum("s").alias("years"))
    hits = df.where("prob >= 0.9").groupBy(F.date_format("d", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sym").alias("syms"))
    return attach_row(hits, years).select("ym", "n", "syms", rnd(F.col("n") / F.col("years")).alias("per_symbol_year"))


@query(
    "industry_daily_with_minimum", "A9",
    S.with_bars(S.SUPP_MONTH, S.adjusted(), "g AS (SELECT adj.*, s_nationkey % 5 AS ind FROM adj JOIN supplier ON sym = s_suppkey)")
    + f"SELECT CAST(d AS VARCHAR) AS d, CAST(ind AS BIGINT) AS ind, CASE WHEN count(pct) >= 5 THEN {r('avg(pct)', 4)} END AS ind_ret FROM g GROUP BY d, ind",
)
def industry_daily_with_minimum(spark, sf_dir):
    sup = SRC.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sym"), (F.col("s_nationkey") % 5).cast("long").alias("ind"))
    adj = SRC.adjust(SRC.bars_supp_month(spark, sf_dir)).join(sup, "sym")
    return adj.groupBy(F.col("d").cast("string").alias("d"), "ind").agg(F.when(F.count("pct") >= 5, rnd(F.avg("pct"), 4)).alias("ind_ret"))


@query(
    "percentiles_and_concentration", "A15 A16 A17",
    SCORED_SQL + f"""SELECT seg, {r('quantile_cont(fwd, 0.05)')} AS p5, {r('quantile_cont(fwd, 0.5)')} AS p50, {r('quantile_cont(fwd, 0.95)')} AS p95,
 CASE WHEN sum(fwd) > 0 THEN {r('(SELECT sum(t) FROM (SELECT sum(fwd) AS t FROM sc z WHERE z.seg = sc.seg GROUP BY d ORDER BY 1 DESC NULLS LAST LIMIT 5)) / sum(fwd)')} END AS top5_share,
 {r('(SELECT avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) FROM (SELECT avg(fwd) AS m, count(fwd) AS c FROM sc q WHERE q.seg = sc.seg GROUP BY y) WHERE c >= 30)')} AS good_years FROM sc GROUP BY seg""",
)
def percentiles_and_concentration(spark, sf_dir):
    df = scored(spark, sf_dir)
    q = X.group_quantiles(df.where("fwd is not null"), ["seg"], "fwd", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    by_day = df.groupBy("seg", "d").agg(F.sum("fwd").alias("t"))
    top = X.top_k(by_day, ["seg"], [F.desc_nulls_last("t"), F.asc("d")], 5).groupBy("seg").agg(F.sum("t").alias("top"))
    total = df.groupBy("seg").agg(F.sum("fwd").alias("total"))
    years = df.groupBy("seg", "y").agg(F.avg("fwd").alias("m"), F.count("fwd").alias("c")).where("c >= 30")
    good = years.groupBy("seg").agg(F.avg((F.col("m") > 0).cast("double")).alias("good_years"))
    out = q.join(top, "seg").join(total, "seg").join(good, "seg", "left")
    return rounded(out.select("seg", "p5", "p50", "p95", F.when(F.col("total") > 0, F.col("top") / F.col("total")).alias("top5_share"), "good_years"))


@query(
    "payoff_metrics", "RP1 A15",
    SCORED_SQL + f"""SELECT seg, count(fwd) AS n, {r('avg(CASE WHEN fwd > 0 THEN fwd END)')} AS avg_win, {r('avg(CASE WHEN fwd < 0 THEN fwd END)')} AS avg_loss, {r('avg(CASE WHEN fwd > 0 THEN fwd END) / abs(avg(CASE WHEN fwd < 0 THEN fwd END))')} AS payoff_ratio,
 {r('sum(CASE WHEN fwd > 0 THEN fwd END) / abs(sum(CASE WHEN fwd < 0 THEN fwd END))')} AS profit_factor FROM sc GROUP BY seg""",
)
def payoff_metrics(spark, sf_dir):
    return rounded(G.payoff(scored(spark, sf_dir), ["seg"], "fwd"))


# ---------------------------------------------------------------- tests
TWO_SQL = SCORED_SQL.rstrip() + ",\nab AS (SELECT *, CASE WHEN prob >= 0.7 THEN 'a' ELSE 'b' END AS g FROM sc WHERE fwd IS NOT NULL)\n"


def two_groups(spark, sf_dir):
    return scored(spark, sf_dir).where("fwd is not null").withColumn("g", F.when(F.col("prob") >= 0.7, "a").otherwise("b"))


def tail_sql(x: str, density: str, steps: int = 2000) -> str:
    """Two-sided p of |x| by Simpson's rule over a density in ``y``."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    y = f"(abs({x}) * i / {steps})"
    return f"1.0 - 2.0 * abs({x}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {density.replace('y', y)}))"


T_DENSITY = "(exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * pow(1 + y * y / dof, -(dof + 1) / 2))"
Z_DENSITY = "(exp(-0.5 * y * y) / sqrt(2 * pi()))"


@query(
    "welch_t_by_segment", "G1",
    TWO_SQL + f""", w AS (SELECT seg, count(*) FILTER (WHERE g = 'a') AS na, count(*) FILTER (WHERE g = 'b') AS nb, avg(fwd) FILTER (WHERE g = 'a') AS ma, avg(fwd) FILTER (WHERE g = 'b') AS mb, var_samp(fwd) FILTER (WHERE g = 'a') AS va, var_samp(fwd) FILTER (WHERE g = 'b') AS vb FROM ab GROUP BY 1),
x AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof FROM w)
SELECT seg, na AS n_a, nb AS n_b, {r('t', 5)} AS t, {r('dof', 2)} AS dof, {r(tail_sql('t', T_DENSITY), 9)} AS p FROM x""",
)
def welch_t_by_segment(spark, sf_dir):
    out = G.welch(two_groups(spark, sf_dir), "fwd", "g", "a", "b", ["seg"])
    return out.select("seg", "n_a", "n_b", rnd("t", 5).alias("t"), rnd("dof", 2).alias("dof"), rnd("p", 9).alias("p"))


@query(
    "mann_whitney_by_segment", "G2",
    TWO_SQL + f""", k AS (SELECT *, rank() OVER (PARTITION BY seg ORDER BY fwd) + (count(*) OVER (PARTITION BY seg, fwd) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY seg, fwd) AS t FROM ab),
u AS (SELECT seg, count(*) FILTER (WHERE g = 'a') AS na, count(*) FILTER (WHERE g = 'b') AS nb, sum(rk) FILTER (WHERE g = 'a') AS ra, sum(t * t - 1) AS tie FROM k GROUP BY 1),
x AS (SELECT *, ra - na * (na + 1) / 2.0 AS u, (abs(ra - na * (na + 1) / 2.0 - na * nb / 2.0) - 0.5) / sqrt(na * nb / 12.0 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1.0)))) AS z FROM u)
SELECT seg, na AS n_a, nb AS n_b, {r('u', 1)} AS u, {r('z', 5)} AS z, {r(tail_sql('z', Z_DENSITY), 9)} AS p FROM x""",
)
def mann_whitney_by_segment(spark, sf_dir):
    out = G.mann_whitney(two_groups(spark, sf_dir), "fwd", "g", "a", "b", ["seg"])
    return out.select("seg", "n_a", "n_b", rnd("u", 1).alias("u"), rnd("z", 5).alias("z"), rnd("p", 9).alias("p"))


@query(
    "proportion_test_and_wilson", "G3 G4 G5",
    TWO_SQL + f""", w AS (SELECT seg, count(*) FILTER (WHERE g = 'a') AS n1, count(*) FILTER (WHERE g = 'b') AS n2, count(*) FILTER (WHERE g = 'a' AND fwd > 0) AS k1, count(*) FILTER (WHERE g = 'b' AND fwd > 0) AS k2, avg(fwd) / (stddev_samp(fwd) / sqrt(count(fwd))) AS t1 FROM ab GROUP BY 1)
SELECT seg, {r('(k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2))')} AS z, {r('((k1 / n1 + 1.96 * 1.96 / (2 * n1)) - 1.96 * sqrt(k1 / n1 * (1 - k1 / n1) / n1 + 1.96 * 1.96 / (4.0 * n1 * n1))) / (1 + 1.96 * 1.96 / n1)')} AS lo,
 {r('((k1 / n1 + 1.96 * 1.96 / (2 * n1)) + 1.96 * sqrt(k1 / n1 * (1 - k1 / n1) / n1 + 1.96 * 1.96 / (4.0 * n1 * n1))) / (1 + 1.96 * 1.96 / n1)')} AS hi, {r('t1', 5)} AS t1 FROM w""",
)
def proportion_test_and_wilson(spark, sf_dir):
    a, b, up = F.col("g") == "a", F.col("g") == "b", F.col("fwd") > 0
    s = two_groups(spark, sf_dir).groupBy("seg").agg(
        F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.count_if(a & up).alias("k1"), F.count_if(b & up).alias("k2"), G.one_sample_t("fwd").alias("t1")
    )
    lo, hi = G.wilson(F.col("k1"), F.col("n1"))
    z = G.proportion_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return s.select("seg", rnd(z).alias("z"), rnd(lo).alias("lo"), rnd(hi).alias("hi"), rnd("t1", 5).alias("t1"))


@query(
    "cluster_robust_t", "G6",
    SCORED_SQL + f""", m AS (SELECT seg, avg(fwd) AS xb, count(fwd) AS n FROM sc WHERE fwd IS NOT NULL GROUP BY 1), c AS (SELECT sc.seg, d, sum(fwd - xb) AS s FROM sc JOIN m ON m.seg = sc.seg WHERE fwd IS NOT NULL GROUP BY 1, 2),
v AS (SELECT seg, count(*) AS g, sum(s * s) AS ss FROM c GROUP BY 1) SELECT m.seg, CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS clusters, {r('xb')} AS mean, {r('xb / sqrt(g / (g - 1.0) * ss / (n * n))', 5)} AS t FROM m JOIN v ON v.seg = m.seg""".replace(", m AS", "\n, m AS", 1),
)
def cluster_robust_t(spark, sf_dir):
    out = G.cluster_t(scored(spark, sf_dir), "fwd", "d", ["seg"])
    return out.select("seg", "n", "clusters", rnd("mean").alias("mean"), rnd("t", 5).alias("t"))


def _avg_rank(x: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


@query(
    "spearman_by_segment", "G7",
    SCORED_SQL + f""", k AS (SELECT seg, {_avg_rank('prob', 'seg')} AS rx, {_avg_rank('fwd', 'seg')} AS ry FROM sc WHERE fwd IS NOT NULL), c AS (SELECT seg, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY 1)
SELECT seg, n, {r('rho')} AS rho, {r('rho * sqrt((n - 2) / (1 - rho * rho))', 5)} AS t FROM c""",
)
def spearman_by_segment(spark, sf_dir):
    out = G.spearman(scored(spark, sf_dir), "prob", "fwd", ["seg"])
    return out.select("seg", "n", rnd("rho").alias("rho"), rnd("t", 5).alias("t"))


IC_SQL = f""", k AS (SELECT d, y, {_avg_rank('prob', 'd')} AS rx, {_avg_rank('fwd', 'd')} AS ry FROM sc WHERE fwd IS NOT NULL), ic AS (SELECT d, any_value(y) AS y, count(*) AS n, corr(rx, ry) AS ic FROM k GROUP BY d HAVING count(*) >= 5)"""


@query("daily_rank_ic", "G8 W30", SCORED_SQL + IC_SQL + f" SELECT CAST(d AS VARCHAR) AS d, n, {r('ic')} AS ic FROM ic")
def daily_rank_ic(spark, sf_dir):
    return rounded(G.rank_ic(scored(spark, sf_dir), "prob", "fwd"))


@query(
    "rank_ic_summary_by_year", "G8 RP16",
    SCORED_SQL + IC_SQL + f" SELECT CAST(y AS BIGINT) AS y, count(*) AS days, {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std, {r('avg(ic) / stddev_samp(ic)', 5)} AS icir, {r('avg(CAST(ic > 0 AS INT))')} AS positive_share FROM ic GROUP BY y HAVING count(*) >= 10",
)
def rank_ic_summary_by_year(spark, sf_dir):
    daily = G.rank_ic(scored(spark, sf_dir), "prob", "fwd").withColumn("y", F.year("d").cast("long"))
    return rounded(G.ic_summary(daily, ["y"], 10), icir=5)


@query(
    "wilcoxon_top_vs_universe", "RP8 RP7",
    SCORED_SQL + f""", tp AS (SELECT d, avg(fwd) AS t FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY prob DESC, sym) AS rn FROM sc WHERE fwd IS NOT NULL) WHERE rn <= 5 GROUP BY d), un AS (SELECT d, avg(fwd) AS u FROM sc WHERE fwd IS NOT NULL GROUP BY d),
df AS (SELECT t - u AS x FROM tp JOIN un USING (d) WHERE abs(t - u) > 1e-12), rk AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS rr, count(*) OVER (PARTITION BY abs(x)) AS tt FROM df)
SELECT count(*) AS n, {r('sum(CASE WHEN x > 0 THEN rr ELSE 0.0 END)', 1)} AS w_plus, {r('(sum(CASE WHEN x > 0 THEN rr ELSE 0.0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - sum(tt * tt - 1) / 48.0)', 5)} AS z FROM rk""",
)
def wilcoxon_top_vs_universe(spark, sf_dir):
    df = scored(spark, sf_dir).where("fwd is not null")
    top = X.top_k(df, ["d"], [F.desc("prob"), F.asc("sym")], 5).groupBy("d").agg(F.avg("fwd").alias("t"))
    whole = df.groupBy("d").agg(F.avg("fwd").alias("u"))
    out = G.wilcoxon_by_day(top.join(whole, "d"), "t", "u")
    return out.select("n", rnd("w_plus", 1).alias("w_plus"), rnd("z", 5).alias("z"))


# ---------------------------------------------------------------- buckets and ranking metrics
@query(
    "score_deciles", "G9 G10",
    SCORED_SQL + f""", k AS (SELECT *, row_number() OVER (ORDER BY prob, sym, d) AS rn, count(*) OVER () AS nn FROM sc WHERE fwd IS NOT NULL), b AS (SELECT *, greatest(1, ceil((rn - 1) * 10 / (nn - 1)::DOUBLE)) AS bucket FROM k)
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, {r('avg(fwd)')} AS mean, {r('avg(lab)')} AS win FROM b GROUP BY 1""",
)
def score_deciles(spark, sf_dir):
    out = G.quantile_buckets(scored(spark, sf_dir).where("fwd is not null"), [], "prob", 10, ["sym", "d"])
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("fwd")).alias("mean"), rnd(F.avg("lab")).alias("win"))


@query(
    "daily_quintile_returns", "G9 RP16",
    SCORED_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY mom, sym) AS rn, count(*) OVER (PARTITION BY d) AS nn FROM sc WHERE fwd IS NOT NULL AND mom IS NOT NULL), b AS (SELECT *, CASE WHEN nn = 1 THEN 1 ELSE greatest(1, ceil((rn - 1) * 5 / (nn - 1)::DOUBLE)) END AS q FROM k)
SELECT CAST(q AS BIGINT) AS q, count(*) AS n, {r('avg(fwd)')} AS mean FROM b GROUP BY 1""",
)
def daily_quintile_returns(spark, sf_dir):
    df = scored(spark, sf_dir).where("fwd is not null and mom is not null")
    return G.quantile_buckets(df, ["d"], "mom", 5, ["sym"], "q").groupBy("q").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("fwd")).alias("mean"))


@query(
    "value_terciles_and_slices", "G9 G10",
    SCORED_SQL + f""", q AS (SELECT quantile_cont(vol10, 1 / 3.0::DOUBLE) AS a, quantile_cont(vol10, 2 / 3.0::DOUBLE) AS b FROM sc), k AS (SELECT *, 1 + CAST(vol10 > a AS INT) + CAST(vol10 > b AS INT) AS bucket FROM sc, q WHERE vol10 IS NOT NULL)
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, {r('avg(fwd)')} AS mean FROM k GROUP BY 1""",
)
def value_terciles_and_slices(spark, sf_dir):
    out = G.value_cut_buckets(scored(spark, sf_dir).where("vol10 is not null"), "vol10", 3)
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("fwd")).alias("mean"))


AP_SQL = """, cs AS (SELECT seg, prob, sum(lab) AS p, count(*) AS c FROM sc WHERE lab IS NOT NULL GROUP BY 1, 2), cu AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS ct, sum(p) OVER (PARTITION BY seg) AS pp FROM cs WINDOW w AS (PARTITION BY seg ORDER BY prob DESC)),
apx AS (SELECT seg, sum(p / pp * (tp / ct)) AS ap FROM cu GROUP BY 1)"""


@query(
    "segment_score_metrics", "G11 G12 G13 T1 C12",
    SCORED_SQL + AP_SQL + f""", tk AS (SELECT seg, d, avg(lab) AS p, sum(lab) AS h, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY seg, d ORDER BY prob DESC, sym) AS rn FROM sc WHERE lab IS NOT NULL) WHERE rn <= 5 GROUP BY 1, 2)
SELECT b.seg, n, {r('base')} AS base_rate, {r('ap')} AS ap, {r('pd')} AS precision_day, {r('pe')} AS precision_event, days FROM (SELECT seg, count(*) AS n, avg(lab) AS base FROM sc WHERE lab IS NOT NULL GROUP BY 1) b
JOIN apx ON apx.seg = b.seg JOIN (SELECT seg, avg(p) AS pd, sum(h) / sum(c) AS pe, count(*) AS days FROM tk GROUP BY 1) t ON t.seg = b.seg""",
)
def segment_score_metrics(spark, sf_dir):
    return rounded(G.segment_metrics(scored(spark, sf_dir), "prob", "lab", "seg", 5, ["sym"]))


@query(
    "threshold_classification", "RP15 G11",
    SCORED_SQL + ", z AS (SELECT sum(lab) AS pos, count(lab) AS n FROM sc WHERE lab IS NOT NULL) " + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, {r('tp / pp')} AS precision, {r('tp / pos')} AS recall, {r('2 * (tp / pp) * (tp / pos) / ((tp / pp) + (tp / pos))')} AS f1, {r('pos / n')} AS prior, {r('(tp / pp) / (pos / n)')} AS lift FROM (SELECT sum(lab) AS tp, count(lab) AS pp FROM sc WHERE lab IS NOT NULL AND prob >= {t}), z"
        for t in (0.3, 0.5, 0.7)),
)
def threshold_classification(spark, sf_dir):
    return rounded(G.threshold_metrics(scored(spark, sf_dir), "prob", "lab", (0.3, 0.5, 0.7)))


@query(
    "daily_hits_and_turnover", "RP16 RP15 T1",
    SCORED_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY prob DESC, sym) AS rn FROM sc WHERE lab IS NOT NULL), h AS (SELECT d, max(CASE WHEN rn <= 1 THEN lab END) AS h1, max(CASE WHEN rn <= 3 THEN lab END) AS h3, max(CASE WHEN rn <= 5 THEN lab END) AS h5 FROM k WHERE rn <= 5 GROUP BY d),
t AS (SELECT sym, d, dense_rank() OVER (ORDER BY d) AS i FROM k WHERE rn <= 5), o AS (SELECT i, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM t b WHERE b.sym = t.sym AND b.i = t.i - 1)) AS kk FROM t GROUP BY i)
SELECT {r('avg(h1)')} AS hit1, {r('avg(h3)')} AS hit3, {r('avg(h5)')} AS hit5, (SELECT {r('avg(1 - kk / n)')} FROM o WHERE i > 1) AS turnover FROM h""",
)
def daily_hits_and_turnover(spark, sf_dir):
    df = scored(spark, sf_dir).where("lab is not null")
    hits = G.hit_at(df, "prob", "lab", (1, 3, 5))
    return rounded(attach_row(hits, G.top_turnover(df, "prob", 5)))


@query(
    "neutral_long_short", "G29 W43",
    SCORED_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY prob DESC, sym) AS hi, row_number() OVER (PARTITION BY d ORDER BY prob, sym) AS lo, dense_rank() OVER (ORDER BY d) AS dn FROM sc WHERE fwd IS NOT NULL)
SELECT CAST(d AS VARCHAR) AS d, {r('avg(CASE WHEN hi <= 10 THEN fwd END) - avg(CASE WHEN lo <= 10 THEN fwd END) - 0.002')} AS long_short, {r('avg(CASE WHEN hi <= 10 THEN fwd END) - avg(fwd) - 0.002')} AS top_minus_universe FROM k GROUP BY d""",
)
def neutral_long_short(spark, sf_dir):
    return rounded(G.long_short(scored(spark, sf_dir).where("fwd is not null"), "prob", "fwd", 10, 0.002))


@query(
    "neutral_long_short_by_phase", "G29 W43",
    SCORED_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY prob DESC, sym) AS hi, row_number() OVER (PARTITION BY d ORDER BY prob, sym) AS lo, dense_rank() OVER (ORDER BY d) AS dn FROM sc WHERE fwd IS NOT NULL)
SELECT CAST(d AS VARCHAR) AS d, CAST((dn - 1) % 4 AS BIGINT) AS phase, {r('avg(CASE WHEN hi <= 10 THEN fwd END) - avg(CASE WHEN lo <= 10 THEN fwd END) - 0.002')} AS long_short, {r('avg(CASE WHEN hi <= 10 THEN fwd END) - avg(fwd) - 0.002')} AS top_minus_universe FROM k GROUP BY d, dn""",
)
def neutral_long_short_by_phase(spark, sf_dir):
    df = scored(spark, sf_dir).where("fwd is not null")
    cal = SRC.calendar(df).select("d", F.pmod(F.col("cal_pos") - 1, F.lit(4)).cast("long").alias("phase"))
    every = G.long_short(df, "prob", "fwd", 10, 0.002).join(F.broadcast(cal), "d")
    return rounded(every.select("d", "phase", "long_short", "top_minus_universe"))


@query(
    "gain_buckets_and_head_labels", "RP4 RP5",
    SCORED_SQL + f""", k AS (SELECT sym, d, (rank() OVER (PARTITION BY d ORDER BY fwd) - 1 + (count(*) OVER (PARTITION BY d, fwd) + 1) / 2.0) / count(*) OVER (PARTITION BY d) AS pr FROM sc WHERE fwd IS NOT NULL)
SELECT sym, CAST(d AS VARCHAR) AS d, CAST(least(30, floor(pr * 31)) AS BIGINT) AS gain, CAST(pr > 0.9 AS BIGINT) AS head FROM k""",
)
def gain_buckets_and_head_labels(spark, sf_dir):
    out = X.add_pct_rank(scored(spark, sf_dir).where("fwd is not null").select("sym", "d", "fwd"), ["d"], "fwd", "pr")
    return out.select("sym", F.col("d").cast("string").alias("d"), F.least(F.lit(30), F.floor(F.col("pr") * 31)).cast("long").alias("gain"), (F.col("pr") > 0.9).cast("long").alias("head"))


@query(
    "time_to_barrier", "RP5",
    S.with_bars(*MAIN_SQL) + """SELECT e.sym, CAST(e.sig_pos AS BIGINT) AS sig_pos, CAST(e.low_pos AS BIGINT) AS low_pos, CAST(least(20, coalesce((SELECT min(x.pos - e.sig_pos) FROM mc x WHERE x.sym = e.sym AND x.pos BETWEEN e.sig_pos + 1 AND e.sig_pos + 20 AND x.high >= b.close * 1.5), 20)) AS BIGINT) AS rows_to_hit
 FROM main_ev e JOIN mc b ON b.sym = e.sym AND b.pos = e.sig_pos""",
)
def time_to_barrier(spark, sf_dir):
    from barloom.operators.joins import bars_after

    panel = macd_bars(spark, sf_dir)
    at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "close")
    ev = main_pool(panel).select("sym", "sig_pos", "low_pos").join(at, ["sym", "sig_pos"])
    path = bars_after(ev, panel, ["high"], 1, 20)
    first = path.where(F.col("x_high") >= F.col("close") * 1.5).groupBy("sym", "sig_pos", "low_pos").agg(F.min("step").alias("s"))
    out = ev.join(first, ["sym", "sig_pos", "low_pos"], "left")
    return out.select("sym", "sig_pos", "low_pos", F.coalesce("s", F.lit(20)).cast("long").alias("rows_to_hit"))


@query(
    "density_strata_and_top_n", "RP6 RP7 W34",
    SCORED_SQL + f""", c AS (SELECT *, count(*) OVER (PARTITION BY d) AS members, row_number() OVER (PARTITION BY d ORDER BY prob DESC, sym) AS rn, avg(lab) OVER (PARTITION BY d) AS pool FROM sc WHERE lab IS NOT NULL AND prob >= 0.6),
s AS (SELECT *, CASE WHEN members <= 3 THEN 'le3' WHEN members <= 10 THEN '4-10' WHEN members <= 50 THEN '11-50' ELSE 'gt50' END AS stratum FROM c), e AS (SELECT s.*, topn FROM s, (VALUES (1), (3), (5), (10), (1000000)) v(topn) WHERE rn <= topn)
SELECT stratum, CAST(topn AS BIGINT) AS top_n, count(DISTINCT d) AS days, count(*) AS picks, {r('avg(lab)')} AS hit FROM e GROUP BY 1, 2""",
)
def density_strata_and_top_n(spark, sf_dir):
    df = scored(spark, sf_dir).where("lab is not null and prob >= 0.6").select("sym", "d", "prob", "lab")
    sizes = df.groupBy("d").agg(F.count(F.lit(1)).alias("m"))
    stratum = F.when(F.col("m") <= 3, "le3").when(F.col("m") <= 10, "4-10").when(F.col("m") <= 50, "11-50").otherwise("gt50")
    tagged = df.join(sizes.select("d", stratum.alias("stratum")), "d")
    few = X.top_k(tagged, ["d"], [F.desc("prob"), F.asc("sym")], 10, "rn").withColumn("top_n", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)]))).where("rn <= top_n").drop("rn")
    both = few.unionByName(tagged.withColumn("top_n", F.lit(1000000)))
    return both.groupBy("stratum", F.col("top_n").cast("long").alias("top_n")).agg(F.count_distinct("d").alias("days"), F.count(F.lit(1)).alias("picks"), rnd(F.avg("lab")).alias("hit"))


@query(
    "day_weighted_baseline", "RP7",
    SCORED_SQL + f"SELECT seg, {r('avg(p)')} AS baseline, count(*) AS days FROM (SELECT seg, d, avg(lab) AS p FROM sc WHERE lab IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
)
def day_weighted_baseline(spark, sf_dir):
    per_day = scored(spark, sf_dir).where("lab is not null").groupBy("seg", "d").agg(F.avg("lab").alias("p"))
    return per_day.groupBy("seg").agg(rnd(F.avg("p")).alias("baseline"), F.count(F.lit(1)).alias("days"))


@query("random_top3_distribution", "RP9")
def random_top3_distribution(spark, sf_dir):
    """Where the score's daily top-3 return lies among 200 random daily top-3 selections."""
    df = scored(spark, sf_dir).where("fwd is not null").select("sym", "d", "prob", "fwd")
    drawn = M.random_picks(df, ["d"], ["sym"], 3, 200, 9)
    means = drawn.groupBy("rep", "d").agg(F.avg("fwd").alias("m")).groupBy("rep").agg(F.avg("m").alias("m"))
    rule = X.top_k(df, ["d"], [F.desc("prob"), F.asc("sym")], 3).groupBy("d").agg(F.avg("fwd").alias("m")).agg(F.avg("m").alias("rule"))
    return attach_row(means, rule).agg(
        F.count(F.lit(1)).alias("draws"), rnd(F.avg("m")).alias("mean"), rnd(F.first("rule")).alias("rule"), rnd(F.avg((F.col("m") < F.col("rule")).cast("double"))).alias("share_below")
    )


@query(
    "open_event_marks", "RP10 J20",
    S.with_bars(*TIMING_SQL, "mk AS (SELECT x.d, x.cf / a.cf - 1 AS m FROM te JOIN mc a ON a.sym = te.sym AND a.pos = te.sig_pos JOIN mc x ON x.sym = te.sym AND x.pos BETWEEN te.sig_pos + 1 AND te.sig_pos + 5)",
                "dm AS (SELECT cal.d, coalesce(avg(m), 0) AS mark, count(m) AS open_n FROM cal LEFT JOIN mk ON mk.d = cal.d GROUP BY 1)")
    + f"SELECT CAST(d AS VARCHAR) AS d, {r('mark')} AS mark, open_n FROM dm",
)
def open_event_marks(spark, sf_dir):
    from barloom.operators.joins import bars_after

    ev, cal = pool_with_days(spark, sf_dir)
    panel = macd_bars(spark, sf_dir)
    at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), F.col("cf").alias("cf0"))
    path = bars_after(ev.select("sym", "sig_pos", "low_pos").join(at, ["sym", "sig_pos"]), panel, ["d", "cf"], 1, 5)
    marks = path.groupBy(F.col("x_d").alias("d")).agg(F.avg(F.col("x_cf") / F.col("cf0") - 1.0).alias("mark"), F.count(F.lit(1)).alias("open_n"))
    return cal.join(marks, "d", "left").select(F.col("d").cast("string").alias("d"), rnd(F.coalesce("mark", F.lit(0.0))).alias("mark"), F.coalesce("open_n", F.lit(0)).cast("long").alias("open_n"))


@query(
    "partial_rank_screening", "RP12",
    SCORED_SQL + f""", k AS (SELECT d, {_avg_rank('prob', 'd')} AS rx, {_avg_rank('fwd', 'd')} AS ry, {_avg_rank('amount', 'd')} AS rz FROM sc WHERE fwd IS NOT NULL), c AS (SELECT d, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM k GROUP BY d HAVING count(*) >= 10)
SELECT count(*) AS days, {r('avg(xy)')} AS ic, {r('avg(xz)')} AS control_corr, {r('avg((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)))')} AS partial_ic FROM c""",
)
def partial_rank_screening(spark, sf_dir):
    df = scored(spark, sf_dir).where("fwd is not null").select("sym", "d", "prob", "fwd", "amount")
    rows = X.largest_group(df, ["d"])
    for c, p in (("prob", "_x"), ("fwd", "_y"), ("amount", "_z")):
        df = X.rank_counts(df, ["d"], c, p, rows)
    rk = {p: X.average_rank(F.col(p + "less"), F.col(p + "ties")) for p in ("_x", "_y", "_z")}
    daily = df.groupBy("d").agg(F.count(F.lit(1)).alias("n"), G.moment_corr(rk["_x"], rk["_y"]).alias("xy"), G.moment_corr(rk["_x"], rk["_z"]).alias("xz"), G.moment_corr(rk["_y"], rk["_z"]).alias("yz")).where("n >= 10")
    xy, xz, yz = F.col("xy"), F.col("xz"), F.col("yz")
    partial = sdiv(xy - xz * yz, F.sqrt((1.0 - xz * xz) * (1.0 - yz * yz)))
    return daily.agg(F.count(F.lit(1)).alias("days"), rnd(F.avg("xy")).alias("ic"), rnd(F.avg("xz")).alias("control_corr"), rnd(F.avg(partial)).alias("partial_ic"))


# ---------------------------------------------------------------- correlation, signs, audits
FEATS = ("mom", "vol10", "amount", "vol", "close", "prob")


@query(
    "pairwise_correlations", "A20",
    SCORED_SQL + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})', 5)} AS corr FROM sc" for i, a in enumerate(FEATS) for b in FEATS[i + 1:]),
)
def pairwise_correlations(spark, sf_dir):
    out = G.pairwise_corr(scored(spark, sf_dir), FEATS)
    return out.select("a", "b", "n", rnd("corr", 5).alias("corr"))


@query("column_dedup_and_clusters", "G14 G15 G16")
def column_dedup_and_clusters(spark, sf_dir):
    """Columns with planted copies: which are dropped, whom they follow, and their connected component."""
    df = scored(spark, sf_dir).withColumns({"amount_copy": F.col("amount") * 2.0, "mom_noisy": F.col("mom") + 0.01 * F.col("prob"), "close_copy": -F.col("close")})
    names = [*FEATS, "amount_copy", "mom_noisy", "close_copy"]
    corr = cut_lineage(G.pairwise_corr(df, names))
    kept, dropped = G.drop_duplicated_columns(corr, names)
    owner = G.representative_clusters(corr, names, 0.9)
    nodes = spark.createDataFrame([(n, n in kept, dropped.get(n), owner[n]) for n in names], "node string, kept boolean, copy_of string, representative string")
    parts = G.linked_components(corr.where("abs(corr) > 0.85"), nodes.select("node"))
    return nodes.join(parts, "node")


@query(
    "yearly_sign_consistency", "G17",
    SCORED_SQL + ", s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS name, y, sign(corr({a}, fwd)) AS sg FROM sc WHERE fwd IS NOT NULL AND {a} IS NOT NULL GROUP BY y" for a in ("mom", "vol10", "prob")) + ") SELECT name, count(*) AS years, CAST(min(sg) = max(sg) AND min(sg) <> 0 AS BIGINT) AS consistent FROM s GROUP BY 1",
)
def yearly_sign_consistency(spark, sf_dir):
    out = G.yearly_signs(scored(spark, sf_dir), {a: (a, "fwd") for a in ("mom", "vol10", "prob")}, "y")
    return out.select("name", "years", F.col("consistent").cast("long").alias("consistent"))


@query(
    "leakage_scan", "G26",
    SCORED_SQL + ", l AS (SELECT *, CASE WHEN lab IS NOT NULL THEN lab * 0.9 + prob * 0.1 END AS leaky FROM sc) " + " UNION ALL ".join(f"SELECT '{a}' AS feature, {r(f'corr({a}, lab)')} AS corr, {r(f'avg(CASE WHEN {a} IS NOT NULL AND lab IS NOT NULL THEN CASE WHEN {a} = lab THEN 1.0 ELSE 0.0 END END)')} AS equal_share, CAST(abs(corr({a}, lab)) > 0.5 AS BIGINT) AS flagged FROM l" for a in ("mom", "vol10", "prob", "leaky")),
)
def leakage_scan(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("leaky", F.col("lab") * 0.9 + F.col("prob") * 0.1)
    return rounded(G.leakage_scan(df, ["mom", "vol10", "prob", "leaky"], "lab"))


@query(
    "dropped_sample_bias", "G27",
    SCORED_SQL + f"SELECT CAST(prob >= 0.3 AND mom IS NOT NULL AS BIGINT) AS kept, count(*) AS n, {r('avg(fwd)')} AS mean, {r('median(fwd)')} AS median FROM sc WHERE fwd IS NOT NULL GROUP BY 1",
)
def dropped_sample_bias(spark, sf_dir):
    df = scored(spark, sf_dir).where("fwd is not null").withColumn("kept", ((F.col("prob") >= 0.3) & F.col("mom").isNotNull()).cast("long"))
    return rounded(G.summary(df, ["kept"], "fwd").drop("win"))


@query(
    "duplicate_key_audit", "G28 J1",
    f"""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated_keys, {r('sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)')} AS repeated_row_share FROM k""",
)
def duplicate_key_audit(spark, sf_dir):
    return rounded(G.duplicate_share(SRC.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(
    "segment_integrity_check", "G24 P4",
    SCORED_SQL + """, cal AS (SELECT d, row_number() OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM sc)), s AS (SELECT seg, min(p) AS lo, max(p) AS hi FROM sc JOIN cal USING (d) GROUP BY 1)
SELECT (SELECT count(*) FROM sc WHERE seg IS DISTINCT FROM CASE WHEN d <= DATE '1997-12-31' THEN 'train' WHEN d BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' THEN 'val' WHEN d >= DATE '2000-01-01' THEN 'test' ELSE 'embargo' END) AS wrong_segment,
 (SELECT count(*) FROM sc WHERE seg = 'embargo') AS in_embargo, CAST((SELECT lo FROM s WHERE seg = 'val') - (SELECT hi FROM s WHERE seg = 'train') - 1 AS BIGINT) AS gap_train_val,
 CAST((SELECT lo FROM s WHERE seg = 'test') - (SELECT hi FROM s WHERE seg = 'val') - 1 AS BIGINT) AS gap_val_test,
 CAST((SELECT lo FROM s WHERE seg = 'val') - (SELECT hi FROM s WHERE seg = 'train') - 1 >= 30 AND (SELECT lo FROM s WHERE seg = 'test') - (SELECT hi FROM s WHERE seg = 'val') - 1 >= 30 AS BIGINT) AS gaps_ok""",
)
def segment_integrity_check(spark, sf_dir):
    rule = Segments.of(train=(None, "1997-12-31"), val=("1998-01-01", "1999-12-31"), test=("2000-01-01", None))
    df = scored(spark, sf_dir)
    return rounded(segment_integrity(df, SRC.calendar(df), rule, (("train", "val"), ("val", "test"))))


@query(
    "tables_agree_on_prefix", "G23 G25 J5",
    S.with_bars(S.SUPP_MONTH) + "SELECT c AS \"column\", 0.0::DOUBLE AS max_diff, CAST(0 AS BIGINT) AS one_sided, (SELECT count(*) FROM bars WHERE d = DATE '1999-06-01') AS n_rows, CAST(1 AS BIGINT) AS agrees FROM (VALUES ('mom'), ('vol10')) v(c)",
)
def tables_agree_on_prefix(spark, sf_dir):
    """Values at a day from full history equal those computed from rows up to that day only."""
    cut = F.lit("1999-06-01").cast("date")

    def feats(bars):
        adj = SRC.adjust(bars)
        return adj.select("sym", "d", B.pct_change("cf", 5).alias("mom"), B.agg("std", "r", 10).alias("vol10")).where(F.col("d") == cut)

    bars = SRC.bars_supp_month(spark, sf_dir)
    out = G.tables_agree(feats(bars), feats(bars.where(F.col("d") <= cut)), ["sym", "d"], ["mom", "vol10"])
    return rounded(out)


@query(
    "prefix_event_equality", "G23 J22 E26 U3 J7",
    S.with_bars(S.BRAND_WEEK) + "SELECT CAST(0 AS BIGINT) AS mismatches",
)
def prefix_event_equality(spark, sf_dir):
    """Events known by a day are the same with and without the rows after it."""
    from barloom.operators.joins import symmetric_difference
    from barloom.operators.sequential import add_recursions, macd

    bars = SRC.bars_brand_week(spark, sf_dir)
    cut = F.lit("1999-03-01").cast("date")

    def known(b):
        panel = stored(add_recursions(SRC.adjust(b), [macd("close")]), "prefix")
        at = panel.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d")
        return main_pool(panel).join(at, ["sym", "sig_pos"]).where(F.col("d") <= cut)

    diff = symmetric_difference(known(bars), known(bars.where(F.col("d") <= cut)), ["sym", "sig_pos", "low_pos", "prev_pos", "rank"])
    return diff.agg(F.count(F.lit(1)).alias("mismatches"))


# ---------------------------------------------------------------- curves, funnels
EQUITY_SQL = S.with_bars(S.INDEX_WEEK, "e AS (SELECT d, close AS equity, close / lag(close) OVER (ORDER BY d) - 1 AS rr, close / max(close) OVER (ORDER BY d) - 1 AS dd FROM bars)")


@query(
    "equity_curve_metrics", "A23 A24 W29",
    EQUITY_SQL + f"""SELECT count(*) AS days, {r('pow(arg_max(equity, d) / arg_min(equity, d), 1 / (count(rr) / 52.0)) - 1')} AS annual_return, {r('avg(rr) / stddev_samp(rr) * sqrt(52.0)')} AS sharpe, {r('min(dd)')} AS max_drawdown,
 {r('(pow(arg_max(equity, d) / arg_min(equity, d), 1 / (count(rr) / 52.0)) - 1) / abs(min(dd))')} AS calmar FROM e""",
)
def equity_curve_metrics(spark, sf_dir):
    curve = SRC.index_bars(spark, sf_dir).select("d", F.col("close").alias("equity"))
    return rounded(G.equity_metrics(curve, periods=52.0))


@query(
    "yearly_return_chain", "A24",
    EQUITY_SQL + f", y AS (SELECT year(d) AS y, arg_max(equity, d) AS z, arg_min(equity, d) AS a FROM e GROUP BY 1) SELECT CAST(y AS BIGINT) AS y, {r('z / coalesce(lag(z) OVER (ORDER BY y), a) - 1')} AS ret FROM y",
)
def yearly_return_chain(spark, sf_dir):
    return rounded(G.yearly_chain(SRC.index_bars(spark, sf_dir).select("d", F.col("close").alias("equity"))))


@query(
    "outcome_funnel", "A22 A13",
    S.with_bars(*BASE, *V1_SQL, PRICED_SQL, entry_sql("v1"), outcome_sql("en", 5)) + "SELECT status, count(*) AS events, CAST(sum(CASE WHEN net_ret > 0 THEN 1 ELSE 0 END) AS BIGINT) AS winners FROM oc GROUP BY 1",
)
def outcome_funnel(spark, sf_dir):
    df = crossed_bars(spark, sf_dir)
    bars = priced(df)
    done = L.outcomes(L.market_entries(E.cross_divergence_simple(df).select("sym", "sig_pos"), bars), bars, L.ExitRule(5, budget=BUDGET))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("net_ret") > 0).alias("winners"))


@query(
    "winner_with_median_constraint", "T4 T5",
    SCORED_SQL + f""", g AS (SELECT CAST(n % 5 AS BIGINT) AS cfg, seg, avg(lab) AS prec, avg(prob) AS ap FROM sc WHERE lab IS NOT NULL GROUP BY 1, 2), md AS (SELECT seg, median(ap) AS m FROM g GROUP BY 1),
k AS (SELECT g.*, m, row_number() OVER (PARTITION BY g.seg ORDER BY prec DESC, ap DESC, cfg) AS rn FROM g JOIN md ON md.seg = g.seg) SELECT seg, cfg, {r('prec')} AS prec, CAST(ap >= m AS BIGINT) AS valid FROM k WHERE rn = 1""",
)
def winner_with_median_constraint(spark, sf_dir):
    g = scored(spark, sf_dir).where("lab is not null").groupBy((F.col("n") % 5).alias("cfg"), "seg").agg(F.avg("lab").alias("prec"), F.avg("prob").alias("ap"))
    best = X.top_k(g, ["seg"], [F.desc("prec"), F.desc("ap"), F.asc("cfg")], 1)
    mid = X.group_quantiles(g, ["seg"], "ap", {"m": 0.5})
    return best.join(mid, "seg").select("seg", "cfg", rnd("prec").alias("prec"), (F.col("ap") >= F.col("m")).cast("long").alias("valid"))


@query(
    "two_pool_elimination", "RP14",
    SCORED_SQL + """, a AS (SELECT sym, avg(mom) AS s FROM sc WHERE seg = 'train' GROUP BY 1), b AS (SELECT sym, avg(mom) AS s FROM sc WHERE seg = 'val' GROUP BY 1),
pa AS (SELECT sym, (rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) + 1) / 2.0) / count(*) OVER () AS p FROM a WHERE s IS NOT NULL), pb AS (SELECT sym, (rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) + 1) / 2.0) / count(*) OVER () AS p FROM b WHERE s IS NOT NULL)
SELECT sym FROM pa WHERE p > 0.5 INTERSECT SELECT sym FROM pb WHERE p > 0.5""",
)
def two_pool_elimination(spark, sf_dir):
    df = scored(spark, sf_dir)

    def kept(seg):
        means = df.where(F.col("seg") == seg).groupBy("sym").agg(F.avg("mom").alias("s")).where("s is not null")
        return X.add_pct_rank(means, [], "s", "p").where("p > 0.5").select("sym")

    return kept("train").intersect(kept("val"))


@query(
    "two_pool_two_rounds", "RP14",
    SCORED_SQL + """, a AS (SELECT sym, avg(mom) AS s FROM sc WHERE seg = 'train' GROUP BY 1), b AS (SELECT sym, avg(mom) AS s FROM sc WHERE seg = 'val' GROUP BY 1),
pa AS (SELECT sym, s, (rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) + 1) / 2.0) / count(*) OVER () AS p FROM a WHERE s IS NOT NULL), pb AS (SELECT sym, s, (rank() OVER (ORDER BY s) - 1 + (count(*) OVER (PARTITION BY s) + 1) / 2.0) / count(*) OVER () AS p FROM b WHERE s IS NOT NULL),
one AS (SELECT pa.sym, pa.s AS sa, pb.s AS sb FROM pa JOIN pb USING (sym) WHERE pa.p > 0.5 AND pb.p > 0.5),
two AS (SELECT *, (rank() OVER (ORDER BY sa) - 1 + (count(*) OVER (PARTITION BY sa) + 1) / 2.0) / count(*) OVER () AS p, (rank() OVER (ORDER BY sb) - 1 + (count(*) OVER (PARTITION BY sb) + 1) / 2.0) / count(*) OVER () AS q FROM one)
SELECT sym, CAST(p > 0.25 AND q > 0.25 AS BIGINT) AS second_round FROM two""",
)
def two_pool_two_rounds(spark, sf_dir):
    """Symbols above the median score in both pools, and which of them also leave the lowest quarter behind in both."""
    df = scored(spark, sf_dir)
    first = two_pool_elimination(spark, sf_dir)
    marks = first
    for seg in ("train", "val"):
        means = df.where(F.col("seg") == seg).groupBy("sym").agg(F.avg("mom").alias("s")).join(first, "sym", "left_semi")
        marks = marks.join(X.add_pct_rank(means, [], "s", f"p_{seg}").select("sym", f"p_{seg}"), "sym")
    return marks.select("sym", ((F.col("p_train") > 0.25) & (F.col("p_val") > 0.25)).cast("long").alias("second_round"))


@query("permutation_importance_by_day", "RP13 G8")
def permutation_importance_by_day(spark, sf_dir):
    """Drop of the mean daily rank correlation when one input of a fixed score is shuffled inside the day, 2 repeats."""
    from barloom.operators.controls import shuffled_within

    df = scored(spark, sf_dir).where("fwd is not null and mom is not null and vol10 is not null").select("sym", "d", "mom", "vol10", "fwd")
    reps = df.withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2))))
    both = shuffled_within(reps, ["rep", "d"], "mom", ["sym"], 100, "mom_s")
    both = both.join(shuffled_within(reps, ["rep", "d"], "vol10", ["sym"], 200, "vol_s").select("rep", "sym", "d", "vol_s"), ["rep", "sym", "d"])
    score = lambda m, v: F.col(m) - 0.5 * F.col(v)
    variants = F.explode(F.array(
        F.struct(F.lit("base").alias("feature"), score("mom", "vol10").alias("score")),
        F.struct(F.lit("mom").alias("feature"), score("mom_s", "vol10").alias("score")),
        F.struct(F.lit("vol10").alias("feature"), score("mom", "vol_s").alias("score")),
    ))
    # Read by the count of the largest day as well; the three means by the drops and by their base.
    both = stored(both.select("rep", "d", "fwd", "mom", "vol10", "mom_s", "vol_s"), "shuffled")
    long = both.select("rep", "d", "fwd", variants.alias("e")).select("rep", "d", "fwd", "e.*").withColumn("day", F.struct("feature", "rep", "d"))
    ic = cut_lineage(G.rank_ic(long, "score", "fwd", "day").groupBy("day.feature").agg(F.avg("ic").alias("ic")))
    base = ic.where("feature = 'base'").select(F.col("ic").alias("base"))
    return attach_row(ic.where("feature <> 'base'"), base).select("feature", rnd(F.col("base") - F.col("ic")).alias("mean_drop"))
