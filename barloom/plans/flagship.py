"""The flagship: daily top-5 reversal picks against the universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import BARS
from barloom.functions.scalar import rnd, sdiv
from barloom.operators.cross_section import add_pct_rank, largest_group, top_k
from barloom.plans.registry import query
from barloom.plans.sqltext import SUPP_MONTH, adjusted, full, lead, r, ref, with_bars
from barloom.sources.bars import adjust, bars_supp_month

SQL = (
    with_bars(
        SUPP_MONTH,
        adjusted(),
        f"f AS (SELECT *, cf / {ref('cf', 20)} - 1.0 AS ret20, {full('stddev_samp', 'r', 20)} AS vol20, "
        f"{lead('cf', 5)} / cf - 1.0 AS fwd5 FROM adj)",
        "s AS (SELECT *, -ret20 / nullif(vol20, 0) AS raw FROM f)",
        "k AS (SELECT * FROM s WHERE raw IS NOT NULL)",
        "p AS (SELECT *, (rank() OVER (PARTITION BY d ORDER BY raw) - 1 + (count(*) OVER (PARTITION BY d, raw) + 1) "
        "/ 2.0) / count(*) OVER (PARTITION BY d) AS score FROM k)",
        "t AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, sym) AS rn FROM p)",
        "u AS (SELECT d, avg(fwd5) AS all5, count(*) AS members FROM t GROUP BY d)",
    )
    + f"""SELECT CAST(t.d AS VARCHAR) AS d, t.sym, CAST(t.rn AS BIGINT) AS place, {r('t.score')} AS score,
 {r('t.fwd5')} AS fwd5, {r('u.all5')} AS universe5, {r('t.fwd5 - u.all5')} AS excess5, CAST(members AS BIGINT) AS members
FROM t JOIN u ON t.d = u.d WHERE t.rn <= 5"""
)


def reversal_scores(bars):
    adj = adjust(bars)
    feats = adj.withColumns(
        {
            "ret20": BARS.pct_change("cf", 20),
            "vol20": BARS.agg("std", "r", 20),
            "fwd5": sdiv(BARS.lead("cf", 5), "cf") - 1.0,
        }
    )
    raw = feats.select("sym", "d", "fwd5", sdiv(-F.col("ret20"), "vol20").alias("raw")).where("raw is not null")
    # Symbols per day, counted on the bars before any window: an upper bound for the ranked groups.
    return add_pct_rank(raw, ["d"], "raw", "score", group_rows=largest_group(bars, ["d"]))


@query("reversal_top5_vs_universe", "P1 W1 W3 W6 W30 T1 L4 A1", SQL)
def reversal_top5_vs_universe(spark, sf_dir):
    scored = reversal_scores(bars_supp_month(spark, sf_dir))
    universe = scored.groupBy("d").agg(F.avg("fwd5").alias("all5"), F.count(F.lit(1)).alias("members"))
    picks = top_k(scored, ["d"], [F.desc("score"), F.asc("sym")], 5, "place")
    return picks.join(universe, "d").select(
        F.col("d").cast("string").alias("d"),
        "sym",
        F.col("place").cast("long").alias("place"),
        rnd("score").alias("score"),
        rnd("fwd5").alias("fwd5"),
        rnd("all5").alias("universe5"),
        rnd(F.col("fwd5") - F.col("all5")).alias("excess5"),
        "members",
    )
