"""Features that combine bars with side tables: turnover, valuation, limits, industry, market mood, style, status.

Panel columns expected: sym, d, open, high, low, close, pre_close, pct (percent), amount, pos, cf, turnover,
volume_ratio, pb, pe, dv, free_share, circ_mv, up_limit, down_limit, status, ind, cal_pos, age, mkt_ret.
Windows with ``min_periods`` follow the table: 20/21 rows need 15, 252 need 126, 500 need 250, 750 need 250,
250-row moments need 126, 60-row residuals need 45, 5-row smoothing needs 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.features.market import DAYS
from barloom.functions.rolling import BARS as B
from barloom.functions.rolling import Layout
from barloom.functions.scalar import positive, safe_log, safe_log1p, sdiv
from barloom.operators.cross_section import add_pct_rank, group_z, largest_group
from barloom.operators.joins import neighbour_day

INDUSTRY = Layout(keys=("ind",), order="d")
MIN_AGE = 5


def c(name: str) -> Column:
    return F.col(name)


def turnover_valuation(panel: DataFrame) -> DataFrame:
    """Turnover levels, liquidity, size, book yield against the industry, earnings yield rank, dividend yield."""
    m21, m252 = B.agg("mean", "turnover", 21, 15), B.agg("mean", "turnover", 252, 126)
    amihud = F.when(c("turnover").isNotNull() & c("pct").isNotNull(), F.abs("pct") / F.greatest(c("turnover"), F.lit(0.01)))
    panel = panel.withColumns({"_amihud": amihud, "_bp": sdiv(F.lit(1.0), positive("pb")), "_ep": sdiv(F.lit(1.0), positive("pe"))})
    panel = panel.withColumns(
        {
            "TURN_F20": B.agg("mean", "turnover", 20, 15),
            "STR20": B.agg("std", "turnover", 20, 15),
            "ABN_TURN_21_252": F.when(m252 > 0, safe_log(sdiv(m21, m252))),
            "VOLUME_RATIO_T": c("volume_ratio"),
            "VOLUME_RATIO_MA5": B.agg("mean", "volume_ratio", 5, 3),
            "AMIHUD_TURN20": B.agg("mean", "_amihud", 20, 15),
            "LN_FREE_MV": F.coalesce(safe_log(c("close") * c("free_share")), safe_log("circ_mv")),
            "EP_TSRANK_500": B.ts_rank_known("_ep", 500, 250),
            "DV_TTM": F.coalesce("dv", F.lit(0.0)),
        }
    )
    return group_z(panel, ["d", "ind"], "_bp", "BP_IND_Z", 10).drop("_amihud", "_bp", "_ep")


def industry_days(panel: DataFrame) -> DataFrame:
    """(d, ind) table: mean return, 20-day momentum, share above the 60-row mean, share near the 120-row low.

    A symbol's own windows run over its rows with a known industry; fewer than five members give NULL.
    """
    own = panel.where("ind is not null").withColumns({"_ma60": B.agg("mean", "cf", 60), "_min120": B.agg("min", "cf", 120)})
    own = own.withColumns(
        {"_above": (c("cf") > c("_ma60")).cast("double"), "_near": (c("cf") <= c("_min120") * 1.02).cast("double")}
    )

    def enough(x: str) -> Column:
        return F.when(F.count(x) >= 5, F.avg(x))

    days = own.groupBy("d", "ind").agg(
        enough("pct").alias("ind_ret"), enough("_above").alias("IND_BREADTH_MA60"), enough("_near").alias("IND_CAPIT_PCT120")
    )
    days = days.withColumn("_log", safe_log1p(c("ind_ret") / 100.0))
    total = F.sum("_log").over(INDUSTRY.last(20))
    known = F.count("ind_ret").over(INDUSTRY.last(20))
    return days.withColumn("IND_MOM20_EQW", F.when(known >= 15, (F.exp(total) - 1.0) * 100.0)).drop("_log")


def excess_and_residual(panel: DataFrame, splice_day: str) -> DataFrame:
    """20-row return over the industry's, and the sum of residual returns over rows t-64 .. t-5 with its source marks.

    ``panel`` already carries the industry table's columns. ``splice_day`` is when the market series changes source.
    """
    log_ret = safe_log1p(c("pct") / 100.0)
    known = c("mkt_ret").isNotNull()
    panel = panel.withColumns(
        {
            "_log": log_ret,
            "_resid": F.when(known, c("pct") - c("mkt_ret") - F.coalesce("ind_ret", F.lit(0.0))),
            "_indna": F.when(known, c("ind_ret").isNull().cast("double")),
            "_src": F.when(known, (c("d") >= F.lit(splice_day).cast("date")).cast("double")),
        }
    )
    ret20 = F.when(F.count("pct").over(B.last(20)) >= 15, (F.exp(F.sum("_log").over(B.last(20))) - 1.0) * 100.0)
    panel = panel.withColumns(
        {
            "IND_EXCESS_RET20": ret20 - c("IND_MOM20_EQW"),
            "_s60": B.agg("sum", "_resid", 60, 45), "_na60": B.agg("max", "_indna", 60, 45),
            "_share": sdiv(B.agg("sum", "_src", 60, 45), B.agg("count", "_src", 60, 45).cast("double")),
        }
    )
    resid, share = B.ref("_s60", 5), B.ref("_share", 5)
    panel = panel.withColumns({"RESID_MOM60": resid, "_share5": share, "_na5": B.ref("_na60", 5)})
    mixed = F.when(c("_share5") >= 1.0, 2.0).when(c("_share5") <= 0.0, 0.0).otherwise(1.0)
    known_resid = c("RESID_MOM60").isNotNull()
    return panel.withColumns(
        {"RESID_MOM60_MKSRC": F.when(known_resid, mixed), "RESID_MOM60_INDNA": F.when(known_resid, c("_na5"))}
    ).drop("_log", "_resid", "_indna", "_src", "_s60", "_na60", "_share", "_share5", "_na5")


def market_days(panel: DataFrame, calendar: DataFrame, limit_era: str, min_touch: int = 10) -> DataFrame:
    """One row per calendar day: sealing, promotion, down-limit pressure, premium, new highs and lows, turnover rank.

    ``panel`` carries the limit flags. The status of the day before is the previous *calendar* day's row.
    """
    traded = panel.where(c("age") >= MIN_AGE).select(
        "sym", "d", "cal_pos", "pct", "amount", "circ_mv", "turnover", "sealed", "touched", "down_sealed", "consec_limitup", "cf"
    )
    traded = neighbour_day(traded, calendar, ["consec_limitup", "sealed"], -1, "prev_")
    daily = traded.groupBy("d").agg(
        F.count_if(c("sealed") == 1).alias("n_sealed"), F.count_if(c("touched") == 1).alias("n_touch"), F.count_if(c("down_sealed") == 1).alias("n_down"),
        sdiv(F.sum("amount"), positive(F.sum("circ_mv"))).alias("to_w"), F.avg("turnover").alias("mean_to"),
        F.count_if(c("prev_consec_limitup") >= 1).alias("promote_den"), F.count_if((c("prev_consec_limitup") >= 1) & (c("sealed") == 1)).alias("promote_num"),
        F.avg(F.when(c("prev_sealed") == 1, c("pct"))).alias("MKT_LIMITUP_PREM"),
    )
    # Highs and lows run over each symbol's rows once it counts as traded.
    high, low = B.agg("max", "cf", 250), B.agg("min", "cf", 250)
    extremes = traded.withColumns({"_nh": (c("cf") >= high).cast("double"), "_nl": (c("cf") <= low).cast("double")})
    extremes = extremes.groupBy("d").agg(F.coalesce(F.sum("_nh"), F.lit(0.0)).alias("n_nh"), F.coalesce(F.sum("_nl"), F.lit(0.0)).alias("n_nl"), F.count(F.lit(1)).alias("n_rows"))
    days = calendar.select("d").join(daily, "d", "left").join(extremes, "d", "left")
    era = c("d") >= F.lit(limit_era).cast("date")
    days = days.withColumns(
        {
            "MKT_SEAL_RATIO": F.when(era & (c("n_touch") >= min_touch), c("n_sealed") / c("n_touch")),
            "MKT_PROMOTE_RATE": F.when(era, sdiv(c("promote_num").cast("double"), c("promote_den").cast("double"))),
            "_down": F.when(era, c("n_down").cast("double")),
            "MKT_NH_NL_DIFF": sdiv(c("n_nh") - c("n_nl"), c("n_rows").cast("double")),
            "MKT_NH_NL_RATIO": sdiv("n_nh", c("n_nh") + c("n_nl")),
            "_to5": DAYS.agg("mean", "to_w", 5, 3), "_eq5": DAYS.agg("mean", "mean_to", 5, 3),
            "MKT_LIMITUP_PREM_MA5": DAYS.agg("mean", "MKT_LIMITUP_PREM", 5, 3),
        }
    )
    sd = DAYS.agg("std", "_down", 250, 126)
    return days.select(
        "d", "MKT_SEAL_RATIO", "MKT_PROMOTE_RATE", sdiv(c("_down") - DAYS.agg("mean", "_down", 250, 126), positive(sd)).alias("MKT_DOWNLIMIT_Z"),
        "MKT_LIMITUP_PREM", "MKT_LIMITUP_PREM_MA5", "MKT_NH_NL_DIFF", "MKT_NH_NL_RATIO",
        DAYS.ts_rank_known("_to5", 750, 250).alias("MKT_TURNOVER_PCTL"), DAYS.ts_rank_known("_eq5", 750, 250).alias("MKT_TURNOVER_PCTL_EQW"),
    )


def style_strength(base: DataFrame, others: dict[str, DataFrame], lag: int = 59) -> DataFrame:
    """Log return of other indices over ``lag`` rows minus the base index's."""
    def logret(ix: DataFrame, name: str) -> DataFrame:
        return ix.select("d", F.log(sdiv("close", DAYS.ref("close", lag))).alias(name))

    out = logret(base, "_base")
    for name, ix in others.items():
        out = out.join(logret(ix, f"_{name}"), "d", "left")
    return out.select("d", *[(c(f"_{n}") - c("_base")).alias(n) for n in others])


def listing(panel: DataFrame, par: float = 1.0) -> DataFrame:
    """Status, distance of the price to par, days below par, listing age."""
    below = F.when(c("close").isNotNull(), (c("close") < par).cast("double"))
    panel = panel.withColumn("_below", below)
    return panel.withColumns(
        {
            "ST_STATUS": c("status"), "PAR_VALUE_GAP": safe_log("close"), "DAYS_BELOW_PAR": B.streak_known("_below"),
            "LIST_AGE": F.when(c("age") >= 0, F.log1p(c("age").cast("double"))),
        }
    ).drop("_below")


def second_set(panel: DataFrame) -> DataFrame:
    """Plain 20/60-row variants: mean and spread of turnover, abnormal turnover, float value, mood, relative strength rank."""
    t5, t20, t60 = (B.agg("mean", "turnover", w) for w in (5, 20, 60))
    up = F.avg(F.when(c("pct") > 0, c("turnover"))).over(B.last(20))
    dn = F.avg(F.when(c("pct") < 0, c("turnover"))).over(B.last(20))
    return panel.withColumns(
        {
            "TURN20": t20, "ABTURN_5_60": sdiv(t5, t60) - 1.0, "STDTURN20": B.agg("std", "turnover", 20), "FLOAT_MCAP": safe_log("circ_mv"),
            "RETAIL_SENT": sdiv(up, dn) - 1.0, "RET20": B.pct_change("cf", 20), "MA20_ABOVE": (c("cf") > B.agg("mean", "cf", 20)).cast("double"),
            "RET5": B.pct_change("cf", 5), "ST_FLAG": (c("status") >= 1).cast("double"),
        }
    )


def second_set_industry(panel: DataFrame) -> DataFrame:
    """Industry momentum, breadth and the day's rank of the industry; relative strength of the symbol."""
    marked = second_set(panel)
    days = marked.where("ind is not null").groupBy("d", "ind").agg(
        F.avg("RET20").alias("IND_MOM20"), F.avg("MA20_ABOVE").alias("IND_BREADTH_MA20"), F.avg("RET5").alias("_r5")
    )
    # Industries per day: a number of industries, not of symbols.
    rows = largest_group(panel.select("d", "ind").distinct(), ["d"])
    days = add_pct_rank(days, ["d"], "IND_MOM20", "IND_RS_RANK", group_rows=rows)
    days = add_pct_rank(days, ["d"], "_r5", "IND_RET5_RANK", group_rows=rows).drop("_r5")
    out = marked.join(days, ["d", "ind"], "left")
    return out.withColumn("IND_REL_STR", c("RET20") - c("IND_MOM20"))
