"""Features of one event from the bars at its anchors and at its signal row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import flag, sdiv
from barloom.operators.joins import with_roles


def c(name: str) -> Column:
    return F.col(name)


def sign_cycle(df: DataFrame, x: str, out: str) -> DataFrame:
    """Total length of the last two finished runs of equal sign of ``x``; zero and unknown keep the sign before."""
    sign = F.signum(c(x))
    held = F.last(F.when(sign != 0, sign), ignorenulls=True).over(B.past())
    df = df.withColumn("_s", held)
    fresh = F.when(c("_s").isNotNull() & ~c("_s").eqNullSafe(B.ref("_s", 1)), 1).otherwise(0)
    df = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(B.past()))
    runs = df.where("_s is not null").groupBy("sym", "_run").agg(F.count(F.lit(1)).alias("_len"))
    order = Window.partitionBy("sym").orderBy("_run")
    runs = runs.select("sym", "_run", (F.lag("_len", 1).over(order) + F.lag("_len", 2).over(order)).cast("double").alias(out))
    return df.join(runs, ["sym", "_run"], "left").drop("_s", "_fresh", "_run")


def negative_stretch(df: DataFrame, x: str, area: str, trough: str) -> DataFrame:
    """Sum and minimum of the latest stretch of x < 0 that has begun by the row, counted up to the row."""
    neg = F.coalesce(c(x) < 0, F.lit(False))
    df = df.withColumn("_neg", neg)
    begins = (c("_neg") & ~F.coalesce(B.ref("_neg", 1), F.lit(False))).cast("int")
    df = df.withColumn("_begin", begins).withColumn("_stretch", F.sum("_begin").over(B.past()))
    inside = Window.partitionBy("sym", "_stretch", "_neg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.struct(F.sum(x).over(inside).alias("a"), F.min(x).over(inside).alias("t"))
    df = df.withColumn("_part", F.when(c("_neg"), so_far))
    carried = F.last("_part", ignorenulls=True).over(B.past())
    df = df.withColumn("_part", carried)
    return df.withColumns({area: c("_part.a"), trough: c("_part.t")}).drop("_neg", "_begin", "_stretch", "_part")


def event_features(events: DataFrame, panel: DataFrame) -> DataFrame:
    """Seventeen features of (sym, sig_pos, prev_pos, low_pos) events.

    ``panel`` is the prepared symbol panel with ``cycle``, ``area``, ``trough``, ``golden`` and ``lower_adj``.
    """
    columns = ["ac", "ao", "al", "dif", "dea", "rsi14", "atr14", "atrp", "hammer", "lower_adj", "cycle", "area", "trough", "golden", "recent_golden"]
    ev = events.withColumns({"i1": c("prev_pos"), "i2": c("low_pos"), "t": c("sig_pos")})
    side = panel.withColumn("pos", c("pos").cast("long"))
    wide = with_roles(ev, side, {"i1": "i1", "i2": "i2", "t": "t"}, columns)
    trailing = Window.partitionBy("sym").orderBy("sig_pos").rangeBetween(-119, 0)
    a = c("t_atr14")
    span = (c("i2") - c("i1")).cast("double")
    rose = (c("i2_al") < c("i1_al")) & (c("i2_rsi14") > c("i1_rsi14"))
    return wide.select(
        *events.columns,
        F.when(c("i1_rsi14").isNotNull() & c("i2_rsi14").isNotNull(), rose.cast("double")).alias("RSI_DIV"),
        F.count(F.lit(1)).over(trailing).cast("double").alias("DIV_COUNT_120"),
        sdiv(c("t_ac") - c("i2_al"), a).alias("REBOUND_FROM_L2"),
        (sdiv("i2_al", "i1_al") - 1.0).alias("DIV_PRICE_NEWLOW_DEPTH"),
        sdiv(c("i2_dif") - c("i1_dif"), a).alias("DIV_DIF_LIFT"),
        span.alias("DIV_SPAN_BARS"),
        (c("t") - c("i2")).cast("double").alias("DAYS_SINCE_L2"),
        sdiv(span, "t_cycle").alias("DIV_SPAN_VS_CYCLE"),
        sdiv(sdiv(c("i2_dif") - c("i1_dif"), span), a).alias("DIV_DIF_SLOPE"),
        F.when(c("t_dea").isNotNull(), sdiv(F.greatest("t_dif", "t_dea"), c("t_ac") * c("t_atrp"))).alias("DIV_ZERO_AXIS_DEPTH"),
        sdiv("i1_dif", c("i1_ac") * c("i1_atrp")).alias("DIV_DIF_LEVEL_L1"),
        sdiv(c("t_ac") - c("t_ao"), a).alias("REBOUND_DAY_T"),
        c("i2_hammer").alias("HAMMER_L2"),
        sdiv("i2_lower_adj", "i2_atr14").alias("LOWER_SHADOW_L2"),
        sdiv("i2_area", "i1_area").alias("DIV_HIST_AREA_SHRINK"),
        sdiv("i2_trough", "i1_trough").alias("DIV_HIST_TROUGH_SHRINK"),
        F.when(c("t_dif").isNotNull() & c("t_dea").isNotNull(), F.when(c("t_golden"), 2.0).when(c("t_recent_golden") > 0, 1.0).otherwise(0.0)).alias("DIV_GOLDEN_CROSS_STATE"),
    )


def event_panel(prepared: DataFrame) -> DataFrame:
    """Extra series the event features read, on top of the prepared symbol panel."""
    from barloom.operators.events import cross_flags

    out = cross_flags(prepared)
    out = out.withColumns(
        {
            "recent_golden": F.max(c("golden").cast("int")).over(B.rows(-5, -1)),
            "lower_adj": c("lower_shadow") * sdiv("cf", "close"),
        }
    )
    return negative_stretch(sign_cycle(out, "dif", "cycle"), "hist", "area", "trough")


# ---------------------------------------------------------------- ranking factors
def ranking_factors(events: DataFrame, bars: DataFrame) -> DataFrame:
    """f1..f12 of cross divergences (and f13 where a previous anchor exists)."""
    at = bars.select(
        "sym", c("pos").cast("long").alias("sig_pos"), c("close").alias("c"), c("vol").alias("v"), c("amount").alias("a"),
        B.agg("min", "close", 250).alias("lo250"), B.agg("max", "close", 250).alias("hi250"),
        F.collect_list("close").over(B.last(61)).alias("last61"), B.ref("close", 20).alias("c20"),
        F.when(F.count("vol").over(B.rows(-20, -1)) == 20, F.avg("vol").over(B.rows(-20, -1))).alias("v20"),
        B.agg("std", "pc1", 20).alias("vol20"),
    )
    ev = events.join(at, ["sym", "sig_pos"])
    back = (c("sig_pos") - c("anchor_pos")).cast("int")
    upto = F.size("last61") - back
    run_up = F.slice("last61", F.lit(1), F.greatest(upto, F.lit(0)))
    cols = {
        "f1": c("dif_lift"), "f2": c("cross_dif"), "f3": sdiv("cross_dif", "c"), "f4": (c("sig_pos") - c("prev_cross_pos")).cast("double"),
        "f5": back.cast("double"), "f6": sdiv("c", "anchor_close") - 1.0,
        "f7": F.when(c("hi250") > c("lo250"), (c("anchor_close") - c("lo250")) / (c("hi250") - c("lo250"))),
        "f8": sdiv("anchor_close", F.array_max(run_up)) - 1.0, "f9": sdiv("c", "c20") - 1.0, "f10": F.when(c("v20") > 0, c("v") / c("v20")),
        "f11": c("vol20"), "f12": c("a").cast("double"),
    }
    if "prev_anchor_close" in events.columns:
        cols["f13"] = sdiv("anchor_close", "prev_anchor_close") - 1.0
    return ev.select(*events.columns, *[e.alias(n) for n, e in cols.items()])


def recognizer_factors(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Position of the event close in its last 120/60 rows, rebound from the anchor, cross height and lift; dd20, bounce."""
    at = bars.select(
        "sym", c("pos").cast("long").alias("sig_pos"),
        (c("close") / F.max("close").over(B.last(120)) - 1.0).alias("g1"), (c("close") / F.min("close").over(B.last(60)) - 1.0).alias("g2"),
        (c("close") / F.min("close").over(B.last(120)) - 1.0).alias("g3"), c("close").alias("_c"),
        (c("close") / F.max("close").over(B.last(21)) - 1.0).alias("dd20"),
    )
    out = events.join(at, ["sym", "sig_pos"])
    return out.withColumns({"g4": sdiv("_c", "anchor_close") - 1.0, "g5": c("cross_dif"), "g6": c("dif_lift"), "bounce": sdiv("_c", "anchor_close") - 1.0}).drop("_c")


def seed_flags(df: DataFrame) -> DataFrame:
    """Selections by drawdown and bounce; unknown values select nothing."""
    dd, bo = c("dd20"), c("bounce")
    near = (bo > 0.02) & (bo <= 0.08)
    rules = {"S1": (dd <= -0.15) & near, "S2": (dd <= -0.20) & near, "S3": (dd <= -0.25) & near, "S4": dd <= -0.15, "S5": dd <= -0.25}
    return df.withColumns({**{f"sel_{n}": flag(F.coalesce(e, F.lit(False))) for n, e in rules.items()}, "sel_ALL": F.lit(1.0)})
