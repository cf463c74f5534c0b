"""Pattern events on one symbol's series: lows, crosses, divergences, confirmations.

Positions are 1-based row numbers of the symbol (column ``pos``). Every event carries the row on which it
becomes known (``sig_pos``); values at that row never need later rows, except the truth lows, which are labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS, Layout
from barloom.functions.scalar import sdiv
from barloom.operators.joins import as_of

# Fixed values of the detectors.
MIN_DIF_LIFT = 0.001
LEFT_ROWS, RIGHT_ROWS, LOW_SPACING = 3, 2, 3


def _series(key: str = "sym") -> Window:
    return Window.partitionBy(key).orderBy("pos")


# ---------------------------------------------------------------- lows
def fractal_lows(bars: DataFrame, price: str, order: int, layout: Layout = BARS) -> DataFrame:
    """(sym, low_pos, sig_pos): strict minimum of ``order`` rows on both sides, known ``order`` rows later."""
    left, right = layout.rows(-order, -1), layout.rows(1, order)
    p = F.col(price)
    strict = (
        (F.count(p).over(left) == order) & (F.count(p).over(right) == order)
        & (p < F.min(p).over(left)) & (p < F.min(p).over(right))
    )
    return (
        bars.withColumn("_low", strict)
        .where("_low")
        .select("sym", F.col("pos").cast("long").alias("low_pos"), (F.col("pos") + order).cast("long").alias("sig_pos"))
    )


def v_low_flag(price: str = "close", layout: Layout = BARS) -> Column:
    """Not above any of 3 rows before and below both rows after."""
    left, right = layout.rows(-LEFT_ROWS, -1), layout.rows(1, RIGHT_ROWS)
    p = F.col(price)
    return F.coalesce(
        (F.count(p).over(left) == LEFT_ROWS) & (F.count(p).over(right) == RIGHT_ROWS)
        & (p <= F.min(p).over(left)) & (p < F.min(p).over(right)),
        F.lit(False),
    )


def truth_lows(bars: DataFrame, half: int, price: str = "close", layout: Layout = BARS) -> DataFrame:
    """Rows that are the minimum of +-half rows and below everything before; looks ahead on purpose (a label)."""
    left, right = layout.rows(-half, -1), layout.rows(1, half)
    p = F.col(price)
    hit = (
        (F.count(p).over(left) == half) & (F.count(p).over(right) == half)
        & (p < F.min(p).over(left)) & (p <= F.min(p).over(right))
    )
    return bars.withColumn("_low", hit).where("_low").select("sym", F.col("pos").cast("long").alias("low_pos"), "d", F.col(price).alias("low_price"))


def _keep_spaced(points: Column, gap: int, place: str) -> Column:
    """Fold over points in order, keeping one if it is ``gap`` or more after the last kept."""
    empty = F.filter(points, lambda _: F.lit(False))
    return F.aggregate(
        points,
        empty,
        lambda kept, p: F.when(
            (F.size(kept) == 0) | (p[place] - F.element_at(kept, -1)[place] >= gap), F.concat(kept, F.array(p))
        ).otherwise(kept),
    )


def min_separation(lows: DataFrame, gap: int, key: str = "sym", place: str = "low_pos") -> DataFrame:
    """Greedy spacing in time order. The fold holds one symbol's lows, far fewer than its bars."""
    if gap <= 1:
        return lows
    others = [c for c in lows.columns if c not in (key, place)]
    point = F.struct(F.col(place), *[F.col(c) for c in others])
    kept = lows.groupBy(key).agg(_keep_spaced(F.array_sort(F.collect_list(point)), gap, place).alias("_kept"))
    return kept.select(key, F.explode("_kept").alias("_p")).select(key, "_p.*").select(*lows.columns)


def v_shape_lows(bars: DataFrame, price: str = "close") -> DataFrame:
    """V-shaped lows (3 left, 2 right) at least 3 rows apart, known 2 rows later."""
    flagged = bars.withColumn("_low", v_low_flag(price)).where("_low")
    points = flagged.select("sym", F.col("pos").cast("long").alias("low_pos"), (F.col("pos") + RIGHT_ROWS).cast("long").alias("sig_pos"))
    return min_separation(points, LOW_SPACING)


def grid_lows(bars: DataFrame, price: str = "close", size: int = 6, step: int = 3, full_only: bool = False) -> DataFrame:
    """Minimum of each window of a fixed grid (starts 0, 3, 6, ...), earliest on ties, each low once.

    ``avail_pos`` is the last row of the first window that shows the low. With ``full_only`` windows cut off by
    the end of the series are left out.
    """
    zero = F.col("pos") - 1
    slots = F.array(*[F.floor(zero / step) - i for i in range(size // step)])
    placed = bars.select("sym", "pos", price, F.explode(slots).alias("slot")).where("slot >= 0")
    best = placed.groupBy("sym", "slot").agg(
        F.min(F.struct(F.col(price), F.col("pos"))).getField("pos").alias("low_pos"), F.count(F.lit(1)).alias("rows")
    )
    if full_only:
        best = best.where(F.col("rows") == size)
    return best.groupBy("sym", F.col("low_pos").cast("long").alias("low_pos")).agg(
        (F.min("slot") * step + size).cast("long").alias("avail_pos")
    )


# ---------------------------------------------------------------- crosses
def cross_flags(df: DataFrame, fast: str = "dif", slow: str = "dea", layout: Layout = BARS) -> DataFrame:
    """golden, death and zero-line crosses of ``fast``; a cross needs known values on both rows."""
    pf, ps = layout.ref(fast, 1), layout.ref(slow, 1)
    f, s = F.col(fast), F.col(slow)
    no = F.lit(False)
    return df.withColumns(
        {
            "golden": F.coalesce((pf <= ps) & (f > s), no),
            "death": F.coalesce((pf >= ps) & (f < s), no),
            "zero_up": F.coalesce((pf <= 0) & (f > 0), no),
            "zero_down": F.coalesce((pf >= 0) & (f < 0), no),
        }
    )


def cross_intervals(df: DataFrame) -> DataFrame:
    """Add ``leg``: golden crosses before the row, so a leg is left-open and right-closed at its cross."""
    return df.withColumn("leg", F.coalesce(F.sum(F.col("golden").cast("long")).over(BARS.before()), F.lit(0)))


def leg_table(df: DataFrame) -> DataFrame:
    """One row per (sym, leg): its cheapest row (earliest on ties), closing cross position and dif there."""
    cheapest = F.min(F.struct(F.col("close").alias("price"), F.col("pos").alias("pos")))
    closing = F.col("golden")
    return cross_intervals(df).groupBy("sym", "leg").agg(
        cheapest.alias("low"),
        F.max(F.when(closing, F.col("pos"))).alias("cross_pos"),
        F.max(F.when(closing, F.col("dif"))).alias("cross_dif"),
    )


def cross_divergence_simple(df: DataFrame, lift: float = MIN_DIF_LIFT) -> DataFrame:
    """Higher dif at the new cross while the leg made a lower low than the leg before."""
    legs = Window.partitionBy("sym").orderBy("leg")
    table = leg_table(df).withColumns(
        {
            "prev_low": F.lag("low").over(legs),
            "prev_cross_pos": F.lag("cross_pos").over(legs),
            "prev_cross_dif": F.lag("cross_dif").over(legs),
        }
    )
    found = table.where(
        (F.col("leg") >= 2) & F.col("cross_pos").isNotNull()
        & (F.col("cross_dif") - F.col("prev_cross_dif") >= lift)
        & (F.col("low.price") < F.col("prev_low.price"))
    )
    return found.select(
        "sym", F.col("cross_pos").alias("sig_pos"), F.col("low.pos").alias("anchor_pos"), F.col("low.price").alias("anchor_close"),
        "prev_cross_pos", "prev_cross_dif", "cross_pos", "cross_dif",
        (F.col("cross_dif") - F.col("prev_cross_dif")).alias("dif_lift"),
    )


def cross_windows(df: DataFrame, after: int = 5) -> DataFrame:
    """Rows of every window (previous cross, cross + after], tagged with the cross number ``k``.

    A row lies in the window of its own leg and of the crosses at most ``after`` rows back. Crosses are two rows apart
    at least, so those are ``(after + 1) // 2``; rows are repeated and joined on (sym, k), nothing is compared pairwise.
    """
    span = (after + 1) // 2
    legs = leg_table(df).where("cross_pos is not null").select(
        "sym", (F.col("leg") + 1).alias("k"), "cross_pos", "cross_dif"
    )
    order = Window.partitionBy("sym").orderBy("k")
    legs = legs.withColumns({"prev_cross_pos": F.lag("cross_pos").over(order), "prev_cross_dif": F.lag("cross_dif").over(order)})
    rows = cross_intervals(df.withColumn("is_low", v_low_flag())).select(
        "sym", "pos", "close", "is_low", F.explode(F.array(*[F.col("leg") + 1 - i for i in range(span + 1)])).alias("k")
    )
    inside = (F.col("pos") > F.col("prev_cross_pos")) & (F.col("pos") <= F.col("cross_pos") + after)
    return rows.join(legs, ["sym", "k"]).where(inside)


def confirmed_anchors(df: DataFrame, after: int = 5) -> DataFrame:
    """(sym, k, anchor): lowest spaced V-low of the window, else the lowest row; earliest on ties."""
    point = F.struct(F.col("pos").alias("pos"), F.col("close").alias("close"))
    grouped = cross_windows(df, after).groupBy("sym", "k").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_low"), point))).alias("_points"),
        F.min(F.struct(F.col("close"), F.col("pos"))).alias("_lowest"),
        *[F.first(c).alias(c) for c in ("cross_pos", "cross_dif", "prev_cross_pos", "prev_cross_dif")],
    )
    kept = _keep_spaced(F.col("_points"), LOW_SPACING, "pos")
    best = F.array_min(F.transform(kept, lambda p: F.struct(p["close"].alias("close"), p["pos"].alias("pos"))))
    return grouped.withColumn("_kept", kept).withColumn("anchor", F.coalesce(best, F.col("_lowest"))).drop("_points")


def cross_divergence_confirmed(df: DataFrame, lift: float = MIN_DIF_LIFT) -> DataFrame:
    """Same lift, but lows are confirmed V-lows; the event waits for the cross and the low's confirmation."""
    order = Window.partitionBy("sym").orderBy("k")
    table = confirmed_anchors(df).withColumn("prev_anchor", F.lag("anchor").over(order))
    ends = df.groupBy("sym").agg(F.max("pos").alias("_n"))
    found = table.join(ends, "sym").where(
        (F.col("k") >= 3)
        & (F.col("cross_dif") - F.col("prev_cross_dif") >= lift)
        & (F.col("anchor.close") < F.col("prev_anchor.close"))
        & (F.col("anchor.pos") + RIGHT_ROWS <= F.col("_n"))
    )
    return found.select(
        "sym", F.greatest(F.col("cross_pos"), F.col("anchor.pos") + RIGHT_ROWS).alias("sig_pos"),
        F.col("anchor.pos").alias("anchor_pos"), F.col("anchor.close").alias("anchor_close"), "prev_cross_pos", "prev_cross_dif",
        "cross_pos", "cross_dif", (F.col("cross_dif") - F.col("prev_cross_dif")).alias("dif_lift"),
        F.col("prev_anchor.pos").alias("prev_anchor_pos"), F.col("prev_anchor.close").alias("prev_anchor_close"),
    )


# ---------------------------------------------------------------- the day before a cross
FAST_KEEP, SLOW_KEEP = 11.0 / 13.0, 25.0 / 27.0
DIF_PER_PRICE = 2.0 / 13.0 - 2.0 / 27.0


def cross_price() -> Column:
    """Next close at which dif would equal today's dea, from the two inner averages."""
    carried = F.col("e12") * FAST_KEEP - F.col("e26") * SLOW_KEEP
    return (F.col("dea") - carried) / DIF_PER_PRICE


def eve_candidates(df: DataFrame, lift: float = MIN_DIF_LIFT) -> DataFrame:
    """Rows on which a cross the next day would make a divergence; ``variant`` v1 or v2.

    v1 compares the cheapest rows of the running and the previous leg. v2 compares anchors known by the row:
    kept V-lows confirmed by then, else the cheapest row so far.
    """
    panel = cross_intervals(df.withColumns({"is_low": v_low_flag(), "next_pos": BARS.lead("pos", 1)}))
    leg_rows = Window.partitionBy("sym", "leg").orderBy("pos")
    so_far = leg_rows.rowsBetween(Window.unboundedPreceding, 0)
    cheap = F.struct(F.col("close").alias("close"), F.col("pos").alias("pos"))
    panel = panel.withColumns(
        {
            "c_star": cross_price(),
            "run_low": F.min(cheap).over(so_far),
            "early_low": F.min(F.when(F.row_number().over(leg_rows) <= 5, cheap)).over(so_far),
        }
    )
    # Kept V-lows of the current leg known so far: greedy spacing restarts at each cross and is prefix stable.
    own = panel.where("is_low").groupBy("sym", "leg").agg(F.array_sort(F.collect_list(F.struct("pos", "close"))).alias("_own"))
    own = own.select("sym", "leg", _keep_spaced(F.col("_own"), LOW_SPACING, "pos").alias("own_lows"))
    # State of the last two crosses: leg j (>= 2 closed crosses) starts at cross j.
    legs = leg_table(df)
    order = Window.partitionBy("sym").orderBy("leg")
    prior = confirmed_anchors(df).select("sym", F.col("k").alias("leg"), F.col("_kept").alias("prior_lows"))
    starts = legs.withColumns(
        {
            "c1": F.lag("cross_pos").over(order), "c1_dif": F.lag("cross_dif").over(order),
            "c2": F.lag("cross_pos", 2).over(order), "prev_low": F.lag("low").over(order),
        }
    ).select("sym", "leg", "c1", "c1_dif", "c2", "prev_low")
    rows = panel.where("dif <= dea and next_pos is not null and leg >= 2").join(starts, ["sym", "leg"])
    rows = rows.where(F.col("dea") - F.col("c1_dif") >= lift)
    rows = rows.join(own, ["sym", "leg"], "left").join(prior, ["sym", "leg"], "left")
    t = F.col("pos")

    def cheapest(points: str, upto: Column) -> Column:
        seen = F.filter(points, lambda p: (p["pos"] + RIGHT_ROWS <= t) & (p["pos"] <= upto))
        return F.array_min(F.transform(seen, lambda p: F.struct(p["close"].alias("close"), p["pos"].alias("pos"))))

    prev_cheap = F.struct(F.col("prev_low.price").alias("close"), F.col("prev_low.pos").alias("pos"))
    rows = rows.withColumns(
        {
            "a_cur": F.coalesce(cheapest("own_lows", t), F.col("run_low")),
            "a_prev": F.coalesce(
                cheapest("prior_lows", F.least(F.col("c1") + 5, t)),
                F.array_min(F.array(prev_cheap, F.col("early_low"))),
            ),
        }
    )
    base = [
        "sym", t.alias("eve_pos"), F.col("next_pos").alias("target_pos"), F.col("close").alias("eve_close"), "c_star",
        (F.col("c_star") / F.col("close") - 1.0).alias("margin_ratio"), F.col("dea").alias("dif_star"),
        (F.col("dea") - F.col("c1_dif")).alias("dif_lift_star"), F.col("c1").alias("cross1_pos"), F.col("c2").alias("cross2_pos"),
    ]
    v1 = rows.where(F.col("run_low.close") < F.col("prev_low.price")).select(
        F.lit("v1").alias("variant"), *base, F.col("run_low.pos").alias("anchor_pos"), F.col("prev_low.pos").alias("anchor_prev_pos")
    )
    v2 = rows.where(F.col("a_cur.close") < F.col("a_prev.close")).select(
        F.lit("v2").alias("variant"), *base, F.col("a_cur.pos").alias("anchor_pos"), F.col("a_prev.pos").alias("anchor_prev_pos")
    )
    return v1.unionByName(v2)


# ---------------------------------------------------------------- early events inside a leg
def early_events(df: DataFrame, steps: tuple[int, ...] = (1, 2, 3), lift: float = MIN_DIF_LIFT) -> DataFrame:
    """First rows of a leg on which dif has turned up for j rows from its running low, above the last cross's dif,
    while price has already undercut the previous leg. Two anchors per fire: b1 cheapest row, b2 confirmed low.
    """
    inc = F.coalesce(F.col("dif") > BARS.ref("dif", 1), F.lit(False))
    panel = cross_intervals(df.withColumns({"is_low": v_low_flag(), "up_run": BARS.streak(inc)}))
    leg_rows = Window.partitionBy("sym", "leg").orderBy("pos")
    so_far = leg_rows.rowsBetween(Window.unboundedPreceding, 0)
    cheap = F.min(F.struct(F.col("close").alias("close"), F.col("pos").alias("pos"))).over(so_far)
    weakest = F.min(F.struct(F.col("dif").alias("dif"), F.col("pos").alias("pos"))).over(so_far)
    panel = panel.withColumns({"cheap": cheap, "weakest": weakest})
    legs = leg_table(df)
    order = Window.partitionBy("sym").orderBy("leg")
    starts = legs.withColumns(
        {
            "c_prev": F.lag("cross_pos").over(order), "c_prev_dif": F.lag("cross_dif").over(order),
            "prev_low": F.lag("low.price").over(order),
        }
    ).select("sym", "leg", "c_prev", "c_prev_dif", "prev_low", F.col("cross_pos").alias("next_cross"), F.col("cross_dif").alias("next_dif"))
    rows = panel.where("leg >= 2 and not golden").join(starts, ["sym", "leg"])
    rows = rows.where(
        (F.col("weakest.dif") >= F.col("c_prev_dif") + lift) & (F.col("cheap.close") < F.col("prev_low"))
    )
    fires = rows.withColumn("j", F.explode(F.array(*[F.lit(j) for j in steps]))).where(
        (F.col("weakest.pos") == F.col("pos") - F.col("j")) & (F.col("up_run") >= F.col("j"))
    )
    first = Window.partitionBy("sym", "leg", "j").orderBy("pos")
    fires = fires.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    own = panel.where("is_low").groupBy("sym", "leg").agg(F.array_sort(F.collect_list(F.struct("pos", "close"))).alias("_own"))
    own = own.select("sym", "leg", _keep_spaced(F.col("_own"), LOW_SPACING, "pos").alias("lows"))
    ends = df.groupBy("sym").agg(F.max("pos").alias("_end"))
    fires = fires.join(own, ["sym", "leg"], "left").join(ends, "sym")
    known = F.filter("lows", lambda p: p["pos"] <= F.col("pos"))
    low = F.array_min(F.transform(known, lambda p: F.struct(p["close"].alias("close"), p["pos"].alias("pos"))))
    fires = fires.withColumn("anchor2", F.coalesce(low, F.col("cheap"))).withColumn("has_low", low.isNotNull())
    common = [
        "sym", "j", F.col("pos").alias("fire_pos"), F.col("weakest.pos").alias("tau_pos"), F.col("weakest.dif").alias("tau_dif"),
        F.col("c_prev").alias("cross_prev_pos"), "next_cross", (F.col("next_dif") - F.col("c_prev_dif")).alias("dif_lift_next"),
    ]
    b1 = fires.select(F.lit("b1").alias("flavor"), *common, F.col("pos").alias("sig_pos"), F.col("cheap.pos").alias("anchor_pos"),
                      F.col("cheap.close").alias("anchor_close"))
    sig2 = F.greatest(F.col("pos"), F.col("anchor2.pos") + RIGHT_ROWS)
    b2 = fires.where(sig2 <= F.col("_end")).select(
        F.lit("b2").alias("flavor"), *common, sig2.alias("sig_pos"), F.col("anchor2.pos").alias("anchor_pos"),
        F.col("anchor2.close").alias("anchor_close"),
    )
    return b1.unionByName(b2)


# ---------------------------------------------------------------- divergence between lows
@dataclass(frozen=True)
class DivergenceRule:
    """Settings of the low-to-low test; a configuration sweep is a list of these."""

    min_decline: float = 0.0
    min_change: float = 0.001
    lookback: int = 2
    below_zero: bool = False
    volume_ratio: float | None = None
    triple: bool = False
    warmup: int = 33


def divergences(bars: DataFrame, lows: DataFrame, rule: DivergenceRule, indicator: str = "dif") -> DataFrame:
    """Events (sym, sig_pos, low_pos, prev_pos, rank, formation): a lower low with a higher indicator.

    The nearest earlier low that satisfies the rule counts; with ``triple`` three lows must satisfy it in a row.
    """
    at_low = bars.select(
        "sym", F.col("pos").cast("long").alias("low_pos"), F.col("close").alias("c"), F.col(indicator).alias("m"), F.col("dif").alias("z"),
        F.col("vol").cast("double").alias("v"),
    )
    seq = lows.join(at_low, ["sym", "low_pos"])
    order = Window.partitionBy("sym").orderBy("low_pos")
    depth = 1 if rule.triple else rule.lookback
    point = F.struct("low_pos", "c", "m", "z", "v")
    seq = seq.withColumns({f"p{r}": F.lag(point, r).over(order) for r in range(1, depth + 1)})

    def holds(prev: str) -> Column:
        p = F.col(prev)
        ok = (F.col("c") < p["c"] * (1.0 - rule.min_decline)) & (F.col("m") > p["m"] + rule.min_change)
        if rule.below_zero:
            ok = ok & (F.col("z") < 0) & (p["z"] < 0)
        if rule.volume_ratio is not None:
            ok = ok & (F.col("v") < p["v"] * rule.volume_ratio)
        return F.coalesce(ok, F.lit(False))

    if rule.triple:
        seq = seq.withColumn("_pair", holds("p1"))
        seq = seq.withColumn("rank", F.when(F.col("_pair") & F.lag("_pair", 1, False).over(order), 1))
    else:
        rank = F.lit(None).cast("int")
        for r in range(depth, 0, -1):
            rank = F.when(holds(f"p{r}"), r).otherwise(rank)
        seq = seq.withColumn("rank", rank)
    prev = F.lit(None).cast("long")
    for r in range(1, depth + 1):
        prev = F.when(F.col("rank") == r, F.col(f"p{r}.low_pos")).otherwise(prev)
    hits = seq.withColumn("prev_pos", prev).where(F.col("rank").isNotNull() & (F.col("sig_pos") > rule.warmup))
    return hits.select(
        "sym", "sig_pos", "low_pos", "prev_pos", F.col("rank").cast("long").alias("rank"),
        (F.col("low_pos") - F.col("prev_pos")).alias("formation"),
    )


def pairwise_low_comparison(bars: DataFrame, lows: DataFrame, gap: int = 5, min_change: float = 0.001, key_macd: str = "dif") -> DataFrame:
    """Every low against its two predecessors (from the third low on); all ranks that diverge are kept."""
    at_low = bars.select(
        "sym", F.col("pos").cast("long").alias("low_pos"), "d", F.col("close").alias("close"), F.col(key_macd).alias("macd"), F.col("vol").cast("double").alias("volume")
    )
    seq = lows.select("sym", "low_pos").join(at_low, ["sym", "low_pos"])
    order = Window.partitionBy("sym").orderBy("low_pos")
    point = F.struct("low_pos", "d", "close", "macd", "volume")
    seq = seq.withColumns({"_n": F.row_number().over(order), "p1": F.lag(point, 1).over(order), "p2": F.lag(point, 2).over(order)})
    pairs = seq.where("_n >= 3").select(
        "sym", "low_pos", "d", "close", "macd", "volume",
        F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("p1").alias("p")), F.struct(F.lit(2).alias("rank"), F.col("p2").alias("p")))).alias("e"),
    ).select("*", "e.rank", "e.p")
    hit = (
        (F.col("low_pos") - F.col("p.low_pos") >= gap) & (F.col("close") < F.col("p.close"))
        & (F.col("macd") > F.col("p.macd") + min_change)
    )
    return describe_pairs(pairs.where(hit))


def describe_pairs(pairs: DataFrame) -> DataFrame:
    """Strength, volume signal and confirmation columns of a low pair."""
    decline = (F.col("close") - F.col("p.close")) / F.col("p.close")
    rise = F.coalesce(sdiv(F.col("macd") - F.col("p.macd"), F.abs(F.col("p.macd"))), F.lit(0.0))
    out = pairs.withColumns({"decline": decline, "rise": rise, "formation": F.col("low_pos") - F.col("p.low_pos")})
    floor = F.when(F.abs("decline") > 1e-6, F.col("decline")).otherwise(1e-6)
    return out.select(
        "sym", F.col("low_pos"), "d", F.col("p.low_pos").alias("prev_pos"), F.col("p.d").alias("prev_d"), F.col("rank").cast("long").alias("rank"),
        "decline", "rise", "formation",
        # The detector's own flag, and the wider one of the daily pipeline.
        (F.col("formation") < 3).cast("long").alias("is_quick"), (F.col("formation") <= 3).cast("long").alias("quick_pair"),
        (F.least(F.lit(1.0), F.abs("decline") / 0.1) * 0.4 + F.least(F.lit(1.0), F.col("rise") / 0.1) * 0.6).alias("strength"),
        F.when(F.col("volume") < F.col("p.volume"), "bullish").when(F.col("volume") > F.col("p.volume") * 1.5, "bearish").otherwise("neutral").alias("volume_signal"),
        F.abs(F.col("rise") / floor).alias("ratio"),
        ((F.abs("decline") + F.abs("rise")) / 2.0).alias("magnitude"),
        ((F.col("decline") < -0.02) & (F.col("rise") > 0.01)).cast("long").alias("confirmed"),
    )


def grid_divergences_causal(bars: DataFrame, min_rows: int = 100, gap: int = 5, min_change: float = 0.001) -> DataFrame:
    """What the grid detector would say on each day with rows up to that day only, for all days at once.

    Whether a row is a low of the cut grid depends on its phase; earlier lows are the two newest known ones,
    or the running low of the second last grid window.
    """
    zero = F.col("pos") - 1
    phase = F.pmod(zero, F.lit(3))
    price = F.col("close")
    back1, back2 = BARS.ref("close", 1), BARS.ref("close", 2)
    is_low = F.when(phase == 0, F.lit(True)).when(phase == 1, price < back1).otherwise(price < F.least(back1, back2))
    slot = F.floor(zero / 3)
    # The second last window starts one step before the row's own slot.
    lowest = F.struct(F.col("close").alias("price"), F.col("pos").alias("pos"))
    panel = bars.withColumns({"slot": slot, "cur": F.coalesce(is_low, F.lit(False))})
    in_slot = Window.partitionBy("sym", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = panel.groupBy("sym", F.col("slot").alias("slot")).agg(F.min(lowest).alias("slot_low"))
    prior = whole.select("sym", (F.col("slot") + 1).alias("slot"), F.col("slot_low").alias("prior_low"))
    panel = panel.withColumn("run_low", F.min(lowest).over(in_slot)).join(prior, ["sym", "slot"], "left")
    panel = panel.withColumn("q", F.when(F.col("prior_low").isNotNull(), F.array_min(F.array("prior_low", "run_low")).getField("pos")))
    lows = grid_lows(bars, full_only=True)
    order = Window.partitionBy("sym").orderBy("low_pos")
    lows = lows.withColumns({"l2": F.lag("low_pos", 1).over(order), "l3": F.lag("low_pos", 2).over(order)})
    known = lows.select("sym", F.col("avail_pos").alias("pos"), F.col("low_pos").alias("l1"), "l2", "l3")
    days = panel.where(F.col("cur") & (F.col("pos") >= min_rows)).withColumn("pos", F.col("pos").cast("long"))
    days = as_of(days, known, ["sym"], "pos", ["l1", "l2", "l3"], right_day="_seen")
    own = F.col("l1") == F.col("pos")
    earlier = F.array(
        F.when(own, F.col("l2")).otherwise(F.col("l1")), F.when(own, F.col("l3")).otherwise(F.col("l2")),
        F.when(F.col("q") < F.col("pos"), F.col("q").cast("long")),
    )
    ordered = F.sort_array(F.array_distinct(F.array_compact(earlier)), asc=False)
    days = days.withColumn("_prev", F.slice(ordered, 1, 2)).where(F.size("_prev") == 2)
    pairs = days.select("sym", "pos", "d", "close", "dif", F.posexplode("_prev").alias("_i", "prev_pos"))
    at = bars.select("sym", F.col("pos").cast("long").alias("prev_pos"), F.col("close").alias("_pc"), F.col("dif").alias("_pd"))
    hits = pairs.join(at, ["sym", "prev_pos"]).where(
        (F.col("pos") - F.col("prev_pos") >= gap) & (F.col("close") < F.col("_pc")) & (F.col("dif") > F.col("_pd") + min_change)
    )
    best = hits.groupBy("sym", "pos", "d").agg(F.min(F.struct("_i", "prev_pos")).alias("b"))
    return best.select("sym", F.col("pos").alias("sig_pos"), "d", (F.col("b._i") + 1).cast("long").alias("rank"), F.col("b.prev_pos").alias("prev_pos"))


# ---------------------------------------------------------------- event set operators
def drop_outside(events: DataFrame, wanted_regime: Column | None = None, above: Column | None = None) -> DataFrame:
    """Keep events in a market phase and/or above a long average."""
    out = events
    for cond in (wanted_regime, above):
        if cond is not None:
            out = out.where(cond)
    return out


def in_both(events: DataFrame, other: DataFrame, on: str = "sig", causal: bool = True) -> DataFrame:
    """Events also found by another run: same symbol and signal row, or same low with an earlier or equal signal."""
    if on == "sig":
        return events.join(other.select("sym", "sig_pos").distinct(), ["sym", "sig_pos"], "left_semi")
    first = other.groupBy("sym", "low_pos").agg(F.min("sig_pos").alias("_other"))
    out = events.join(first, ["sym", "low_pos"])
    if causal:
        out = out.where(F.col("_other") <= F.col("sig_pos"))
    return out.drop("_other")


def consensus(runs: dict[str, DataFrame], width: int = 1) -> DataFrame:
    """Clusters of events of several runs whose neighbours are at most ``width`` rows apart, with distinct runs."""
    tagged = None
    for name, run in runs.items():
        one = run.select("sym", F.col("sig_pos").alias("pos")).distinct().withColumn("run", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    order = Window.partitionBy("sym").orderBy("pos", "run")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(order) > width).cast("int"), F.lit(1))
    cluster = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = tagged.withColumn("_fresh", fresh).withColumn("cluster", cluster).groupBy("sym", "cluster")
    return grouped.agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("events")
    )


# ---------------------------------------------------------------- rejection rules
def reject_rules(df: DataFrame, down_limit: str = "down_limit", tol: float = 0.005) -> DataFrame:
    """r1 staircase of lower 20-row lows, r2 narrowing box with a break down, r3 shock within 60 rows."""
    low20 = BARS.agg("min", "close", 20)
    out = df.withColumn("_m", low20)
    stairs = [F.lag("_m", k).over(BARS.whole()) for k in (0, 20, 40, 60, 80, 100)]
    falls = sum(((stairs[i] < stairs[i + 1]).cast("int") for i in range(5)), F.lit(0))
    span = BARS.agg("max", "high", 20) - BARS.agg("min", "low", 20)
    shock = (F.coalesce(F.col("close") <= F.col(down_limit) + tol, F.lit(False))) | F.coalesce(
        sdiv("open", BARS.ref("close", 1)) - 1.0 <= -0.05, F.lit(False)
    )
    out = out.withColumns({"_falls": falls, "_span": span, "_shock": shock.cast("int")})
    narrow = F.col("_span") < 0.6 * F.lag("_span", 60).over(BARS.whole())
    return out.withColumns(
        {
            "reject_r1": F.col("_falls") >= 4,
            "reject_r2": narrow & (F.col("close") == BARS.agg("min", "close", 60)),
            "reject_r3": F.when(F.col("pos") > 60, F.max("_shock").over(BARS.last(60)) == 1),
        }
    ).drop("_m", "_falls", "_span", "_shock")


# ---------------------------------------------------------------- limit flags
def limit_flags(panel: DataFrame, exact_from: str, rule_from: str, min_age: int = 5, tol: float = 0.005, tol_pp: float = 0.5) -> DataFrame:
    """Sealed, touched, failed, one-word and down-limit columns from listed limits, or from percent thresholds before.

    Needs open/high/low/close, pre_close, pct, up_limit, down_limit, age (days listed), status, cal_pos.
    """
    day = F.col("d")
    c, o, h, lo, pre = (F.col(x) for x in ("close", "open", "high", "low", "pre_close"))
    up, down = F.col("up_limit"), F.col("down_limit")
    exact = (day >= F.lit(exact_from).cast("date")) & up.isNotNull()
    approx = (day < F.lit(exact_from).cast("date")) & (day >= F.lit(rule_from).cast("date")) & pre.isNotNull()
    known = F.coalesce((F.col("age") >= min_age) & (exact | approx) & c.isNotNull(), F.lit(False))
    pct_limit = F.when(F.col("status") >= 1, 5.0).otherwise(10.0)
    panel = panel.withColumns({"_exact": F.coalesce(exact, F.lit(False)), "_known": known, "_lim": pct_limit})
    e, k, thr = F.col("_exact"), F.col("_known"), F.col("_lim") - tol_pp

    # What a bar is held against, chosen once per row: listed limits are prices, the others are gains in percent.
    ceiling = F.when(e, up - tol).otherwise(thr)
    floor = F.when(e, down + tol).otherwise(-thr)
    at = {x: F.when(e, price).otherwise(gain) for x, price, gain in (("close", c, F.col("pct")), ("high", h, (sdiv(h, pre) - 1.0) * 100.0), ("low", lo, (sdiv(lo, pre) - 1.0) * 100.0))}

    def flag(ok: Column, hit: Column) -> Column:
        return F.when(ok, F.coalesce(hit, F.lit(False)).cast("double"))

    up_eff = F.when(e, up).otherwise(pre * (1.0 + F.col("_lim") / 100.0))
    down_eff = F.when(e, down).otherwise(pre * (1.0 - F.col("_lim") / 100.0))
    down_ok = k & down_eff.isNotNull()
    panel = panel.withColumns(
        {
            "sealed": flag(k, at["close"] >= ceiling),
            "_touch": flag(k, at["high"] >= ceiling),
            "oneword": F.when(k & e, ((F.abs(o - up) <= tol) & (F.abs(h - up) <= tol) & (F.abs(lo - up) <= tol) & (F.abs(c - up) <= tol)).cast("double")),
            "_down_touch": flag(down_ok, at["low"] <= floor),
            "down_sealed": flag(down_ok, at["close"] <= floor),
            "_up_eff": up_eff,
            "_down_eff": down_eff,
            "sealed_src": F.when(k & e, 2.0).when(k, 1.0).otherwise(0.0),
        }
    )
    streak = BARS.streak_known("sealed")
    gap = F.coalesce((F.col("cal_pos") - BARS.ref("cal_pos", 1) > 1).cast("double"), F.lit(0.0))
    panel = panel.withColumns(
        {
            "touched": F.when(k, ((F.col("sealed") == 1) | (F.col("_touch") == 1)).cast("double")),
            "touch_fail": F.when(k, ((F.col("_touch") == 1) & (F.col("sealed") == 0)).cast("double")),
            "touch_fail_depth": F.when((F.col("_touch") == 1) & (F.col("_up_eff") > 0), (F.col("_up_eff") - c) / F.col("_up_eff")),
            "down_unsealed": F.when(down_ok, ((F.col("_down_touch") == 1) & (F.col("down_sealed") == 0)).cast("double")),
            "down_recover": F.when((F.col("_down_touch") == 1) & (F.col("_down_eff") > 0), (c - F.col("_down_eff")) / F.col("_down_eff")),
            "consec_limitup": streak,
        }
    )
    panel = panel.withColumn(
        "consec_gap", F.when(F.col("consec_limitup").isNotNull(), F.when(F.col("consec_limitup") > 0, gap).otherwise(0.0))
    )
    return panel.drop("_exact", "_known", "_lim", "_touch", "_down_touch", "_up_eff", "_down_eff")


def candle_flags(df: DataFrame) -> DataFrame:
    """Hammer, doji, engulfing (+1 bull, -1 bear) and shadow ratios of raw prices."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), h - lo
    lower, upper = F.least(o, c) - lo, h - F.greatest(o, c)
    pc, po = BARS.ref("close", 1), BARS.ref("open", 1)
    bull = (c > o) & (pc < po) & (c >= po) & (o <= pc)
    bear = (c < o) & (pc > po) & (c <= po) & (o >= pc)
    flat = span <= 0
    return df.withColumns(
        {
            "hammer": ((lower >= 2.0 * body) & (upper <= 0.5 * body) & (lower >= 0.6 * span) & ~flat).cast("double"),
            "doji": (body < 0.1 * span).cast("double"),
            "engulfing": F.when(pc.isNotNull(), F.when(bull, 1.0).when(bear, -1.0).otherwise(0.0)),
            "upper_shadow": F.when(flat, 0.0).otherwise(sdiv(upper, span)),
            "lower_shadow": lower,
            "close_vs_high": F.when(flat, 0.5).otherwise(sdiv(h - c, span)),
        }
    )


