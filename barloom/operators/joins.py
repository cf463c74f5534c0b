"""Keyed, as-of and interval joins over panels.

As-of and interval joins are a union of both sides sorted by (key, day) and one running ``last``: no range
condition, no cross product, one shuffle by key. The work of one key is its own rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import attach_row


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what} is not unique on {list(keys)}")


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left join that never multiplies rows: the right side must be unique on the keys."""
    if check:
        assert_unique(right, keys, "right side")
    return left.join(right, list(keys), "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full", check: bool = True) -> DataFrame:
    if check:
        assert_unique(left, keys, "left side")
        assert_unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    day: str,
    values: Sequence[str],
    right_day: str = "as_of_d",
    strict: bool = False,
    slot: Column | None = None,
) -> DataFrame:
    """Latest right row at or before each left row (strictly before with ``strict``).

    The right side must hold one row per (keys, day). ``right_day`` receives the day of the matched row.

    Panels of bars have at most one row per calendar day and key, so one window per key is bounded. Where a key
    may have more rows (raw events), pass ``slot``, a coarse monotone function of the day such as its month: each
    key is then worked slot by slot, and what is still open from earlier slots comes from one row per (key, slot).
    """
    keys = list(keys)
    if slot is not None:
        left, right = left.withColumn("_slot", slot), right.withColumn("_slot", slot)
    part = [*keys, "_slot"] if slot is not None else keys
    packed = F.struct(F.col(day).alias("_d"), *[F.col(v) for v in values])
    probe = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_hit", F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType))
    data = right.select(*part, day, F.lit(1 if strict else 0).alias("_side"), packed.alias("_hit"))
    both = probe.unionByName(data, allowMissingColumns=True)
    so_far = Window.partitionBy(*part).orderBy(day, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(so_far))
    kept = filled.where(F.col("_side") == (0 if strict else 1))
    hit = F.col("_hit")
    if slot is not None:
        ends = right.groupBy(*part).agg(F.max_by(packed, day).alias("_end"))
        slots = left.select(*part).distinct().join(ends, part, "full")
        earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        carried = slots.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        kept = kept.join(carried, part, "left")
        hit = F.coalesce("_hit", "_carried")
    names = [c for c in left.columns if c != "_slot"]
    kept = kept.withColumn("_found", hit)
    return kept.select(
        *names, F.col("_found._d").alias(right_day), *[F.col(f"_found.{v}").alias(v) for v in values]
    )


def interval_value(
    panel: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    out: str,
    default: Column | None = None,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Value of the interval with the latest start at or before the row, if the row is inside it.

    A NULL end is open. Of several intervals with one start, the one with the largest end (open last), then the
    largest value, counts; this makes the result independent of input order.
    """
    rank = Window.partitionBy(*keys, start).orderBy(F.col(end).desc_nulls_first(), F.col(value).desc())
    latest = (
        intervals.withColumn("_rn", F.row_number().over(rank))
        .where("_rn = 1")
        .select(*keys, F.col(start).alias(day), F.col(end).alias("_end"), F.col(value).alias("_value"))
    )
    hit = as_of(panel, latest, keys, day, ["_end", "_value"], right_day="_start")
    inside = F.col("_start").isNotNull() & (F.col("_end").isNull() | (F.col(day) <= F.col("_end")))
    chosen = F.when(inside, F.col("_value"))
    if default is not None:
        chosen = F.when(inside, F.col("_value")).otherwise(default)
    return hit.withColumn(out, chosen).drop("_start", "_end", "_value")


def neighbour_day(
    panel: DataFrame, calendar: DataFrame, columns: Sequence[str], step: int, prefix: str, key: str = "sym", day: str = "d"
) -> DataFrame:
    """Columns of the same symbol ``step`` *calendar* days away (-1 previous, 1 next); no row gives NULL.

    ``calendar`` is (day, cal_pos); the symbol's own previous row may be older than the previous day.
    """
    placed = panel if "cal_pos" in panel.columns else panel.join(F.broadcast(calendar), day, "left")
    other = placed.select(
        key, (F.col("cal_pos") - step).alias("cal_pos"), *[F.col(c).alias(prefix + c) for c in columns]
    )
    return placed.join(other, [key, "cal_pos"], "left")


def shuffled_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input: both sides are shuffled, neither is ever broadcast.

    Left to itself Spark judges a side by its compressed files and ignores what ``explode`` adds, so it would send
    through the driver a side many times larger than the broadcast limit.
    """
    return left.hint("merge").join(right, on, how)


def with_roles(events: DataFrame, bars: DataFrame, roles: dict[str, str], columns: Sequence[str], key: str = "sym", pos: str = "pos") -> DataFrame:
    """Columns of the symbol's bar at several positions: ``roles`` maps a prefix to the event's position column."""
    out = events
    for prefix, place in roles.items():
        side = bars.select(key, F.col(pos).alias(place), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        out = shuffled_join(out, side, [key, place], "left")
    return out


def nearest_by_position(
    events: DataFrame, targets: DataFrame, key: str, event_id: str, pos: str, target_pos: str, out: str = "gap"
) -> DataFrame:
    """For each event the target of the same key nearest in position; of two equally near, the earlier.

    The nearest target is either the last at or before the event or the first after it, so two running
    windows over the union replace the all-pairs join.
    """
    both = events.select(key, F.col(pos).alias("_p"), F.col(event_id).alias("_id")).unionByName(
        targets.select(key, F.col(target_pos).alias("_p")).distinct().withColumn("_id", F.lit(None).cast(events.schema[event_id].dataType))
    )
    is_target = F.col("_id").isNull()
    # Both directions use growing frames (the second over descending rows): linear in the rows of a key.
    forward, backward = (Window.partitionBy(key).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("_p"), F.desc("_p")))
    before = F.max(F.when(is_target, F.col("_p"))).over(forward)
    after = F.min(F.when(is_target, F.col("_p"))).over(backward)
    found = both.withColumns({"_b": before, "_a": after}).where(F.col("_id").isNotNull())
    take_before = F.col("_a").isNull() | (F.col("_p") - F.col("_b") <= F.col("_a") - F.col("_p"))
    nearest = F.when(take_before, F.col("_b")).otherwise(F.col("_a"))
    return found.select(
        F.col(key), F.col("_id").alias(event_id), F.col("_p").alias(pos), nearest.alias(target_pos),
        (F.col("_p") - nearest).alias(out),
    )


def band_matches(main: DataFrame, other: DataFrame, key: str, pos: str, width: int, main_id: str, other_id: str) -> DataFrame:
    """Pairs of the same key at most ``width`` positions apart, kept an equi-join by bucketing positions."""
    size = 2 * width + 1
    left = main.select(key, F.col(main_id), F.col(pos).alias("_lp"), F.floor(F.col(pos) / size).alias("_b"))
    right = other.select(
        key, F.col(other_id), F.col(pos).alias("_rp"),
        F.explode(
            F.array_distinct(
                F.array(F.floor((F.col(pos) - width) / size), F.floor((F.col(pos) + width) / size))
            )
        ).alias("_b"),
    )
    return (
        left.join(right, [key, "_b"])
        .where(F.abs(F.col("_lp") - F.col("_rp")) <= width)
        .select(key, main_id, other_id, F.col("_lp").alias("main_pos"), F.col("_rp").alias("other_pos"))
    )


def bars_after(events: DataFrame, bars: DataFrame, columns: Sequence[str], first: int, last: int, key: str = "sym", sig: str = "sig_pos") -> DataFrame:
    """One row per event and following bar, ``step`` first..last: an equi-join on (key, position)."""
    steps = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("step")
    want = events.select("*", steps).withColumn("_pos", F.col(sig) + F.col("step"))
    side = bars.select(key, F.col("pos").alias("_pos"), *[F.col(c).alias(f"x_{c}") for c in columns])
    return shuffled_join(want, side, [key, "_pos"]).drop("_pos")


def bars_after_wide(events: DataFrame, bars: DataFrame, columns: Sequence[str], last: int, key: str = "sym", sig: str = "sig_pos", out: str = "ahead") -> DataFrame:
    """Each event with the array of the next ``last`` bars (``pos`` and ``columns``), oldest first.

    The arrays are made once per bar by a bounded forward frame and looked up by equality.
    """
    item = F.struct(F.col("pos").alias("pos"), *[F.col(c) for c in columns])
    frame = Window.partitionBy(key).orderBy("pos").rowsBetween(1, last)
    ahead = bars.select(key, F.col("pos").alias(sig), F.collect_list(item).over(frame).alias(out))
    return shuffled_join(events, ahead, [key, sig], "left")


def densify(bars: DataFrame, calendar: DataFrame, key: str = "sym", day: str = "d") -> DataFrame:
    """Every key on every calendar day between its first and last bar; absent days have NULL columns.

    Grows each key from the broadcast calendar as one array lookup, not a cross join of tables.
    """
    days = calendar.agg(F.sort_array(F.collect_list(day)).alias("_days"))
    spans = bars.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    grid = attach_row(spans, days).select(
        key, F.explode(F.filter("_days", lambda x: (x >= F.col("_lo")) & (x <= F.col("_hi")))).alias(day)
    )
    return grid.join(bars, [key, day], "left")


def anti_same_day(pool: DataFrame, events: DataFrame, key: str = "sym", day: str = "d") -> DataFrame:
    """Rows of the pool whose (key, day) has no event."""
    return pool.join(events.select(key, day).distinct(), [key, day], "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows only in one of two tables, tagged; empty when they are equal as multisets."""
    only_a = a.select(*columns).exceptAll(b.select(*columns)).withColumn("only_in", F.lit("a"))
    only_b = b.select(*columns).exceptAll(a.select(*columns)).withColumn("only_in", F.lit("b"))
    return only_a.unionByName(only_b)


def overlap(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_base, n_other, n_both and the two recalls of distinct keys: one outer join, one aggregate."""
    a = base.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = other.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(keys), "full")
    n = both.agg(
        F.count("_a").alias("n_base"), F.count("_b").alias("n_other"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"),
    )
    return n.select(
        "n_base", "n_other", "n_both",
        F.try_divide(F.col("n_both").cast("double"), "n_base").alias("recall_base"),
        F.try_divide(F.col("n_both").cast("double"), "n_other").alias("recall_other"),
    )


def merge_sources(
    spine: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """Left join feature sources in priority order; a column given twice must agree, the first one is kept.

    Agreement is checked for all repeated columns in one aggregate; a mismatch raises.
    """
    out, owner, repeats = spine, {c: "spine" for c in spine.columns}, []
    for name, source in sources.items():
        assert_unique(source, keys, name)
        renamed = []
        for c in source.columns:
            if c in keys:
                renamed.append(F.col(c))
            elif c in owner:
                repeats.append((c, f"_{name}_{c}"))
                renamed.append(F.col(c).alias(f"_{name}_{c}"))
            else:
                owner[c] = name
                renamed.append(F.col(c))
        out = shuffled_join(out, source.select(*renamed), list(keys), "left")
    if repeats:
        bad = []
        for kept, again in repeats:
            a, b = F.col(kept).cast("double"), F.col(again).cast("double")
            close = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-300))
            differs = (a.isNull() != b.isNull()) | (a.isNotNull() & b.isNotNull() & ~close)
            bad.append(F.sum(differs.cast("long")).alias(again))
        counts = out.agg(*bad).first().asDict()
        wrong = {k: v for k, v in counts.items() if v}
        if wrong:
            raise ValueError(f"sources disagree on repeated columns: {wrong}")
        out = out.drop(*[again for _, again in repeats])
    return out
