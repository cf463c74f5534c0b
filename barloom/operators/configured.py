"""Detector settings as rows: one table of configurations drives one scan, and events carry their configuration.

Also truncation tests: the same detectors over many prefixes of the history at once, one series per (cut, key).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barloom.operators.events import _keep_spaced
from barloom.operators.sequential import ZigzagLegs
from barloom.session import attach_row

SETTINGS = "pool string, config string, method string, order int, pct double, min_sep int, regime_window int, min_change double, lookback int"
#: A settings table is read on the driver for its distinct orders, fractions and windows; it is written by hand.
MOST_SETTINGS = 10_000


def distinct_values(settings: DataFrame, column: str) -> list:
    rows = settings.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} values of {column}")
    return sorted(r[0] for r in rows)


def fractal_lows_by_order(bars: DataFrame, orders: Sequence[int], price: str = "close") -> DataFrame:
    """(order, sym, low_pos, sig_pos) for every order: two frames per order over one sort of the series."""
    p = F.col(price)

    def strict(n: int):
        left, right = (Window.partitionBy("sym").orderBy("pos").rowsBetween(*x) for x in ((-n, -1), (1, n)))
        return (F.count(p).over(left) == n) & (F.count(p).over(right) == n) & (p < F.min(p).over(left)) & (p < F.min(p).over(right))

    marked = bars.select("sym", "pos", *[F.when(strict(n), F.lit(n)).alias(f"_o{n}") for n in orders])
    found = marked.select("sym", "pos", F.explode(F.array_compact(F.array(*[f"_o{n}" for n in orders]))).alias("order"))
    return found.select(F.col("order").cast("int").alias("order"), "sym", F.col("pos").cast("long").alias("low_pos"), (F.col("pos") + F.col("order")).cast("long").alias("sig_pos"))


def zigzag_lows_by_pct(bars: DataFrame, pcts: Sequence[float], price: str = "close") -> DataFrame:
    """(pct, sym, low_pos, sig_pos) for every fraction: one grouped pass, all automata step over the same rows."""
    schema = StructType([StructField("pct", DoubleType()), bars.schema["sym"], StructField("low_pos", LongType()), StructField("sig_pos", LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="mergesort")
        rows = list(zip(group[price].to_numpy(float).tolist(), group["pos"].to_numpy().tolist()))
        found = []
        for pct in pcts:
            legs = ZigzagLegs([])
            found += [(pct, group["sym"].iloc[0], low, pos) for x, pos in rows if (low := legs.push(x, pos, pct)) is not None]
        return pd.DataFrame(found, columns=["pct", "sym", "low_pos", "sig_pos"])

    return bars.select("sym", "pos", price).groupBy("sym").applyInPandas(run, schema)


def configured_lows(bars: DataFrame, settings: DataFrame) -> DataFrame:
    """(settings columns, sym, low_pos, sig_pos): lows of every configuration, spaced by its own ``min_sep``.

    Configurations with one order or fraction share its lows.
    """
    fractal, zigzag = settings.where("method = 'fractal'"), settings.where("method = 'zigzag'")
    parts = []
    if orders := distinct_values(fractal, "order"):
        parts.append(fractal_lows_by_order(bars, orders).join(F.broadcast(fractal), "order"))
    if pcts := distinct_values(zigzag, "pct"):
        parts.append(zigzag_lows_by_pct(bars, pcts).join(F.broadcast(zigzag), "pct"))
    if not parts:
        raise ValueError("no configuration")
    names = [*settings.columns, "sym", "low_pos", "sig_pos"]
    lows = parts[0].select(*names)
    for part in parts[1:]:
        lows = lows.unionByName(part.select(*names))
    point = F.struct("low_pos", "sig_pos")
    grouped = lows.groupBy(*settings.columns, "sym").agg(F.array_sort(F.collect_list(point)).alias("_points"))
    kept = grouped.withColumn("_kept", _keep_spaced(F.col("_points"), F.coalesce(F.col("min_sep"), F.lit(0)), "low_pos"))
    return kept.select(*settings.columns, "sym", F.explode("_kept").alias("_p")).select(*settings.columns, "sym", "_p.low_pos", "_p.sig_pos")


def configured_divergences(bars: DataFrame, lows: DataFrame, keys: Sequence[str] = ("pool", "config", "sym"), deepest: int = 2, warmup: int = 33) -> DataFrame:
    """Events of every configuration: a lower low with a higher ``dif``, within its ``lookback`` earlier lows, by its ``min_change``."""
    at_low = bars.select("sym", F.col("pos").cast("long").alias("low_pos"), F.col("close").alias("c"), F.col("dif").alias("m"))
    seq = lows.join(at_low, ["sym", "low_pos"])
    order = Window.partitionBy(*keys).orderBy("low_pos")
    seq = seq.withColumns({f"_p{k}": F.lag(F.struct("low_pos", "c", "m"), k).over(order) for k in range(1, deepest + 1)})
    rank, prev = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k in range(deepest, 0, -1):
        p = F.col(f"_p{k}")
        holds = F.coalesce((F.lit(k) <= F.col("lookback")) & (F.col("c") < p["c"]) & (F.col("m") > p["m"] + F.col("min_change")), F.lit(False))
        rank, prev = F.when(holds, F.lit(k).cast("long")).otherwise(rank), F.when(holds, p["low_pos"]).otherwise(prev)
    hits = seq.withColumns({"rank": rank, "prev_pos": prev}).where(F.col("rank").isNotNull() & (F.col("sig_pos") > warmup))
    return hits.select(*lows.columns, "prev_pos", "rank", (F.col("low_pos") - F.col("prev_pos")).alias("formation"))


def in_wanted_phase(events: DataFrame, days: DataFrame, phases: DataFrame, wanted: float = 1.0) -> DataFrame:
    """Events of configurations without a regime window, and of the others those whose signal day is in the wanted phase.

    ``days`` (sym, sig_pos, d); ``phases`` (regime_window, d, regime): one row per day and window.
    """
    dated = events.join(days, ["sym", "sig_pos"])
    return dated.join(phases, ["regime_window", "d"], "left").where(F.col("regime_window").isNull() | (F.col("regime") == wanted)).drop("regime")


def recalls(events: DataFrame, base: str, on: Sequence[str]) -> DataFrame:
    """Per pool and configuration against the pool's ``base``: n_base, n_other, n_both and both recalls of distinct keys.

    The base's keys meet those of all configurations in one join; a configuration without an event is not listed.
    """
    keys = events.select("pool", "config", *on).distinct()
    ground = keys.where(F.col("config") == base).drop("config")
    n_base = ground.groupBy("pool").agg(F.count(F.lit(1)).alias("n_base"))
    others = keys.where(F.col("config") != base)
    both = others.join(ground.withColumn("_hit", F.lit(1)), ["pool", *on], "left")
    counts = both.groupBy("pool", "config").agg(F.count(F.lit(1)).alias("n_other"), F.count("_hit").alias("n_both")).join(n_base, "pool", "left")
    share = lambda n: F.try_divide(F.col("n_both").cast("double"), F.col(n))
    return counts.select("pool", "config", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "n_other", "n_both", share("n_base").alias("recall_base"), share("n_other").alias("recall_other"))


# ---------------------------------------------------------------- truncation
def cut_days(calendar: DataFrame, n_cuts: int) -> DataFrame:
    """(cut, cut_d, after_d): ``n_cuts`` days spread over the calendar, the last day included, each with the cut before it."""
    total = F.max("cal_pos").over(Window.partitionBy())
    edge = F.ceil(F.col("cal_pos") * n_cuts / total)
    marked = calendar.withColumn("_edge", edge).groupBy("_edge").agg(F.max("d").alias("cut_d"))  # one row per day, known to be few
    order = Window.orderBy("cut_d")
    return marked.select(F.row_number().over(order).alias("cut"), "cut_d", F.lag("cut_d").over(order).alias("after_d"))


def seen_by_cuts(bars: DataFrame, cuts: DataFrame, lookback: int | None = None, day: str = "d") -> DataFrame:
    """Every bar once for each cut that sees it, in a series of its own named by cut and key; ``cut`` and ``key`` stay.

    A bar's first cut is a lookup in the sorted cuts, the others follow by number. With ``lookback`` a series starts
    that many rows before the rows that only this cut sees; then positions must come with the bars.
    """
    tagged = attach_row(bars, cuts.agg(F.array_sort(F.collect_list("cut_d")).alias("_edges")))
    first = F.size(F.filter("_edges", lambda x: x < F.col(day))) + 1
    tagged = tagged.withColumn("_first", first).where(F.col("_first") <= F.size("_edges"))
    last = F.size("_edges")
    if lookback is not None:
        ahead = Window.partitionBy("sym").orderBy("pos").rowsBetween(0, lookback)
        # The newest cut whose own rows begin within the lookback.
        last = F.least(last, F.max("_first").over(ahead))
    out = tagged.withColumn("_last", last).withColumn("cut", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("key", F.col("sym")).withColumn("sym", F.concat_ws("|", "cut", "sym")).drop("_edges", "_first", "_last")


def truncation_differences(whole: DataFrame, prefixes: DataFrame, cuts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cut: events of its own window in the full run, in the run on its prefix, and in both, compared as rows.

    ``whole`` (sym, d, columns) and ``prefixes`` (cut, sym, d, columns); a cut's window is (cut before, cut].
    """
    window = cuts.select("cut", "cut_d", "after_d")
    inside = (F.col("d") <= F.col("cut_d")) & (F.col("after_d").isNull() | (F.col("d") > F.col("after_d")))
    mine = prefixes.join(F.broadcast(window), "cut").where(inside).select("cut", "sym", *columns, F.lit(1).alias("_prefix"))
    dated = whole.join(F.broadcast(window), inside).select("cut", "sym", *columns, F.lit(1).alias("_whole"))
    both = dated.join(mine, ["cut", "sym", *columns], "full")
    counts = both.groupBy("cut").agg(
        F.count("_whole").alias("n_whole"), F.count("_prefix").alias("n_prefix"), F.count(F.when(F.col("_whole").isNotNull() & F.col("_prefix").isNotNull(), 1)).alias("n_both")
    )
    none = {n: F.coalesce(n, F.lit(0)).alias(n) for n in ("n_whole", "n_prefix", "n_both")}
    return cuts.join(counts, "cut", "left").select("cut", "cut_d", *none.values())


def truncation_test(bars: DataFrame, cuts: DataFrame, detect: Callable[[DataFrame], DataFrame], columns: Sequence[str], lookback: int | None = None) -> DataFrame:
    """``truncation_differences`` of a detector (bars -> sym, sig_pos, ...): one full run, one run over all prefixes at once."""
    day = bars.select("sym", F.col("pos").cast("long").alias("sig_pos"), "d")
    replay = seen_by_cuts(bars, cuts, lookback)
    owner = replay.select("sym", "cut", "key").distinct()
    whole = detect(bars).join(day, ["sym", "sig_pos"])
    found = detect(replay).join(owner, "sym").select("cut", F.col("key").alias("sym"), *columns)
    return truncation_differences(whole, found.join(day, ["sym", "sig_pos"]), cuts, columns)
