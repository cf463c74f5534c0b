"""Bar tables: one row per (sym, d), unique by construction, so a series is never longer than its calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS
from barloom.functions.scalar import finite, rnd, sdiv, to_day
from barloom.session import by_series

FILL_TIE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aggregate_bars(
    ticks: DataFrame,
    sym: Column,
    bucket: Column,
    price: Column,
    tie: Sequence[str],
    vol: Column,
    amount: Column,
) -> DataFrame:
    """Ticks to bars in one shuffle with map-side combine; a hot symbol shrinks to one row per period first."""
    keyed = ticks.select(
        sym.alias("sym"),
        bucket.cast("date").alias("d"),
        price.alias("px"),
        vol.alias("q"),
        amount.alias("a"),
        F.struct(*tie, price.alias("px")).alias("k"),  # the price rides on the tie key: one buffer per end
    )
    return (
        keyed.groupBy("sym", "d")
        .agg(
            F.min("k").getField("px").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max("k").getField("px").alias("close"),
            F.sum("q").alias("vol"),
            rnd(F.sum("a"), 2).alias("amount"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("close").isNotNull())
    )


def _fill_price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def bars_brand_week(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    fills = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return aggregate_bars(
        fills, F.col("p_brand"), F.date_trunc("week", "l_shipdate"), _fill_price(), FILL_TIE,
        F.col("l_quantity"), F.col("l_extendedprice"),
    )


def bars_supp_month(spark, sf_dir: str) -> DataFrame:
    return aggregate_bars(
        table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.date_trunc("month", "l_shipdate"),
        _fill_price(), FILL_TIE, F.col("l_quantity"), F.col("l_extendedprice"),
    )


def bars_user_day(spark, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").where(F.col("value") > 0)
    return aggregate_bars(
        ticks, F.col("user_id"), F.col("ts").cast("date"), F.col("value"), ("ts", "event_id"),
        F.lit(1.0), F.col("value"),
    )


def index_bars(spark, sf_dir: str, only_type: str | None = None) -> DataFrame:
    """The same weekly aggregation without a key: one index series (or one per part type prefix)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    if only_type is not None:
        part = part.where(F.col("p_type").startswith(only_type))
    fills = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return aggregate_bars(
        fills, F.lit(only_type or "ALL"), F.date_trunc("week", "l_shipdate"), _fill_price(), FILL_TIE,
        F.col("l_quantity"), F.col("l_extendedprice"),
    )


def clean_bars(raw: DataFrame, keys: Sequence[str] = ("sym",), day: str = "d", keep_first: Sequence[str] = ()) -> DataFrame:
    """Drop rows without close, keep the first row per (key, day) in ``keep_first`` order."""
    order = [F.col(c) for c in (keep_first or raw.columns)]
    first = Window.partitionBy(*keys, day).orderBy(*order)
    return (
        raw.where(finite("close").isNotNull())
        .withColumn("_first", F.row_number().over(first))
        .where("_first = 1")
        .drop("_first")
    )


def normalise_columns(raw: DataFrame, aliases: dict[str, Sequence[str]], day: str | None = None) -> DataFrame:
    """Give a foreign bar table our column names: first present alias wins, absent ones become NULL."""
    present = set(raw.columns)
    picked = []
    for name, options in aliases.items():
        found = [F.col(o) for o in options if o in present]
        picked.append((F.coalesce(*found) if found else F.lit(None).cast("double")).alias(name))
    out = raw.select(*picked)
    return out.withColumn(day, to_day(day)) if day else out


def adjust(bars: DataFrame, layout=BARS) -> DataFrame:
    """Previous close, percent change, running factor ``cf`` and prices adjusted by it.

    A missing change counts as no change in the chain. ``cf`` doubles as the adjusted close.
    """
    prev = layout.ref("close", 1)
    step = by_series(bars, layout.keys).withColumn("pre_close", prev).withColumn("pos", layout.pos())
    step = step.withColumn("pct", (sdiv("close", "pre_close") - 1.0) * 100.0)
    step = step.withColumn("r", F.col("pct") / 100.0)
    step = step.withColumn("cf", F.product(1.0 + F.coalesce("r", F.lit(0.0))).over(layout.past()))
    factor = sdiv("cf", "close")
    return step.withColumns(
        {"ac": F.col("cf"), "ao": F.col("open") * factor, "ah": F.col("high") * factor, "al": F.col("low") * factor}
    )


def calendar(bars: DataFrame, day: str = "d") -> DataFrame:
    """Distinct days with their position. The window has no key but sees one row per day only."""
    return bars.select(day).distinct().withColumn("cal_pos", F.row_number().over(Window.orderBy(day)))


def splice(first: DataFrame, second: DataFrame, cut, day: str = "d") -> DataFrame:
    """Rows of ``first`` before the cut day and of ``second`` from it on."""
    cut = F.lit(cut).cast("date")
    return first.where(F.col(day) < cut).unionByName(second.where(F.col(day) >= cut))
