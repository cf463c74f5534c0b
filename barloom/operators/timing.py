"""When events happen: bursts of signal days, open events per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def burst_segments(events: DataFrame, place: str = "cal_pos") -> DataFrame:
    """Runs of consecutive calendar days with at least one event.

    Events shrink to one row per day before the unkeyed windows, so those see at most a calendar.
    """
    per_day = events.groupBy(place).agg(F.count(F.lit(1)).alias("_n"))
    days = Window.orderBy(place)
    island = per_day.withColumn("_island", F.col(place) - F.row_number().over(days))
    segments = island.groupBy("_island").agg(
        F.min(place).alias("seg_start"), F.max(place).alias("seg_end"), F.count(F.lit(1)).alias("days"), F.sum("_n").alias("events")
    )
    nxt = F.lead("seg_start").over(Window.orderBy("seg_start"))
    return segments.withColumn("idle_after", nxt - F.col("seg_end") - 1).drop("_island")


def concurrency(events: DataFrame, calendar: DataFrame, entry: str = "cal_pos", exit_: str = "exit_pos") -> DataFrame:
    """Open events per calendar day: +1 at entry, -1 the day after exit, summed per day and then along the calendar."""
    steps = events.select(F.col(entry).alias("cal_pos"), F.lit(1).alias("_s")).unionByName(
        events.select((F.col(exit_) + 1).alias("cal_pos"), F.lit(-1).alias("_s"))
    )
    net = steps.groupBy("cal_pos").agg(F.sum("_s").alias("_s"))
    running = F.sum(F.coalesce("_s", F.lit(0))).over(Window.orderBy("cal_pos"))
    return calendar.join(net, "cal_pos", "left").withColumn("open_events", running).drop("_s")
