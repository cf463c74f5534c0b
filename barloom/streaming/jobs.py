"""Structured Streaming twins of the batch operators.

After the last row of a day has arrived, the rows emitted for that day equal the batch rows. Windowed operators run in
append mode and emit a window once the watermark has passed its end; stateful operators keep a small state per symbol.
The stateful ones here emit a row in the batch that brings it and need batches in order of time; ``ordered.py`` has the
ones that put late rows in their place first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barloom.operators.sequential import MACD_FAST, MACD_SIGNAL, MACD_SLOW, ZigzagLegs
from barloom.session import ensure_checkpoint_dir


# ---------------------------------------------------------------- sources and sinks
def parquet_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run the stream over everything available into a parquet table and read that table back."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    writer = stream.writeStream.outputMode(output_mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/_state")
    writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_days(batch: DataFrame, path: str, day: str = "d", batch_id: int = 0) -> None:
    """Idempotent sink for ``foreachBatch``: a replay replaces the rows of its own batch, by day, and no others.

    A day whose rows arrive in several batches keeps them all, one folder per batch below the day.
    """
    tagged = batch.withColumn("batch", F.lit(batch_id).cast("long"))
    tagged.hint("rebalance", day).write.partitionBy(day, "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def start_day_sink(stream: DataFrame, path: str, checkpoint: str, day: str = "d"):
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: write_days(batch, path, day, batch_id))
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .start()
    )


# ---------------------------------------------------------------- windows
def tick_bars(ticks: DataFrame, key: str, price: Column, tie: Sequence[str], bar: str, delay: str, ts: str = "ts") -> DataFrame:
    """Bars from ticks over tumbling windows, emitted when the watermark passes the window."""
    rows = ticks.withWatermark(ts, delay).select(ts, F.col(key).alias("sym"), price.alias("px"), F.struct(ts, *tie).alias("k"))
    return (
        rows.groupBy(F.window(ts, bar).alias("w"), "sym")
        .agg(
            F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("sym", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "n")
    )


def sliding_breadth(ticks: DataFrame, hit: Column, width: str, slide: str, delay: str, ts: str = "ts") -> DataFrame:
    """Rows, distinct-free hit share and count over sliding windows."""
    return (
        ticks.withWatermark(ts, delay)
        .groupBy(F.window(ts, width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("share"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "share")
    )


def burst_sessions(ticks: DataFrame, key: str, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart belong together."""
    return (
        ticks.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def first_of_day(ticks: DataFrame, key: str, delay: str, ts: str = "ts") -> DataFrame:
    """One row per (key, day): later duplicates inside the watermark are dropped."""
    return ticks.withColumn("d", F.col(ts).cast("date")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, "d"])


def with_static(stream: DataFrame, static: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Stream rows joined to a static table (calendar, limits, intervals)."""
    return stream.join(static, list(keys), how)


def matured_pairs(events: DataFrame, later: DataFrame, key: str, horizon: str, delay: str, how: str = "inner") -> DataFrame:
    """Each event with the later rows of its key inside the horizon; with ``leftOuter`` unmatched events are emitted
    once the watermark shows that none can come any more. Columns: events (key, ts, event_id), later (key, ts, value)."""
    a = events.withWatermark("ts", delay).alias("a")
    b = later.withWatermark("ts", delay).alias("b")
    cond = (
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.ts") > F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"interval {horizon}"))
    )
    return a.join(b, cond, how).select(
        F.col(f"a.{key}").alias(key), F.col("a.event_id").alias("event_id"), F.col("a.ts").alias("ts"), F.col("b.ts").alias("later_ts"), F.col("b.value").alias("value")
    )


def observe_late(ticks: DataFrame, ts: str, newest: Column, allowed: str, name: str = "late"):
    """Count rows older than ``newest`` minus the allowed delay as an observed metric of the query."""
    late = F.col(ts) < newest - F.expr(f"interval {allowed}")
    return ticks.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late_rows"))


# ---------------------------------------------------------------- state per symbol
_MACD_STATE = StructType(
    [
        StructField("n", LongType()), StructField("seed", ArrayType(DoubleType())), StructField("fast", DoubleType()), StructField("slow", DoubleType()),
        StructField("difs", ArrayType(DoubleType())), StructField("dea", DoubleType()),
    ]
)


def _macd_step(state: tuple, close: float) -> tuple[tuple, float, float]:
    """One row: returns the new state and (dif, dea), NaN until the signal line starts."""
    n, seed, fast, slow, difs, dea = state
    n, nan = n + 1, float("nan")
    if n <= MACD_SLOW:
        seed = [*seed, close]
        if n < MACD_SLOW:
            return (n, seed, fast, slow, difs, dea), nan, nan
        fast, slow = sum(seed[-MACD_FAST:]) / MACD_FAST, sum(seed) / MACD_SLOW
        seed = []
    else:
        fast += 2.0 / (MACD_FAST + 1) * (close - fast)
        slow += 2.0 / (MACD_SLOW + 1) * (close - slow)
    dif = fast - slow
    if n < MACD_SLOW + MACD_SIGNAL:
        difs = [*difs, dif]
        if len(difs) < MACD_SIGNAL:
            return (n, seed, fast, slow, difs, dea), nan, nan
        dea, difs = sum(difs) / MACD_SIGNAL, []
    else:
        dea += 2.0 / (MACD_SIGNAL + 1) * (dif - dea)
    return (n, seed, fast, slow, difs, dea), dif, dea


def streaming_macd(bars: DataFrame, price: str = "close", key: str = "sym", order: str = "d") -> DataFrame:
    """dif and dea of every arriving bar; state is two averages and, early on, the seed rows."""
    schema = StructType([bars.schema[key], bars.schema[order], StructField("dif", DoubleType()), StructField("dea", DoubleType())])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="mergesort")
        s = state.get if state.exists else (0, [], 0.0, 0.0, [], 0.0)
        s = (s[0], list(s[1]), s[2], s[3], list(s[4]), s[5])
        dif, dea = [], []
        for close in rows[price].astype(float).tolist():
            s, a, b = _macd_step(s, close)
            dif.append(a)
            dea.append(b)
        state.update(s)
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "dif": pd.Series(dif).astype(object).where(~np.isnan(dif), None), "dea": pd.Series(dea).astype(object).where(~np.isnan(dea), None)})

    return bars.select(key, order, price).groupBy(key).applyInPandasWithState(step, schema, _MACD_STATE, "append", GroupStateTimeout.NoTimeout)


_ZIGZAG_STATE = StructType(
    [
        StructField("n", LongType()), StructField("signs", ArrayType(LongType())), StructField("extremes", ArrayType(DoubleType())),
        StructField("places", ArrayType(LongType())),
    ]
)


def streaming_zigzag(bars: DataFrame, pct: float, price: str = "close", key: str = "sym", order: str = "d") -> DataFrame:
    """Lows as they are confirmed: (key, day of the confirming row, low_pos, sig_pos)."""
    schema = StructType([bars.schema[key], bars.schema[order], StructField("low_pos", LongType()), StructField("sig_pos", LongType())])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="mergesort")
        n, *open_legs = state.get if state.exists else (0, [], [], [])
        legs, out = ZigzagLegs(list(zip(*open_legs))), []
        for day, p in zip(rows[order], rows[price].astype(float)):
            n += 1
            low = legs.push(p, n, pct)
            if low is not None:
                out.append((k[0], day, low, n))
        state.update((n, *[[leg[i] for leg in legs.open] for i in range(3)]))
        if out:
            yield pd.DataFrame(out, columns=[key, order, "low_pos", "sig_pos"])

    return bars.select(key, order, price).groupBy(key).applyInPandasWithState(step, schema, _ZIGZAG_STATE, "append", GroupStateTimeout.NoTimeout)


def streaming_last_n(bars: DataFrame, column: str, n: int, key: str = "sym", order: str = "d") -> DataFrame:
    """Strict mean, minimum and maximum of the last n values; state is a buffer of at most n - 1 values."""
    schema = StructType([bars.schema[key], bars.schema[order], *[StructField(x, DoubleType()) for x in ("mean", "min", "max")]])
    kept = StructType([StructField("last", ArrayType(DoubleType()))])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="mergesort")
        before = list(state.get[0]) if state.exists else []
        values = pd.Series([*before, *rows[column].astype(float)])
        roll = values.rolling(n, min_periods=n)
        out = pd.DataFrame({"mean": roll.mean(), "min": roll.min(), "max": roll.max()}).iloc[len(before) :].reset_index(drop=True)
        state.update((values.iloc[-(n - 1) :].tolist(),))
        out = out.astype(object).where(out.notna(), None)
        out.insert(0, order, rows[order].to_numpy())
        out.insert(0, key, k[0])
        yield out

    return bars.select(key, order, column).groupBy(key).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)
