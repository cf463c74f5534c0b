"""Streams whose rows arrive out of order: rows of a key wait in state until the watermark passes them.

A fold then sees them in the order of their event time, so what it emits equals the batch result whatever the order of
arrival, as long as no row comes later than the watermark allows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barloom.operators.sequential import ZigzagLegs
from barloom.streaming.jobs import _macd_step

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAN = float("nan")


@dataclass(frozen=True)
class Fold:
    """A recursion along one key: ``step(state, row) -> (state, outputs or None)``; rows are tuples of ``columns`` (doubles)."""

    columns: tuple[str, ...]
    state: str
    start: tuple
    outputs: str
    step: Callable[[tuple, tuple], tuple[tuple, tuple | None]]


class InOrder(StatefulProcessor):
    """Pending rows in a list state, one event-time timer per key at its earliest pending row, a fold over what is due."""

    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, " + ", ".join(f"{c} double" for c in self.fold.columns))
        self.due = handle.getValueState("due", "at long")
        self.kept = handle.getValueState("kept", self.fold.state)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", *self.fold.columns]
        new = [tuple(r) for part in rows for r in part[names].itertuples(index=False, name=None)]
        new = [(int(r[0]), *[float(v) if v is not None else NAN for v in r[1:]]) for r in new]
        if new:
            self.pending.appendList(new)
            first = min(r[0] for r in new)
            if not self.due.exists():
                self._wake(first)
            elif first < self.due.get()[0]:
                self.handle.deleteTimer(self.due.get()[0])
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.pending.get())
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        self.due.clear()
        self.pending.clear()
        if later:
            self.pending.put(later)
            self._wake(later[0][0])
        state = tuple(self.kept.get()) if self.kept.exists() else self.fold.start
        out = []
        for at, *values in ready:
            state, made = self.fold.step(state, tuple(values))
            if made is not None:
                out.append((key[0], at, *[None if isinstance(v, float) and math.isnan(v) else v for v in made]))
        self.kept.update(tuple(state))
        names = [self.key, "at", *[c.split()[0] for c in self.fold.outputs.split(", ")]]
        yield pd.DataFrame(out, columns=names, dtype=object)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, fold: Fold, ts: str, delay: str, key: str = "sym") -> DataFrame:
    """(key, ts, outputs of the fold) once the watermark, ``delay`` behind the newest row, has passed a row.

    Rows later than that are dropped by the engine. The state of a key is its rows inside the delay and the fold's own.
    Keeps state in RocksDB, which event-time timers need; the provider is set for the session.
    """
    spark: SparkSession = rows.sparkSession
    if spark.conf.get(STATE_PROVIDER, None) != ROCKSDB:
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
    values = [F.col(c).cast("double").alias(c) for c in fold.columns]
    marked = rows.withWatermark(ts, delay).select(key, ts, F.unix_millis(F.col(ts)).alias("at"), *values)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, at long, {fold.outputs}"
    out = marked.groupBy(key).transformWithStateInPandas(InOrder(fold, key), schema, "append", "EventTime")
    return out.withColumn(ts, F.timestamp_millis("at")).drop("at")


# ---------------------------------------------------------------- folds
def _average(total: float, seen: int, x: float, n: int) -> tuple[float, int]:
    """Wilder's average: a sum up to the n-th value, from there on the smoothed mean."""
    seen += 1
    if seen < n:
        return total + x, seen
    return ((total + x) / n if seen == n else total + (x - total) / n), seen


def rsi(price: str, n: int) -> Fold:
    """``rsi``: the twin of the batch recursion; state is the last price and two averages."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        last, seen, gain, loss = state
        x = row[0]
        if last is None:
            return (x, 0, 0.0, 0.0), (NAN,)
        move = x - last
        gain, more = _average(gain, seen, max(move, 0.0), n)
        loss, _ = _average(loss, seen, max(-move, 0.0), n)
        both = gain + loss
        return (x, more, gain, loss), (NAN if more < n else 100.0 * gain / both if both > 0 else 0.0,)

    return Fold((price,), "last double, seen long, gain double, loss double", (None, 0, 0.0, 0.0), "rsi double", step)


def atr(high: str, low: str, close: str, n: int) -> Fold:
    """``atr``: Wilder's average true range, first shown at the n-th range."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        last, seen, mean = state
        h, lo, c = row
        if last is None:
            return (c, 0, 0.0), (NAN,)
        mean, more = _average(mean, seen, max(h - lo, abs(h - last), abs(lo - last)), n)
        return (c, more, mean), (mean if more >= n else NAN,)

    return Fold((high, low, close), "last double, seen long, mean double", (None, 0, 0.0), "atr double", step)


_MACD = "n long, seed array<double>, fast double, slow double, difs array<double>, dea double"
_MACD_START = (0, [], 0.0, 0.0, [], 0.0)


def macd(price: str) -> Fold:
    """``dif``, ``dea``: seeded averages."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        n, seed, fast, slow, difs, dea = state
        made = _macd_step((n, list(seed), fast, slow, list(difs), dea), row[0])
        return made[0], made[1:]

    return Fold((price,), _MACD, _MACD_START, "dif double, dea double", step)


def crosses(price: str) -> Fold:
    """A row per cross of dif over dea: ``golden`` upward, else downward. State is the MACD's and the last two lines."""
    inner = macd(price)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        *own, dif0, dea0 = state
        own, (dif, dea) = inner.step(tuple(own), row)
        known = dif0 is not None and not (math.isnan(dif) or math.isnan(dea))
        up, down = known and dif0 <= dea0 and dif > dea, known and dif0 >= dea0 and dif < dea
        shown = (None, None) if math.isnan(dif) or math.isnan(dea) else (dif, dea)
        return (*own, *shown), ((up, dif, dea) if up or down else None)

    return Fold((price,), f"{_MACD}, dif0 double, dea0 double", (*_MACD_START, None, None), "golden boolean, dif double, dea double", step)


def zigzag(price: str, pct: float) -> Fold:
    """``low_pos``, ``sig_pos`` of every low on the row that confirms it; positions count the rows of the key from 1."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        n, signs, extremes, places = state
        legs = ZigzagLegs(list(zip(signs, extremes, places)))
        low = legs.push(row[0], n + 1, pct)
        return (n + 1, *([x[i] for x in legs.open] for i in range(3))), (None if low is None else (low, n + 1))

    return Fold((price,), "n long, signs array<long>, extremes array<double>, places array<long>", (0, [], [], []), "low_pos long, sig_pos long", step)


def last_n(column: str, n: int) -> Fold:
    """``mean``, ``low``, ``high`` of the last n values, strict; state is at most n - 1 values."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        held = [*state[0], row[0]][-n:]
        full = len(held) == n
        return (held[-(n - 1) :] if n > 1 else [],), ((sum(held) / n, min(held), max(held)) if full else (NAN, NAN, NAN))

    return Fold((column,), "held array<double>", ([],), "mean double, low double, high double", step)


def together(*folds: Fold) -> Fold:
    """Several folds over the same rows in one pass; a row is emitted with the outputs of all."""
    columns = tuple(dict.fromkeys(c for f in folds for c in f.columns))
    places = [[columns.index(c) for c in f.columns] for f in folds]
    widths = [len(f.start) for f in folds]
    names = [f"f{i}_{part}" for i, f in enumerate(folds) for part in f.state.split(", ")]

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        kept, made, at = [], [], 0
        for f, own, width in zip(folds, places, widths):
            new, out = f.step(tuple(state[at : at + width]), tuple(row[i] for i in own))
            kept += new
            made += out
            at += width
        return tuple(kept), tuple(made)

    return Fold(columns, ", ".join(names), tuple(v for f in folds for v in f.start), ", ".join(f.outputs for f in folds), step)
