"""Recursions along one series: exponential smoothing, MACD, Wilder indicators, KDJ, zigzag lows.

A recursion has no finite frame, so these run once per symbol on Arrow batches, several columns in one
pass. A group is one symbol's bars, unique per period, so its size is bounded by the calendar. The loops
inside are pandas' compiled ``ewm``; only the zigzag automaton steps row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, NumericType, StructField, StructType

from barloom.functions.series_arrays import whole_series

# Indicator lengths.
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9


@dataclass(frozen=True)
class Recursion:
    """``outputs`` columns made by ``step(group) -> dict of arrays`` from one symbol's ordered rows."""

    outputs: tuple[str, ...]
    step: Callable[[Mapping[str, np.ndarray]], dict[str, np.ndarray]] = field(compare=False)


def add_recursions(
    df: DataFrame, recursions: Sequence[Recursion], keys: Sequence[str] = ("sym",), order: str = "d"
) -> DataFrame:
    """Append the outputs of all recursions in one Arrow pass over sorted series (one shuffle by the series key).

    A task takes the many short series of a batch as arrays at once; a grouped call for each would cost more than its rows.
    """
    outputs = [o for r in recursions for o in r.outputs]
    schema = StructType([*df.schema.fields, *[StructField(o, DoubleType()) for o in outputs]])
    names = [f.name for f in schema.fields]
    df_columns = df.columns
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            columns = {c: table.column(c).to_numpy().astype(np.float64) for c in numbers}
            starts = np.flatnonzero(table.column("_row").to_numpy() == 1).tolist()
            made = {o: np.full(table.num_rows, np.nan) for o in outputs}
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                group = {c: x[a:b] for c, x in columns.items()}
                for r in recursions:
                    for o, values in r.step(group).items():
                        made[o][a:b] = values
            kept = [table.column(c).combine_chunks() for c in df_columns]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, mask=np.isnan(v)) for v in made.values()]], names)

    # The window of the row number is the last step before the pass: it brings the series together in order.
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.mapInArrow(run, schema)


def _values(group: Mapping[str, np.ndarray | pd.Series], name: str) -> np.ndarray:
    x = group[name]
    return x if isinstance(x, np.ndarray) else x.to_numpy(dtype=np.float64, na_value=np.nan)


def _smooth_from(x: np.ndarray, start: int, seed: float, alpha: float) -> np.ndarray:
    """y[start] = seed, then y = y + alpha * (x - y); NaN before ``start``."""
    out = np.full(len(x), np.nan)
    if start < len(x):
        chain = np.concatenate([[seed], x[start + 1 :]])
        out[start:] = pd.Series(chain).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def ema(src: str, w: int, out: str, min_known: int | None = None) -> Recursion:
    """alpha = 2/(w+1), seeded with the first known value, shown once ``min_known`` values are known."""

    def step(g):
        s = pd.Series(_values(g, src))
        need = w if min_known is None else min_known
        return {out: s.ewm(alpha=2.0 / (w + 1), adjust=False, min_periods=need).mean().to_numpy()}

    return Recursion((out,), step)


def smoothed(src: str, alpha: float, out: str) -> Recursion:
    def step(g):
        return {out: pd.Series(_values(g, src)).ewm(alpha=alpha, adjust=False).mean().to_numpy()}

    return Recursion((out,), step)


def macd_arrays(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fast ema, slow ema, dif, dea). Averages start at row 25, the signal line at row 33."""
    n, first = len(close), MACD_SLOW - 1
    blank = np.full(n, np.nan)
    if n < MACD_SLOW:
        return blank, blank.copy(), blank.copy(), blank.copy()
    fast = _smooth_from(close, first, close[MACD_SLOW - MACD_FAST : MACD_SLOW].mean(), 2.0 / (MACD_FAST + 1))
    slow = _smooth_from(close, first, close[:MACD_SLOW].mean(), 2.0 / (MACD_SLOW + 1))
    dif = fast - slow
    start = first + MACD_SIGNAL - 1
    if n <= start:
        return fast, slow, dif, blank
    dea = _smooth_from(dif, start, dif[first : start + 1].mean(), 2.0 / (MACD_SIGNAL + 1))
    return fast, slow, dif, dea


def macd(src: str = "ac", prefix: str = "") -> Recursion:
    """dif, dea and the inner averages ``e12``/``e26``; dif and dea show from row 33."""
    outs = tuple(prefix + n for n in ("dif", "dea", "e12", "e26"))

    def step(g):
        fast, slow, dif, dea = macd_arrays(_values(g, src))
        shown = np.where(np.isnan(dea), np.nan, dif)
        return dict(zip(outs, (shown, dea, fast, slow)))

    return Recursion(outs, step)


def rsi(src: str, n: int, out: str) -> Recursion:
    """Wilder's index: averages of gains and losses seeded with their first n-row mean; 0 when both are 0."""

    def step(g):
        x = _values(g, src)
        move = np.diff(x, prepend=np.nan)
        if len(x) <= n:
            return {out: np.full(len(x), np.nan)}
        up, down = np.where(move > 0, move, 0.0), np.where(move < 0, -move, 0.0)
        gain = _smooth_from(up, n, up[1 : n + 1].mean(), 1.0 / n)
        loss = _smooth_from(down, n, down[1 : n + 1].mean(), 1.0 / n)
        both = gain + loss
        share = np.divide(gain, both, out=np.zeros(len(x)), where=both > 0)
        return {out: np.where(np.isnan(both), np.nan, 100.0 * share)}

    return Recursion((out,), step)


def atr(high: str, low: str, close: str, n: int, out: str) -> Recursion:
    """Wilder's average true range, first shown at row n."""

    def step(g):
        h, lo, c = _values(g, high), _values(g, low), _values(g, close)
        prev = np.concatenate([[np.nan], c[:-1]])
        tr = np.maximum(h - lo, np.maximum(np.abs(h - prev), np.abs(lo - prev)))
        if len(tr) <= n:
            return {out: np.full(len(tr), np.nan)}
        return {out: _smooth_from(tr, n, tr[1 : n + 1].mean(), 1.0 / n)}

    return Recursion((out,), step)


def kdj(rsv: str = "rsv9") -> Recursion:
    def step(g):
        k = pd.Series(_values(g, rsv)).ewm(alpha=1.0 / 3.0, adjust=False).mean()
        d = k.ewm(alpha=1.0 / 3.0, adjust=False).mean()
        return {"kdj_k": k.to_numpy(), "kdj_d": d.to_numpy(), "kdj_j": (3.0 * k - 2.0 * d).to_numpy()}

    return Recursion(("kdj_k", "kdj_d", "kdj_j"), step)


@dataclass
class ZigzagLegs:
    """Legs that wait for their end, as [sign, extreme, position]: sign 1 looks for a low, -1 for a high.

    Mirrored by its sign, a leg is always one that falls to a lowest price and ends on the first row that stands
    ``pct`` above it; the next leg runs the other way from that row. Before the first end both directions are open.
    What is open is all there is to remember, in a batch pass and as streaming state.
    """

    open: list[tuple[int, float, int]]

    @staticmethod
    def _followed(leg: tuple[int, float, int], price: float, pos: int, pct: float) -> tuple[tuple[int, float, int], bool]:
        sign, extreme, _ = leg
        if sign * price < sign * extreme:
            return (sign, price, pos), False
        return leg, sign * price >= sign * (extreme * (1.0 + sign * pct))

    def push(self, price: float, pos: int, pct: float) -> int | None:
        """Take the next row; returns the position of a low that this row confirms."""
        if not self.open:
            self.open = [(1, price, pos), (-1, price, pos)]
            return None
        for i, leg in enumerate(self.open):
            self.open[i], ended = self._followed(leg, price, pos, pct)
            if ended:
                self.open = [(-leg[0], price, pos)]
                return leg[2] if leg[0] > 0 else None
        return None


def zigzag_lows(df: DataFrame, price: str, pct: float, key: str = "sym", pos: str = "pos") -> DataFrame:
    """(key, low_pos, sig_pos): a low is confirmed on the row that rebounds ``pct`` from it."""
    schema = StructType(
        [df.schema[key], StructField("low_pos", LongType()), StructField("sig_pos", LongType())]
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(pos, kind="mergesort")
        legs, found = ZigzagLegs([]), []
        for p, i in zip(group[price].to_numpy(float).tolist(), group[pos].to_numpy().tolist()):
            low = legs.push(p, i, pct)
            if low is not None:
                found.append((low, i))
        return pd.DataFrame(
            {key: group[key].iloc[0], "low_pos": [f[0] for f in found], "sig_pos": [f[1] for f in found]}
        )

    return df.select(key, pos, price).groupBy(key).applyInPandas(run, schema)
