"""Window values of whole series as numpy arrays: what a task computes for all its series at once.

A batch holds many series one after the other. Shifting the whole column by k rows gives the k-th value of every
window, so each operator is a handful of vector steps per shift, and rows whose window reaches into the series before
are told apart by their row number.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_series(batches: Iterable[pa.RecordBatch], row: str = "_row") -> Iterator[pa.Table]:
    """Batches of sorted series, cut anew so that none splits a series. ``row`` is 1 where a series begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(row).to_numpy() == 1)
        if len(starts):
            cut = int(starts[-1])
            done = [b for b in [*held, batch.slice(0, cut)] if b.num_rows]
            if done:
                yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def window_values(x: np.ndarray, row: np.ndarray, w: int, ops: Collection[str]) -> dict[str, np.ndarray]:
    """Operators over the last ``w`` rows of each row's series, oldest first; NaN unless all ``w`` are known.

    REF and DELTA look ``w`` rows back and need only the rows they read.
    """
    n = len(x)
    padded = np.concatenate([np.full(w - 1, np.nan), x])
    shifts = [padded[k : k + n] for k in range(w)]
    missing = np.concatenate([[0], np.cumsum(np.isnan(padded))])
    full = (row >= w) & (missing[w:] - missing[:-w] == 0)
    out: dict[str, np.ndarray] = {}

    total = sum(shifts[1:], shifts[0])
    out |= {"SUM": total, "MEAN": total / w, "COUNT": sum((s > 0 for s in shifts), np.zeros(n)) / w}
    if not {"STD", "SKEW", "KURT", "SLOPE", "RSQ", "RESI"}.isdisjoint(ops):
        out |= _moments(shifts, out["MEAN"], x)
    if not {"MAX", "MIN", "MED", "Q20", "Q80"}.isdisjoint(ops):
        ordered = np.sort(np.lib.stride_tricks.sliding_window_view(padded, w), axis=1)
        out |= {"MAX": ordered[:, w - 1], "MIN": ordered[:, 0]}
        out |= {op: _interpolated(ordered, w, q) for op, q in (("MED", 0.5), ("Q20", 0.2), ("Q80", 0.8))}
    if "TSRANK" in ops:
        out["TSRANK"] = (sum((s < x for s in shifts), np.zeros(n)) + sum((s == x for s in shifts), np.zeros(n)) * 0.5) / w
    if "IDXMAX" in ops:
        out["IDXMAX"] = _rows_since_oldest_best(shifts, np.greater)
    if "IDXMIN" in ops:
        out["IDXMIN"] = _rows_since_oldest_best(shifts, np.less)
    if "WMA" in ops:
        out["WMA"] = sum((s * (k + 1.0) for k, s in enumerate(shifts)), np.zeros(n)) / (w * (w + 1) / 2.0)
    out = {op: np.where(full, values, np.nan) for op, values in out.items()}
    back = np.concatenate([np.full(min(w, n), np.nan), x[: max(n - w, 0)]])
    out["REF"] = np.where(row > w, back, np.nan)
    out["DELTA"] = x - out["REF"]
    return out


def _moments(shifts: list[np.ndarray], mean: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Spread, shape and the straight line of a window by running updates, as the engine's aggregates do them value by
    value: equal values have no spread at all, and results agree with those aggregates to the last digits."""
    w = len(shifts)
    avg, m2, m3, m4, sxy, syy = (np.zeros(len(x)) for _ in range(6))
    for k, y in enumerate(shifts):
        n = k + 1.0
        step = y - avg
        share = step / n
        avg = avg + share
        rest = y - avg
        m2 = m2 + step * (step - share)
        m3 = m3 - 3.0 * share * m2 + step * (step * step - share * share)
        m4 = m4 - 4.0 * share * m3 - 6.0 * share * share * m2 + step * (step * step * step - share * share * share)
        # Rows are numbered 0, 1, 2, ..., so a new one stands (k + 1) / 2 above the mean of those before.
        sxy, syy = sxy + (n / 2.0 if k else 0.0) * rest, syy + step * rest
    sxx = w * (w * w - 1) / 12.0
    spread, slope = np.where(m2 > 0, m2, np.nan), sxy / sxx
    r = sxy / np.sqrt(sxx * np.where(syy > 0, syy, np.nan))
    return {
        "STD": np.sqrt(m2 / w), "SKEW": np.sqrt(w) * m3 / np.sqrt(spread * spread * spread), "KURT": w * m4 / (spread * spread) - 3.0,
        "SLOPE": slope, "RSQ": r * r, "RESI": x - (mean + slope * ((w - 1) / 2.0)),
    }


def _interpolated(ordered: np.ndarray, w: int, q: float) -> np.ndarray:
    place = q * (w - 1)
    lo = int(place)
    low = ordered[:, lo]
    return low if place == lo else low + (ordered[:, lo + 1] - low) * (place - lo)


def _rows_since_oldest_best(shifts: list[np.ndarray], better) -> np.ndarray:
    """Rows after the oldest of the best values, as a share of the window."""
    w, best, at = len(shifts), shifts[0], np.zeros(len(shifts[0]))
    for k, s in enumerate(shifts[1:], 1):
        found = better(s, best)
        best, at = np.where(found, s, best), np.where(found, k, at)
    return (w - (at + 1)) / w
