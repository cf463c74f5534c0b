"""Window primitives over one ordered series per key.

All frames count rows, never calendar days. ``strict`` frames give a value only when all ``w`` rows
of the frame are present and not NULL; ``minp`` frames need ``mp`` non-NULL rows.
Every primitive of one layout shares the same partitioning and order, so Spark runs them in one
shuffle and one sort however many columns are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalar import col, greatest_strict, safe_sqrt, sdiv


@dataclass(frozen=True)
class Layout:
    """Keys that isolate one series and the column that orders it."""

    keys: tuple[str, ...] = ("sym",)
    order: str = "d"

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def past(self) -> WindowSpec:
        return self.whole().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.whole().rowsBetween(Window.unboundedPreceding, -1)

    def last(self, w: int) -> WindowSpec:
        return self.whole().rowsBetween(-(w - 1), 0)

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.whole().rowsBetween(lo, hi)

    # ---- shifts
    def pos(self) -> Column:
        return F.row_number().over(self.whole())

    def ref(self, x: Column | str, k: int) -> Column:
        return F.lag(col(x), k).over(self.whole())

    def lead(self, x: Column | str, k: int) -> Column:
        return F.lead(col(x), k).over(self.whole())

    def delta(self, x: Column | str, k: int = 1) -> Column:
        return col(x) - self.ref(x, k)

    def diff2(self, x: Column | str) -> Column:
        return col(x) - 2.0 * self.ref(x, 1) + self.ref(x, 2)

    def pct_change(self, x: Column | str, k: int = 1) -> Column:
        return sdiv(x, self.ref(x, k)) - 1.0

    # ---- gates
    def strict(self, value: Column, x: Column | str, w: int) -> Column:
        return F.when(F.count(col(x)).over(self.last(w)) == w, value)

    def minp(self, value: Column, x: Column | str, w: int, mp: int) -> Column:
        return F.when(F.count(col(x)).over(self.last(w)) >= mp, value)

    def agg(self, fn: str, x: Column | str, w: int, mp: int | None = None) -> Column:
        """mean, sum, std (ddof 1), pstd (ddof 0), var, min, max, count over the last ``w`` rows."""
        x = col(x)
        value = _AGGS[fn](x).over(self.last(w))
        return self.strict(value, x, w) if mp is None else self.minp(value, x, w, mp)

    def quantile(self, x: Column | str, w: int, q: float) -> Column:
        x = col(x)
        return self.strict(F.percentile(x, F.lit(q)).over(self.last(w)), x, w)

    # ---- higher moments
    def skew_pop(self, x: Column | str, w: int) -> Column:
        x = col(x)
        return self.strict(F.skewness(x).over(self.last(w)), x, w)

    def kurt_pop(self, x: Column | str, w: int) -> Column:
        x = col(x)
        return self.strict(F.kurtosis(x).over(self.last(w)), x, w)

    def skew_unbiased(self, x: Column | str, w: int) -> Column:
        return self.skew_pop(x, w) * F.lit((w * (w - 1)) ** 0.5 / (w - 2))

    def kurt_unbiased(self, x: Column | str, w: int) -> Column:
        scale = (w - 1.0) / ((w - 2.0) * (w - 3.0))
        return ((w + 1.0) * self.kurt_pop(x, w) + 6.0) * scale

    # ---- lines through the window
    def slope(self, x: Column | str, w: int, pos: str = "pos") -> Column:
        """Least-squares slope of x against 0..w-1."""
        x = col(x)
        return self.strict(F.regr_slope(x, col(pos).cast("double")).over(self.last(w)), x, w)

    def rsquare(self, x: Column | str, w: int, pos: str = "pos") -> Column:
        x = col(x)
        frame = self.last(w)
        spread = F.var_pop(x).over(frame)
        return self.strict(
            F.when(spread > 0, F.regr_r2(x, col(pos).cast("double")).over(frame)), x, w
        )

    def end_residual(self, x: Column | str, w: int, pos: str = "pos") -> Column:
        """Last value minus the fitted line at the last row."""
        x = col(x)
        return x - (self.agg("mean", x, w) + self.slope(x, w, pos) * ((w - 1) / 2.0))

    def decay_mean(self, x: Column | str, w: int, pos: str = "pos") -> Column:
        """Weighted mean with weights 1..w, newest heaviest, from two window sums."""
        x, pos = col(x), col(pos)
        frame = self.last(w)
        weighted = F.sum(x * pos).over(frame) - (pos - w) * F.sum(x).over(frame)
        return self.strict(weighted / (w * (w + 1) / 2.0), x, w)

    # ---- ranks and extremes
    def ts_rank(self, x: Column | str, w: int) -> Column:
        """(less + ties/2) / w of the newest value inside its own full window."""
        x = col(x)
        values = F.collect_list(x).over(self.last(w))
        return self.strict(_rank_share(values, x), x, w)

    def ts_rank_known(self, x: Column | str, w: int, mp: int) -> Column:
        """Same rank over the known values only; needs ``mp`` of them and a known newest value."""
        x = col(x)
        values = F.collect_list(x).over(self.last(w))
        return F.when(x.isNotNull() & (F.size(values) >= mp), _rank_share(values, x))

    def percentile_of_previous(self, x: Column | str, w: int) -> Column:
        """Share (0..100) of the previous ``w`` values below x, ties half; x itself is left out."""
        x = col(x)
        values = F.collect_list(x).over(self.rows(-w, -1))
        return F.when(F.size(values) == w, _rank_share(values, x) * 100.0)

    def since_extreme(self, x: Column | str, w: int, kind: str, pos: str = "pos") -> Column:
        """Rows since the window maximum or minimum; the oldest of equal extremes counts."""
        x = col(x)
        key = -x if kind == "max" else x
        first = F.min(F.struct(key.alias("v"), col(pos).alias("p"))).over(self.last(w))
        return self.strict((col(pos) - first["p"]).cast("double"), x, w)

    def topk_mean(self, x: Column | str, w: int, k: int) -> Column:
        x = col(x)
        top = F.slice(F.sort_array(F.collect_list(x).over(self.last(w)), asc=False), 1, k)
        total = F.aggregate(top, F.lit(0.0), lambda a, v: a + v)
        return self.strict(total / float(k), x, w)

    # ---- runs
    def streak(self, cond: Column, pos: str = "pos") -> Column:
        """Consecutive true rows ending here; 0 on a false or unknown row."""
        broken = F.when(~F.coalesce(cond, F.lit(False)), col(pos))
        return (col(pos) - F.coalesce(F.max(broken).over(self.past()), F.lit(0))).cast("double")

    def streak_known(self, x: Column | str, pos: str = "pos") -> Column:
        """Streak of ones in a 0/1/NULL column: NULL breaks the run and stays NULL."""
        x = col(x)
        return F.when(x.isNotNull(), self.streak(x == 1, pos))

    # ---- pairs
    def moments(self, x: Column | str, y: Column | str, w: int) -> tuple[Column, Column, Column, Column]:
        """(all pairs known, covariance, variance of x, variance of y); population moments."""
        x, y = col(x), col(y)
        pair = x.isNotNull() & y.isNotNull()
        px, py = F.when(pair, x), F.when(pair, y)
        frame = self.last(w)
        full = F.count(px).over(frame) == w
        return full, F.covar_pop(px, py).over(frame), F.var_pop(px).over(frame), F.var_pop(py).over(frame)

    def cov_pop(self, x: Column | str, y: Column | str, w: int) -> Column:
        full, cov, _, _ = self.moments(x, y, w)
        return F.when(full, cov)

    def corr(self, x: Column | str, y: Column | str, w: int) -> Column:
        """Not the built-in ``corr``: that one fails on a constant window."""
        full, cov, vx, vy = self.moments(x, y, w)
        return F.when(full, sdiv(cov, F.sqrt(vx) * F.sqrt(vy)))

    def residual_std(self, y: Column | str, x: Column | str, w: int) -> Column:
        """Standard deviation of what a straight line in x leaves of y, from window moments."""
        full, cov, vy, vx = self.moments(y, x, w)
        return F.when(full, safe_sqrt(vy - sdiv(cov * cov, vx)))

    # ---- derived
    def conditional(self, fn: str, cond: Column, y: Column | str, w: int) -> Column:
        """Aggregate of y over the rows of the frame where ``cond`` holds (no gate)."""
        return _AGGS[fn](F.when(cond, col(y))).over(self.last(w))

    def robust_z(self, x: Column | str, w: int) -> Column:
        """(x - median) / (IQR / 1.34896), at least max(10, w/2) known rows."""
        x = col(x)
        frame = self.last(w)
        q1, q2, q3 = (F.percentile(x, F.lit(q)).over(frame) for q in (0.25, 0.5, 0.75))
        spread = F.when(q3 - q1 == 0, 1e-9).otherwise((q3 - q1) / 1.34896)
        return self.minp((x - q2) / spread, x, w, max(10, w // 2))

    def cv(self, x: Column | str, w: int) -> Column:
        """Coefficient of variation, 0 where the mean is not positive."""
        x = col(x)
        mean = F.avg(x).over(self.last(w))
        return self.strict(
            F.when(mean > 0, F.stddev_samp(x).over(self.last(w)) / mean).otherwise(0.0), x, w
        )

    def true_range(self, high: str, low: str, close: str) -> Column:
        """max(h-l, |h-pc|, |l-pc|); h-l on the first row."""
        prev = self.ref(close, 1)
        spread = col(high) - col(low)
        wide = greatest_strict(spread, F.abs(col(high) - prev), F.abs(col(low) - prev))
        return F.when(prev.isNull(), spread).otherwise(wide)

    def obv(self, close: str, vol: str) -> Column:
        """Running signed volume; the first row counts as up."""
        prev = self.ref(close, 1)
        step = F.when(prev.isNull(), col(vol)).otherwise(F.signum(col(close) - prev) * col(vol))
        return F.sum(step).over(self.past())

    def drawdown(self, x: Column | str) -> Column:
        return sdiv(x, F.max(col(x)).over(self.past())) - 1.0

    def forward(self, fn: str, x: Column | str, lo: int, hi: int) -> Column:
        """Aggregate over the rows lo..hi after this one; NULL unless all are present."""
        x = col(x)
        frame = self.rows(lo, hi)
        return F.when(F.count(x).over(frame) == hi - lo + 1, _AGGS[fn](x).over(frame))

    def frac_diff(self, x: Column | str, d: float, threshold: float, limit: int = 10_000) -> Column:
        """Fixed-width fractional difference: a dot product with weights cut at ``threshold``."""
        weights = frac_weights(d, threshold, limit)
        x = col(x)
        n = len(weights)
        values = F.collect_list(x).over(self.last(n))
        oldest_first = F.array(*[F.lit(v) for v in reversed(weights)])
        dot = F.aggregate(
            F.zip_with(values, oldest_first, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v
        )
        return self.strict(dot, x, n)


def frac_weights(d: float, threshold: float, limit: int = 10_000) -> list[float]:
    """1, -d, d(d-1)/2, ... until the next weight is below ``threshold`` in size."""
    weights = [1.0]
    while len(weights) < limit:
        k = len(weights)
        nxt = weights[-1] * (k - 1 - d) / k
        if abs(nxt) < threshold:
            break
        weights.append(nxt)
    return weights


def _rank_share(values: Column, x: Column) -> Column:
    less = F.size(F.filter(values, lambda v: v < x))
    ties = F.size(F.filter(values, lambda v: v == x))
    return (less + ties * 0.5) / F.size(values)


_AGGS = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "pstd": F.stddev_pop,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}

BARS = Layout()
