"""Tail probabilities as column expressions: gamma and beta functions, Student's t, the normal, exact rank sums.

Series and continued fractions are folds over a fixed number of terms, so they stay in the JVM; they are meant for result
rows, one per test, not for data rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Lanczos coefficients for g = 7, nine terms.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
LOG_ROOT_TWO_PI = 0.9189385332046727
TINY = 1e-300
TERMS = 400


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5."""
    y = x - 1.0
    terms = reduce(lambda a, b: a + b, [F.lit(c) / (y + i) for i, c in enumerate(LANCZOS) if i], F.lit(LANCZOS[0]))
    t = y + LANCZOS_G + 0.5
    return LOG_ROOT_TWO_PI + (y + 0.5) * F.log(t) - t + F.log(terms)


def _floor(x: Column) -> Column:
    """Keeps a denominator off zero, as the fraction's recurrences ask."""
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz recurrence; converges fast for
    x below (a + 1) / (a + b + 2)."""
    start = F.struct(F.lit(1.0).alias("c"), (1.0 / _floor(1.0 - (a + b) * x / (a + 1.0))).alias("d"), (1.0 / _floor(1.0 - (a + b) * x / (a + 1.0))).alias("h"))

    def half(state: Column, factor: Column) -> Column:
        d = 1.0 / _floor(1.0 + factor * state["d"])
        c = _floor(1.0 + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def both(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return half(half(state, even), odd)

    steps = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, both, lambda state: state["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 0.5."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    low = front * _beta_fraction(x, a, b) / a
    high = 1.0 - front * _beta_fraction(1.0 - x, b, a) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's t with ``dof`` (1 or more) degrees of freedom; NULL where either is."""
    p = beta_share(dof / (dof + t * t), dof / 2.0, F.lit(0.5))
    return F.when(t.isNotNull() & dof.isNotNull(), F.when(t == 0, F.lit(1.0)).otherwise(p))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|): a series near the middle, a continued fraction outside of it."""
    x = F.abs(z)
    density = F.exp(-0.5 * x * x - LOG_ROOT_TWO_PI)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("term"), x.alias("sum")),
        lambda s, k: F.struct((s["term"] * x * x / (2.0 * k.cast("double") + 1.0)).alias("term"), (s["sum"] + s["term"] * x * x / (2.0 * k.cast("double") + 1.0)).alias("sum")),
        lambda s: s["sum"],
    )
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), x, lambda f, k: x + k.cast("double") / f)
    tail = F.when(x < 3.0, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z.isNotNull(), F.least(F.lit(1.0), 2.0 * tail))


def rank_sum_counts(n_a: int, n_b: int) -> list[int]:
    """How many orders of two groups without ties give U = 0, 1, ...: the coefficients of a product of (1 - q^(b + i)) / (1 - q^i)."""
    top = n_a * n_b
    counts = [1] + [0] * top
    for i in range(1, n_a + 1):
        for u in range(top, n_b + i - 1, -1):
            counts[u] -= counts[u - n_b - i]
        for u in range(i, top + 1):
            counts[u] += counts[u - i]
    return counts


#: Up to this many rows per group the exact distribution is used where there are no ties.
EXACT_ROWS = 25


@F.pandas_udf(DoubleType())
def exact_rank_sum_p(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """Two-sided p of U without ties, from all orders; NULL beyond ``EXACT_ROWS`` rows per group."""

    def one(u: float, a: float, b: float) -> float | None:
        if pd.isna(u) or pd.isna(a) or pd.isna(b) or a < 1 or b < 1 or max(a, b) > EXACT_ROWS:
            return None
        counts = rank_sum_counts(int(a), int(b))
        least = int(min(u, a * b - u))
        return min(1.0, 2.0 * sum(counts[: least + 1]) / sum(counts))

    return pd.Series([one(*x) for x in zip(u, n_a, n_b)], dtype="float64")
