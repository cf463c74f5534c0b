"""Tail probabilities against tabulated values, closed forms and counted orders."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import tails
from barloom.operators import stats as G


def column(spark, rows, schema, expr):
    return [r["v"] for r in spark.createDataFrame(rows, schema).select("i", expr.alias("v")).orderBy("i").collect()]


def test_t_closed_forms(spark):
    """One, two and four degrees of freedom have closed forms; many approach the normal."""
    ts = [0.0, 0.1, 1.0, 2.5, 12.706204736174698, 60.0]
    rows = [(i, t, d) for i, (t, d) in enumerate(itertools.product(ts, (1.0, 2.0, 4.0)))]
    got = column(spark, rows, "i int, t double, dof double", tails.t_two_sided(F.col("t"), F.col("dof")))

    def exact(t, d):
        if d == 1:
            return 1 - 2 / math.pi * math.atan(t)
        if d == 2:
            return 1 - t / math.sqrt(2 + t * t)
        x = t / math.sqrt(4 + t * t)
        return 1 - (1.5 * x - 0.5 * x**3)

    for (_, t, d), p in zip(rows, got):
        assert p == pytest.approx(exact(t, d), abs=1e-12)
    assert got[rows.index((12, 12.706204736174698, 1.0))] == pytest.approx(0.05, abs=1e-12)


def test_t_tabulated(spark):
    """Two-sided 5 % points."""
    points = [(10, 2.2281388519649385), (30, 2.0422724563012373), (100, 1.98397151844963), (1000, 1.96233908082641)]
    rows = [(i, t, float(d)) for i, (d, t) in enumerate(points)] + [(9, None, 3.0)]
    got = column(spark, rows, "i int, t double, dof double", tails.t_two_sided(F.col("t"), F.col("dof")))
    assert got[:-1] == pytest.approx([0.05] * len(points), abs=1e-9) and got[-1] is None


def test_normal_and_gamma(spark):
    zs = [0.0, 1e-4, 0.5, -1.0, 1.959963984540054, 2.999, 3.001, 5.0, 8.0]
    got = column(spark, list(enumerate(zs)), "i int, z double", tails.normal_two_sided(F.col("z")))
    for z, p in zip(zs, got):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)
    xs = [0.5, 1.0, 1.5, 7.25, 100.0, 5e5]
    got = column(spark, list(enumerate(xs)), "i int, x double", tails.log_gamma(F.col("x")))
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("a, b", [(1, 1), (2, 3), (4, 4), (5, 3)])
def test_rank_sum_counts(a, b):
    counts = [0] * (a * b + 1)
    for places in itertools.combinations(range(a + b), a):
        counts[sum(places) - a * (a - 1) // 2] += 1
    assert tails.rank_sum_counts(a, b) == counts


def test_small_samples_use_all_orders(spark):
    rng = np.random.default_rng(4)
    rows = [("s", "a" if i < 10 else "b", float(x)) for i, x in enumerate(np.r_[rng.normal(1, 1, 10), rng.normal(0, 1, 12)])]
    tied = [("t", g, float(int(x * 2))) for _, g, x in rows]
    got = {r["k"]: r for r in G.mann_whitney(spark.createDataFrame(rows + tied, "k string, g string, x double"), "x", "g", "a", "b", ["k"]).collect()}
    counts = tails.rank_sum_counts(10, 12)
    u = min(got["s"]["u"], 120 - got["s"]["u"])
    assert got["s"]["p"] == pytest.approx(min(1, 2 * sum(counts[: int(u) + 1]) / math.comb(22, 10)), abs=1e-12)
    assert got["t"]["p"] == pytest.approx(math.erfc(abs(got["t"]["z"]) / math.sqrt(2)), rel=1e-9)
