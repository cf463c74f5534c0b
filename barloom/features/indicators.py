"""Indicators that are plain windows (bands, stochastic)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import BARS, Layout
from barloom.functions.scalar import sdiv


def stochastic(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Stochastic (5, 3, 3): adds ``fastk``, ``slowk`` and ``slowd``; a flat range gives 0."""
    low, high = layout.agg("min", "low", 5), layout.agg("max", "high", 5)
    raw = F.when(low.isNotNull(), 100.0 * F.coalesce(sdiv(F.col("close") - low, high - low), F.lit(0.0)))
    return (
        df.withColumn("fastk", raw)
        .withColumn("slowk", layout.agg("mean", "fastk", 3))
        .withColumn("slowd", layout.agg("mean", "slowk", 3))
    )
