"""Named date ranges (train, validation, test, embargo) and their integrity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import col


@dataclass(frozen=True)
class Segments:
    """Ordered (name, first, last); the first range that holds a day names it, so overrides come first."""

    ranges: tuple[tuple[str, str | None, str | None], ...]

    @classmethod
    def of(cls, **ranges: tuple[str | None, str | None]) -> "Segments":
        return cls(tuple((n, lo, hi) for n, (lo, hi) in ranges.items()))

    def column(self, day: Column | str) -> Column:
        day = col(day)
        out = F.lit(None).cast("string")
        for name, lo, hi in reversed(self.ranges):
            inside = F.lit(True)
            if lo is not None:
                inside = inside & (day >= F.lit(lo).cast("date"))
            if hi is not None:
                inside = inside & (day <= F.lit(hi).cast("date"))
            out = F.when(inside, F.lit(name)).otherwise(out)
        return out


def segment_integrity(
    df: DataFrame, calendar: DataFrame, rule: Segments, pairs: tuple[tuple[str, str], ...], min_gap: int = 30,
    seg: str = "seg", day: str = "d", banned: str = "embargo",
) -> DataFrame:
    """One row of findings: rows whose segment breaks the rule, rows in the embargo, and calendar days between segments."""
    spans = {name: F.min(F.when(F.col(seg) == name, F.col("cal_pos"))).alias(f"lo_{name}") for pair in pairs for name in pair}
    ends = {name: F.max(F.when(F.col(seg) == name, F.col("cal_pos"))).alias(f"hi_{name}") for pair in pairs for name in pair}
    stats = df.join(F.broadcast(calendar), day, "left").agg(
        F.count_if(~F.col(seg).eqNullSafe(rule.column(day))).alias("wrong_segment"),
        F.count_if(F.col(seg) == banned).alias("in_embargo"),
        *spans.values(),
        *ends.values(),
    )
    gaps = [(F.col(f"lo_{b}") - F.col(f"hi_{a}") - 1).alias(f"gap_{a}_{b}") for a, b in pairs]
    wide_enough = F.lit(True)
    for a, b in pairs:
        wide_enough = wide_enough & (F.col(f"lo_{b}") - F.col(f"hi_{a}") - 1 >= min_gap)
    return stats.select("wrong_segment", "in_embargo", *gaps, wide_enough.alias("gaps_ok"))
