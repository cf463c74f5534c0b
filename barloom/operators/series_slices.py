"""Windows over series too long for one task.

Bars are unique per (symbol, day), so a bar series never outgrows its calendar and plain windows are enough. Series
of raw ticks have no such bound and one symbol may hold a large share of all rows. ``slice_series`` numbers the rows of
each symbol without sorting the symbol as a whole, cuts it into slices of equal length and repeats the last ``lookback``
rows of a slice at the start of the next. Any window of at most ``lookback`` earlier rows computed per (symbol, slice)
then equals the window over the whole series on the slice's own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import Layout

SLICE = "_slice"


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "pos") -> DataFrame:
    """Row numbers per key; ``block`` is a coarse monotone function of the first order column (an hour, a month).

    Rows are numbered inside (key, block) and shifted by the counts of the key's earlier blocks.
    """
    keys = list(keys)
    tagged = df.withColumn("_block", block)
    sizes = tagged.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return (
        tagged.withColumn("_in", inside)
        .join(sizes, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_block", "_in", "_before")
    )


def slice_series(numbered: DataFrame, slice_rows: int, lookback: int, pos: str = "pos") -> DataFrame:
    """Add the slice and repeat rows that the next slice looks back to; ``_own`` marks a slice's own rows."""
    if lookback > slice_rows:
        raise ValueError("a slice must be at least as long as the lookback")
    own = F.floor((F.col(pos) - 1) / slice_rows)
    tail = F.pmod(F.col(pos) - 1, F.lit(slice_rows)) >= slice_rows - lookback
    places = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_home", own).withColumn(SLICE, F.explode(places))
    return spread.withColumn("_own", F.col("_home") == F.col(SLICE)).drop("_home")


def windows_by_slice(
    numbered: DataFrame, columns: Callable[[Layout], dict[str, Column]], slice_rows: int, lookback: int,
    keys: Sequence[str] = ("sym",), pos: str = "pos",
) -> DataFrame:
    """Window columns of bounded lookback over a series of any length, computed slice by slice."""
    layout = Layout(keys=(*keys, SLICE), order=pos)
    sliced = slice_series(numbered, slice_rows, lookback, pos)
    return sliced.withColumns(columns(layout)).where("_own").drop("_own", SLICE)
