"""Scalar column helpers. Missing is NULL everywhere; no helper emits NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(num: Column | str, den: Column | str) -> Column:
    """num / den with x/0 and 0/0 as NULL."""
    return F.try_divide(col(num), col(den))


def finite(c: Column | str) -> Column:
    """NaN and infinities to NULL (done once, at the scan)."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def positive(c: Column | str) -> Column:
    c = col(c)
    return F.when(c > 0, c)


def safe_log(c: Column | str) -> Column:
    return F.log(positive(c))


def safe_log1p(c: Column | str) -> Column:
    c = col(c)
    return F.log1p(F.when(c > -1, c))


def safe_sqrt(c: Column | str) -> Column:
    """sqrt of a negative number is NULL, not NaN."""
    c = col(c)
    return F.sqrt(F.when(c >= 0, c))


def flag(cond: Column) -> Column:
    """Boolean to 1.0/0.0, unknown stays NULL."""
    return F.when(cond, 1.0).when(~cond, 0.0)


def greatest_strict(*cols: Column | str) -> Column:
    """greatest() that is NULL when any input is NULL (Spark's own skips NULL)."""
    cs = [col(c) for c in cols]
    known = cs[0].isNotNull()
    for c in cs[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cs))


def least_strict(*cols: Column | str) -> Column:
    cs = [col(c) for c in cols]
    known = cs[0].isNotNull()
    for c in cs[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.least(*cs))


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Half-up rounding by floor, in plain double arithmetic (stays in codegen, no decimal detour)."""
    scale = float(10**digits)
    return F.floor(col(c) * scale + 0.5) / scale


def clip(c: Column | str, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


def to_day(c: Column | str) -> Column:
    """Dates given as date, timestamp, ISO text or yyyyMMdd text; bad text is NULL."""
    c = col(c)
    text = c.cast("string")
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.expr("NULL").cast("date"), c.try_cast("date"))


def day_number(c: Column | str) -> Column:
    return F.unix_date(col(c))


def board_limit(code: Column | str, day: Column | str) -> Column:
    """Daily price limit in percent by board."""
    code, day = col(code).cast("string"), col(day)
    growth = code.startswith("300") | code.startswith("301")
    return (
        F.when(code.endswith(".BJ"), 30.0)
        .when(code.startswith("688"), 20.0)
        .when(growth & (day >= F.lit("2020-08-24").cast("date")), 20.0)
        .otherwise(10.0)
    )


def name_status(name: Column | str) -> Column:
    """Listing status told by a security name: 3 delisting, 2 starred, 1 special treatment, 0 normal."""
    n = F.translate(F.upper(F.trim(col(name))), "＊　 ", "*")
    return (
        F.when(n.contains("退"), 3.0).when(n.contains("*ST"), 2.0).when(n.contains("ST"), 1.0).otherwise(0.0)
    )


# Fixed values of the fee schedule.
COMMISSION_RATE = 0.00025
COMMISSION_MIN = 5.0
STAMP_OLD = 0.001
STAMP_NEW = 0.0005
STAMP_CHANGE = "2023-08-28"
SLIPPAGE = 0.001
LOT = 100


def commission(amount: Column | str) -> Column:
    return F.greatest(F.lit(COMMISSION_MIN), col(amount) * COMMISSION_RATE)


def stamp_rate(day: Column | str) -> Column:
    return F.when(col(day) < F.lit(STAMP_CHANGE).cast("date"), STAMP_OLD).otherwise(STAMP_NEW)


def lot_shares(cash: Column | str, price: Column | str) -> Column:
    """Whole lots that ``cash`` buys at ``price``."""
    return F.floor(sdiv(cash, price) / LOT) * LOT
