"""Columns that depend on the date only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import col

# First day of the lunar new year.
LUNAR_NEW_YEAR = (
    "1990-01-27", "1991-02-15", "1992-02-04", "1993-01-23", "1994-02-10", "1995-01-31", "1996-02-19", "1997-02-07",
    "1998-01-28", "1999-02-16", "2000-02-05", "2001-01-24", "2002-02-12", "2003-02-01", "2004-01-22", "2005-02-09",
    "2006-01-29", "2007-02-18", "2008-02-07", "2009-01-26", "2010-02-14", "2011-02-03", "2012-01-23", "2013-02-10",
    "2014-01-31", "2015-02-19", "2016-02-08", "2017-01-28", "2018-02-16", "2019-02-05", "2020-01-25", "2021-02-12",
    "2022-02-01", "2023-01-22", "2024-02-10", "2025-01-29", "2026-02-17", "2027-02-06",
)


def date_parts(df: DataFrame, day: str = "d") -> DataFrame:
    """Day of year, ISO week, quarter, day of month and month/quarter edges."""
    d = F.col(day)
    quarter_start = F.trunc(d, "quarter")
    return df.withColumns(
        {
            "day_of_year": F.dayofyear(d),
            "week_of_year": F.weekofyear(d),
            "quarter": F.quarter(d),
            "day_of_month": F.dayofmonth(d),
            "month_start": (F.dayofmonth(d) == 1).cast("int"),
            "month_end": (d == F.last_day(d)).cast("int"),
            "quarter_start": (d == quarter_start).cast("int"),
            "quarter_end": (d == F.date_sub(F.add_months(quarter_start, 3), 1)).cast("int"),
        }
    )


def _is_workday(d: Column) -> Column:
    return F.weekday(d) < 5


def workdays_left(day: Column | str) -> Column:
    """Working days after this one in its month."""
    d = col(day)
    last = F.last_day(d)
    return F.when(d == last, 0).otherwise(F.size(F.filter(F.sequence(F.date_add(d, 1), F.greatest(last, F.date_add(d, 1))), _is_workday)))


def back_workdays(day: Column, n: int) -> Column:
    """The working day n before ``day`` after rolling a weekend back to Friday."""
    base = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    # Steps of five working days are whole weeks.
    weeks, rest = divmod(n, 5)
    moved = F.date_sub(base, 7 * weeks)
    return F.date_sub(moved, F.when(F.weekday(moved) < rest, rest + 2).otherwise(rest))


def first_workday(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) >= 5, 7 - F.weekday(day)).otherwise(0))


def holiday_flag(day: Column | str) -> Column:
    """1 within 10 working days before, or 5 working days from a week after, lunar new year or October 1."""
    d = col(day)
    years = F.sequence(F.year(d) - 1, F.year(d) + 1)
    autumn = F.transform(years, lambda y: F.make_date(y, F.lit(10), F.lit(1)))
    spring = F.array(*[F.lit(x).cast("date") for x in LUNAR_NEW_YEAR])
    holidays = F.concat(spring, autumn)

    def near(h: Column) -> Column:
        before = (d >= back_workdays(h, 10)) & (d < h)
        resume = first_workday(F.date_add(h, 7))
        # Five working days from a working day on always span one whole week.
        return before | ((d >= resume) & (d < F.date_add(resume, 7)))

    return F.exists(holidays, near).cast("double")


def calendar_flags(df: DataFrame, day: str = "d") -> DataFrame:
    d = F.col(day)
    cols = {f"CAL_DOW_{i}": (F.weekday(d) == i).cast("double") for i in range(5)}
    cols |= {f"CAL_MONTH_{m}": (F.month(d) == m).cast("double") for m in range(1, 13)}
    cols["CAL_MONTH_POS"] = workdays_left(d).cast("double")
    cols["CAL_HOLIDAY"] = holiday_flag(d)
    return df.withColumns(cols)
