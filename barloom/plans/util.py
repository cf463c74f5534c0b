"""Small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import rnd
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.sources.bars import adjust, bars_brand_week, bars_supp_month, bars_user_day

SOURCES = {
    "brand_week": (bars_brand_week, S.BRAND_WEEK),
    "supp_month": (bars_supp_month, S.SUPP_MONTH),
    "user_day": (bars_user_day, S.USER_DAY),
}


def shown(df: DataFrame, cols: dict[str, Column], digits: int = 6, keys: tuple[str, ...] = ("sym", "d")) -> DataFrame:
    """Keys (days as text) plus rounded value columns."""
    key_cols = [F.col(k).cast("string").alias(k) if k == "d" else F.col(k) for k in keys]
    return df.select(*key_cols, *[rnd(c, digits).alias(n) for n, c in cols.items()])


def shown_sql(source: str, cols: dict[str, str], digits: int = 6, keys: tuple[str, ...] = ("sym", "d"), tail: str = "") -> str:
    key_cols = [f"CAST({k} AS VARCHAR) AS {k}" if k == "d" else k for k in keys]
    values = [f"{S.r(e, digits)} AS {n}" for n, e in cols.items()]
    return f"SELECT {', '.join([*key_cols, *values])} FROM {source} {tail}"


def panel_query(
    name: str,
    covers: str,
    source: str,
    cols: Callable[[], dict[str, Column]],
    sql_cols: dict[str, str],
    digits: int = 6,
    pre: Callable[[DataFrame], DataFrame] | None = None,
    pre_sql: tuple[str, ...] = (),
    last_cte: str = "adj",
) -> None:
    """Register a query that adds columns to the adjusted bars of one source."""
    build, bars_sql = SOURCES[source]
    sql = S.with_bars(bars_sql, S.adjusted(), *pre_sql) + shown_sql(last_cte, sql_cols, digits)

    @query(name, covers, sql)
    def run(spark, sf_dir):
        panel = adjust(build(spark, sf_dir))
        if pre is not None:
            panel = pre(panel)
        return shown(panel, cols(), digits)
