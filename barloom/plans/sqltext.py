"""Shared SQL fragments for the comparison queries (DuckDB dialect)."""

from __future__ import annotations

FILL_KEY = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
PX = "l_extendedprice / l_quantity"


def r(expr: str, digits: int = 6) -> str:
    scale = float(10**digits)
    return f"(floor(({expr}) * {scale!r}::DOUBLE + 0.5::DOUBLE) / {scale!r}::DOUBLE)"


def _bars(sym: str, unit: str, source: str, where: str = "") -> str:
    return f"""SELECT {sym} AS sym, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS d,
 arg_min({PX}, {FILL_KEY}) AS open, max({PX}) AS high, min({PX}) AS low, arg_max({PX}, {FILL_KEY}) AS close,
 sum(l_quantity) AS vol, {r('sum(l_extendedprice)', 2)} AS amount, count(*) AS n
 FROM {source} {where} GROUP BY 1, 2"""


BRAND_WEEK = _bars("p_brand", "week", "lineitem JOIN part ON l_partkey = p_partkey")
SUPP_MONTH = _bars("l_suppkey", "month", "lineitem")
USER_DAY = f"""SELECT user_id AS sym, CAST(ts AS DATE) AS d,
 arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS vol,
 {r('sum(value)', 2)} AS amount, count(*) AS n
 FROM events WHERE value > 0 GROUP BY 1, 2"""
INDEX_WEEK = _bars("'ALL'", "week", "lineitem JOIN part ON l_partkey = p_partkey")


def index_of(prefix: str) -> str:
    return _bars(
        f"'{prefix}'", "week", "lineitem JOIN part ON l_partkey = p_partkey", f"WHERE starts_with(p_type, '{prefix}')"
    )


W = "PARTITION BY sym ORDER BY d"


def last(w: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def past() -> str:
    return f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def whole() -> str:
    return f"OVER ({W})"


def full(fn: str, x: str, w: int) -> str:
    """fn over the last w rows when all are known. {x} may be an expression."""
    return f"CASE WHEN count({x}) {last(w)} = {w} THEN {fn}({x}) {last(w)} END"


def strict(value: str, x: str, w: int) -> str:
    return f"CASE WHEN count({x}) {last(w)} = {w} THEN {value} END"


def ref(x: str, k: int) -> str:
    return f"lag({x}, {k}) {whole()}"


def lead(x: str, k: int) -> str:
    return f"lead({x}, {k}) {whole()}"


def adjusted(bars: str = "bars") -> str:
    """CTE chain b0, b1, adj over a CTE called ``bars``: the adjusted series."""
    return f"""b0 AS (SELECT *, lag(close) {whole()} AS pre_close, row_number() {whole()} AS pos FROM {bars}),
b1 AS (SELECT *, (close / nullif(pre_close, 0) - 1.0::DOUBLE) * 100.0::DOUBLE AS pct FROM b0),
b2 AS (SELECT *, pct / 100.0::DOUBLE AS r FROM b1),
b3 AS (SELECT *, product(1.0::DOUBLE + coalesce(r, 0.0::DOUBLE)) {past()} AS cf FROM b2),
adj AS (SELECT *, cf AS ac, open * (cf / close) AS ao, high * (cf / close) AS ah, low * (cf / close) AS al FROM b3)"""


def with_bars(bars: str, *ctes: str) -> str:
    """WITH bars AS (...), ctes..."""
    return "WITH RECURSIVE " + ",\n".join([f"bars AS ({bars})", *ctes]) + "\n"
