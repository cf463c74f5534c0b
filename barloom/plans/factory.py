"""Generated features, checked per field class against window SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.features import factory as FX
from barloom.functions.rolling import BARS as B
from barloom.functions.scalar import rnd, sdiv
from barloom.plans import sqltext as S
from barloom.plans.registry import query
from barloom.plans.sqltext import full, last, ref, strict
from barloom.plans.util import shown, shown_sql
from barloom.plans.windows import _skew_pop, corr_sql, slope_sql, ts_rank_sql
from barloom.sources.bars import adjust, bars_brand_week, bars_supp_month, index_bars

FIELD_SQL = """fields AS (SELECT sym, d, pos, open, high, low, close, ao AS OPEN_, ah AS HIGH_, al AS LOW_, ac AS CLOSE_, cf,
 amount / nullif(vol, 0) AS VWAP, vol AS V, amount AS A, ln(vol + 1.0) AS LOGV, r AS R_, open / pre_close - 1.0 AS RETON,
 close / open - 1.0 AS RETID, high / low AS HLR FROM adj)"""
SQL_NAME = {"OPEN": "OPEN_", "HIGH": "HIGH_", "LOW": "LOW_", "CLOSE": "CLOSE_", "R": "R_", "CF": "cf"}


def ema_sql(x: str, w: int) -> str:
    """Fold of the known values so far, oldest first."""
    a = 2.0 / (w + 1)
    known = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {S.past()}"
    return (
        f"CASE WHEN count({x}) {S.past()} >= {w} THEN list_reduce({known}, lambda ee, zz: ee * {1 - a!r}::DOUBLE + zz * "
        f"{a!r}::DOUBLE) END"
    )


def op_sql(op: str, x: str, w: int) -> str:
    spread = strict(f"CASE WHEN var_pop({x}) {last(w)} > 0 THEN regr_r2({x}, pos) {last(w)} END", x, w)
    vals = f"list({x}) {last(w)}"
    table = {
        "MEAN": full("avg", x, w), "STD": full("stddev_pop", x, w), "MAX": full("max", x, w), "MIN": full("min", x, w),
        "MED": strict(f"quantile_cont({x}, 0.5) {last(w)}", x, w),
        "Q20": strict(f"quantile_cont({x}, 0.2) {last(w)}", x, w),
        "Q80": strict(f"quantile_cont({x}, 0.8) {last(w)}", x, w),
        "SKEW": _skew_pop(x, w), "KURT": strict(f"kurtosis_pop({x}) {last(w)}", x, w),
        "TSRANK": ts_rank_sql(x, w),
        "IDXMAX": strict(f"({w} - list_position({vals}, max({x}) {last(w)})) / {w}::DOUBLE", x, w),
        "IDXMIN": strict(f"({w} - list_position({vals}, min({x}) {last(w)})) / {w}::DOUBLE", x, w),
        "SLOPE": slope_sql(x, w), "RSQ": spread,
        "RESI": f"{x} - (({full('avg', x, w)}) + ({slope_sql(x, w)}) * {(w - 1) / 2.0}::DOUBLE)",
        "EMA": ema_sql(x, w),
        "WMA": strict(f"list_sum(list_transform({vals}, lambda zz, ii: zz * ii)) / {w * (w + 1) / 2.0}::DOUBLE", x, w),
        "REF": ref(x, w), "DELTA": f"{x} - {ref(x, w)}",
    }
    return table[op]


def normalised_sql(op: str, field: str, w: int) -> str:
    x = SQL_NAME.get(field, field)
    e = op_sql(op, x, w)
    if op not in FX.LEVEL_OPS:
        return e
    if field in FX.PRICE_FIELDS:
        return f"({e}) / cf"
    if field == "VWAP":
        return f"({e}) / close"
    if field in FX.VOLUME_FIELDS:
        return f"({e}) / (({full('avg', x, w)}) + 1.0)" if op in ("STD", "SLOPE", "RESI") else f"({e}) / ({x} + 1.0)"
    return e


def _register(field: str, windows: tuple[int, ...], name: str, digits: int = 6, ops: tuple[str, ...] = FX.OPS) -> None:
    cols = {f"{op}_{field}_{w}": normalised_sql(op, field, w) for w in windows for op in ops}
    if field in FX.RETURN_FIELDS:
        x = SQL_NAME.get(field, field)
        for w in windows:
            cols[f"SUM_{field}_{w}"] = full("sum", x, w)
            cols[f"COUNT_{field}_{w}"] = strict(f"avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) {last(w)}", x, w)
    sql = S.with_bars(S.SUPP_MONTH, S.adjusted(), FIELD_SQL) + shown_sql("fields", cols, digits)

    @query(name, "F4 W21 Q7 UF2", sql)
    def run(spark, sf_dir):
        fields = FX.base_fields(adjust(bars_supp_month(spark, sf_dir)))
        out = FX.field_features(fields, field, windows)
        return shown(out, {c: F.col(c) for c in cols}, digits)


_register("CLOSE", (5, 20), "generated_adjusted_close")
_register("HIGH", (10,), "generated_adjusted_high")
_register("VWAP", (10,), "generated_vwap")
_register("A", (5, 30), "generated_amount")
_register("LOGV", (10,), "generated_log_volume")
_register("R", (20, 60), "generated_return")
_register("RETID", (10,), "generated_intraday_return")
_register("HLR", (20,), "generated_high_low_ratio")

#: The windows registered above, by field; all others follow here, so that every field is compared in every window.
_ABOVE = {"CLOSE": (5, 20), "HIGH": (10,), "VWAP": (10,), "A": (5, 30), "LOGV": (10,), "R": (20, 60), "RETID": (10,), "HLR": (20,)}
for _field in FX.FIELDS:
    _rest = tuple(w for w in FX.WINDOWS if w not in _ABOVE.get(_field, ()))
    if _field == "V":
        # Means of volumes end in a 5 at the seventh or eighth digit, where rounding would cut them in halves; moments of
        # three nearly equal values are known to four digits.
        _register("V", _rest, "generated_rest_of_v", 9, tuple(op for op in FX.OPS if op not in ("SKEW", "KURT")))
        _register("V", _rest, "generated_rest_of_v_moments", 4, ("SKEW", "KURT"))
    else:
        _register(_field, _rest, f"generated_rest_of_{_field.lower()}", 4 if _field == "LOGV" else 6)

def pair_moments_sql(windows: tuple[int, ...]) -> str:
    names = {f"CORR_{a}_{b}_{w}": ("corr", a, b, w) for a, b in FX.CORR_PAIRS for w in windows}
    names |= {f"COV_{a}_{b}_{w}": ("cov", a, b, w) for a, b in FX.COV_PAIRS for w in windows}
    return S.with_bars(
        S.BRAND_WEEK, S.adjusted(), FIELD_SQL,
        f"ib AS ({S.INDEX_WEEK})",
        "ir AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1.0 AS RIDX FROM ib)",
        "fi AS (SELECT f.*, ir.RIDX FROM fields f LEFT JOIN ir USING (d))",
    ) + shown_sql("fi", {n: corr_sql(SQL_NAME.get(a, a), SQL_NAME.get(b, b), w, k) for n, (k, a, b, w) in names.items()}, 5)


def index_returns(index):
    """(d, RIDX): day-on-day return of a one-series bar table."""
    return index.select("d", (sdiv("close", B.ref("close", 1)) - 1.0).alias("RIDX"))


def pair_moments(spark, sf_dir, windows):
    fields = FX.base_fields(adjust(bars_brand_week(spark, sf_dir)), index_returns(index_bars(spark, sf_dir)))
    out = FX.pair_features(fields, windows)
    return shown(out, {c: F.col(c) for c in out.columns if c not in ("sym", "d")}, 5)


@query("generated_pair_moments", "F4 W20 J11 J28", pair_moments_sql((20, 60)))
def generated_pair_moments(spark, sf_dir):
    return pair_moments(spark, sf_dir, (20, 60))


@query("generated_rest_of_pairs", "F4 W20 J11 J28", pair_moments_sql((3, 5, 10, 30)))
def generated_rest_of_pairs(spark, sf_dir):
    return pair_moments(spark, sf_dir, (3, 5, 10, 30))


SHAPE_SQL = {
    "KBAR_KMID": "(close - open) / open", "KBAR_KLEN": "(high - low) / open",
    "KBAR_KMID2": "(close - open) / (high - low + 1e-12::DOUBLE)",
    "KBAR_KUP": "(high - greatest(open, close)) / open",
    "KBAR_KUP2": "(high - greatest(open, close)) / (high - low + 1e-12::DOUBLE)",
    "KBAR_KLOW": "(least(open, close) - low) / open",
    "KBAR_KLOW2": "(least(open, close) - low) / (high - low + 1e-12::DOUBLE)",
    "KBAR_KSFT": "(2.0 * close - high - low) / open",
    "KBAR_KSFT2": "(2.0 * close - high - low) / (high - low + 1e-12::DOUBLE)",
    "SNAP_O": "open / close", "SNAP_H": "high / close", "SNAP_L": "low / close", "SNAP_VWAP": "amount / vol / close",
}


@query("generated_bar_shapes", "F4 E16", S.with_bars(S.SUPP_MONTH) + shown_sql("bars", SHAPE_SQL))
def generated_bar_shapes(spark, sf_dir):
    fields = FX.base_fields(adjust(bars_supp_month(spark, sf_dir)))
    return shown(FX.shape_features(fields), {n: F.col(n) for n in SHAPE_SQL})


@query("generated_vocabulary_coverage", "F4 S16 UF2")
def generated_vocabulary_coverage(spark, sf_dir):
    """Known values and mean of every generated column of the return field, one row per column."""
    fields = FX.base_fields(adjust(bars_supp_month(spark, sf_dir)))
    wide = FX.field_features(fields, "R")
    names = [c for c in wide.columns if c not in ("sym", "d")]
    stats = wide.agg(*[F.struct(F.count(n).alias("known"), F.avg(n).alias("mean")).alias(n) for n in names])
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("s")) for n in names])).alias("e"))
    return long.select("e.name", F.col("e.s.known").alias("known"), rnd("e.s.mean").alias("mean"))
