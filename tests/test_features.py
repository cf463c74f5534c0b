"""Feature contracts: prefix equality, isolation, registry guards, calendar."""

import datetime as dt

import numpy as np
import pytest
from helpers import random_bars
from pyspark.sql import functions as F

from barloom.features import calendar as CAL
from barloom.features import engine as EN
from barloom.features import factory as FX
from barloom.features import legacy as LG
from barloom.functions.registry import FeatureRegistry
from barloom.sources.bars import adjust

CUT = dt.date(2019, 1, 1) + dt.timedelta(days=279)


def at_cut(df):
    names = sorted(c for c in df.columns if c not in ("sym", "d"))
    rows = df.where(F.col("d") == F.lit(CUT)).orderBy("sym").select("sym", *names).collect()
    return names, [list(r) for r in rows]


def same_at_cut(build, bars):
    names, full = at_cut(build(bars))
    _, cut = at_cut(build(bars.where(F.col("d") <= F.lit(CUT))))
    assert full and len(full) == len(cut)
    for a, b in zip(full, cut):
        for name, x, y in zip(names, a[1:], b[1:]):
            assert (x is None) == (y is None), name
            if isinstance(x, float):
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9), name


@pytest.fixture(scope="module")
def bars(spark):
    return random_bars(spark, 2, 320, seed=3, skip={(1, i) for i in range(100, 110)}).cache()


def test_engine_features_only_look_back(bars):
    same_at_cut(lambda b: EN.symbol_features(adjust(b)), bars)


def test_generated_features_only_look_back(bars):
    same_at_cut(lambda b: FX.field_features(FX.base_fields(adjust(b)), "CLOSE", (5, 20)), bars)


def test_legacy_pipeline_only_looks_back(bars):
    def build(b):
        out = LG.pipeline(adjust(b))
        return out.select("sym", "d", *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"])

    same_at_cut(build, bars)


def test_symbols_do_not_leak_into_each_other(bars):
    one = bars.where("sym = 'S0'")
    names, both = at_cut(EN.symbol_features(adjust(bars), families=["returns", "volume", "trend"]))
    _, alone = at_cut(EN.symbol_features(adjust(one), families=["returns", "volume", "trend"]))
    for name, x, y in zip(names, both[0][1:], alone[0][1:]):
        assert x == pytest.approx(y) if x is not None else y is None, name


def test_no_nan_or_infinity_leaves_the_engine(bars):
    flat = bars.withColumns({c: F.lit(10.0) for c in ("open", "high", "low", "close")})
    out = EN.symbol_features(adjust(flat))
    names = [c for c in out.columns if c not in ("sym", "d")]
    bad = out.agg(*[F.sum((F.isnan(n) | (F.abs(n) == float("inf"))).cast("int")).alias(n) for n in names]).first().asDict()
    assert {n: v for n, v in bad.items() if v} == {}


def test_vocabulary_size_and_names():
    vocab = [g.name for g in _vocabulary_without_shapes()]
    assert len(vocab) == 1590 and len(set(vocab)) == 1590


def _vocabulary_without_shapes():
    out = [FX.Generated(f"{op}_{f}_{w}", op, f, w) for f in FX.FIELDS for w in FX.WINDOWS for op in FX.OPS]
    out += [FX.Generated(f"{op}_{f}_{w}", op, f, w) for f in FX.RETURN_FIELDS for op in ("SUM", "COUNT") for w in FX.WINDOWS]
    out += [FX.Generated(f"CORR_{a}_{b}_{w}", "CORR", a, w) for a, b in FX.CORR_PAIRS for w in FX.WINDOWS]
    return out + [FX.Generated(f"COV_{a}_{b}_{w}", "COV", a, w) for a, b in FX.COV_PAIRS for w in FX.WINDOWS]


def test_whole_vocabulary_has_1603_columns(spark):
    assert len(FX.vocabulary()) == 1603


def test_registry_refuses_repeats_and_foreign_inputs():
    reg = FeatureRegistry()
    reg.add("A", "f", "close", lambda: F.col("close"))
    with pytest.raises(ValueError, match="already registered"):
        reg.add("A", "f", "close", lambda: F.col("close"))
    with pytest.raises(ValueError, match="outside the allowed list"):
        reg.add("B", "f", "future_return_5d", lambda: F.col("future_return_5d"))


def test_calendar_matches_numpy_business_days(spark):
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=i) for i in range(900)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    got = {r["d"]: (r["CAL_MONTH_POS"], r["CAL_HOLIDAY"]) for r in CAL.calendar_flags(df).collect()}
    hols = [np.datetime64(x) for x in CAL.LUNAR_NEW_YEAR] + [np.datetime64(f"{y}-10-01") for y in range(2014, 2020)]
    for x in days:
        d = np.datetime64(x)
        nxt = (d.astype("datetime64[M]") + 1).astype("datetime64[D]")
        near = False
        for h in hols:
            near |= np.busday_offset(h, -10, roll="backward") <= d < h
            resume = np.busday_offset(h + 7, 0, roll="forward")
            near |= resume <= d < np.busday_offset(resume, 5, roll="forward")
        assert got[x] == (float(np.busday_count(d + 1, nxt)), float(near)), x
