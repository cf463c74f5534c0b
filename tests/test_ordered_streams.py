"""Streams with rows out of order, late rows, and a day table that dies between write and commit."""

import datetime as dt

import numpy as np
import pytest
from helpers import random_bars
from pyspark.sql import functions as F

from barloom.operators import events as E
from barloom.operators import sequential as Q
from barloom.sources.bars import adjust
from barloom.streaming import jobs as ST
from barloom.streaming import ordered as O
from barloom.streaming.day_table import DayTable, route_late


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Two symbols of 200 days in two batches that overlap by up to 30 days, then a heartbeat far ahead."""
    bars = random_bars(spark, 2, 200, 5).withColumn("ts", F.col("d").cast("timestamp")).cache()
    folder = str(tmp_path_factory.mktemp("shuffled") / "files")
    edge = dt.date(2019, 1, 1) + dt.timedelta(days=100)
    first = F.date_add("d", F.pmod(F.xxhash64("d", "sym"), F.lit(30)).cast("int")) < F.lit(edge)
    for part in (bars.where(first), bars.where(~first), bars.limit(1).withColumn("ts", F.lit("2050-01-01").cast("timestamp")).withColumn("sym", F.lit(""))):
        part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(folder)
    assert bars.where(~first).agg(F.min("d")).first()[0] < bars.where(first).agg(F.max("d")).first()[0]
    return bars, ST.parquet_stream(spark, folder, "*.parquet", bars.schema, 1)


def run(stream, fold, delay="40 days"):
    out = ST.run_available(O.in_order(stream, fold, "ts", delay), "t-ordered").where("sym <> ''")
    return out.withColumn("d", F.col("ts").cast("date")).orderBy("sym", "d").toPandas()


def test_indicators_equal_batch(shuffled):
    bars, stream = shuffled
    got = run(stream, O.together(O.macd("close"), O.rsi("close", 14), O.atr("high", "low", "close", 14)))
    want = Q.add_recursions(bars, [Q.macd("close"), Q.rsi("close", 14, "rsi"), Q.atr("high", "low", "close", 14, "atr")]).orderBy("sym", "d").toPandas()
    for c in ("dif", "dea", "rsi", "atr"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_crosses_and_zigzag_equal_batch(shuffled):
    bars, stream = shuffled
    got = run(stream, O.crosses("close"))
    flags = E.cross_flags(Q.add_recursions(bars.select("sym", "d", "close"), [Q.macd("close")])).where("golden OR death")
    assert [(r.sym, r.d, bool(r.golden)) for r in got.itertuples()] == [(r["sym"], r["d"], r["golden"]) for r in flags.orderBy("sym", "d").collect()]
    assert len(got) > 4
    got = run(stream, O.zigzag("close", 0.04))
    want = Q.zigzag_lows(adjust(bars.drop("ts")), "close", 0.04)
    assert sorted((r.sym, r.low_pos, r.sig_pos) for r in got.itertuples()) == sorted((r["sym"], r["low_pos"], r["sig_pos"]) for r in want.collect())


def test_rows_wait_for_the_watermark(shuffled):
    """Without the heartbeat nothing newer than the delay is emitted, and what is emitted has all rows before it."""
    bars, stream = shuffled
    got = run(stream.where("sym <> ''"), O.last_n("close", 3))
    newest = bars.agg(F.max("d")).first()[0]
    assert got["d"].max() < newest - dt.timedelta(days=39)
    assert len(got) == bars.where(F.col("d") <= F.lit(got["d"].max())).count()


def zigzag_by_definition(prices, pct):
    """Lows and the rows that confirm them, leg by leg: the lowest price so far, until one stands pct above it."""
    found, start, look = [], 0, None
    while True:
        ends = []
        for sign in (1, -1) if look is None else (look,):
            for t in range(start + 1, len(prices)):
                part = prices[start:t]
                extreme = min(part) if sign > 0 else max(part)
                if (prices[t] >= extreme * (1 + pct)) if sign > 0 else (prices[t] <= extreme * (1 - pct)):
                    ends.append((t, -sign, sign, start + part.index(extreme)))
                    break
        if not ends:
            return found
        t, _, sign, at = min(ends)
        if sign > 0:
            found.append((at + 1, t + 1))
        start, look = t, -sign


@pytest.mark.parametrize("seed", range(8))
def test_zigzag_legs_by_definition(seed):
    rng = np.random.default_rng(seed)
    prices = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.03, 300))), 1 if seed % 2 else 6).tolist()
    legs, found = Q.ZigzagLegs([]), []
    for i, p in enumerate(prices):
        low = legs.push(p, i + 1, 0.05)
        if low is not None:
            found.append((low, i + 1))
    assert found == zigzag_by_definition(prices, 0.05) and len(found) > 5


def day_rows(spark, batch):
    return spark.createDataFrame([(f"2024-01-0{1 + (batch + j) % 3}", 10 * batch + j) for j in range(6)], "d string, v int")


def test_death_between_write_and_commit(spark, tmp_path, monkeypatch):
    for i in range(3):
        day_rows(spark, i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("d string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = DayTable(spark, str(tmp_path / "table"))
    honest = DayTable.commit

    def dies(self, folder, batch_id, columns):
        if batch_id == 1:
            raise RuntimeError("lost before the commit")
        honest(self, folder, batch_id, columns)

    monkeypatch.setattr(DayTable, "commit", dies)
    with pytest.raises(Exception, match="lost before the commit"):
        table.start(stream, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["v"] for r in table.read().collect()) == list(range(6))
    monkeypatch.setattr(DayTable, "commit", honest)
    for state in ("state", "state", "another"):  # resumed, resumed with nothing new, replayed from the start
        table.start(stream, str(tmp_path / state)).awaitTermination()
        assert sorted(r["v"] for r in table.read().collect()) == sorted(10 * i + j for i in range(3) for j in range(6))
    assert table.manifest().agg(F.sum("n_rows")).first()[0] == 18 and table.changed_days().count() == 0
    table.compact()
    table.start(stream, str(tmp_path / "third")).awaitTermination()
    table.add(day_rows(spark, 7), 7)
    assert table.read().count() == 24 and table.manifest().select("folder").distinct().count() == 2
    table.compact()
    assert table.read().count() == 24 and table.manifest().select("folder").distinct().count() == 1 and table.changed_days().count() == 0


def test_manifest_names_changed_days(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "table"))
    table.add(day_rows(spark, 0), 0)
    folder = table.manifest().first()["folder"]
    spark.createDataFrame([(99,)], "v int").write.mode("append").parquet(f"{tmp_path}/table/rows/{folder}/d=2024-01-02")
    assert [r["day"] for r in table.changed_days().collect()] == ["2024-01-02"]


def test_late_rows_take_the_side_table(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    batches = [[(1, 0), (2, 600)], [(3, 550), (4, 10), (5, 1200)], [(6, 595), (7, 1195)], [(8, 1300), (9, None)]]
    for rows in batches:
        data = [(i, None if m is None else base + dt.timedelta(minutes=m), "2024-01-01") for i, m in rows]
        spark.createDataFrame(data, "id long, ts timestamp, d string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, d string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for state in ("a", "b"):  # a replay decides alike
        in_time, late, counted = route_late(stream, "ts", 3600, "d", str(tmp_path / "out"), str(tmp_path / state))
        assert sorted(r["id"] for r in in_time.read().collect()) == [1, 2, 3, 5, 7, 8, 9]
        assert sorted(r["id"] for r in late.read().collect()) == [4, 6]
        assert sorted((r["batch"], r["n_rows"], r["n_late"]) for r in counted.collect()) == [(0, 2, 0), (1, 3, 1), (2, 2, 1), (3, 2, 0)]
