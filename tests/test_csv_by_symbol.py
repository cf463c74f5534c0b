"""CSV folders per symbol: one file each, however many tasks hold a symbol's rows."""

from pathlib import Path

from pyspark.sql import functions as F

from barloom.sources import tables as T


def test_one_file_per_symbol_from_many_tasks(spark, tmp_path):
    folder = str(tmp_path / "csv")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 5).cast("int")), "yyyyMMdd")
    rows = spark.range(100).select((F.col("id") % 5).alias("sym"), day.alias("trade_date"), F.col("id").cast("double").alias("close")).repartition(7)
    T.write_csv_by_symbol(rows, folder)
    assert sorted(len(list(p.glob("*.csv"))) for p in Path(folder).glob("sym=*")) == [1] * 5
    got = T.read_csv_bars(spark, folder, "trade_date string, close double", "trade_date", "2024-01-02", "2024-01-10", symbol_pattern=r"sym=([^/]+)/")
    assert sorted(int(r["close"]) for r in got.collect()) == list(range(5, 50))
    assert got.where("cast(sym as int) <> close % 5").count() == 0
