"""CSV bars whose names are written in GBK."""

from barloom.sources import tables as T


def test_names_in_gbk(spark, tmp_path):
    header = "日期,名称,收盘\n"
    (tmp_path / "600000.SH.csv").write_bytes((header + "20240102,浦发银行,6.5\n20240103,ST浦发,6.6\n20240104,,6.7\n").encode("gbk"))
    (tmp_path / "000001.SZ.csv").write_bytes((header + "20240102,平安銀行乗,9.5\n").encode("gbk"))
    got = T.read_csv_bars(spark, str(tmp_path), "day string, name string, close double", "day", names=("name",)).orderBy("sym", "d").collect()
    assert [(r["sym"], r["name"], r["close"]) for r in got] == [("000001", "平安銀行乗", 9.5), ("600000", "浦发银行", 6.5), ("600000", "ST浦发", 6.6), ("600000", None, 6.7)]
