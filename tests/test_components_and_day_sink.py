"""Components to the fixpoint, and a day sink whose days arrive in several batches."""

from barloom.operators import stats as G
from barloom.streaming import jobs as ST


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z"), (None, "y")], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(61)] + [("x",), ("y",), ("z",), ("alone",)], "node string")
    got = {r["node"]: r["component"] for r in G.linked_components(pairs, nodes).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert (got["x"], got["y"], got["z"], got["alone"]) == ("x", "x", "z", "alone")


def test_day_over_two_batches_keeps_all_rows(spark, tmp_path):
    for i in (0, 1):
        spark.createDataFrame([("2024-01-01", 5 * i + j) for j in range(5)], "d string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for state in ("first", "replay"):
        stream = spark.readStream.schema("d string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ST.start_day_sink(stream, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
        assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))
