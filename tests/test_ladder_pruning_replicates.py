"""The ladder and its elbow, a dated table that is read for the wanted days only, and resampling as vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import controls as M
from barloom.operators import model as K
from barloom.plans.joins import events_and_dated_limits
from barloom.sources import tables as T

SF = "/root/testdata/sf0.001"


def elbow(spark, ks, values):
    out = K.with_elbow(spark.createDataFrame(list(zip(ks, values)), "k int, precision double")).collect()
    return [r["k"] for r in out if r["chosen"]], {r["k"]: r["distance"] for r in out}


def test_ladder_sizes():
    assert K.ladder_sizes(2060)[-1] == 2060 and K.ladder_sizes(2060)[:4] == [5, 10, 15, 20]
    assert K.ladder_sizes(12) == [5, 10, 12] and K.ladder_sizes(5) == [5]
    with pytest.raises(ValueError):
        K.ladder_sizes(4)


def test_elbow(spark):
    assert elbow(spark, [5, 10, 20, 40, 80, 160], [0.50, 0.56, 0.575, 0.578, 0.579, 0.579])[0] == [10]
    assert elbow(spark, [5, 10, 20], [0.5, 0.55, 0.6])[0] == [5]  # on one line all are equally far
    chosen, far = elbow(spark, [5, 10, 20], [0.5, 0.5, 0.9])
    assert chosen == [10] and far[5] == far[20] == 0
    assert elbow(spark, [7], [0.5])[0] == [7]
    for ks, values in (([5, 5], [0.1, 0.2]), ([5, 6], [0.1, None])):
        with pytest.raises(ValueError):
            elbow(spark, ks, values)


def test_refit_ladder_uses_the_first_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 7))
    rows = [(f"s{i % 20}", f"2020-01-{1 + i // 20:02d}", *map(float, x[i]), float(x[i, 5] > 0)) for i in range(600)]
    names = [f"f{j}" for j in range(7)]
    df = spark.createDataFrame(rows, "sym string, d string, " + ", ".join(f"{n} double" for n in names) + ", y double")
    got = {r["k"]: r["precision"] for r in K.refit_ladder(df.where("d < '2020-01-21'"), df.where("d >= '2020-01-21'"), names, "y", K.TreeParams(5, 2), ["sym"]).collect()}
    assert set(got) == {5, 7} and got[7] > 0.95 > got[5]  # the sixth feature decides the label


def scanned_folders(df):
    """Partitions that the scan of the dated table read, from the metrics of the executed plan."""
    df.collect()
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.metrics().contains("numPartitions") and "limits-" in node.toString():
            found.append(int(node.metrics().apply("numPartitions").value()))
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_only_wanted_days_are_read(spark):
    events, table = events_and_dated_limits(spark, SF)
    every = table.select("d").distinct().count()
    few = events.where("sym = 1")
    days = few.join(table.select("d").distinct(), "d", "left_semi").select("d").distinct().count()
    plan = T.rows_of_days(table, few)
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString().lower()
    read = scanned_folders(plan)
    assert read == [days] and days < every
    assert scanned_folders(T.in_range(table, "1996-01-01", "1996-03-01")) == [table.where("d BETWEEN '1996-01-01' AND '1996-03-01'").select("d").distinct().count()]


def test_replicate_sums_equal_the_weights_one_by_one(spark):
    rows = [(f"d{i:03d}", float(i), i % 4) for i in range(150)]
    days = spark.createDataFrame(rows, "d string, s double, c long").repartition(5)
    got = {r["draw"]: (r["s"], r["c"]) for r in M.replicate_sums(days, ["s", "c"], 40, 9).collect()}
    hashes = {r["d"]: r["h"] for r in days.select("d", F.xxhash64("d").alias("h")).collect()}
    w = M.replicate_weights(np.array([hashes[d] for d, _, _ in rows], np.int64).view(np.uint64), 40, 9)
    for draw in range(40):
        assert got[draw + 1] == pytest.approx((sum(w[i, draw] * s for i, (_, s, _) in enumerate(rows)), sum(w[i, draw] * c for i, (_, _, c) in enumerate(rows))))
    big = M.replicate_weights(np.arange(2000, dtype=np.uint64) * np.uint64(977), 200, 3)
    assert abs(big.mean() - 1) < 0.01 and abs(big.var() - 1) < 0.02 and big.max() >= 6
    assert M.day_bootstrap(days.limit(0), "s", "c", 5, 1).where("mean IS NOT NULL").count() == 0
