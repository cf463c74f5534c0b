"""The race runs every label and setting, and its rounds end by the validation error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cross_section as X
from barloom.operators import model as K
from barloom.operators import stats as G
from barloom.operators import tree_race as T
from barloom.plans import models as M


@pytest.fixture(scope="module")
def panel(spark):
    i = F.col("id")
    code = lambda seed: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(33)).cast("double")
    df = spark.range(2400).select(i.alias("sym"), F.date_add(F.lit("2020-01-01"), (i % 60).cast("int")).alias("d"), code(1).alias("a"), F.when(i % 5 > 0, code(2)).alias("b"), code(3).alias("c"))
    signal = F.col("a") + F.coalesce(F.col("b"), F.lit(20)) + F.pmod(F.xxhash64(F.lit(9), "sym"), F.lit(20))
    df = df.withColumn("up", (signal > 40).cast("double")).withColumn("seg", F.when(F.col("d") < F.lit("2020-02-15").cast("date"), "train").otherwise("val")).localCheckpoint()
    return df.where("seg = 'train'"), df.where("seg = 'val'")


def test_the_grid_is_whole():
    assert len(set(M.RACE_GRID)) == 36 and len(set(M.RACE_LABELS)) == 22
    assert all(p.max_rounds == 1000 for p in M.RACE_GRID)
    for name, values in {"depth": {4, 5, 6}, "min_rows": {50, 100, 200}, "step": {0.05, 0.1}, "share": {0.6, 0.8}}.items():
        assert {getattr(p, name) for p in M.RACE_GRID} == values


def test_label_race_grid_places_every_label_in_every_setting(spark, monkeypatch):
    fits, grown = {}, T.grown

    def kept(*args):
        fits.update(grown(*args))
        return fits

    monkeypatch.setattr(T, "grown", kept)
    got = M.label_race_grid(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(zip(got["candidate"], got["config_id"])) == sorted((y, i) for y in M.RACE_LABELS for i in range(36))
    assert sorted(got["place"]) == list(range(1, 793))
    ranked = got.sort_values("place")["precision_day"].fillna(-1.0)
    assert ranked.is_monotonic_decreasing
    assert len(fits) == 22 * 36 * 6 and max(map(len, fits.values())) > 2


def test_rounds_end_by_the_validation_error_as_in_single_fits(panel):
    grid = (K.TreeParams(max_rounds=40, depth=2, step=0.3, min_rows=150),)
    args = (*panel, ("a", "b", "c"), ("up",), grid, 2, ["sym"])
    want, got = (df.toPandas().sort_values("seg").reset_index(drop=True) for df in (K.race(*args), T.race_on_codes(*args)))
    for name in want.columns.drop(["candidate", "config_id", "seg"]):
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-3 if name.startswith("calib") else 1e-9, err_msg=name)
    only = T.race_on_codes(*args, segments=["val"]).toPandas()
    assert only["seg"].tolist() == ["val"] and only["ap"][0] == pytest.approx(got["ap"][1])


def test_trees_ask_the_features_drawn_and_no_small_leaves(panel, monkeypatch):
    seen, level = [], T.grow_level

    def watched(table, lines, *rest):
        level(table, lines, *rest)
        seen.extend((line.features, {f for f, _ in tree.words}) for line, _, tree in lines)

    monkeypatch.setattr(T, "grow_level", watched)
    grid = (K.TreeParams(max_rounds=3, depth=3, step=0.1, share=0.6), K.TreeParams(max_rounds=3, depth=3, step=0.1, min_rows=5000))
    rows = [T.race_on_codes(*panel, ("a", "b", "c"), ("up",), grid, 2, ["sym"]).orderBy("config_id", "seg").collect() for _ in range(2)]
    assert rows[0] == rows[1]
    assert {len(features) for features, _ in seen} == {2, 3} and all(asked <= {*features, 0} for features, asked in seen)
    assert any(len(asked) == 2 for _, asked in seen)
    flat = [r for r in rows[0] if r["config_id"] == 1 and r["seg"] == "val"][0]
    assert flat["ap"] == pytest.approx(flat["base_rate"])  # no split leaves 5,000 rows on both sides: one score for all


@pytest.mark.parametrize("depth", [1, 4, 6, 8])
def test_words_lead_to_the_node_that_questions_lead_to(depth):
    rng = np.random.default_rng(depth)
    bins, tree, asked = rng.integers(0, 32, (3, 34)), T.Tree(3, 34), []
    for level in range(depth):
        node = np.flatnonzero(rng.random(1 << level) < 0.8)
        feature, cut = rng.integers(-1, 3, len(node)), rng.integers(0, 31, len(node))
        asked.append({int(p): (int(f), int(c)) for p, f, c in zip(node, feature, cut)})
        tree.grow(bins, node, feature, cut, rng.random(len(node)), rng.random(len(node)))
    codes = rng.integers(0, 34, (3, 500))
    want = []
    for row in codes.T:
        p = 0
        for questions in asked:
            f, c = questions.get(p, (-1, 0))
            p = 2 * p + int(f >= 0 and bins[f, row[f]] > c)
        want.append(p)
    assert tree.places(codes).tolist() == want and len(tree.values) == 1 << depth


def test_a_feature_unknown_in_a_fold_is_not_asked():
    assert not T.bins_of(np.array([0, 0, 0, 9]), np.array([0, 0, 0, 9])).any()
    n, s = np.array([[[0, 0, 0, 9]]]), np.array([[[0.0, 0.0, 0.0, 3.0]]])
    put = (np.zeros((1, 4, 1), int) == np.arange(T.SPLITS + 1)).astype(float)
    feature, _, left, right = T.best_splits(n, s, put, 1)
    assert feature.tolist() == [-1] and left[0] == right[0] == pytest.approx(1 / 3)


def test_rounds_end_where_they_stop():
    for errors in ([1.0, 0.9, 0.8, 0.8], [1.0, 0.9, 0.8999], [1.0, 1.1], [float("nan"), float("nan")]):
        assert T.ended(errors) and not any(T.ended(errors[:m]) for m in range(1, len(errors)))


def test_average_precision_of_counts_in_both_forms(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(400).select(F.when(i % 4 > 0, i % 2).alias("g"), (i * 37 % 60 / 7.0).alias("s"), (i * 31 % 3 == 0).cast("double").alias("y"))
    counts = df.groupBy("g", "s").agg(F.count("y").alias("n"), F.sum("y").cast("long").alias("k"))
    want = {r["g"]: r["ap"] for r in G.average_precision(df, "s", "y", ["g"]).collect()}
    small = {r["g"]: r["ap"] for r in G.average_precision_of_counts(counts, "s", "n", "k", ["g"]).collect()}
    monkeypatch.setattr(X, "WINDOW_GROUP_ROWS", -1)
    big = {r["g"]: r["ap"] for r in G.average_precision_of_counts(counts, "s", "n", "k", ["g"]).collect()}
    assert len(want) == 3 and small == pytest.approx(want) and big == pytest.approx(want)


def test_calibrations_of_groups_are_those_of_single_fits(spark):
    i = F.col("id")
    df = spark.range(600).select((i % 3).cast("int").alias("g"), (i % 10 / 10.0).alias("p"), F.when(i % 3 == 2, 1.0).otherwise((i * 7 % 10 < i % 10).cast("double")).alias("y"))
    counts = df.groupBy("g", "p").agg(F.count("y").alias("n"), F.sum("y").cast("long").alias("k"))
    got = K.SquaredLogit.fit_groups(counts, "g", "p", "n", "k", 3)
    for g in range(2):
        one = K.SquaredLogit.fit(df.where(F.col("g") == g), "p", "y")
        assert (*got[g].coef, got[g].intercept) == pytest.approx((*one.coef, one.intercept), rel=1e-3)
    assert got[2].of(np.array([0.3])).tolist() == [1.0]
    with pytest.raises(ValueError, match="no row"):
        K.SquaredLogit.fit_groups(counts, "g", "p", "n", "k", 4)
