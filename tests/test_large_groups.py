"""Both physical forms of the group operators give the same rows; one group and one value hold a third of all rows."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import controls as M
from barloom.operators import cross_section as X
from barloom.operators import joins as J
from barloom.operators import stats as G
from barloom.operators.series_slices import number_rows, windows_by_slice
from barloom.functions.rolling import Layout

BIG, SMALL = 10**12, 0


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows: group 0 has half of them, value 7.0 is a third of that group; some values are missing."""
    i = F.col("id")
    value = F.when(i % 6 == 0, 7.0).when(i % 41 == 0, F.lit(None)).otherwise((F.pmod(i * 7919, F.lit(503)) / 10.0))
    return spark.range(600).select(F.when(i % 2 == 0, 0).otherwise(i % 5 + 1).alias("g"), i.alias("sym"), value.alias("v")).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_rank_counts_agree(skewed):
    assert rows(X.rank_counts(skewed, ["g"], "v", group_rows=BIG)) == rows(X.rank_counts(skewed, ["g"], "v", group_rows=SMALL))


def test_rank_counts_without_keys_agree(skewed):
    assert rows(X.rank_counts(skewed, [], "v", group_rows=BIG)) == rows(X.rank_counts(skewed, [], "v", group_rows=SMALL))


def test_percent_rank_matches_pandas(skewed):
    got = X.add_pct_rank(skewed, ["g"], "v", "p", group_rows=BIG).toPandas().sort_values("sym")
    want = got.groupby("g")["v"].rank(pct=True)
    assert got["p"].astype(float).fillna(-1).tolist() == pytest.approx(want.fillna(-1).tolist())


def test_rank_against_agrees(skewed):
    queries = skewed.where("sym % 3 = 0")
    universe = skewed.where("sym % 2 = 0")
    a = X.rank_against(queries, universe, ["g"], "v", "r", BIG)
    b = X.rank_against(queries, universe, ["g"], "v", "r", SMALL)
    assert rows(a.select("g", "sym", F.round("r", 12).alias("r"))) == rows(b.select("g", "sym", F.round("r", 12).alias("r")))


def test_quantiles_and_robust_z_agree(skewed):
    q = {"a": 0.1, "b": 0.5, "c": 0.93}
    r6 = lambda df, *c: df.select("g", *[F.round(x, 9).alias(x) for x in c])
    assert rows(r6(X.group_quantiles(skewed, ["g"], "v", q, BIG), *q)) == rows(r6(X.group_quantiles(skewed, ["g"], "v", q, SMALL), *q))
    z = [X.robust_z(skewed, ["g"], "v", "z", n).select("sym", F.round("z", 9).alias("z")) for n in (BIG, SMALL)]
    assert rows(z[0]) == rows(z[1])


def test_positions_agree(skewed):
    a = X.positions(skewed, ["g"], ["v", "sym"], "p", BIG)
    b = X.positions(skewed, ["g"], ["v", "sym"], "p", SMALL)
    assert rows(a) == rows(b)


def test_hashed_positions_are_a_permutation(skewed):
    out = X.hashed_positions(skewed, ["g"], 3, ["sym"], "at").toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["at"]) == list(range(len(part)))
        assert set(part["at_n"]) == {len(part)}


def test_random_picks_are_distinct_and_complete(skewed):
    out = M.random_picks(skewed.select("g", "sym"), ["g"], ["sym"], 3, 20, 5).toPandas()
    assert len(out) == 20 * 3 * out["g"].nunique()
    assert (out.groupby(["g", "rep"])["sym"].nunique() == 3).all()


def test_shuffle_keeps_the_multiset(skewed):
    known = skewed.where("v is not null")
    out = M.shuffled_within(known, ["g"], "v", ["sym"], 8, "w").toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["v"]) == sorted(part["w"])
    assert (out["v"] != out["w"]).any()


def test_first_ranks_and_buckets(skewed, monkeypatch):
    a = rows(G.quantile_buckets(skewed, ["g"], "v", 5, ["sym"]))
    monkeypatch.setattr(X, "WINDOW_GROUP_ROWS", -1)
    assert rows(G.quantile_buckets(skewed, ["g"], "v", 5, ["sym"])) == a


def test_as_of_by_slot_equals_plain(spark):
    n = F.col("id")
    left = spark.range(400).select((n % 3 % 2).alias("k"), (n * 13 % 997).alias("t"), n.alias("row"))
    right = spark.range(120).select((n % 3 % 2).alias("k"), (n * 29 % 997).alias("t"), (n * 1.0).alias("v")).dropDuplicates(["k", "t"])
    for strict in (False, True):
        plain = J.as_of(left, right, ["k"], "t", ["v"], "rt", strict)
        sliced = J.as_of(left, right, ["k"], "t", ["v"], "rt", strict, slot=F.floor(F.col("t") / 50))
        assert rows(plain) == rows(sliced)


def test_sliced_windows_equal_whole_windows(spark):
    n = F.col("id")
    ticks = spark.range(500).select(F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (n % 4).cast("string"))).alias("sym"), n.alias("t"), (n * 37 % 101 * 1.0).alias("x"))
    numbered = number_rows(ticks, ["sym"], ["t"], F.floor(F.col("t") / 60))
    cols = lambda w: {"m": w.agg("mean", "x", 10), "lag": w.ref("x", 7), "mx": w.agg("max", "x", 10, 1)}
    whole = numbered.withColumns(cols(Layout(order="pos")))
    assert rows(windows_by_slice(numbered, cols, 16, 10)) == rows(whole)


@pytest.fixture(scope="module")
def null_keys(spark):
    """120 rows: a quarter has a NULL key, group 9 has no known value."""
    i = F.col("id")
    g = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, 9).otherwise(i % 3)
    value = F.when(i % 4 == 1, F.lit(None)).when(i % 7 == 0, F.lit(None)).otherwise(F.pmod(i * 31, F.lit(17)) / 4.0)
    return spark.range(120).select(g.alias("g"), i.alias("sym"), value.cast("double").alias("v")).cache()


def test_null_keys_are_a_group_in_both_forms(null_keys):
    forms = (
        lambda n: X.rank_counts(null_keys, ["g"], "v", group_rows=n),
        lambda n: X.positions(null_keys, ["g"], ["v", "sym"], "p", n),
        lambda n: X.group_quantiles(null_keys, ["g"], "v", {"a": 0.25, "b": 0.5}, n),
        lambda n: X.rank_against(null_keys.where("sym % 3 = 0"), null_keys, ["g"], "v", "r", n),
        lambda n: X.robust_z(null_keys, ["g"], "v", "z", n).withColumn("z", F.round("z", 9)),
    )
    for form in forms:
        big, small = rows(form(BIG)), rows(form(SMALL))
        assert big and big == small
    assert len(rows(X.rank_counts(null_keys, ["g"], "v", group_rows=SMALL))) == 120


def test_null_keys_keep_their_rows_in_draws_and_scores(null_keys):
    out = X.hashed_positions(null_keys, ["g"], 3, ["sym"], "at").toPandas()
    assert len(out) == 120
    for _, part in out.groupby("g", dropna=False):
        assert sorted(part["at"]) == list(range(len(part)))
    z = X.group_z(null_keys, ["g"], "v", "z", 5)
    assert z.count() == 120 and z.where("g IS NULL AND v IS NOT NULL AND z IS NULL").count() == 0
    assert M.shuffled_within(null_keys, ["g"], "v", ["sym"], 8, "w").count() == 120
