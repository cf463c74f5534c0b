"""Ranks inside large groups: ranges come from partitions, not from a list of cuts that every value is held against."""

from pyspark.sql import functions as F

from barloom.operators import cross_section as X


def test_one_large_group_is_ranked_in_many_ranges(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 5 > 0, "big").alias("g"), (F.col("id") % 2_500).cast("double").alias("v"))
    out = X.value_ranks(rows, ["g"], "v")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in text and "_cuts" not in text
    got = {(r["g"], r["v"]): (r["less"], r["ties"], r["total"]) for r in out.collect()}
    want = {}
    for g, keep in (("big", lambda v: v % 5 > 0), (None, lambda v: v % 5 == 0)):
        values = [v for v in range(2_500) if keep(v)]
        want |= {(g, float(v)): (2 * i, 2, 2 * len(values)) for i, v in enumerate(values)}
    assert got == want
