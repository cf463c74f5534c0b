"""The shuffled panel is built once, for the count of the largest day, for the drops and for their base."""

from barloom.plans.stats import permutation_importance_by_day


def test_result_reads_only_the_three_means(spark):
    out = permutation_importance_by_day(spark, "/root/testdata/sf0.001")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in text and "Window" not in text
    assert sorted(r["feature"] for r in out.collect()) == ["mom", "vol10"]
