"""Statistics over event and score tables, built from mergeable sums and distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import col, safe_sqrt, sdiv
from barloom.functions.tails import exact_rank_sum_p, normal_two_sided, t_two_sided
from barloom.operators.cross_section import (
    average_rank, fits_window, group_quantiles, join_groups, largest_group, pct_rank_average, positions, rank_counts, top_k,
)
from barloom.operators.components import star_forest
from barloom.session import attach_row, cut_lineage


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, win share, mean and median of the known values per group."""
    known = df.where(col(value).isNotNull())
    base = known.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg((col(value) > 0).cast("double")).alias("win"), F.avg(value).alias("mean")
    )
    medians = group_quantiles(known, keys, value, {"median": 0.5})
    return base.join(medians, list(keys)) if keys else attach_row(base, medians)


def summaries_by(df: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str], min_n: int = 1) -> DataFrame:
    """n, win, mean of several label columns over several groupings in one pass (grouping sets)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    labels = F.explode(F.array(*[F.struct(F.lit(v).alias("label"), col(v).alias("x")) for v in values]))
    long = df.select(*keys, labels.alias("e")).select(*keys, "e.label", "e.x").where("x is not null")
    grouped = long.groupingSets([[F.col("label"), *[F.col(k) for k in s]] for s in sets], F.col("label"), *[F.col(k) for k in keys])
    out = grouped.agg(
        F.count("x").alias("n"), F.avg((F.col("x") > 0).cast("double")).alias("win"), F.avg("x").alias("mean"),
        *[F.grouping(k).alias(f"all_{k}") for k in keys],
    )
    return out.where(F.col("n") >= min_n)


def excess_vs_controls(df: DataFrame, value: str, group: str, event: str, controls: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and win share of the events minus those of each control group."""
    def stat(g: str, fn) -> Column:
        return F.avg(F.when(col(group) == g, fn))

    win = F.when(col(value).isNotNull(), (col(value) > 0).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count(F.when(col(group) == event, col(value))).alias("n"), stat(event, col(value)).alias("mean"),
        *[(stat(event, col(value)) - stat(c, col(value))).alias(f"mean_vs_{c}") for c in controls],
        *[(stat(event, win) - stat(c, win)).alias(f"win_vs_{c}") for c in controls],
    )
    return out


def payoff(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average win, average loss, payoff ratio, profit factor."""
    x = col(value)
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x < 0, x)).alias("avg_loss"),
        F.sum(F.when(x > 0, x)).alias("_w"), F.sum(F.when(x < 0, x)).alias("_l"),
    )
    return out.withColumns(
        {"payoff_ratio": sdiv("avg_win", F.abs("avg_loss")), "profit_factor": sdiv("_w", F.abs("_l"))}
    ).drop("_w", "_l")


# ---------------------------------------------------------------- tests
def welch(df: DataFrame, value: str, group: str, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t of group a against b, its degrees of freedom and two-sided p; NULL below 10 per side."""
    def part(g: str) -> list[Column]:
        x = F.when(col(group) == g, col(value))
        return [F.count(x).alias(f"n_{g}"), F.avg(x).alias(f"m_{g}"), F.var_samp(x).alias(f"v_{g}")]

    s = df.groupBy(*keys).agg(*part(a), *part(b))
    ea, eb = col(f"v_{a}") / col(f"n_{a}"), col(f"v_{b}") / col(f"n_{b}")
    enough = (col(f"n_{a}") >= 10) & (col(f"n_{b}") >= 10)
    t = sdiv(col(f"m_{a}") - col(f"m_{b}"), safe_sqrt(ea + eb))
    dof = sdiv((ea + eb) * (ea + eb), ea * ea / (col(f"n_{a}") - 1) + eb * eb / (col(f"n_{b}") - 1))
    return s.select(*keys, f"n_{a}", f"n_{b}", F.when(enough, t).alias("t"), F.when(enough, dof).alias("dof")).withColumn("p", t_two_sided(col("t"), col("dof")))


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """U of group a, a two-sided normal z with tie and continuity correction, and p: from all orders where both groups
    are small and have no ties, else from z."""
    both = df.where(col(group).isin(a, b) & col(value).isNotNull()).select(*keys, group, value)
    ranked = rank_counts(both, keys, value, "_")
    r = average_rank(col("_less"), col("_ties"))
    s = ranked.groupBy(*keys).agg(
        F.count(F.when(col(group) == a, 1)).alias("n_a"), F.count(F.when(col(group) == b, 1)).alias("n_b"),
        F.sum(F.when(col(group) == a, r)).alias("_ra"), F.sum(col("_ties") * col("_ties") - 1).cast("double").alias("_tie"),
    )
    na, nb = col("n_a").cast("double"), col("n_b").cast("double")
    n = na + nb
    u = col("_ra") - na * (na + 1) / 2.0
    sigma = safe_sqrt(na * nb / 12.0 * ((n + 1) - sdiv("_tie", n * (n - 1))))
    z = sdiv(F.abs(u - na * nb / 2.0) - 0.5, sigma)
    enough = (na >= 10) & (nb >= 10)
    out = s.select(*keys, "n_a", "n_b", u.alias("u"), F.when(enough, z).alias("z"), "_tie", na.alias("_na"), nb.alias("_nb"))
    exact = F.when(col("_tie") == 0, exact_rank_sum_p(col("u"), col("_na"), col("_nb")))
    return out.withColumn("p", F.coalesce(exact, normal_two_sided(col("z")))).drop("_tie", "_na", "_nb")


def proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; NULL when a side is empty or the standard error is 0."""
    p = sdiv((k1 + k2).cast("double"), (n1 + n2).cast("double"))
    se = safe_sqrt(p * (1.0 - p) * (sdiv(F.lit(1.0), n1.cast("double")) + sdiv(F.lit(1.0), n2.cast("double"))))
    return sdiv(sdiv(k1.cast("double"), n1.cast("double")) - sdiv(k2.cast("double"), n2.cast("double")), se)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = sdiv(k.cast("double"), n.cast("double"))
    n = n.cast("double")
    den = 1.0 + z * z / n
    mid = (p + z * z / (2.0 * n)) / den
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / den
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def one_sample_t(value: Column | str, min_n: int = 30) -> Column:
    """Aggregate: mean over its standard error; NULL below ``min_n`` or without spread."""
    x = col(value)
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= min_n) & (sd > 0), sdiv(F.avg(x), sd / F.sqrt(F.count(x).cast("double"))))


def cluster_t(df: DataFrame, value: str, cluster: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over a cluster-robust standard error, from per-cluster sums and counts only."""
    parts = df.where(col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("_s"), F.count(value).cast("double").alias("_c"))
    s = parts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum("_s").alias("_sum"), F.sum(col("_s") * col("_s")).alias("_ss"),
        F.sum(col("_s") * col("_c")).alias("_sc"), F.sum(col("_c") * col("_c")).alias("_cc"),
    )
    mean = col("_sum") / col("n")
    spread = col("_ss") - 2.0 * mean * col("_sc") + mean * mean * col("_cc")
    g = col("clusters").cast("double")
    var = sdiv(g, g - 1.0) * spread / (col("n") * col("n"))
    t = F.when((col("n") >= 2) & (col("clusters") >= 2) & (var > 0), mean / F.sqrt(var))
    return s.select(*keys, col("n").cast("long").alias("n"), "clusters", mean.alias("mean"), t.alias("t"))


def moment_corr(x: Column, y: Column) -> Column:
    """Aggregate correlation that is NULL, not an error, when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return sdiv(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_n: int = 30) -> DataFrame:
    """Rank correlation (average ranks) per group with its t."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull()).select(*keys, x, y)
    rows = largest_group(both, keys)  # counted once for both rankings
    ranked = rank_counts(rank_counts(both, keys, x, "_x", rows), keys, y, "_y", rows)
    rho = moment_corr(average_rank(col("_xless"), col("_xties")), average_rank(col("_yless"), col("_yties")))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))
    t = col("rho") * F.sqrt((col("n") - 2) / F.greatest(F.lit(1e-12), 1.0 - col("rho") * col("rho")))
    known = col("n") >= min_n
    return out.select(*keys, "n", F.when(known, col("rho")).alias("rho"), F.when(known, t).alias("t"))


def rank_ic(df: DataFrame, score: str, ret: str, day: str = "d", min_rows: int = 5) -> DataFrame:
    """Rank correlation of score and forward return per day."""
    return spearman(df, score, ret, [day], min_rows).select(day, "n", F.col("rho").alias("ic")).where("ic is not null")


def ic_summary(daily: DataFrame, keys: Sequence[str] = (), min_days: int = 1) -> DataFrame:
    out = daily.groupBy(*keys).agg(
        F.count("ic").alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        sdiv(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"),
    )
    return out.where(F.col("days") >= min_days)


def wilcoxon_by_day(paired: DataFrame, a: str, b: str, min_n: int = 10) -> DataFrame:
    """Signed-rank z of a - b over days; differences below 1e-12 are dropped, too few pairs give NULL."""
    diff = paired.select((col(a) - col(b)).alias("_d")).where(F.abs("_d") > 1e-12).withColumn("_abs", F.abs("_d"))
    ranked = rank_counts(diff, [], "_abs", "_")
    r = average_rank(col("_less"), col("_ties"))
    s = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(col("_d") > 0, r).otherwise(0.0)).alias("w_plus"), F.sum(col("_ties") * col("_ties") - 1).cast("double").alias("_tie"),
    )
    n = col("n").cast("double")
    sigma = safe_sqrt(n * (n + 1) * (2.0 * n + 1) / 24.0 - col("_tie") / 48.0)
    return s.select("n", "w_plus", F.when(col("n") >= min_n, sdiv(col("w_plus") - n * (n + 1) / 4.0, sigma)).alias("z"))


# ---------------------------------------------------------------- buckets and ranking metrics
def first_ranks(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], out: str) -> DataFrame:
    """1-based rank with ties broken by ``tie``, and the number of known values; NULL values stay unranked."""
    known = positions(df.where(col(value).isNotNull()), keys, [value, *tie], out)
    return known.unionByName(df.where(col(value).isNull()), allowMissingColumns=True)


def quantile_buckets(df: DataFrame, keys: Sequence[str], value: str, k: int, tie: Sequence[str], out: str = "bucket") -> DataFrame:
    """Equal-frequency buckets 1..k on first-ranks."""
    ranked = first_ranks(df, keys, value, tie, "_r")
    place = F.ceil((col("_r") - 1) * k / (col("_r_n") - 1).cast("double"))
    b = F.when(col("_r").isNotNull(), F.when(col("_r_n") == 1, 1).otherwise(F.greatest(F.lit(1), place)))
    return ranked.withColumn(out, b.cast("long")).drop("_r", "_r_n")


def value_cut_buckets(df: DataFrame, value: str, k: int, out: str = "bucket") -> DataFrame:
    """Buckets 1..k cut at the quantiles of the raw values (ties share a bucket)."""
    names = {f"_q{i}": i / k for i in range(1, k)}
    cuts = group_quantiles(df, [], value, names)
    b = F.lit(1)
    for n in names:
        b = b + (col(value) > col(n)).cast("int")
    return attach_row(df, cuts).withColumn(out, F.when(col(value).isNotNull(), b).cast("long")).drop(*names)


def average_precision(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the precision steps: mean over positives of precision at their score, ties as one step."""
    known = df.where(col(score).isNotNull() & col(label).isNotNull()).select(*keys, score, label)
    steps = cut_lineage(known.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_a"), F.count_if(col(label) == 1).alias("_p")))
    rows = largest_group(steps, keys)
    if fits_window(rows):  # one row per score, not per row scored
        reached = Window.partitionBy(*keys).orderBy(F.desc(score))
        precise = steps.withColumn("_precision", F.sum("_p").over(reached) / F.sum("_a").over(reached)).where("_p > 0")
        return precise.groupBy(*keys).agg((F.sum(col("_p") * col("_precision")) / F.sum("_p")).alias("ap"))
    ranked = rank_counts(known, keys, score, "_a", rows)
    hits = rank_counts(ranked.where(col(label) == 1), keys, score, "_p", rows)
    precision = (col("_ptotal") - col("_pless")) / (col("_atotal") - col("_aless"))
    return hits.groupBy(*keys).agg(F.avg(precision).alias("ap"))


def average_precision_of_counts(counts: DataFrame, score: str, n: str, pos: str, keys: Sequence[str]) -> DataFrame:
    """``average_precision`` of rows that are counted already: one row per group and score, with its rows and its positive ones."""
    if fits_window(largest_group(counts, keys)):
        reached = Window.partitionBy(*keys).orderBy(F.desc(score))
        steps = counts.select(*keys, col(pos).alias("_p"), F.sum(n).over(reached).alias("_a_to"), F.sum(pos).over(reached).alias("_p_to"))
    else:  # split by range of the score inside a group; written once, so that the ranges stay the same
        parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = cut_lineage(counts.select(*keys, (-col(score)).alias("_s"), col(n).alias("_a"), col(pos).alias("_p")).repartitionByRange(parts, *keys, "_s").withColumn("_range", F.spark_partition_id()))
        above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_a").alias("_ra"), F.sum("_p").alias("_rp"))
        sizes = sizes.select(*keys, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_ra", "_rp")])
        inside = Window.partitionBy(*keys, "_range").orderBy("_s")
        placed = join_groups(ranged.withColumns({"_a_in": F.sum("_a").over(inside), "_p_in": F.sum("_p").over(inside)}), sizes, [*keys, "_range"], safe=keys)
        steps = placed.select(*keys, "_p", (col("_a_in") + col("_ra_above")).alias("_a_to"), (col("_p_in") + col("_rp_above")).alias("_p_to"))
    return steps.where("_p > 0").groupBy(*keys).agg((F.sum(col("_p") * (col("_p_to") / col("_a_to"))) / F.sum("_p")).alias("ap"))


def precision_at_k(df: DataFrame, score: str, label: str, k: int, keys: Sequence[str] = (), day: str = "d", tie: Sequence[str] = ("sym", "event_id")) -> DataFrame:
    """Label share of each day's top k: averaged over days, and over picks."""
    picks = top_k(df.where(col(label).isNotNull()), [*keys, day], [F.desc(score), *[F.asc(t) for t in tie]], k)
    per_day = picks.groupBy(*keys, day).agg(F.avg(label).alias("_p"), F.sum(label).alias("_h"), F.count(label).alias("_c"))
    return per_day.groupBy(*keys).agg(
        F.avg("_p").alias("precision_day"), sdiv(F.sum("_h"), F.sum("_c").cast("double")).alias("precision_event"), F.count(F.lit(1)).alias("days")
    )


def segment_metrics(df: DataFrame, score: str, label: str, seg: str, k: int, tie: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """n, base rate, AP and precision@k per segment (and ``keys``)."""
    by = [*keys, seg]
    base = df.where(col(label).isNotNull()).groupBy(*by).agg(F.count(label).alias("n"), F.avg(label).alias("base_rate"))
    return (
        base.join(average_precision(df, score, label, by), by, "left")
        .join(precision_at_k(df, score, label, k, by, tie=tie), by, "left")
    )


def threshold_metrics(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 per threshold: one aggregate, unpivoted."""
    y, s = col(label), col(score)
    aggs = [F.sum(y).alias("_pos"), F.count(y).alias("_n")]
    for i, t in enumerate(thresholds):
        aggs += [F.sum(F.when(s >= t, y)).alias(f"_tp{i}"), F.count(F.when(s >= t, y)).alias(f"_pp{i}")]
    one = df.where(y.isNotNull() & s.isNotNull()).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), col(f"_tp{i}").alias("tp"), col(f"_pp{i}").alias("pp")) for i, t in enumerate(thresholds)]))
    out = one.select("_pos", "_n", rows.alias("e")).select("e.*", "_pos", "_n")
    precision, recall = sdiv("tp", col("pp").cast("double")), sdiv("tp", col("_pos").cast("double"))
    return out.select(
        "threshold", precision.alias("precision"), recall.alias("recall"), sdiv(2.0 * precision * recall, precision + recall).alias("f1"),
        sdiv("_pos", col("_n").cast("double")).alias("prior"), sdiv(precision, sdiv("_pos", col("_n").cast("double"))).alias("lift"),
    )


def hit_at(df: DataFrame, score: str, label: str, ks: Sequence[int], day: str = "d", tie: Sequence[str] = ("sym",)) -> DataFrame:
    """Share of days with at least one hit among the top k, for several k from one ranking."""
    top = top_k(df.where(col(label).isNotNull()), [day], [F.desc(score), *[F.asc(t) for t in tie]], max(ks), "_rn")
    per_day = top.groupBy(day).agg(*[F.max(F.when(col("_rn") <= k, col(label))).alias(f"hit{k}") for k in ks])
    return per_day.agg(*[F.avg(f"hit{k}").alias(f"hit{k}") for k in ks])


def top_turnover(df: DataFrame, score: str, k: int, day: str = "d", key: str = "sym") -> DataFrame:
    """1 - overlap of consecutive days' top-k sets, averaged over days."""
    top = top_k(df, [day], [F.desc(score), F.asc(key)], k).select(day, key)
    days = top.select(day).distinct().withColumn("_i", F.row_number().over(Window.orderBy(day)))
    placed = top.join(F.broadcast(days), day)
    before = placed.select(key, (F.col("_i") + 1).alias("_i"), F.lit(1).alias("_kept"))
    per_day = placed.join(before, [key, "_i"], "left").groupBy("_i").agg(F.count(F.lit(1)).alias("_n"), F.count("_kept").alias("_k"))
    return per_day.where("_i > 1").agg(F.avg(1.0 - F.col("_k") / F.col("_n")).alias("turnover"))


def long_short(df: DataFrame, score: str, ret: str, k: int, cost: float, day: str = "d", key: str = "sym") -> DataFrame:
    """Per day: mean return of the top k minus the bottom k, and minus the universe, net of a fixed cost."""
    known = df.where(col(ret).isNotNull() & col(score).isNotNull())
    best = top_k(known, [day], [F.desc(score), F.asc(key)], k).groupBy(day).agg(F.avg(ret).alias("_t"))
    worst = top_k(known, [day], [F.asc(score), F.asc(key)], k).groupBy(day).agg(F.avg(ret).alias("_b"))
    whole = known.groupBy(day).agg(F.avg(ret).alias("_u"))
    return best.join(worst, day).join(whole, day).select(
        day, (col("_t") - col("_b") - cost).alias("long_short"), (col("_t") - col("_u") - cost).alias("top_minus_universe")
    )


# ---------------------------------------------------------------- correlation over many columns
def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over the rows where both columns are known, i < j.

    Every task multiplies its own batches as matrices and emits one row per pair; only those sums are shuffled.
    """
    names = list(cols)
    upper = np.triu_indices(len(names), 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=np.float64, na_value=np.nan)
            known = ~np.isnan(x)
            m, z = known.astype(np.float64), np.where(known, x, 0.0)
            part = np.stack([m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z])
            total = part if total is None else total + part
        if total is not None:
            picked = total[:, upper[0], upper[1]]
            yield pd.DataFrame(
                {"i": upper[0], "j": upper[1], **{n: picked[k] for k, n in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}}
            )

    schema = "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = df.select(*[col(c).cast("double").alias(c) for c in names]).mapInPandas(partial, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def pairwise_corr(df: DataFrame, cols: Sequence[str], min_pairs: int = 30) -> DataFrame:
    """(a, b, n, corr) for all column pairs over pairwise complete rows."""
    s = pair_sums(df, cols)
    n = col("n")
    cov = col("sxy") / n - col("sx") / n * (col("sy") / n)
    vx = col("sxx") / n - (col("sx") / n) * (col("sx") / n)
    vy = col("syy") / n - (col("sy") / n) * (col("sy") / n)
    names = F.array(*[F.lit(c) for c in cols])
    r = F.when((n >= min_pairs) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return s.select(F.get(names, col("i").cast("int")).alias("a"), F.get(names, col("j").cast("int")).alias("b"), n.cast("long").alias("n"), r.alias("corr"))


def drop_duplicated_columns(corr: DataFrame, order: Sequence[str], threshold: float = 0.999) -> tuple[list[str], dict[str, str]]:
    """Greedy in priority order: keep a column unless it is nearly identical to a kept one.

    Works on the pair table above the threshold, whose size depends on the number of columns only.
    """
    near: dict[str, set[str]] = {}
    for row in corr.where(F.abs("corr") >= threshold).collect():
        near.setdefault(row["a"], set()).add(row["b"])
        near.setdefault(row["b"], set()).add(row["a"])
    kept: list[str] = []
    dropped: dict[str, str] = {}
    for name in order:
        twin = next((k for k in kept if k in near.get(name, ())), None)
        if twin is None:
            kept.append(name)
        else:
            dropped[name] = twin
    return kept, dropped


def representative_clusters(corr: DataFrame, ranked: Sequence[str], threshold: float = 0.9) -> dict[str, str]:
    """Column -> representative: the first better-ranked representative it correlates with, else itself."""
    near: dict[str, set[str]] = {}
    for row in corr.where(F.abs("corr") >= threshold).collect():
        near.setdefault(row["a"], set()).add(row["b"])
        near.setdefault(row["b"], set()).add(row["a"])
    reps: list[str] = []
    owner: dict[str, str] = {}
    for name in ranked:
        rep = next((r for r in reps if r in near.get(name, ())), name)
        if rep == name:
            reps.append(name)
        owner[name] = rep
    return owner


def linked_components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node name reachable through pairs (a, b), over any number of steps."""
    forest = star_forest(pairs.select("a", "b"))
    return nodes.select("node").join(forest, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def yearly_signs(df: DataFrame, pairs: dict[str, tuple[str, str]], year: str) -> DataFrame:
    """Per name whether corr(x, y) has one non-zero sign in every year."""
    aggs = [F.signum(moment_corr(col(x), col(y))).alias(n) for n, (x, y) in pairs.items()]
    per_year = df.groupBy(year).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), col(n).alias("sign")) for n in pairs]))
    long = per_year.select(year, rows.alias("e")).select(year, "e.*")
    return long.groupBy("name").agg(
        F.count("sign").alias("years"),
        ((F.min("sign") == F.max("sign")) & (F.min("sign") != 0) & (F.count("sign") == F.count(F.lit(1)))).alias("consistent"),
    )


def elbow(points: Sequence[tuple[int, float]]) -> int:
    """Of (k, metric) points the k farthest from the chord in (log2 k, metric); the smallest k within 1e-12 of the farthest."""
    pts = sorted(points)
    (x0, y0), (x1, y1) = (np.log2(pts[0][0]), pts[0][1]), (np.log2(pts[-1][0]), pts[-1][1])
    norm = float(np.hypot(x1 - x0, y1 - y0))
    if norm == 0:
        return pts[0][0]
    far = {k: abs((x1 - x0) * (y0 - y) - (x0 - np.log2(k)) * (y1 - y0)) / norm for k, y in pts}
    return min(k for k, distance in far.items() if distance >= max(far.values()) - 1e-12)


# ---------------------------------------------------------------- audits
def tables_agree(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column: largest absolute difference and rows where only one side is known."""
    joined = a.select(*keys, *columns).join(b.select(*keys, *[col(c).alias(f"_b_{c}") for c in columns]), list(keys))
    aggs = []
    for x in columns:
        aggs += [F.max(F.abs(col(x) - col(f"_b_{x}"))).alias(f"d_{x}"), F.count_if(col(x).isNull() != col(f"_b_{x}").isNull()).alias(f"m_{x}")]
    one = joined.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), col(f"d_{x}").alias("max_diff"), col(f"m_{x}").alias("one_sided")) for x in columns]))
    out = one.select("n_rows", rows.alias("e")).select("e.*", "n_rows")
    return out.withColumn("agrees", (F.coalesce("max_diff", F.lit(0.0)) <= tolerance) & (col("one_sided") == 0))


def leakage_scan(df: DataFrame, features: Sequence[str], label: str, limit: float = 0.5) -> DataFrame:
    """Per feature: correlation with the label, share of rows equal to it, and whether it looks like a leak."""
    aggs = []
    for f in features:
        aggs += [moment_corr(col(f), col(label)).alias(f"c_{f}"), F.avg((col(f) == col(label)).cast("double")).alias(f"e_{f}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), col(f"c_{f}").alias("corr"), col(f"e_{f}").alias("equal_share")) for f in features]))
    return one.select(rows.alias("e")).select("e.*").withColumn("flagged", F.abs("corr") > limit)


def duplicate_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        (F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("repeated_row_share"),
    )


# ---------------------------------------------------------------- equity curve metrics
def equity_metrics(equity: DataFrame, day: str = "d", value: str = "equity", periods: float = 252.0) -> DataFrame:
    """Annual return, Sharpe, max drawdown, Calmar of one daily curve (one row per calendar day)."""
    days = Window.orderBy(day)
    e = col(value)
    s = equity.withColumns({"_r": sdiv(e, F.lag(e).over(days)) - 1.0, "_dd": e / F.max(e).over(days) - 1.0})
    out = s.agg(
        F.min_by(value, day).alias("_a"), F.max_by(value, day).alias("_z"), (F.count("_r") / periods).alias("_years"),
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.min("_dd").alias("max_drawdown"), F.count(F.lit(1)).alias("days"),
    )
    ann = F.pow(sdiv("_z", "_a"), sdiv(F.lit(1.0), "_years")) - 1.0
    return out.select(
        "days", ann.alias("annual_return"), (sdiv("_m", "_s") * F.sqrt(F.lit(periods))).alias("sharpe"), "max_drawdown", sdiv(ann, F.abs("max_drawdown")).alias("calmar")
    )


def yearly_chain(equity: DataFrame, day: str = "d", value: str = "equity") -> DataFrame:
    """Return of each year, from the last value of the year before (or the first value)."""
    per_year = equity.groupBy(F.year(day).cast("long").alias("y")).agg(F.max_by(value, day).alias("_z"), F.min_by(value, day).alias("_a"))
    prev = F.coalesce(F.lag("_z").over(Window.orderBy("y")), col("_a"))
    return per_year.select("y", (sdiv("_z", prev) - 1.0).alias("ret"))


def rank_share(less: str, ties: str, total: str) -> Column:
    return pct_rank_average(col(less), col(ties), col(total))
