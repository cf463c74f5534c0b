"""Same-date (or any-group) ranks, z-scores and quantiles that do not need a group to fit one task.

A time series is bounded by its calendar; the number of symbols on one date is not. Every operator
here therefore has two physical forms with the same result:

* groups known to be small: one window per group;
* larger groups: values are counted per (group, value) with map-side combine, partitioned by ranges of
  (group, value), ranked inside each range, and shifted by the size of the ranges below.
  Only ranges, never whole groups, meet in one task, and rows find their rank by an equi-join that
  adaptive execution may split when one value is very frequent.

The form is chosen by counting the largest group (a column-pruned job), unless the caller knows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import sdiv
from barloom.session import attach_row, cut_lineage

WINDOW_GROUP_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: counted map-side, reduced to one number."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", safe: Sequence[str] | None = None) -> DataFrame:
    """Join on group keys where a NULL key is a group like any other; the keys of the right side go.

    ``safe`` names the keys that may be NULL (all, if not given).
    """
    safe = keys if safe is None else safe
    other = right.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        mine, theirs = F.col(k), F.col(f"_g_{k}")
        match = match & (mine.eqNullSafe(theirs) if k in safe else mine == theirs)
    return left.join(other, match, how).drop(*[f"_g_{k}" for k in keys])


def fits_window(group_rows: int) -> bool:
    return group_rows <= WINDOW_GROUP_ROWS


def _small(df: DataFrame, keys: Sequence[str], group_rows: int | None) -> bool:
    return fits_window(largest_group(df, keys) if group_rows is None else group_rows)


def rank_counts(
    df: DataFrame, keys: Sequence[str], value: str, prefix: str = "", group_rows: int | None = None
) -> DataFrame:
    """Append how many known values of the group are less / equal / known at all.

    Columns ``{prefix}less``, ``{prefix}ties`` (the row itself included) and ``{prefix}total``;
    all NULL where the value is NULL.
    """
    names = [prefix + n for n in ("less", "ties", "total")]
    if _small(df, keys, group_rows):
        known = F.col(value).isNotNull()
        by = Window.partitionBy(*keys, known)
        ordered = by.orderBy(value)
        shown = {
            names[0]: F.rank().over(ordered) - 1,
            names[1]: F.count(F.lit(1)).over(ordered.rangeBetween(0, 0)),
            names[2]: F.count(F.lit(1)).over(by),
        }
        return df.withColumns({n: F.when(known, c.cast("long")) for n, c in shown.items()})
    counts = value_ranks(df, keys, value).withColumnsRenamed(dict(zip(("less", "ties", "total"), names)))
    return join_groups(df, counts, [*keys, value], "left", safe=keys)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (group, value): less, ties, total. Work is split by value range inside a group.

    Counts are range-partitioned by group and value together and written once: the ranges must be the same for the
    sizes and for the ranks, and nothing before them runs again.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counted.repartitionByRange(n, *keys, value).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("ties").alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = ranged.withColumn("_in", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return join_groups(ranked, sizes, [*keys, "_range"], safe=keys).select(
        *keys, value, (F.col("_below") + F.col("_in")).alias("less"), "ties", "total"
    )


def pct_rank_average(less: Column, ties: Column, total: Column) -> Column:
    """Average rank divided by the number of known values (pandas ``rank(pct=True)``)."""
    return (less + (ties + 1) / 2.0) / total


def pct_rank_half(less: Column, ties: Column, total: Column) -> Column:
    """(less + ties/2) / known values."""
    return (less + ties / 2.0) / total


def average_rank(less: Column, ties: Column) -> Column:
    return less + (ties + 1) / 2.0


def add_pct_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, how: str = "average", group_rows=None) -> DataFrame:
    """Percent rank of ``value`` in its group as column ``out``; ``how`` is 'average' or 'half'."""
    formula = {"average": pct_rank_average, "half": pct_rank_half}[how]
    ranked = rank_counts(df, keys, value, "_x_", group_rows)
    cols = [F.col(f"_x_{c}") for c in ("less", "ties", "total")]
    return ranked.withColumn(out, formula(*cols)).drop("_x_less", "_x_ties", "_x_total")


def rank_against(
    queries: DataFrame, universe: DataFrame, keys: Sequence[str], value: str, out: str, group_rows=None
) -> DataFrame:
    """Half-tie percent rank of query values inside the universe of the same group.

    Query values need not occur in the universe: both are ranked together with weight 0 for queries.
    """
    weight = "_w"
    both = queries.withColumn(weight, F.lit(0)).unionByName(
        universe.select(*keys, value).withColumn(weight, F.lit(1)), allowMissingColumns=True
    )
    if _small(both, keys, group_rows):
        known = F.col(value).isNotNull()
        by = Window.partitionBy(*keys, known)
        below = by.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
        equal = by.orderBy(value).rangeBetween(0, 0)
        ties = F.sum(weight).over(equal)
        less = F.sum(weight).over(below) - ties
        total = F.sum(weight).over(by)
        both = both.withColumn(out, F.when(known, sdiv(less + ties / 2.0, total)))
        return both.where(F.col(weight) == 0).drop(weight)
    # Ranks over the union of values; the weights of the queries drop out by subtracting their own ranks.
    all_ranks = value_ranks(both, keys, value)
    query_ranks = value_ranks(queries, keys, value).select(
        *keys, value, F.col("less").alias("_ql"), F.col("ties").alias("_qt"), F.col("total").alias("_qn")
    )
    ranks = join_groups(all_ranks, query_ranks, [*keys, value], safe=keys).select(
        *keys,
        value,
        sdiv(
            F.col("less") - F.col("_ql") + (F.col("ties") - F.col("_qt")) / 2.0,
            (F.col("total") - F.col("_qn")).cast("double"),
        ).alias(out),
    )
    return join_groups(queries, ranks, [*keys, value], "left", safe=keys)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], group_rows=None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group as named columns."""
    if _small(df, keys, group_rows):
        return df.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(q)).alias(n) for n, q in quantiles.items()]
        )
    # Groups without a known value have quantiles too: NULL.
    groups = df.select(*keys).distinct() if keys else None
    ranked = value_ranks(df, keys, value)
    picks = []
    for name, q in quantiles.items():
        place = (F.col("total") - 1) * F.lit(q)
        lo, hi, share = F.floor(place), F.ceil(place), place - F.floor(place)
        holds = lambda p: (F.col("less") <= p) & (p < F.col("less") + F.col("ties"))
        low = F.max(F.when(holds(lo), F.col(value)))
        high = F.max(F.when(holds(hi), F.col(value)))
        picks.append((low + (high - low) * F.max(share)).alias(name))
    found = ranked.groupBy(*keys).agg(*picks)
    return join_groups(groups, found, keys, "left") if keys else found


def robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str, group_rows=None) -> DataFrame:
    """(x - median) / (population std + 1e-9) of the group."""
    if _small(df, keys, group_rows):
        by = Window.partitionBy(*keys)
        mid = F.percentile(value, F.lit(0.5)).over(by)
        return df.withColumn(out, (F.col(value) - mid) / (F.stddev_pop(value).over(by) + 1e-9))
    middle = group_quantiles(df, keys, value, {"_mid": 0.5}, group_rows)
    spread = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    if keys:
        whole = join_groups(join_groups(df, middle, keys, "left"), spread, keys, "left")
    else:
        whole = attach_row(attach_row(df, middle), spread)
    return (
        whole
        .withColumn(out, (F.col(value) - F.col("_mid")) / (F.col("_sd") + 1e-9))
        .drop("_mid", "_sd")
    )


def group_z(df: DataFrame, keys: Sequence[str], value: str, out: str, min_members: int = 10) -> DataFrame:
    """(x - mean) / sample std per group when it has enough known members.

    Moments are aggregated with map-side combine and joined back, so a large group is never gathered.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n")
    )
    z = F.when((F.col("_n") >= min_members) & (F.col("_sd") > 0), (F.col(value) - F.col("_mu")) / F.col("_sd"))
    return join_groups(df, stats, keys, "left").withColumn(out, z).drop("_mu", "_sd", "_n")


def hashed_positions(
    df: DataFrame, keys: Sequence[str], seed: int, identity: Sequence[str], out: str, spread: int = 64
) -> DataFrame:
    """A random 0-based position of every row inside its group, plus ``{out}_n``, the group size.

    Rows are ordered by a seeded hash. The hash is uniform, so its leading part splits a group into
    ``spread`` even ranges that are numbered separately and shifted by the ranges below.
    """
    keys = list(keys)
    h = F.xxhash64(F.lit(seed), *identity)
    tagged = df.withColumn("_h", h).withColumn("_part", F.pmod(F.shiftrightunsigned("_h", 32), F.lit(spread)))
    sizes = tagged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{out}_n"),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_h", *identity)
    numbered = tagged.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        join_groups(numbered, sizes, [*keys, "_part"], safe=keys)
        .withColumn(out, F.col("_below") + F.col("_in"))
        .drop("_h", "_part", "_in", "_below")
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, group_rows: int | None = None) -> DataFrame:
    """1-based position of every row in its group by ``order`` (which must be a total order) and ``{out}_n``.

    Large groups: rows are range-partitioned by group and order together, so neither a large group nor a frequent
    value stays in one task; rows are numbered per partition and shifted by the counts of the partitions before.
    """
    keys = list(keys)
    if _small(df, keys, group_rows):
        by = Window.partitionBy(*keys)
        return df.withColumns({out: F.row_number().over(by.orderBy(*order)), f"{out}_n": F.count(F.lit(1)).over(by)})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Fixed before use: the partition of a row must be the same for the counts and for the numbering.
    placed = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias(f"{out}_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(*order))
    return (
        join_groups(placed.withColumn("_in", inside), sizes, [*keys, "_pid"], safe=keys)
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_pid", "_in", "_before")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """First k rows per group in a total order. Spark keeps only k rows per group before the shuffle."""
    numbered = df.withColumn(out or "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col(out or "_rn") <= k)
    return kept if out else kept.drop("_rn")
