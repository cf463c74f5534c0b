"""Matched controls, random baselines and resampling; every draw is a seeded hash, so reruns agree."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cross_section import hashed_positions, join_groups


def same_symbol_controls(events: DataFrame, bars: DataFrame, seed: int, warmup: int) -> DataFrame:
    """For each event one random row of the same symbol that is past the warm-up and carries no event.

    Without replacement while rows last, then around again. Adds ``ctrl_pos``. Both sides of a symbol are bounded
    by its calendar.
    """
    pool = bars.where(F.col("pos") > warmup).select("sym", F.col("pos").cast("long").alias("ctrl_pos"))
    taken = events.select("sym", F.col("sig_pos").cast("long").alias("ctrl_pos")).distinct()
    pool = pool.join(taken, ["sym", "ctrl_pos"], "left_anti")
    shuffled = Window.partitionBy("sym").orderBy(F.xxhash64(F.lit(seed), "sym", "ctrl_pos"), "ctrl_pos")
    pool = pool.withColumns({"_at": F.row_number().over(shuffled) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("sym"))})
    sizes = pool.select("sym", "_n").distinct()
    order = Window.partitionBy("sym").orderBy(F.xxhash64(F.lit(seed + 1), "sym", "sig_pos", "event_id"), "event_id")
    drawn = events.withColumn("_i", F.row_number().over(order) - 1).join(sizes, "sym")
    drawn = drawn.withColumn("_at", F.pmod(F.col("_i"), F.col("_n")).cast("int")).drop("_i", "_n")
    return drawn.join(pool.select("sym", "_at", "ctrl_pos"), ["sym", "_at"]).drop("_at")


def same_day_controls(events: DataFrame, bars: DataFrame, seed: int) -> DataFrame:
    """For each event a random other symbol with a row and no event that day; none if there is no such symbol.

    Adds ``ctrl_sym``. A day may hold very many symbols: positions inside a day are numbered by hash ranges and
    each event looks one position up, so no day is gathered in one task.
    """
    pool = bars.select("sym", "d").join(events.select("sym", "d").distinct(), ["sym", "d"], "left_anti")
    placed = hashed_positions(pool, ["d"], seed, ["sym"], "_at")
    sizes = placed.groupBy("d").agg(F.max("_at_n").alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "event_id"), F.col("_n")).cast("long")
    wanted = events.join(sizes, "d").withColumn("_at", draw)
    chosen = placed.select("d", F.col("_at").cast("long").alias("_at"), F.col("sym").alias("ctrl_sym"))
    return wanted.join(chosen, ["d", "_at"]).drop("_at", "_n")


def random_picks(df: DataFrame, keys: Sequence[str], identity: Sequence[str], k: int, repetitions: int, seed: int) -> DataFrame:
    """``k`` different random rows of every group, ``repetitions`` times over, tagged ``rep``.

    Only positions are drawn and looked up, so the work is groups x repetitions x k, not rows x repetitions. The
    i-th pick is drawn from what is left: its place is shifted past the earlier picks in ascending order. Groups with
    fewer than k rows give all of theirs.
    """
    placed = hashed_positions(df, keys, seed, identity, "_at")
    groups = placed.groupBy(*keys).agg(F.max("_at_n").alias("_n"))
    draws = groups.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    taken = F.expr("cast(array() as array<bigint>)")
    for i in range(k):
        left = F.col("_n") - i
        raw = F.when(left > 0, F.pmod(F.xxhash64(F.lit(seed + 1 + i), "rep", *keys), left))
        spot = F.aggregate(F.sort_array(taken), raw, lambda a, t: F.when(a >= t, a + 1).otherwise(a))
        draws = draws.withColumn(f"_t{i}", F.when(spot.isNotNull(), F.concat(taken, F.array(spot))).otherwise(taken))
        taken = F.col(f"_t{i}")
    wanted = draws.select(*keys, "rep", F.explode(taken).alias("_at"))
    rows = placed.withColumn("_at", F.col("_at").cast("long")).drop("_at_n")
    return join_groups(wanted, rows, [*keys, "_at"], safe=keys).drop("_at")


def random_anchor_coverage(truth: DataFrame, anchors: DataFrame, rows: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Expected share of truth lows within ``width`` rows of a random anchor set of the same size, in closed form.

    ``anchors`` is (sym, m) and ``rows`` is (sym, n): each of m independent uniform anchors misses a low with
    probability 1 - p, where p is the share of rows within reach.
    """
    joined = truth.join(anchors, "sym", "left").join(rows, "sym")
    shares = []
    for w in widths:
        reach = F.least(F.col("low_pos") + w, F.col("n")) - F.greatest(F.col("low_pos") - w, F.lit(1)) + 1
        shares.append(F.avg(1.0 - F.pow(1.0 - reach / F.col("n"), F.coalesce(F.col("m"), F.lit(0)))).alias(f"cover_le{w}"))
    return joined.agg(*shares)


def random_anchor_draws(anchors: DataFrame, rows: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """(rep, sym, anchor_pos): m uniform positions per symbol and repetition."""
    base = anchors.join(rows, "sym").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    base = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return base.select("rep", "sym", (F.pmod(F.xxhash64(F.lit(seed), "rep", "sym", "i"), F.col("n")) + 1).alias("anchor_pos"))


def spot_sample(cells: DataFrame, n: int, seed: int, identity: Sequence[str]) -> DataFrame:
    """A seeded sample of n cells for re-checks; a top-n of hashes, no full sort."""
    return cells.orderBy(F.xxhash64(F.lit(seed), *identity), *identity).limit(n)


def poisson_weight(seed: int, *cols: str):
    """Poisson(1) count from a seeded hash, by its distribution function, as far as double precision can tell it from 1."""
    u = (F.xxhash64(F.lit(seed), *cols) / F.lit(2.0**64)) + 0.5
    last = 18
    out, total, mass = F.lit(last), 0.0, 0.36787944117144233
    edges = []
    for k in range(last):
        total += mass
        edges.append((k, total))
        mass /= k + 1
    for k, edge in reversed(edges):
        out = F.when(u < edge, k).otherwise(out)
    return out


#: Cumulative law of Poisson(1), to the last double below 1: a uniform is turned into a count by its place here.
POISSON_ONE = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(19)])
#: Days whose weights of all draws a task holds at a time.
BOOTSTRAP_DAYS = 32


def replicate_weights(days: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each day (a 64-bit hash) counts in each draw: Poisson(1), fixed by seed, day and draw."""
    mixed = days.astype(np.uint64)[:, None] ^ (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64)))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(POISSON_ONE, uniform, side="right").astype(np.float64)


def replicate_sums(per_day: DataFrame, values: Sequence[str], draws: int, seed: int, day: str = "d") -> DataFrame:
    """(draw, values): sums of every draw. A task adds up the vectors of all draws over its days and hands on one row, so what
    moves is tasks x draws, whatever the number of days."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values), draws))
        for batch in batches:
            hashes = batch.column("_h").to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.stack([batch.column(v).to_numpy(zero_copy_only=False).astype(np.float64) for v in values])
            for at in range(0, len(hashes), BOOTSTRAP_DAYS):
                total += x[:, at : at + BOOTSTRAP_DAYS] @ replicate_weights(hashes[at : at + BOOTSTRAP_DAYS], draws, seed)
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.float64())) for row in total], names=list(values))

    rows = per_day.select(F.xxhash64(day).alias("_h"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    vectors = rows.mapInArrow(run, ", ".join(f"{v} array<double>" for v in values))
    each = vectors.select(F.posexplode(F.arrays_zip(*values)).alias("draw", "x")).select((F.col("draw") + 1).alias("draw"), "x.*")
    return each.groupBy("draw").agg(*[F.sum(v).alias(v) for v in values])


def day_bootstrap(per_day: DataFrame, total: str, count: str, draws: int, seed: int, day: str = "d") -> DataFrame:
    """Means of ``draws`` day-resampled copies: each day is repeated Poisson(1) times per draw."""
    sums = replicate_sums(per_day, [total, count], draws, seed, day)
    return sums.select("draw", F.try_divide(total, count).alias("mean"))


def shuffled_within(df: DataFrame, keys: Sequence[str], column: str, identity: Sequence[str], seed: int, out: str) -> DataFrame:
    """``column`` permuted at random inside each group: rows and values are numbered by two different hashes."""
    rows = hashed_positions(df, keys, seed, identity, "_i").drop("_i_n")
    values = hashed_positions(df.select(*keys, *identity, column), keys, seed + 1, identity, "_i")
    return join_groups(rows, values.select(*keys, "_i", F.col(column).alias(out)), [*keys, "_i"], safe=keys).drop("_i")
