"""Mixing sources to target weights: quotas of permuted blocks, dealt to output shards by a hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.text import word_count
from barloom.session import stored

#: Rows that one hash cell of a source holds about, cells per group of cells, words of a block, words of a shard.
CELL_ROWS, CELL_GROUP, BLOCK_WORDS, SHARD_WORDS = 128, 256, 8192, 1 << 22
WEIGHTS = (5, 2, 1)
#: The hypergeometric draw counts up to 10^9; tasks walk to so many shards each.
MOST_BLOCKS, SHARDS_PER_TASK = 1 << 29, 256


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: n rows, source_size, weight, target. One row per source; the frame it reads is pre-aggregated.

    Targets are ``share`` of all words by weight, each stopped at ``most`` times its source; the excess is reshared by
    weight. That is one water level: with sources ordered by cap over weight, those below the level get their cap.
    """
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    table = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    table = table.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    table = table.withColumn("total", F.sum("source_size").over(every) * share).withColumn("cap", F.col("source_size") * most)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    table = table.withColumn("level", left / F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    table = table.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # The level at the first source that stays below its cap; behind it the running level only falls.
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * rest))
    return table.withColumn("target", target).select("source", "n", "source_size", "weight", "target")


def split_quotas(blocks: np.ndarray, shard: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of every source in one output shard.

    Walks from the root to the shard. At a node the left half of its shards draws its share of the node's blocks
    without replacement (a multivariate hypergeometric draw, seeded by the node), the right half gets the rest. Every
    shard can walk by itself; siblings repeat the same draws, so the quotas add up exactly and blocks are disjoint.
    """
    first, own = np.zeros_like(blocks), blocks.copy()
    lo, hi = 0, n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(own.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, total * (mid - lo) // (hi - lo), method="marginals")
        if shard < mid:
            own, hi = left, mid
        else:
            first, own, lo = first + left, own - left, mid
    return first, own


def block_size(total: float) -> int:
    """Words of a block: ``BLOCK_WORDS``, doubled until all targets together have fewer than ``MOST_BLOCKS`` blocks."""
    words = BLOCK_WORDS
    while total / words > MOST_BLOCKS:
        words *= 2
    return words


def deal_blocks(spark: SparkSession, quotas: list[tuple[str, float]], block: int, seed: int) -> DataFrame:
    """(name, shard, first, blocks): disjoint runs of every source's permuted blocks, by output shard.

    ``quotas`` has the target of every source. Shards are dealt to tasks; each walks to its own shards only.
    """
    quotas = sorted(quotas)
    blocks = np.array([math.ceil(t / block) for _, t in quotas], np.int64)
    n_shards = max(1, math.ceil(math.fsum(t for _, t in quotas) / SHARD_WORDS))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard in batch.column("shard").to_pylist():
                first, own = split_quotas(blocks, shard, n_shards, seed)
                rows += [(name, shard, int(a), int(k)) for (name, _), a, k in zip(quotas, first, own) if k]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["name", "shard", "first", "blocks"])

    shards = spark.range(0, n_shards, 1, -(-n_shards // SHARDS_PER_TASK)).toDF("shard")
    return shards.mapInArrow(walk, "name string, shard long, first long, blocks long")


def lay_out(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with ``at``: the words of the source before the row in the source's permuted order.

    The order is by hash cell and hash within it. Cells hold about ``CELL_ROWS`` rows, so a source with a third of all
    rows is many small windows; the cells before are summed over groups of cells.
    """
    keyed = sizes.select("*", source_key().alias("name"))
    shape = targets.select(source_key().alias("name"), "n", "source_size", "target")
    cells = F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("long")
    rows = keyed.join(F.broadcast(shape), "name").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("cell", F.pmod("_h", cells))
    per_cell = rows.groupBy("name", "cell").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("cell") / CELL_GROUP))
    per_cell = stored(per_cell, "mix-cells")
    past = (Window.unboundedPreceding, -1)
    groups = per_cell.groupBy("name", "group").agg(F.sum("words").alias("group_words"))
    groups = groups.withColumn("group_at", F.coalesce(F.sum("group_words").over(Window.partitionBy("name").orderBy("group").rowsBetween(*past)), F.lit(0)))
    inside = F.coalesce(F.sum("words").over(Window.partitionBy("name", "group").orderBy("cell").rowsBetween(*past)), F.lit(0))
    cell_at = per_cell.withColumn("inside", inside).join(groups, ["name", "group"]).select("name", "cell", (F.col("group_at") + F.col("inside")).alias("cell_at"))
    near = Window.partitionBy("name", "cell").orderBy("_h", "doc_id", "size", "row").rowsBetween(*past)
    placed = rows.join(cell_at, ["name", "cell"]).withColumn("at", F.col("cell_at") + F.coalesce(F.sum("size").over(near), F.lit(0)))
    return placed.drop("cell_at")


def taken_copies(source_size: Column, target: Column, at: Column, size: Column) -> Column:
    """Passes over the source whose middle of the row lies before the target: 0, 1 or 2 at a target of up to twice the source."""
    middle = at + size / 2
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.ceil((target - middle) / source_size), F.lit(0))).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, seed: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, row, size, source_size, target, copies, taken, places.

    A source's rows lie in a permuted order on a line of words that is walked again when it ends; the first
    ``target`` words are cut into blocks, and a row belongs to the block that its start lies in. A row is taken once for
    each of its blocks that an output shard drew, if its middle lies before the target: ``copies`` counts them, and
    ``places`` names per copy the shard and the row's place (order) in the shard's local shuffle. Whole documents are
    taken, so a source misses its target by half a document at most. A null source is a source of its own, the last
    one; a text without words has size 0 and is never taken; repeated rows are rows of their own; an empty table gives
    no rows. The same rows and seed give the same mix.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share), "mix-targets")
    quotas = [(r["name"], r["target"]) for r in targets.select(source_key().alias("name"), "target").collect()]
    block = block_size(math.fsum(t for _, t in quotas))
    passes = taken_copies(F.col("source_size"), F.col("target"), F.col("at"), F.col("size"))
    walked = F.transform(F.sequence(F.lit(0), passes - 1), lambda p: F.floor((F.col("at") + p * F.col("source_size")) / block))
    laid = stored(lay_out(sizes, targets, seed).withColumn("blocks", F.when(passes > 0, walked)), "mix-rows")
    dealt = deal_blocks(docs.sparkSession, quotas, block, seed)
    # A run of blocks opens at its first block: the run of a block is the last one opened before it, found by cell of blocks.
    stride = 64
    opened = dealt.select("name", "shard", F.explode(F.sequence(F.floor(F.col("first") / stride), F.floor((F.col("first") + F.col("blocks") - 1) / stride))).alias("span"), "first", "blocks")
    want = laid.where("blocks is not null").select("row", "name", F.explode("blocks").alias("block")).withColumn("span", F.floor(F.col("block") / stride))
    hit = want.join(opened, ["name", "span"]).where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("blocks")))
    places = hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("shard", F.xxhash64(F.lit(seed + 1), "block", "row").alias("order")))).alias("places"))
    out = laid.join(places, "row", "left").withColumn("copies", F.coalesce(F.size("places"), F.lit(0)))
    return out.select("doc_id", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "places")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: each row as often as it is taken, all columns kept, laid out shard by shard.

    Rows are sorted by the shard that drew them and their place in it, so the partitions in their order are the shards
    one after another. Rows that share a doc_id share the copies of one another in doc_id: each of them is taken its
    own number of times, dealt in the order of size. The texts meet the mix in one shuffle; only rows that agree in
    doc_id and size are numbered, in a second one.
    """
    mixed = mix(docs, **options).select(F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_size"), F.col("places").alias("_mix_places"), "copies", "row")
    mixed = stored(mixed, "mix-copies")
    keys = mixed.groupBy(F.col("_mix_id").alias("_mix_key"), F.col("_mix_size").alias("_mix_key_size")).agg(
        F.count(F.lit(1)).alias("_mix_rows"), F.max("copies").alias("_mix_most"), F.first("_mix_places").alias("_mix_only")
    )
    same_key = F.col("doc_id").eqNullSafe(F.col("_mix_key")) & (F.col("_mix_words") == F.col("_mix_key_size"))
    met = docs.withColumn("_mix_words", word_count(F.col("text"))).join(keys.where("_mix_most > 0"), same_key)
    alone = met.where("_mix_rows = 1").withColumn("_mix_places", F.col("_mix_only"))
    nth = F.row_number().over(Window.partitionBy("_mix_id", "_mix_size").orderBy("row"))
    copies = mixed.where("copies > 0").withColumn("_mix_nth", nth).drop("row", "copies")
    again = Window.partitionBy("doc_id", "_mix_words").orderBy(F.xxhash64("text"), "source")
    shared = met.where("_mix_rows > 1").withColumn("_mix_place", F.row_number().over(again))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_words") == F.col("_mix_size")) & (F.col("_mix_place") == F.col("_mix_nth"))
    columns = [*docs.columns, "_mix_places"]
    taken = alone.select(*columns).unionByName(shared.join(copies, same).select(*columns))
    taken = taken.withColumn("_mix_at", F.explode("_mix_places"))
    return taken.orderBy("_mix_at.shard", "_mix_at.order").select(*docs.columns)
