"""Connected components over an edge table, to the fixpoint."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import discard, stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _points_at_roots(edges: DataFrame) -> bool:
    """Every node has one link, and it leads to a node without one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("own"), F.lit(1).alias("root")))
    nodes = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("root").alias("root"))
    return nodes.where((F.col("own") > 1) | ((F.col("own") == 1) & (F.col("root") == 1))).count() == 0


def contracted(links: DataFrame, per_task: int = 1 << 18) -> DataFrame:
    """(a, b): links that connect what ``links`` connect, each slice's nodes led to the smallest one they reach inside it.

    There are as many slices as ``per_task`` links each need, so few links meet in one task and a search over them has
    little left to do; more links are more tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := group.setdefault(i, i)) != i:
                group[i] = i = group[up]
            return i

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                group[max(a, b)] = min(a, b)
        ends = [(i, r) for i in group if (r := root(i)) != i]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

    known = links.where(F.col("a") != F.col("b")).select("a", "b")
    slices = -(-known.count() // per_task)
    return known.repartition(max(slices, 1)).mapInArrow(run, "a long, b long")


def star_forest(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable through links (a, b), for every node that has a link.

    Alternating stars: the large star links every larger neighbour of a node to the node's least neighbour, the small
    star does so for the smaller ones. Both keep what is connected, and links always lead to the smaller node; so the
    search is over when every node points at a node that points nowhere. The rounds grow with the logarithm of the
    longest path. Tables of a round go when the next one is written. Loops and NULL ends are passed over.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(links.where(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _points_at_roots(edges):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = _least_neighbour(both)
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.least("m", "a").alias("b")).distinct()
        large = stored(large, "large-star")
        least_large = _least_neighbour(large)
        joined = large.join(least_large, "a")
        small = joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(least_large.select("a", F.col("m").alias("b")))
        read, edges = (edges, least, large, least_large), stored(small.distinct(), "small-star")
        for table in read:
            discard(table)
    return edges.select(a.alias("node"), b.alias("root"))
