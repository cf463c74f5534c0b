"""The Merkle manifest against trees folded by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, steps from every node: left and right siblings)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // 16 * 16
            run = nodes[first : first + 16]
            paths[i].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([trees[s][1] for s in sources])
    out = []
    for s, stem in zip(sources, above):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            path = path + stem
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf((*r[:4], lowered(r[4]))) if hit else leaf(r)
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(docs):
    want = by_hand([tuple(r) for r in docs.select(*FIELDS).collect()])
    got = [tuple(r) for r in merkle.merkle_manifest(docs).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_odd_rows(odd):
    got = check(odd)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_smallest_table(corpus):
    check(corpus)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257, 300])
def test_one_source_of_many_sizes(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.concat(F.lit("T"), "id").alias("text"))
    check(docs)


def test_many_lone_sources(spark):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("é"), "id").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("n_chars"), F.lit("A").alias("text")
    )
    check(docs)


def test_hot_source_repeated_rows_and_ids(spark):
    """A source with most rows, one row many times and one doc_id many times."""
    rows = [(i % 50, "hot", "en", 1, "Same") for i in range(400)] + [(7, "hot", "en", 1, f"t{i}") for i in range(60)] + [(1, None, None, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(5)
    # Equal rows have equal leaves, but those of one run border differ in their siblings: as many of each.
    check(docs)


def test_ranges_keep_a_hot_source_apart(spark):
    docs = spark.range(4000).select(F.lit("0").alias("branch"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("row"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.numbered(docs, "branch", ["doc_id", "digest", "row"])
        assert got.where("idx <> doc_id OR n <> 4000").count() == 0
        placed = docs.repartitionByRange(F.col("branch"), F.col("doc_id")).groupBy(F.spark_partition_id()).count()
        assert placed.agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_clashing_columns(nothing, odd, clashing):
    assert merkle.merkle_manifest(nothing).count() == 0
    extra = clashing.select("*", *[F.lit(1).alias(c) for c in ("branch", "idx", "n", "leaf", "path", "slot0", "child", "_at", "_part")])
    got = [sorted((tuple(r) for r in merkle.merkle_manifest(d).select(*COLUMNS).collect()), key=repr) for d in (odd, extra)]
    assert got[0] == got[1]
