"""Merkle manifest of a table: slot pivots spread the children of a node into columns, upward for hashes, downward for proofs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import discard, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it, so that no two rows spell the same bytes."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def leaf_rows(docs: DataFrame, tamper_every: int = 5) -> DataFrame:
    """(branch, doc_id, digest, tampered, row): one pass over the texts, narrow rows from there on.

    ``branch`` names the source and sorts like it, null first. ``tampered`` is the leaf of the changed row, null where
    nothing changes. ``row`` tells rows apart that agree in all else.
    """
    own = {c: F.col(c).cast("string") for c in FIELDS}
    hit = F.crc32(own["doc_id"].cast("binary")) % tamper_every == 0
    changed = [*[own[c] for c in FIELDS[:-1]], F.translate(own["text"], UPPER, LOWER)]
    branch = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    rows = docs.select(
        branch.alias("branch"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(list(own.values())).alias("digest"),
        F.when(hit, leaf_digest(changed)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stored(rows, "leaves")


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx (from 0, by ``order``) and n (size) within their tree.

    Rows are dealt by ranges of tree and order together, so a tree of a third of all rows is many tasks. A row's place
    in its task and the counts of the tasks before give idx; only one row per tree and task meets in a window.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed")
    parts = placed.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(tree, "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(tree)).alias("n"))
    placed = placed.join(parts, [tree, "_part"])
    return placed.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def slot_pivot(nodes: DataFrame, held: Column) -> DataFrame:
    """One row per run of ``FANOUT`` nodes: its place one level up and the children in columns slot0, slot1, ..."""
    slot = F.pmod("idx", F.lit(FANOUT))
    spread = [F.max(F.when(slot == j, held)).alias(f"slot{j}") for j in range(FANOUT)]
    up = F.floor(F.col("idx") / FANOUT)
    return nodes.where("n > 1").groupBy("branch", up.alias("idx")).agg(F.max("n").alias("n"), *spread)


def slot_digests(pivot: DataFrame) -> list[Column]:
    """The digests of the children, null behind the last one."""
    return [F.col(f"slot{j}.digest") for j in range(FANOUT)]


def parents(pivot: DataFrame) -> DataFrame:
    """(branch, idx, n, digest): a run becomes the hash of its columns side by side."""
    return pivot.select("branch", "idx", F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2(F.concat_ws("", *slot_digests(pivot)), 256).alias("digest"))


def grow(nodes: DataFrame, held: Column) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and (branch, digest) of the node that remains of each tree.

    ``held`` is a struct with the digest and what else a child of the lowest level carries. The number of levels is
    the logarithm of the largest tree.
    """
    widest = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("branch", "digest")
    while widest > 1:
        levels.append(stored(slot_pivot(nodes, held), "pivot"))
        nodes = parents(levels[-1])
        tops = tops.unionByName(nodes.where("n = 1").select("branch", "digest"))
        held = F.struct("digest")
        widest = -(-widest // FANOUT)
    return levels, tops


def children(pivot: DataFrame, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(branch, idx, child, path, *carried) of every child: the columns beside its own, left and right of it, lead its path.

    ``above`` holds the path of each pivot's own node; ``top`` is true for nodes that are all that remains of a tree.
    """
    kids = F.array(*[f"slot{j}" for j in range(FANOUT)])
    joined = pivot.withColumn("top", F.col("n") <= FANOUT).join(above, ["branch", "idx", "top"])
    kid = joined.select("branch", "idx", "path", *carried, kids.alias("kids"), F.posexplode(kids).alias("slot", "child")).where("child IS NOT NULL")
    left = F.array_join(F.slice("kids.digest", F.lit(1), F.col("slot")), "")
    right = F.array_join(F.slice("kids.digest", F.col("slot") + 2, F.lit(FANOUT)), "")
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
    return kid.select("branch", (F.col("idx") * FANOUT + F.col("slot")).alias("idx"), "child", path.alias("path"), *carried)


def descend(levels: list[DataFrame], tops: DataFrame, carried: Sequence[str]) -> DataFrame | None:
    """The children of the lowest level with their whole paths; ``tops`` has (branch, path, *carried) of every tree."""
    tops = tops.select("branch", F.lit(0).cast("long").alias("idx"), F.lit(True).alias("top"), "path", *carried)
    above, kids = tops, None
    for i, level in enumerate(reversed(levels)):
        kids = children(level, above, carried)
        if i + 1 < len(levels):  # the next level's paths are a table, so that no job grows with the height
            above = stored(tops.unionByName(kids.select("branch", "idx", F.lit(False).alias("top"), "path", *carried)), "paths")
    return kids


def merkle_manifest(docs: DataFrame, tamper_every: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified, height.

    A source's leaves ascend by doc_id; runs of ``FANOUT`` nodes become their hash until one node, the subroot, is
    left; subroots by source (null first) give the root likewise. The proof is the nodes beside a leaf's path to the
    root. ``folded_root`` folds a leaf back through them, the changed leaf where ``tamper_every`` divides the CRC-32 of
    doc_id; ``verified`` says whether the root comes out. ``height`` counts the levels passed.

    Nulls in any field are leaves of their own kind; rows that share a doc_id are ordered by digest, null doc_ids come
    first; equal rows are leaves of their own. A lone leaf is its subroot, a lone subroot the root. Very long texts are
    hashed once, in the row. An empty table gives no rows. Other columns are not read.
    """
    rows = leaf_rows(docs, tamper_every)
    leaves = stored(numbered(rows, "branch", ["doc_id", "digest", "row"]).drop("row"), "numbered-leaves")
    discard(rows)
    levels, subroots = grow(leaves, F.struct("digest", "doc_id", "tampered"))
    subroots = subroots.select(F.lit("").alias("tree"), F.col("branch").alias("source_branch"), "digest")
    stems = stored(numbered(subroots, "tree", ["source_branch"]).withColumnRenamed("tree", "branch"), "subroots")
    upper, top = grow(stems, F.struct("digest", "source_branch"))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = top.select("branch", empty.alias("path"), F.col("digest").alias("root"))
    kids = descend(upper, top, ["root"])
    paths = stems.where("n = 1").join(top, "branch").select(F.col("source_branch").alias("branch"), F.col("digest").alias("subroot"), "path", "root")
    if kids is not None:
        paths = paths.unionByName(kids.select(F.col("child.source_branch").alias("branch"), F.col("child.digest").alias("subroot"), "path", "root"))
    paths = stored(paths, "subroot-paths")
    out = leaves.where("n = 1").join(paths, "branch").select(F.struct("digest", "doc_id", "tampered").alias("child"), "path", "subroot", "root")
    kids = descend(levels, paths, ["subroot", "root"])
    if kids is not None:
        out = out.unionByName(kids.select("child", "path", "subroot", "root"))
    folded = F.aggregate("path", F.coalesce("child.tampered", "child.digest"), lambda own, at: F.sha2(F.concat(at["left"], own, at["right"]), 256))
    beside = F.concat_ws("", F.transform("path", lambda at: F.concat(at["left"], at["right"])))
    out = out.select(
        "child.doc_id", F.col("child.digest").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root"), F.size("path").alias("height")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(levels: int = 8, tamper_every: int = 5) -> str:
    """DuckDB SQL for the rows of ``merkle_manifest`` on trees of up to ``FANOUT ** levels`` nodes.

    Levels are unrolled; a tree of one node is handed up unchanged. A node's siblings are its run's list without its
    own place. CRC-32 is written out bit by bit.
    """
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    spelled = [field.format(c) for c in FIELDS]
    changed = " || ".join([*spelled[:-1], field.format(f"translate(text, '{UPPER}', '{LOWER}')")])
    crc = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
    run = f"PARTITION BY branch, idx // {FANOUT}"
    steps = [
        f"""leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS branch, sha256({" || ".join(spelled)}) AS leaf,
            CASE WHEN {crc} % {tamper_every} = 0 THEN sha256({changed}) END AS tampered FROM documents)""",
        """a0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY branch) AS n FROM leaves)""",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            steps.append(
                f"""{name}{k + 1} AS (SELECT branch, idx // {FANOUT} AS idx, ceil(n / {FANOUT})::BIGINT AS n,
                CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY {name}{k}.idx)) ELSE any_value(digest) END AS digest FROM {name}{k} GROUP BY branch, {name}{k}.idx // {FANOUT}, n)"""
            )
            steps.append(
                f"""{name}_beside{k} AS (SELECT branch, idx, n > 1 AS turn, {"" if k else "doc_id, leaf, tampered, " if name == "a" else "source_branch, "}
                coalesce(string_agg(digest, '') OVER ({run} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
                coalesce(string_agg(digest, '') OVER ({run} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM {name}{k})"""
            )

    climb("a")
    steps.append(f"b0 AS (SELECT '' AS branch, branch AS source_branch, digest, row_number() OVER (ORDER BY branch) - 1 AS idx, count(*) OVER () AS n FROM a{levels})")
    climb("b")
    # One step per level: the text to the left and right of the own digest; a level that was not passed stays out.
    fold, proof, digest = "coalesce(x.tampered, x.leaf)", [], []
    joins = []
    for name, base in (("a", "x"), ("b", "y")):
        for k in range(levels):
            at = f"{name}p{k}"
            joins.append(f"JOIN {name}_beside{k} {at} ON {at}.branch = {base}.branch AND {at}.idx = {base}.idx // {FANOUT**k}")
            proof.append(f"CASE WHEN {at}.turn THEN {at}.lefts || {at}.rights ELSE '' END")
            digest.append(at)
        if name == "a":
            joins.append("JOIN b0 y ON y.source_branch = x.branch")
    folds, last = [], "f0"
    folds.append(
        f"""f0 AS (SELECT x.doc_id, x.leaf, y.digest AS subroot, {fold} AS own, {" || ".join(proof)} AS beside, (SELECT digest FROM b{levels}) AS root,
        {", ".join(f"{at}.turn AS {at}_turn, {at}.lefts AS {at}_l, {at}.rights AS {at}_r" for at in digest)} FROM a0 x {" ".join(joins)})"""
    )
    for i, at in enumerate(digest):
        folds.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {at}_turn THEN sha256({at}_l || own || {at}_r) ELSE own END AS own) FROM f{i})")
        last = f"f{i + 1}"
    height = " + ".join(f"{at}_turn::INT" for at in digest)
    return f"""WITH {", ".join(steps + folds)}
        SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, own AS folded_root, ({height})::INT AS height, own = root AS verified FROM {last}"""
