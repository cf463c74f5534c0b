"""MinHash near-dedup by chosen paths: trees of minwise tokens split documents until nodes are small enough to compare."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.simhash_groups import shingle_hashes, text_mark
from barloom.llm.text import chunks, row_key, runs, utf8
from barloom.operators.components import contracted, star_forest
from barloom.session import discard, stored

#: Minwise tokens of a document; two bits of each make its sketch.
FUNCTIONS = 128
SKETCH = ("s0", "s1", "s2", "s3")
PAIR_BITS = 0x5555555555555555
TREES = 8
#: Members of a node that are compared exhaustively in one step, and shingles that their sets may have together.
SMALL, SMALL_SHINGLES = 512, 1 << 22
#: Levels of branching; nodes that are still large then are compared block by block, and so are large nodes whose
#: blocks together have no more than BLOCK_ROWS rows for each row of the first level.
DEEPEST, BLOCK_ROWS = 8, 0.5
#: Blocks are compared by sketches first, which need no sets: so many times ``SMALL`` members then meet in one step,
#: ``TILE`` of them at a time. Of a tile's close pairs the closest of each member are tried ``PICKS`` times before all are.
WIDE, TILE, PICKS = 8, 512, 3
#: Members per large node that all others are held against.
LEADERS = 16
STEP = 2048


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS, SHIFTS = _odd(11, FUNCTIONS), _odd(12, FUNCTIONS)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` make one, none make none."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of every function over a set, ``STEP`` members at a time."""
    out = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), STEP):
        values = (MULTIPLIERS[:, None] * hashes[None, at : at + STEP] + SHIFTS[:, None]) >> np.uint64(32)
        np.minimum(out, values.min(axis=1), out=out)
    return out.astype(np.uint32)


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Two low bits of every token, side by side in four words per document."""
    two = (tokens & np.uint32(3)).astype(np.uint8)
    bits = np.stack([two & 1, two >> 1], axis=2).reshape(len(tokens), -1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def most_apart(similarity: float) -> int:
    """Tokens of a sketch in which a pair of this similarity differs at most: 3.7 standard deviations over its mean."""
    differs = 0.75 * (1 - similarity)
    return int(FUNCTIONS * differs + 3.7 * math.sqrt(FUNCTIONS * differs * (1 - differs)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def branches(nodes: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): every row takes one branch of its node, and a second one so often that 1/similarity are taken.

    A node's own value decides which tokens select its branches, so all members select alike and stay together where
    they agree in that token. A pair of the given similarity then stays together in one branch of a node on average.
    """
    every = np.arange(len(nodes))
    first = mix(nodes + np.uint64(1)) % np.uint64(FUNCTIONS)
    other = (first + np.uint64(1) + mix(nodes + np.uint64(2)) % np.uint64(FUNCTIONS - 1)) % np.uint64(FUNCTIONS)
    twice = every[(mix(nodes + np.uint64(3)) >> np.uint64(11)).astype(np.float64) < (1 / similarity - 1) * 2.0**53]
    rows = np.r_[every, twice]
    token = np.r_[first, other[twice]]
    value = tokens[rows, token.astype(np.int64)].astype(np.uint64)
    return rows, mix(mix(nodes[rows] + token + np.uint64(7)) ^ (value * np.uint64(0x9E3779B97F4A7C15)))


def token_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, n, key, tokens): size and digest of a document's set, and its minwise tokens; key is null without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = [shingle_set(x, width) for x in utf8(part)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            tokens = [minima(s).tobytes() if len(s) else None for s in sets]
            columns = [part.column("doc_id").cast(pa.int64()), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "key", "tokens"])

    return docs.select("doc_id", "text", text_mark().alias("mark")).mapInArrow(run, "doc_id long, mark long, n long, key binary, tokens binary")


def set_classes(prints: DataFrame) -> DataFrame:
    """One row per distinct set: cid, key, n, tokens, its smallest doc_id, and the key of a row that has it."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("head")
    each = prints.where(F.col("key").isNotNull()).groupBy("key", "n").agg(head, F.first("tokens").alias("tokens"))
    row = row_key(F.col("mark").cast("string"))
    return stored(
        each.select("key", "n", "tokens", "head.doc_id", "head.mark").select(F.monotonically_increasing_id().alias("cid"), "key", "n", "tokens", F.col("doc_id").alias("first_id"), row.alias("row")),
        "set-classes",
    )


def grown(members: DataFrame, similarity: float, trees: int = 0) -> DataFrame:
    """(node, cid, n, sketch) one level down: of ``trees`` roots for every class, or of the member's own ``node``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
            sketch = sketch_of(tokens).view(np.int64)
            cid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n"))
            own = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for tree in range(max(trees, 1)):
                start = np.full(len(cid), mix(np.array([tree + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03))[0]) if trees else own
                rows, child = branches(start, tokens, similarity)
                columns = [child.view(np.int64), cid[rows], n[rows], *[np.ascontiguousarray(sketch[rows, i]) for i in range(4)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "cid", "n", *SKETCH])

    kinds = "node long, cid long, n long, s0 long, s1 long, s2 long, s3 long"
    return members.select("cid", "n", "tokens", F.lit(0).cast("long").alias("node") if trees else "node").mapInArrow(run, kinds)


def close_pairs(n: np.ndarray, sketch: np.ndarray, percent: int, apart: int) -> np.ndarray:
    """Pairs (i < j) of a node whose sizes and sketches allow the similarity."""
    differ = sketch[:, None, :] ^ sketch[None, :, :]
    away = np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(PAIR_BITS)).sum(axis=2)
    fits = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    return np.argwhere(np.triu((away <= apart) & fits, 1))


def spanning(pairs: np.ndarray, size: int) -> np.ndarray:
    """Pairs that connect what all the pairs connect."""
    group = list(range(size))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    keep: list[tuple[int, int]] = []
    for i, j in pairs.tolist():
        if len(keep) == size - 1:
            break
        a, b = root(i), root(j)
        if a != b:
            group[max(a, b)] = min(a, b)
            keep.append((i, j))
    return np.array(keep, np.int64).reshape(-1, 2)


def node_runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by node, cut between nodes; binary columns as objects."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        yield [x[:last] for x in held]
        held = [x[last:] for x in held]
    if held is not None:
        yield held


def node_slices(node: np.ndarray) -> Iterator[slice]:
    starts, sizes = runs(node)
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        yield slice(start, start + size)


def small_node_pairs(rows: DataFrame, percent: int, apart: int) -> DataFrame:
    """(a, b, node) of candidates in small nodes: all close pairs of a node that has few, else as many as connect them, with
    the node's name, so that the node is looked at again. A task streams its nodes and holds one at a time."""
    names = ["node", "cid", "n", *SKETCH]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, cid, n, *words in node_runs(batches, names):
            sketch = np.stack(words, axis=1).view(np.uint64)
            found = [(np.zeros(0, np.int64),) * 3]
            for at in node_slices(node):
                size = at.stop - at.start
                pairs = close_pairs(n[at], sketch[at], percent, apart)
                dense = len(pairs) > 2 * size
                pairs = spanning(pairs, size) if dense else pairs
                found.append((cid[at][pairs[:, 0]], cid[at][pairs[:, 1]], np.full(len(pairs), node[at.start] if dense else 0)))
            a, b, name = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(name)], names=["a", "b", "node"])

    return rows.select(*names).repartition("node").sortWithinPartitions("node", "cid").mapInArrow(run, "a long, b long, node long")


def common_members(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one: products of their incidence, ``step`` members at a time."""
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    border = sum(map(len, left))
    in_both = np.zeros(len(values), np.int8)
    in_both[place[:border]] = 1
    in_both[place[border:]] |= 2
    shared = in_both == 3
    column = np.cumsum(shared) - 1
    sides = []
    for sets, at in ((left, place[:border]), (right, place[border:])):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared[at]]
        at = column[at[shared[at]]]
        order = np.argsort(at, kind="stable")
        sides.append((len(sets), at[order], owner[order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(shared.sum()), step):
        blocks = []
        for size, at, owner in sides:
            lo, hi = np.searchsorted(at, [first, first + step])
            blocks.append(np.zeros((size, step), np.float32))
            blocks[-1][owner[lo:hi], at[lo:hi] - first] = 1
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def node_links(n: np.ndarray, sketch: np.ndarray, comp: np.ndarray, members: np.ndarray, percent: int, apart: int) -> np.ndarray:
    """Pairs of members that link on their whole sets, as many as connect what all such pairs connect beyond the components.

    Pairs inside a component need no test, and every link found joins two, so the closest pair of each member goes first;
    what is still apart after ``PICKS`` of them is compared in full.
    """
    order = np.argsort(n, kind="stable")
    n, sketch = n[order], sketch[order]
    group = np.unique(comp[order], return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in members[order]]
    links = [np.zeros((0, 2), np.int64)]
    for own, others, away, close in size_tiles(n, sketch, percent, apart):
        i, j = np.nonzero(close & (group[own, None] != group[None, others]))
        near = away[i, j]
        i, j = i + own.start, j + others.start
        for turn in range(PICKS + 1):
            apart_still = group[i] != group[j]
            i, j, near = i[apart_still], j[apart_still], near[apart_still]
            if not len(i):
                break
            if turn < PICKS:
                by = np.lexsort((near, i))
                picked = by[np.flatnonzero(np.r_[True, np.diff(i[by]) > 0])]
                common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i[picked], j[picked])])
            else:
                picked = np.arange(len(i))
                (rows, r), (cols, c) = (np.unique(x, return_inverse=True) for x in (i, j))
                common = common_members([sets[a] for a in rows], [sets[a] for a in cols])[r, c]
            a, b = i[picked], j[picked]
            linked = 100 * common >= percent * (n[a] + n[b] - common)
            a, b = a[linked], b[linked]
            low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
            first = np.unique(low * len(n) + high, return_index=True)[1]
            for x, y in zip(a[first].tolist(), b[first].tolist()):
                if group[x] != group[y]:
                    links.append(np.array([[x, y]]))
                    group[group == group[y]] = group[x]
            rest = np.ones(len(i), bool)
            rest[picked] = False
            i, j, near = i[rest], j[rest], near[rest]
    return order[np.concatenate(links)]


def size_tiles(n: np.ndarray, sketch: np.ndarray, percent: int, apart: int) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """(members, others, tokens apart, close) of a node sorted by size: ``TILE`` members against all from the first of them on
    whose sizes can fit. A pair of one tile comes in both orders."""
    for at in range(0, len(n), TILE):
        end = min(at + TILE, len(n))
        stop = int(np.searchsorted(n, 100 * n[end - 1] // percent, side="right"))
        away = np.zeros((end - at, stop - at), np.uint8)
        for word in range(sketch.shape[1]):
            differ = sketch[at:end, word, None] ^ sketch[None, at:stop, word]
            away += np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(PAIR_BITS))
        fits = (100 * n[at:end, None] >= percent * n[None, at:stop]) & (100 * n[None, at:stop] >= percent * n[at:end, None])
        yield slice(at, end), slice(at, stop), away, (away <= apart) & fits


def rivals(n: np.ndarray, sketch: np.ndarray, comp: np.ndarray, percent: int, apart: int) -> np.ndarray:
    """Members of a node that have a close one in another component."""
    order = np.argsort(n, kind="stable")
    n, sketch, comp = n[order], sketch[order], comp[order]
    met = np.zeros(len(n), bool)
    for own, others, _, close in size_tiles(n, sketch, percent, apart):
        close &= comp[own, None] != comp[None, others]
        met[own] |= close.any(axis=1)
        met[others] |= close.any(axis=0)
    out = np.zeros(len(n), bool)
    out[order] = met
    return out


def contested(rows: DataFrame, percent: int, apart: int) -> DataFrame:
    """The rows whose member has a close one in another component of its node, by sizes and sketches.

    Only these can link components, so only they bring their whole sets along.
    """
    names = ["node", "cid", "n", *SKETCH, "comp"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in node_runs(batches, names):
            node, _, n, *words, comp = columns
            sketch = np.stack(words, axis=1).view(np.uint64)
            keep = np.zeros(len(node), bool)
            for at in node_slices(node):
                if (comp[at] != comp[at.start]).any():
                    keep[at] = rivals(n[at], sketch[at], comp[at], percent, apart)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

    return rows.select(*names).repartition("node").sortWithinPartitions("node", "cid").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def exact_links(rows: DataFrame, percent: int, apart: int) -> DataFrame:
    """(a, b): links between the components of a node, on the whole sets that its members bring along.

    Close pairs in different components are compared in the task that has the node; what comes out is one link for
    each two components joined, however many pairs there are.
    """
    names = ["node", "cid", "n", *SKETCH, "comp", "members"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, cid, n, *words, comp, members in node_runs(batches, names):
            sketch = np.stack(words, axis=1).view(np.uint64)
            found = [(np.zeros(0, np.int64),) * 2]
            for at in node_slices(node):
                if (comp[at] != comp[at.start]).any():
                    pairs = node_links(n[at], sketch[at], comp[at], members[at], percent, apart)
                    found.append((cid[at][pairs[:, 0]], cid[at][pairs[:, 1]]))
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.select(*names).repartition("node").sortWithinPartitions("node", "cid").mapInArrow(run, "a long, b long")


def members_of(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cid, members): the whole sets of some classes (cid, row), sorted 64-bit hashes side by side."""
    texts = class_texts(classes, docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch]):
                sets = pa.array([shingle_set(x, width).tobytes() for x in utf8(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cid"), sets], names=["cid", "members"])

    return stored(texts.mapInArrow(run, "cid long, members binary"), "members")


def sketch_distance(x: Column) -> Column:
    """Tokens in which a struct ``x`` with a sketch differs from the row's own."""
    words = [F.col(s).bitwiseXOR(x[s]) for s in SKETCH]
    return reduce(lambda u, v: u + v, [F.bit_count(w.bitwiseOR(F.shiftrightunsigned(w, 1)).bitwiseAND(F.lit(PAIR_BITS))) for w in words])


def leader_pairs(big: DataFrame, percent: int, apart: int) -> DataFrame:
    """(a, b, node) of every member of a large node with the closest of its leaders, if it is close enough.

    Leaders are the members of smallest hash in each of ``LEADERS`` lanes: one record per task and lane before they
    meet, and one array per node, so a node of a third of all rows is as many tasks as its rows need.
    """
    lane, rank = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(LEADERS)), F.xxhash64("cid")
    heads = big.groupBy("node", lane.alias("lane")).agg(F.min(F.struct(rank.alias("rank"), "cid", "n", *SKETCH)).alias("head"))
    leaders = heads.groupBy("node").agg(F.array_sort(F.collect_list("head")).alias("leaders"))
    fits = lambda x: (x["cid"] != F.col("cid")) & (100 * F.least(F.col("n"), x["n"]) >= percent * F.greatest(F.col("n"), x["n"]))
    nearest = F.array_min(F.transform(F.filter("leaders", fits), lambda x: F.struct(sketch_distance(x).alias("away"), x["cid"].alias("cid"))))
    met = big.join(leaders, "node").withColumn("met", nearest).where(F.col("met.away") <= apart).withColumn("other", F.col("met.cid"))
    return met.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"), F.lit(0).cast("long").alias("node"))


def class_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, text): the text of one row of each class in ``wanted`` (cid, row)."""
    rows = docs.select(row_key(text_mark().cast("string")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(wanted.select("cid", "row"), "row").select("cid", "text").dropDuplicates(["cid"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) of classes with linked: 100 * intersection >= percent * union on the whole sets.

    Texts are fetched for the classes at hand only. A class that many pairs share is a plain join key on both sides,
    which adaptive execution splits.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = stored(class_texts(ends.join(classes.select("cid", "row"), "cid"), docs), "contenders")
    both = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for part in chunks([batch], "text_b"):
                linked = []
                for a, left, right in zip(part.column("a").to_pylist(), utf8(part, "text_a"), utf8(part, "text_b")):
                    if a != last:
                        last, held = a, shingle_set(left, width)
                    other = shingle_set(right, width)
                    common = len(np.intersect1d(held, other, assume_unique=True))
                    linked.append(100 * common >= percent * (len(held) + len(other) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    out = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean"), "verified")
    discard(texts)
    return out


def with_components(rows: DataFrame, forest: DataFrame) -> DataFrame:
    named = forest.select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    return rows.join(named, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def wide_blocks(members: Column, shingles: Column | None = None) -> Column:
    """Blocks that a node is cut into, so that two of them are few enough members, and ``shingles`` if given, for one step."""
    fits, blocks = members <= WIDE * SMALL, F.ceil(2 * members / (WIDE * SMALL))
    if shingles is not None:
        fits = fits & ((shingles <= SMALL_SHINGLES) | (members == 2))
        blocks = F.greatest(blocks, F.least(members, F.ceil(2 * shingles / SMALL_SHINGLES)))
    return F.when(fits, F.lit(1).cast("long")).otherwise(blocks)


def dealt_in_blocks(big: DataFrame, blocks: Column) -> DataFrame:
    """Nodes cut into ``blocks`` (an aggregate of their rows); every two blocks meet in a node of their own."""
    sizes = big.groupBy("node").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("blocks"))
    dealt = big.join(sizes, "node").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("node", F.xxhash64("node", F.least("block", "with"), F.greatest("block", "with"))).drop("blocks", "block", "with")


def with_main_component(big: DataFrame) -> DataFrame:
    """``big`` with the largest component of each node (``main``), and members outside of it."""
    comps = big.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"))
    nodes = comps.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    return big.join(nodes.select("node", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.c")).alias("others")), "node")


def dealt_to_others(big: DataFrame) -> DataFrame:
    """Nodes with few members outside of their main component: the main one is cut into blocks, the others join every block.

    At most half a block is others, so the rows are twice those of the nodes at most.
    """
    blocks = wide_blocks(F.col("members"))
    block = F.pmod(F.xxhash64("cid", F.lit(2)), blocks)
    inside = big.where("comp = main").withColumn("node", F.xxhash64("node", block))
    outside = big.where("comp <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("node", F.xxhash64("node", "block"))
    return inside.unionByName(outside.drop("block"))


def near_components(classes: DataFrame, docs: DataFrame, width: int, percent: int, trees: int = TREES, first: DataFrame | None = None) -> DataFrame:
    """(node, root): the smallest class that each class with a link reaches.

    Level by level: nodes of up to ``SMALL`` members are compared; in larger ones all members are held against a few
    leaders. Of a node that then has one main component and few others, the others meet that component block by block;
    other nodes of several components branch on, or are cut into blocks that meet two by two where that costs less. At the
    end these blocks, and small nodes with more close pairs than were tried, are compared by sketches; members with a
    close one in another component get their whole sets and are compared in full. So every close pair that shares a
    small node or a block is either inside a component or compared on its whole sets. ``first`` may bring candidates (a, b) of another
    search; they are verified like any other.
    """
    similarity, apart = percent / 100, most_apart(percent / 100)
    nothing = classes.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0)
    tested: list[DataFrame] = []
    dense: list[DataFrame] = []

    def test(pairs: DataFrame) -> None:
        for done in tested:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs.select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            tested.append(verified(pairs, classes, docs, width, percent))
        discard(pairs)

    searched: dict[int, DataFrame] = {}

    def forest() -> DataFrame:
        """The components of all links so far, searched once for as many tested tables as there are."""
        if not tested:
            return nothing
        if len(tested) not in searched:
            searched[len(tested)] = star_forest(contracted(reduce(DataFrame.unionByName, tested).where("linked").select("a", "b")))
        return searched[len(tested)]

    if first is not None:
        test(first)
    rows = grown(classes, similarity, trees)
    budget = BLOCK_ROWS * trees / similarity * classes.count()
    for level in range(1, DEEPEST + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
        met = stored(rows.join(sizes, "node"), "nodes")
        small = (F.col("members") <= SMALL) & ((F.col("shingles") <= SMALL_SHINGLES) | (F.col("members") == 2))
        few, big = met.where(small), met.where(~small)
        more = not big.isEmpty()
        pairs = small_node_pairs(few, percent, apart)
        pairs = stored(pairs.unionByName(leader_pairs(big, percent, apart)) if more else pairs, "candidates")
        dense.append(few.join(pairs.where("node <> 0").select("node").distinct(), "node", "left_semi"))
        test(pairs)
        if not more:
            break
        if tested:
            big = stored(with_main_component(mixed_nodes(with_components(big, forest()))), "mixed")
            near_one = F.col("others") <= WIDE * SMALL // 2
            dense.append(dealt_to_others(big.where(near_one)))
            big = big.where(~near_one)
        blocks = wide_blocks(F.max("members"))
        cost = big.groupBy("node").agg((F.max("members") * blocks).alias("rows")).agg(F.sum("rows")).first()[0] or 0
        if cost <= budget or level == DEEPEST:
            if cost:
                dense.append(dealt_in_blocks(big, wide_blocks(F.count(F.lit(1)))))
            break
        rows = grown(big.select("cid", "node").join(classes.select("cid", "n", "tokens"), "cid"), similarity)
    again = reduce(DataFrame.unionByName, [d.select("node", "cid", "n", *SKETCH) for d in dense])
    again = stored(mixed_nodes(with_components(again, forest())), "again")
    again = stored(contested(again, percent, apart), "contested")
    if again.isEmpty():
        return forest()
    again = dealt_in_blocks(again, wide_blocks(F.count(F.lit(1)), F.sum("n")))
    wanted = again.select("cid").distinct().join(classes.select("cid", "row"), "cid")
    sets = members_of(wanted, docs, width)
    more_links = stored(exact_links(again.join(sets, "cid"), percent, apart), "links")
    discard(sets)
    # Roots stand for what is linked already.
    if more_links.isEmpty():
        return forest()
    known = forest().select(F.col("node").alias("a"), F.col("root").alias("b"))
    return star_forest(contracted(known.unionByName(more_links)))


def mixed_nodes(rows: DataFrame) -> DataFrame:
    """The rows of nodes whose members are in more than one component."""
    mixed = rows.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("node")
    return rows.join(mixed, "node", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, trees: int = TREES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``width`` words, A-Z lower-cased; with fewer words the whole
    sequence is the one member; a document without words (null, empty, blanks) has none and links with nothing. Sets
    link at ``percent`` in a hundred of their union or more, confirmed on the whole sets. component_id is the smallest
    doc_id reachable; ``kept`` is doc_id = component_id. Equal sets are one class, so copies of any number cost one
    member. Null doc_ids are left out of the smallest; where a component has no other, component_id is null and its
    rows stay. Rows that share a doc_id are rows of their own. An empty table gives no rows.
    """
    prints = stored(token_sets(docs, width), "token-sets")
    classes = set_classes(prints)
    forest = near_components(classes, docs, width, percent, trees)
    rooted = with_components(classes.select("cid", "key", "n", "first_id"), forest)
    least = rooted.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(least, "comp").select("key", "n", "component_id"), "class-components")
    worded = prints.where(F.col("key").isNotNull()).join(named, ["key", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    wordless = prints.where(F.col("key").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return worded.unionByName(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
