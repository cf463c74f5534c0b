"""Chosen paths against the exact join of all pairs."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import chosen_paths


def shingles(text, width=4):
    w = brute.words(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def by_hand(docs, width=4, percent=80):
    sets = [shingles(t, width) for _, t in docs]
    comp = list(range(len(docs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    name = [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(docs))]
    return [(d, len(sets[i]), name[i], d == name[i]) for i, (d, _) in enumerate(docs)]


def check(df, **options):
    want = by_hand([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = [tuple(r) for r in chosen_paths.near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def family(seed, n, length, changes, start=0):
    """Near copies of one text, each with a few words replaced; neighbours differ twice as much as each from the base."""
    rng = random.Random(seed)
    base = [f"b{seed}x{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(length)] = f"new{rng.randrange(10**6)}"
        out.append((start + i, " ".join(words)))
    return out


@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_components(request, name):
    check(request.getfixturevalue(name))


def test_large_near_groups_and_hot_copies(spark, monkeypatch):
    """Groups beyond what a small node holds, some at the border of the similarity, and a third of all rows equal."""
    monkeypatch.setattr(chosen_paths, "SMALL", 48)
    monkeypatch.setattr(chosen_paths, "BLOCK_ROWS", 0)
    rows = family(1, 150, 120, 8) + family(2, 80, 60, 4, 1000) + [(5000 + i, "the very same text in many rows of it") for i in range(150)]
    rows += [(7000 + i, "") for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_blocks_alone_are_exact(spark, monkeypatch):
    """One level, so that large nodes are compared block by block."""
    monkeypatch.setattr(chosen_paths, "SMALL", 48)
    monkeypatch.setattr(chosen_paths, "DEEPEST", 1)
    check(spark.createDataFrame(family(3, 200, 80, 7), "doc_id long, text string"))


def test_wide_blocks_meet_two_by_two(spark, monkeypatch):
    """Nodes beyond the wide limit, so that both comparisons, by sketches and on sets, are cut into blocks."""
    monkeypatch.setattr(chosen_paths, "SMALL", 24)
    monkeypatch.setattr(chosen_paths, "WIDE", 2)
    monkeypatch.setattr(chosen_paths, "DEEPEST", 1)
    monkeypatch.setattr(chosen_paths, "TILE", 16)
    check(spark.createDataFrame(family(4, 200, 80, 9), "doc_id long, text string"))


def test_sets_go_to_few_rows_of_large_nodes(spark, monkeypatch):
    """Members of a node far larger than a small one bring their sets once per node, and only if a close one is elsewhere."""
    monkeypatch.setattr(chosen_paths, "SMALL", 24)
    monkeypatch.setattr(chosen_paths, "DEEPEST", 1)
    seen, plain = [], chosen_paths.exact_links
    monkeypatch.setattr(chosen_paths, "exact_links", lambda rows, *rest: seen.append(rows.count()) or plain(rows, *rest))
    phrase = "every text has these words in it and so they all meet"
    rng = random.Random(8)
    apart = [(1000 + i, phrase + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(20))) for i in range(150)]
    rows = family(5, 150, 80, 9) + apart
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(seen) <= 150 * 2 * chosen_paths.TREES


def test_close_pairs_by_tiles():
    rng = np.random.default_rng(9)
    n, comp = rng.integers(50, 90, 70), rng.integers(0, 4, 70)
    sketch = rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (70, 4), dtype=np.uint64)
    want = np.zeros(70, bool)
    for limit in (60, 75):
        pairs = chosen_paths.close_pairs(n, sketch, 80, limit)
        pairs = pairs[comp[pairs[:, 0]] != comp[pairs[:, 1]]]
        want[:] = False
        want[pairs.ravel()] = True
        assert (chosen_paths.rivals(n, sketch, comp, 80, limit) == want).all()


def test_similarity_at_the_border(spark):
    """27 of 33 shingles in common stay below 80 in a hundred, 28 of 35 reach it."""
    words = [f"w{i}" for i in range(40)]
    longer = words[:31]
    rows = [(1, " ".join(longer)), (2, " ".join(longer + ["a", "b", "c", "d", "e", "f", "g"])), (3, " ".join(words[:38])), (4, " ".join(words[3:38] + ["q"] * 0 + ["u", "v", "x"]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketch_passes_what_links():
    rng = np.random.default_rng(5)
    limit = chosen_paths.most_apart(0.8)
    missed = 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = (np.stack([chosen_paths.minima(np.concatenate([common, own[at : at + 100]]))]) for at in (0, 100))
        differ = chosen_paths.sketch_of(a) ^ chosen_paths.sketch_of(b)
        missed += int(np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(chosen_paths.PAIR_BITS)).sum()) > limit
    assert missed <= 1


def test_pairs_share_a_path_often_enough():
    """A pair at the border stays together in a tree with probability about 0.84, 0.73, 0.64 after one, two, three levels."""
    rng = np.random.default_rng(6)
    kept = np.zeros(3)
    for trial in range(400):
        same = rng.random(chosen_paths.FUNCTIONS) < 0.8
        a = rng.integers(0, 1 << 32, chosen_paths.FUNCTIONS, dtype=np.uint64).astype(np.uint32)
        b = np.where(same, a, a + np.uint32(1)).astype(np.uint32)
        nodes = [np.array([trial * 977 + 1], np.uint64)] * 2
        for level in range(3):
            nodes = [chosen_paths.branches(x, np.repeat(t[None, :], len(x), axis=0), 0.8)[1] for x, t in zip(nodes, (a, b))]
            shared = np.intersect1d(*nodes)
            kept[level] += len(shared) > 0
            nodes = [shared, shared]
    assert (np.abs(kept / 400 - np.array([0.84, 0.73, 0.64])) < 0.08).all()


def test_empty_table_and_clashing_columns(nothing, odd, clashing):
    assert chosen_paths.near_duplicates(nothing).count() == 0
    extra = clashing.select("*", *[F.lit(1).alias(c) for c in ("cid", "node", "key", "tokens", "mark", "n", "comp")])
    check(extra)
