"""The K2-treap search against scores computed document by document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import treap_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, top=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in treap_search.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def check(docs, items, top=20, **options):
    plain = [[(r[0], r["text"]) for r in df.collect()] for df in (docs.select("doc_id", "text"), items.select("item_id", "text"))]
    assert found(docs, items, top=top, **options) == by_hand(*plain, top=top)


@pytest.fixture(scope="module")
def items(spark):
    texts = ["passage w1 w2 w59 w3", "GNU general public License", "é É z", "日本語 text emoji", "", None, "t1 t16 t144", "the unknownterm", "unknownterm", "one one one two", "this very LINE stands"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "one two")], "item_id long, text string")


def test_odd_texts(odd, items):
    check(odd, items)


def test_smallest_table(spark, corpus):
    check(corpus, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))


def test_small_slices_and_blocks_of_items(odd, items):
    """Many treaps per task, and several passes over the items."""
    check(odd, items, top=4, block_terms=6, slice_docs=3, slice_points=40)


def test_ties_go_by_doc_id(spark):
    """Copies of one text in a third of all rows, over many tasks, ids not in the order of the rows."""
    rows = [((i * 7919) % 3001, "alpha beta gamma" if i % 3 == 0 else f"alpha filler{i % 11} more{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(docs, spark.createDataFrame([(1, "beta alpha"), (2, "gamma"), (3, "filler3 more2 alpha alpha")], "item_id long, text string"))


def test_treap_cells():
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(0, 1 << 16, 500))
    term, doc = points >> 8, points & 255
    impact = rng.integers(1, 1000, len(points))
    treap = treap_search.Treap.build(term, doc, impact, 256)
    assert treap.levels == 8 and treap.peak[-1] == impact.max()
    # At most one cell per point on the levels where points are apart, and full levels above.
    assert len(treap.peak) <= len(points) * (math.log(65536 / len(points), 4) + 4 / 3) + 1
    # Descending to every grid point finds its impact, or an empty cell.
    dense = np.full((256, 256), 0)
    dense[term, doc] = impact
    cells = np.full(256 * 256, len(treap.peak) - 1)
    t, d = np.divmod(np.arange(256 * 256), 256)
    for level in range(7, -1, -1):
        cells = treap.quarter(cells, (((t >> level) & 1) * 2 + ((d >> level) & 1)).astype(np.uint8))
    assert (np.where(cells >= 0, treap.peak[cells], 0) == dense.ravel()).all()


def test_descent_leaves_most_documents_out():
    """Best-first: a search for few terms reads far fewer cells than the grid has."""
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(4096), 8)
    term = rng.integers(0, 512, len(doc))
    impact = (rng.pareto(1, len(doc)) * 100).astype(np.int64) + 1
    _, at = np.unique(term * 4096 + doc, return_index=True)
    treap = treap_search.Treap.build(term[at], doc[at], impact[at], 512)
    seen = []
    original = treap_search.Treap.quarter

    class Counted(treap_search.Treap):
        def quarter(self, cells, k):
            seen.append(int((cells >= 0).sum()))
            return original(self, cells, k)

    best = treap_search.Best(5)
    Counted(treap.quarters, treap.first, treap.peak, treap.levels).search(np.arange(4096), np.array([5, 300]), np.array([1, 1]), best)
    scores = np.zeros(4096, np.int64)
    np.add.at(scores, doc[at][np.isin(term[at], (5, 300))], impact[at][np.isin(term[at], (5, 300))])
    order = np.lexsort((np.arange(4096), -scores))[:5]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    # Splitting every range would look up 2 terms x 2 halves of 4095 ranges.
    assert sum(seen) < 2 * 2 * 4095 / 4


def test_empty_tables_and_clashing_columns(spark, nothing, odd, clashing, items):
    none = items.limit(0)
    assert treap_search.search(nothing, items).count() == treap_search.search(odd, none).count() == 0
    extra = clashing.select("*", *[F.lit(1).alias(c) for c in ("n", "terms", "counts", "query", "task", "lane", "rank")])
    assert found(extra, items.select("*", F.lit(1).alias("line"), F.lit(1).alias("block"))) == found(odd, items)
