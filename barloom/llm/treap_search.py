"""Ranked lexical search: a K2-treap per slice of documents over the term-document grid, descended best-first."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text import chunks, utf8
from barloom.session import discard, stored

TOP = 20
#: Terms of the items that are searched in one pass over the grid; more items are more passes.
BLOCK_TERMS = 1 << 17
#: Documents and grid points of one treap.
SLICE_DOCS, SLICE_POINTS = 1 << 13, 1 << 20
#: Document ranges that are split in one step of a descent.
FRONT = 64
#: Tasks whose lists meet before all lists of an item do.
LANE_TASKS = 1024
NO_ID = np.iinfo(np.int64).max
#: What is no letter, digit or non-ASCII byte becomes a blank; A-Z become a-z.
TERM_BYTES = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of a number below 2^32, a zero between each two."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


@dataclass(frozen=True)
class Treap:
    """Cells of all levels in one row, lowest level first. A cell is the bitmap of its quarters, the place of its first
    quarter that holds anything (the others follow it), and the largest impact inside; empty cells are not kept."""

    quarters: np.ndarray
    first: np.ndarray
    peak: np.ndarray
    levels: int

    @classmethod
    def build(cls, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, height: int) -> Treap:
        """``height`` is the number of rows of the grid, also of those that are empty here."""
        levels = max((height - 1).bit_length(), int(doc.max()).bit_length(), 1)
        code = (spread(term) << np.uint64(1)) | spread(doc)
        order = np.argsort(code, kind="stable")
        code, peak = code[order], impact[order]
        quarters, first, peaks, below = [np.zeros(len(code), np.uint8)], [np.zeros(len(code), np.int64)], [peak], 0
        for _ in range(levels):
            up = code >> np.uint64(2)
            starts = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            bit = (np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            quarters.append(np.bitwise_or.reduceat(bit, starts))
            first.append(below + starts)
            peak = np.maximum.reduceat(peak, starts)
            peaks.append(peak)
            below += len(code)
            code = up[starts]
        return cls(np.concatenate(quarters), np.concatenate(first), np.concatenate(peaks), levels)

    def quarter(self, cells: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th quarter of every cell, -1 where it is empty or the cell is."""
        bits = self.quarters[cells]
        before = np.bitwise_count(bits & ((np.uint8(1) << k) - np.uint8(1)))
        return np.where((cells >= 0) & ((bits >> k) & np.uint8(1) == 1), self.first[cells] + before, -1)

    def search(self, ids: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Offer to ``best`` the documents (``ids``, ascending) that score highest over ``terms``, each counted ``times``.

        A state is an aligned range of documents with one cell per term: the one on the term's row path that covers the
        range. What its documents can score is at most the sum of the cells' peaks. The states of the highest bounds are
        split first, in all their cells at once; at single documents the sum is the score.
        """
        bound = np.array([int((times * self.peak[-1]).sum())])
        start, level = np.zeros(1, np.int64), np.full(1, self.levels)
        cells = np.full((1, len(terms)), len(self.peak) - 1)
        while len(bound):
            if len(bound) > FRONT:
                order = np.argpartition(-bound, FRONT)
                front, rest = order[:FRONT], order[FRONT:]
            else:
                front, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            below = level[front] - 1
            half = (terms[None, :] >> below[:, None]) & 1
            new = []
            for side in (0, 1):
                at = start[front] + (side << below)
                inside = self.quarter(cells[front], (half * 2 + side).astype(np.uint8))
                worth = (times * np.where(inside >= 0, self.peak[inside], 0)).sum(axis=1)
                new.append((worth, at, below, inside))
            worth, at, deep, inside = (np.concatenate(x) for x in zip(*new))
            found = (deep == 0) & (worth > 0)
            best.offer(worth[found], ids[at[found]])
            bound, start, level, cells = (np.concatenate([x[rest], y[deep > 0]]) for x, y in zip((bound, start, level, cells), (worth, at, deep, inside)))
            alive = bound > 0
            alive[alive] = best.can_enter(bound[alive], ids[start[alive]])
            bound, start, level, cells = bound[alive], start[alive], level[alive], cells[alive]


class Best:
    """The ``top`` highest scores with their doc_ids, equal scores by ascending doc_id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]

    def can_enter(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether documents from these ids on, with these bounds, could displace the last one."""
        if len(self.scores) < self.top:
            return np.ones(len(bounds), bool)
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (ids < self.ids[-1]))


def grid_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document: all its terms with repeats, and its points on the rows of the grid."""
    places = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places.value.get
        for part in chunks(batches):
            sizes, terms, counts = [], [], []
            for text in utf8(part):
                words = terms_of(text)
                found = np.array([p for p in map(find, words) if p is not None], np.int32)
                own, many = np.unique(found, return_counts=True)
                sizes.append(len(words))
                terms.append(own)
                counts.append(many.astype(np.int32))
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def term_weights(grid: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """The weight of every row of the grid; the documents that hold a term are counted per task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for row in grid.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row["term"]] = row["df"]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def search_grid(grid: DataFrame, weights: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int, slice_docs: int = SLICE_DOCS, slice_points: int = SLICE_POINTS) -> DataFrame:
    """(query, doc_id, score, task): per task the ``top`` documents of every query.

    A task cuts its documents into slices of bounded size, sorts each by doc_id, and builds and searches the slice's
    treap; what a query has found in earlier slices bounds the later ones.
    """
    shared = grid.sparkSession.sparkContext.broadcast((weights, queries))

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        points = rows = 0
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                fits = int(np.searchsorted(np.cumsum(sizes[at:]), slice_points - points, side="right"))
                take = max(min(fits, slice_docs - rows, len(sizes) - at), 0 if rows else 1)
                held.append(batch.slice(at, take))
                rows, points, at = rows + take, points + int(sizes[at : at + take].sum()), at + take
                if at < len(sizes):
                    yield pa.Table.from_batches(held)
                    held, points, rows = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        weight, wanted = shared.value
        lists = [Best(top) for _ in wanted]
        for part in slices(batches):
            ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy()
            order = np.argsort(ids, kind="stable")
            lists_of, ids = part.take(pa.array(order)), ids[order]
            n = lists_of.column("n").to_numpy()
            term, tf = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists_of.column(x).chunks]).astype(np.int64) for x in ("terms", "counts"))
            sizes = pa.compute.list_value_length(lists_of.column("terms")).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            m = 75 + (25 * n * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            if not len(term):
                continue
            treap = Treap.build(term, doc, impact, len(weight))
            width = 1 << treap.levels
            padded = np.concatenate([ids, np.full(width - len(ids), NO_ID)]) if width > len(ids) else ids
            for (terms, times), best in zip(wanted, lists):
                if len(terms):
                    treap.search(padded, terms, times, best)
        for query, best in enumerate(lists):
            if len(best.ids):
                doc_id = pa.array(best.ids, mask=best.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), query, np.int32)), doc_id, pa.array(best.scores)], names=["query", "doc_id", "score"])

    # The grid is small for the work it makes: dealt out anew, in as many parts as there are slices, so that tasks stay alike.
    parts = max(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // slice_docs))
    found = grid.where("n > 0").select("doc_id", "n", "terms", "counts").repartition(parts).mapInArrow(run, "query int, doc_id long, score long")
    return found.withColumn("task", F.spark_partition_id())


def ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` rows of every group with their rank: lists of some tasks meet first, then the lists of these."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lane = F.floor(F.col("task") / LANE_TASKS)
    some = found.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "lane").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, **slices: int) -> DataFrame:
    """For every row of ``items`` (item_id, text) its ``top`` documents of ``docs`` (doc_id, text): item_id, rank, doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document scores, over the item's
    terms with repeats, weight * ((10^9 tf) div (1000 tf + 12 m)), with weight and m from counts over all documents;
    equal scores rank by ascending doc_id, null last. Documents without a common term are not returned. The grid has
    a row for each term of the items at hand and a column for each document, long texts included. Items are
    searched in blocks of about ``block_terms`` terms, so what travels with a job is bounded by that and one item;
    repeated items are answered each. Null and empty texts, and items whose terms no document holds, give no rows, as do empty tables.
    """
    spark = docs.sparkSession
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = stored(items.select("item_id", F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)).alias("terms"), F.monotonically_increasing_id().alias("line")), "items")
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    dealt = items.where(F.size("terms") > 0).withColumn("block", F.pmod(F.xxhash64("line"), F.lit(blocks)))
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item_id", "terms").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({t.encode() for r in rows for t in r["terms"]}))}
        if not vocabulary:
            continue
        grid = stored(grid_rows(docs, vocabulary), "grid")
        n_docs, n_terms = grid.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            queries = [np.unique([vocabulary[t.encode()] for t in r["terms"]], return_counts=True) for r in rows]
            weights = term_weights(grid, len(vocabulary), n_docs)
            found = ranked(search_grid(grid, weights, queries, n_docs, n_terms, top, **slices), ["query"], top)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {kind}")
            found = stored(found.join(names, "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "ranked")
            out = out.unionByName(found)
        discard(grid)
    return out


def search_sql(top: int = TOP) -> str:
    """DuckDB SQL for the rows of ``search`` over ``documents`` and ``benchmark`` (item_ids unique)."""
    words = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')) AS term"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), t AS (SELECT r, {words} FROM d),
        size AS (SELECT r, count(*) AS n FROM t GROUP BY r), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
        tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {words} FROM benchmark) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
        s AS (SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
              FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (r), total GROUP BY item_id, r)
        SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank
            FROM s JOIN d USING (r) WHERE score > 0) WHERE rank <= {top}"""
