"""SimHash near-dedup: fingerprints embedded as popcounts of their segments, joined on a grid, verified bit by bit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import chunks, one_row_each, row_key, runs, utf8
from barloom.operators.components import star_forest
from barloom.session import stored

SEED = 42
#: Segments have two bits, so a segment's popcount (0 to 2) takes the segment's own place in the word.
LOW_BITS = np.uint64(0x5555555555555555)
HALF = np.uint64(0xFFFFFFFF)
LANES = 16
#: Members of one cell that are compared at a time.
BLOCK = 1024


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased text; fewer words than ``width`` make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return []
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hash_(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - width + 1].tolist()
    return [hash_(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint_of(hashes: list[int]) -> int:
    """Bit i is 1 if set in over half of the hashes; zero without hashes."""
    ones, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(hashes), step):
        part = np.array(hashes[at : at + step], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def text_mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, mark, fp): mark is a hash of the text, fp holds the 64 bits as a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            fps = np.array([fingerprint_of(shingle_hashes(x, width)) for x in utf8(part)], np.uint64)
            columns = [part.column("doc_id").cast(pa.int64()), part.column("mark"), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp"])

    return docs.select("doc_id", "text", text_mark().alias("mark")).mapInArrow(run, "doc_id long, mark long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The popcounts of all 32 segments, two bits each, packed into one word."""
    return (fps & LOW_BITS) + ((fps >> np.uint64(1)) & LOW_BITS)


def visits(fps: DataFrame) -> DataFrame:
    """(cell, fp, home): the grid cells that a fingerprint lives in and visits.

    Flipping one bit moves one popcount by one, so the Manhattan distance of two embeddings is at most their number of
    differing bits. Within 3, one half of the segments is within 1: one of the two fingerprints lives in the cell of
    that half and the other lives there too, or one step up from it. Steps up are enough, since a step down is the
    other's step up.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            counts = popcounts(own.view(np.uint64))
            for half in (0, 1):
                cell = (counts >> np.uint64(32 * half)) & HALF
                tag = np.uint64(half) << np.uint64(32)
                yield _visit(cell | tag, own, True)
                for lane in range(LANES):
                    shift = np.uint64(2 * lane)
                    up = ((cell >> shift) & np.uint64(3)) < 2
                    yield _visit((cell[up] + (np.uint64(1) << shift)) | tag, own[up], False)

    return fps.select("fp").mapInArrow(run, "cell long, fp long, home boolean")


def _visit(cell: np.ndarray, fp: np.ndarray, home: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp), pa.array(np.full(len(fp), home))], names=["cell", "fp", "home"])


def spanning_links(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``bits`` of one another; one link per member reached, not all pairs.

    A search over the members: each is compared once with those not reached yet, ``BLOCK`` at a time.
    """
    rest, links = members, []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            block, front = front[:BLOCK], front[BLOCK:]
            near = np.zeros(len(rest), bool)
            for at in range(0, len(rest), BLOCK):
                near[at : at + BLOCK] = (np.bitwise_count(rest[at : at + BLOCK, None] ^ block[None, :]) <= bits).any(axis=1)
            found, rest = rest[near], rest[~near]
            links += [(int(root), int(x)) for x in found]
            front = np.concatenate([front, found])
    return links


def cell_links(cells: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links inside runs of equal cells. A cell where nobody lives shows no pair that another cell doesn't show."""
    links: list[tuple[int, int]] = []
    starts, sizes = runs(cells)
    settled = np.logical_or.reduceat(home, starts) if len(starts) else np.zeros(0, bool)
    pairs = starts[(sizes == 2) & settled]
    a, b = fps[pairs], fps[pairs + 1]
    near = (np.bitwise_count(a ^ b) <= bits) & (a != b)
    links += zip(a[near].tolist(), b[near].tolist())
    for start, n in zip(starts[(sizes > 2) & settled].tolist(), sizes[(sizes > 2) & settled].tolist()):
        links += spanning_links(np.unique(fps[start : start + n]), bits)
    return links


def grid_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect everything within ``bits`` of one another.

    A task streams its cells in order and holds one cell at a time. Cells hold distinct fingerprints only: copies have
    been folded before, so a group of any size is as many members as it has different fingerprints near one another.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new[1] = new[1].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new)]
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            yield out(cell_links(*[x[:last] for x in held], bits))
            held = [x[last:] for x in held]
        yield out(cell_links(*held, bits))

    return visits(fps).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def rooted_fingerprints(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, first_id, root) per distinct fingerprint: its smallest doc_id, and the fingerprint that names its component."""
    if bits > 3:
        raise ValueError("the grid is laid out for at most 3 bits")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    links = stored(grid_links(classes, bits), "fingerprint-links")
    forest = star_forest(links)
    rooted = classes.join(forest, classes["fp"] == forest["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return stored(rooted, "fingerprint-roots")


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``bits`` (up to 3) or fewer differing bits; component_id is the smallest doc_id reachable.
    Texts without words (null, empty, blanks) have fingerprint zero and link like any other. Repeated rows and rows
    that share a doc_id are rows of their own; null doc_ids are left out of the smallest. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, width), "fingerprints")
    rooted = rooted_fingerprints(prints, bits)
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of each SimHash component: the one with the smallest doc_id.

    A null doc_id comes after all others. Of rows that share the doc_id the one with the smallest text hash stays.
    """
    prints = stored(fingerprints(docs, width), "fingerprints")
    rooted = rooted_fingerprints(prints, bits).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
    # A fingerprint of a third of all rows is one record per task before it meets its root.
    heads = stored(prints.groupBy("fp").agg(first.alias("head")), "fingerprint-heads")
    stay = heads.join(rooted, "fp").groupBy("root").agg(F.min("head").alias("head")).select("head.doc_id", F.col("head.mark").cast("string").alias("mark"))
    return one_row_each(docs, row_key(text_mark().cast("string")), stay.select(row_key(F.col("mark"))))
