"""Line dedup with two Bloom filters per hash slice: once-seen and twice-seen line hashes.

Only lines that the twice-seen filter holds (or that a task has itself met twice) go on to the exact confirmation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import chunks, runs, slice_count, utf8
from barloom.session import stored

BLANK = b" \t\n\v\f\r"
#: Lines that one hash slice is laid out for, filter bits per line, probes per line.
SLICE_LINES, BITS_PER_LINE, PROBES = 1 << 15, 16, 4
DIGEST = 16


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased (``bytes.lower`` maps ASCII only)."""
    return line.strip(BLANK).lower()


def counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


def line_packs(docs: DataFrame, n_slices: int, min_chars: int) -> DataFrame:
    """Per chunk of a task: packs of line digests by hash slice.

    ``once`` holds the digests that one document of the chunk has, with those documents; ``again`` those that several
    have. The latter are proven repeats and need no filter: they leave as rows of slice -1 with all their documents,
    so a line of a third of all documents puts one entry per chunk into its slice.
    """
    shift = np.uint64(64 - int(n_slices).bit_length() + 1)
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("docs", pa.list_(pa.int64())), ("again", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            holders: dict[bytes, list] = {}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part)):
                for key in {k for line in text.split(b"\n") if counts(k := line_key(line), min_chars)}:
                    holders.setdefault(digest(key), []).append(doc_id)
            if not holders:
                continue
            keys = sorted(holders)
            slices = np.frombuffer(b"".join(k[:8] for k in keys), ">u8") >> shift
            rows = []
            for start, n in zip(*runs(slices)):
                own = keys[start : start + n]
                once = [k for k in own if len(holders[k]) == 1]
                again = [k for k in own if len(holders[k]) > 1]
                rows.append((int(slices[start]), b"".join(once), [holders[k][0] for k in once], b"".join(again)))
                rows += [(-1, k, holders[k], b"") for k in again]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(pack, "slice int, once binary, docs array<long>, again binary")


class TwiceSeen:
    """Two Bloom filters over the digests of one slice."""

    def __init__(self, lines: int):
        size = 1 << 10
        while size < lines * BITS_PER_LINE:
            size *= 2
        self.mask = np.uint64(size - 1)
        self.once = np.zeros(size, bool)
        self.twice = np.zeros(size, bool)

    def probes(self, digests: bytes) -> np.ndarray:
        halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        steps = np.arange(PROBES, dtype=np.uint64)
        return ((halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & self.mask).astype(np.int64)

    def add(self, digests: bytes, already: bool = False) -> None:
        """Digests of one pack, each once: those seen before (or ``already`` known as repeats) enter the second filter."""
        at = self.probes(digests)
        seen = at if already else at[self.once[at].all(axis=1)]
        self.twice[seen.ravel()] = True
        self.once[at.ravel()] = True

    def suspects(self, digests: bytes) -> np.ndarray:
        return np.flatnonzero(self.twice[self.probes(digests)].all(axis=1))


def suspected(packs: DataFrame) -> DataFrame:
    """(digest, doc_id) of the lines that the twice-seen filter of their slice holds."""

    def test(table: pa.Table) -> pa.Table:
        once = [v or b"" for v in table.column("once").to_pylist()]
        again = [v or b"" for v in table.column("again").to_pylist()]
        docs = table.column("docs").to_pylist()
        seen = TwiceSeen(sum(map(len, once + again)) // DIGEST)
        for a, b in zip(once, again):
            seen.add(a)
            seen.add(b, already=True)
        out: list[tuple] = []
        for a, ids in zip(once, docs):
            out += [(a[i * DIGEST : (i + 1) * DIGEST], ids[i]) for i in seen.suspects(a).tolist()]
        return pa.table([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], names=["digest", "doc_id"])

    direct = packs.where("slice < 0").select(F.col("once").alias("digest"), F.explode("docs").alias("doc_id"))
    tested = packs.where("slice >= 0").select("slice", "once", "docs", "again")
    return tested.groupBy("slice").applyInArrow(test, "digest binary, doc_id long").unionByName(direct)


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, drops): per document the digests of its lines that go, as one array."""
    # An upper bound of the lines that count: each takes its characters and a line end.
    lines = docs.agg(F.sum(F.least(F.length("text") / (min_chars + 1) + 1, F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1))).first()[0]
    packs = stored(line_packs(docs, slice_count(int(lines or 0), SLICE_LINES), min_chars), "line-packs")
    seen = stored(suspected(packs), "line-suspects")
    confirmed = stored(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs), "line-repeats")
    goes = seen.join(confirmed, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return goes.groupBy("doc_id").agg(F.collect_list("digest").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text, kept_sha256.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its lines everywhere but in
    the largest doc_id. A null or empty text is one empty line. Rows that share a doc_id count one by one towards
    ``min_docs`` and all keep the line if theirs is the largest id; a null doc_id ranks below all others. An empty
    table gives no rows. Lines are told apart by a 128-bit cryptographic digest of their key.
    """
    drops = repeated_lines(docs, min_chars, min_docs).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text")
    joined = rows.join(drops, rows["doc_id"].eqNullSafe(drops["_id"]), "left").select("doc_id", "text", "drops")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            n_lines, n_dropped, kept, sha = [], [], [], []
            for text, gone in zip(utf8(part), part.column("drops").to_pylist()):
                lines = text.split(b"\n")
                total = len(lines)
                if gone:
                    gone = set(gone)
                    lines = [x for x in lines if not (counts(k := line_key(x), min_chars) and digest(k) in gone)]
                    text = b"\n".join(lines)
                n_lines.append(total)
                n_dropped.append(total - len(lines))
                kept.append(text)
                sha.append(hashlib.sha256(text).hexdigest())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return joined.mapInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string")
