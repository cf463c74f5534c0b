"""Substring dedup: anchors at difference-cover positions find shared passages, which are then extended to full windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import chunks, ragged, runs, slice_count, utf8
from barloom.session import discard, stored

#: Every difference modulo 7 is a difference of two members, so of 7 shifts one puts both ends of a pair on the cover.
PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
SLICE_ENTRIES = 1 << 17
#: Stands for the documents of an anchor that a chunk knows as shared; no document id.
SHARED = -(1 << 62)


def odd_factors(n: int, salt: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % i, salt) | 1 for i in range(n)], np.uint64)


class Words:
    """Word hashes of a chunk of documents, one after another, with the document and place of each."""

    def __init__(self, texts: list[bytes]):
        lists = pc.ascii_split_whitespace(pa.array([x.strip() for x in texts], pa.binary()).cast(pa.large_string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.cast(pa.large_binary())
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_128_intdigest(w) & (2**64 - 1) for w in distinct), np.uint64, len(distinct))
        more = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in distinct), np.uint64, len(distinct))
        codes = coded.indices.to_numpy()
        # An empty text splits into one empty word.
        empty = np.array([not x.strip() for x in texts], bool)
        keep = np.ones(len(codes), bool)
        keep[offsets[:-1][empty[: len(offsets) - 1]]] = False
        self.counts = np.diff(offsets) - empty
        codes = codes[keep]
        self.low, self.high = hashes[codes], more[codes]
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.place = np.arange(len(codes)) - np.repeat(self.first, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place

    def windows(self, values: np.ndarray, width: int, salt: int) -> np.ndarray:
        """A hash of the ``width`` words from every place on; valid where ``left >= width``."""
        out = np.zeros(len(values), np.uint64)
        mixed = values * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for i, factor in enumerate(odd_factors(width, salt)):
            out[: len(values) - i] += mixed[i:] * factor
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the chunk, hash) of the windows that start on the cover."""
        on = np.isin(self.place % PERIOD, COVER) & (self.left >= width)
        at = np.flatnonzero(on)
        return at, self.windows(self.low, width, 3)[at]


def ids_of(part: pa.RecordBatch) -> np.ndarray:
    """Document ids, null as the largest number: such a document has all others before it."""
    return part.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def packed(slices: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """Entries as one row per slice; the columns' bytes one after another. ``slices`` is sorted."""
    starts, sizes = runs(slices)
    arrays = [pa.array(slices[starts].astype(np.int32))]
    for c in columns:
        data = np.ascontiguousarray(c).tobytes()
        w = c.itemsize
        arrays.append(pa.array([data[a * w : (a + n) * w] for a, n in zip(starts.tolist(), sizes.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def joined_bytes(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(v or b"" for v in table.column(name).to_pylist()), dtype)


def shared_anchors(docs: DataFrame, n_slices: int, width: int) -> DataFrame:
    """(doc_id, anchor): anchors of a document that another document has too (or seems to: 32 bits of hash in a slice).

    Per chunk and anchor one entry goes to the anchor's hash slice, so an anchor of a third of all documents is one
    entry per chunk. An anchor that several documents of a chunk have is known as shared at once.
    """
    bits = int(n_slices).bit_length() - 1
    schema = pa.schema([("slice", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words, ids = Words(utf8(part)), ids_of(part)
            at, key = words.anchors(width)
            key >>= np.uint64(32 - bits)
            doc = words.doc[at]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[first], ids[doc[first]]
            starts, sizes = runs(key)
            one = np.repeat(sizes == 1, sizes)
            known = ~one
            if known.any():
                yield packed(np.full(known.sum(), -1), [key[known].astype("<i8"), doc[known].astype("<i8")], schema)
            # One entry per anchor; those known as shared say so to the other chunks' anchors.
            head, head_doc = key[starts], np.where(sizes == 1, doc[starts], SHARED)
            yield packed((head >> np.uint64(32)).astype(np.int64), [(head & np.uint64(0xFFFFFFFF)).astype("<u4"), head_doc.astype("<i8")], schema)

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        h, doc = joined_bytes(table, "hash", "<u4"), joined_bytes(table, "doc", "<i8")
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        starts, sizes = runs(h)
        marked = np.logical_or.reduceat(doc == SHARED, starts) if len(starts) else np.zeros(0, bool)
        hit = np.repeat((sizes > 1) | marked, sizes) & (doc != SHARED)
        anchor = (np.int64(key[0].as_py()) << np.int64(32)) | h[hit].astype(np.int64)
        return pa.table([pa.array(doc[hit]), pa.array(anchor)], names=["doc_id", "anchor"])

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor = np.frombuffer(b"".join(b.column("hash").to_pylist()), "<i8")
            doc = np.frombuffer(b"".join(b.column("doc").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor)], names=["doc_id", "anchor"])

    packs = stored(docs.select("doc_id", "text").mapInArrow(pack, "slice int, hash binary, doc binary"), "anchor-packs")
    far = packs.where("slice >= 0").groupBy("slice").applyInArrow(repeated, "doc_id long, anchor long")
    near = packs.where("slice < 0").mapInArrow(known, "doc_id long, anchor long")
    out = stored(far.unionByName(near), "shared-anchors")
    discard(packs)
    return out


def repeated_windows(docs: DataFrame, n_anchor: int, n_slices: int, width: int) -> DataFrame:
    """(doc_id, starts): places of windows whose words also start in a document with a smaller id.

    The upper half of a start is a hash of the text, so that rows that share a doc_id keep their own.

    ``docs`` has the anchors that a document shares. Windows around them are hashed to 96 bits within their slice;
    per chunk the smallest document of a window goes to the slice, the chunk's other ones are known to be later.
    """
    anchor_width, bits, abits = width - PERIOD + 1, int(n_slices).bit_length() - 1, int(n_anchor).bit_length() - 1
    schema = pa.schema([("slice", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("doc", pa.binary()), ("place", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = utf8(part)
            words, ids = Words(texts), ids_of(part)
            at, key = words.anchors(anchor_width)
            key >>= np.uint64(32 - abits)
            lists = part.column("anchors").to_pylist()
            shared = np.concatenate([np.array(x or [], np.int64).view(np.uint64) for x in lists])
            owner = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists]).astype(np.uint64)
            mix = np.uint64(0x9E3779B97F4A7C15)
            hit = at[np.isin((key ^ (words.doc[at].astype(np.uint64) * mix)), shared ^ (owner * mix))]
            size = len(words.doc) + 1
            begin = np.maximum(hit - (PERIOD - 1), words.first[words.doc[hit]])
            around = np.cumsum(np.bincount(begin, minlength=size) - np.bincount(hit + 1, minlength=size))[:-1] > 0
            starts = np.flatnonzero(around & (words.left >= width))
            low, high = words.windows(words.low, width, 5)[starts], words.windows(words.high, width, 6)[starts]
            marks = np.fromiter(map(xxhash.xxh32_intdigest, texts), np.uint64, len(texts))
            doc, place = ids[words.doc[starts]], (marks[words.doc[starts]] << np.uint64(32)) | words.place[starts].astype(np.uint64)
            order = np.lexsort((place, doc, high, low))
            low, high, doc, place = low[order], high[order], doc[order], place[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
            own = doc == least
            cut = (low >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(low), np.int64)
            later = ~own
            columns = [low.astype("<u8"), (high >> np.uint64(32)).astype("<u4"), doc.astype("<i8"), place.astype("<u8")]
            if later.any():
                by = np.argsort(doc[later], kind="stable")
                yield packed(np.full(later.sum(), -1), [c[later][by] for c in columns], schema)
            yield packed(cut[own], [c[own] for c in columns], schema)

    def places(doc: np.ndarray, place: np.ndarray) -> pa.Table:
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        starts, sizes = runs(doc)
        rows = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(doc)].astype(np.int32)), pa.array(place.view(np.int64)))
        return pa.table([pa.array(doc[starts]), rows], names=["doc_id", "starts"])

    def later_than_first(table: pa.Table) -> pa.Table:
        low, high = joined_bytes(table, "low", "<u8"), joined_bytes(table, "high", "<u4")
        doc, place = joined_bytes(table, "doc", "<i8"), joined_bytes(table, "place", "<u8")
        order = np.lexsort((doc, high, low))
        low, high, doc, place = low[order], high[order], doc[order], place[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
        late = np.flatnonzero(doc > least)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(late) + 1, dtype=np.int32)), pa.array(place[late].view(np.int64)))
        return pa.table([pa.array(doc[late]), rows], names=["doc_id", "starts"])

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            yield from places(joined_bytes(table, "doc", "<i8"), joined_bytes(table, "place", "<u8")).combine_chunks().to_batches()

    packs = stored(docs.mapInArrow(pack, "slice int, low binary, high binary, doc binary, place binary"), "window-packs")
    far = packs.where("slice >= 0").groupBy("slice").applyInArrow(later_than_first, "doc_id long, starts array<long>")
    near = packs.where("slice < 0").select("doc", "place").mapInArrow(known, "doc_id long, starts array<long>")
    out = stored(far.unionByName(near), "repeated-windows")
    discard(packs)
    return out


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text, kept_sha256.

    Words covered by a window of ``width`` words that also starts in a document with a smaller doc_id go; the kept
    words are joined by one space. A match of ``width`` words holds, at some shift below the period, an anchor of
    ``width - 6`` words that lies on the cover in both documents, so no match is missed. Null, empty and short texts
    have no windows. Rows that share a doc_id are one document as far as "smaller" goes; a null doc_id is larger than
    all others. An empty table gives no rows.
    """
    if width < PERIOD:
        raise ValueError(f"windows need {PERIOD} words at least")
    words = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    n_anchor = slice_count(words * len(COVER) // PERIOD, SLICE_ENTRIES)
    texts = docs.select("doc_id", "text")
    shared = shared_anchors(texts, n_anchor, width - PERIOD + 1)
    n_windows = slice_count(shared.count() * PERIOD // len(COVER), SLICE_ENTRIES)
    top = F.lit(2**63 - 1).cast("long")
    wanted = shared.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("anchor").alias("anchors"))
    near = texts.join(wanted, F.coalesce(texts["doc_id"], top) == wanted["_id"]).select("doc_id", "text", "anchors")
    found = repeated_windows(near, n_anchor, n_windows, width)
    discard(shared)
    gone = found.groupBy(F.col("doc_id").alias("_id")).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    marked = texts.join(gone, F.coalesce(texts["doc_id"], top) == gone["_id"], "left").select("doc_id", "text", "starts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            n, removed, kept, sha = [], [], [], []
            for text, starts in zip(utf8(part), part.column("starts").to_pylist()):
                own = text.split()
                stay = own
                if starts:
                    gone = np.zeros(len(own), bool)
                    at = np.unique(np.array(starts, np.int64).view(np.uint64))
                    at = (at[at >> np.uint64(32) == xxhash.xxh32_intdigest(text)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    gone[ragged(at, np.full(len(at), width))] = True
                    stay = [own[i] for i in np.flatnonzero(~gone).tolist()]
                line = b" ".join(stay)
                n.append(len(own))
                removed.append(len(own) - len(stay))
                kept.append(line)
                sha.append(hashlib.sha256(line).hexdigest())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
