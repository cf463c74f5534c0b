"""SentencePiece-style encoding with N-best segmentations, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.pieces import LOST, MODEL, Vocabulary, code_units, nbest, viterbi
from barloom.llm.text import chunks, ragged, utf8

N_BEST = 4


#: A way to segment a text: its loss against the best, its change of piece count, and the units changed (place among the
#: text's units, alternative of that unit).
Way = tuple[int, int, tuple[tuple[int, int], ...]]


def merge_best(lists: list[list[Way]], n: int) -> list[Way]:
    """The ``n`` smallest sums of loss with one entry from each list; each list starts with loss 0 and no change."""
    out: list[Way] = [(0, 0, ())]
    for own in lists:
        out = sorted(((a + x, b + y, c + z) for a, b, c in out for x, y, z in own), key=lambda v: v[0])[:n]
    return out


def text_nbest(codes: np.ndarray, units: list[bytes], loss: np.ndarray, known: dict[int, list], vocabulary: Vocabulary, n: int) -> list[Way]:
    """A text's ``n`` best segmentations.

    They differ from its best in the ``n - 1`` units whose second best loses least: any other change loses at least as
    much as those one by one. Only these units are searched.
    """
    own = loss[codes]
    near = np.argpartition(own, n - 2)[: n - 1] if len(own) > n - 1 else np.arange(len(own))
    lists = []
    for place in sorted(near[own[near] < -LOST].tolist()):
        code = int(codes[place])
        if code not in known:
            known[code] = nbest(units[code], vocabulary, n)
        best, ids = known[code][0]
        lists.append([(best - s, len(x) - len(ids), ((place, k),) if k else ()) for k, (s, x) in enumerate(known[code])])
    return merge_best(lists, n)


def changes_of(way: Way, codes: np.ndarray, begins: np.ndarray, known: dict[int, list]) -> list[dict]:
    """A way as changes to the ids of the best segmentation: from place ``at``, ``drop`` ids give way to ``ids``."""
    found = [(int(begins[place]), known[int(codes[place])], k) for place, k in way[2]]
    return [{"at": at, "drop": len(paths[0][1]), "ids": paths[k][1]} for at, paths, k in found]


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> bytes:
    """The text of a sequence of ids, without the space that encoding puts before it; ids without text are passed over."""
    surface = vocabulary.surface
    line = b"".join([surface[i] for i in ids if i in surface])
    return line[1:] if line[:1] == b" " else line


def encode(docs: DataFrame, n_best: int = N_BEST, model_path: str = MODEL) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, ids, n_pieces, score, nbest_scores, nbest_pieces,
    nbest_changes, decoded_sha256, text_sha256.

    ``ids`` is the best segmentation; ``nbest_scores`` and ``nbest_pieces`` list the scores and piece counts of the
    ``n_best`` best, fewer where a text has fewer, and ``nbest_changes`` what each changes in ``ids`` (``nbest_ids``
    spells them out). Among equal scores any may come first, but the first entry is always the best segmentation's.
    ``decoded_sha256`` is taken of the ids decoded again. Null and empty texts have no ids and one segmentation, the
    empty one. Texts without spaces and runs of blanks are units like any other, in time linear in their length.
    Repeated rows are rows of their own; an empty table gives no rows.
    """
    if n_best < 2:
        raise ValueError("n_best counts from 2")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    change = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("score", pa.int64())]
        + [("nbest_scores", pa.list_(pa.int64())), ("nbest_pieces", pa.list_(pa.int64())), ("nbest_changes", pa.list_(pa.list_(change))), ("decoded_sha256", pa.string()), ("text_sha256", pa.string())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for part in chunks(batches):
            texts = utf8(part)
            units, codes, sizes = code_units(texts)
            best = viterbi(units, words, ids=True)
            known: dict[int, list] = {}
            columns: list[list] = [[] for _ in range(6)]
            # The ids of all texts in one row: the units' ids, as often as texts have them.
            flat = np.concatenate([np.zeros(0, np.int32), *best.ids])[ragged((np.cumsum(best.count) - best.count)[codes], best.count[codes])]
            begins = np.r_[0, np.cumsum(best.count[codes])]
            ends = np.r_[0, np.cumsum(sizes)]
            bounds = begins[ends]
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            scores = np.r_[0, np.cumsum(best.score[codes])]
            ways_of: dict[bytes, tuple] = {}
            for text, a, b, left, right in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if text not in ways_of:
                    own = codes[a:b]
                    score = int(scores[b] - scores[a])
                    ways = text_nbest(own, units, best.loss, known, words, n_best)
                    changes = [changes_of(w, own, begins[a:b] - left, known) for w in ways]
                    again = decode(flat[left:right].tolist(), words)
                    ways_of[text] = (score, [score - w[0] for w in ways], [right - left + w[1] for w in ways], changes, hashlib.sha256(again).hexdigest(), hashlib.sha256(text).hexdigest())
                for column, value in zip(columns, ways_of[text]):
                    column.append(value)
            rest = [pa.array(c, t) for c, t in zip(columns, schema.types[3:])]
            n_pieces = pa.array(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids.cast(pa.list_(pa.int32())), n_pieces, *rest], schema=schema)

    kinds = "doc_id long, ids array<int>, n_pieces long, score long, nbest_scores array<long>, nbest_pieces array<long>, nbest_changes array<array<struct<at:int,drop:int,ids:array<int>>>>, decoded_sha256 string, text_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def nbest_ids(encoded: DataFrame) -> DataFrame:
    """(doc_id, rank, score, ids): every one of the ``n_best`` segmentations of ``encode`` as whole ids, rank from 1."""
    way = encoded.select("doc_id", "ids", "nbest_scores", F.posexplode("nbest_changes").alias("way", "changes"))
    # From the last change to the first, so that places further left stay where they are.
    whole = F.aggregate(
        F.reverse("changes"),
        F.col("ids"),
        lambda ids, c: F.concat(F.slice(ids, F.lit(1), c["at"]), c["ids"], F.slice(ids, c["at"] + c["drop"] + 1, F.size(ids))),
    )
    return way.select("doc_id", (F.col("way") + 1).alias("rank"), F.col("nbest_scores")[F.col("way")].alias("score"), whole.alias("ids"))


def decode_ids(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids) as (doc_id, text); null ids give a null text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [None if x is None else decode(x, vocabulary.value).decode("utf-8", "replace") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
