"""Language ID: normalised TF-IDF vectors of hashed letter n-grams against several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import chunks, utf8

DIM = 4096
CENTROIDS, SAMPLE_PER_LANGUAGE, ROUNDS = 4, 400, 12
#: Steps of length (half powers of two of distinct n-grams), bins of the cosine, rows that a step needs for a bound.
EXTENTS, BINS, LEAST_FITTED = 25, 200, 20
#: A bound lies so many times the distance from the median to the 5 % quantile below the median, at this share of it at most.
SPREADS, SHARE = 3.0, 0.6
UNKNOWN = "und"
ADDED = ("held_out", "lang_pred", "score", "rejected")
LETTER = regex.compile(r"\p{L}")
#: White space, ASCII digits and ASCII punctuation count as one blank; A-Z as a-z.
FOLD = bytes(c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Counts of hashed byte 2-, 3- and 4-grams of the folded text."""
    line = np.frombuffer(b" " + b" ".join(text.translate(FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(DIM, np.float32)
    code = line
    for n in (2, 3, 4):
        if len(line) < n:
            break
        code = code[:-1] * np.uint32(257) + line[n - 1 :]
        out += np.bincount(((code * np.uint32(2654435761)) >> np.uint32(20)) ^ np.uint32(n), minlength=DIM)[:DIM]
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of normalised TF-IDF: 1 + log of the count, times idf, length 1 (or 0 for a row of zeros)."""
    w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    length = np.linalg.norm(w, axis=1, keepdims=True)
    return (w / np.maximum(length, 1e-12)).astype(np.float32)


def learnable() -> Column:
    """Labelled documents outside the held-out quarter."""
    return F.col("lang").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf by feature over all rows; per task one vector of counts leaves, DIM numbers reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(DIM, np.int64)
        for part in chunks(batches):
            for text in utf8(part):
                seen += features(text) > 0
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(DIM), -1].astype(np.int32)), pa.array(np.r_[seen, total])], names=["f", "n"])

    rows = docs.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    n = {r["f"]: r["n"] for r in rows}
    return np.array([np.log((1 + n.get(-1, 0)) / (1 + n.get(i, 0))) + 1 for i in range(DIM)], np.float32)


def cluster(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the vector farthest from those chosen, so the result depends on the rows alone."""
    chosen = [0]
    for _ in range(min(k, len(vectors)) - 1):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(near.argmin()))
    centres = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return centres


def smallest_hashes(known: DataFrame, per_language: int) -> DataFrame:
    """(_id, _lang): of every language the ``per_language`` ids of (doc_id, lang) with the smallest hash; no null ids.

    Hashes are uniform, so about twice as many ids lie below ``2 * per_language / n`` of their range, where n is the
    sketched number of ids of the language: that many are shuffled and ranked, however many tasks have read the
    table. The smallest hash always counts, so no language is lost; the sketch depends on the ids alone.
    """
    hashed = known.where(F.col("doc_id").isNotNull()).withColumn("_hash", F.xxhash64("doc_id"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), F.min("_hash").alias("least"))
    below = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n")) * 2.0**64 - 2.0**63
    limits = counts.select(F.col("lang").alias("_lang"), F.greatest(below, F.col("least").cast("double")).alias("_limit"))
    # One row per language, as the model itself.
    near = hashed.join(F.broadcast(limits), (F.col("lang") == F.col("_lang")) & (F.col("_hash").cast("double") <= F.col("_limit")))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_id"))
    ids = near.select(F.col("doc_id").alias("_id"), "_lang", "_hash").distinct()
    return ids.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("_id", "_lang")


def taught(docs: DataFrame) -> DataFrame:
    return docs.where(learnable()).where(F.length(F.trim("text")) > 0).select("doc_id", "lang", "text")


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(idf, language of each centroid, centroids).

    idf is counted over every labelled row outside the held-out quarter. The centroids are clustered from at most
    ``per_language`` such rows of a language, those with the smallest hash of doc_id; of rows that share a doc_id the
    smallest text.
    """
    known = taught(docs)
    idf = inverse_frequencies(known)
    picked = smallest_hashes(known.select("doc_id", "lang"), per_language)
    sample = known.join(F.broadcast(picked), (known["doc_id"] == picked["_id"]) & (known["lang"] == picked["_lang"])).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def centroids(key: tuple, table: pa.Table) -> pa.Table:
        texts = [x for _, x in sorted(zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()))]
        centres = cluster(weigh(np.stack([features(x) for x in texts]), idf), k, rounds)
        return pa.table([pa.array([key[0].as_py()] * len(centres), pa.string()), pa.array([c.tobytes() for c in centres], pa.binary())], names=["lang", "centre"])

    rows = sorted(sample.groupBy("lang").applyInArrow(centroids, "lang string, centre binary").collect())
    if not rows:
        return idf, [], np.zeros((0, DIM), np.float32)
    return idf, [r["lang"] for r in rows], np.stack([np.frombuffer(r["centre"], np.float32) for r in rows])


def nearest(texts: list[bytes], model: tuple) -> tuple[list[str], list[float], list[int]]:
    """Language and cosine of the nearest centroid and step of length per text; ``und`` and 0 without a letter or without a model."""
    idf, names, centres = model
    lang, score, extent = [], [], []
    for at in range(0, len(texts), 256):
        some = texts[at : at + 256]
        if not names:
            lang += [UNKNOWN] * len(some)
            score += [0.0] * len(some)
            extent += [0] * len(some)
            continue
        counts = np.stack([features(x) for x in some])
        near = weigh(counts, idf) @ centres.T
        extent += np.floor(2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int).tolist()
        for text, row, best in zip(some, near, near.argmax(axis=1)):
            letters = LETTER.search(text.decode("utf-8", "replace")) is not None
            lang.append(names[best] if letters else UNKNOWN)
            score.append(min(1.0, max(0.0, float(row[best]))) if letters else 0.0)
    return lang, score, extent


def openings(text: bytes) -> Iterator[bytes]:
    """The first 1, 2, 4, 8, ... words of a text, and all of it: every row shows how its language looks at each length."""
    words = text.split()
    n = 1
    while n < len(words):
        yield b" ".join(words[:n])
        n *= 2
    yield text


def bounds_of(seen: np.ndarray) -> np.ndarray:
    """Least cosine by language and step of length from counts by language, step and bin of the cosine.

    Half of the texts of a language and length lie above the median, so what is foreign or junk among them moves the
    bound little. Short texts differ much from one another, so their bound is low. A step with few rows takes the bound
    of the next shorter one that has enough, 0 without any: then nothing is rejected by distance.
    """
    out = np.zeros(seen.shape[:2])
    for lang, steps in enumerate(seen):
        bound = 0.0
        for step, bins in enumerate(steps):
            n, below = bins.sum(), bins.cumsum()
            if n >= LEAST_FITTED:
                low, middle = (np.searchsorted(below, q * n) / BINS for q in (0.05, 0.5))
                bound = max(0.0, min(middle - SPREADS * (middle - low), SHARE * middle))
            out[lang, step] = bound
    return out


def rejection_bounds(docs: DataFrame, model: tuple) -> dict[str, np.ndarray]:
    """Per language the least cosine by step of length, fitted to the openings of all learnable rows.

    Per task one table of counts leaves, languages times ``EXTENTS`` times ``BINS`` numbers reach the driver at most.
    """
    names = sorted(set(model[1]))
    if not names:
        return {}
    index, shape = {x: i for i, x in enumerate(names)}, (len(names), EXTENTS, BINS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shape, np.int64)
        for part in chunks(batches):
            for text in utf8(part):
                for lang, score, extent in zip(*nearest(list(openings(text)), model)):
                    if lang in index:
                        seen[index[lang], extent, min(int(score * BINS), BINS - 1)] += 1
        flat = seen.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    rows = taught(docs).select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(shape, np.int64)
    for r in rows:
        seen[np.unravel_index(r["at"], shape)] = r["n"]
    return dict(zip(names, bounds_of(seen)))


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others) with held_out, lang_pred, score and rejected added.

    ``learn_from`` (doc_id, lang, text; ``docs`` if not given) teaches the languages. ``score`` is the cosine to the
    nearest centroid, 0 to 1; its language is the prediction, the first by name in a tie. A null text, one without a
    letter, or any text if nothing could be learnt is ``und`` with score 0. Rejected are those, and texts farther from
    every centroid than texts of the predicted language and of their length are. Repeated rows get equal results; an empty table gives no rows. Columns of
    ``docs`` that have one of the added names are replaced.
    """
    teachers = learn_from if learn_from is not None else docs
    model = train(teachers)
    bounds = rejection_bounds(teachers, model)
    rows = docs.drop(*ADDED)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            lang, score, extent = nearest(utf8(part), model)
            far = [x not in bounds or y < bounds[x][z] for x, y, z in zip(lang, score, extent)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.mapInArrow(predict, schema).select(*rows.columns, held.alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; all columns kept, also those that have one of its names."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ADDED}
    kept = identify(docs.withColumnsRenamed(own), learn_from).where(~F.col("rejected")).drop(*ADDED)
    return kept.withColumnsRenamed({new: old for old, new in own.items()}).select(*docs.columns)
