"""What the text operators share: reading the table, bounded chunks of a batch, ASCII white space, packs by hash slice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it; ``bytes.split()`` cuts at exactly these bytes.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Bytes of text that one step of a task holds as arrays; a longer text makes a chunk of its own.
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(digest: Column) -> Column:
    """doc_id and a digest of the text as one string that is never null, so that joins on it stay plain equality."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), digest)


def one_row_each(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in the only column of ``stay``, one row per key; all columns kept.

    Join and dedup share the exchange by key.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    keys = stay.toDF(name)
    return docs.withColumn(name, key).join(keys, name, "left_semi").dropDuplicates([name]).drop(name)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(v) if v is not None else 0 for v in batch.column(column).to_pylist()], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [v or b"" for v in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slice_count(entries: int, per_slice: int, least: int = 64) -> int:
    """Power of two of hash slices, so that a slice holds about ``per_slice`` entries at any size of the input."""
    n = least
    while n * per_slice < entries:
        n *= 2
    return n


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal runs."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
