"""Token counts of a unigram tokenizer without the tokens: a Viterbi pass that carries score and piece count only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.pieces import MODEL, Vocabulary, code_units, viterbi
from barloom.llm.text import chunks, utf8


def count_tokens(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, score of the best segmentation under the vocabulary.

    An Aho-Corasick automaton enumerates the pieces that end at a place; each distinct unit of a chunk of documents is
    solved once. Ties go to the longer piece, as the tokenizer's own decoder does; an unknown character counts one byte
    piece per byte. Null and empty texts have 0 tokens; blanks are pieces like any other. Repeated rows are rows of
    their own; an empty table gives no rows. The vocabulary is read on the driver and travels with the job: its size is
    that of the file, not of the data.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            units, codes, sizes = code_units(utf8(part))
            best = viterbi(units, vocabulary.value)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            tokens, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(tokens, owner, best.count[codes])
            np.add.at(score, owner, best.score[codes])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(tokens), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score long")
