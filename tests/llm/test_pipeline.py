"""The pipeline against its stages' plain definitions, and the entry without the text operators."""

from pyspark.sql import functions as F
from test_chosen_paths import by_hand as near_by_hand

import corpus_pipeline
from barloom.llm import language_id, mixing


def test_pipeline_equals_the_stages_by_hand(spark, corpus):
    docs = {r["doc_id"]: r for r in corpus.collect()}
    keep = {r["doc_id"] for r in language_id.identify(corpus).where("NOT rejected").collect()}
    last = {}
    for d in sorted(keep):
        last[docs[d]["text"]] = d
    keep = set(last.values())
    keep = {d for d, _, c, _ in near_by_hand([(d, docs[d]["text"]) for d in sorted(keep)], 5) if d == c}
    kept = corpus.where(F.col("doc_id").isin(sorted(keep)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(d for d, n in copies.items() for _ in range(n))


def test_stages_before_the_last_return_documents(spark, corpus):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, corpus, "/root/testdata/sf0.001").columns == corpus.columns


def test_near_copies_of_sf01_against_all_pairs(spark):
    """Recall of links at 0.8 of five-word shingles, and no group without one."""
    from barloom.llm import exact_dedup, near_copies

    docs = exact_dedup.drop_exact_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    left = {r["doc_id"] for r in near_copies.drop_near_copies(docs).select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert left == {d for d, _, c, _ in near_by_hand(rows, 5) if d == c}
