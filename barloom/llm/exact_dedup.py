"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import one_row_each, row_key
from barloom.session import stored

KEY = ("digest", "n_bytes", "check")


def digest_runs(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its id, a row number, the key of its text and the scan partition as its run.

    Written to the shared folder, so run and row numbers stay as they are when an executor is lost.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).alias("n_bytes"),
            F.xxhash64(text).alias("check"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def merge_runs(digests: DataFrame, keep: str = "largest", fan_in: int = 16) -> DataFrame:
    """(digest, n_bytes, check, best, n): one record per text, merged up a tree of runs.

    In each round the runs ``fan_in * r ...`` send their records to run ``r``. A struct as aggregate makes Spark sort
    by (run, key) on both sides of the exchange, so a run is a sorted run, and the merge is a stream over sorted
    records in bounded memory. Equal records meet first inside a task (the partial aggregate), so a text that fills a
    third of the table is one record per task before anything moves. Runs are spread by (run, key), so no task holds a
    whole run, the last one included. Byte length and a second hash are part of the key: texts that shared a SHA-256
    without being equal would stay apart.
    """
    best = F.max if keep == "largest" else F.min
    n_runs = (digests.agg(F.max("run")).first()[0] or 0) + 1
    tree = digests.select("run", *KEY, F.struct("doc_id", "row").alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        parent = F.floor(F.col("run") / fan_in).cast("int").alias("run")
        tree = tree.groupBy(parent, *KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
        n_runs = -(-n_runs // fan_in)
        if n_runs <= 1:
            return tree.drop("run")


def exact_groups(docs: DataFrame, keep: str = "largest", fan_in: int = 16) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. ``keep`` names which doc_id of a group stays. Rows with the
    same doc_id and text are a group like any other and one of them stays; a null doc_id ranks below all others.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    digests = digest_runs(docs)
    groups = stored(merge_runs(digests, keep, fan_in), "digest-groups")
    # The rows of one text share a key: both sides are plain exchanges, so adaptive execution splits a hot one.
    return digests.join(groups, list(KEY)).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns kept, rows with one doc_id told apart by text.

    Rows that agree in doc_id and text leave one row.
    """
    stay = exact_groups(docs, keep).where("kept").select(row_key(F.col("text_sha256")))
    return one_row_each(docs, row_key(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), stay)
