"""The queries of the text operators, and the SQL each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chosen_paths, exact_dedup, language_id, license_scan, line_dedup, merkle, mixing, nbest_pieces, quality_ratio, simhash_groups, substring_dedup, token_counts, treap_search
from barloom.llm.text import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = nbest_pieces.encode(documents(spark, sf_dir))
    return coded.withColumn("lossless", F.col("decoded_sha256") == F.col("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).drop("kept_text")


def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ratio.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.col("places.shard").alias("shards"), F.col("places.order").alias("places"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.simhash_groups(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(documents(spark, sf_dir))


def op12_minhash_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_paths.near_duplicates(documents(spark, sf_dir))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_nbest_pieces, op3_exact_dedup, op4_language_id, op5_line_dedup, op6_quality_ratio, op7_mixing, op8_license_scan,
        op9_substring_dedup, op10_simhash_groups, op11_merkle_manifest, op12_minhash_paths, op13_treap_search,
    )
}

SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_merkle_manifest": merkle.manifest_sql(),
    "op13_treap_search": treap_search.search_sql(),
}
