"""Quality rules and a hashed n-gram log-likelihood ratio of trusted against raw text (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import SPACE
from barloom.session import attach_row, stored

BUCKETS = 10_000
#: Labelled documents that the trusted side learns from at most: those with the smallest hash of doc_id.
TRUSTED_ROWS = 20_000
SMOOTHING = 1.0
#: A document stays if its mean log-likelihood ratio per n-gram is at least this.
LEAST_RATIO = -0.25
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and runs of other characters that aren't white space."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\p{N}\s]+)", " $1 ")
    return F.array_remove(F.split(apart, r"\s+"), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = " \t\n\v\f\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, blank, "")) > 0)
    out = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    # Neighbours are zipped, not looked up by place: a lambda that names the array may split the text again for every word.
    rest = F.greatest(F.size("_w"), F.lit(1))
    zipped = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, rest).alias("b"), F.slice("_w", 3, rest).alias("c"))
    whole = F.slice(zipped, 1, F.greatest(F.size("_w") - 2, F.lit(0)))
    windows = F.transform(whole, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    out = out.withColumn("_g", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    # Most texts have no repeated window; the others sort theirs, so that equal ones are neighbours.
    placed = F.array_sort(F.arrays_zip(F.col("_g").alias("g"), F.sequence(F.lit(0), F.size("_g") - 1).alias("i")))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed))
    paired = F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(paired, lambda x: x.isNotNull()))))
    out = out.withColumn("_at", F.when(F.col("_s").isNotNull(), at))
    gaps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b, a + 3) - a))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    out = (
        out.withColumn("word_chars", F.length(F.translate(text, blank, "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered)
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "_lines", "_g", "_s", "_at")


def gram_rows(docs: DataFrame, *carried: str) -> DataFrame:
    """One row per hashed token and pair of neighbouring tokens; a text without tokens gives one row of NULL."""
    tokens = docs.select(*carried, tokens_of(F.col("text")).alias("_t"))
    pairs = F.arrays_zip(F.col("_t").alias("a"), F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1))).alias("b"))
    rows = tokens.select(*carried, F.inline_outer(pairs))
    one = F.pmod(F.xxhash64("a"), F.lit(BUCKETS)).cast("int")
    two = F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)).cast("int")
    both = F.when(F.col("b").isNull(), F.array(F.when(F.col("a").isNotNull(), one))).otherwise(F.array(one, two))
    return rows.select(*carried, F.explode(both).alias("bucket"))


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """(bucket, ratio) for every bucket: log of the trusted share over the raw share, both smoothed.

    The raw side counts every document. The trusted side counts documents labelled as good, ``trusted_rows`` of them at
    most; their ids are broadcast, a bounded list. Only one row per bucket and task is shuffled.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(trusted_rows).withColumn("trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_id"), "left")
    grams = gram_rows(marked, "trusted").where("bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = stored(every.join(counts, "bucket", "left").fillna(0, ["raw", "good"]), "gram-counts")
    totals = counts.agg(F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all"))
    share = lambda n, total: (F.col(n) + SMOOTHING) / (F.col(total) + SMOOTHING * BUCKETS)
    both = attach_row(counts, totals)
    return stored(both.select("bucket", F.round(F.log(share("good", "good_all") / share("raw", "raw_all")), 9).alias("ratio")), "gram-ratios")


def judge(docs: DataFrame, labels: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the base counts, base_failed, ratio, kept.

    ``ratio`` is the mean log-likelihood ratio of the text's n-grams, 0 without any; a document is kept if the base
    rules hold and the ratio is at least ``least_ratio``. Null and empty texts have no words and fail the base rules.
    Repeated rows are rows of their own; without any good label the ratios are those of a flat target. An empty table
    gives no rows. The ratios are rounded, so the sum doesn't depend on the order of rows.
    """
    ratios = log_ratios(docs, labels)
    carried = ("doc_id", "_row", *BASE, "base_failed")
    rows = base_counts(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
    grams = gram_rows(rows, *carried).join(F.broadcast(ratios), "bucket", "left")
    scored = grams.groupBy(*carried).agg((F.sum((F.col("ratio") * 1e9).cast("long")) / F.count("ratio") / 1e9).alias("ratio"))
    ratio = F.coalesce("ratio", F.lit(0.0))
    return scored.select("doc_id", *BASE, "base_failed", ratio.alias("ratio"), (~F.col("base_failed") & (ratio >= least_ratio)).alias("kept"))
