"""Near copies at a stated similarity: SimHash candidates from the popcount grid, completed by chosen paths, checked exactly.

A 64-bit SimHash of five-word shingles differs in about ten bits between texts of Jaccard similarity 0.8, far more than a grid
over its popcounts can search at scale; what it finds (up to 3 bits) is verified here, and chosen paths find the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chosen_paths import near_components, set_classes, token_sets, with_components
from barloom.llm.simhash_groups import fingerprints, grid_links, text_mark
from barloom.llm.text import one_row_each, row_key
from barloom.session import discard, stored


def simhash_candidates(classes: DataFrame, docs: DataFrame, width: int, bits: int = 3) -> DataFrame:
    """(a, b): pairs of classes whose fingerprints are equal or within ``bits`` of one another, as many as connect them."""
    key = row_key(F.col("mark").cast("string"))
    prints = fingerprints(docs, width).select(key.alias("row"), "fp").dropDuplicates(["row"])
    named = stored(classes.select("cid", "row").join(prints, "row").select("cid", "fp"), "class-fingerprints")
    heads = stored(named.groupBy("fp").agg(F.min("cid").alias("head")), "fingerprint-heads")
    same = named.join(heads, "fp").where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    links = stored(grid_links(heads.select("fp"), bits), "fingerprint-links")
    ends = [heads.select(F.col("fp").alias(e), F.col("head").alias(f"_{e}")) for e in ("a", "b")]
    near = links.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return same.unionByName(near)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id; all columns kept.

    Texts link when the sets of their shingles of ``width`` words, A-Z lower-cased, have ``percent`` in a hundred of
    their union in common; every link is confirmed on the whole sets. Texts without words stay. A null doc_id comes
    after all others; rows that agree in doc_id and text leave one row. An empty table gives no rows.
    """
    prints = stored(token_sets(docs, width), "token-sets")
    classes = set_classes(prints)
    forest = near_components(classes, docs, width, percent, first=simhash_candidates(classes, docs, width))
    rooted = with_components(classes.select("cid", "first_id", "row"), forest)
    head = F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "row")).alias("head")
    stay = rooted.groupBy("comp").agg(head).select("head.row")
    wordless = prints.where(F.col("key").isNull()).select(row_key(F.col("mark").cast("string")).alias("row")).distinct()
    stay = stored(stay.unionByName(wordless), "stay")
    discard(prints)
    return one_row_each(docs, row_key(text_mark().cast("string")), stay)
