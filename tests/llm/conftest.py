import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This very line stands in several documents"


def odd_texts():
    """Nulls, blanks, ties, repeats, long texts, one-word texts and texts with shared lines and passages."""
    passage = " ".join(f"w{i}" for i in range(60))
    long_text = " ".join(f"t{i * i % 977}" for i in range(30_000))
    return [
        None, "", "   ", "\n\n", "a", "one two", "One  TWO", "12 345 --", passage, f"before it {passage} after it",
        f"{LINE}\nown line of this text here", f"  {LINE.upper()}  \nother line of this text", f"{LINE}\n{LINE}\t\nlast", f"x {passage} {passage}",
        long_text, long_text + " end", "same same same same same same", "é" * 19 + "\n" + "é" * 20, "é" * 20, "é" * 20 + "\n " + "é" * 20,
        "GNU General-Public, License and Apache\nLicense; mit license license mit license", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0",
        "Cc By cc by-nc", "z" * 5_000, "🙂 emoji 🙂 日本語 text", "tab\tand\x0bvt\x0cff\rcr", "nbsp is no space \x85 here",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    texts = odd_texts()
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", None, "b")[i % 3], 0) for i, t in enumerate(texts)]
    rows += [(3, "\n\n", "en", "a", 0), (None, texts[8], "en", None, 0), (None, None, None, None, None), (100, texts[12], "fr", "a", 1), (101, texts[14], "fr", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with more columns, named like results and helpers."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(1).alias(c) for c in ("digest", "run", "row", "score", "lang_pred", "size", "fp", "drops", "_id", "n_words", "slice")])
