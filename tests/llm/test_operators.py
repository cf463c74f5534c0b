"""Every operator against its plain definition, on odd texts and on the smallest table."""

import re

import brute
import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, language_id, license_scan, line_dedup, mixing, near_copies, nbest_pieces, quality_ratio, simhash_groups, substring_dedup, token_counts

OPS = {
    "tokens": token_counts.count_tokens,
    "pieces": nbest_pieces.encode,
    "exact": exact_dedup.exact_groups,
    "language": language_id.identify,
    "lines": line_dedup.dedup_lines,
    "mixing": mixing.mix,
    "license": license_scan.scan_licenses,
    "substring": substring_dedup.remove_repeats,
    "simhash": simhash_groups.simhash_groups,
    "quality": lambda d: quality_ratio.judge(d, d.sparkSession.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")),
}
FILTERS = (exact_dedup.drop_exact_copies, simhash_groups.drop_near_copies, near_copies.drop_near_copies, mixing.mixed_documents, language_id.drop_rejected)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


@pytest.fixture(params=["odd", "corpus"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", OPS)
def test_empty_table_and_clashing_columns(name, nothing, odd, clashing):
    op = OPS[name]
    assert op(nothing).count() == 0
    plain = op(odd)
    assert op(clashing).count() == plain.count() == odd.count()


@pytest.mark.parametrize("step", FILTERS, ids=lambda f: f.__name__)
def test_stage_forms_keep_the_columns(step, nothing, odd, clashing):
    assert step(nothing).count() == 0
    assert step(clashing).columns == clashing.columns
    assert step(odd).columns == odd.columns


def test_exact_groups(docs):
    texts = pairs(docs)
    groups = {}
    for d, t in texts:
        groups.setdefault(t or "", []).append(d)
    got = exact_dedup.exact_groups(docs, fan_in=2)
    same(rows(got, "doc_id", "keep_id", "group_size", "text_sha256"), [(d, brute.last_id(groups[t or ""]), len(groups[t or ""]), brute.sha(t or "")) for d, t in texts])
    assert got.where("kept").count() == len(groups)
    assert got.where("kept AND NOT doc_id <=> keep_id").count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.count() == len(groups) and {t or "" for _, t in pairs(left)} == set(groups)


def test_smallest_id_can_stay(corpus):
    assert exact_dedup.exact_groups(corpus, keep="smallest").where("keep_id > doc_id").count() == 0


def test_line_dedup(docs):
    same(rows(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.line_dedup(pairs(docs)))


def test_twice_seen_filter_misses_no_repeat():
    import numpy as np

    digests = np.random.default_rng(1).bytes(16 * 4000)
    seen = line_dedup.TwiceSeen(4000)
    seen.add(digests)
    seen.add(digests[: 16 * 500])
    hits = set(seen.suspects(digests).tolist())
    assert set(range(500)) <= hits and len(hits) < 550


def test_quality_base_and_ratio(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality_ratio.judge(docs, labels)
    same(rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.quality_base(pairs(docs)))
    assert got.where("base_failed AND kept").count() == 0
    assert got.where("NOT base_failed AND kept != (ratio >= -0.25)").count() == 0
    assert rows(got, "doc_id", "ratio") == rows(quality_ratio.judge(docs.repartition(5), labels), "doc_id", "ratio")


def test_quality_ratio_by_hand(spark):
    import math
    from collections import Counter

    docs = spark.createDataFrame([(1, "good words here"), (2, "bad *** words"), (3, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    grams = {r["doc_id"]: [] for r in docs.collect()}
    for r in quality_ratio.gram_rows(docs, "doc_id").collect():
        grams[r["doc_id"]].append(r["bucket"])
    assert {d: len(g) for d, g in grams.items()} == {1: 5, 2: 5, 3: 1}
    raw, good, b = Counter(x for g in grams.values() for x in g), Counter(grams[1]), quality_ratio.BUCKETS
    ratio = lambda x: math.log((good[x] + 1) / (5 + b) / ((raw[x] + 1) / (11 + b)))
    got = {r["doc_id"]: r["ratio"] for r in quality_ratio.judge(docs, labels).collect()}
    for d, g in grams.items():
        assert got[d] == pytest.approx(sum(map(ratio, g)) / len(g), abs=1e-7)


def test_quality_keeps_labelled_good(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_ratio.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
    n = got.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert n > 0.99


def test_license_base(docs):
    same(rows(license_scan.scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), brute.license_base(pairs(docs)))


@pytest.mark.parametrize(
    ("expression", "labels", "freedom"),
    [
        ("mit or gpl-2.0-only", {"mit", "gpl"}, 1.0),
        ("mit and gpl-2.0-only", {"mit", "gpl"}, 0.4),
        ("mit or gpl-3.0 and agpl-3.0", {"mit", "gpl", "agpl"}, 1.0),
        ("(mit or gpl-3.0) and agpl-3.0", {"mit", "gpl", "agpl"}, 0.3),
        ("gpl-2.0 with classpath-exception-2.0 and mit", {"gpl", "mit"}, 0.5),
        ("foo", {"foo"}, 0.3),
    ],
)
def test_license_expressions(expression, labels, freedom):
    terms = license_scan.evaluate(expression)
    assert terms.labels == labels and terms.freedom == pytest.approx(freedom)


@pytest.mark.parametrize("expression", ["", "and", "mit or", "(mit", "mit)", "mit gpl", "( )", "or mit"])
def test_malformed_expressions_are_passed_over(expression):
    assert license_scan.evaluate(expression) is None


def test_substring(docs):
    same(rows(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring(pairs(docs)))


def test_cover_holds_every_difference():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("chunk", [200, 4 << 20])
def test_chunk_size_changes_nothing(corpus, chunk, monkeypatch):
    from barloom.llm import text

    monkeypatch.setattr(text.chunks, "__defaults__", ("text", chunk))
    same(rows(substring_dedup.remove_repeats(corpus), "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring(pairs(corpus)))
    same(rows(line_dedup.dedup_lines(corpus), "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.line_dedup(pairs(corpus)))


def test_simhash(docs):
    same(rows(simhash_groups.simhash_groups(docs), "doc_id", "fingerprint", "component_id"), brute.simhash(pairs(docs)))


def test_grid_links_find_every_pair(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    fps = {int(x) for x in seeds} | {0, 2**64 - 1}
    for x in seeds[:20]:
        for _ in range(30):
            bits = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            fps.add(int(x) ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    frame = spark.createDataFrame([(x if x < 2**63 else x - 2**64,) for x in fps], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash_groups.grid_links(frame).collect()]

    def parts(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        groups = {}
        for x in fps:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    true = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    assert parts(links) == parts(true)


def test_mixing(docs):
    by_source, sizes = {}, {}
    for r in docs.select("doc_id", "source", "text").collect():
        n = len(brute.words(r["text"]))
        by_source[r["source"]] = by_source.get(r["source"], 0) + n
        sizes.setdefault(r["source"], []).append(n)
    want = brute.targets(by_source)
    got = mixing.mix(docs)
    joined = got.join(docs.select(F.col("doc_id").alias("_id"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("_id"))).collect() if docs.count() == docs.select("doc_id").distinct().count() else []
    assert sorted(r["size"] for r in got.collect()) == sorted(x for v in sizes.values() for x in v)
    for s, target in want.items():
        own = [r for r in joined if r["source"] == s]
        if own:
            assert own[0]["target"] == pytest.approx(target)
            assert abs(sum(r["taken"] for r in own) - target) <= max(sizes[s]) / 2 + 1
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] and len(r["places"] or []) == r["copies"] for r in got.collect())
    assert rows(got, "doc_id", "taken") == rows(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mixed_documents(docs).count() == got.agg(F.sum("copies")).first()[0]


def test_blocks_stay_countable():
    assert mixing.block_size(0) == mixing.block_size(1e9) == mixing.BLOCK_WORDS
    assert 1.5e14 / mixing.block_size(1.5e14) <= mixing.MOST_BLOCKS


def test_split_quotas_add_up():
    import numpy as np

    blocks, shards = np.array([50, 0, 7, 23]), 7
    parts = [mixing.split_quotas(blocks, i, shards, 3) for i in range(shards)]
    assert (sum(k for _, k in parts) == blocks).all()
    assert {int(k.sum()) for _, k in parts} <= {blocks.sum() // shards, blocks.sum() // shards + 1}
    for s in range(len(blocks)):
        taken = sorted(x for a, k in parts for x in range(a[s], a[s] + k[s]))
        assert taken == list(range(blocks[s]))


def test_drawn_blocks_decide_what_is_taken(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 14)
    every = {r["row"]: r for r in mixing.mix(corpus).collect()}
    deal = mixing.deal_blocks
    monkeypatch.setattr(mixing, "deal_blocks", lambda *a: deal(*a).where("shard % 2 = 0"))
    some = {r["row"]: r for r in mixing.mix(corpus).collect()}
    even = {i: [p for p in r["places"] or [] if p["shard"] % 2 == 0] for i, r in every.items()}
    assert {i: r["copies"] for i, r in some.items()} == {i: len(x) for i, x in even.items()}
    assert 0 < sum(r["taken"] for r in some.values()) < sum(r["taken"] for r in every.values())


def test_mix_is_laid_out_by_shard(spark, corpus, monkeypatch):
    from barloom.llm.queries import op7_mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 14)
    got = op7_mixing(spark, "/root/testdata/sf0.001").where("copies > 0").collect()
    at = sorted((shard, place, r["doc_id"]) for r in got for shard, place in zip(r["shards"], r["places"]))
    assert len({shard for shard, _, _ in at}) > 1
    assert [r["doc_id"] for r in mixing.mixed_documents(corpus).collect()] == [d for _, _, d in at]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs)
    held = got.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    assert got.where("rejected").count() <= 0.005 * got.count()


def test_short_clean_texts_stay_and_other_languages_go(spark):
    import random

    learn = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = ["Yes", "Hi", "Home", "Bonjour", "Avec.", "The", "Der", "Der Der Der Der Der Der Der Der Der Der Der Der"]
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "".join(random.Random(0).choices("abcdefghijklmnopqrstuvwxyz ", k=2000)),
    ]
    docs = spark.createDataFrame(list(enumerate(clean + foreign)), "doc_id long, text string")
    got = {r["text"]: r["rejected"] for r in language_id.identify(docs, learn).collect()}
    assert [x for x in clean if got[x]] == [] and [x for x in foreign if not got[x]] == []


def test_language_sample_has_the_smallest_hashes(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("lang"))
    rows = rows.unionAll(spark.range(9000).select(F.lit(7).cast("long"), F.lit("c")))
    got = {(r["_lang"], r["_id"]) for r in language_id.smallest_hashes(rows, 80).collect()}
    by = {}
    for r in sorted(rows.distinct().withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: r["h"]):
        by.setdefault(r["lang"], []).append(r["doc_id"])
    assert got == {(lang, d) for lang, ids in by.items() for d in ids[:80]}


def test_language_prediction_does_not_see_labels(odd):
    got = language_id.identify(odd)
    assert got.where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").select("lang_pred").distinct().collect() == [("und",)]
    assert got.where("text RLIKE '\\\\p{L}' AND lang_pred NOT IN ('en', 'fr')").count() == 0


def test_filters_keep_one_row_of_each_group_and_own_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i * 7 % 41}" for i in range(40))
    rows = [(1, text), (1, other), (2, text), (None, text), (None, " ".join(f"u{i * 5 % 43}" for i in range(40))), (None, "only null ids here " * 20), (None, "only null ids here " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(9.0), "rejected": F.lit("mine"), "_key": F.lit(5)})
    near = simhash_groups.drop_near_copies(docs).collect()
    groups = {r["fingerprint"]: r["component_id"] for r in simhash_groups.simhash_groups(docs).collect()}
    links = sum(1 for a in groups for b in groups if a < b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 3)
    assert links == 0 and len(near) == len(groups)
    assert sorted(r["text"] for r in near if r["doc_id"] == 1) == sorted([text, other])
    exact = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact) == sorted([(2, text), (1, other), (0, rows[4][1]), (0, rows[5][1])])
    for r in [*near, *exact, *language_id.drop_rejected(docs.withColumn("lang", F.lit("en"))).collect()]:
        assert (r["score"], r["rejected"], r["_key"]) == (9.0, "mine", 5)


TAG = "SPDX-License-Identifier:"


@pytest.mark.parametrize(
    "text, labels, score",
    [
        (f"{TAG} MIT Copyright 2020", "mit", 1.0),
        (f"({TAG} MIT)", "mit", 1.0),
        (f"// {TAG} MIT.", "mit", 1.0),
        (f"<p>{TAG} MIT</p>", "mit", 1.0),
        (f'"{TAG} "MIT"', "mit", 1.0),
        (f"/* {TAG} GPL-2.0-or-later WITH Classpath-exception-2.0 */", "gpl", 0.5),
        (f"<!-- {TAG} (MIT OR Apache-2.0) AND BSD-3-Clause-->", "apache,bsd,mit", 1.0),
        (f"{TAG} MIT AND", "mit", 1.0),
        (f"{TAG} (MIT OR GPL-3.0", "", 0.5),
        (f"{TAG} MIT {TAG} GPL-3.0+, all rights reserved", "gpl,mit,proprietary", 0.0),
        (f"{TAG}\nMIT", "", 0.5),
        (f"spdx license identifier {TAG.lower()}\tISC", "isc", 1.0),
        (f"{TAG} Foo-1.0 under the mit license", "foo-1.0,mit", 0.3),
        ("creative commons and public domain", "cc,public-domain", 0.5),
        ("nothing", "", 0.5),
        (None, "", 0.5),
    ],
)
def test_license_labels_and_score(spark, text, labels, score):
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["labels"], got["score"]) == (labels, pytest.approx(score))


def test_a_megabyte_of_tags_is_linear():
    import time

    find = license_scan.automaton()
    for text in (f"{TAG} MIT OR " * 45_000, f"{TAG} (" * 40_000, f"{TAG} MIT\n" * 40_000, f"{TAG} " + "mit and " * 130_000 + "mit"):
        begin = time.time()
        license_scan.scan(text.encode(), find)
        assert time.time() - begin < 5


def ngram_counts(text):
    """The definition of the features: folded text between blanks, byte 2- to 4-grams, one hash each."""
    import re as plain

    line = " " + " ".join(plain.sub(r"[\x00-\x60\x7b-\x7f]", " ", plain.sub(r"[A-Z]", lambda m: m[0].lower(), text)).split(" ")) + " "
    line = plain.sub(" +", " ", line)
    data, out = line.encode(), {}
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            code = data[i]
            for b in data[i + 1 : i + n]:
                code = (code * 257 + b) % 2**32
            f = (code * 2654435761 % 2**32 >> 20) ^ n
            out[f] = out.get(f, 0) + 1
    return out


def test_nearest_centroid_by_hand(odd, corpus):
    import math

    idf, names, centres = language_id.train(corpus, per_language=40, k=3, rounds=2)
    texts = [t for _, t in pairs(odd) if t and len(t) < 2000] + [t for _, t in pairs(corpus) if t and len(t) < 300][:25]
    got = language_id.nearest([t.encode() for t in texts], (idf, names, centres))
    for text, lang, score in zip(texts, *got[:2]):
        counts = ngram_counts(text)
        w = {f: (1 + math.log(c)) * float(idf[f]) for f, c in counts.items()}
        size = math.sqrt(sum(v * v for v in w.values())) or 1.0
        near = [sum(v / size * float(centre[f]) for f, v in w.items()) for centre in centres]
        if any(ch.isalpha() for ch in text):
            assert score == pytest.approx(min(1.0, max(near)), abs=1e-4)
            assert near[names.index(lang)] <= max(near) and max(n for n, x in zip(near, names) if x == lang) == pytest.approx(max(near), abs=1e-4)
        else:
            assert (lang, score) == ("und", 0.0)


def test_openings_are_the_same_for_every_text():
    assert list(language_id.openings(b"a b c d e")) == [b"a", b"a b", b"a b c d", b"a b c d e"]
    assert list(language_id.openings(b"a b c d f")) == [b"a", b"a b", b"a b c d", b"a b c d f"]
    assert list(language_id.openings(b"")) == [b""]


def test_mix_moves_texts_once_and_sorts_them(spark, corpus):
    """Rows of their own in doc_id and size meet the mix in one shuffle of the texts; the sort by shard is the other."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = mixing.mixed_documents(corpus)
        assert df.collect()
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(threshold, before)
    tree, nodes = plan.split("== Initial Plan ==")[0], plan.split("\n\n(1) ")[1]
    final = set(re.findall(r"(?<!Reused)Exchange \((\d+)\)", tree))
    moved = [k for k, kind, rest in re.findall(r"\((\d+)\) (Exchange)\n(.*)", nodes) if k in final and re.search(r"\btext#", rest)]
    assert len(moved) == 2, moved
