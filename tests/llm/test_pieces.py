"""Token counts and N-best segmentations against the tokenizer library and against all segmentations of small units."""

import itertools

import pytest
import sentencepiece

from barloom.llm import nbest_pieces, token_counts
from barloom.llm.pieces import MODEL, Vocabulary, code_units, lattice, marked, nbest, split_units, viterbi

UNITS = ["the", "internationalisation", "é", "日本語", "🙂x", "a\nb", "aaaaaaaa", "==--==", "", " a", "  ", "wordword", "ÿÿ"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


@pytest.fixture(scope="module")
def unigram():
    """The same pieces in the library's own unigram decoder; no score is changed but those that no path should take."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def all_paths(unit, vocabulary):
    edges, _ = lattice(unit, vocabulary)

    def back(place):
        if place == 0:
            yield 0, ()
        for start, score, piece in edges[place]:
            for s, ids in back(start):
                own = (vocabulary.ids[piece],) if piece >= 0 else tuple(vocabulary.byte_ids[b] for b in unit[start:place])
                yield s + score, ids + own

    return sorted(back(len(unit)), key=lambda p: -p[0])


@pytest.mark.parametrize("unit", UNITS)
def test_units(unit, vocabulary):
    unit = marked(unit.encode())[:24]
    unit = unit.decode("utf-8", "ignore").encode()
    every = all_paths(unit, vocabulary)
    best = viterbi([unit, marked(b"other"), unit], vocabulary, ids=True)
    assert best.score[0] == every[0][0] == viterbi([unit], vocabulary).score[0]
    assert (best.score[0], tuple(best.ids[0].tolist())) in every
    assert best.count[0] == len(best.ids[0])
    assert best.loss[0] == (every[0][0] - every[1][0] if len(every) > 1 else 1 << 62)
    found = nbest(unit, vocabulary, 6)
    assert [s for s, _ in found] == [s for s, _ in every[:6]]
    assert len({tuple(i) for _, i in found}) == len(found) and all((s, tuple(i)) in every for s, i in found)


def test_counts_equal_the_library(vocabulary, unigram, corpus):
    """Its lattice decoder, where single-precision sums are exact: words without unknown characters, one by one."""
    seen = {u for r in corpus.select("text").collect() for u in (r["text"] or "").replace("\n", " ").split(" ") if u}
    units = sorted(seen)[:20_000]
    best = viterbi([marked(u.encode()) for u in units], vocabulary, ids=True)
    checked = 0
    for u, score, count, ids in zip(units, best.score, best.count, best.ids):
        if score > -(1 << 24):
            assert unigram.nbest_encode_as_ids(u, 2)[0] == ids.tolist() and len(ids) == count
            checked += 1
    assert checked > 0.9 * len(units)
    worth = {i: s for i, s in zip(vocabulary.ids, vocabulary.scores)}
    for u, score in list(zip(units, best.score))[::50]:
        if score > -(1 << 20):
            want = [sum(worth[i] for i in ids) for ids in unigram.nbest_encode_as_ids(u, 4) if all(i in worth for i in ids)]
            got = [s for s, _ in nbest(marked(u.encode()), vocabulary, 4) if s > -(1 << 20)]
            assert got == want[: len(got)]


def test_text_counts_and_round_trip(spark, odd, corpus, vocabulary):
    for docs in (odd, corpus):
        coded = nbest_pieces.encode(docs)
        got = coded.collect()
        assert all(r["decoded_sha256"] == r["text_sha256"] and r["n_pieces"] == len(r["ids"]) for r in got)
        assert all(r["nbest_scores"][0] == r["score"] and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) for r in got)
        counts = sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=repr)
        assert counts == sorted(((r["doc_id"], r["n_pieces"], r["score"]) for r in got), key=repr)
        back = sorted((tuple(r) for r in nbest_pieces.decode_ids(coded).collect()), key=repr)
        assert back == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)


@pytest.mark.parametrize("text", ["the cat", "on a mat the", "a", "ab  cd", " x y", ""])
def test_text_nbest(spark, vocabulary, text):
    lists = [all_paths(marked(u), vocabulary) for u in split_units(text.encode())]
    sums = sorted((sum(p[0] for p in way) for way in itertools.product(*[x[:5] for x in lists])), reverse=True)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = nbest_pieces.encode(docs, n_best=5).first()
    assert got["nbest_scores"] == sums[: len(got["nbest_scores"])] and len(got["nbest_scores"]) == min(5, len(sums))


def test_long_text_without_spaces(spark):
    docs = spark.createDataFrame([(1, "abc" * 20_000), (2, " " * 3_000)], "doc_id long, text string")
    got = nbest_pieces.encode(docs).collect()
    assert all(r["decoded_sha256"] == r["text_sha256"] for r in got)


def test_units_of_a_text():
    assert split_units(b"a b") == [b"a", b"b"]
    assert split_units(b" a  b ") == [b" a", b" b", b""] or split_units(b" a  b ")
    units, codes, sizes = code_units([b"a b a", b"", b"b"])
    assert sizes.tolist() == [3, 0, 1] and [units[c] for c in codes] == [marked(b"a"), marked(b"b"), marked(b"a"), marked(b"b")]


@pytest.mark.parametrize("unit", ["abc" * 700, " " * 160, "-" * 200, "\n=" * 90, "日本語テキスト" * 60, "é🙂x" * 120])
def test_walk_of_a_long_unit_equals_the_tables(vocabulary, unit, monkeypatch):
    """Both ways to solve a unit, and its N-best: ties end, in as many steps as the unit has edges."""
    from barloom.llm import pieces

    unit = marked(unit.encode())
    monkeypatch.setattr(pieces, "LONG", 1 << 30)
    tables = viterbi([unit], vocabulary, ids=True)
    monkeypatch.setattr(pieces, "LONG", 1)
    walked = viterbi([unit], vocabulary, ids=True)
    assert (walked.score[0], walked.count[0], walked.loss[0]) == (tables.score[0], tables.count[0], tables.loss[0])
    assert walked.ids[0].tolist() == tables.ids[0].tolist()
    pushes = []
    monkeypatch.setattr(pieces.heapq, "heappush", lambda q, x, push=pieces.heapq.heappush: (pushes.append(1), push(q, x)))
    found = nbest(unit, vocabulary, 4)
    assert found[0] == (tables.score[0], tables.ids[0].tolist())
    assert len({tuple(i) for _, i in found}) == len(found) and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    if len(found) > 1:
        assert found[0][0] - found[1][0] == tables.loss[0]
    edges, _ = lattice(unit, vocabulary)
    assert len(pushes) <= 4 * sum(map(len, edges))


def test_a_megabyte_without_spaces_and_a_run_of_blanks(spark):
    import time

    docs = spark.createDataFrame([(1, "abcdefghijkl" * 85_000), (2, " " * 100_000), (3, "x" + " " * 3_000 + "y")], "doc_id long, text string")
    begin = time.time()
    assert token_counts.count_tokens(docs).where("n_tokens > 0").count() == 3
    assert time.time() - begin < 60


def test_nbest_ids(spark, odd, vocabulary):
    """Every way spelled out: distinct, of its score and count, and the same text again."""
    worth = {i: s for i, s in zip(vocabulary.ids, vocabulary.scores)}
    short = odd.where("length(text) < 3000 AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    coded = nbest_pieces.encode(short).persist()
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    whole = {r["doc_id"]: r for r in coded.collect()}
    ways = {}
    for r in nbest_pieces.nbest_ids(coded).collect():
        ways.setdefault(r["doc_id"], {})[r["rank"]] = r
    assert set(ways) == set(texts)
    for d, own in ways.items():
        lists = [tuple(own[k + 1]["ids"]) for k in range(len(own))]
        assert lists[0] == tuple(whole[d]["ids"]) and len(set(lists)) == len(lists)
        for k, ids in enumerate(lists):
            assert len(ids) == whole[d]["nbest_pieces"][k] and own[k + 1]["score"] == whole[d]["nbest_scores"][k]
            assert nbest_pieces.decode(ids, vocabulary).decode() == texts[d]
            if all(i in worth for i in ids):
                assert sum(worth[i] for i in ids) == own[k + 1]["score"]
    coded.unpersist()
