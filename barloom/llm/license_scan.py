"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; tags hold and/or/with expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.text import chunks, utf8

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, by label.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: How freely text under a label may be used, 0 to 1; labels that are not named count as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 1.0, "public-domain": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5,
    "cc-by-sa": 0.5, "cc": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0,
}
UNKNOWN, EXCEPTION_BONUS, NO_NOTICE = 0.3, 0.1, 0.5
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "mpl", "bsd", "isc", "cc0", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by")
#: Binding strength of the operators of an expression.
STRENGTH = {"or": 1, "and": 2, "with": 3}
#: Bytes that are no part of a word become blanks; A-Z become a-z.
WORDS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


#: The words of an identifier tag, as they stand in a line of words.
TAG = " spdx license identifier "
#: One token of an expression: a parenthesis, or a licence name that starts and ends with a letter, digit or plus.
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9](?:[a-z0-9.+_-]*[a-z0-9+])?)")


def automaton() -> ahocorasick.Automaton:
    """Notice phrases and the tag; a match is its phrase, None for the tag."""
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE}:
        found.add_word(f" {phrase} ", phrase)
    found.add_word(TAG, None)
    found.make_automaton()
    return found


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, or the identifier itself."""
    return next((f for f in FAMILIES if identifier == f or identifier.startswith((f + "-", f + "+"))), identifier)


def parse(tokens: Iterable[str]) -> tuple[list[str], int]:
    """Shunting yard over lower-cased tokens, as far as they make an expression: (postfix order, tokens used).

    Reading stops at the first token that can't follow, so the cost is that of the tokens read. What is returned is the
    longest beginning that is an expression by itself: after each operand or closing parenthesis outside of all
    parentheses, what has been read could end there.
    """
    out: list[str] = []
    waiting: list[str] = []
    whole, used = [], 0
    operand, depth = True, 0  # operand: what must come next
    for i, token in enumerate(tokens):
        if token in STRENGTH:
            if operand:
                break
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
            continue
        if token == ")":
            if operand or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif not operand:
            break
        elif token == "(":
            waiting.append(token)
            depth += 1
        else:
            out.append(token)
            operand = False
        if not operand and not depth:
            whole, used = [len(out), *waiting[::-1]], i + 1
    return (out[: whole[0]] + whole[1:], used) if used else ([], 0)


def postfix(expression: str) -> list[str] | None:
    """A whole expression in postfix order; None if it isn't well formed."""
    tokens = re.findall(r"[()]|[^\s()]+", expression)
    order, used = parse(tokens)
    return order if used and used == len(tokens) else None


@dataclass(frozen=True)
class Terms:
    labels: frozenset[str]
    freedom: float


def evaluate(expression: str) -> Terms | None:
    """``terms_of`` a whole expression; None if it isn't well formed."""
    order = postfix(expression)
    return None if order is None else terms_of(order)


def terms_of(order: list[str]) -> Terms:
    """Labels and freedom: ``or`` leaves the choice (the freest side), ``and`` binds by both, ``with`` loosens the left side."""
    stack: list[Terms] = []
    for token in order:
        if token not in STRENGTH:
            label = family(token)
            stack.append(Terms(frozenset([label]), FREEDOM.get(label, UNKNOWN)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(Terms(left.labels, min(1.0, left.freedom + EXCEPTION_BONUS)))
        else:
            pick = max if token == "or" else min
            stack.append(Terms(left.labels | right.labels, pick(left.freedom, right.freedom)))
    return stack[0]


def tokens_from(lowered: str, at: int) -> Iterator[str]:
    """Tokens of a line from a place on; names are taken without the punctuation behind them."""
    while found := TOKEN.match(lowered, at):
        if found[1] == TAG_NAME:  # the next tag; what follows belongs to that one
            return
        at = found.end()
        yield found[1]


def tag_terms(lowered: str, at: int) -> Terms | None:
    """The longest well-formed expression at a place behind a tag."""
    order, used = parse(tokens_from(lowered, at))
    return terms_of(order) if used else None


TAG_NAME = "spdx-license-identifier"
#: The tag as it is spelled, with a quotation mark that may open what follows.
TAG_TEXT = re.compile(TAG_NAME + r"[ \t]*:[ \t]*[\"'`]?")


def scan(text: bytes, find: ahocorasick.Automaton) -> tuple:
    words = text.translate(WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, labels, starts, freedom = set(), set(), [], []
    at = word = 0
    hits = sorted(((end - len(phrase or TAG) - 1, phrase) for end, phrase in find.iter(line)), key=lambda h: h[0])
    tagged = False
    for start, phrase in hits:
        if phrase is None:
            tagged = True
            continue
        word += line.count(" ", at, start)
        at = start
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        freedom.append(FREEDOM.get(label, UNKNOWN))
        if phrase in BASE:
            base.add(label)
            starts.append(word)
    if tagged:
        # The words of a tag stand in the text; its spelling and what follows are read there, each place once.
        lowered = text.lower().decode("utf-8", "replace")
        for found in TAG_TEXT.finditer(lowered):
            terms = tag_terms(lowered, found.end())
            if terms:
                labels |= terms.labels
                freedom.append(terms.freedom)
    score = min(freedom) if freedom else NO_NOTICE
    return (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of a-z, 0-9 and non-ASCII characters of the lower-cased text; a phrase is found where its words
    stand one after another, whatever separates them, overlapping places included. ``labels`` adds further notices and
    the licences of identifier tags: behind a tag the longest well-formed expression on its line counts, whatever follows it. ``score`` is the freedom that the strictest notice leaves, 0.5 without any. Null
    and empty texts have no words; malformed expressions are passed over; repeated rows are rows of their own.
    """
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for part in chunks(batches):
            rows = [scan(x, find) for x in utf8(part)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
