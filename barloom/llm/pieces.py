"""A piece vocabulary as a unigram model: Aho-Corasick matches, and Viterbi scores of many short units at a time.

Scores are whole numbers (the vocabulary's ranks), added exactly. A text is cut into units, each a run of spaces with
what follows up to the next space: no piece has a space behind another character, so segmentations of units are
independent. White space is kept, and one space is put before the text.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
UNIT = re.compile(rb" +[^ ]*")
LOST = np.int64(-(1 << 62))
#: Cells of one Viterbi table.
CELLS = 1 << 21
#: Bytes from which a unit is walked by itself: the tables of a step pay for many units of a like length only.
LONG = 1 << 10


@dataclass(eq=False)
class Vocabulary:
    """Pieces that text can match (id, bytes, score), the ids of the 256 byte pieces and the score of an unknown character."""

    ids: list[int]
    pieces: list[bytes]
    scores: list[int]
    byte_ids: list[int]
    unknown: int
    tables: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [int(model.get_score(i)) for i in known]
        return cls(known, [model.id_to_piece(i).encode() for i in known], scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], min(scores) - 10)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("ids", "pieces", "scores", "byte_ids", "unknown")} | {"tables": {}}

    @cached_property
    def surface(self) -> dict[int, bytes]:
        """The bytes that an id stands for, spaces as spaces."""
        return {i: p.replace(MARK, b" ") for i, p in zip(self.ids, self.pieces)} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """The automaton's longest and shorter pieces and the piece lengths, for walks by single steps."""
        _, longest, shorter, lengths = self.automaton
        return longest.tolist(), shorter.tolist(), lengths.tolist()

    @cached_property
    def automaton(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(next state by state and byte, longest piece that ends in a state, next shorter such piece, piece lengths)."""
        children: list[dict[int, int]] = [{}]
        piece_at: dict[int, int] = {}
        for k, piece in enumerate(self.pieces):
            state = 0
            for b in piece:
                if b not in children[state]:
                    children[state][b] = len(children)
                    children.append({})
                state = children[state][b]
            piece_at[state] = k
        n = len(children)
        step = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        longest = np.full(n, -1, np.int32)
        shorter = np.full(len(self.pieces), -1, np.int32)
        queue = [0]
        for state in queue:
            if state:
                step[state] = step[fail[state]]
                longest[state] = longest[fail[state]]
                if state in piece_at:
                    shorter[piece_at[state]] = longest[state]
                    longest[state] = piece_at[state]
            for b, child in children[state].items():
                fail[child] = step[state, b] if state else 0
                step[state, b] = child
                queue.append(child)
        return step, longest, shorter, np.array([len(p) for p in self.pieces], np.int64)


def split_units(text: bytes) -> list[bytes]:
    """Units of a text without the space before each; an empty text has none."""
    if not text:
        return []
    if b"  " not in text and text[:1] != b" ":
        return text.split(b" ")
    return [u[1:] for u in UNIT.findall(b" " + text)]


def marked(unit: bytes) -> bytes:
    return MARK + unit.replace(b" ", MARK)


def code_units(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct marked units, code of each unit of the texts, units of each text)."""
    lists = [split_units(x) for x in texts]
    coded = pa.array([u for own in lists for u in own], pa.binary()).dictionary_encode()
    return [marked(u) for u in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64), np.array([len(x) for x in lists], np.int64)


@dataclass
class Best:
    """Per unit: score and number of pieces of the best segmentation; with alternatives also its ids and the loss of the second best."""

    score: np.ndarray
    count: np.ndarray
    loss: np.ndarray | None = None
    ids: list[np.ndarray] | None = None


def viterbi(units: list[bytes], vocabulary: Vocabulary, ids: bool = False) -> Best:
    """Best segmentation of every unit. Of equal scores the one whose last piece is longest wins, at every place.

    Units are handled by length, many at a time: the automaton moves one byte in all of them, then the pieces that end
    there are tried, the longest first, and replace what is held only if they score higher; an unknown character, one
    without a piece of its own, comes last and counts one byte piece per byte. Units of ``LONG`` bytes or more (texts
    without spaces, runs of blanks) are walked one by one, in time and memory linear in their length.
    """
    n = len(units)
    score, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    loss = np.full(n, -LOST) if ids else None
    found: list = [None] * n
    sizes = np.fromiter(map(len, units), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    at = int((sizes >= LONG).sum())
    for i in order[:at].tolist():
        own = Walk.over(units[i], vocabulary)
        score[i], count[i] = own.best[-1], own.count[-1]
        if ids:
            loss[i] = own.best[-1] - own.second[-1] if own.second[-1] > LOST // 2 else -LOST
            found[i] = np.array(own.ids(vocabulary), np.int32)
    while at < n:
        width = int(sizes[order[at]])
        rows = order[at : at + max(1, CELLS // (width + 1))]
        at += len(rows)
        part = _viterbi([units[i] for i in rows], sizes[rows], vocabulary, ids)
        score[rows], count[rows] = part.score, part.count
        if ids:
            loss[rows] = part.loss
            for i, x in zip(rows.tolist(), part.ids):
                found[i] = x
    return Best(score, count, loss, found if ids else None)


def _viterbi(units: list[bytes], sizes: np.ndarray, vocabulary: Vocabulary, ids: bool) -> Best:
    step, longest, shorter, lengths = vocabulary.automaton
    values = vocabulary.tables.setdefault("values", np.array(vocabulary.scores, np.int64))
    n, width = len(units), int(sizes[0])
    text = np.zeros((n, width), np.uint8)
    flat = np.frombuffer(b"".join(units), np.uint8)
    text[np.arange(width)[None, :] < sizes[:, None]] = flat
    best = np.full((n, width + 1), LOST)
    best[:, 0] = 0
    count = np.zeros((n, width + 1), np.int32)
    last = np.full((n, width + 1), -1, np.int32) if ids else None
    second = np.full((n, width + 1), LOST) if ids else None
    state = np.zeros(n, np.int32)
    begin = np.zeros(n, np.int64)  # of the character at hand

    def offer(rows: np.ndarray, start: np.ndarray, t: int, worth: np.ndarray, more: np.ndarray, piece: np.ndarray) -> None:
        new, old = best[rows, start] + worth, best[rows, t]
        better = new > old
        if ids:
            runner = np.where(better, np.maximum(old, second[rows, start] + worth), new)
            second[rows, t] = np.maximum(second[rows, t], np.maximum(runner, LOST))
        r = rows[better]
        best[r, t] = new[better]
        count[r, t] = count[r, start[better]] + more[better]
        if ids:
            last[r, t] = piece[better]

    for t in range(1, width + 1):
        live = int(np.searchsorted(-sizes, -t, side="right"))
        byte = text[:live, t - 1]
        fresh = (byte & 0xC0) != 0x80
        begin[:live][fresh] = t - 1
        state[:live] = step[state[:live], byte]
        piece = longest[state[:live]]
        rows = np.flatnonzero(piece >= 0)
        piece = piece[rows]
        whole = np.zeros(live, bool)
        while len(rows):
            size = lengths[piece]
            whole[rows] |= size == t - begin[rows]
            offer(rows, t - size, t, values[piece], np.ones(len(rows), np.int32), piece)
            piece = shorter[piece]
            rows, piece = rows[piece >= 0], piece[piece >= 0]
        ends = np.ones(live, bool)
        inner = sizes[:live] > t
        ends[inner] = (text[:live][inner, t] & 0xC0) != 0x80 if t < width else True
        rows = np.flatnonzero(ends & ~whole)
        if len(rows):
            start = begin[rows]
            offer(rows, start, t, np.full(len(rows), vocabulary.unknown), (t - start).astype(np.int32), np.full(len(rows), -1))
    every = np.arange(n)
    out = Best(best[every, sizes], count[every, sizes])
    if ids:
        runner = second[every, sizes]
        out.loss = np.where(runner > LOST // 2, out.score - runner, -LOST)
        out.ids = _trace(units, sizes, last, vocabulary, out.count)
    return out


def _trace(units: list[bytes], sizes: np.ndarray, last: np.ndarray, vocabulary: Vocabulary, count: np.ndarray) -> list[np.ndarray]:
    """Ids of the best segmentations, from the last piece back."""
    _, _, _, lengths = vocabulary.automaton
    names = vocabulary.tables.setdefault("ids", np.array(vocabulary.ids, np.int32))
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    cursor, place = ends.copy(), sizes.copy()
    rows = np.flatnonzero(place > 0)
    while len(rows):
        piece = last[rows, place[rows]]
        known = piece >= 0
        k = rows[known]
        cursor[k] -= 1
        out[cursor[k]] = names[piece[known]]
        place[k] -= lengths[piece[known]]
        for r in rows[~known].tolist():
            end = int(place[r])
            start = end - 1
            while units[r][start] & 0xC0 == 0x80:
                start -= 1
            for b in reversed(units[r][start:end]):
                cursor[r] -= 1
                out[cursor[r]] = vocabulary.byte_ids[b]
            place[r] = start
        rows = rows[place[rows] > 0]
    return np.split(out, ends[:-1]) if len(ends) else []


@dataclass
class Walk:
    """One unit walked byte by byte: per place the automaton's state, the first byte of the character that ends there (-1
    inside a character), the best and second best score from the start, and pieces and last piece of the best."""

    unit: bytes
    state: array
    begin: array
    best: array
    second: array
    count: array
    last: array

    @classmethod
    def over(cls, unit: bytes, vocabulary: Vocabulary) -> Walk:
        step = vocabulary.automaton[0]
        longest, shorter, lengths = vocabulary.lists
        scores, unknown, lost = vocabulary.scores, vocabulary.unknown, int(LOST)
        n = len(unit)
        state, begin, count, last = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best, second = array("q", [lost]) * (n + 1), array("q", [lost]) * (n + 1)
        best[0] = 0
        at = first = 0
        for t in range(1, n + 1):
            b = unit[t - 1]
            if b & 0xC0 != 0x80:
                first = t - 1
            at = step.item(at, b)
            state[t] = at
            high, low, pieces, name, whole = lost, lost, 0, -1, False
            piece = longest[at]
            while piece >= 0:
                start = t - lengths[piece]
                whole |= start == first
                new = best[start] + scores[piece]
                if new > high:
                    low, high, pieces, name = max(low, high, second[start] + scores[piece]), new, count[start] + 1, piece
                elif new > low:
                    low = new
                piece = shorter[piece]
            if t == n or unit[t] & 0xC0 != 0x80:
                begin[t] = first
                if not whole:
                    new = best[first] + unknown
                    if new > high:
                        low, high, pieces, name = max(low, high, second[first] + unknown), new, count[first] + t - first, -1
                    elif new > low:
                        low = new
            best[t], second[t], count[t], last[t] = high, low, pieces, name
        return cls(unit, state, begin, best, second, count, last)

    def edges(self, place: int, vocabulary: Vocabulary) -> list[tuple[int, int, int]]:
        """What ends at a place: (start, score, piece or -1), the longest piece first."""
        longest, shorter, lengths = vocabulary.lists
        out, whole = [], False
        piece = longest[self.state[place]] if place else -1
        while piece >= 0:
            start = place - lengths[piece]
            whole |= start == self.begin[place]
            out.append((start, vocabulary.scores[piece], piece))
            piece = shorter[piece]
        if place and not whole and self.begin[place] >= 0:
            out.append((self.begin[place], vocabulary.unknown, -1))
        return out

    def ids(self, vocabulary: Vocabulary) -> list[int]:
        out, place = [], len(self.unit)
        lengths = vocabulary.lists[2]
        while place:
            piece = self.last[place]
            start = place - lengths[piece] if piece >= 0 else self.begin[place]
            out += [vocabulary.ids[piece]] if piece >= 0 else [vocabulary.byte_ids[b] for b in reversed(self.unit[start:place])]
            place = start
        return out[::-1]


def lattice(unit: bytes, vocabulary: Vocabulary) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Per place the edges that end there (start, score, piece or -1), and the best score from the start to the place."""
    walk = Walk.over(unit, vocabulary)
    return [walk.edges(t, vocabulary) for t in range(len(unit) + 1)], walk.best.tolist()


def nbest(unit: bytes, vocabulary: Vocabulary, n: int) -> list[tuple[int, list[int]]]:
    """The ``n`` best segmentations (score, ids), best first; the first is the one that ``viterbi`` finds.

    A-star from the end of the unit: the forward Viterbi score of a place is exactly what the rest can still bring, so
    hypotheses leave the queue in the order of their final score. Equal ones leave nearest to the start first, so ties
    are walked to their end one after another, and only the first ``n`` that reach a place go on from it: what reaches
    it later can't be among the ``n`` best. The queue grows with ``n`` times the edges at most.
    """
    walk = Walk.over(unit, vocabulary)
    best = walk.best
    queue: list[tuple[int, int, int, int, tuple]] = [(-best[-1], len(unit), 0, 0, ())]
    used: dict[int, int] = {}
    pushed, out = 1, []
    while queue and len(out) < n:
        minus, place, _, worth, chain = heapq.heappop(queue)
        if place == 0:
            out.append((-minus, _ids(chain, vocabulary)))
            continue
        used[place] = used.get(place, 0) + 1
        if used[place] > n:
            continue
        for start, score, piece in walk.edges(place, vocabulary):
            if best[start] > LOST // 2:
                step = (unit[start:place], piece)
                heapq.heappush(queue, (-(worth + score + best[start]), start, -pushed, worth + score, (step, chain)))
                pushed += 1
    first = (int(best[-1]), walk.ids(vocabulary))
    return [first, *[x for x in out if x != first]][:n]


def _ids(chain: tuple, vocabulary: Vocabulary) -> list[int]:
    out = []
    while chain:
        (surface, piece), chain = chain
        out += [vocabulary.ids[piece]] if piece >= 0 else [vocabulary.byte_ids[b] for b in surface]
    return out
