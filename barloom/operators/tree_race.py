"""A race of boosted trees whose models are grown together.

A model per label, setting and fold is some hundred passes over the panel when each is a fit of its own. Here every level of
every model reads the same stored table of feature codes once: tasks count rows and add up targets per (model, node,
feature, code), Spark brings the parts of a model together, and tasks choose the best split of each node from the sums. Only
the splits reach the driver. The trees are those of ``GBTClassifier`` (variance gain, log loss, the first tree with weight 1,
later ones with ``step``, early stopping on the validation block, missing values filled with the mean of the rows seen), except
that split points come from the counts of all rows instead of a sample of 10,000, and that a share of the features is drawn
once for a tree and not for every node. A model whose validation error has stopped falling leaves the passes; the model of all
rows gets a round more as soon as its folds are sure to ask for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.model import SquaredLogit, TreeParams, date_folds, final_rounds
from barloom.operators.stats import average_precision_of_counts, precision_at_k
from barloom.session import stored

#: Rows a task holds at a time, and rows of them worked on at a time.
CHUNK, BLOCK = 1 << 20, 1 << 15
#: Leaf values are rounded, so that equal means stay equal whatever the order of their rows.
DIGITS = 12
#: As in Spark ML: thresholds per feature, and how much a further round must lower the validation error.
SPLITS, TOLERANCE = 31, 0.001
#: A gain below this is rounding.
LEAST_GAIN = 1e-12
#: Levels whose nodes fit the bits of a word, and bytes of a batch on its way to the shuffle.
WORD_LEVELS, BATCH_BYTES = 6, 1 << 22


@dataclass(frozen=True)
class Line:
    """Models that share a round's tree: the label's index, the block validated (the number of blocks: none, all rows are
    learnt), what the setting says of a tree, and the step from the third round on (the first two don't depend on it)."""

    label: int
    block: int
    depth: int
    min_rows: int
    features: tuple[int, ...]
    step: float | None = None


class Tree:
    """A complete binary tree over feature codes.

    A row's node is the one bit that is set in the words of all its codes: the word of a (feature, code) has the nodes that it
    doesn't rule out. Levels below the first six ask node by node.
    """

    def __init__(self, n_features: int, width: int) -> None:
        self.values, self.alive = np.zeros(1), np.ones(1, bool)
        self.allowed = np.ones((n_features, width, 1), bool)
        self.words: list[tuple[int, np.ndarray]] = []
        self.deeper: list[tuple[np.ndarray, np.ndarray]] = []

    def __getstate__(self) -> dict:
        return {"values": self.values, "words": self.words, "deeper": self.deeper}

    def places(self, codes: np.ndarray) -> np.ndarray:
        if self.words:
            open_ = reduce(np.bitwise_and, [word[codes[f]] for f, word in self.words])
            place = (open_.astype(np.float64).view(np.int64) >> 52) - 1023  # the exponent: which bit is set
        else:
            place = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1]) if self.deeper else None
        for feature, right in self.deeper:
            place = 2 * place + right.ravel()[place * right.shape[1] + codes[feature[place], rows]]
        return place

    def grow(self, bins: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """The next level: the splits chosen for ``node`` (``feature`` -1: none), all rows of other nodes go left."""
        nodes, width = len(self.values), bins.shape[1]
        asked, goes, self.values = np.zeros(nodes, np.int64), np.zeros((nodes, width), bool), np.repeat(self.values, 2)
        self.values[2 * node], self.values[2 * node + 1] = np.round(left, DIGITS), np.round(right, DIGITS)
        split = feature >= 0
        node, feature = node[split], feature[split]
        asked[node], goes[node] = feature, bins[feature] > cut[split, None]
        self.alive = np.zeros(2 * nodes, bool)
        self.alive[2 * node] = self.alive[2 * node + 1] = True
        if 2 * nodes > 1 << WORD_LEVELS:
            self.deeper.append((asked, goes.astype(np.int64)))
            return
        self.allowed = np.repeat(self.allowed, 2, axis=2)
        f, code, p = asked[:, None], np.arange(width)[None, :], np.arange(nodes)[:, None]
        self.allowed[f, code, 2 * p] &= ~goes
        self.allowed[f, code, 2 * p + 1] &= goes
        bits = np.zeros((*self.allowed.shape[:2], 64), bool)
        bits[:, :, : 2 * nodes] = self.allowed
        words = np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)[:, :, 0]
        self.words = [(f, words[f]) for f in range(len(words)) if not self.allowed[f].all()]

    def close(self) -> None:
        self.allowed = self.alive = None


def margin(trees: Sequence[Tree], step: float, codes: np.ndarray) -> np.ndarray:
    """The first tree's value and ``step`` times those of later ones, added up in order."""
    total = trees[0].values[trees[0].places(codes)]
    for tree in trees[1:]:
        total = total + step * tree.values[tree.places(codes)]
    return total


def chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 - 1.0 / (1.0 + np.exp(2.0 * margin))


def drawn(n: int, setting: TreeParams, m: int) -> tuple[int, ...]:
    """The features that round ``m`` may ask: as in LightGBM the draws follow the seed alone, so all fits make the same ones."""
    if setting.share >= 1.0:
        return tuple(range(n))
    order = np.random.default_rng([setting.seed, m]).permutation(n)
    return tuple(sorted(int(f) for f in order[: max(1, round(setting.share * n))]))


class CodeTable:
    """The stored table of codes: features (``width`` - 1: missing), labels and blocks (-1: label unknown)."""

    def __init__(self, table: DataFrame, n_features: int, n_labels: int, width: int) -> None:
        self.table, self.n_features, self.n_labels, self.width = table, n_features, n_labels, width

    def cells(self, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the table over ``size`` cells. ``add(codes, y, blocks, n, s)`` adds a chunk of rows to the task's own."""
        nf, nl = self.n_features, self.n_labels

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(size, np.int64), np.zeros(size)
            for rows in chunks(batches):
                add(rows[:nf], rows[nf : nf + nl], rows[nf + nl :], n, s)
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(s[hit])], ["cell", "n", "s"])

        parts = self.table.mapInArrow(partial, "cell long, n long, s double").withColumn("part", F.spark_partition_id())
        # One row per cell, whatever the number of rows; added up in the order of the parts, so that reruns agree.
        added = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "s"))), F.lit(0.0), lambda total, one: total + one["s"])
        sums = parts.groupBy("cell").agg(F.sum("n").alias("n"), added.alias("s")).toArrow()
        n, s = np.zeros(size, np.int64), np.zeros(size)
        at = sums["cell"].to_numpy()
        n[at], s[at] = sums["n"].to_numpy(), sums["s"].to_numpy()
        return n, s


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Batches of byte columns as matrices (column, row) of about ``CHUNK`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield np.concatenate(held, axis=1)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held, axis=1)


def code_columns(features: Sequence[str], width: int) -> list:
    return [F.coalesce(F.col(f).cast("byte"), F.lit(width - 1).cast("byte")).alias(f"_f{i}") for i, f in enumerate(features)]


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Split points between the distinct ``values``: all, or if too many those nearest to equal shares of the rows."""
    middle = (values[:-1] + values[1:]) / 2.0
    room = min(SPLITS, int(counts.sum()) - 1)
    if len(middle) <= room:
        return middle
    stride = counts.sum() / (room + 1)
    picked, target = [], stride
    for i, reached in enumerate(np.cumsum(counts)[:-1]):
        if abs(reached - target) < abs(reached + counts[i + 1] - target):
            picked.append(middle[i])
            target += stride
    return np.array(picked)


def bins_of(learnt: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each code's bin from its counts among the rows learnt and seen (with the validation block); the last code is missing
    and stands at the mean of the rows seen."""
    if not seen[:-1].sum():  # no row of the fold knows the feature: it is never asked
        return np.zeros(len(seen), np.int64)
    known = np.arange(len(seen) - 1, dtype=float)
    at = np.append(known, (known * seen[:-1]).sum() / seen[:-1].sum())
    values, group = np.unique(at, return_inverse=True)
    counts = np.bincount(group, weights=learnt)
    return np.searchsorted(thresholds(values[counts > 0], counts[counts > 0]), at, side="left")


def ordered(rows: np.ndarray, nf: int, nl: int, i: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and signs of the rows that know label ``i``, by block, and where blocks 0, 1, ... start."""
    block = rows[nf + nl + i]
    order = np.argsort(block, kind="stable")
    order = order[np.searchsorted(block[order], 0) :]
    return rows[:nf, order].astype(np.intp), 2.0 * rows[nf + i, order] - 1.0, np.searchsorted(block[order], np.arange(blocks + 1))


def blocks_of(first: int, last: int) -> Iterator[slice]:
    for a in range(first, last, BLOCK):
        yield slice(a, min(a + BLOCK, last))


def best_splits(n: np.ndarray, s: np.ndarray, put: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """Per node the place of the feature (-1: none) and the bin after which codes go right, of highest gain in variance, and the
    mean targets on both sides; of equal ones the first feature and point. From counts and sums per (node, feature, code);
    ``put`` (feature, code, bin) is 1 where a code belongs to a bin."""
    total, whole = n[:, 0].sum(axis=1).astype(float), s[:, 0].sum(axis=1)
    ln, ls = (np.cumsum(np.matmul(x.transpose(1, 0, 2).astype(float), put).transpose(1, 0, 2), axis=2)[:, :, :-1] for x in (n, s))
    rn, rs = total[:, None, None] - ln, whole[:, None, None] - ls
    ok = (ln >= max(min_rows, 1)) & (rn >= max(min_rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (ls**2 / ln + rs**2 / rn - (whole**2 / total)[:, None, None]) / total[:, None, None]
    gain = np.where(ok, gain, -np.inf).reshape(len(n), -1)
    j, at = gain.argmax(axis=1), np.arange(len(n))
    split, (feature, cut) = gain[at, j] > LEAST_GAIN, np.divmod(j, ln.shape[2])
    mean = whole / total
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = (np.where(split, (a / b)[at, feature, cut], mean) for a, b in ((ls, ln), (rs, rn)))
    return np.where(split, feature, -1), cut, left, right


def grow_level(table: CodeTable, lines: Sequence[tuple[Line, list[Tree], Tree]], level: int, bins: dict[tuple[int, int], np.ndarray], blocks: int) -> None:
    """One pass over the table for the next level of every line's tree. ``lines``: the line, the trees before, the tree."""
    nf, nl, width, nodes = table.n_features, table.n_labels, table.width, 1 << level
    of_label = {i: [(j, *one) for j, one in enumerate(lines) if one[0].label == i] for i in range(nl)}
    alive = [np.flatnonzero(tree.alive) for _, _, tree in lines]
    asked = [(line.label, line.block, line.features, line.min_rows) for line, _, _ in lines]

    def sums(line: Line, before: list[Tree], tree: Tree, codes: np.ndarray, sign: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        n, s = np.zeros((nodes, len(line.features), width), np.int64), np.zeros((nodes, len(line.features), width))
        for cut in blocks_of(0, rows):
            part, target = codes[:, cut], sign[cut]
            if before:
                target = 4.0 * target / (1.0 + np.exp(2.0 * target * margin(before, line.step or 0.0, part)))
            base = tree.places(part) * width
            for q, f in enumerate(line.features):
                cell = base + part[f]
                n[:, q] += np.bincount(cell, minlength=nodes * width).reshape(nodes, width)
                s[:, q] += np.bincount(cell, weights=target, minlength=nodes * width).reshape(nodes, width)
        return n, s

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, rows in enumerate(chunks(batches)):
            held, size = [], 0
            for i, mine in of_label.items():
                if not mine:
                    continue
                codes, sign, starts = ordered(rows, nf, nl, i, blocks)
                for j, line, before, tree in mine:
                    known = int(starts[line.block])
                    if not known:
                        continue
                    n, s = sums(line, before, tree, codes, sign, known)
                    hit = alive[j][n[alive[j], 0].any(axis=1)]
                    if not len(hit):
                        continue
                    held.append((np.full(len(hit), j), hit, n[hit].astype(np.int32), s[hit]))
                    size += held[-1][2].nbytes + held[-1][3].nbytes
                    if size > BATCH_BYTES:
                        yield packed(held, slab)
                        held, size = [], 0
            if held:
                yield packed(held, slab)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches hold the parts by line, node and part; a line that may go on in the next batch is held back."""
        held, puts = None, {key: (one[:, :, None] == np.arange(SPLITS + 1)).astype(float) for key, one in bins.items()}
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            line = held.column(0).to_numpy()
            last = int(np.searchsorted(line, line[-1]))
            if last:
                yield chosen(held.slice(0, last), puts)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield chosen(held, puts)

    def chosen(batch: pa.RecordBatch, puts: dict) -> pa.RecordBatch:
        line, node = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 1))
        out = []
        for rows in np.split(np.arange(len(line)), np.flatnonzero(np.diff(line)) + 1):
            a, b = rows[0], rows[-1] + 1
            label, block, features, min_rows = asked[line[a]]
            first = np.flatnonzero(np.diff(node[a:b], prepend=-1))
            n, s = (
                np.add.reduceat(payload(batch.column(c), a, b, kind).reshape(b - a, len(features), width), first, axis=0)
                for c, kind in ((4, np.int32), (5, np.float64))
            )
            place, cut, left, right = best_splits(n, s, puts[label, block][list(features)], min_rows)
            out.append((np.full(len(first), line[a]), node[a:b][first], np.where(place < 0, -1, np.array(features)[place]), cut, left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["line", "node", "feature", "cut", "left", "right"])

    parts = table.table.mapInArrow(partial, "line int, node int, slab int, n binary, s binary")
    parts = parts.select("line", "node", F.spark_partition_id().alias("part"), "slab", "n", "s")
    # Parts are added up in their order, so that reruns agree.
    together = parts.repartition("line").sortWithinPartitions("line", "node", "part", "slab")
    found = together.mapInArrow(choose, "line long, node long, feature long, cut long, left double, right double").toArrow()
    columns = [found[c].to_numpy() for c in ("line", "node", "feature", "cut", "left", "right")]
    order = np.lexsort((columns[1], columns[0]))
    line, *rest = (c[order] for c in columns)
    starts = np.searchsorted(line, np.arange(len(lines) + 1))
    for j, (of, _, tree) in enumerate(lines):
        tree.grow(bins[of.label, of.block], *[c[starts[j] : starts[j + 1]] for c in rest])


def packed(held: list, slab: int) -> pa.RecordBatch:
    """Counts and sums of nodes as bytes, one row per (line, node)."""

    def binary(parts: list[np.ndarray]) -> pa.Array:
        sizes = np.concatenate([np.full(len(p), p[0].nbytes) for p in parts])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(p.tobytes() for p in parts))])

    line, node, n, s = zip(*held)
    line, node = np.concatenate(line).astype(np.int32), np.concatenate(node).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(line), pa.array(node), pa.array(np.full(len(line), slab, np.int32)), binary(n), binary(s)], ["line", "node", "slab", "n", "s"])


def payload(column: pa.Array, a: int, b: int, kind: type) -> np.ndarray:
    """The numbers in rows ``a`` to ``b`` of a column of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset + a : column.offset + b + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)


Fits = dict[tuple[int, int], list[Tree]]


def grown(table: CodeTable, candidates: Sequence[tuple[int, TreeParams]], n_splits: int) -> Fits:
    """The trees kept of every candidate (label, setting) by (candidate, block): blocks 1.. are validated, the last fit has all
    rows and as many rounds as its folds kept on average."""
    nf, width, labels, blocks = table.n_features, table.width, table.n_labels, n_splits + 1

    def count_codes(codes, y, block, n, s):
        for i in range(labels):
            at = block[i] >= 0
            base = (i * blocks + block[i][at].astype(np.int64)) * nf * width
            for f in range(nf):
                n += np.bincount(base + f * width + codes[f][at], minlength=len(n))

    counts = table.cells(count_codes, labels * blocks * nf * width)[0].reshape(labels, blocks, nf, width).cumsum(axis=1)
    bins = {}
    for i in range(labels):
        for k in range(1, blocks + 1):
            learnt, seen = counts[i, k - 1], counts[i, min(k, blocks - 1)]
            bins[i, k] = np.stack([bins_of(learnt[f], seen[f]) for f in range(nf)])

    fits: Fits = {(c, k): [] for c in range(len(candidates)) for k in range(1, blocks + 1)}
    errors: dict[tuple[int, int], list[float]] = {of: [] for of in fits if of[1] < blocks}
    active, early = set(errors), {}

    def kept(c: int) -> list[int]:
        return [stopped(errors[c, k]) for k in range(1, blocks)]

    def wanted() -> list[tuple[int, int]]:
        # What folds keep only grows, so the rounds of the last fit can be grown before the folds have ended.
        sure = [(c, blocks) for c in range(len(candidates)) if len(fits[c, blocks]) < (final_rounds(kept(c)) if errors[c, 1] else 1)]
        return [*sorted(active), *sure]

    while now := wanted():
        todo: dict[tuple, tuple[list[Tree], Tree]] = {}
        at = {}
        for c, k in now:
            (i, p), m = candidates[c], len(fits[c, k]) + 1
            line = Line(i, k, p.depth, p.min_rows, drawn(nf, p, m), p.step if m > 2 else None)
            at[c, k] = key = line, m, p.share, p.seed if p.share < 1.0 else None
            if key not in early and key not in todo:
                todo[key] = list(fits[c, k]), Tree(nf, width)
        for level in range(max((key[0].depth for key in todo), default=0)):
            open_ = [(key[0], *pair) for key, pair in todo.items() if level < key[0].depth and pair[1].alive.any()]
            if open_:
                grow_level(table, open_, level, bins, blocks)
        for tree in (pair[1] for pair in todo.values()):
            tree.close()
        early.update({key: pair[1] for key, pair in todo.items() if key[0].step is None})
        for of, key in at.items():
            fits[of].append(early[key] if key in early else todo[key][1])
        validate(table, candidates, fits, sorted(active), errors, blocks)
        active -= {of for of in active if len(fits[of]) >= candidates[of[0]][1].max_rounds or ended(errors[of])}
    return {(c, k): trees[: stopped(errors[c, k])] if k < blocks else trees for (c, k), trees in fits.items()}


def validate(table: CodeTable, candidates: Sequence[tuple[int, TreeParams]], fits: Fits, active: Sequence[tuple[int, int]], errors: dict, blocks: int) -> None:
    """Append the validation error of all trees so far of the ``active`` fits."""
    if not active:
        return
    models = [(candidates[c][0], k, candidates[c][1].step, fits[c, k]) for c, k in active]
    nf, nl = table.n_features, table.n_labels
    def add(codes, y, block, n, s):
        rows = np.concatenate([codes, y, block])
        for i in sorted({model[0] for model in models}):
            known, sign, starts = ordered(rows, nf, nl, i, blocks)
            for j, (label, k, step, trees) in enumerate(models):
                if label == i:
                    n[j] += starts[k + 1] - starts[k]
                    for cut in blocks_of(int(starts[k]), int(starts[k + 1])):
                        s[j] += (2.0 * np.logaddexp(0.0, -2.0 * sign[cut] * margin(trees, step, known[:, cut]))).sum()

    n, s = table.cells(add, len(models))
    found = np.divide(s, n, out=np.full(s.shape, np.nan), where=n > 0)  # a block without rows keeps the first round
    for of, error in zip(active, found):
        errors[of].append(float(error))


def ended(errors: Sequence[float]) -> bool:
    """Whether the last round lowered the validation error too little."""
    return len(errors) > 1 and not min(errors[:-1]) - errors[-1] >= TOLERANCE * max(errors[-1], 0.01)


def stopped(errors: Sequence[float]) -> int:
    best, kept = errors[0], 1
    for m, error in enumerate(errors[1:], 2):
        if best - error < TOLERANCE * max(error, 0.01):
            break
        if error < best:
            best, kept = error, m
    return kept


def score_margins(rows: np.ndarray, n_features: int, candidates: Sequence[tuple[int, TreeParams]], fits: Fits, blocks: int, folds: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(candidate, rows that know its label, their margins): of the models that validate their block (``folds``; none in block
    0), or of the last fits. Below codes and labels (-1: unknown) the matrix has the blocks."""
    nl = (len(rows) - n_features) // (2 if folds else 1)
    codes = rows[:n_features].astype(np.intp)
    for i in range(nl):
        label = rows[n_features + i]
        known = (label >= 0) & (rows[n_features + nl + i] > 0) if folds else label >= 0
        at = np.flatnonzero(known)
        if not len(at):
            continue
        if folds:  # by block, so that a model's rows are a slice
            block = rows[n_features + nl + i, at]
            order = np.argsort(block, kind="stable")
            starts, back = np.searchsorted(block[order], np.arange(1, blocks + 1)), np.argsort(order, kind="stable")
            cuts = [(k, starts[k - 1], starts[k]) for k in range(1, blocks)]
            mine = codes[:, at[order]]
        else:
            cuts, mine, back = [(blocks, 0, len(at))], codes[:, at], slice(None)
        for c, (of, p) in enumerate(candidates):
            if of == i:
                out = np.empty(len(at))
                for k, a, b in cuts:
                    for cut in blocks_of(int(a), int(b)):
                        out[cut] = margin(fits[c, k], p.step, mine[:, cut])
                yield c, at, out[back]


def matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns])


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``CHUNK`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def counted_margins(df: DataFrame, names: Sequence[str], score: Callable) -> DataFrame:
    """Rows per candidate, segment and margin, and the positive ones of them. Tasks count their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            seg = slab.column(0).dictionary_encode()
            which, rows = seg.indices.to_numpy(), matrix(slab.columns[1:])
            for g, name in enumerate(seg.dictionary.to_pylist()):
                part = rows[:, which == g]
                for c, at, found in score(part):
                    value, group = np.unique(found, return_inverse=True)
                    hits = np.bincount(group, weights=part[label_row(c), at] == 1, minlength=len(value)).astype(np.int64)
                    n = np.bincount(group, minlength=len(value))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), c, np.int32)), pa.repeat(pa.scalar(name, pa.string()), len(value)), pa.array(value), pa.array(n.astype(np.int64)), pa.array(hits)], ["c", "seg", "margin", "n", "pos"]
                    )

    label_row = score.label_row
    parts = df.select("seg", *names).mapInArrow(run, "c int, seg string, margin double, n long, pos long")
    return parts.groupBy("c", "seg", "margin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def task_tops(df: DataFrame, names: Sequence[str], score: Callable, calibrators: Sequence[SquaredLogit], tie: Sequence[str], k: int) -> DataFrame:
    """The ``k`` best rows of every task, day, segment and candidate by calibrated score, ties by ``tie``: all that can be among
    the best of all tasks."""
    keep = ["seg", "d", *tie]
    label_row = score.label_row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            seg, rows = slab.column(0).dictionary_encode(), matrix(slab.columns[len(keep) :])
            day = slab.column(1).dictionary_encode().indices.to_numpy().astype(np.int64) * len(seg.dictionary) + seg.indices.to_numpy()
            for c, at, found in score(rows):
                prob = calibrators[c].of(chance(found))
                order = np.argsort(-prob, kind="stable")  # rows come sorted by ``tie``
                order = order[np.argsort(day[at[order]], kind="stable")]
                group = day[at[order]]
                first = np.searchsorted(group, group)
                order = order[np.arange(len(order)) - first < k]
                picked = slab.select(keep).take(pa.array(at[order]))
                y = rows[label_row(c), at[order]].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), c, np.int32)), *picked.columns, pa.array(prob[order]), pa.array(y)], ["c", *keep, "prob", "y"])

    read = df.select(*keep, *names).sortWithinPartitions(*tie)
    kinds = ", ".join(["c int", *[f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keep)]], "prob double", "y double"])
    return read.mapInArrow(run, kinds)


class Scores:
    """Margins of a frame's rows by candidate; what tasks need, nothing of the frame."""

    def __init__(self, n_features: int, candidates: Sequence[tuple[int, TreeParams]], fits: Fits, blocks: int, folds: bool) -> None:
        self.n_features, self.candidates, self.blocks, self.folds = n_features, candidates, blocks, folds
        self.fits = {of: trees for of, trees in fits.items() if (of[1] < blocks) == folds}

    def __call__(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return score_margins(rows, self.n_features, self.candidates, self.fits, self.blocks, self.folds)

    def label_row(self, c: int) -> int:
        return self.n_features + self.candidates[c][0]


def race_on_codes(
    train: DataFrame, val: DataFrame, features: Sequence[str], labels: Sequence[str], grid: Sequence[TreeParams], n_splits: int, tie: Sequence[str], bins: int = 32, k: int = 5,
    segments: Sequence[str] | None = None,
) -> DataFrame:
    """What ``race`` returns, for features that are codes from 0 to ``bins`` or NULL (``shared_bins``). Models are grown
    together, so the passes over the rows follow depth and rounds, not the number of labels, settings and folds.

    A seed has an effect only where a share of the features is drawn. ``segments``: those whose metrics are wanted (all).
    """
    width, nf, spark = bins + 2, len(features), train.sparkSession
    if width > 128 or n_splits > 126:
        raise ValueError("codes and blocks are kept as bytes")
    codes = code_columns(features, width)
    bad = [F.max((F.col(f) < 0) | (F.col(f) > bins) | (F.col(f) != F.floor(f))).alias(f) for f in features]
    if any(train.unionByName(val, allowMissingColumns=True).agg(*bad).first()):
        raise ValueError(f"features are codes from 0 to {bins}")
    # One row per calendar day and label.
    days = stored(train.groupBy("d").agg(*[F.count(y).alias(y) for y in labels]), "race-days")
    placed = days.select("d")
    for i, y in enumerate(labels):
        placed = placed.join(F.broadcast(date_folds(days.where(F.col(y) > 0).select("d"), n_splits, out=f"_b{i}")), "d", "left")
    placed = stored(placed, "race-blocks")

    def coded(df: DataFrame, known: Sequence, blocks: Sequence = ()) -> DataFrame:
        # As many parts as there are cores, and no part of more than a chunk of rows.
        parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // CHUNK))
        y = [F.coalesce(y, F.lit(-1)).cast("byte").alias(f"_y{i}") for i, y in enumerate(known)]
        return stored(df.select(*tie, "d", "seg", *codes, *y, *blocks).repartition(parts, *tie, "d"), "race-codes")

    block = [F.when(F.col(y).isNotNull(), F.col(f"_b{i}")).otherwise(-1).cast("byte").alias(f"_b{i}") for i, y in enumerate(labels)]
    folded = coded(train.join(F.broadcast(placed), "d", "left"), [F.col(y) for y in labels], block)
    later = coded(val, [F.when(F.col("seg") != "test", F.col(y)) for y in labels])
    names = [f"_f{i}" for i in range(nf)], [f"_y{i}" for i in range(len(labels))], [f"_b{i}" for i in range(len(labels))]
    learn = [n for part in names for n in part]
    table = CodeTable(folded.select(*learn), nf, len(labels), width)

    candidates = [(y, i) for y in labels for i in range(len(grid))]
    numbered = [(labels.index(y), grid[i]) for y, i in candidates]
    fits = grown(table, numbered, n_splits)
    oof, final = (Scores(nf, numbered, fits, n_splits + 1, folds) for folds in (True, False))

    # Calibration and average precision see rows only through their score and label: rows are counted by these.
    p = (1.0 - 1.0 / (1.0 + F.exp(2.0 * F.col("margin")))).alias("p")
    learnt = stored(counted_margins(folded, learn, oof), "race-pairs")
    calibrators = SquaredLogit.fit_groups(learnt.select("c", p, "n", "pos"), "c", "p", "n", "pos", len(candidates))
    named = F.broadcast(spark.createDataFrame(
        [(c, y, i, *map(float, f.coef), float(f.intercept)) for c, ((y, i), f) in enumerate(zip(candidates, calibrators))],
        "c int, candidate string, config_id int, calib_p double, calib_p2 double, calib_0 double",
    ))
    by = ["c", "seg"]
    wanted = F.col("seg").isin(list(segments)) if segments is not None else F.lit(True)
    sides = [(folded, learn, oof, learnt), (later, [*names[0], *names[1]], final, None)]
    pairs, tops = [], []
    for frame, columns, score, counted in sides:
        if segments is None or not frame.where(wanted).isEmpty():
            pairs.append(counted if counted is not None else counted_margins(frame, columns, score))
            tops.append(task_tops(frame, columns, score, calibrators, tie, k))
    if not pairs:
        raise ValueError(f"no row in {segments}")
    pairs, tops = reduce(DataFrame.unionByName, pairs).where(wanted), reduce(DataFrame.unionByName, tops).where(wanted)
    z = F.col("calib_0") + F.col("calib_p") * F.col("p") + F.col("calib_p2") * F.col("p") * F.col("p")
    steps = pairs.select(*by, p, "n", "pos").join(named, "c").groupBy(*by, (1.0 / (1.0 + F.exp(-z))).alias("prob")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    steps = stored(steps, "race-steps")
    base = steps.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("pos") / F.sum("n")).alias("base_rate"))
    metrics = base.join(average_precision_of_counts(steps, "prob", "n", "pos", by), by, "left").join(precision_at_k(tops, "prob", "y", k, by, tie=tie), by, "left")
    return metrics.join(named, "c").select("candidate", "config_id", *[c for c in metrics.columns if c != "c"], "calib_p", "calib_p2")
