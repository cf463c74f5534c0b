"""Plain definitions that the operators are held against; for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WS, text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def last_id(ids):
    return max((i for i in ids if i is not None), default=None)


def line_dedup(docs):
    def key(x):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))

    holders = defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(d)
    gone = {k: last_id(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def quality_base(docs):
    out = []
    for d, t in docs:
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed))
    return out


def targets(sizes_by_source, weights=(5, 2, 1)):
    names = sorted(sizes_by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes_by_source.values())
    full = set()
    while True:
        left = total - sum(2.0 * sizes_by_source[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = sum(weight[s] for s in open_)
        got = {s: 2.0 * sizes_by_source[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in open_ if got[s] > 2.0 * sizes_by_source[s]}
        if not over:
            return got
        full |= over


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(docs):
    out = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        out.append((d, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    return out


def substring(docs, width=13):
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, float("inf")), rank(d))
    out = []
    for d, t in docs:
        w = words(t)
        gone = {i + j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < rank(d) for j in range(width)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def fingerprint(text):
    w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    fps = [fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [(d, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)]
