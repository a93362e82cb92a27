"""Plain single-process versions of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingle_set(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_groups(rows):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component)}; all pairs sharing a shingle are compared."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, same = defaultdict(list), defaultdict(list)
    for d, s in sets.items():
        if s:
            same[s].append(d)
    for group in same.values():
        for d in group[1:]:
            a, b = find(group[0]), find(d)
            parent[max(a, b)] = min(a, b)
        for x in sets[group[0]]:
            holders[x].append(group[0])
    seen = set()
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a], sets[b]
                    both = len(x & y)
                    if 100 * both >= 75 * (len(x) + len(y) - both):
                        u, v = find(a), find(b)
                        parent[max(u, v)] = min(u, v)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(rows, least=100):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    first, out = {}, {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if w in first:
                gone[i : i + least] = True
            else:
                first[w] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def line_texts(rows):
    """Each row's text without the lines that a smaller doc_id holds; rows without id keep all and own none."""
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for d, t in rows:
        for x in (t or "").split("\n") if d is not None else ():
            if len(k := key(x)) >= 10:
                holders[k].add(d)
    owner = {k: min(v) for k, v in holders.items() if len(v) > 1}
    return ["\n".join(x for x in (t or "").split("\n") if d is None or owner.get(key(x), d) == d) for d, t in rows]


def lines(rows):
    out = {}
    for (d, t), kept in zip(rows, line_texts(rows), strict=True):
        n = (t or "").count("\n") + 1
        stay = 0 if kept == "" and t else kept.count("\n") + 1
        if kept == "" and t:  # all lines are gone, or empty lines stay
            own = (t or "").split("\n")
            stay = 1 if own == [""] else sum(x == "" for x in own)
        out[d] = (n, n - stay, hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_scores_by_row(rows):
    c, held = Counter(), lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    for d, t in rows:
        if not held(d):
            c.update([*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        w = [*words(t), "\n"]
        yield d, t, (held(d), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))


def base_scores(rows):
    return {d: out for d, _, out in base_scores_by_row(rows)}


def contaminated(docs, items, percent=75):
    found = set()
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    index = defaultdict(list)
    parsed = {}
    for item, t in items:
        w = words(t)
        if w:
            k = min(5, len(w))
            parsed[item] = (w, k, grams(w, k))
            for o in range(len(w) - k + 1):
                index[tuple(w[o : o + k])].append((item, o))
    for d, t in docs:
        w = words(t)
        starts = set()
        for k in {p[1] for p in parsed.values()}:
            for p in range(len(w) - k + 1):
                for item, o in index.get(tuple(w[p : p + k]), ()):
                    if parsed[item][1] == k:
                        starts.add((item, max(0, min(p - o, len(w) - len(parsed[item][0])))))
        for item, s in starts:
            iw, k, own = parsed[item]
            got = grams(w[s : s + len(iw)], k)
            low = sum(min(got[g], own[g]) for g in own)
            if 100 * low >= percent * (sum(got.values()) + sum(own.values()) - low):
                found.add((d, item))
    return found


def nearest(rows, is_query, near=10):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if is_query(i):
            d = np.sqrt(((m - v) ** 2).sum(axis=1))
            keep = ids != i
            by = np.lexsort((ids[keep], d[keep]))[:near]
            out[i] = list(zip(ids[keep][by].tolist(), d[keep][by].tolist(), strict=True))
    return out


def contaminated_anywhere(docs, items, percent=75):
    """(doc, item) -> (similarity, start) of the first of the best windows, with a window begun at every word."""
    found = {}
    for d, t in docs:
        w = words(t)
        for item, text in items:
            iw = words(text)
            k, best = max(1, min(5, len(iw))), None
            grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))  # noqa: B023, E731
            own = grams(iw)
            for s in range(max(1, len(w) - len(iw) + 1) if own.keys() & grams(w).keys() else 0):
                got = grams(w[s : s + len(iw)])
                low = sum((got & own).values())
                either = sum(got.values()) + sum(own.values()) - low
                if low and 100 * low >= percent * either and (best is None or low / either > best[0]):
                    best = (low / either, s)
            if best:
                found[d, item] = best
    return found
