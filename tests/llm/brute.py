"""Plain single-machine versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def find_groups(ids, links):
    """{id: smallest id reachable}"""
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def lines(docs: dict[int, str | None], chars=40, least=5):
    split = {i: (t or "").split("\n") for i, t in docs.items()}
    key = lambda line: line.strip(SPACE).translate(UPPER)
    held = defaultdict(set)
    for i, ls in split.items():
        for line in ls:
            if len(key(line)) >= chars:
                held[key(line)].add(i)
    gone = lambda i, line: len(held.get(key(line), ())) >= least and i < max(held[key(line)])
    return {i: (len(ls), sum(gone(i, x) for x in ls), sha("\n".join(x for x in ls if not gone(i, x)))) for i, ls in split.items()}


def shingle_set(text: str | None, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def near(docs: dict[int, str | None], similarity=75):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = defaultdict(int)
    for ids in held.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    top = find_groups(docs, links)
    return {i: (len(sets[i]), top[i], top[i] == i) for i in docs}, len(links)


def repeats(texts: list[str | None], depth=400):
    raw = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for b in raw:
        for p in range(len(b) - depth + 1):
            count[hash(b[p : p + depth])] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if count[hash(b[p : p + depth])] > 1:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def vectors(rows: list[tuple], threshold=0.93):
    """rows (vec_id, embedding, label) -> {vec_id: (n_links, component, kept)}"""
    unit = {}
    for i, v, label in rows:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.array(v, np.float64)
        unit[i] = None if label is None or x is None or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x)
    label = {i: n for i, _, n in rows}
    links, n = [], defaultdict(int)
    by = defaultdict(list)
    for i, u in unit.items():
        if u is not None:
            by[label[i], len(u)].append(i)
    for ids in by.values():
        m = np.stack([unit[i] for i in ids])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            links.append((ids[a], ids[b]))
            n[ids[a]] += 1
            n[ids[b]] += 1
    top = find_groups(list(unit), links)
    return {i: (n[i], top[i], top[i] == i) for i in unit}
