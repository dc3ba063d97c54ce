"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int) -> set:
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def components(ids: list, linked) -> list:
    """The smallest id reachable from each place; ``linked(i, j)`` says whether two places are."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least: dict = {}
    for i, name in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, name), name)
    return [least[find(i)] for i in range(len(ids))]


def near_duplicates(rows: list[tuple], width: int, percent: int) -> dict:
    sets = [shingles(t, width) for _, t in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = len(a & b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    return dict(zip([i for i, _ in rows], zip(map(len, sets), components([i for i, _ in rows], linked))))


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def near_vectors(rows: list[tuple], cosine: float) -> dict:
    def unit(v):
        if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, dtype=float)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and len(a) == len(b) and float(a @ b) >= cosine

    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return dict(zip([i for i, _ in rows], zip(links, components([i for i, _ in rows], linked))))


def cleaned(rows: list[tuple], min_docs: int, min_chars: int) -> dict:
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(UPPER)

    holders: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    often = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if often.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out
