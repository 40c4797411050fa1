"""The contracts in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re

from tideframe.llm.jaccard_join import shingle_set


def quality_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The contract's counts of one text in plain Python, for small fixtures."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at: dict[tuple, list[int]] = {}
    for i in range(len(words) - 8 + 1):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    twice = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), n < 20 or 100 * len(twice) > 30 * n


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, str]]:
    """The contract in plain Python for small fixtures: doc_id to (n_words, n_removed, digest)."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        out[d] = (len(w), len(gone), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def components(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """The contract in plain Python for small fixtures: doc_id to (n_shingles, component_id)."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    top = {d: d for d in sets}

    def find(d: int) -> int:
        while top[d] != d:
            d = top[d]
        return d

    where: dict[bytes, list[int]] = {}
    for d in sorted(sets):
        shared: dict[int, int] = {}
        for x in sets[d]:
            for e in where.setdefault(x, []):
                shared[e] = shared.get(e, 0) + 1
            where[x].append(d)
        for e, both in shared.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                top[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}
