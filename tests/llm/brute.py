"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import re


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingle_set(text: str | None, n: int) -> set[tuple]:
    words = spaced_words(text)
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def linked(a: set, b: set, percent: int) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def near_duplicates(docs: dict[int, str | None], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {d: shingle_set(t, n) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= percent * large and linked(sets[a], sets[b], percent):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}
