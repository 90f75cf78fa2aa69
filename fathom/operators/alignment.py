"""Global and local alignment of texts or token lists, and clustering by it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Costs of a global alignment: fixed values.
INSERT, DELETE, REPLACE = 1, 1, 2

#: Scores of a local alignment: fixed values.
MATCH, GAP_X, GAP_Y, MISMATCH = 1, -1, -1, -2


def _codes(a: Sequence, b: Sequence, case: bool) -> tuple[np.ndarray, np.ndarray]:
    fold = (lambda x: x) if case else (lambda x: x.lower() if isinstance(x, str) else x)
    ids: dict = {}
    return tuple(np.array([ids.setdefault(fold(x), len(ids)) for x in s], np.int64) for s in (a, b))


def _costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cost of aligning every two prefixes; a row is filled at once: along it the cost can only rise by INSERT."""
    d = np.empty((len(x) + 1, len(y) + 1), np.int32)
    steps = np.arange(len(y) + 1, dtype=np.int32) * INSERT
    d[0] = steps
    for i in range(1, len(x) + 1):
        row = d[i]
        row[0] = i * DELETE
        row[1:] = np.minimum(d[i - 1, :-1] + np.where(y == x[i - 1], 0, REPLACE), d[i - 1, 1:] + DELETE)
        row[:] = np.minimum.accumulate(row - steps) + steps
    return d


def align(a: Sequence, b: Sequence, case: bool = True, gap: str = "-") -> tuple[float, object, object]:
    """(cost, a and b with gaps); of equally cheap ways the diagonal comes before an insertion, that before a deletion."""
    x, y = _codes(a, b, case)
    d = _costs(x, y)
    i, j, left, right = len(x), len(y), [], []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (0 if x[i - 1] == y[j - 1] else REPLACE):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif j and d[i, j] == d[i, j - 1] + INSERT:
            j -= 1
            left.append(gap)
            right.append(b[j])
        else:
            i -= 1
            left.append(a[i])
            right.append(gap)
    join = "".join if isinstance(a, str) and isinstance(b, str) else list
    return float(d[-1, -1]), join(reversed(left)), join(reversed(right))


def align_cost(a: Sequence, b: Sequence, case: bool = True) -> float:
    x, y = _codes(a, b, case)
    return float(_costs(x, y)[-1, -1])


def closest(text: str, others: Sequence[str], case: bool = True) -> tuple[int, float] | None:
    """Index and relative cost (cost over twice the text's length) of the most alike of others."""
    best = None
    for k, o in enumerate(others):
        cost = align_cost(text, o, case) / max(1, 2 * len(text))
        if best is None or cost < best[1]:
            best = (k, cost)
    return best


@dataclass(frozen=True)
class Local:
    x: object
    y: object
    x_start: int
    x_to: int
    y_start: int
    y_to: int
    score: float


def local_alignments(a: Sequence, b: Sequence, case: bool = True) -> list[Local]:
    """The best local alignments (Smith and Waterman), one for each place where the best score is reached."""
    x, y = _codes(a, b, case)
    h = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(1, len(x) + 1):
        same = np.where(y == x[i - 1], MATCH, MISMATCH)
        best = np.maximum(0, np.maximum(h[i - 1, :-1] + same, h[i - 1, 1:] + GAP_X))
        steps = -GAP_Y * np.arange(1, len(y) + 1)
        h[i, 1:] = np.maximum(best, np.maximum.accumulate(best + steps) - steps)
    top = int(h.max()) if h.size else 0
    out = []
    for i, j in zip(*np.nonzero(h == top), strict=True) if top > 0 else ():
        ei, ej = int(i), int(j)
        i, j = ei, ej
        while h[i, j] > 0:
            if i and j and h[i, j] == h[i - 1, j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
                i, j = i - 1, j - 1
            elif j and h[i, j] == h[i, j - 1] + GAP_Y:
                j -= 1
            else:
                i -= 1
        out.append(Local(a[i:ei], b[j:ej], i, ei, j, ej, float(top)))
    return out


def cluster(texts: Sequence[Sequence]) -> list[tuple[int, int]]:
    """Merges, cheapest first: pairs of cluster numbers; the texts are 0 to n-1, each merge makes the next number."""
    alive: dict[int, list[int]] = {k: [k] for k in range(len(texts))}
    cost = {(i, j): align_cost(texts[i], texts[j]) / max(1, len(texts[i]) + len(texts[j])) for i in alive for j in alive if i < j}
    mean = lambda p, q: sum(cost[min(i, j), max(i, j)] for i in p for j in q) / (len(p) * len(q))
    out: list[tuple[int, int]] = []
    while len(alive) > 1:
        a, b = min(((i, j) for i in alive for j in alive if i < j), key=lambda ij: (mean(alive[ij[0]], alive[ij[1]]), ij))
        alive[len(texts) + len(out)] = alive.pop(a) + alive.pop(b)
        out.append((a, b))
    return out


def multiple_alignment(texts: Sequence[str], gap: str = "-") -> list[str]:
    """The texts with gaps, of one length: merged along the cluster tree by their consensus."""
    if not texts:
        return []
    groups: dict[int, list[list]] = {k: [list(t)] for k, t in enumerate(texts)}
    names: dict[int, list[int]] = {k: [k] for k in range(len(texts))}
    last = 0
    for n, (a, b) in enumerate(cluster(texts)):
        ga, gb = groups.pop(a), groups.pop(b)
        _, x, y = align([max(set(c), key=c.count) for c in zip(*ga, strict=True)], [max(set(c), key=c.count) for c in zip(*gb, strict=True)], gap="\0gap")
        merged = []
        for rows, mask in ((ga, x), (gb, y)):
            for row in rows:
                it = iter(row)
                merged.append([gap if m == "\0gap" else next(it) for m in mask])
        last = len(texts) + n
        groups[last], names[last] = merged, names.pop(a) + names.pop(b)
    (rows,) = groups.values()
    (order,) = names.values()
    return ["".join(r) for _, r in sorted(zip(order, rows, strict=True), key=lambda p: p[0])]


def pieces(text: str, kind: str = "text") -> list[tuple[str, int]]:
    """(piece, place): words of a text, tags and words of html, or characters (str)."""
    import re

    pattern = {"text": r"\S+", "html": r"<[^>]*>|[^<\s]+", "str": r"(?s)."}[kind]
    return [(m[0], m.start()) for m in re.finditer(pattern, text)]


def align_texts(a: str, b: str, kind: str = "text") -> dict:
    """Alignment of two texts by pieces: X and Y (pieces with gaps), their (place, length) in each text, L, cost."""
    p, q = pieces(a, kind), pieces(b, kind)
    cost, x, y = align([t for t, _ in p], [t for t, _ in q], gap="\0")
    places = lambda side, own: [(None, 0) if t == "\0" else next(own) for t in side]
    at_x, at_y = (iter([(k, len(t)) for t, k in own]) for own in (p, q))
    return {"X": ["" if t == "\0" else t for t in x], "Y": ["" if t == "\0" else t for t in y], "X_index": places(x, at_x), "Y_index": places(y, at_y), "L": len(x), "cost": cost}


def consensus(texts: Sequence[str]) -> str:
    """The most frequent character of each column of the multiple alignment, gaps left out."""
    rows = multiple_alignment(texts, "\0")
    return "".join(c for col in zip(*rows, strict=True) if (c := max(sorted(set(col)), key=col.count)) != "\0")
