"""The words of scanned pages in the order in which they are read.

A page comes as recognised lines and their boxes. Lines that run over several columns are cut where
the box says that the next column begins; the pieces are then read column by column, from the top.
Lines without a box keep their place among the lines around them.
"""

from __future__ import annotations

import re

import numpy as np

#: What scanners take for one another, by what it is counted as (pairs of letters first).
PAIRS = (("cl", "d"), ("rn", "m"), ("nn", "m"), ("vv", "w"), ("ii", "u"))
LETTERS = str.maketrans(
    {**dict.fromkeys("eoca0déèêdqóâ", "o"), **dict.fromkeys("il1jï|", "i"), **dict.fromkeys("rntuvy7ü", "n"), **dict.fromkeys("sſ5f8ß", "s"),
     **dict.fromkeys("hb6", "h"), **dict.fromkeys("g9", "g"), **dict.fromkeys("kx", "k"), **dict.fromkeys("wm", "w"), "ä": "o", "ö": "o"}
)
NOT_LETTERS = re.compile(r"[\W_]+")
BREAKS = "-=¬—~–"
GAP = re.compile(r"\s{2,}\|?\s*|\s\|\s")


def fold(word: str) -> str:
    """A word's letters, those counted as one that are misread as one another."""
    w = NOT_LETTERS.sub("", word.lower())
    for a, b in PAIRS:
        if a in w:
            w = w.replace(a, b)
    return w.translate(LETTERS)


def _middle(ordered: np.ndarray) -> float:
    """The median of a sorted array."""
    n = len(ordered)
    return float(ordered[n // 2]) if n % 2 else (float(ordered[n // 2 - 1]) + float(ordered[n // 2])) / 2


def _columns(x0: np.ndarray, width: float) -> list[float]:
    """Where columns begin: clusters of left edges."""
    if not len(x0):
        return []
    xs = np.sort(x0)
    cuts = np.flatnonzero(np.diff(xs) > 6 * width) + 1
    edges = [0, *cuts.tolist(), len(xs)]
    kept = [_middle(xs[a:z]) for a, z in zip(edges, edges[1:]) if z - a > 1]  # an edge that only one line has begins no column
    return kept or [float(xs[0])]


def _cut(line: str, x0: float, x1: float, starts: list[float], width: float) -> list[tuple[float, str]]:
    """The pieces of a line by the column they stand in."""
    inner = [s for s in starts if s > x0 + 4 * width and s < x1 - 1.5 * width]
    pieces, rest, end = [], line.rstrip(), x1
    for s in reversed(inner):
        at = len(rest) - (end - s) / width  # where the right piece should begin
        gaps = [(m.start(), m.end()) for m in GAP.finditer(rest)]
        near = min(gaps, key=lambda g: abs(g[1] - at), default=None)
        if near is None or abs(near[1] - at) > 6:
            spaces = [(m.start(), m.end()) for m in re.finditer(r"\s+\|?\s*", rest)]
            near = min(spaces, key=lambda g: abs(g[1] - at), default=None)
            if near is None or abs(near[1] - at) > 8:
                continue
        pieces.append((s, rest[near[1]:]))
        rest = rest[: near[0]]
        end = x0 + len(rest) * width
    pieces.append((x0, rest))
    return pieces[::-1]


def reading_order(text: str, boxes: np.ndarray | None) -> list[str]:
    """The lines of a page, cut into columns and in reading order; boxes: rows of line_no, x0, y0, x1, y1."""
    lines = text.split("\n")
    if boxes is None or not len(boxes):
        return lines
    b = np.asarray(boxes).reshape(-1, 5)
    b = b[(b[:, 0] >= 1) & (b[:, 0] <= len(lines)) & (b[:, 1:].min(1) >= 0)]
    if not len(b):
        return lines
    nos, firsts = np.unique(b[:, 0], return_index=True)
    b = b[firsts].astype(float)
    left, right, top = np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 1], b[:, 3]), np.minimum(b[:, 2], b[:, 4])
    numbers = nos.tolist()
    width = _middle(np.sort((right - left) / np.array([max(1, len(lines[n - 1].rstrip())) for n in numbers]))) or 1.0
    starts = _columns(left, width)
    if len(starts) == 1 and (np.diff(top) >= 0).all():
        return lines
    edges = np.array(starts)
    column = np.abs(edges[None, :] - left[:, None]).argmin(1)
    crossing = ((edges[None, :] > left[:, None] + 4 * width) & (edges[None, :] < right[:, None] - 1.5 * width)).any(1)
    placed: list[tuple[int, float, int, str]] = [
        (c, y, n, lines[n - 1]) for c, y, n, x in zip(column.tolist(), top.tolist(), numbers, crossing.tolist()) if not x
    ]
    for k in np.flatnonzero(crossing).tolist():
        n = numbers[k]
        for x, piece in _cut(lines[n - 1], left[k], right[k], starts, width):
            placed.append((min(range(len(starts)), key=lambda c: abs(starts[c] - x)), float(top[k]), n, piece))
    if len(numbers) < len(lines):
        where = {n: (x, y) for n, x, y in zip(numbers, left.tolist(), top.tolist())}
        placed += _settle([n for n in range(1, len(lines) + 1) if n not in where], lines, where, placed, len(starts))
    placed.sort(key=lambda p: p[:3])
    return [p[3] for p in placed]


def _settle(lost: list[int], lines: list[str], where: dict, placed: list, columns: int) -> list[tuple[int, float, int, str]]:
    """Lines without a box: into the widest hole of a column near the lines around them."""
    tops = [sorted({p[1] for p in placed if p[0] == c}) for c in range(columns)]
    steps = [_middle(np.sort(np.diff(t))) if len(t) > 2 else 0.0 for t in tops]
    holes = []
    for c, t in enumerate(tops):
        if steps[c] > 0:
            for a, z in zip(t, t[1:]):
                k = round((z - a) / steps[c])
                holes += [(c, a + (z - a) * i / k) for i in range(1, k)]
    out = []
    for no in lost:
        before = next((where[n] for n in range(no - 1, 0, -1) if n in where), None)
        after = next((where[n] for n in range(no + 1, len(lines) + 1) if n in where), None)
        y = before[1] if before else after[1]
        step = max(steps) or 1.0
        near = [h for h in holes if abs(h[1] - y) <= 2.5 * step or (after and abs(h[1] - after[1]) <= 2.5 * step)]
        if not near:
            same = [p for p in placed if p[2] == no - 1] or [p for p in placed if p[2] == no + 1]
            c, top = (same[0][0], same[0][1]) if same else (0, y)
            out.append((c, top + 0.5, no, lines[no - 1]))
            continue
        near.sort(key=lambda h: abs(h[1] - y) + (abs(h[1] - after[1]) if after else 0))
        pieces = [p for p in GAP.split(lines[no - 1]) if p] if len(near) > 1 else [lines[no - 1]]
        for (c, top), piece in zip(sorted(near[: len(pieces)]), pieces):
            out.append((c, top, no, piece))
            holes.remove((c, top))
        out += [(*near[-1], no, p) for p in pieces[len(near):]]
    return out
