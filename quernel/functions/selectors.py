"""Column and row selectors: names, 1-based positions, positions from the end, and ranges of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: A point is a name, a position (1-based) or a position from the end (negative).
Point = str | int


@dataclass(frozen=True)
class Span:
    """An inclusive range; None is an open end."""

    first: Point | None
    last: Point | None


class SelectorError(ValueError):
    pass


def _atom(text: str, quoted: bool) -> Point:
    if not quoted and re.fullmatch(r"-?[0-9]+", text):
        n = int(text)
        if n == 0:
            raise SelectorError("positions begin with 1")
        return n
    if not text:
        raise SelectorError("empty column selector")
    return text


def _scan(text: str) -> list[list[tuple[str, bool]]]:
    """Items of a list; each is its parts between colons, with whether the part was quoted."""
    items: list[list[tuple[str, bool]]] = [[("", False)]]
    i = 0
    while i < len(text):
        c = text[i]
        if c in "`{" and not items[-1][-1][0].strip():
            end, out = "`" if c == "`" else "}", []
            i += 1
            while i < len(text) and text[i] != end:
                if text[i] == "\\" and i + 1 < len(text):
                    i += 1
                out.append(text[i])
                i += 1
            if i >= len(text):
                raise SelectorError(f"unterminated {c} in column selector")
            items[-1][-1] = ("".join(out), True)
        elif c == ",":
            items.append([("", False)])
        elif c == ":":
            items[-1].append(("", False))
        elif items[-1][-1][1]:
            if not c.isspace():
                raise SelectorError(f"unexpected {c!r} behind a quoted name")
        else:
            items[-1][-1] = (items[-1][-1][0] + c, False)
        i += 1
    return [[(t if q else t.strip(), q) for t, q in parts] for parts in items]


def parse(text: str) -> list[Point | Span]:
    """A comma-separated selector list."""
    items = _scan(text)
    if len(items) > 1 and items[-1] == [("", False)]:
        items.pop()
    out: list[Point | Span] = []
    for parts in items:
        if len(parts) == 1:
            out.append(_atom(*parts[0]))
        elif len(parts) == 2:
            first, last = (None if not t and not q else _atom(t, q) for t, q in parts)
            out.append(Span(first, last))
        else:
            raise SelectorError(f"more than one ':' in {text!r}")
    return out


def locate(point: Point, names: list[str], has_header: bool = True) -> int:
    """0-based place of a point; of equal names the first."""
    if isinstance(point, str):
        if not has_header:
            raise SelectorError(f"names cannot be used without a header: {point!r}")
        if point not in names:
            raise SelectorError(f"no column {point!r}")
        return names.index(point)
    place = point - 1 if point > 0 else len(names) + point
    if not 0 <= place < len(names):
        raise SelectorError(f"no column {point} among {len(names)}")
    return place


def resolve(selectors: list[Point | Span], names: list[str], has_header: bool = True, descending: bool = False) -> list[int]:
    """0-based places in the order asked for, repeats kept."""
    out: list[int] = []
    for s in selectors:
        if isinstance(s, Span):
            a = 0 if s.first is None else locate(s.first, names, has_header)
            b = len(names) - 1 if s.last is None else locate(s.last, names, has_header)
            if a > b and not descending:
                raise SelectorError("a range runs from left to right")
            out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
        else:
            out.append(locate(s, names, has_header))
    return out


def columns(text: str, names: list[str], has_header: bool = True) -> list[int]:
    return resolve(parse(text), names, has_header)


def column(text: str, names: list[str], has_header: bool = True) -> int:
    """Exactly one column; ranges are refused."""
    found = parse(text)
    if len(found) != 1 or isinstance(found[0], Span):
        raise SelectorError(f"exactly one column is needed: {text!r}")
    return locate(found[0], names, has_header)


def per_table(text: str, count: int) -> list[str]:
    """Selector texts of several tables, separated by semicolons; one stands for all."""
    parts = text.split(";")
    if len(parts) == 1:
        return parts * count
    if len(parts) != count:
        raise SelectorError(f"{len(parts)} selector groups for {count} tables")
    return parts


def row_spans(text: str) -> list[tuple[int | None, int | None]]:
    """Row ranges as (first, last), inclusive; negative counts from the end, None is open."""
    out = []
    for token in text.split(","):
        token = token.strip()
        if not token:
            continue
        parts = token.split(":")
        if len(parts) > 2:
            raise SelectorError(f"more than one ':' in {token!r}")
        try:
            ends = [int(p) if p.strip() else None for p in parts]
        except ValueError:
            raise SelectorError(f"no row number: {token!r}") from None
        if 0 in ends:
            raise SelectorError("rows begin with 1")
        out.append((ends[0], ends[-1]))
    if not out:
        raise SelectorError("no rows selected")
    return out
