"""Patterns and replacement templates of the table language, as Java understands them.

The language has no look-around and no back-references, `$` outside multi-line mode is the very end,
names of groups may hold underscores, and templates write $1, ${name} and $$.
"""

from __future__ import annotations

import re

_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
#: POSIX classes by Java's names.
_CLASSES = dict(
    alpha="Alpha", digit="Digit", alnum="Alnum", upper="Upper", lower="Lower", punct="Punct", space="Space", blank="Blank", cntrl="Cntrl",
    graph="Graph", print="Print", xdigit="XDigit",
)


class PatternError(ValueError):
    pass


def translate(pattern: str) -> tuple[str, dict[str, int]]:
    """(Java pattern, numbers of the named groups)."""
    out, names, groups, i, in_class = ["(?dU)"], {}, 0, 0, 0
    multiline = bool(re.match(r"\(\?[a-z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt.isdigit() or nxt == "k":
                raise PatternError("back-references are not supported")
            if nxt in ("Z", "G", "Q", "E"):
                raise PatternError(f"\\{nxt} is not supported")
            out.append(c + nxt)
            i += 2
            continue
        if in_class:
            if m := _POSIX.match(pattern, i):
                out.append(("\\P{" if m[1] else "\\p{") + _CLASSES.get(m[2], m[2]) + "}")
                i = m.end()
                continue
            in_class += (c == "[") - (c == "]" and pattern[i - 1] != "[" and pattern[i - 2 : i] != "[^")
            out.append(c)
        elif c == "[":
            in_class = 1
            out.append(c)
        elif c == "(":
            if pattern.startswith("(?", i):
                if re.match(r"\(\?<?[=!]", pattern[i:]):
                    raise PatternError("look-around is not supported")
                if m := re.match(r"\(\?P?<([A-Za-z_][\w.\[\]]*)>", pattern[i:]):
                    groups += 1
                    names[m[1]] = groups
                    out.append("(")
                    i += m.end()
                    continue
                if m := re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]", pattern[i:]):
                    if "U" in m[1]:
                        raise PatternError("swapped greediness is not supported")
                    multiline = multiline or "m" in m[1]
            else:
                groups += 1
            out.append(c)
        elif c == "$" and not multiline:
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    java = "".join(out)
    return java, names | {str(k): k for k in range(groups + 1)}


def template(text: str, groups: dict[str, int]) -> str:
    """A replacement template in Java's form; unknown groups give nothing."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "$":
            if text.startswith("$$", i):
                out.append("\\$")
                i += 2
                continue
            m = re.compile(r"\{([^}]*)\}|(\w+)").match(text, i + 1)
            if m:
                name = m[1] if m[1] is not None else m[2]
                if name in groups:
                    # An empty group between the number and a digit that follows keeps them apart.
                    out.append(f"${groups[name]}")
                    if m.end() < len(text) and text[m.end()].isdigit():
                        out.append("\\" + text[m.end()])
                        i = m.end() + 1
                        continue
                i = m.end()
                continue
            out.append("\\$")
        elif text[i] == "\\":
            out.append("\\\\")
        else:
            out.append(text[i])
        i += 1
    return "".join(out)
