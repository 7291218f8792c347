"""The expression language: parsed on the driver, compiled to Column expressions.

Precedence, low to high: | or, & and, ! not, comparisons (chained) and ~ !~, + -, * /, ^ (to the
right), unary minus. Columns are $name, $3, $-1, ${any name}; $a:$c and $a,$c are lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import regexes, rows, selectors
from quernel.functions.values import EPSILON, Val, finite, format_number, listed, number


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # op, name, number, text, column, columns
    value: object


@dataclass
class Scope:
    """The columns that an expression sees."""

    names: list[str]
    cells: Callable[[int], Val]
    has_header: bool = True
    text_equality: bool = False  # == compares texts even of two numbers
    seed: int = 0
    lets: list[list[tuple[str, Column]]] = field(default_factory=list)

    def let(self, cols: list[Column]) -> list[Column]:
        """Names for values that an expression uses more than once; prepare() makes them columns."""
        names = [f"__let{len(self.lets)}_{i}" for i in range(len(cols))]
        self.lets.append(list(zip(names, cols)))
        return [F.col(n) for n in names]

    def prepare(self, df: DataFrame) -> DataFrame:
        """df with the named values, which Spark then computes once."""
        for stage in self.lets:
            df = df.select("*", *[c.alias(n) for n, c in stage])
        return df


_SIMPLE = re.compile(r"\s+|(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\|?|&&?|==|!=|!~|<=|>=|[<>~!+\-*/^(),])")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_BRACED = re.compile(r"\$\{((?:[^}\\]|\\.)*)\}", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    i = 0
    while i < len(text):
        if text[i] == '"':
            m = _STRING.match(text, i)
            if not m:
                raise ExpressionError("unterminated string")
            out.append(Token("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), m[1], flags=re.S)))
            i = m.end()
        elif text[i] == "$":
            m = _BRACED.match(text, i)
            if m:
                out.append(Token("column", re.sub(r"\\(.)", r"\1", m[1], flags=re.S)))
                i = m.end()
            elif text.startswith("${", i):
                raise ExpressionError("unterminated ${")
            else:
                token, i = _column(text, i + 1)
                out.append(token)
        else:
            m = _SIMPLE.match(text, i)
            if not m:
                raise ExpressionError(f"unexpected {text[i]!r} in expression")
            if m.lastgroup:
                out.append(Token(m.lastgroup, m[0]))
            i = m.end()
    return out


def _column(text: str, start: int) -> tuple[Token, int]:
    """A column token behind its $. A minus belongs to a name unless it looks like arithmetic."""
    i = start
    while i < len(text):
        c = text[i]
        if c == "-":
            so_far = text[start:i].replace("$", "")
            ahead = text[i + 1 :].lstrip()[:1]
            if so_far and (so_far.isdigit() or ahead in tuple('$()+-*/^".') and ahead or ahead.isdigit()):
                break
        elif not (c.isalnum() or c in "_.,:$"):
            break
        i += 1
    if text[start:i].endswith(",") and text[i:].lstrip().startswith('"'):
        i -= 1  # the comma parts the arguments of a call
    name = text[start:i].replace("$", "").strip()
    if not name:
        raise ExpressionError("a column name or position is needed behind $")
    found = selectors.parse(name)
    if "," in name or ":" in name:
        return Token("columns", tuple(found)), i
    return Token("column", found[0]), i


_NUMERIC = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x),
    "ln": lambda x: F.when(x > 0, F.ln(x)), "log": lambda x: F.when(x > 0, F.log10(x)),
    "log10": lambda x: F.when(x > 0, F.log10(x)), "log2": lambda x: F.when(x > 0, F.log2(x)),
}


class Parser:
    """Recursive descent straight to Columns; errors come before any job."""

    def __init__(self, text: str, scope: Scope):
        self.text, self.tokens, self.at, self.scope = text, tokens(text), 0, scope

    # -- helpers

    def peek(self, *ops: str) -> str | None:
        if self.at < len(self.tokens):
            t = self.tokens[self.at]
            if (t.kind == "op" or t.kind == "name") and t.value in ops:
                return t.value
        return None

    def take(self, *ops: str) -> str | None:
        op = self.peek(*ops)
        if op:
            self.at += 1
        return op

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ExpressionError(f"{op!r} expected in {self.text!r}")

    def next(self) -> Token:
        if self.at >= len(self.tokens):
            raise ExpressionError(f"expression ends too early: {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at].value!r} in {self.text!r}")

    # -- predicates

    def predicate(self) -> Column:
        out = self._and()
        while self.take("|", "||", "or"):
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._not()
        while self.take("&", "&&", "and"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self.take("!", "not"):
            return ~self._not()
        return self._comparison()

    def _comparison(self) -> Column:
        if op := self.take("~", "!~"):
            every = tuple(self.scope.cells(i) for i in range(len(self.scope.names)))
            return self._matches(every, op)
        if self.peek("("):
            start = self.at
            try:  # a bracketed predicate, unless arithmetic or a comparison goes on behind it
                self.take("(")
                inner = self.predicate()
                self.need(")")
                if not self.peek("==", "!=", "<", "<=", ">", ">=", "~", "!~", "+", "-", "*", "/", "^"):
                    return inner
            except ExpressionError:
                pass
            self.at = start
        left = self.value()
        if op := self.take("~", "!~"):
            return self._matches(left.items or (left,), op)
        out = None
        while op := self.take("==", "!=", "<", "<=", ">", ">="):
            right = self.value()
            one = self._compare(op, left, right)
            out = one if out is None else out & one
            left = right
        return _truth(left) if out is None else out

    def _compare(self, op: str, a: Val, b: Val) -> Column:
        if op in ("==", "!="):
            if a.is_number and b.is_number and not self.scope.text_equality:
                same = F.coalesce((a.num == b.num) & ~F.isnan(a.num), a.num.isNull() & b.num.isNull())
            else:
                same = a.text == b.text
            return same if op == "==" else ~same
        held = {"<": a.num < b.num, "<=": a.num <= b.num, ">": a.num > b.num, ">=": a.num >= b.num}[op]
        for v in (a, b):
            if v.loose is None:  # the result of arithmetic is never NaN
                held = held & ~F.isnan(v.num)
        return F.coalesce(held, F.lit(False))

    def _matches(self, cells: tuple[Val, ...], op: str) -> Column:
        static = self.at < len(self.tokens) and self.tokens[self.at].kind == "text" and not (
            self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].value in ("+", "-", "*", "/", "^")
        )
        if static:
            java, _ = regexes.translate(str(self.next().value))
            _check(java)
            test = lambda v: v.text.rlike(java)
        else:
            pattern = self.value().text
            test = lambda v: _dynamic_match(v.text, pattern)
        any_of = test(cells[0])
        for v in cells[1:]:
            any_of = any_of | test(v)
        return any_of if op == "~" else ~any_of

    # -- values

    def value(self) -> Val:
        out = self._product()
        while op := self.take("+", "-"):
            right = self._product()
            out = number(out.raw + right.raw if op == "+" else out.raw - right.raw)
        return out

    def _product(self) -> Val:
        out = self._power()
        while op := self.take("*", "/"):
            right = self._power()
            if op == "*":
                out = number(out.raw * right.raw)
            else:
                out = number(F.when(F.abs(right.num) >= EPSILON, out.raw / right.num))
        return out

    def _power(self) -> Val:
        base = self._unary()
        if self.take("^"):
            return number(F.pow(base.num, self._power().num))
        return base

    def _unary(self) -> Val:
        if self.take("-"):
            return number(-self._unary().raw)
        if self.take("+"):
            return number(self._unary().raw)
        return self._factor()

    def _factor(self) -> Val:
        if self.take("("):
            inner = self.value()
            self.need(")")
            return inner
        t = self.next()
        if t.kind == "number":
            n = F.lit(float(t.value))
            return Val(lambda: format_number(n), n, True)
        if t.kind == "text":
            from quernel.functions.values import parse_number

            return Val(F.lit(t.value), parse_number(F.lit(t.value)))
        if t.kind == "column":
            return self.scope.cells(selectors.locate(t.value, self.scope.names, self.scope.has_header))
        if t.kind == "columns":
            found = selectors.resolve(list(t.value), self.scope.names, self.scope.has_header)
            return listed([self.scope.cells(i) for i in found])
        if t.kind == "name" and self.peek("("):
            return self._call(str(t.value))
        raise ExpressionError(f"unexpected {t.value!r} in {self.text!r}; columns are written with $")

    def _call(self, name: str) -> Val:
        self.need("(")
        if name in _NUMERIC:
            inner = self.value()
            self.need(")")
            return number(_NUMERIC[name](finite(inner.num)))
        if name == "sub":
            target = self.value()
            self.need(",")
            pattern = self.next()
            self.need(",")
            new = self.next()
            self.need(")")
            if pattern.kind != "text" or new.kind != "text":
                raise ExpressionError("sub() takes a column, a pattern and a replacement")
            return substitute((target.items or (target,))[0], str(pattern.value), str(new.value))
        statistic = rows.canonical(name)
        if statistic is None:
            raise ExpressionError(f"no function {name!r}")
        cells: list[Val] = []
        while not self.take(")"):
            t = self.next()
            if t.kind == "column":
                cells.append(self.scope.cells(selectors.locate(t.value, self.scope.names, self.scope.has_header)))
            elif t.kind == "columns":
                cells += [self.scope.cells(i) for i in selectors.resolve(list(t.value), self.scope.names, self.scope.has_header)]
            else:
                raise ExpressionError(f"{name}() takes columns")
            if not self.peek(")"):
                self.need(",")
        if not cells:
            raise ExpressionError(f"{name}() needs columns")
        return rows.row_statistic(statistic, cells, self.scope.seed, self.scope.let)


def _truth(v: Val) -> Column:
    if v.items:
        out = F.trim(v.items[0].text) != ""
        for x in v.items[1:]:
            out = out | (F.trim(x.text) != "")
        return out
    return F.when(v.num.isNotNull(), (v.num != 0) | F.isnan(v.num)).otherwise(F.trim(v.text) != "")


def _compiled(java: str):
    """A translated pattern as Python understands it."""
    import regex

    return regex.compile(java.replace("(?dU)", "").replace("\\z", "\\Z"))


def _check(java: str) -> None:
    """Refuses a wrong pattern before any job (Python's view of it is close enough for brackets and repeats)."""
    import regex

    try:
        _compiled(java)
    except regex.error as e:
        raise regexes.PatternError(str(e)) from None


def _dynamic_match(text: Column, pattern: Column) -> Column:
    """Patterns that differ by row: an Arrow batch at a time, wrong patterns match nothing."""

    @F.pandas_udf("boolean")
    def match(t: pd.Series, p: pd.Series) -> pd.Series:
        import regex

        known: dict = {}

        def one(text, pat):
            if pat not in known:
                try:
                    known[pat] = _compiled(regexes.translate(pat)[0])
                except (regex.error, regexes.PatternError):
                    known[pat] = None
            return known[pat] is not None and known[pat].search(text) is not None

        return pd.Series([one(a, b) for a, b in zip(t, p)], dtype=bool)

    return match(text, pattern)


def substitute(target: Val, pattern: str, new: str) -> Val:
    """All matches of a pattern replaced."""
    from quernel.functions.values import parse_number

    java, groups = regexes.translate(pattern)
    _check(java)
    text = F.regexp_replace(target.text, java, regexes.template(new, groups))
    return Val(text, parse_number(text))


def predicate(text: str, scope: Scope) -> Column:
    p = Parser(text, scope)
    out = p.predicate()
    p.done()
    return out


def value(text: str, scope: Scope) -> Val:
    p = Parser(text, scope)
    out = p.value()
    p.done()
    return out
