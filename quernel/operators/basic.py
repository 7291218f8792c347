"""Operators on single rows, and on rows by their place: cut, filter, mutate, slice, sort, melt."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions import expressions, selectors
from quernel.functions.values import Val, exact_text
from quernel.table import ORDER, Table


def cut(t: Table, fields: str) -> Table:
    """Columns chosen, reordered or repeated; missing texts as ""."""
    found = selectors.columns(fields, list(t.names), t.has_header)
    return t.with_columns([(t.names[i], t.col(i)) for i in found])


def keep(t: Table, expression: str) -> Table:
    """Rows for which the expression holds."""
    scope = t.scope()
    test = expressions.predicate(expression, scope)
    df = scope.prepare(t.df).filter(test)
    return replace(t, df=df.select(*t.df.columns) if scope.lets else df)


def _result(t: Table, v: Val):
    """A derived value as a column: a number where it is one, or text with six decimals in text mode."""
    if v.is_number:
        return exact_text(v.num) if t.text_mode else v.num
    return v.text


def _split_assignment(text: str) -> tuple[str | None, str]:
    """Name and expression at the first = that is not quoted and no part of a comparison."""
    i, quoted = 0, False
    while i < len(text):
        c = text[i]
        if c == "\\" and quoted:
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "=" and not quoted and text[i - 1 : i] not in ("=", "!", "<", ">") and text[i + 1 : i + 2] != "=":
            return text[:i].strip(), text[i + 1 :].strip()
        i += 1
    return None, text.strip()


def _unquote_name(name: str) -> str:
    if len(name) > 1 and (name[0], name[-1]) in (("`", "`"), ("{", "}")):
        return re.sub(r"\\(.)", r"\1", name[1:-1])
    return name


def mutate(t: Table, *operations: str, overwrite: bool = False) -> Table:
    """Derived columns, one after another; each sees those before it.

    name=EXPR and name=agg(COLS) append a column (a name that is there already is appended again and
    the old one goes on to be meant by $name, unless overwrite); s/COLS/PATTERN/NEW/ changes columns.
    """
    for op in operations:
        if re.match(r"s/", op):
            parts = [p.replace("\\/", "/") for p in re.split(r"(?<!\\)/", op)]
            if len(parts) != 5 or parts[4]:
                raise expressions.ExpressionError(f"s/COLUMNS/PATTERN/NEW/ expected: {op!r}")
            targets = set(selectors.columns(parts[1], list(t.names), t.has_header))
            cols = [
                (n, expressions.substitute(t.cell(i), parts[2], parts[3]).text if i in targets else t.col(i)) for i, n in enumerate(t.names)
            ]
            t = t.with_columns(cols)
            continue
        name, text = _split_assignment(op)
        if name is None and t.has_header:
            raise expressions.ExpressionError(f"NAME=EXPRESSION expected: {op!r}")
        name = _unquote_name(name) if name is not None and t.has_header else f"col{len(t.names) + 1}"
        scope = t.scope()
        made = _result(t, expressions.value(text, scope))
        t = replace(t, df=scope.prepare(t.df))
        cols = [(n, t.col(i)) for i, n in enumerate(t.names)]
        if overwrite and name in t.names:
            cols[t.names.index(name)] = (name, made)
        else:
            cols.append((name, made))
        t = t.with_columns(cols)
    return t


# ---------------------------------------------------------------- order

_MODIFIERS = {"n": "n", "num": "n", "numeric": "n", "r": "r", "desc": "r", "asc": "a", "str": "t", "text": "t", "s": "t", "nr": "nr", "rn": "rn"}


def sort(t: Table, *keys: str) -> Table:
    """Rows by the keys COLUMN[:MODIFIERS], stable. Texts go by their bytes.

    With modifier n, cells that are no finite numbers go before all numbers, by text; r turns the
    whole order round.
    """
    by = []
    for key in keys:
        name, *mods = key.split(":")
        numeric = turned = False
        for m in mods:
            if m not in _MODIFIERS:
                raise selectors.SelectorError(f"no sort modifier {m!r}")
            for x in _MODIFIERS[m]:
                numeric = True if x == "n" else False if x == "t" else numeric
                turned = True if x == "r" else False if x == "a" else turned
        v = t.cell(selectors.column(name.lstrip("<$"), list(t.names), t.has_header))
        if numeric:
            n = v.finite
            rest = F.when(n.isNull(), v.text)
            by += [n.isNull(), -n, _turned(rest)] if turned else [n, rest]
        else:
            by.append(_turned(v.text) if turned else v.text)
    # The order is a function of the row (keys, then its place before), never of where the row lies after a shuffle.
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], F.col(ORDER).alias("o"))
    # Sorted by the fields of the struct, whose first bytes the sort compares at once.
    return replace(t, df=t.df.withColumn(ORDER, order).orderBy(*[F.col(f"{ORDER}.k{i}") for i in range(len(by))], F.col(f"{ORDER}.o")))


def _turned(text: Column) -> Column:
    """A text that orders the other way round: its bytes in complement, and a sign behind them greater than any."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


#: A bound further in than this is found by counting ranges of the order column, not by a top-k.
TOP_K = 10_000


def _bound(t: Table, n: int):
    """The order value of the nth row (from the end if negative); None if there are fewer rows.

    Near an end by a top-k. Else the order column is laid into ranges, their rows are counted, and it
    goes on within the range that holds the row, until that is near an end of it: no task gets more
    than its range, and the driver only counts and bounds.
    """
    rows, kind = t.df.select(ORDER), t.df.schema[ORDER].dataType
    ranges = max(2, int(t.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while abs(n) > TOP_K:
        laid = rows.repartitionByRange(ranges, ORDER)
        counts = laid.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("lo"), F.max(ORDER).alias("hi")).orderBy("p").collect()
        total = sum(c.n for c in counts)
        if abs(n) > total:
            return None
        rank = n if n > 0 else total + 1 + n
        for c in counts:
            if rank <= c.n:
                break
            rank -= c.n
        if c.lo == c.hi:
            return c.lo
        # The same rows by their bounds, whatever range another run would put them into.
        rows = rows.filter((F.col(ORDER) >= _literal(c.lo, kind)) & (F.col(ORDER) <= _literal(c.hi, kind)))
        n = rank if 2 * rank <= c.n else rank - c.n - 1
    way = F.col(ORDER).asc() if n > 0 else F.col(ORDER).desc()
    picked = rows.orderBy(way).limit(abs(n)).agg(F.count(F.lit(1)).alias("n"), (F.max(ORDER) if n > 0 else F.min(ORDER)).alias("o")).first()
    return picked.o if picked.n == abs(n) else None


def take(t: Table, spec: str) -> Table:
    """Rows by 1-based place: 3, 2:5, :10, 7:, -2, -3:; each once, in the order of the table.

    A place becomes a bound on the order column (found by a top-k, no numbering of all rows), a range
    a filter between bounds. Places behind the end give nothing; from-end places before the
    beginning are an error.
    """
    kind = t.df.schema[ORDER].dataType
    spans = selectors.row_spans(spec)
    tests = []
    for first, last in spans:
        test = F.lit(True)
        for n, lower in ((first, True), (last, False)):
            if n is None:
                continue
            if n == 1 and lower or n == -1 and not lower:
                continue
            o = _bound(t, n)
            if o is None:
                if n < 0:
                    raise selectors.SelectorError(f"fewer than {-n} rows")
                test = F.lit(False) if lower else test
                continue
            at = _literal(o, kind)
            test = test & ((F.col(ORDER) >= at) if lower else (F.col(ORDER) <= at))
        tests.append(test)
    return replace(t, df=t.df.filter(reduce(lambda a, b: a | b, tests)))


def _literal(value, kind: T.DataType):
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def melt(t: Table, ids: str, values: str | None = None, variable: str = "variable", value: str = "value", fill: str | None = None) -> Table:
    """One row per value column, in the order of the columns; fill replaces empty cells, of the ids too."""
    held = selectors.columns(ids, list(t.names), t.has_header)
    found = selectors.columns(values, list(t.names), t.has_header) if values else [i for i in range(len(t.names)) if i not in held]
    if not found:
        raise selectors.SelectorError("no value columns")
    if len(set(found)) < len(found):
        raise selectors.SelectorError("a value column is chosen twice")
    if set(found) & set(held):
        raise selectors.SelectorError("a column cannot be both id and value")
    kinds = {t.kind(i).simpleString() for i in found}
    filled = (lambda c: F.when(c.text == "", F.lit(fill)).otherwise(c.text)) if fill is not None else None
    cells = [filled(t.cell(i)) if filled else t.col(i) if len(kinds) == 1 else t.cell(i).text for i in found]
    pairs = F.array(*[F.struct(F.lit(t.names[i]).alias("n"), c.alias("v")) for i, c in zip(found, cells)])
    df = t.df.select(*[f"_c{i}" for i in held], ORDER, F.posexplode(pairs).alias("__p", "__kv"))
    cols = [(t.names[i], filled(t.cell(i)) if filled else t.col(i)) for i in held] + [(variable, F.col("__kv.n")), (value, F.col("__kv.v"))]
    return replace(t, df=df).with_columns(cols, F.struct(ORDER, "__p"))
