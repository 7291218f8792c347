"""Joining any number of tables on keys.

Keys are compared as texts (or as numbers where all key columns are of one numeric type), missing
keys being equal. Which keys are kept is decided before rows are multiplied: the kept key set is the
union of the key columns of the tables named, and every table is left-joined to it. Spark chooses
a broadcast or merge join by size for the first two, further tables are merged; skewed partitions are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions import selectors
from quernel.table import ORDER, Table


def _names(key_names: list[str], parts: list[list[str]]) -> list[str]:
    taken: set[str] = set()
    out = []
    for n in key_names:
        name, k = n, 2
        while name in taken:
            name, k = f"{n}#{k}", k + 1
        taken.add(name)
        out.append(name)
    for number, names in enumerate(parts, 1):
        for n in names:
            name, k = n, number
            while name in taken:
                name, k = f"{n}#{k}", k + 1
            taken.add(name)
            out.append(name)
    return out


def kept_tables(keep: str, count: int) -> list[int] | None:
    """Numbers of the tables any of which must have a key (0-based); None: all must."""
    keep = keep.strip()
    if keep in ("", "-1"):
        return None
    if keep == "0":
        return list(range(count))
    out = []
    for token in keep.split(","):
        n = int(token)
        if not 1 <= n <= count:
            raise selectors.SelectorError(f"no table {n}")
        out.append(n - 1)
    return sorted(set(out))


def join(tables: list[Table], on: str, keep: str = "", select: str | None = None, fill: str | None = None, merge: bool = False) -> Table:
    """Tables joined on the key columns `on` (per table separated by ;).

    keep: "" inner, "0" full outer, "1,3" keys that table 1 or 3 has. select: value columns per table
    (an empty part is all but the keys). fill: text for the cells of absent rows. merge: a hint to
    sort-merge.
    """
    if len(tables) < 2:
        raise selectors.SelectorError("a join takes two tables or more")
    keys = [selectors.columns(s, list(t.names), t.has_header) for s, t in zip(selectors.per_table(on, len(tables)), tables)]
    if len({len(k) for k in keys}) > 1:
        raise selectors.SelectorError("key columns differ in number")
    wide = len(keys[0])
    specs = select.split(";") if select is not None else [""] * len(tables)
    if len(specs) != len(tables):
        raise selectors.SelectorError("one group of columns per table is needed")
    shown = [
        [i for i in (selectors.columns(s, list(t.names), t.has_header) if s.strip() else range(len(t.names))) if i not in k]
        for s, t, k in zip(specs, tables, keys)
    ]
    sides, value_cols = [], []
    typed = [len({t.kind(k[j]).simpleString() for t, k in zip(tables, keys)}) == 1 and tables[0].kind(keys[0][j]).simpleString() != "string" for j in range(wide)]
    for n, (t, k, cols) in enumerate(zip(tables, keys, shown)):
        made = [(t.col(i) if typed[j] else t.cell(i).text).alias(f"k{j}") for j, i in enumerate(k)]
        made += [t.col(i).alias(f"v{n}_{m}") for m, i in enumerate(cols)]
        side = t.df.select(*made, F.col(ORDER).alias(f"o{n}"), F.lit(True).alias(f"p{n}"))
        sides.append(side.hint("merge") if merge else side)
        value_cols += [(n, f"v{n}_{m}", t.kind(i).simpleString() == "string") for m, i in enumerate(cols)]
    k = [f"k{j}" for j in range(wide)]
    members = kept_tables(keep, len(tables))
    if members is None:
        # The order of an inner join: by the first row of the key in table 1.
        out = sides[0].withColumn("rank", F.struct(F.lit(0).alias("t"), F.min("o0").over(W.partitionBy(*k)).alias("o")))
        out = _chain(out, sides[1:], k, "inner")
    elif len(tables) == 2 and len(members) == 2 and tables[0].df.schema[ORDER].dataType == tables[1].df.schema[ORDER].dataType:
        out = _full(*sides, k)
    else:
        if len(members) == 1:
            n = members[0]
            out = sides[n].withColumn("rank", F.struct(F.lit(n).alias("t"), F.min(f"o{n}").over(W.partitionBy(*k)).alias("o")))
            rest = [i for i in range(len(sides)) if i != n]
        else:
            # A key goes by its first row in the first of these tables that has it; orders of different tables may be of different types.
            kinds = {n: tables[n].df.schema[ORDER].dataType for n in members}

            def first(n: int) -> Column:
                return F.struct(F.lit(n).alias("t"), *[(F.min(f"o{n}") if i == n else F.lit(None).cast(kind)).alias(f"o{i}") for i, kind in kinds.items()])

            firsts = [sides[n].groupBy(*k).agg(first(n).alias("r")) for n in members]
            out = reduce(lambda a, b: a.unionByName(b), firsts).groupBy(*k).agg(F.min("r").alias("rank"))
            rest = list(range(len(sides)))
        out = _chain(out, [sides[i] for i in rest], k, "left")
    cols: list[tuple[str, Column]] = []
    names = _names([tables[0].names[i] for i in keys[0]], [[t.names[i] for i in c] for t, c in zip(tables, shown)])
    for j in range(wide):
        cols.append((names[j], F.col(f"k{j}")))
    for (n, c, is_text), name in zip(value_cols, names[wide:]):
        v = F.col(c)
        if fill is not None:
            v = F.when(F.col(f"p{n}").isNull(), F.lit(fill)).otherwise(v if is_text else v.cast("string"))
        cols.append((name, v))
    order = F.struct("rank", *[f"o{n}" for n in range(len(tables))])
    return Table(out, tuple(names), tables[0].has_header, tables[0].text_mode).with_columns(cols, order)


def _full(left, right, keys: list[str]):
    """Both tables with every key of either; a key goes by its first row in the first table, else in the second."""
    first = lambda n: F.struct(F.lit(n).alias("t"), F.min(f"o{n}").over(W.partitionBy(*keys)).alias("o"))
    a = left.withColumn("first0", first(0))
    b = right.withColumn("first1", first(1)).select(*[F.col(c).alias("r" + c) if c in keys else F.col(c) for c in [*right.columns, "first1"]])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("r" + c)) for c in keys])
    both = a.join(b, same, "full_outer").withColumn("rank", F.coalesce("first0", "first1"))
    return both.withColumns({c: F.when(F.col("p0").isNull(), F.col("r" + c)).otherwise(F.col(c)) for c in keys}).drop(*["r" + c for c in keys], "first0", "first1")


def _chain(left, rights: list, keys: list[str], how: str):
    """left joined with one table after the other.

    Compiled together with a join before it, a broadcast join holds all rows of a key (the product of all
    tables) in memory before it hands on the first. A merge join is compiled by itself, so from the second on they are.
    """
    for i, right in enumerate(rights):
        left = _equi(left, right.hint("merge") if i else right, keys, how)
    return left


def _equi(left, right, keys: list[str], how: str):
    renamed = right.select(*[F.col(c).alias("r" + c) if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("r" + c)) for c in keys])
    return left.join(renamed, same, how).drop(*["r" + c for c in keys])
