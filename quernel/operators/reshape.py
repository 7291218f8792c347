"""Long to wide, and the profile of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import selectors
from quernel.runtime import side_by_side
from quernel.table import ORDER, Table

#: More columns than this are an error: their names have to fit into a plan.
MAX_COLUMNS = 20_000
#: What counts as a date.
DATE = r"^\s*[+-]?[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}\s*$"


class DuplicateCell(ValueError):
    pass


def pivot(t: Table, index: str, columns: str, values: str, fill: str | None = None) -> Table:
    """One row per index and one column per text in `columns`, both in the order they first come.

    Two rows of one cell are an error (raised when the result is read); fill is for cells without a
    row, empty ones stay empty.
    """
    names = list(t.names)
    idx, c, v = selectors.columns(index, names, t.has_header), selectors.column(columns, names, t.has_header), selectors.column(values, names, t.has_header)
    base = t.df.select(*[t.col(i).alias(f"i{k}") for k, i in enumerate(idx)], t.cell(c).text.alias("c"), t.col(v).alias("v"), ORDER)
    heads = base.groupBy("c").agg(F.min(ORDER).alias("o")).orderBy("o").limit(MAX_COLUMNS + 1).select("c").collect()
    if len(heads) > MAX_COLUMNS:
        raise selectors.SelectorError(f"more than {MAX_COLUMNS} columns")
    heads = [r.c for r in heads]
    keys = [f"i{k}" for k in range(len(idx))]
    # One row per cell first (combined on the map side), then cells side by side.
    cells = base.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.min(ORDER).alias("o"))
    alone = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two rows for the cell of column "), F.col("c")))).otherwise(F.struct(F.col("v").alias("x")))
    cells = cells.withColumn("v", alone)
    out = side_by_side(cells, keys, "c", "v", heads, F.min("o").alias(ORDER))
    cols = [(names[i], F.col(f"i{k}")) for k, i in enumerate(idx)]
    for n, h in enumerate(heads):
        x = F.col(f"_h{n}")
        cols.append((h, F.when(x.isNull(), F.lit(fill)).otherwise(x["x"].cast("string")) if fill is not None else x["x"]))
    return Table(out, tuple(names[i] for i in idx), t.has_header, t.text_mode).with_columns(cols)


def info(t: Table, first: int = 3) -> Table:
    """index, name, type (num, date or str) and the first texts of each column; one pass over the table."""
    kinds, aggs = ["num", "date", "str"], []
    for i in range(len(t.names)):
        v = t.cell(i)
        filled = F.trim(v.text) != ""
        is_num = v.num.isNotNull()
        is_date = v.text.rlike(DATE) & F.trim(v.text).try_cast("date").isNotNull()
        aggs += [F.max(filled).alias(f"f{i}"), F.min(F.when(filled, is_num)).alias(f"n{i}"), F.min(F.when(filled, is_date)).alias(f"d{i}")]
    facts = t.df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    head = t.df.orderBy(ORDER).limit(first)
    shown = head.agg(*[F.transform(F.array_sort(F.collect_list(F.struct(ORDER, t.cell(i).text.alias("x")))), lambda s: s["x"]).alias(f"h{i}") for i in range(len(t.names))])
    both = facts.crossJoin(shown)  # one row each
    per = F.array(*[
        F.struct(
            F.lit(i + 1).alias("index"), F.lit(n).alias("name"),
            F.when(F.coalesce(F.col(f"n{i}"), F.lit(False)), kinds[0]).when(F.coalesce(F.col(f"d{i}"), F.lit(False)), kinds[1]).otherwise(kinds[2]).alias("type"),
            F.concat(F.lit("["), F.array_join(F.col(f"h{i}"), ", "), F.lit("]")).alias("head"), F.col("rows"),
        )
        for i, n in enumerate(t.names)
    ])
    df = both.select(F.explode(per).alias("x")).select("x.*").withColumn(ORDER, F.col("index"))
    names = (["index", "name", "type"] if t.has_header else ["index", "type"]) + [f"first{first}"]
    cols = [(n, F.col("head" if n.startswith("first") else n)) for n in names]
    return Table(df, tuple(names)).with_columns([*cols, ("rows", F.col("rows"))])
