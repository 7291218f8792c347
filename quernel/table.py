"""A DataFrame with a header of its own and an order of rows.

Columns are physical _c0, _c1, ... so that names may repeat, differ in case only or hold any sign;
the hidden column __o orders the rows where an operator's meaning depends on order. It is dropped by
the optimizer wherever nothing asks for it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.expressions import Scope
from quernel.functions.values import Val, cell

ORDER = "__o"


#: Plan nodes that leave rows where they were read.
_KEEPING = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "DataSourceV2ScanRelation", "View"}


def _as_read(df: DataFrame) -> bool:
    """Whether a row's place in its partition is the same in every run: nothing but a scan, chosen columns and rows."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        if plan.getClass().getSimpleName() not in _KEEPING:
            return False
        if plan.children().isEmpty():
            return True
        plan = plan.children().head()


@dataclass(frozen=True)
class Table:
    df: DataFrame
    names: tuple[str, ...]
    has_header: bool = True
    text_mode: bool = False  # numbers are handed on as text with six decimals, and compared as text

    @staticmethod
    def of(df: DataFrame, order_by: list[str | Column] | None = None, text_mode: bool = False) -> Table:
        """A table over df; order_by gives the order of its rows. Without, rows of a scan are in the order they are read, others in that of their contents."""
        keys = [F.col(f"`{k}`") if isinstance(k, str) else k for k in order_by or []]
        if keys:
            order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
        elif _as_read(df):
            order = F.monotonically_increasing_id()
        else:  # places after a shuffle differ from run to run, contents don't
            order = F.struct(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias(f"k{i}") for i, c in enumerate(df.columns)])
        cols = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]
        return Table(df.select(*cols, order.alias(ORDER)), tuple(df.columns), True, text_mode)

    def headless(self) -> Table:
        """The same rows without a header: columns are known by place."""
        return replace(self, has_header=False)

    def to_df(self) -> DataFrame:
        """The table as a DataFrame; a repeated name gets #2, #3, ..."""
        seen: Counter = Counter()
        out = []
        for i, n in enumerate(self.names):
            seen[n] += 1
            out.append(F.col(f"_c{i}").alias(n if seen[n] == 1 else f"{n}#{seen[n]}"))
        return self.df.select(*out)

    # -- what operators use

    def col(self, i: int) -> Column:
        return F.col(f"_c{i}")

    def kind(self, i: int):
        return self.df.schema[f"_c{i}"].dataType

    def cell(self, i: int) -> Val:
        return cell(self.col(i), self.kind(i))

    def scope(self) -> Scope:
        return Scope(list(self.names), self.cell, self.has_header, self.text_mode)

    def with_columns(self, cols: list[tuple[str, Column]], order: Column | None = None) -> Table:
        """A table of these columns over the same rows."""
        made = [c.alias(f"_c{i}") for i, (_, c) in enumerate(cols)]
        df = self.df.select(*made, (F.col(ORDER) if order is None else order).alias(ORDER))
        return replace(self, df=df, names=tuple(n for n, _ in cols))
