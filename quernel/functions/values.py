"""Cells as pairs of text and number, the way every operator sees them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the texts that are numbers (surrounding white space aside).
NUMBER = r"(?iU)^\s*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan))\s*$"
EPSILON = 2.220446049250313e-16
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Val:
    """text is never NULL ("" is the missing cell); num is NULL where the cell is no number."""

    shown: Column | Callable[[], Column]  # the text, or how to make it where something asks for it
    num: Column
    is_number: bool = False  # a numeric column, a literal or the result of arithmetic
    items: tuple[Val, ...] = ()  # of a list of columns
    loose: Column | None = None  # num before what is not finite was made NULL

    @property
    def text(self) -> Column:
        return self.shown() if callable(self.shown) else self.shown

    @property
    def raw(self) -> Column:
        """For sums and products, through which what is not finite stays so: it is made NULL once, at the end."""
        return self.num if self.loose is None else self.loose

    @property
    def finite(self) -> Column:
        return finite(self.num)


def finite(num: Column) -> Column:
    return F.when(F.abs(num) < F.lit(float("inf")), num)  # NaN is greater than all numbers


def parse_number(text: Column) -> Column:
    bare = F.regexp_extract(text, NUMBER, 1)
    return F.when(bare.rlike("(?i)nan$"), F.lit(float("nan"))).when(bare != "", bare.try_cast("double"))


def format_number(num: Column) -> Column:
    """Whole numbers without a point, others with six decimals; NULL as ""."""
    whole = (num == F.floor(num)) & (F.abs(num) < 1e18)
    text = (
        F.when(F.isnan(num), F.lit("NaN"))
        .when(num == float("inf"), F.lit("inf")).when(num == float("-inf"), F.lit("-inf"))
        .when(whole, F.format_string("%.0f", num))
        .otherwise(F.format_string("%.6f", num))
    )
    return F.when(num.isNull(), F.lit("")).otherwise(text)


def exact_text(num: Column) -> Column:
    """format_number rounded from the exact binary value, half to even: for text sinks (Arrow batches)."""
    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "" if x is None or x != x else f"{x:.0f}" if x in (float("inf"), float("-inf")) or x == int(x) else f"{x:.6f}")

    return F.coalesce(F.when(num.isNotNull() & F.isnan(num), F.lit("NaN")).otherwise(render(num)), F.lit(""))


def shortest(num: Column) -> Column:
    """A number as it would be typed, with all its digits: no exponent for the usual sizes, no trailing zeros."""
    d = num.cast("double")
    plain = d.cast("string")
    # Every digit of a double between these bounds fits into the decimal.
    long = F.regexp_replace(plain.cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    usual = F.abs(d).between(1e-4, 1e15) | (d == 0)
    text = F.when(F.isnan(d), F.lit("NaN")).when(usual & plain.contains("E"), long).otherwise(F.when(plain == "-0.0", F.lit("0")).otherwise(F.regexp_replace(plain, r"\.0$", "")))
    return F.coalesce(text, F.lit(""))


def cell(c: Column, kind: T.DataType) -> Val:
    """The value of a column of this type."""
    if isinstance(kind, T.StringType):
        text = F.coalesce(c, F.lit(""))
        return Val(text, parse_number(text))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Val(lambda: shortest(c), c.cast("double"), True)
    if isinstance(kind, NUMERIC):
        return Val(lambda: F.coalesce(c.cast("string"), F.lit("")), c.cast("double"), True)
    return Val(F.coalesce(c.cast("string"), F.lit("")), F.lit(None).cast("double"))


def number(num: Column) -> Val:
    """The result of arithmetic: anything that is not finite is blank."""
    n = finite(num)
    return Val(lambda: format_number(n), n, True, (), num)


def sure(num: Column) -> Val:
    """A number that cannot be infinite or NaN."""
    return Val(lambda: format_number(num), num, True)


def listed(items: list[Val]) -> Val:
    """Several columns where one value is expected: texts joined by tabs, the first number."""
    return Val(lambda: F.concat_ws("\t", *[v.text for v in items]), F.coalesce(*[v.num for v in items]), False, tuple(items))
