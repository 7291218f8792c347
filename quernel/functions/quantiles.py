"""Quantile tokens: q2, q25, q0.25, q0_25, p90."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(token: str) -> float | None:
    """The share that a token stands for; None if it is no quantile token."""
    m = re.fullmatch(r"([qp])([0-9]+)(?:[._]([0-9]+))?", token)
    if not m:
        return None
    n = float(f"{m[2]}.{m[3] or 0}")
    if m[1] == "p":
        return n / 100 if n <= 100 else None
    if m[3] is None:
        return n / 4 if n <= 4 else n / 100 if n <= 100 else None
    return n if n <= 1 else n / 100 if n <= 100 else None


def log_bucket(v: Column) -> Column:
    """A whole number that grows with v: 256 buckets for each doubling, whatever the range."""
    size = F.floor(F.log2(F.abs(v)) * 256) + 300_000
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("long")
