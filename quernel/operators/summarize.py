"""Grouped statistics.

Algebraic statistics of all columns share one aggregation with map-side combining. Statistics of
frequencies (mode, entropy, unique, ...) and of ranks (quantiles, trimmed mean) come from value
counts, so a task gets a group's different values, not its rows. Positions (argmin, argmax) are
counted in a second aggregation. All parts are joined on the group key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions import rows, selectors
from quernel.functions.quantiles import fraction, log_bucket
from quernel.functions.values import Val
from quernel.runtime import join_safe
from quernel.table import ORDER, Table

BY_FREQUENCY = {"mode", "antimode", "entropy", "unique", "countunique"}
BY_POSITION = {"argmin", "argmax"}


@dataclass(frozen=True)
class Stat:
    column: int
    op: str  # canonical
    label: str


def parse_stats(specs: list[str], names: list[str], has_header: bool = True) -> list[Stat]:
    """COLUMNS=op,op (or COLUMNS:op); ranges of columns may run backwards."""
    out = []
    for spec in specs:
        head, eq, ops = spec.rpartition("=")
        if not eq:
            head, eq, ops = spec.rpartition(":")
        if not eq or not ops.strip():
            raise selectors.SelectorError(f"COLUMNS=OPERATIONS expected: {spec!r}")
        for i in selectors.resolve(selectors.parse(head), names, has_header, descending=True):
            for op in (o.strip() for o in ops.split(",")):
                name = rows.canonical(op)
                if name is None:
                    raise selectors.SelectorError(f"no statistic {op!r}")
                label = op if op in ("countunique", "distinct") else re.sub(r"\.", "_", name)
                out.append(Stat(i, name, f"{names[i]}_{label}"))
    return out


def _rank_of(f: float, n: Column) -> tuple[Column, Column, Column]:
    at = (n - 1) * F.lit(f)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def _simple(op: str, v: Val, seed: int) -> Column | None:
    """A statistic that is one aggregate expression over rows."""
    num, text, o = v.finite, v.text, F.col(ORDER)
    signed = lambda key: F.when(num.isNotNull(), key)
    n, s = F.count(num), F.sum(num)
    return {
        "sum": lambda: s, "mean": lambda: F.avg(num), "count": lambda: F.count(F.lit(1)).cast("double"),
        "sd": lambda: F.stddev_pop(num), "var": lambda: F.var_pop(num), "min": lambda: F.min(num), "max": lambda: F.max(num),
        "prod": lambda: F.when(n > 0, F.product(num)),
        "first": lambda: F.min_by(text, o), "last": lambda: F.max_by(text, o),
        "absmin": lambda: F.min(signed(F.struct(F.abs(num).alias("a"), o.alias("o"), num.alias("v"))))["v"],
        "absmax": lambda: F.min(signed(F.struct((-F.abs(num)).alias("a"), o.alias("o"), num.alias("v"))))["v"],
        "rand": lambda: F.max_by(text, F.struct(F.xxhash64(F.lit(seed), F.to_json(F.struct(o))), o)),
        "collapse": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), text.alias("t")))), lambda x: x["t"]), ","),
    }.get(op, lambda: None)()


def summarize(t: Table, stats: list[str] | str, group: str | None = None, seed: int = 0, sample: bool = False) -> Table:
    """A row per group with a column per statistic, groups in the order of their first rows.

    Without group the whole table is one group; a table without rows gives no row.
    """
    wanted = parse_stats([stats] if isinstance(stats, str) else stats, list(t.names), t.has_header)
    keys = selectors.columns(group, list(t.names), t.has_header) if group else []
    base = t.df.select(*[F.coalesce(t.col(i), F.lit("")).alias(f"g{k}") if t.kind(i).simpleString() == "string" else t.col(i).alias(f"g{k}") for k, i in enumerate(keys)],
                       *[t.col(i) for i in sorted({s.column for s in wanted})], ORDER)
    g = [f"g{k}" for k in range(len(keys))]
    simple, parts = [], []
    for k, s in enumerate(wanted):
        c = _simple(s.op, t.cell(s.column), seed)
        if c is not None:
            if sample and s.op in ("sd", "var"):
                n = t.cell(s.column).finite
                c = F.stddev_samp(n) if s.op == "sd" else F.var_samp(n)
            simple.append(c.alias(f"s{k}"))
    out = base.groupBy(*g).agg(F.min(ORDER).alias(ORDER), F.count(F.lit(1)).alias("__n"), *simple).filter("__n > 0")
    for i in sorted({s.column for s in wanted}):
        mine = [(k, s) for k, s in enumerate(wanted) if s.column == i]
        v = t.cell(i)
        if by := [(k, s) for k, s in mine if s.op in BY_FREQUENCY]:
            parts.append(_frequencies(base, g, v, by))
        if by := [(k, s) for k, s in mine if s.op in ("median", "iqr", "trimmean") or fraction(s.op) is not None]:
            parts.append(_ranks(base, g, v, by))
        if by := [(k, s) for k, s in mine if s.op in BY_POSITION]:
            parts.append(_positions(base, g, v, by))
    for p in parts:
        out = _join(out, p, g)
    cols = [(t.names[i], F.col(f"g{k}")) for k, i in enumerate(keys)] + [(s.label, F.col(f"s{k}")) for k, s in enumerate(wanted)]
    return Table(out, tuple(f"g{k}" for k in range(len(keys))), True, t.text_mode).with_columns(cols)


def _join(left: DataFrame, right: DataFrame, g: list[str]) -> DataFrame:
    if not g:
        return left.crossJoin(F.broadcast(right))  # one row each
    renamed = right.select(*[F.col(c).alias("r" + c) if c in g else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col("r" + c))
    return left.join(renamed, same, "left").drop(*["r" + c for c in g])


def _frequencies(base: DataFrame, g: list[str], v: Val, by: list) -> DataFrame:
    counts = base.select(*g, v.text.alias("v"), ORDER).groupBy(*g, "v").agg(F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("o"))
    often = F.struct((-F.col("n")).alias("n"), "o", "v")
    seldom = F.struct("n", "o", "v")
    total = F.sum("n")
    made = {
        "mode": F.min(often)["v"], "antimode": F.min(seldom)["v"], "countunique": F.count("v").cast("double"),
        "unique": F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), ","),
        # -sum(p log p) = log(total) - sum(n log n) / total: one pass of plain sums
        "entropy": F.greatest(F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total, F.lit(0.0)),
    }
    return counts.groupBy(*g).agg(*[made[s.op].alias(f"s{k}") for k, s in by])


def _ranks(base: DataFrame, g: list[str], v: Val, by: list) -> DataFrame:
    counts = base.select(*g, v.finite.alias("v")).filter("v is not null").groupBy(*g, "v").agg(F.count(F.lit(1)).alias("n"))
    # Values are ordered within buckets, so that a large group is spread over tasks; what lies before a bucket comes from sums.
    counts = counts.withColumn("bucket", log_bucket(F.col("v")))
    sums = counts.groupBy(*g, "bucket").agg(F.sum("n").alias("s"))
    within = [F.col(c) for c in g] or [F.lit(0)]
    sums = sums.withColumn("before", F.sum("s").over(W.partitionBy(*within).orderBy("bucket")) - F.col("s")).withColumn("t", F.sum("s").over(W.partitionBy(*within)))
    inner = W.partitionBy(*g, "bucket").orderBy("v")
    placed = join_safe(counts, sums.drop("s"), [*g, "bucket"])
    placed = placed.withColumn("b", F.sum("n").over(inner) + F.col("before")).withColumn("a", F.col("b") - F.col("n"))
    total = F.col("t")
    at = lambda rank: F.max(F.when((F.col("a") <= rank) & (F.col("b") > rank), F.col("v")))

    def quantile(f: float) -> Column:
        low, high, part = _rank_of(f, total)
        return at(low) + (at(high) - at(low)) * F.max(part)

    def made(op: str) -> Column:
        if op == "iqr":
            return quantile(0.75) - quantile(0.25)
        if op == "trimmean":
            cut = F.floor(total * F.lit(rows.TRIM))
            kept = F.greatest(F.least(F.col("b"), total - cut) - F.greatest(F.col("a"), cut), F.lit(0))
            return F.sum(F.col("v") * kept) / F.sum(kept)
        return quantile(0.5 if op == "median" else fraction(op))

    return placed.groupBy(*g).agg(*[made(s.op).alias(f"s{k}") for k, s in by])


def _positions(base: DataFrame, g: list[str], v: Val, by: list) -> DataFrame:
    nums = base.select(*g, v.finite.alias("v"), F.col(ORDER).alias("o")).filter("v is not null")
    ends = nums.groupBy(*g).agg(F.min(F.struct("v", "o"))["o"].alias("low"), F.min(F.struct((-F.col("v")).alias("v"), "o"))["o"].alias("high"))
    both = _join(nums, ends, g)
    made = {"argmin": F.sum((F.col("o") <= F.col("low")).cast("double")), "argmax": F.sum((F.col("o") <= F.col("high")).cast("double"))}
    return both.groupBy(*g).agg(*[made[s.op].alias(f"s{k}") for k, s in by])
