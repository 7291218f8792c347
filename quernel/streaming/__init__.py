"""Operators on streams: what works on single rows works on a stream of rows as it is.

cut, keep, mutate and melt take a Table over a streaming DataFrame. summarize_windows() groups by
event time; statistics that need an order of rows or all different values have no bounded state
and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import selectors
from quernel.operators.summarize import parse_stats
from quernel.table import Table

ALGEBRAIC = {"sum", "mean", "count", "sd", "var", "min", "max", "prod"}


def stream_table(df: DataFrame) -> Table:
    """A table over a stream; its rows have no order."""
    cols = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]
    return Table(df.select(*cols, F.lit(0).cast("bigint").alias("__o")), tuple(df.columns))


def summarize_windows(df: DataFrame, time: str, window: str, stats: list[str], group: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, groups and statistics per window of event time; rows later than `late` are dropped."""
    if df.schema[time].dataType.typeName() == "timestamp_ntz":  # watermarks need a point in time: that of the session's zone
        df = df.withColumn(time, F.col(f"`{time}`").cast("timestamp"))
    watched = df.withWatermark(time, late)
    t = stream_table(watched)
    wanted = parse_stats(stats, list(t.names))
    if any(s.op not in ALGEBRAIC for s in wanted):
        raise selectors.SelectorError(f"on streams only {', '.join(sorted(ALGEBRAIC))} are possible")
    keys = selectors.columns(group, list(t.names)) if group else []
    at = F.window(t.col(t.names.index(time)), window, slide) if slide else F.window(t.col(t.names.index(time)), window)
    made = []
    for s in wanted:
        v = t.cell(s.column).finite
        made.append({
            "sum": F.sum(v), "mean": F.avg(v), "count": F.count(F.lit(1)).cast("double"), "sd": F.stddev_pop(v), "var": F.var_pop(v),
            "min": F.min(v), "max": F.max(v), "prod": F.product(v),
        }[s.op].alias(s.label))
    out = t.df.groupBy(at.alias("w"), *[t.col(i).alias(t.names[i]) for i in keys]).agg(*made)
    return out.select(F.col("w.start").alias("window_start"), *[t.names[i] for i in keys], *[s.label for s in wanted])
