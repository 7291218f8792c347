"""Column profiles per load, and the loads that stand out (problem 2).

Method: footers settle what they can, dictionaries give the different values of other chunks, and
only chunks without either are scanned (quernel.sources.footers). Everything else (shares, distinct
values, range, the exact median, the most frequent number) comes from the counts of values, which are
written once to the checkpoint folder.

Edge cases: an empty table has no profile. NULL loads are a load of their own. NULL and blank cells
are missing; NaN, infinities and texts that are no plain decimal number are unreadable. Rows that
occur again count again. Numbers are told apart by all their digits, also beyond those of a double.
The median of an even number of values is the mean of the two in the middle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.functions.quantiles import log_bucket
from quernel.runtime import cut, join_safe
from quernel.sources.footers import footers, value_counts

PLAIN = r"^[+-]?[0-9]+(\.[0-9]+)?$"
#: Values are laid into this many buckets to find the one that holds a median.
BUCKETS = 4096
SHARES = {"missing": 0.10, "unreadable": 0.05, "range": 0.05, "frequent": 0.20, "shift": 0.25}


def readings(counts: DataFrame, limits: dict[str, tuple[float, bool, float | None]]) -> DataFrame:
    """Value counts with the number read (if any), missing and in_range; limits: column to (lowest, whether it is itself allowed, highest)."""
    text = F.btrim("text", F.lit(" \t"))
    finite = F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") < float("inf"))
    value = F.when(finite, F.col("number")).when(text.rlike(PLAIN), text.try_cast("double")) + F.lit(0.0)
    out = counts.withColumns({"value": value, "missing": F.col("number").isNull() & (F.coalesce(text, F.lit("")) == "")})
    fits = F.lit(True)
    for c, (low, allowed, high) in limits.items():
        ok = (F.col("value") >= low) if allowed else (F.col("value") > low)
        fits = F.when(F.col("col_name") == c, ok if high is None else ok & (F.col("value") <= high)).otherwise(fits)
    # The digits of a number without sign, zeros and point that add nothing.
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1"), r"(\.[0-9]*?)0+$", "$1")
    digits = F.regexp_replace(digits, r"\.$", "")
    same = F.when(finite, F.col("value").cast("string")).when(F.col("value").isNotNull(), F.when(digits == "-0", F.lit("0")).otherwise(digits))
    return out.withColumns({"in_range": F.col("value").isNotNull() & fits, "digits": same})


def _middle(laid: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the buckets (_b) that hold ranks _low and _high, with _before raised by what lies in earlier buckets."""
    order = W.partitionBy(*keys).orderBy("_b")
    sums = laid.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_before").alias("_earlier"))
    sums = sums.withColumn("_before", F.col("_earlier") + F.sum("_n").over(order) - F.col("_n"))
    held = sums.filter((F.col("_before") <= F.col("_high")) & (F.col("_before") + F.col("_n") > F.col("_low"))).select(*keys, "_b", "_before")
    return join_safe(laid.drop("_before"), held, [*keys, "_b"])  # two buckets a key at most


def exact_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: exact, from (keys, value, n) with each value once.

    No task gets all values of a group: buckets by the logarithm are summed in order (a few thousand
    rows a group), then even buckets within the one that holds the middle, then only its values.
    """
    totals = values.groupBy(*keys).agg(F.sum("n").alias("_total"))
    ranks = totals.select(*keys, F.floor((F.col("_total") - 1) / 2).alias("_low"), F.floor(F.col("_total") / 2).alias("_high"), F.lit(0).cast("long").alias("_before"))
    laid = join_safe(values.select(*keys, "value", "n"), ranks, keys).withColumn("_b", log_bucket(F.col("value")))
    first = cut(_middle(laid, keys))  # the values of a bucket or two a key
    parts = [*keys, "_b"]
    span = first.groupBy(*parts).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    step = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("value") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / BUCKETS))).otherwise(0)
    second = join_safe(first, span, parts).withColumn("_outer", F.col("_b")).withColumn("_b", step.cast("long")).drop("_lo", "_hi")
    inside = cut(_middle(second, [*keys, "_outer"]))
    end = F.sum("n").over(W.partitionBy(*keys, "_outer", "_b").orderBy("value")) + F.col("_before")
    inside = inside.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("n"))
    holds = lambda rank: F.max(F.when((F.col("_start") <= F.col(rank)) & (F.col("_end") > F.col(rank)), F.col("value")))
    return inside.groupBy(*keys).agg((holds("_low") / 2 + holds("_high") / 2).alias("median"))


def profile(spark: SparkSession, tables: dict[str, tuple[str, dict]], load: str) -> DataFrame:
    """One row per table, column and load: rows, missing, unreadable, out of range, distinct values, range, median, share of the most frequent number, median of all loads' medians.

    tables: name to (path, {column: (lowest, whether it is itself allowed, highest)}).
    """
    keys = ["tbl", "col_name", "load_id"]
    parts = [readings(value_counts(spark, path, list(limits), load), limits).withColumn("tbl", F.lit(name)) for name, (path, limits) in tables.items()]
    counts = reduce(DataFrame.unionByName, parts)
    by_value = cut(counts.groupBy(*keys, "digits", "value", "in_range", "missing").agg(F.sum("n").alias("n")))
    inside = by_value.filter("in_range").groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    summary = by_value.groupBy(*keys).agg(
        F.sum("n").alias("rows_n"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("missing_n"),
        F.sum(F.when(~F.col("missing") & F.col("value").isNull(), F.col("n")).otherwise(0)).alias("unreadable_n"),
        F.sum(F.when(F.col("value").isNotNull() & ~F.col("in_range"), F.col("n")).otherwise(0)).alias("outside_n"),
        F.sum(F.when(F.col("in_range"), F.col("n")).otherwise(0)).alias("inside_n"),
        F.count(F.when(F.col("value").isNotNull(), 1)).alias("distinct_n"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.max(F.when(F.col("in_range"), F.col("n"))).alias("most_n"),
    )
    # Chunks are read outside of Spark: their counts have to come to the rows that Spark counts in each load.
    rows = [spark.read.parquet(path).groupBy(F.col(f"`{load}`").cast("string").alias("load_id")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("tbl", F.lit(name)) for name, (path, _) in tables.items()]
    summary = join_safe(summary, reduce(DataFrame.unionByName, rows), ["tbl", "load_id"], "left")
    wrong = F.raise_error(F.concat(F.lit("counts don't come to the rows of load "), F.coalesce("load_id", F.lit("NULL"))))
    summary = summary.withColumn("rows_n", F.when(F.col("rows_n") == F.col("_rows"), F.col("_rows")).otherwise(wrong.cast("bigint"))).drop("_rows")
    out = join_safe(summary, exact_medians(inside, keys), keys, "left")
    # One row per column and load from here on.
    centre = out.groupBy("tbl", "col_name").agg(F.percentile("median", F.lit(0.5)).alias("centre"))
    return out.join(F.broadcast(centre), ["tbl", "col_name"], "left")


def chunks(spark: SparkSession, tables: dict[str, tuple[str, dict]], load: str) -> DataFrame:
    """(tbl, col_name, rows_n, nulls_n, settled, dictionary, scan): what footers alone tell, and how many chunks go which way."""
    parts = [footers(spark, path, list(limits), load).withColumn("tbl", F.lit(name)) for name, (path, limits) in tables.items()]
    ways = [F.count(F.when(F.col("way") == w, 1)).alias(w) for w in ("settled", "dictionary", "scan")]
    return reduce(DataFrame.unionByName, parts).groupBy("tbl", "col_name").agg(F.sum("rows").alias("rows_n"), F.sum("nulls").alias("nulls_n"), *ways)


def outliers(profiled: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(tbl, col_name, load_id, issue) of loads that stand out."""
    s = SHARES | (shares or {})
    c = F.col
    readable = c("rows_n") - c("missing_n") - c("unreadable_n")
    tests = {
        "missing": c("missing_n") > s["missing"] * c("rows_n"),
        "unreadable": c("unreadable_n") > s["unreadable"] * (c("rows_n") - c("missing_n")),
        "range": c("outside_n") > s["range"] * readable,
        "frequent": c("most_n") > s["frequent"] * c("inside_n"),
        "shift": F.abs(c("median") - c("centre")) > s["shift"] * F.abs(c("centre")),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return profiled.select("tbl", "col_name", "load_id", F.explode(found).alias("issue"))
