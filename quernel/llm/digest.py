"""Percentiles of very large columns from partial results that can be combined (problem 1).

Method: merging centroid digests. Sorted values are clustered under a size function that allows
large clusters in the middle and small ones at the ends (the arcsine scale); digests are merged by
clustering their centroids again, first by a salt and then by key, so that no task gets all partial
results of a large key. A second pass over the values counts how many lie below and at each
estimate, which gives the error in ranks exactly instead of trusting the digest.

A digest is rows (keys, mean, weight), so it can be stored per load or day and merged later.

Edge cases: NULL, NaN and infinite values do not count; a group without values has no digest and no
row. NULL keys are a group. Equal values share a centroid, and any rank they cover is met exactly.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.runtime import cut, join_safe

#: A digest has at most about half as many centroids.
COMPRESSION = 800
#: A centroid of more than HEAVY / compression of all values is larger than the scale lets any cluster of different values be (pi / compression).
HEAVY = 4
#: The error in ranks, as a share of the values, that a certificate grants.
RANK_ERROR = 0.005
#: Values (or centroids) that a task holds at a time.
HELD = 1 << 18
SALTS = 32
#: Keys whose marks are broadcast (some 200 bytes each); with more, values are joined by a shuffle.
BROADCAST_KEYS = 50_000


def cluster(key: np.ndarray, mean: np.ndarray, weight: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of many digests at once; key tells them apart."""
    if not len(key):
        return key, mean, weight
    order = np.lexsort((mean, key))
    key, mean, weight = key[order], mean[order], weight[order]
    # Equal values are one centroid, whatever its weight.
    new = np.r_[True, (key[1:] != key[:-1]) | (mean[1:] != mean[:-1])]
    at = np.flatnonzero(new)
    key, mean, weight = key[at], mean[at], np.add.reduceat(weight, at)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[start, len(key)])
    total = np.repeat(np.add.reduceat(weight, start), sizes)
    done = np.cumsum(weight)
    done -= np.repeat(done[start] - weight[start], sizes)
    q = np.clip((done - weight / 2) / total, 0, 1)
    unit = np.floor(compression / (2 * np.pi) * (np.arcsin(2 * q - 1) + np.pi / 2)).astype(np.int64)
    # A heavy centroid stays alone, so that it doesn't draw its neighbours to it.
    heavy = weight > HEAVY * total / compression
    edge = np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1]) | heavy[1:] | heavy[:-1]]
    at = np.flatnonzero(edge)
    w = np.add.reduceat(weight, at)
    alone = np.diff(np.r_[at, len(key)]) == 1  # stays exactly as it is
    return key[at], np.where(alone, mean[at], np.add.reduceat(mean * weight, at) / w), w


def _digesting(keys: list[str], compression: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def fold(frames: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(frames, ignore_index=True)
            if pdf.empty:
                return pdf
            grouped = pdf.groupby(keys, dropna=False, sort=False)
            number = grouped.ngroup().to_numpy()
            k, m, w = cluster(number, pdf["mean"].to_numpy(float), pdf["weight"].to_numpy(float), compression)
            first = np.full(number.max() + 1, -1)
            first[number[::-1]] = np.arange(len(number))[::-1]
            out = pdf[keys].iloc[first[k]].reset_index(drop=True)
            return out.assign(mean=m, weight=w)

        for pdf in it:
            held.append(pdf)
            rows += len(pdf)
            if rows >= HELD:
                small = fold(held)
                if len(small) > HELD // 4:  # too many keys to go on folding: pass them on
                    yield small
                    held, rows = [], 0
                else:
                    held, rows = [small], len(small)
        if held:
            yield fold(held)

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", mean double, weight double"


def digest(df: DataFrame, keys: list[str], value: str, compression: float = COMPRESSION) -> DataFrame:
    """keys, mean, weight: a digest of value for each key. Values are clustered before they are shuffled."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*keys, v.alias("mean"), F.lit(1.0).alias("weight")).filter(F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < float("inf")))
    return merge(rows.mapInPandas(_digesting(keys, compression), _schema(rows, keys)), keys, compression)


def merge(digests: DataFrame, keys: list[str], compression: float = COMPRESSION, salts: int = SALTS) -> DataFrame:
    """Digests of the same keys as one digest per key (of loads, days or partitions alike)."""
    schema = _schema(digests, keys)
    salted = digests.select(*keys, "mean", "weight", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    once = salted.repartition(*keys, "_salt").drop("_salt").mapInPandas(_digesting(keys, compression), schema)
    return once.repartition(*keys).mapInPandas(_digesting(keys, compression), schema)


def quantiles(digests: DataFrame, keys: list[str], qs: list[float], compression: float = COMPRESSION) -> DataFrame:
    """keys, q, estimate: interpolated between the centroids of each digest."""
    kept = ", ".join(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keys)

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mean", kind="stable")
        m, w = pdf["mean"].to_numpy(float), pdf["weight"].to_numpy(float)
        # A heavy centroid holds equal values and covers its whole span of ranks, any other stands in its middle.
        end = np.cumsum(w)
        half = np.where(w > HEAVY * end[-1] / compression, w / 2, 0.0)
        ranks = np.stack([end - w / 2 - half, end - w / 2 + half], 1).ravel()
        found = np.interp(np.array(qs) * end[-1], ranks, np.repeat(m, 2))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(qs) for k in keys}, "q": qs, "estimate": found})

    return digests.groupBy(*keys).applyInPandas(estimate, f"{kept}, q double, estimate double")


def certify(df: DataFrame, keys: list[str], value: str, estimates: DataFrame, bound: float = RANK_ERROR) -> DataFrame:
    """estimates with n, the values below and up to each, the error in ranks as a share of n, and whether it is within bound."""
    v = F.col(f"`{value}`").cast("double")
    values = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    marks = cut(estimates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", "estimate"))).alias("_marks")))
    # A row per key. If there are few, values stay where they are and only counts per interval are shuffled.
    if marks.count() <= BROADCAST_KEYS:
        marks = F.broadcast(marks)
    # Values are counted by the interval between marks they fall into: small, whatever the group's size.
    both = join_safe(values, marks, keys)
    below = F.aggregate("_marks", F.lit(0), lambda a, m: a + F.when(m["estimate"] < F.col("_v"), 1).otherwise(0))
    upto = F.aggregate("_marks", F.lit(0), lambda a, m: a + F.when(m["estimate"] <= F.col("_v"), 1).otherwise(0))
    counted = both.groupBy(*keys, below.alias("_over"), upto.alias("_from")).agg(F.count(F.lit(1)).alias("_n"))
    per_mark = join_safe(counted, marks, keys).select(*keys, "_over", "_from", "_n", F.posexplode("_marks").alias("_i", "_m"))
    out = per_mark.groupBy(*keys, F.col("_m.q").alias("q"), F.col("_m.estimate").alias("estimate")).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("_from") <= F.col("_i"), F.col("_n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("_over") <= F.col("_i"), F.col("_n")).otherwise(0)).alias("upto"),
    )
    rank = F.col("q") * F.col("n")
    error = F.greatest(F.col("below") - rank, rank - F.col("upto"), F.lit(0.0)) / F.col("n")
    return out.withColumn("rank_error", error).withColumn("certified", F.col("rank_error") <= F.greatest(F.lit(bound), 0.5 / F.col("n")) + 1e-9)
