"""Splits that keep what belongs together in one part (problem 7).

Method: frontier breadth-first search from many seeds. Vertices and edges are hash-partitioned
adjacency rows; what hangs together among the edges that a task reads is contracted to stars first,
so that distances are short. Every vertex that is smaller, by hash, than all its neighbours is a seed; all seeds
expand at once, a round reaching the neighbours of the last round's frontier, and a vertex that two
seeds reach goes to the smaller one. Edges whose ends went to different seeds make a graph of the
seeds, at most half as large (no two seeds are neighbours), on which the same is done again until no
edge is left. So the rounds grow with the logarithm of the largest component, not with its diameter,
and no step collects anything but a count. Components are cut into parts in the order of their
hashes, by cumulated size.

Edge cases: NULL ends make no edge, an edge to itself neither. Repeated edges count once. No edges
give no components. Records without a key are parts of their own, by their fallback key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.runtime import cut

#: Components are laid into this many buckets, in the order of their hashes, to cumulate sizes.
BUCKETS = 4096
#: Vertices that a task contracts at a time.
VERTICES = 1 << 18


def star_edges(df: DataFrame, link: str, member: str) -> DataFrame:
    """(a, b): the members of each link, each tied to the link's smallest one: as many edges as members."""
    pairs = df.select(F.col(link).alias("_k"), F.col(member).alias("b")).filter("_k is not null and b is not null").distinct()
    least = pairs.groupBy("_k").agg(F.min("b").alias("a"))
    return pairs.join(least, "_k").filter("a != b").select("a", "b").distinct()


def _stars(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b): each vertex tied to the one of least hash that it hangs together with, among VERTICES at a time."""
    up: dict = {}
    rank: dict = {}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def found() -> pd.DataFrame:
        ends = [(root(v), v) for v in up]
        return pd.DataFrame([(r, v) for r, v in ends if r != v], columns=["a", "b"])

    for pdf in it:
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"]):
            for v, h in ((a, x), (b, y)):
                if v not in up:
                    up[v] = v
                    rank[v] = (h, v)
            p, q = root(a), root(b)
            if p != q:
                p, q = (p, q) if rank[p] < rank[q] else (q, p)
                up[q] = p
        if len(up) > VERTICES:
            yield found()
            up.clear()
            rank.clear()
    if up:
        yield found()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex that has an edge; edges: (a, b)."""
    e = edges.filter("a is not null and b is not null and a != b").select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    kind = edges.schema["a"].dataType.simpleString()
    e = e.mapInPandas(_stars, f"a {kind}, b {kind}")
    both = cut(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return both.select(F.col("a").alias("v"), F.col("b").alias("root"))
    labels = cut(_expand(both))
    of_a, of_b = labels.select(F.col("v").alias("a"), F.col("root").alias("la")), labels.select(F.col("v").alias("b"), F.col("root").alias("lb"))
    collided = both.join(of_a, "a").join(of_b, "b").filter("la < lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    roots = components(collided)
    upper = roots.select(F.col("v").alias("root"), F.col("root").alias("top"))
    return labels.join(upper, "root", "left").select("v", F.coalesce("top", "root").alias("root"))


def _expand(both: DataFrame) -> DataFrame:
    """(v, root): each vertex with the seed whose frontier reached it first."""
    order = lambda c: F.struct(F.xxhash64(c), c)
    seeds = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m")).filter(order(F.col("a")) < F.col("m"))
    frontier = cut(seeds.select(F.col("a").alias("v"), F.col("a").alias("root")))
    reached = frontier
    while True:
        near = both.join(frontier.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("root").alias("root"))
        frontier = cut(near.join(reached, "v", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def split(weights: DataFrame, key: str, weight: str, parts: dict[str, float]) -> DataFrame:
    """(key, part): each key once, cut in the order of its hash so that the parts' weights come close to the proportions."""
    spread = weights.select(key, F.col(weight).alias("_w"), F.xxhash64(key).alias("_h")).withColumn("_b", F.shiftright("_h", 52))
    buckets = spread.groupBy("_b").agg(F.sum("_w").alias("_bw"))
    order = W.orderBy("_b")  # over at most BUCKETS rows
    starts = buckets.select("_b", (F.sum("_bw").over(order) - F.col("_bw")).alias("_start"), F.sum("_bw").over(W.partitionBy(F.lit(1))).alias("_all"))
    within = W.partitionBy("_b").orderBy("_h", key)
    placed = spread.join(starts, "_b").withColumn("_mid", (F.col("_start") + F.sum("_w").over(within) - F.col("_w") / 2) / F.col("_all"))
    total, edge, part = sum(parts.values()), 0.0, F.lit(list(parts)[-1])
    for name, share in reversed(list(parts.items())[:-1]):
        edge = sum(list(parts.values())[: list(parts).index(name) + 1]) / total
        part = F.when(F.col("_mid") < edge, F.lit(name)).otherwise(part)
    return placed.select(key, part.alias("part"))
