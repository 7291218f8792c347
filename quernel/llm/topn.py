"""The N best names of every group (problem 4).

Method: sorted runs and a loser tree. Each task sorts what it reads, a bounded run at a time, by
group, score (best first) and name, and keeps of each group only the rows up to its Nth different
name: from there on it seeks to the next group. The shortened runs are shuffled into buckets by
group. A bucket merges its runs with a loser tree; after N outputs of a group every run seeks,
by binary search, to its first row of another group. A group of any size therefore reaches one
task with N names per run at most, and no group is ever held as a whole.

Edge cases: rows with a NULL group, name or score, or a NaN or infinite score, do not count. A name
counts once, with its highest score; equal scores go by the smaller UTF-8 bytes of the name; 0 and
-0 are equal. Groups with fewer names give them all. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a run: what a task sorts at a time.
RUN_ROWS = 1 << 19
#: Bytes of input for each bucket (runs are shorter than what they come from).
BUCKET_BYTES = 32 << 20
_RUN = "grp string, name string, score double, run bigint"


class LoserTree:
    """Merges sorted sources: the smallest head is on top, each inner node holds the loser of its match.

    heads: one key per source, None when it is used up.
    """

    def __init__(self, heads: list):
        self.heads, self.size = heads, max(1, len(heads))
        self.losers = [-1] * self.size
        winners = [-1] * self.size + [i if i < len(heads) else -1 for i in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            won, lost = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.losers[node] = won, lost
        self.top = winners[1] if self.size > 1 else (0 if heads else -1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a] if a >= 0 else None, self.heads[b] if b >= 0 else None
        return y is None or (x is not None and x <= y)

    def replace(self, key) -> None:
        """The top source shows its next key (None: it has no more); one match per level is replayed."""
        i = self.top
        self.heads[i] = key
        node = (i + self.size) // 2
        heads, losers = self.heads, self.losers
        while node:
            j = losers[node]
            other = heads[j] if j >= 0 else None
            mine = heads[i]
            if other is not None and (mine is None or other < mine):
                losers[node], i = i, j
            node //= 2
        self.top = i


class Run:
    """A sorted run of Arrow rows, decoded a block at a time."""

    def __init__(self, table: pa.Table, block: int = 4096):
        self.table, self.block, self.start, self.i, self.keys = table, block, 0, 0, []
        self._load(0)

    def _load(self, start: int) -> None:
        t = self.table.slice(start, self.block)
        # Python compares text by code points, which is the order of its UTF-8 bytes.
        self.keys = list(zip(t["grp"].to_pylist(), (-t["score"].to_numpy()).tolist(), t["name"].to_pylist()))
        self.start, self.i = start, 0

    def head(self) -> tuple | None:
        if self.i >= len(self.keys) and self.keys:
            self._load(self.start + len(self.keys))
        return self.keys[self.i] if self.keys else None

    def seek(self, group: str) -> None:
        """To the first row of a group behind this one."""
        while self.keys and self.keys[-1][0] == group:
            self._load(self.start + len(self.keys))
        self.i = bisect_right(self.keys, group, lo=self.i, key=lambda k: k[0])


def merge_top(runs: list[Run], n: int) -> Iterator[tuple]:
    """(group, -score, name) of the n best names of each group."""
    tree = LoserTree([r.head() for r in runs])
    group, names = None, set()
    while tree.top >= 0 and (key := tree.heads[tree.top]) is not None:
        run = runs[tree.top]
        if key[0] != group:
            group, names = key[0], set()
        if len(names) < n:
            if key[2] not in names:
                names.add(key[2])
                yield key
            run.i += 1
        else:
            run.seek(group)
        tree.replace(run.head())


def _shorten(table: pa.Table, n: int) -> pa.Table:
    """table sorted by group, score, name, without what lies behind the nth different name of a group."""
    table = table.append_column("minus", pc.negate(table["score"]))
    table = table.take(pc.sort_indices(table, sort_keys=[("grp", "ascending"), ("minus", "ascending"), ("name", "ascending")]))
    rows = table.num_rows
    if rows == 0:
        return table
    group = table["grp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    name = table["name"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    # Within a group only a name's first row, its best, can count.
    order = np.lexsort((np.arange(rows), name, group))
    first = np.zeros(rows, bool)
    first[order] = np.r_[True, (group[order][1:] != group[order][:-1]) | (name[order][1:] != name[order][:-1])]
    before = np.cumsum(first) - first  # names so far, over all groups
    start = np.r_[True, group[1:] != group[:-1]]
    rank = before - before[np.maximum.accumulate(np.where(start, np.arange(rows), 0))]
    return table.filter(pa.array(first & (rank < n)))


def _make_runs(n: int, rows: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        held, count, k = [], 0, 0

        def flush():
            nonlocal held, count, k
            t = _shorten(pa.Table.from_batches(held), n).drop_columns(["minus"]) if held else None
            held, count, k = [], 0, k + 1
            return t.append_column("run", pa.array(np.full(t.num_rows, (part << 24) + k))).to_batches() if t is not None else []

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= rows:
                yield from flush()
        yield from flush()

    return runs


def _merge(n: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        run = t["run"].to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), t.num_rows]
        runs = [Run(t.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]
        out: list[tuple] = []
        for key in merge_top(runs, n):
            out.append(key)
            if len(out) >= 1 << 16:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return merge


def _batch(keys: list[tuple]) -> pa.RecordBatch:
    g, minus, name = zip(*keys)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(name, pa.string()), pa.array(-np.array(minus) + 0.0)], ["grp", "name", "score"])


def _buckets(df: DataFrame) -> int:
    """As many buckets as keep one small, since a task merges a bucket in memory."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // BUCKET_BYTES) if size < 1 << 50 else least  # beyond: the size is not known


def top_names(df: DataFrame, group: str, name: str, score: str, n: int, run_rows: int = RUN_ROWS, buckets: int | None = None) -> DataFrame:
    """(grp, name, score): the n best names of each group."""
    s = F.col(f"`{score}`").cast("double")
    valid = df.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{name}`").cast("string").alias("name"), (s + F.lit(0.0)).alias("score")).filter(
        F.col("grp").isNotNull() & F.col("name").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    )
    runs = valid.mapInArrow(_make_runs(n, run_rows), _RUN)
    spread = runs.repartition(buckets or _buckets(df), "grp")
    # Spark's external sort brings the rows of a run together again, spilling where it must.
    return spread.sortWithinPartitions("run", "grp", F.desc("score"), "name").mapInArrow(_merge(n), "grp string, name string, score double")
