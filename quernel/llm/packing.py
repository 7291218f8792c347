"""Packing items of varying length into containers of fixed capacity (problem 8).

Method: bounded-space online best-fit. A packer holds a fixed number of open bins in buckets by free
space; a bitset of the free sizes in use (one Python integer) gives the tightest bin that takes an
item in a few word operations. If none does, a new bin is opened, and where that would be one too
many the fullest bin is closed first. Each task packs what it reads, with nothing shuffled or held
but the open bins; a container never spans tasks, so a lost task is packed again alike.

Tokens are counted with a public vocabulary given by its path. Text is cut into pieces by the
vocabulary's pattern, each piece has the same number of tokens wherever it stands, so counts are
kept per piece.

Edge cases: NULL and empty texts have 0 tokens and go into a container as they come. An item is
divided only if it alone exceeds the capacity: into full containers and a rest, which is packed like
any other item. Repeated rows are packed again, each for itself. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_BINS = 64


class BestFit:
    """Bounded-space best-fit: put() gives the bin of an item."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.by_free: dict[int, list[int]] = {}
        self.used = 0  # bit f: an open bin has f free
        self.open = self.next = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            del self.by_free[free]
            self.used ^= 1 << free
        return b

    def put(self, size: int) -> int:
        fits = self.used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.used & -self.used).bit_length() - 1)  # the fullest closes
                self.open -= 1
            b, free = self.next, self.capacity
            self.next += 1
            self.open += 1
        free -= size
        if free:
            self.by_free.setdefault(free, []).append(b)
            self.used |= 1 << free
        else:
            self.open -= 1
        return b


@lru_cache(maxsize=4)
def _counter(path: str, pattern: str):
    """Counts tokens of a text by the ranks in a vocabulary file (base64 token, rank per line)."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    whole = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces, known = regex.compile(pattern), {}

    def count(text: str) -> int:
        total = 0
        for p in pieces.findall(text):
            n = known.get(p)
            if n is None:
                n = len(whole.encode_ordinary(p))
                if len(known) < 1 << 18:
                    known[p] = n
            total += n
        return total

    return count


def pack(
    df: DataFrame, row_id: str, text: str, capacity: int, vocabulary: str, pattern: str, open_bins: int = OPEN_BINS
) -> DataFrame:
    """(container, row_id, piece, first_token, tokens): where each item, or piece of one that is too large, lies."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, packer = _counter(vocabulary, pattern), BestFit(capacity, open_bins)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for pdf in it:
            out: list[tuple] = []
            for i, t in zip(pdf["id"], pdf["text"]):
                left, piece, first = count(t) if t else 0, 0, 0
                while True:
                    size = min(left, capacity)
                    b = packer.put(size)
                    # A container belongs to one task, which numbers its own.
                    out.append((f"{task}.{b}", i, piece, first, size))
                    left, piece, first = left - size, piece + 1, first + size
                    if left <= 0:
                        break
            yield pd.DataFrame(out, columns=["container", "id", "piece", "first_token", "tokens"])

    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    packed = rows.mapInPandas(run, f"container string, id {kind}, piece int, first_token bigint, tokens bigint")
    return packed.withColumnRenamed("id", row_id)
