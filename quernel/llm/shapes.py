"""Pages made of repeated keywords, link addresses or product tags (problem 10).

Method: line shapes. A page's lines are cut at wide gaps and each piece is reduced to a shape: its
words, its shares of capitals, separators, links, tags and figures, of connectors (the short words
that hold a sentence together) and of words that the page repeats close by, each as a level. Pieces
are grouped by shape. Some shapes are no sentences: links or tags with hardly a connector, and
repeated words with hardly a connector and no figure. A page is flagged where a few of those shapes
carry most of its words. Reports, songs and price lists have connectors or figures, whatever they
repeat.

No list of words is used. A connector is a short word in lower case, unless there are only a few
different ones of them around: prose of any language mixes many, "new tea, new hats" has one. A word
is repeated if it comes again within NEAR words, so that neither the length of a page nor the number
of its keywords matters.

Pages are independent rows: nothing is shuffled. Whole texts are read, whatever their length.

Edge cases: NULL, empty and blank texts have no words and are not flagged. Repeated rows are judged
each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = re.compile(r"://|^w\w?w\.|\S/\S+/\S|[^\W\d_][\w-]*[.,][^\W\d_]{2,}/|^[\w-]{3,}\.[^\W\d_]{2,}\W*$|^(?:[\w-]+\.){2,}\w{2,}", re.I)
TAG = re.compile(r"^\W*#\w|^[|]+$|\w\(\d+\)\W*$|^\d+/\d+\W*$")
GAP = re.compile(r"\s{2,}|\t")
EDGES = ".,;:!?\"'()[]-=¬—~»«„“”’"
#: Letters that scanners take for one another, by the one they are counted as.
LOOKALIKE = str.maketrans("0eca1ijtfſ5bh6nuyrq9x", "oooollllls" + "s" + "nnnn" + "vvv" + "ggk")
#: Letters of a connector at most.
SHORT = 3
#: In BLOCK words, FEW short words that make up this share of all short ones are no connectors.
BLOCK, FEW, DOMINANT = 60, 3, 0.85
#: A word is repeated if it comes again within so many words.
NEAR = 120
#: A page is flagged if not more than SHAPES shapes that are no sentences carry more than MOST of its words. Misread and broken
#: pieces of a list are missed more often than sentences are taken for one, so that a little less than one half is counted for
#: it. (Of 10,000 pages every one counts up to 0.41 or from 0.51 on, with 16 shapes at most.)
SHAPES, MOST = 24, 0.46


#: Counts of a piece are summed side by side in one number, each in so many bits: capitals, separators, links, tags, figures,
#: connectors, repeated words.
BITS = 32
CONNECTOR, REPEATED = 1 << 5 * BITS, 1 << 6 * BITS


class Words(dict):
    """(folded letters, folded short word or "", counts side by side) of a word, kept for words seen before."""

    KEPT = 1 << 18

    def __missing__(self, word: str) -> tuple[str, str, int]:
        link, tag = bool(LINK.search(word)), bool(TAG.search(word))
        bare = word.strip(EDGES)
        letters = "".join([c for c in word.lower() if c.isalpha()]).translate(LOOKALIKE)
        short = not link and not tag and 0 < len(bare) <= SHORT and bare.isalpha() and bare == bare.lower()
        digits = sum([c.isdigit() for c in bare])
        figure = not link and not tag and digits > 0 and 2 * digits >= len(bare)
        seps = word.count(",") + word.count(";") + word.count("|") + word.count("#")
        counts = sum([int(x) << k * BITS for k, x in enumerate((word[:1].isupper(), seps, link, tag, figure))])
        got = letters, letters if short else "", counts
        if len(self) < self.KEPT:
            self[word] = got
        return got


def _connectors(flat: list[tuple]) -> list[bool]:
    """Which words hold sentences together: short ones, unless a few make up nearly all short words around."""
    out = [False] * len(flat)
    few = FEW * min(len(flat), BLOCK) // BLOCK
    for a in range(0, len(flat), BLOCK):
        first = max(0, min(a, len(flat) - BLOCK))  # the last block is as long as the others
        around = [w[1] for w in flat[first : first + BLOCK] if w[1]]
        most = Counter(around).most_common(few) if few and around else ()
        ordinary = {k for k, _ in most} if most and sum([n for _, n in most]) >= DOMINANT * len(around) else ()
        for i in range(a, min(a + BLOCK, len(flat))):
            w = flat[i][1]
            out[i] = w != "" and w not in ordinary
    return out


def _repeated(flat: list[tuple], connectors: list[bool]) -> list[bool]:
    out = [False] * len(flat)
    last: dict[str, int] = {}
    for i, (w, c) in enumerate(zip(flat, connectors)):
        f = w[0]
        if c or not f:
            continue
        j = last.get(f)
        if j is not None and i - j <= NEAR:
            out[i] = out[j] = True
        last[f] = i
    return out


def _level(part: int, words: int) -> int:
    """None, up to a fifth, a quarter, a half, or more of the words."""
    return 0 if not part else 1 if 5 * part <= words else 2 if 4 * part <= words else 3 if 2 * part < words else 4


def shapes(text: str, words: Words) -> Counter:
    """Words of the page by shape: (words, and levels of capitals, separators, links, tags, figures, connectors, repeated words)."""
    pieces = [
        [words[w] for w in ws]
        for line in text.split("\n")
        for p in (GAP.split(line) if "  " in line or "\t" in line else (line,))
        if (ws := p.split())
    ]
    flat = [w for p in pieces for w in p]
    connectors = _connectors(flat)
    repeated = _repeated(flat, connectors)
    counts = [w[2] + (CONNECTOR if c else REPEATED if r else 0) for w, c, r in zip(flat, connectors, repeated)]
    out: Counter = Counter()
    at = 0
    for p in pieces:
        n = len(p)
        out[_shape(n, sum(counts[at : at + n]))] += n
        at += n
    return out


@lru_cache(maxsize=1 << 16)
def _shape(n: int, counts: int) -> tuple:
    parts = [counts >> k * BITS & (1 << BITS) - 1 for k in range(7)]
    return (min(n.bit_length(), 5), *[_level(x, n) for x in parts[:3]], 10 * parts[3] >= 3 * n, *[_level(x, n) for x in parts[4:]])


def no_sentence(shape: tuple) -> bool:
    """Whether a shape is one of links, tags or repeated keywords."""
    _, _, _, links, tags, figures, connectors, repeated = shape
    if links or tags:
        return connectors <= 2
    return connectors <= 1 and repeated == 4 and not figures


def judge(text: str | None, words: Words) -> tuple[int, int, int]:
    """(words, words in shapes that are no sentences, the fewest such shapes that carry most of the page or else all) of a page."""
    found = shapes(text, words) if text else Counter()
    total = sum(found.values())
    listed = sorted([n for s, n in found.items() if no_sentence(s)], reverse=True)
    carried = few = 0
    for n in listed:
        carried, few = carried + n, few + 1
        if carried > MOST * total:
            break
    return total, sum(listed), few


def judge_pages(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, words, listed, shapes, flagged): one row per page."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in it:
            got = pd.DataFrame([judge(t, words) for t in pdf["text"]], columns=["words", "listed", "shapes"])
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), **{c: got[c].to_numpy() for c in got}})

    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, words bigint, listed bigint, shapes bigint")
    flagged = (F.col("listed") > MOST * F.col("words")) & (F.col("shapes") <= SHAPES)
    return out.select(F.col("id").alias(row_id), "words", "listed", "shapes", flagged.alias("flagged"))
