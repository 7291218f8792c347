"""Evaluation texts inside training pages (problem 9).

Method: size-partitioned MinHash containment search, verified exactly. Items are cut into passages
of the length that counts as a leak, pages into overlapping windows twice as long. Windows keep the
shingles that any passage has (no other can add to containment), are partitioned by how many they
keep, and each partition gets the rows per band that its sizes call for. Passages and windows that
agree in a band are candidates; a candidate is kept where the exact share of the passage's shingles
that the window holds is high enough. A kept pair of page and item is then read word by word: a run
of item words may go on over line ends, words broken there, words run together or misread, and over
whole lines set in between.

Pages are read in the order of their columns (quernel.llm.reading), words in a form that counts
letters as one where scanners take them for one another.

The items are the stated query set. They are used in blocks of a fixed size, each one pass over the
pages, so what is broadcast never grows with their number. Pages stay where they are but for one
shuffle that brings their boxes to them.

Edge cases: NULL or empty texts of pages or items give nothing; items shorter than a leak can't
leak. Pages without boxes are read in the order of their lines. Repeated rows give one pair. Empty
tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.reading import BREAKS, fold, reading_order
from quernel.runtime import cut

#: Words in a row that make a leak, words of a shingle.
RUN, SHINGLE = 15, 3
#: Shingles of a passage.
SPAN = RUN - SHINGLE + 1
#: Hash functions, and the share of a passage's shingles that a window has to hold.
#: (Three words and this share, as broken and misread words count as printed: of longer shingles too few survive.)
HASHES, CONTAINED = 60, 0.6
NEEDED = math.ceil(CONTAINED * SPAN - 1e-9)
#: Characters of items that are broadcast at a time (their tables take some 100 bytes a character in each worker).
BLOCK_CHARS = 1_000_000
#: Lines in a row that may be set in between the lines of a passage; more of them are an article of their own.
SET_IN = 12
#: Words of a run that a candidate window holds at least; and lines before and after it that are read word by word as well: it
#: lacks no more words of a passage than those leave, each may stand on a line of its own, and something may be set in on the way.
CORE = NEEDED + SHINGLE - 1
MARGIN = SET_IN + RUN - CORE
#: Pages that a task looks up at a time.
PAGES = 200


# ---------------------------------------------------------------- words


class Folds(dict):
    """Words to their folded letters, kept for words seen before."""

    KEPT = 1 << 18

    def __missing__(self, word: str) -> str:
        f = fold(word)
        if len(self) < self.KEPT:
            self[word] = f
        return f


class Hashes(Folds):
    """Words to the hash of their folded letters; 0 where there are none."""

    def __missing__(self, word: str) -> int:
        f = fold(word)
        h = xxhash.xxh64_intdigest(f) | 1 if f else 0
        if len(self) < self.KEPT:
            self[word] = h
        return h


def _hashed(words: list[str], hashes: Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


class Seen:
    """A sorted array of hashes, with bits that tell most others apart by one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(16, int(len(keys) * 16).bit_length()))
        self.bits = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.bits[self._bit(keys)] = True

    def _bit(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of x are there, where the first of each stands)"""
        maybe = np.flatnonzero(self.bits[self._bit(x)])
        maybe = maybe[np.argsort(x[maybe])]  # neighbours in the array are looked up together
        at = np.searchsorted(self.keys, x[maybe])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == x[maybe]
        place = np.full(len(x), -1)
        place[maybe[same]] = at[same]
        found = np.flatnonzero(place >= 0)
        return found, place[found]


def _once(x: np.ndarray) -> np.ndarray:
    """The different values in order."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of SHINGLE words in a row."""
    if len(h) < SHINGLE:
        return h[:0]
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i]
    return out ^ (out >> np.uint64(29))


_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def _minhash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES minima for each set; sets are values[starts[i]:starts[i + 1]], none of them empty."""
    out = np.empty((len(starts), HASHES), np.uint64)
    for k, seed in enumerate(_SEEDS):
        v = values * seed
        v ^= v >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(v * seed, starts)
    return out


def rows_per_band(size: int, query: int) -> int:
    """For windows that keep `size` shingles: the most rows at which a pair at the least containment is found with 98 % or more."""
    least = max(1.0, CONTAINED * query)
    j = least / (query + size - least) if size >= least else 0.0
    return next((r for r in (4, 3, 2) if 1 - (1 - j**r) ** (HASHES // r) >= 0.98), 1)


#: Partitions by the number of kept shingles.
SIZES = (8, 12, 18, 1 << 30)


def _bands(sig: np.ndarray, r: int) -> np.ndarray:
    """Band hashes, one column per band."""
    used = sig[:, : HASHES // r * r].reshape(len(sig), -1, r)
    out = np.zeros(used.shape[:2], np.uint64)
    for i in range(r):
        out = (out ^ used[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
    return out + np.arange(out.shape[1], dtype=np.uint64)[None, :]


# ---------------------------------------------------------------- items


class Items:
    """A block of items: their shingles, the bands of their passages, and the words for reading."""

    def __init__(self, rows: list[tuple]):
        hashes = Hashes()
        self.ids = [r[0] for r in rows]
        self.raw = [[w for w in (r[1] or "").split() if hashes[w]] for r in rows]
        self.words = [[fold(w) for w in ws] for ws in self.raw]
        self.index = [word_index(ws) for ws in self.words]
        sets = [_shingles(_hashed(ws, hashes)) if len(ws) >= RUN else np.zeros(0, np.uint64) for ws in self.raw]
        self.lengths = np.array([len(x) for x in sets], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.universe, self.places = np.unique(flat, return_inverse=True)
        self.tables: dict[int, tuple[Seen, np.ndarray, np.ndarray]] = {}
        if not len(flat):
            return
        self.known = Seen(self.universe)
        begins = np.concatenate([np.arange(a, a + n - SPAN + 1) for a, n in zip(self.starts.tolist(), self.lengths.tolist()) if n])
        owner = np.repeat(np.arange(len(sets)), np.maximum(0, self.lengths - SPAN + 1))
        # The different shingles that a window has in common with an item at least, if it holds enough of one of its passages.
        order = np.lexsort((np.arange(len(flat)), flat))
        earlier = np.full(len(flat), -1)
        same = flat[order][1:] == flat[order][:-1]
        earlier[order[1:][same]] = order[:-1][same]
        repeats = sum((earlier[begins + j] >= begins).astype(np.int64) for j in range(SPAN))
        self.least = np.full(len(sets), 1 << 30)
        np.minimum.at(self.least, owner, np.maximum(1, NEEDED - repeats))
        # Item and shingle pairs as bits: what is not there is told by one look.
        self.bits = max(16, int(len(flat) * 16).bit_length())
        self.member = np.zeros(1 << self.bits, bool)
        self.member[self._bit(np.repeat(np.arange(len(sets)), self.lengths), self.places)] = True
        sig = _minhash(flat, np.arange(len(flat)))
        for step in (1, 2, 4, 5):  # the minima of 1 + 1, + 2, + 4, + 5 = SPAN shingles in a row
            sig[:-step] = np.minimum(sig[:-step], sig[step:])
        sig = sig[begins]
        for r in {rows_per_band(min(s, 2 * RUN), SPAN) for s in SIZES}:
            b = _bands(sig, r)
            keys, owners = b.ravel(), np.repeat(owner, b.shape[1])
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            once = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]
            keys, owners = keys[once], owners[once]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.tables[r] = Seen(keys[first]), np.r_[first, len(keys)], owners

    def _bit(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        x = item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return x >> np.uint64(64 - self.bits)

    def candidates(self, values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a band and where the window holds enough of a passage of the item.

        Window k holds the places values[begins[k] : begins[k] + sizes[k]] of the universe.
        """
        if not len(begins):
            return begins, begins
        at = _spread(begins, sizes)
        sig = _minhash(self.universe[values[at]], np.cumsum(sizes) - sizes)
        held = _once(np.repeat(np.arange(len(begins)), sizes) * len(self.universe) + values[at])
        out: list[np.ndarray] = []
        low = 0
        for high in SIZES:
            of_size = np.flatnonzero((sizes > low) & (sizes <= high))
            r = rows_per_band(min(high, 2 * RUN), SPAN)
            low = high
            seen, firsts, owners = self.tables[r]
            for c in range(0, len(of_size), 1 << 12):
                some = of_size[c : c + (1 << 12)]
                b = _bands(sig[some], r)
                hit, key = seen.find(b.ravel())
                pairs = _once(np.repeat(some[hit // b.shape[1]], firsts[key + 1] - firsts[key]) * len(self.ids) + owners[_spread(firsts[key], firsts[key + 1] - firsts[key])])
                out.append(self._enough(*np.divmod(pairs, len(self.ids)), values, begins, sizes, held))
        return np.divmod(_once(np.concatenate(out)), len(self.ids))

    def _enough(self, w: np.ndarray, i: np.ndarray, places: np.ndarray, begins: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
        """window * items + item of the pairs where the window holds NEEDED of SPAN shingles in a row of the item."""
        kept = []
        for c in range(0, len(w), 1 << 15):
            x, y = w[c : c + (1 << 15)], i[c : c + (1 << 15)]
            bits = self.member[self._bit(np.repeat(y, sizes[x]), places[_spread(begins[x], sizes[x])])]
            common = np.add.reduceat(bits, np.cumsum(sizes[x]) - sizes[x], dtype=np.int64)
            on = common >= self.least[y]
            x, y = x[on], y[on]
            if not len(x):
                continue
            n = self.lengths[y]
            code = np.repeat(x, n) * len(self.universe) + self.places[_spread(self.starts[y], n)]
            at = np.searchsorted(held, code)
            at[at == len(held)] = 0
            sums = np.r_[0, np.cumsum(held[at] == code)]
            first = np.cumsum(n) - n
            best = np.maximum.reduceat(sums[_spread(first + SPAN, n - SPAN + 1)] - sums[_spread(first, n - SPAN + 1)], np.cumsum(n - SPAN + 1) - (n - SPAN + 1))
            kept.append((x * len(self.ids) + y)[best >= NEEDED])
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    if not len(n):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


# ---------------------------------------------------------------- pages


def _page_words(lines: list[list[str]]) -> tuple[list[str], list[int]]:
    """The words of a page, those with a break mark at a line's end joined, and how many begin in each line."""
    words: list[str] = []
    counts: list[int] = []
    held = ""
    for ws in lines:
        if held:
            ws = [held + ws[0], *ws[1:]]
            held = ""
        last = ws[-1]
        if last[-1] in BREAKS and len(last) > 1:
            held = last[:-1]
            ws = ws[:-1]
        words += ws
        counts.append(len(ws))
    if held:
        words.append(held)
        counts[-1] += 1
    return words, counts


def _windows(h: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of 2 * RUN words, within pages, that keep enough of the passages' shingles to matter.

    h: hashes of the words of all pages, page p ending before ends[p]. Gives the places of the kept
    shingles in the universe, and of each window its first kept one, how many it has, and its first word.
    """
    sh = _shingles(h)
    page = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = page[: len(sh)] == page[SHINGLE - 1 :]
    kept, places = items.known.find(sh)
    inside = whole[kept]
    kept, places = kept[inside], places[inside]
    begins = np.r_[0, ends[:-1]]
    firsts = np.concatenate([np.arange(a, max(a + 1, z - RUN), RUN) for a, z in zip(begins.tolist(), ends.tolist())]) if len(ends) else begins
    last = np.minimum(firsts + (2 * RUN - SHINGLE + 1), ends[np.searchsorted(ends, firsts, side="right")])
    x, y = np.searchsorted(kept, firsts), np.searchsorted(kept, last)
    on = y - x >= NEEDED
    return places, x[on], (y - x)[on], firsts[on]


class _Near(dict):
    """Whether two folded words are the same but for a letter or two, kept for pairs seen before."""

    def __missing__(self, pair: tuple[str, str]) -> bool:
        got = _alike(*pair)
        if len(self) < 1 << 18:
            self[pair] = got
        return got


_NEAR = _Near()


def _near(a: str, b: str) -> bool:
    return a == b or (abs(len(a) - len(b)) <= 3 and _NEAR[a, b])


def _alike(a: str, b: str) -> bool:
    n = max(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 7 else 2 if n < 11 else 3
    if abs(len(a) - len(b)) > most:
        return False
    i, x, y = 0, len(a), len(b)
    while i < x and i < y and a[i] == b[i]:
        i += 1
    while x > i and y > i and a[x - 1] == b[y - 1]:
        x -= 1
        y -= 1
    a, b = a[i:x], b[i:y]
    if max(len(a), len(b)) <= most:
        return True
    if most < 2 or not a or not b:  # one edit lies between what both begin and end with
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _short_near(a: str, b: str) -> bool:
    """Whether two words of two or three letters differ in one of them (one of them may have a letter less)."""
    x, y = len(a), len(b)
    if x > y:
        a, b, x, y = b, a, y, x
    if not 1 < y < 4 or y - x > 1:
        return False
    if x == y:
        return sum([c != d for c, d in zip(a, b)]) <= 1
    return any(b[:k] + b[k + 1 :] == a for k in range(y))


def word_index(item: list[str]) -> tuple[dict[str, list[int]], dict[str, int]]:
    """Where each word of an item stands, and each two neighbours run together."""
    where: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        where.setdefault(w, []).append(i)
    return where, {item[i] + item[i + 1]: i for i in range(len(item) - 1)}


def longest_run(item: list[str], lines: list[list[tuple[str, str]]], enough: int = 1 << 30, index: tuple | None = None) -> int:
    """Words of item that the page carries in a row; lines: (folded, written) words in reading order.

    A state is the next item word awaited; its value the words carried so far. States at the end of a
    line go on at the beginning of the next one, and from two words on also behind SET_IN lines.
    A short word a letter off counts where the run goes on behind it, as it may as well be another word.
    """
    n = len(item)
    where, joined = index or word_index(item)
    # Per line: states, and states with a word begun, (awaited, begun) -> words; both again as far as set-in lines may follow.
    ends: list[tuple[dict, dict, list, list]] = []
    best = 0
    for line in lines:
        states: dict[int, int] = {}
        begun: dict[tuple[int, str], int] = {}
        if ends:
            states, begun = dict(ends[-1][0]), dict(ends[-1][1])
        for _, _, s, b in ends[-1 - SET_IN : -1]:
            for i, r in s:
                if r > states.get(i, 0):
                    states[i] = r
            for k, r in b:
                if r > begun.get(k, 0):
                    begun[k] = r
        last, opened = len(line) - 1, {}
        skip: dict[int, int] = {}  # states that a word read in two takes effect one word later
        for k, (f, raw) in enumerate(line):
            new: dict[int, int] = skip
            skip = {}
            unsure: dict[int, int] = {}
            if k == 0:
                for (i, head), r in begun.items():
                    if _near(fold(head + raw), item[i]) and r + 1 > new.get(i + 1, 0):
                        new[i + 1] = r + 1
            for i in where.get(f, ()):
                r = states.get(i, 0) + 1
                if r > new.get(i + 1, 0):
                    new[i + 1] = r
            if f in joined:
                i = joined[f]
                r = states.get(i, 0) + 2
                if r > new.get(i + 2, 0):
                    new[i + 2] = r
            for i, r in states.items():
                if i >= n or r < 3:
                    continue
                if item[i] != f:
                    if _near(f, item[i]):
                        if r + 1 > new.get(i + 1, 0):
                            new[i + 1] = r + 1
                    elif i + 1 < n and len(f) > len(item[i]) and _near(f, item[i] + item[i + 1]):
                        if r + 2 > new.get(i + 2, 0):
                            new[i + 2] = r + 2
                    elif k < last and len(f) < len(item[i]) and _near(fold(raw + line[k + 1][1]), item[i]):
                        if r + 1 > skip.get(i + 1, 0):
                            skip[i + 1] = r + 1
                    if len(item[i]) < 4 and r + 1 > new.get(i + 1, 0) and _short_near(f, item[i]):
                        unsure[i + 1] = r + 1
                    if not f and r > new.get(i, 0):  # a mark that is no word
                        new[i] = r
            if k == last:
                head = raw.rstrip(BREAKS + " ")
                part = fold(head)
                for i, r in states.items() if part else ():
                    if i < n and len(part) <= len(item[i]) and (item[i].startswith(part) or (r >= 3 and len(part) > 3 and _near(part, item[i][: len(part)]))):
                        if r > opened.get((i, head), -1):
                            opened[i, head] = r
            if new:
                m = max(new.values())
                if m > best:
                    best = m
                    if best >= enough:
                        return best
            for i, r in unsure.items():
                if r > new.get(i, 0):
                    new[i] = r
            states = new
        ends.append((states, opened, [x for x in states.items() if x[1] > 1], [x for x in opened.items() if x[1] > 1]))
        if len(ends) > SET_IN + 2:
            ends[-SET_IN - 3] = ({}, {}, [], [])
    return best


def leaks(pages: list[tuple], items: Items, hashes: Hashes, folds: Folds) -> list[tuple]:
    """(page, item) ids of the leaks in a batch of pages (id, text, boxes)."""
    if not items.tables:
        return []
    read: list[tuple] = []
    words: list[str] = []
    counts: list[int] = []
    ends: list[int] = []
    for page, text, boxes in pages:
        lines = [ws for line in reading_order(text, boxes) if (ws := line.split())] if text else []
        if not lines:
            continue
        some, n = _page_words(lines)
        read.append((page, lines, len(counts)))
        words += some
        counts += n
        ends.append(len(words))
    if not read:
        return []
    h = _hashed(words, hashes)
    real = h != 0
    line = np.repeat(np.arange(len(counts)), counts)[real]
    ends_real = np.r_[0, np.cumsum(real)][np.array(ends)]
    h = h[real]
    if len(h) < SHINGLE:
        return []
    kept = np.diff(ends_real, prepend=0) > 0
    read, ends_real = [r for r, k in zip(read, kept) if k], ends_real[kept]
    places, begins, sizes, firsts = _windows(h, ends_real, items)
    window, item = items.candidates(places, begins, sizes)
    first = firsts[window]
    of = np.searchsorted(ends_real, first, side="right")
    last = line[np.minimum(first + 2 * RUN, ends_real[of]) - 1]
    cores: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, i, a, z in zip(of.tolist(), item.tolist(), line[first].tolist(), last.tolist()):
        start = read[k][2]
        cores.setdefault((k, i), []).append((a - start, z - start + 1))
    written: dict[tuple[int, int], list] = {}

    def run(k: int, i: int, a: int, z: int, enough: int) -> bool:
        lines = read[k][1]
        for n in range(a, z):
            if (k, n) not in written:
                written[k, n] = [(folds[w], w) for w in lines[n]]
        return longest_run(items.words[i], [written[k, n] for n in range(a, z)], enough, items.index[i]) >= enough

    out = []
    for (k, i), parts in cores.items():
        # What a window holds of a run has so many words by itself; then the lines around it are read as well.
        parts = [p for p in parts if run(k, i, *p, CORE)]
        spans: list[list[int]] = []
        for a, z in parts:
            a, z = max(0, a - MARGIN), min(len(read[k][1]), z + MARGIN)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = z
            else:
                spans.append([a, z])
        if any(run(k, i, a, z, RUN) for a, z in spans):
            out.append((read[k][0], items.ids[i]))
    return out


def find(pages: DataFrame, row_id: str, text: str, boxes: DataFrame, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(row_id, item_id) of every page that carries a leak; boxes: (row_id, line_no, x0, y0, x1, y1)."""
    spark = pages.sparkSession
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = 1 + size // BLOCK_CHARS
    flat = boxes.select(F.col(row_id).alias("_id"), F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in ("line_no", "x0", "y0", "x1", "y1")]).alias("_b"))
    flat = flat.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.flatten(F.collect_list("_b")).alias("_boxes"))
    rows = pages.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).filter("_text != ''").join(flat, "_id", "left")
    kind = pages.schema[row_id].dataType.simpleString()
    kinds = f"id {kind}, item {items.schema[item_id].dataType.simpleString()}"
    if blocks > 1:
        # Boxes are joined and pages put in order once; every block of items then reads the ordered pages.
        rows = cut(rows.mapInPandas(_ordered, f"_id {kind}, _text string")).withColumn("_boxes", F.lit(None).cast("array<int>"))
    out = None
    for b in range(blocks):
        part = items.filter(F.col(item_text).isNotNull() & (F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)).select(item_id, item_text).collect()
        given, name = spark.sparkContext.broadcast([tuple(r) for r in sorted(part)]), uuid.uuid4().hex

        def run(it: Iterator[pd.DataFrame], given=given, name=name) -> Iterator[pd.DataFrame]:
            block, hashes, folds = _prepared(name, given)
            for pdf in it:
                for a in range(0, len(pdf), PAGES):
                    part = pdf.iloc[a : a + PAGES]
                    yield pd.DataFrame(leaks(list(zip(part["_id"], part["_text"], part["_boxes"])), block, hashes, folds), columns=["id", "item"])

        one = rows.mapInPandas(run, kinds)
        out = one if out is None else out.unionByName(one)
    return out.distinct().select(F.col("id").alias(row_id), F.col("item").alias(item_id))


def _ordered(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with their lines in reading order."""
    for pdf in it:
        yield pd.DataFrame({"_id": pdf["_id"], "_text": ["\n".join(reading_order(t, b)) for t, b in zip(pdf["_text"], pdf["_boxes"])]})


_PREPARED: dict[str, tuple[Items, Hashes, Folds]] = {}


def _prepared(name: str, given) -> tuple[Items, Hashes, Folds]:
    """The tables of a block, made once by each worker and kept until it gets another block."""
    if name not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name] = Items(given.value), Hashes(), Folds()
    return _PREPARED[name]
