"""Filling cells without a usable value from the other fields (problem 3).

Method: chained equations. A linear model of the numeric field and a Bayes classifier of each
categorical field are fitted from all other fields, every round with the cells that the models of
the round before filled. A round is one pass over the table: partitions emit sufficient statistics
(a Gram matrix, class-by-bin counts) whose size depends on the classes alone, Spark adds them up and
the driver solves. Fills are a function of the row and the models, so nothing is cached or iterated
on in data. Fills are drawn, not set to the mean: prediction plus residual noise, or a class by its
probability, from a hash of the record's id, so a repeated run fills alike.

Every spelling is a class of its own, unless it is a letter or two off one that is far more frequent:
then it trains that class, and is kept as written. The CLASSES most frequent ones are told apart by the
models; all others are one class more, and a cell that draws it gets one of their values.

Edge cases: a cell without value is NULL, NaN, blank, a word for "not known" or out of bounds. It is
marked in <field>_filled where it was given a value; only if no record at all has one does it stay NULL,
not marked. Rows that occur again are filled alike. Spellings differing in case and blanks are one.
Extra columns pass through; a clashing mark gets a "_" appended.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.runtime import fresh_name

#: Letters of entries that only say that nothing is known, in lower case.
UNKNOWN = (
    "", "na", "nan", "nil", "none", "null", "nd", "nk", "tba", "tbc", "tbd", "unk", "unkn", "unknown", "missing", "blank", "empty",
    "notknown", "notrecorded", "notavailable", "notapplicable", "notstated", "notreported", "notgiven", "notspecified", "notasked",
    "norecord", "nodata", "noinformation", "noinfo", "noanswer", "noentry", "unspecified", "unrecorded", "unavailable", "undefined", "undetermined", "unstated",
)
#: Classes that models tell apart, and those with a coefficient of their own in a regression (most frequent first).
CLASSES, COEFFICIENTS = 500, 64
#: Values kept for cells that draw a class beyond those.
RARE = 4096
#: A spelling that is near one at least so many times as frequent is a misspelling; longer texts have none.
RATIO, SPELLED = 20, 64
ROUNDS = 3


@dataclass(frozen=True)
class Plan:
    """What to fill, and from what."""

    row_id: str
    numeric: dict[str, tuple[float, float]]  # field: bounds of usable values
    categorical: tuple[str, ...]
    by_number: tuple[str, ...] = ()
    by_class: tuple[str, ...] = ()
    by_time: tuple[str, ...] = ()
    rounds: int = ROUNDS
    nouns: tuple[str, ...] = field(default=("site", "status", "smoker", "smoking", "value"))


SUBJECTS = Plan("rec_id", {"bmi": (10.0, 80.0)}, ("smoker_status", "site"), by_number=("age",), by_class=("sex",), by_time=("enrolled_on",))


def says_nothing(c: Column, nouns: tuple[str, ...]) -> Column:
    """Whether a text is NULL, blank, without a letter or digit, or only says that nothing is known."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    bare = F.regexp_replace(letters, f"(?<=.)({'|'.join(nouns)})+$", "")
    return c.isNull() | letters.isin(*UNKNOWN) | bare.isin(*UNKNOWN)


def _spelling(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _inputs(df: DataFrame, plan: Plan) -> dict[str, Column]:
    """The internal columns: numbers, spellings (NULL where missing) and draws."""
    cols: dict[str, Column] = {}
    for f, (low, high) in plan.numeric.items():
        v = F.col(f"`{f}`").cast("double")
        cols["n_" + f] = F.when(v.between(low, high) & ~F.isnan(v), v)
    for f in plan.categorical:
        c = F.col(f"`{f}`")
        cols["c_" + f] = F.when(~says_nothing(c, plan.nouns), _spelling(c))
    for f in plan.by_class:
        cols["c_" + f] = _spelling(F.col(f"`{f}`").cast("string"))
    for f in plan.by_number:
        v = F.col(f"`{f}`").cast("double")
        cols["n_" + f] = F.when(~F.isnan(v) & (F.abs(v) < 1e12), v)
    for f in plan.by_time:
        cols["n_" + f] = F.unix_timestamp(F.col(f"`{f}`").cast("timestamp")).cast("double") / 86400.0
    for f in [*plan.numeric, *plan.categorical]:
        cols["u_" + f] = (F.xxhash64(F.col(f"`{plan.row_id}`"), F.lit(f)).bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / float(1 << 52)
    return cols


def _distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _shortened(text: str, most: int) -> set[str]:
    """text without up to `most` letters."""
    found = layer = {text}
    for _ in range(most):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        found = found | layer
    return found


class _Speller:
    """Finds the class that a spelling is near to; texts with other figures are never near."""

    def __init__(self):
        self.names: list[str] = []
        self.index: dict[str, list[int]] = {}

    def add(self, name: str) -> None:
        if len(name) <= SPELLED:
            for v in _shortened(name, 2):
                self.index.setdefault(v, []).append(len(self.names))
        self.names.append(name)

    def nearest(self, text: str) -> int:
        """The place of the class, or -1."""
        if len(text) > SPELLED:
            return -1
        most = 1 if len(text) < 6 else 2
        near = {i for v in _shortened(text, most) for i in self.index.get(v, ())}
        figures = re.sub(r"\D", "", text)
        best = min(((_distance(text, self.names[i], most), i) for i in near if re.sub(r"\D", "", self.names[i]) == figures), default=(most + 1, -1))
        return best[1] if best[0] <= most else -1


class _Coder:
    """Turns a batch into arrays, cells filled by the models so far."""

    def __init__(self, plan: Plan, classes: dict[str, list[str]], rare: dict[str, list[str]], centre: dict[str, tuple[float, float]], models: list[dict]):
        self.plan, self.classes, self.rare, self.centre, self.models = plan, classes, rare, centre, models
        self.seen: dict[tuple[str, str], int] = {}
        self.spellers: dict[str, _Speller] = {}

    def count(self, f: str) -> int:
        """Classes of a field, that of the rare values included."""
        return len(self.classes[f]) + bool(self.rare.get(f))

    def code(self, f: str, s: pd.Series) -> np.ndarray:
        if f not in self.spellers:
            self.spellers[f] = _Speller()
            for i, name in enumerate(self.classes[f]):
                self.spellers[f].add(name)
                self.seen[f, name] = i
        codes, values = pd.factorize(s)
        out = np.full(len(values) + 1, -1)
        for i, v in enumerate(values):
            if (f, v) not in self.seen:
                near = self.spellers[f].nearest(v)
                self.seen[f, v] = near if near >= 0 or not self.rare.get(f) else len(self.classes[f])
            out[i] = self.seen[f, v]
        return out[codes]

    def arrays(self, pdf: pd.DataFrame) -> tuple[dict, dict]:
        p = self.plan
        num = {f: pdf["n_" + f].to_numpy(float) for f in (*p.numeric, *p.by_number, *p.by_time)}
        cat = {f: self.code(f, pdf["c_" + f]) for f in (*p.categorical, *p.by_class)}
        lost = {f: pdf["c_" + f].isna().to_numpy() for f in p.categorical} | {f: np.isnan(num[f]) for f in p.numeric}
        self.lost = lost
        for model in self.models:
            num, cat = self.fill(model, num, cat, lost, pdf)
        return num, cat

    def design(self, f: str, num: dict, cat: dict) -> np.ndarray:
        n = len(next(iter(num.values()))) if num else len(next(iter(cat.values())))
        cols = [np.ones(n)]
        for g in num:
            if g != f:
                mean, sd = self.centre[g]
                z = np.nan_to_num((num[g] - mean) / sd)
                cols += [z, z * z]
        for g in cat:
            cols += [(cat[g] == k).astype(float) for k in range(1, min(COEFFICIENTS, self.count(g)))]
        return np.stack(cols, 1)

    def width(self, f: str) -> int:
        """Columns of the design for f."""
        p = self.plan
        numbers = len([g for g in (*p.numeric, *p.by_number, *p.by_time) if g != f])
        return 1 + 2 * numbers + sum([max(0, min(COEFFICIENTS, self.count(g)) - 1) for g in (*p.categorical, *p.by_class)])

    def bins(self, f: str, num: dict, cat: dict) -> list[np.ndarray]:
        """For each other field the row's bin, -1 where it has no value."""
        out = []
        for g in num:
            mean, sd = self.centre[g]
            z = (num[g] - mean) / sd
            out.append(np.where(np.isnan(z), -1, np.clip(np.floor(np.nan_to_num(z) * 4) + 12, 0, 23)).astype(int))
        out += [cat[g] for g in cat if g != f]
        return out

    def fill(self, model: dict, num: dict, cat: dict, lost: dict, pdf: pd.DataFrame) -> tuple[dict, dict]:
        new_num, new_cat = dict(num), dict(cat)
        for f in self.plan.numeric:
            if model[f] is not None and lost[f].any():
                beta, sd = model[f]
                low, high = self.plan.numeric[f]
                guess = self.design(f, num, cat) @ beta + sd * _normal(pdf["u_" + f].to_numpy(float))
                new_num[f] = np.where(lost[f], np.clip(guess, low, high), num[f])
        for f in self.plan.categorical:
            if model[f] is not None and lost[f].any():
                at = np.flatnonzero(lost[f])
                prior, tables = model[f]
                score = np.tile(prior, (len(at), 1))
                for b, t in zip(self.bins(f, num, cat), tables):
                    score += np.where((b[at] >= 0)[:, None], t[:, b[at]].T, 0.0)
                odds = np.exp(score - score.max(1, keepdims=True))
                edge = np.cumsum(odds / odds.sum(1, keepdims=True), 1)
                pick = (edge < pdf["u_" + f].to_numpy(float)[at][:, None]).sum(1)
                new_cat[f] = cat[f].copy()
                new_cat[f][at] = np.minimum(pick, len(prior) - 1)
        return new_num, new_cat


def _normal(u: np.ndarray) -> np.ndarray:
    """Standard normal draws from uniform ones (logistic approximation would fatten the tails)."""
    from statistics import NormalDist

    grid = np.linspace(0.0005, 0.9995, 2000)
    return np.interp(u, grid, [NormalDist().inv_cdf(x) for x in grid])


def _statistics(coder: _Coder, frames: Iterator[pd.DataFrame]) -> dict[tuple[str, str, int], np.ndarray]:
    total: dict = {}

    def add(key, value):
        total[key] = value if key not in total else total[key] + value

    for pdf in frames:
        num, cat = coder.arrays(pdf)
        for f in coder.plan.numeric:
            known = ~coder.lost[f]
            x = np.column_stack([coder.design(f, num, cat)[known], num[f][known]])
            add((f, "gram", 0), (x.T @ x).ravel())
        for f in coder.plan.categorical:
            k = coder.count(f)
            known = ~coder.lost[f] & (cat[f] >= 0)
            add((f, "prior", 0), np.bincount(cat[f][known], minlength=k).astype(float))
            for i, b in enumerate(coder.bins(f, num, cat)):
                width = _widths(coder, f)[i]
                both = known & (b >= 0)
                add((f, "bins", i), np.bincount(cat[f][both] * width + b[both], minlength=k * width).astype(float))
    return total


def _widths(coder: _Coder, f: str) -> list[int]:
    p = coder.plan
    return [24] * len((*p.numeric, *p.by_number, *p.by_time)) + [max(1, coder.count(g)) for g in (*p.categorical, *p.by_class) if g != f]


def _fit(base: DataFrame, coder: _Coder) -> dict:
    def emit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (f, what, i), values in _statistics(coder, it).items():
            at = np.flatnonzero(values)
            yield pd.DataFrame({"field": f, "what": what, "i": i, "at": at, "v": values[at]})

    rows = base.mapInPandas(emit, "field string, what string, i int, at bigint, v double").groupBy("field", "what", "i", "at").agg(F.sum("v").alias("v")).toPandas()
    got = {k: (x["at"].to_numpy(), x["v"].to_numpy()) for k, x in rows.groupby(["field", "what", "i"])}

    def dense(key: tuple, size: int) -> np.ndarray:
        out = np.zeros(size)
        if key in got:
            out[got[key][0]] = got[key][1]
        return out

    model: dict = {}
    for f in coder.plan.numeric:
        p = coder.width(f) + 1
        gram = dense((f, "gram", 0), p * p).reshape(p, p)
        n = gram[0, 0]
        if n < 1:
            model[f] = None
            continue
        a, b, yy = gram[:-1, :-1] + 1e-6 * n * np.eye(p - 1), gram[:-1, -1], gram[-1, -1]
        beta = np.linalg.solve(a, b)
        rss = yy - 2 * beta @ b + beta @ gram[:-1, :-1] @ beta
        model[f] = beta, math.sqrt(max(0.0, rss) / n)
    for f in coder.plan.categorical:
        k = coder.count(f)
        prior = dense((f, "prior", 0), k)
        if not prior.sum():
            model[f] = None
            continue
        tables = []
        for i, width in enumerate(_widths(coder, f)):
            t = dense((f, "bins", i), k * width).reshape(k, width) + 0.5
            tables.append(np.log(t / t.sum(1, keepdims=True)) - np.log(t.sum(0) / t.sum()))
        model[f] = np.log((prior + 0.5) / (prior + 0.5).sum()), tables
    return model


def _classes(base: DataFrame, k: str) -> tuple[list[str], bool]:
    """The classes of a field, the most frequent first, and whether there are more than CLASSES spellings."""
    seen = base.filter(F.col(k).isNotNull()).groupBy(k).count().orderBy(F.desc("count"), k).limit(CLASSES + 1).collect()
    speller, counts = _Speller(), []
    for name, n in seen[:CLASSES]:
        near = speller.nearest(name)
        if near < 0 or counts[near] < RATIO * n:
            speller.add(name)
            counts.append(n)
    return speller.names, len(seen) > CLASSES


def _rare(df: DataFrame, spelled: Column, written: Column, classes: list[str]) -> list[str]:
    """Values beyond the classes, spread by hash: the most frequent one of each of RARE buckets."""
    rest = df.select(spelled.alias("k"), written.alias("v")).filter(F.col("k").isNotNull() & ~F.col("k").isin(classes)).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    return [r.v for r in rest.groupBy(F.pmod(F.xxhash64("k"), F.lit(RARE)).alias("b")).agg(F.max_by("v", F.struct("n", "v")).alias("v")).orderBy("b").collect()]


def fit(df: DataFrame, plan: Plan) -> _Coder:
    """The fitted chain; its size depends on the number of classes only."""
    cols = _inputs(df, plan)
    base = df.select(*[c.alias(k) for k, c in cols.items()])
    numbers = [k for k in cols if k.startswith("n_")]
    first = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias("a" + k) for k in numbers], *[F.stddev_pop(k).alias("s" + k) for k in numbers]).first()
    centre = {k[2:]: (first["a" + k] or 0.0, first["s" + k] or 1.0) for k in numbers}
    classes, rare = {}, {}
    for k in cols:
        if k.startswith("c_"):
            f = k[2:]
            classes[f], more = _classes(base, k)
            if more:
                rare[f] = _rare(df, cols[k], F.col(f"`{f}`").cast("string"), classes[f])
    coder = _Coder(plan, classes, rare, centre, [])
    for _ in range(plan.rounds):
        model = _fit(base, coder)
        coder = _Coder(plan, classes, rare, centre, [*coder.models, model])
    return coder


def impute(df: DataFrame, plan: Plan) -> DataFrame:
    """df with every cell of the plan's fields that holds no usable value filled, and a mark per field."""
    coder, cols = fit(df, plan), _inputs(df, plan)
    fields = [*plan.numeric, *plan.categorical]
    shown = _written(df, plan, coder.classes, cols)
    kinds = ", ".join(f"`{f}` {'double' if f in plan.numeric else 'string'}" for f in fields)

    @F.pandas_udf(kinds)
    def fills(pdf: pd.DataFrame) -> pd.DataFrame:
        num, cat = coder.arrays(pdf)
        out = {f: num[f] for f in plan.numeric}
        for f in plan.categorical:
            names = np.array([*[shown[f].get(c, c) for c in coder.classes[f]], None], dtype=object)
            out[f] = names[np.minimum(cat[f], len(names) - 1)]
            if rare := coder.rare.get(f):
                at = np.flatnonzero(cat[f] == len(coder.classes[f]))
                # The lower digits of the draw, as the upper ones chose the class.
                out[f][at] = np.array(rare, dtype=object)[(pdf["u_" + f].to_numpy(float)[at] * 1e6 % 1 * len(rare)).astype(int)]
        return pd.DataFrame(out)

    inner = fresh_name("_fills", df)
    filled = df.withColumn(inner, fills(F.struct(*[c.alias(k) for k, c in cols.items()])))
    out, marks = [], {f: fresh_name(f + "_filled", df) for f in fields}
    for c in df.columns:
        if c in fields:
            lost = cols[("n_" if c in plan.numeric else "c_") + c].isNull()
            out.append(F.when(lost, F.col(inner)[c].cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    given = lambda f: cols[("n_" if f in plan.numeric else "c_") + f].isNull() & F.col(inner)[f].isNotNull()
    return filled.select(*out, *[given(f).alias(m) for f, m in marks.items()])


def _written(df: DataFrame, plan: Plan, classes: dict, cols: dict) -> dict[str, dict[str, str]]:
    """How each class is mostly written."""
    out = {}
    for f in plan.categorical:
        if not classes[f]:
            out[f] = {}
            continue
        seen = df.select(cols["c_" + f].alias("k"), F.col(f"`{f}`").alias("v")).filter(F.col("k").isin(classes[f])).groupBy("k", "v").count()
        out[f] = {r.k: r.v for r in seen.groupBy("k").agg(F.max_by("v", F.struct("count", "v")).alias("v")).collect()}
    return out


def filled_cells(filled: DataFrame, row_id: str, fields: tuple[str, ...] = ("bmi", "smoker_status", "site")) -> DataFrame:
    """(row_id, field_name, value) of every cell without a usable value: what it was filled with, or NULL where nothing could be learned."""
    cells = F.array_compact(F.array(*[
        F.when(F.col(f + "_filled") | F.col(f).isNull(), F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"))) for f in fields
    ]))
    return filled.select(row_id, F.explode(cells).alias("c")).select(row_id, "c.field_name", "c.value")
