"""Statistics over several cells of one row, as array expressions inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.quantiles import fraction
from quernel.functions.values import Val, finite, number, parse_number, sure

#: Other names of the statistics.
ALIASES = {"avg": "mean", "med": "median", "std": "sd", "stddev": "sd", "variance": "var", "product": "prod", "random": "rand", "distinct": "countunique"}
NAMES = {
    "sum", "mean", "median", "trimmean", "iqr", "sd", "var", "min", "max", "absmin", "absmax", "prod", "first", "last", "count", "rand",
    "unique", "collapse", "countunique", "mode", "antimode", "entropy", "argmin", "argmax",
}
TRIM = 0.1


def canonical(name: str) -> str | None:
    name = ALIASES.get(name, name)
    return name if name in NAMES or fraction(name) is not None else None


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _quantile(ordered: Column, f: float) -> Column:
    at = (F.size(ordered) - 1) * F.lit(f)
    low, high = F.try_element_at(ordered, (F.floor(at) + 1).cast("int")), F.try_element_at(ordered, (F.ceil(at) + 1).cast("int"))
    return low + (high - low) * (at - F.floor(at))


#: Columns up to which statistics are written out as plain arithmetic, which compiles; longer lists go through arrays.
WRITTEN_OUT, COMPARED = 32, 10


def _add(cs: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, cs)


def _first_where(tests: list[Column], values: list[Column]) -> Column:
    return F.coalesce(*[F.when(t, v) for t, v in zip(tests, values)])


def _extreme(nums: list[Column], least: bool) -> Column:
    return nums[0] if len(nums) == 1 else (F.least if least else F.greatest)(*nums)


def _flat(name: str, nums: list[Column], let) -> Column | None:
    """Statistics as plain arithmetic, without a function called for each cell. let() names what is used more than once."""
    k = len(nums)
    if name in ("sd", "var", "absmin", "absmax", "argmin", "argmax") and k <= WRITTEN_OUT:
        nums = let(nums)
    total, n = _add([F.coalesce(x, F.lit(0.0)) for x in nums]), _add([x.isNotNull().cast("int") for x in nums])
    mean = total / F.nullif(n, F.lit(0))
    if name == "sum":
        return total
    if name == "mean":
        return mean
    if name in ("min", "max"):
        return _extreme(nums, name == "min")
    if name == "prod":
        return F.when(n > 0, reduce(lambda x, y: x * y, [F.coalesce(x, F.lit(1.0)) for x in nums]))
    if k > WRITTEN_OUT:
        return None
    if name in ("median", "iqr", "trimmean") or fraction(name) is not None:
        ordered, n = let([F.sort_array(F.array(*nums)), n])  # NULLs first
    place = lambda i: F.get(ordered, F.lit(k) - n + i)

    def quantile(f: float) -> Column:
        at = (n - 1) * F.lit(f)
        low = F.floor(at).cast("int")
        return place(low) + (place(F.ceil(at).cast("int")) - place(low)) * (at - low)

    f = fraction(name)
    if f is not None or name == "median":
        return quantile(0.5 if f is None else f)
    if name == "iqr":
        return quantile(0.75) - quantile(0.25)
    if name == "trimmean":
        if int(k * TRIM) == 0:
            return mean
        t = F.floor(n * F.lit(TRIM)).cast("int")
        kept = [F.when((F.lit(i) >= t) & (F.lit(i) < n - t), place(F.lit(i))) for i in range(k)]
        return _add([F.coalesce(x, F.lit(0.0)) for x in kept]) / F.nullif(n - 2 * t, F.lit(0))
    if name in ("sd", "var"):
        # Around a value of the row, so that nothing is cancelled that matters: the variance is at least its square's nth part.
        origin, count = let([F.coalesce(*nums), n])
        off = let([x - origin for x in nums])
        first, second = let([_add([F.coalesce(o if p == 1 else o * o, F.lit(0.0)) for o in off]) / F.nullif(count, F.lit(0)) for p in (1, 2)])
        (var,) = let([F.greatest(second - first * first, F.lit(0.0))])
        return F.sqrt(var) if name == "sd" else var
    if name in ("absmin", "absmax"):
        sizes = [F.abs(x) for x in nums]
        (wanted,) = let([_extreme(sizes, name == "absmin")])
        return _first_where([s == wanted for s in sizes], nums)
    if name in ("argmin", "argmax"):
        (wanted,) = let([_extreme(nums, name == "argmin")])
        return _first_where([x == wanted for x in nums], [_add([y.isNotNull().cast("int") for y in nums[: i + 1]]).cast("double") for i in range(k)])
    return None


def _compared(name: str, texts: list[Column], let) -> Column:
    """mode, antimode and entropy from how often each text comes, by comparing all with all."""
    texts = let(texts)
    counts = let([_add([(a == b).cast("int") for b in texts]) for a in texts])
    if name == "entropy":
        return _add([F.log2(F.lit(float(len(texts))) / c) for c in counts]) / len(texts)
    wanted = _extreme(counts, name == "antimode")
    return _first_where([c == wanted for c in counts], texts)


def _ranked(name: str, nums: Column) -> Column | None:
    """Statistics of an array of numbers that is not empty."""
    f = fraction(name)
    ordered = F.sort_array(nums)  # array_sort would call a comparison for each pair
    if f is not None or name == "median":
        return _let(ordered, lambda o: _quantile(o, 0.5 if f is None else f))
    if name == "iqr":
        return _let(ordered, lambda o: _quantile(o, 0.75) - _quantile(o, 0.25))
    if name == "trimmean":
        t = F.floor(F.size(nums) * F.lit(TRIM)).cast("int")
        return _let(F.slice(ordered, t + 1, F.size(nums) - 2 * t), lambda kept: _sum(kept) / F.size(kept))
    if name in ("absmin", "absmax"):
        least = F.array_min if name == "absmin" else F.array_max
        return _let(F.transform(nums, F.abs), lambda sizes: F.element_at(nums, F.array_position(sizes, least(sizes)).cast("int")))
    if name in ("sd", "var"):
        squares = lambda m: F.aggregate(nums, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(nums)
        var = _let(_sum(nums) / F.size(nums), squares)
        return F.sqrt(var) if name == "sd" else var
    if name in ("argmin", "argmax"):
        return F.array_position(nums, F.array_min(nums) if name == "argmin" else F.array_max(nums)).cast("double")
    return None


def row_statistic(name: str, cells: list[Val], seed: int = 0, let=lambda cols: cols) -> Val:
    """A statistic over the cells; what needs numbers takes the finite ones."""
    flat = _flat(name, [v.finite for v in cells], let)
    if flat is not None:
        return number(let([flat])[0])
    if name == "count":
        return number(F.lit(float(len(cells))))
    if name in ("first", "last"):
        return cells[0 if name == "first" else -1]
    found = F.array_compact(F.array(*[v.finite for v in cells]))
    if _ranked(name, F.array(F.lit(0.0))) is not None:
        # finite() inside: what is outside an array function is computed again for each mention.
        return sure(_let(found, lambda nums: F.when(F.size(nums) > 0, _let(_ranked(name, nums), finite))))
    texts = F.array(*[v.text for v in cells])
    text = lambda c: Val(c, parse_number(c))
    if name == "rand":
        return text(F.element_at(texts, (F.floor(F.rand(seed) * len(cells)) + 1).cast("int")))
    if name == "collapse":
        return text(F.array_join(texts, ","))
    if name == "unique":
        return text(F.array_join(F.array_distinct(texts), ","))
    if name == "countunique":
        return sure(F.size(F.array_distinct(texts)).cast("double"))

    def counted(use):
        """use(distinct texts, how often each comes)"""
        counts = lambda d, t: F.transform(d, lambda x: F.size(F.filter(t, lambda y: y == x)))
        return _let(texts, lambda t: _let(F.array_distinct(t), lambda d: _let(counts(d, t), lambda c: use(d, c))))

    if name in ("mode", "antimode", "entropy") and len(cells) <= COMPARED:
        found = _compared(name, [v.text for v in cells], let)
        return sure(found) if name == "entropy" else text(found)
    if name in ("mode", "antimode"):
        best = F.array_max if name == "mode" else F.array_min
        return text(counted(lambda d, c: F.element_at(d, F.array_position(c, best(c)).cast("int"))))
    if name == "entropy":
        share = F.lit(float(len(cells)))
        return sure(counted(lambda d, c: F.aggregate(c, F.lit(0.0), lambda a, x: a - x / share * F.log2(x / share))))
    raise ValueError(f"no statistic {name!r}")
