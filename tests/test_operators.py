"""The table operators on small tables."""

import math

import pytest

from quernel.functions.expressions import ExpressionError
from quernel.functions.selectors import SelectorError
from quernel.operators import cut, info, join, keep, melt, mutate, pivot, sort, summarize, take
from quernel.table import Table


@pytest.fixture(scope="module")
def cyto(spark):
    rows = [("S01", 4.2, 3.1, 6.8, 2.4), ("S02", 3.9, 2.7, 5.5, 2.0), ("S03", 4.9, 3.6, 7.4, 2.6)]
    return Table.of(spark.createDataFrame(rows, "sample_id string, IL6 double, TNF double, IFNG double, IL10 double"), ["sample_id"])


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("S01", "case", "0.94"), ("S02", "control", "0.90"), ("S03", "case", "0.96"), ("S04", "case", "")]
    return Table.of(spark.createDataFrame(rows, "sample_id string, grp string, purity string"), ["sample_id"])


def rows(t):
    return [tuple(r) for r in t.df.orderBy("__o").drop("__o").collect()]


def test_pipeline(cyto, samples):
    t = mutate(cyto, "total=sum($IL6:$IL10)", "log_total=log2($total)")
    t = keep(join([t, samples], "sample_id", keep="0"), '$grp == "case" & $purity >= 0.94')
    got = rows(cut(t, "sample_id:IL10,log_total:purity"))
    assert [(r[0], round(r[5], 6), r[7]) for r in got] == [("S01", 4.044394, "0.94"), ("S03", 4.209453, "0.96")]


@pytest.mark.parametrize("expression, want", [
    ("$a > 1", [2, 3]), ("$a == 1", [1]), ('$b == ""', [3]), ("$b", [1]), ("!$b", [2, 3]), ("1 <= $a <= 2", [1, 2]), ('$a:$c ~ "^x"', [1, 2]),
    ('~ "y"', [3]), ('$c !~ "x"', [3]), ("-2^2 == 4", [1, 2, 3]), ("2^3^2 == 512 & $a == 1", [1]), ("1/($a-1) > 0.6", [2]), ("sqrt(-$a)", []),
    ("($a == 1 | $a == 3) & ($a + 1) * 2 > 4", [3]), ("$a == 1 or not $a < 3", [1, 3]), ("sum($a,$b) == 3", [3]), ("$a < nope", None), ("$zz == 1", None), ("$a ==", None),
    ('$c ~ "("', None), ("max($a + 1)", None),
])
def test_filter(spark, expression, want):
    t = Table.of(spark.createDataFrame([(1, "5", "x1"), (2, "0", "x2"), (3, "", "y")], "a int, b string, c string"), ["a"])
    if want is None:
        with pytest.raises((ExpressionError, SelectorError, ValueError)):
            keep(t, expression)
    else:
        assert [r[0] for r in rows(keep(t, expression))] == want


def test_numbers_in_text(spark):
    texts = ["1", "1.0", "1e3", ".5", "inf", "NaN", "1d", "0x1p3", "1_0", "007", "-0", " 2 ", " 3", None, ""]
    t = Table.of(spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string"), ["i"])
    numeric = [r.s for r in keep(t, "abs($s) >= 0").to_df().collect()]
    assert numeric == ["1", "1.0", "1e3", ".5", "007", "-0", " 2 ", " 3"]
    assert [r.s for r in keep(t, "$s == 1").to_df().collect()] == ["1"]


def test_mutate_forms(spark):
    t = Table.of(spark.createDataFrame([("ab-12", 2.0, 0.0)], "s string, x double, y double"), ["s"])
    t = mutate(t, 'r=sub($s,"([a-z]+)-(\\d+)","$2:$1")', "s/s/b/B\\//", "d=$x / $y", "x=$x * 2", "z=$x + 1")
    assert t.names == ("s", "x", "y", "r", "d", "x", "z")
    assert rows(t) == [("aB/-12", 2.0, 0.0, "12:ab", None, 4.0, 3.0)]
    assert t.to_df().columns == ["s", "x", "y", "r", "d", "x#2", "z"]
    assert mutate(t, "x=$x+1", overwrite=True).names == t.names
    with pytest.raises(ExpressionError):
        mutate(t, "q")
    with pytest.raises(ExpressionError):
        mutate(t, "q=$x == 1")


def test_text_mode_hands_on_six_decimals(spark):
    t = Table.of(spark.createDataFrame([(1.0, 3.0)], "a double, b double"), ["a"], text_mode=True)
    assert rows(cut(mutate(t, "c=$a/$b", "d=$c*3", "e=2"), "c:e")) == [("0.333333", "0.999999", "2")]


def test_row_statistics(spark):
    t = Table.of(spark.createDataFrame([("2", "-2", "x", "", "2")], "a string, b string, c string, d string, e string"), ["a"])
    made = {}
    for f in ("sum", "mean", "median", "sd", "var", "min", "max", "absmin", "absmax", "prod", "count", "unique", "collapse", "countunique", "mode", "antimode", "argmin", "argmax", "first", "last", "iqr", "trimmean", "q1"):
        made[f] = rows(cut(mutate(t, f"r={f}($a:$e)"), "r"))[0][0]
    assert made["sum"] == 2 and made["mean"] == pytest.approx(2 / 3) and made["median"] == 2 and made["prod"] == -8 and made["q1"] == 0
    assert made["absmin"] == 2 and made["absmax"] == 2 and made["argmin"] == 2 and made["argmax"] == 1 and made["count"] == 5
    assert made["unique"] == "2,-2,x," and made["collapse"] == "2,-2,x,,2" and made["countunique"] == 4 and made["mode"] == "2" and made["antimode"] == "-2"
    assert made["var"] == pytest.approx(32 / 9) and made["sd"] == pytest.approx(math.sqrt(32 / 9)) and made["first"] == "2" and made["last"] == "2"
    none = rows(cut(mutate(t, "a=sum($c:$d)", "b=mean($c:$d)", overwrite=True), "a,b"))
    assert none == [(0.0, None)]


def test_summarize(spark):
    data = [(1, "a", "3"), (2, "a", "1"), (3, "b", ""), (4, "a", "3"), (5, "a", "x"), (6, None, "-3")]
    t = Table.of(spark.createDataFrame(data, "i int, g string, v string"), ["i"])
    ops = ["sum", "count", "mode", "antimode", "unique", "collapse", "countunique", "first", "last", "argmin", "argmax", "absmax", "median", "q0_25", "trimmean", "entropy", "sd", "prod"]
    s = summarize(t, "v=" + ",".join(ops), "g")
    got = {r[0]: dict(zip(ops, r[1:])) for r in rows(s)}
    assert [r[0] for r in rows(s)] == ["a", "b", ""] and s.names[14] == "v_q0_25"
    a = got["a"]
    assert a["sum"] == 7 and a["count"] == 4 and a["mode"] == "3" and a["antimode"] == "1" and a["unique"] == "3,1,x" and a["collapse"] == "3,1,3,x"
    assert a["argmin"] == 2 and a["argmax"] == 1 and a["median"] == 3 and a["q0_25"] == 2 and a["entropy"] == pytest.approx(1.5) and a["prod"] == 9
    assert got["b"]["sum"] is None and got["b"]["count"] == 1 and got["b"]["first"] == "" and got["b"]["median"] is None and got["b"]["entropy"] == 0
    assert got[""]["absmax"] == -3
    assert rows(summarize(keep(t, "$i > 99"), "v=sum,median,mode")) == []
    with pytest.raises(SelectorError):
        summarize(t, "v=nope")


def test_joins(spark):
    a = Table.of(spark.createDataFrame([(1, "x", "a1"), (2, "y", "a2"), (3, "x", "a3"), (4, "", "a4")], "o int, k string, v string"), ["o"])
    b = Table.of(spark.createDataFrame([(1, "z", "b1"), (2, "x", "b2"), (3, "x", "b3"), (4, None, "b4")], "o int, k string, v string"), ["o"])
    two = [cut(a, "k,v"), cut(b, "k,v")]
    assert rows(join(two, "k")) == [("x", "a1", "b2"), ("x", "a1", "b3"), ("x", "a3", "b2"), ("x", "a3", "b3"), ("", "a4", "b4")]
    assert join(two, "k").names == ("k", "v", "v#2")
    assert [r[0] for r in rows(join(two, "k", keep="0"))] == ["x"] * 4 + ["y", "", "z"]
    assert rows(join(two, "k", keep="1", fill="-"))[4] == ("y", "a2", "-")
    assert len(rows(join(two, "k", keep="2"))) == 6
    assert len(rows(join([*two, two[0]], "k", keep="1,3"))) == 10
    assert join(two, "k;k", select=";v").names == ("k", "v", "v#2")
    with pytest.raises(SelectorError):
        join(two, "k;k,v")


def test_sort_and_slice(spark):
    t = Table.of(spark.createDataFrame([(i, s) for i, s in enumerate(["10", "9", "x", "", "-1", "9", "B"])], "i int, s string"), ["i"])
    order = lambda *k: [r[0] for r in sort(t, *k).df.select("_c0").collect()]
    assert order("s:n") == [3, 6, 2, 4, 1, 5, 0]
    assert order("s:nr") == [0, 1, 5, 4, 2, 6, 3]
    assert order("s") == [3, 4, 0, 1, 5, 6, 2]
    assert order("s:n:r", "i:nr")[:3] == [0, 5, 1]
    place = lambda spec: [r[0] for r in rows(take(t, spec))]
    assert place("2,4:5") == [1, 3, 4] and place(":-2") == [0, 1, 2, 3, 4, 5] and place("-2:") == [5, 6] and place("6:99") == [5, 6] and place("8") == []
    with pytest.raises(SelectorError):
        place("-9")


def test_melt_pivot(spark):
    t = Table.of(spark.createDataFrame([("A", 1, 2), ("B", 3, None)], "id string, s1 int, s2 int"), ["id"])
    long = melt(t, "id")
    assert rows(long) == [("A", "s1", 1), ("A", "s2", 2), ("B", "s1", 3), ("B", "s2", None)]
    assert rows(pivot(long, "id", "variable", "value")) == [("A", 1, 2), ("B", 3, None)]
    assert rows(melt(t, "id", fill="-"))[3] == ("B", "s2", "-")
    assert rows(pivot(take(long, ":3"), "id", "variable", "value", fill="none")) == [("A", "1", "2"), ("B", "3", "none")]
    case = Table.of(spark.createDataFrame([("i", "A", 1), ("i", "a", 2), ("j", "a b`c", 3)], "i string, c string, v int"), ["v"])
    wide = pivot(case, "i", "c", "v")
    assert wide.names == ("i", "A", "a", "a b`c") and rows(wide) == [("i", 1, 2, None), ("j", None, None, 3)]
    twice = Table.of(spark.createDataFrame([("A", "x", 1), ("A", "x", 2)], "i string, c string, v int"))
    with pytest.raises(Exception, match="two rows"):
        rows(pivot(twice, "i", "c", "v"))
    with pytest.raises(SelectorError):
        melt(t, "id", "id,s1")


def test_info(spark):
    t = Table.of(spark.createDataFrame([("1", "2024-1-5", "x", ""), ("", "2024-02-03", "1", " ")], "a string, b string, c string, d string"), ["b"])
    assert [r[:3] for r in rows(info(t))] == [(1, "a", "num"), (2, "b", "date"), (3, "c", "str"), (4, "d", "str")]


def test_rows_by_place_after_a_sort(spark, monkeypatch):
    """Whatever way the rows go through a shuffle, and also where bounds are found by ranges."""
    from quernel.operators import basic

    t = Table.of(spark.range(30_000).selectExpr("id", "id * 7919 % 30011 as x", "cast(id % 7 as string) as g"), ["id"])
    want = sorted(((i * 7919 % 30011, i) for i in range(30_000)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        for k in (10_000, 40):
            monkeypatch.setattr(basic, "TOP_K", k)
            up, down = sort(t, "x:n"), sort(t, "x:nr")
            assert [r[1] for r in rows(cut(take(up, "-10:"), "id,x"))] == [x for x, _ in want[-10:]]
            assert [r[0] for r in rows(cut(take(up, "20000:20004"), "id,x"))] == [i for _, i in want[19999:20004]]
            assert [r[0] for r in rows(cut(take(down, "20000:20004"), "id,x"))] == [i for _, i in want[::-1][19999:20004]]
            text = sort(t, "g:r", "x:n")
            by_text = sorted(((-(i % 7), x, i) for x, i in want))
            assert [r[0] for r in rows(cut(take(text, "15001:15003"), "id"))] == [i for *_, i in by_text[15000:15003]]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_sorting_texts_the_other_way_round(spark):
    texts = ["", "a", "ab", "b", "é", "a\x00", "Z", "😀", None]
    t = Table.of(spark.createDataFrame([(x,) for x in texts], "s string"))
    assert [r[0] for r in rows(sort(t, "s:r"))] == sorted(texts, key=lambda x: (x or "").encode(), reverse=True)
    assert [r[0] for r in sort(t, "s").to_df().collect()] in (sorted(texts, key=lambda x: (x or "").encode()), [None, *sorted(texts[:-1], key=lambda x: x.encode())])


def test_order_without_keys_does_not_depend_on_shuffles(spark):
    df = spark.range(1000).selectExpr("id % 37 as k", "id").repartition(7).groupBy("k").count()
    assert rows(take(Table.of(df), "3")) == rows(take(Table.of(df.repartition(3)), "3"))


def test_numbers_that_differ_late(spark):
    df = spark.createDataFrame([(0.12345678901,), (0.12345678902,), (1e-7,), (2.5e9,), (-0.0,), (0.0,), (123456789.125,)], "x double")
    t = Table.of(df, ["x"])
    assert rows(summarize(t, "x=countunique")) == [(6.0,)]
    other = Table.of(spark.createDataFrame([(0.12345678902, "b")], "x double, y string"), ["x"])
    assert [r[1] for r in rows(join([t, other], "x"))] == ["b"]
    from quernel.functions.values import shortest
    from pyspark.sql import functions as F
    shown = [r[0] for r in df.select(shortest(F.col("x"))).collect()]
    assert shown == ["0.12345678901", "0.12345678902", "1.0E-7", "2500000000", "0", "0", "123456789.125"]


def test_patterns_of_a_column_are_those_of_the_language(spark):
    t = Table.of(spark.createDataFrame([("ab", "a(?=b)"), ("ab\n", "b$"), ("ab", "b$"), ("ab", "[")], "s string, p string"), ["s", "p"])
    assert [r[1] for r in rows(keep(t, "$s ~ $p"))] == ["b$"]


def test_order_of_joins_of_tables_ordered_by_different_kinds(spark):
    a = Table.of(spark.createDataFrame([(k, k) for k in (100, 9, 20)], "k int, a int"), ["a"])
    b = sort(Table.of(spark.createDataFrame([(k, f"b{k}") for k in (3, 20, 1)], "k int, b string"), ["k"]), "b:r")
    c = Table.of(spark.createDataFrame([(k,) for k in (7, 20)], "k int"), ["k"])
    assert [r[0] for r in rows(join([a, b], "k", keep="0"))] == [9, 20, 100, 3, 1]
    assert [r[0] for r in rows(join([a, b, c], "k", keep="0"))] == [9, 20, 100, 3, 1, 7]


def test_joins_of_many_tables_do_not_hold_all_rows_of_a_key(spark):
    """Broadcast joins compiled together hold the product of all tables for a key; at most the first is one."""
    made = [Table.of(spark.range(12).selectExpr(f"cast(id % {m} as string) as k", "id"), ["id"]) for m in (2, 3, 4)]
    for keep, want in (("", 144), ("1", 144), ("1,3", 159), ("0", 159)):
        df = join(made, "k", keep=keep).to_df()
        assert df.count() == want and df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1
