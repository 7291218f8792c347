import random

import pytest

from quernel.llm import components as C


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


GRAPHS = {
    "path": [(f"v{i:03}", f"v{i + 1:03}") for i in range(120)],
    "star": [("hub", f"s{i}") for i in range(200)] + [("s1", "t"), ("s1", "t")],
    "random": [(f"n{random.Random(i).randint(0, 150)}", f"n{random.Random(-i - 1).randint(0, 150)}") for i in range(110)],
    "dirt": [("a", None), (None, None), ("a", "a"), ("b", "c"), ("c", "b"), ("", "b")],
}


@pytest.mark.parametrize("vertices", [1 << 18, 3])
@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, monkeypatch, name, vertices):
    """Contracted by the task as a whole, and hardly at all (three vertices and one row at a time)."""
    monkeypatch.setattr(C, "VERTICES", vertices)
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "a string, b string")
    out = C.components(df if vertices > 3 else df.repartition(40)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.root, set()).add(r.v)
    assert {frozenset(g) for g in groups.values()} == union_find(edges) and len({r.v for r in out}) == len(out)
    assert all(k in g for k, g in groups.items())


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([("a", None)], "a string, b string")).collect() == []


def test_star_edges(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("k", None), (None, "z"), ("l", "q")], "k string, m string").selectExpr("*", "1 as a", "2 as b")
    assert [tuple(r) for r in C.star_edges(df, "k", "m").collect()] == [("a", "b")]


def test_split(spark):
    rows = [(f"c{i}", 1 + i % 4) for i in range(3000)]
    parts = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = {r[0]: r[1] for r in C.split(spark.createDataFrame(rows, "c string, n int"), "c", "n", parts).collect()}
    total = sum(n for _, n in rows)
    assert len(got) == 3000
    for p, share in parts.items():
        assert abs(sum(n for c, n in rows if got[c] == p) / total - share) < 0.005
