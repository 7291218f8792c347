import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import topn


def brute(rows, n):
    best = {}
    for g, name, s in rows:
        if g is None or name is None or s is None or s != s or s in (float("inf"), float("-inf")):
            continue
        best.setdefault(g, {})
        best[g][name] = max(best[g].get(name, s), s)
    return {g: [x for x, _ in sorted(b.items(), key=lambda x: (-x[1], x[0].encode()))[:n]] for g, b in best.items()}


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree_merges(lists):
    sources = [iter(sorted(x)) for x in lists]
    tree = topn.LoserTree([next(s, None) for s in sources])
    out = []
    while tree.top >= 0 and tree.heads[tree.top] is not None:
        out.append(tree.heads[tree.top])
        tree.replace(next(sources[tree.top], None))
    assert out == sorted(x for xs in lists for x in xs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", "Z", "é", "zz", ""]), st.sampled_from([1.0, 2.0, -0.0, 0.0, 3.5])), max_size=25), max_size=5), st.integers(1, 4), st.integers(1, 5))
def test_runs_against_brute_force(parts, n, block):
    runs = []
    for p in parts:
        t = pa.table({"grp": pa.array([r[0] for r in p], pa.string()), "name": pa.array([r[1] for r in p], pa.string()), "score": pa.array([r[2] for r in p], pa.float64())})
        runs.append(topn.Run(topn._shorten(t, n), block))
    got = {}
    for g, _, name in topn.merge_top(runs, n):
        got.setdefault(g, []).append(name)
    assert got == brute([r for p in parts for r in p], n)


def test_query(spark):
    rnd = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(rnd.choice(["hot", "hot", "a", "b", "c", None]), rnd.choice(["x", "y", "zz", "Z", "é", "", None, "w" * 5000]), rnd.choice([1.0, 1.0, 2.0, -0.0, nan, inf, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "subject string, name string, score double").selectExpr("*", "1 as grp", "2 as run").repartition(5)
    out = topn.top_names(df, "subject", "name", "score", 3, run_rows=200, buckets=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (-r.score, r.name.encode())):
        got.setdefault(r.grp, []).append(r.name)
    assert got == brute(rows, 3)
    assert topn.top_names(df.limit(0), "subject", "name", "score", 3).collect() == []
