from hypothesis import given
from hypothesis import strategies as st

from quernel.llm.packing import BestFit, pack

VOCABULARY = "ab"


@given(st.lists(st.integers(0, 20), max_size=200), st.integers(1, 6))
def test_best_fit(sizes, open_bins):
    p = BestFit(20, open_bins)
    load = {}
    for s in sizes:
        b = p.put(s)
        load[b] = load.get(b, 0) + s
        assert p.open <= open_bins
    assert all(v <= 20 for v in load.values())
    assert p.open == sum(map(len, p.by_free.values()))


def test_tightest_bin_and_fullest_closes():
    p = BestFit(10, 2)
    assert [p.put(6), p.put(7)] == [0, 1]
    assert p.put(3) == 1 and p.put(4) == 0  # both are full now
    assert [p.put(6), p.put(8), p.put(9)] == [2, 3, 4]  # 3, the fullest, was closed
    assert p.put(2) == 2


def test_pack(spark, tmp_path):
    import base64

    v = tmp_path / "v.tiktoken"
    v.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate([*(bytes([i]) for i in range(256)), b"ab"])))
    texts = ["ab ab", None, "", "x" * 25, "cab", "ab ab", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as tokens").coalesce(1)
    out = pack(df, "doc_id", "text", 10, str(v), r"\s|\S+").collect()
    want = {0: 3, 1: 0, 2: 0, 3: 25, 4: 2, 5: 3, 6: 2}
    got, bins = {}, {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
        bins[r.container] = bins.get(r.container, 0) + r.tokens
    assert got == want and max(bins.values()) <= 10 and len(bins) == 4
    assert [(r.piece, r.first_token, r.tokens) for r in out if r.doc_id == 3] == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    # Rows of one id are items of their own, and tasks don't share containers.
    twice = spark.createDataFrame([(1, "a" * 6), (1, "a" * 6), (2, None), (2, "a" * 6)], "doc_id long, text string").repartition(3)
    loads = {}
    for r in pack(twice, "doc_id", "text", 10, str(v), r"\s|\S+").collect():
        loads[r.container] = loads.get(r.container, 0) + r.tokens
    assert sum(loads.values()) == 18 and max(loads.values()) <= 10
    assert pack(df.limit(0), "doc_id", "text", 10, str(v), r"\s|\S+").collect() == []
