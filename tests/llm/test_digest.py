import random

import numpy as np

from quernel.llm import digest


def test_cluster_keeps_weight_and_point_masses():
    rng = np.random.default_rng(0)
    key = np.repeat([0, 1], [5000, 10])
    mean = np.r_[rng.normal(size=4000), np.full(1000, 0.95), np.arange(10.0)]
    k, m, w = digest.cluster(key, mean, np.ones(len(key)), 100)
    assert w[k == 0].sum() == 5000 and w[k == 1].sum() == 10 and (k == 0).sum() < 130
    assert w[(k == 0) & (m == 0.95)].max() == 1000


def test_percentiles_are_within_the_bound(spark):
    rnd = random.Random(2)
    rows = []
    for g, n in (("hot", 20000), ("small", 7), (None, 500), ("equal", 300)):
        for _ in range(n):
            v = 5.0 if g == "equal" else rnd.choice([rnd.gauss(0, 1), rnd.lognormvariate(0, 3), 0.25])
            rows.append((g, f"L{rnd.randint(0, 3)}", v))
    rows += [("hot", "L1", x) for x in (None, float("nan"), float("inf"))] + [("none", "L1", None)]
    df = spark.createDataFrame(rows, "g string, load string, v double").selectExpr("*", "1 as mean", "2 as weight").repartition(6)
    partial = digest.digest(df, ["g", "load"], "v")
    merged = digest.merge(partial, ["g"])
    out = digest.certify(df, ["g"], "v", digest.quantiles(merged, ["g"], [0.01, 0.25, 0.5, 0.75, 0.99])).collect()
    assert len(out) == 20 and all(r.certified for r in out)
    for r in out:
        values = sorted(v for g, _, v in rows if g == r.g and v is not None and v == v and abs(v) < 1e308)
        below, upto = sum(v < r.estimate for v in values), sum(v <= r.estimate for v in values)
        assert (r.n, r.below, r.upto) == (len(values), below, upto)
        assert max(below - r.q * r.n, r.q * r.n - upto, 0) <= max(digest.RANK_ERROR * r.n, 0.5) + 1e-6
    assert merged.filter("g = 'hot'").count() < digest.COMPRESSION
    assert all(r.estimate == 5 for r in out if r.g == "equal")
    assert digest.digest(df.limit(0), ["g"], "v").count() == 0
