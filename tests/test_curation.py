"""Profiles, imputation, orphans and wide tables against plain Python on small tables."""

import datetime as dt

import pytest

from quernel.curation import impute, orphans, quality, wide

T = lambda d: dt.datetime(2024, 1, d)


# ---------------------------------------------------------------- orphans


def _orphans(spark, child, parent, **how):
    c = spark.createDataFrame(child, "rec_id long, k string, loaded_at timestamp_ntz, _key string, reason int")
    p = spark.createDataFrame(parent, "k string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, rec_id string")
    folded = orphans.fold_parent(p, "k", "loaded_at", "deleted_at")
    rows = sorted(tuple(r) for r in orphans.orphan_rows(c, "k", "loaded_at", folded, "rec_id", **how).collect())
    counts = sorted((tuple(r) for r in orphans.orphan_counts(c, "k", "loaded_at", folded, **how).collect()), key=repr)
    return rows, counts


CHILD = [
    (1, "a", T(5), "x", 1), (2, " A\t", T(1), "x", 1), (3, "b", T(5), "x", 1), (4, "b", T(3), "x", 1), (5, "zz", T(5), "x", 1), (6, None, T(5), "x", 1),
    (7, " \t", T(5), "x", 1), (8, "a", None, "x", 1), (9, "none", None, "x", 1), (5, "zz", T(5), "x", 1), (10, "c", T(9), "x", 1),
]
PARENT = [("A", T(2), None, "p"), ("a ", T(4), T(5), "p"), ("B", T(2), T(4), "p"), ("b", T(3), T(5), "p"), (None, T(1), None, "p"), ("", T(1), None, "p"), ("C", None, T(9), "p")]
REASONS = [(2, "late"), (3, "deleted"), (5, "missing"), (5, "missing"), (9, "missing"), (10, "deleted")]


@pytest.mark.parametrize("how", [{}, {"share": 0.1}, {"share": 2.0}])
def test_orphans(spark, how):
    rows, counts = _orphans(spark, CHILD, PARENT, **how)
    assert rows == REASONS
    assert sum(c[2] for c in counts) == 6 and ("2024-01", "missing", 2) in counts


def test_orphans_of_empty_tables(spark):
    assert _orphans(spark, [], PARENT) == ([], [])
    assert [r[0] for r in _orphans(spark, CHILD, [])[0]] == [1, 2, 3, 4, 5, 5, 8, 9, 10]


def test_heavy_keys_are_bounded(spark):
    groups = spark.range(1000).selectExpr("if(id < 400, 'hot', concat('k', id)) as _key", "cast(1 as long) as _n")
    assert [r[0] for r in orphans.heavy_keys(groups, 0.01).collect()] == ["hot"]


def test_hot_orphans_at_the_boundary(spark):
    """A key with most references, one day of a month before and one after its first load."""
    child = [(i, "hot", T(1 + i % 28), "x", 1) for i in range(280)] + [(1000 + i, f"k{i}", T(3), "x", 1) for i in range(40)]
    parent = [("HOT", T(11), T(21), "p")] + [(f"K{i}", T(1), None, "p") for i in range(0, 40, 2)]
    rows, counts = _orphans(spark, child, parent)
    late, deleted = [r for r in rows if r[1] == "late"], [r for r in rows if r[1] == "deleted"]
    assert (len(late), len(deleted), len(rows)) == (100, 80, 200)
    assert counts == [("2024-01", "deleted", 80), ("2024-01", "late", 100), ("2024-01", "missing", 20)]


# ---------------------------------------------------------------- wide tables

GENES = [("G1", "double"), ("G2", "bigint"), ("G3", "boolean"), ("G4", "string"), ("ENTITY", "string")]
CELLS = [
    (1, "s1", "g1", "1.50", T(1)), (2, " S1 ", "G1 ", "+1.5e0", T(2)), (3, "s1", "g2", "007", T(1)), (4, "s1", "g2", "7", T(1)), (5, "s1", "g2", "x", T(3)),
    (6, "s1", "g3", "YES", T(1)), (7, "s1", "g3", "0", T(2)), (8, "s1", "g4", " b ", T(1)), (9, "s2", "g1", "ND", T(1)), (10, "s2", "g1", None, T(1)),
    (11, "s2", "g9", "anything", T(1)), (12, None, "g1", "1", T(1)), (13, "s3", "", "1", T(1)), (14, "s3", "g1", " \t", T(1)), (6, "s1", "g3", "YES", T(1)), (15, "s2", "entity", "e", T(1)),
    (16, "s2", "g2", "123456789012345678901234", T(1)), (17, "s4", "g1", ".5", T(1)),
]


def _wide(spark, rows, batches=(), bucketed=True):
    types = wide.attribute_types(spark.createDataFrame(GENES, "gene string, value_type string"), "gene", "value_type")
    df = spark.createDataFrame(rows, "rec_id long, sample_id string, gene string, v string, loaded_at timestamp_ntz").selectExpr("*", "1 as entity", "2 as conflict", "'q' as run", "'z' as cells")
    log = wide.Log(spark, buckets=3)
    assert log.bucketed
    log.bucketed = bucketed
    for part in batches or [None]:  # one batch, or one after another
        log.upsert(df if part is None else df.filter(part), types, "sample_id", "gene", "v", ["loaded_at", "rec_id"])
    return (log.compact() if batches else log).cells(), types


@pytest.mark.parametrize("bucketed", [True, False])
@pytest.mark.parametrize("batches", [(), ("rec_id % 3 = 0", "rec_id % 3 = 1", "rec_id % 3 = 2", "rec_id % 3 = 1")])
def test_wide(spark, batches, bucketed):
    cells, types = _wide(spark, CELLS, batches, bucketed)
    assert sorted(tuple(r) for r in wide.issues(cells).collect()) == [("S1", "G2", "unreadable"), ("S1", "G3", "conflict"), ("S2", "G1", "unreadable"), ("S4", "G1", "unreadable")]
    got = {r[0]: r.asDict() for r in wide.widen(cells, types, "entity").collect()}
    assert got["S1"] == {"entity": "S1", "ENTITY_": None, "G1": 1.5, "G2": 7, "G3": False, "G4": "b"}
    assert got["S2"]["G1"] is None and got["S2"]["ENTITY_"] == "e" and got["S2"]["G2"] is None and "S3" not in got


def test_a_cell_read_again_and_again(spark, monkeypatch):
    """Folded in parts before the shuffle, with NULL versions and unreadable entries, it is the latest readable one all the same."""
    monkeypatch.setattr(wide, "FOLDED", 7)
    rows = [(i, "s1", "g1", "x" if i % 5 == 0 else f"{i}", T(1 + i % 28) if i % 3 else None) for i in range(200)] + [(500, "s1", "g2", "4", None), (501, "s1", "g2", "y", T(2))]
    cells, _ = _wide(spark, rows)
    got = {r.attribute: (r.entry, r.conflict, r.unreadable) for r in cells.collect()}
    latest = max((r for r in rows[:200] if r[3] != "x" and r[4]), key=lambda r: (r[4], r[0]))
    assert got == {"G1": (latest[3], True, True), "G2": ("4", False, True)}


def test_runs_are_merged_without_a_shuffle(spark):
    cells, _ = _wide(spark, CELLS)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "bucketed" in plan.lower()


def test_wide_of_nothing(spark):
    cells, types = _wide(spark, [])
    assert wide.issues(cells).count() == 0
    assert wide.widen(cells, types, "sample_id").columns == ["sample_id", "ENTITY", "G1", "G2", "G3", "G4"]


# ---------------------------------------------------------------- profiles


def test_profile(spark, tmp_path):
    rows = [("a", t) for t in ["1", " 2 ", "+2.0", "", None, "NaN", "-1", "x", ">3", "2e3"]] + [("b", "10")] * 3 + [(None, "5")]
    spark.createDataFrame(rows, "load_id string, v string").selectExpr("*", "1 as value", "'q' as col_name", "2 as n").write.parquet(str(tmp_path / "t"))
    p = {r.load_id: r for r in quality.profile(spark, {"t": (str(tmp_path / "t"), {"v": (0.0, False, None)})}, "load_id").collect()}
    a = p["a"]
    assert (a.rows_n, a.missing_n, a.unreadable_n, a.outside_n, a.inside_n, a.distinct_n, a.lowest, a.highest, a.median, a.most_n) == (10, 2, 4, 1, 3, 3, -1.0, 2.0, 2.0, 2)
    assert p["b"].median == 10 and p[None].median == 5 and a.centre == 5
    found = {(r.load_id, r.issue) for r in quality.outliers(quality.profile(spark, {"t": (str(tmp_path / "t"), {"v": (0.0, False, None)})}, "load_id")).collect()}
    assert found == {("a", x) for x in ("missing", "unreadable", "range", "frequent", "shift")} | {("b", "frequent"), ("b", "shift"), (None, "frequent")}


def test_exact_medians(spark):
    import random
    import statistics

    rnd = random.Random(3)
    rows = [(g, rnd.choice([rnd.gauss(0, 1e6), float(rnd.randint(0, 3)), 1e300])) for g in ("a", "b", None) for _ in range(rnd.randint(40, 60))]
    df = spark.createDataFrame(rows, "g string, value double").groupBy("g", "value").count().withColumnRenamed("count", "n")
    got = {r.g: r["median"] for r in quality.exact_medians(df, ["g"]).collect()}
    assert got == {g: pytest.approx(statistics.median(v for h, v in rows if h == g)) for g in ("a", "b", None)}


def test_profile_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "load_id string, v double").write.parquet(str(tmp_path / "e"))
    assert quality.profile(spark, {"e": (str(tmp_path / "e"), {"v": (0.0, True, 100.0)})}, "load_id").count() == 0


def test_ways_of_chunks(spark, tmp_path):
    """Settled, dictionary and scanned chunks give the same counts as reading all rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    big = 2**53
    sets = {
        "constant": ([5] * 50, True), "wide": ([big, big + 1] * 25, True), "mixed": ([None, "x", " 7", "7.0", "07"] * 10, True),
        "plain": ([f"{i}.50" for i in range(50)], False), "none": ([None] * 50, True), "nan": ([float("nan"), 1.0, None, 2.0, -0.0] * 10, True),
    }
    for name, (values, dictionary) in sets.items():
        table = pa.table({"v": values if name != "none" else pa.array(values, pa.string()), "load_id": ["a"] * 20 + ["b"] * 20 + [None] * 10})
        (tmp_path / name).mkdir()
        pq.write_table(table, tmp_path / name / "one.parquet", row_group_size=20, use_dictionary=["v", "load_id"] if dictionary else ["load_id"])
        pq.write_table(table.slice(0, 5), tmp_path / name / "two.parquet")
        ways = quality.chunks(spark, {"t": (str(tmp_path / name), {"v": (0.0, True, None)})}, "load_id").first()
        assert (ways.rows_n, ways.nulls_n) == (55, sum(v is None for v in values) + sum(v is None for v in values[:5]))
        expected = {"constant": ways.settled, "none": ways.settled, "plain": ways.scan}.get(name, ways.dictionary)
        assert expected > 0
        p = {r.load_id: r for r in quality.profile(spark, {"t": (str(tmp_path / name), {"v": (0.0, True, None)})}, "load_id").collect()}
        assert {k: r.rows_n for k, r in p.items()} == {"a": 25, "b": 20, None: 10}
        if name == "wide":
            assert p["a"].distinct_n == 2 and p["b"].most_n == 10
        if name == "mixed":
            assert (p["b"].distinct_n, p["b"].missing_n, p["b"].unreadable_n, p["b"].most_n) == (1, 4, 4, 12)
        if name == "nan":
            assert (p["b"].distinct_n, p["b"].unreadable_n, p["b"].lowest, p["b"].highest) == (3, 4, 0.0, 2.0)
        if name == "none":
            assert p["b"].missing_n == 20 and p["b"]["median"] is None


def test_medians_with_strays(spark):
    rows = [("a", 1e12, 1), ("a", -1e300, 1)] + [("a", 5 + i / 1e6, 1) for i in range(999)]
    assert quality.exact_medians(spark.createDataFrame(rows, "g string, value double, n long"), ["g"]).first()["median"] == 5 + 499 / 1e6


# ---------------------------------------------------------------- imputation

SUBJECT = "rec_id long, age int, sex string, site string, bmi double, smoker_status string, enrolled_on date, bmi_filled string, extra int"


def _subjects(n):
    out = []
    for i in range(n):
        site = ("North", "South")[i % 2]
        bmi = 20.0 + 8 * (i % 2) + (i % 5) / 10
        status = "never" if i % 2 else "former"
        out.append((i, 30 + i % 40, "MF"[i % 2], site, bmi, status, dt.date(2024, 1 + i % 12, 1), "kept", i))
    return out


def test_impute(spark):
    rows = _subjects(400)
    holes = {0: ("bmi", None), 1: ("bmi", float("nan")), 2: ("bmi", 99.0), 3: ("site", "N/A"), 4: ("site", " unknown site"), 5: ("smoker_status", "-"), 6: ("smoker_status", ""), 7: ("site", None), 8: ("smoker_status", "not recorded")}
    at = {"site": 3, "bmi": 4, "smoker_status": 5}
    for i, (f, v) in holes.items():
        r = list(rows[i])
        r[at[f]] = v
        rows[i] = tuple(r)
    kept = list(rows[20])
    kept[3] = "NORTH "
    rows[20] = tuple(kept)
    out = impute.impute(spark.createDataFrame(rows, SUBJECT), impute.SUBJECTS)
    assert out.columns[-3:] == ["bmi_filled_", "smoker_status_filled", "site_filled"]
    got = {r.rec_id: r for r in out.collect()}
    for i, (f, _) in holes.items():
        assert got[i]["bmi_filled_" if f == "bmi" else f + "_filled"]
    assert sum(r.bmi_filled_ + r.site_filled + r.smoker_status_filled for r in got.values()) == len(holes)
    assert abs(got[0].bmi - 20) < 3 and abs(got[1].bmi - 28) < 3 and got[3].site == "South" and got[4].site == "North"
    assert got[5].smoker_status == "never" and got[6].smoker_status == "former" and got[20].site == "NORTH " and got[20].bmi_filled == "kept"
    again = {r.rec_id: r for r in impute.impute(spark.createDataFrame(rows, SUBJECT), impute.SUBJECTS).collect()}
    assert again == got


def test_impute_without_values(spark):
    row = (1, None, None, None, None, None, None, "k", 1)
    for rows in ([], [row, row]):
        out = impute.impute(spark.createDataFrame(rows, SUBJECT), impute.SUBJECTS).collect()
        assert all(r.bmi is None and r.site is None and not r.bmi_filled_ and not r.site_filled for r in out) and len(out) == len(rows)


@pytest.mark.parametrize("sites", [300, 700])
def test_many_even_classes(spark, sites):
    """Every hole is filled, from all of the classes, also where there are more than models tell apart."""
    rows = [(i, 40, "F", None if i % 11 == 0 else f"site {i % sites}", 24.0, "never", dt.date(2024, 1, 1), "k", i) for i in range(12 * sites)]
    got = impute.impute(spark.createDataFrame(rows, SUBJECT), impute.SUBJECTS).filter("site_filled").collect()
    assert len(got) == len([r for r in rows if r[3] is None]) and all(r.site is not None for r in got)
    used = {int(r.site.split()[1]) for r in got}
    assert len(used) > sites / 3 and all(u < sites for u in used)


def test_spellings():
    s = impute._Speller()
    for name in ("site b11", "hospital north", "ward"):
        s.add(name)
    assert s.nearest("hospitel norh") == 1 and s.nearest("site b12") == -1 and s.nearest("wart") == 2 and s.nearest("word x") == -1 and s.nearest("x" * 100_000) == -1


def test_residual_variation_is_kept(spark):
    rows = [(r[0], r[1], r[2], r[3], None if i % 4 == 0 else r[4] + (i * 7919 % 101 - 50) / 20, *r[5:]) for i, r in enumerate(_subjects(800))]
    got = impute.impute(spark.createDataFrame(rows, SUBJECT), impute.SUBJECTS).filter("site = 'North'")
    spread = {r.bmi_filled_: r.s for r in got.groupBy("bmi_filled_").agg({"bmi": "stddev"}).withColumnRenamed("stddev(bmi)", "s").collect()}
    assert 0.6 < spread[True] / spread[False] < 1.6
