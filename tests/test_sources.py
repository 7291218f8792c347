"""Text, compressed text, workbooks, footers."""

import gzip
import lzma

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quernel.sources import footers, text, xlsx
from quernel.table import Table

BODY = '# note\nid\tname\tv\n1\t"a\tb"\t"say ""hi"""\n\n2\tx\n   \t\t\n3\ty\tz\textra\n'


def got(t):
    return [tuple(r) for r in t.df.orderBy("__o").drop("__o").collect()]


@pytest.mark.parametrize("name, pack", [("t.tsv", lambda b: b), ("t.tsv.gz", lambda b: gzip.compress(b[:20]) + gzip.compress(b[20:])), ("t.tsv.xz", lzma.compress)])
def test_read(spark, tmp_path, name, pack):
    p = tmp_path / name
    p.write_bytes(pack(BODY.encode()))
    t = text.read(spark, str(p))
    assert t.names == ("id", "name", "v")
    assert got(t) == [("1", "a\tb", 'say "hi"'), ("2", "x", ""), ("   ", "", ""), ("3", "y", "z")]
    assert len(got(text.read(spark, str(p), skip_empty=True))) == 3
    assert [r[0] for r in got(text.read(spark, str(p), skip_ragged=True))] == ["1", "   "]
    assert got(text.read(spark, str(p), na="NA"))[1] == ("2", "x", "NA")
    assert text.read(spark, str(p), header=False).names == ("col1", "col2", "col3")
    with pytest.raises(Exception, match="another width"):
        got(text.read(spark, str(p), strict=True))


def test_header_behind_comment_sign_and_empty(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("#id,b\r\n1,\r\n")
    assert text.read(spark, str(p), sep=",").names == ("1", "")
    assert got(text.read(spark, str(p), sep=",", comment="", na="-")) == [("1", "-")]
    p.write_text("")
    assert text.read(spark, str(p)).names == ()


def test_write_and_pretty(spark, tmp_path):
    t = Table.of(spark.createDataFrame([(2, "y", 1.5), (1, None, 2.0)], "i int, s string, d double"), ["i"])
    assert list(text.lines(t)) == ["i\ts\td", "1\t\t2", "2\ty\t1.5"]
    text.write(t, str(tmp_path / "out"), ordered=True)
    back = text.read(spark, str(next((tmp_path / "out").glob("*.txt"))))
    assert got(back) == [("1", "", "2"), ("2", "y", "1.5")]
    assert list(text.pretty_lines(t, 0)) == text.pretty(t, digits=0).splitlines()
    assert list(text.pretty_lines(t)) == text.pretty(t).splitlines() and list(text.pretty_lines(Table(t.df.limit(0), t.names))) == text.pretty(Table(t.df.limit(0), t.names)).splitlines()
    assert text.pretty(t, digits=0).splitlines()[1:5] == ["| i | s | d |", "+---+---+---+", "| 1 |   | 2 |", "| 2 | y | 2 |"]


def test_workbook_round_trip(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    data = [(1, "007", "2024-03-01", "1.50", "true", "<&>", "2024-03-01 12:30:00"), (2, "x", "", "2", "false", "a\tb", "")]
    t = Table.of(spark.createDataFrame(data, "n int, s string, d string, f string, b string, q string, m string"), ["n"])
    assert xlsx.write(p, {"One": t, "Two": t}, max_rows=2) == ["One", "One (2)", "Two", "Two (2)"]
    xlsx.write(p, {"One": t})
    assert xlsx.list_sheets(p) == [(1, "One", 3, 7, ["mixed", "string", "mixed", "mixed", "mixed", "string", "mixed"])]
    back = xlsx.read(spark, p, na="NA", escape_tabs=True)
    assert got(back) == [("1", "007", "2024-03-01", "1.5", "true", "<&>", "2024-03-01T12:30:00"), ("2", "x", "NA", "2", "false", "a\\tb", "NA")]
    assert got(xlsx.read(spark, p, "One", fields="B,n,D:E", rows="-1")) == [("2", "x", "2", "false")]
    assert got(xlsx.read(spark, p, dates="raw", fields="d"))[0] == ("45352",)
    assert xlsx.preview(p, rows=1).splitlines() == ["#1 One", "n\ts\td\tf\tb\tq\tm", "1\t007\t2024-03-01\t1.5\ttrue\t<&>\t2024-03-01T12:30:00"]
    with pytest.raises(Exception):
        xlsx.read(spark, p, "Nope").df.collect()


def test_footers_settle_chunks(spark, tmp_path):
    d = tmp_path / "t.parquet"
    d.mkdir()
    nan = float("nan")
    pq.write_table(pa.table({"load": ["a", "a"], "n": pa.array([None, None], pa.float64()), "i": [5, 5]}), d / "1.parquet")
    pq.write_table(pa.table({"load": ["a", "b"], "n": pa.array([1.0, nan]), "i": [5, 6]}), d / "2.parquet")
    facts = {(r.uri[-9:], r.col_name): (r.way, r.load_settled) for r in footers.footers(spark, str(d), ["n", "i"], "load").collect()}
    assert facts == {("1.parquet", "n"): ("settled", True), ("1.parquet", "i"): ("settled", True), ("2.parquet", "n"): ("dictionary", False), ("2.parquet", "i"): ("dictionary", False)}
    counts = footers.value_counts(spark, str(d), ["n", "i"], "load").groupBy("col_name", "load_id", "text", "number").sum("n").collect()
    assert sorted((r.col_name, r.load_id, str(r.text), str(r.number), r[4]) for r in counts) == [
        ("i", "a", "5", "None", 3), ("i", "b", "6", "None", 1), ("n", "a", "None", "1.0", 1), ("n", "a", "None", "None", 2), ("n", "b", "NaN", "None", 1)
    ]


QUOTED = 'id\tnote\n1\t"two\nlines, ""said"" #3"\n# no row\n2\t"x"\n'


@pytest.mark.parametrize("name, pack", [("q.tsv", lambda b: b), ("q.tsv.gz", gzip.compress), ("q.tsv.xz", lzma.compress)])
def test_quoted_line_ends(spark, tmp_path, name, pack):
    p = tmp_path / name
    p.write_bytes(pack(QUOTED.encode()))
    want = [("1", 'two\nlines, "said" #3'), ("2", "x")]
    assert got(text.read(spark, str(p), multiline=True)) == want and got(text.read(spark, str(p), multiline=None)) == want
    with pytest.raises(Exception, match="multiline"):
        got(text.read(spark, str(p)))


def test_folders(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.tsv").write_text(f"# part {i}\na\tb\n{i}\tx\n")
    assert sorted(got(text.read(spark, str(tmp_path)))) == [("0", "x"), ("1", "x"), ("2", "x")]
    assert len(got(text.read(spark, str(tmp_path), header=False))) == 6
    (tmp_path / "9.tsv").write_text("a\tc\n")
    with pytest.raises(ValueError, match="header"):
        text.read(spark, str(tmp_path))


def test_cells_of_loaded_workbooks():
    assert [xlsx._typed(t, "infer", "excel", None) for t in ("+5", "-1234567890123456789", "9999999999999999999", "007")] == [
        "><v>5</v>", "><v>-1234567890123456789</v>", ' t="inlineStr"><is><t xml:space="preserve">9999999999999999999</t></is>', ' t="inlineStr"><is><t xml:space="preserve">007</t></is>'
    ]
    assert xlsx._typed("6:30", "infer", "excel", None).startswith(' s="3"><v>0.2708') and xlsx._typed("2024-03-01T12:00Z", "infer", "excel", None) == ' s="2"><v>45352.5</v>'
    assert "inlineStr" in xlsx._typed("25:99", "infer", "excel", None) and "inlineStr" in xlsx._typed("5", "string", "excel", None)
    assert xlsx.header_names("S1..S3") == ["S1", "S2", "S3"] and xlsx.header_names("a, b") == ["a", "b"]
    with pytest.raises(Exception):
        xlsx.header_names("S3..T4")


def test_command_line(spark, tmp_path, capsys):
    from quernel import cli

    p = tmp_path / "s.tsv"
    p.write_text("name\tsubject\tscore\nAlice\tmath\t88\nBob\tmath\t92\nCara\tart\t88\n")
    run = lambda *a: cli.run(cli._parser().parse_args(a), spark, str(tmp_path))
    assert list(text.lines(run("summarize", "-g", "subject", "-s", "score=mean,count", str(p)))) == ["subject\tscore_mean\tscore_count", "math\t90\t2", "art\t88\t1"]
    assert list(text.lines(run("slice", "-r", "2", str(p)))) == ["name\tsubject\tscore", "Bob\tmath\t92"]
    assert list(text.lines(run("filter", "-e", "$score / 3 < 30", str(p))))[1:] == ["Alice\tmath\t88", "Cara\tart\t88"]
    assert run("info", str(p)).splitlines()[:2] == ["#shape(3, 3)", "index\tname\ttype\tfirst3"]
    assert list(run("pretty", str(p)))[:4] == ["+-------+---------+-------+", "| name  | subject | score |", "+-------+---------+-------+", "| Alice | math    | 88    |"]
    assert list(run("pretty", "-H", "-r", "0", str(p)))[1:3] == ["| name  | subject | score |", "| Alice | math    | 88    |"]
    assert run("info", "--preview", "1", str(p)).splitlines()[1] == "index\tname\ttype\tfirst1"
    w = str(tmp_path / "w.xlsx")
    run("excel", "--load", str(p), "-s", "S", "--load", str(p), "-o", w)
    assert run("excel", "--sheets", w).splitlines() == [f"{i}\t{n}\trows=4\tcols=3\ttypes=[string, string, mixed]" for i, n in ((1, "S"), (2, "2"))]
    assert run("excel", "--preview", w, "-n", "1", "--pretty", "-s", "S").splitlines()[:5] == [
        "#1 S", "+-------+---------+-------+", "| name  | subject | score |", "+-------+---------+-------+", "| Alice | math    | 88    |"
    ]
    run("excel", "--load", str(p), str(p), "-H", "-f", "S1..S3", "-o", w)
    assert run("excel", "--preview", w, "-n", "0", "-s", "2") == "#2 2\nS1\tS2\tS3"
    assert list(text.lines(run("excel", "--dump", w, "-s", "2", "-r", "2"))) == ["S1\tS2\tS3", "Alice\tmath\t88"]


def test_quoted_line_ends_in_whole_batches_and_empty_files(spark, tmp_path):
    """Files of no rows, and of just as many as are handed on at once."""
    (tmp_path / "0.tsv").write_text("")
    (tmp_path / "1.tsv").write_text("".join(f'{i}\t"a\nb"\n' for i in range(20_000)))
    (tmp_path / "2.tsv").write_text('x\t"a\nb"\n')
    t = text.read(spark, str(tmp_path), header=False, multiline=None)
    assert t.df.count() == 20_001 and t.df.select("_c1").distinct().collect() == [("a\nb",)]
    (tmp_path / "3.tsv").write_text("# no row\n")
    assert text.read(spark, str(tmp_path / "3.tsv"), multiline=True).names == ()
