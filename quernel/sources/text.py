"""Delimited text: tables of tab- or otherwise separated lines, plain, .gz or .xz.

Lines are parsed inside the JVM, so a plain file is split over tasks. Fields may be quoted, quotes in
them doubled. A quoted field that goes on over a line's end is an error there; with multiline, files are
parsed as a whole instead, one task each. Blank lines and comments are no rows. Of several files each
has a header of its own, and all headers must be the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.table import ORDER, Table


class RaggedRow(ValueError):
    pass


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line)"""
    if PurePath(path).suffix.lower() != ".xz":
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for file, content in zip(pdf["path"], pdf["content"]):
                held: list[str] = []
                for line in _open(file, content):
                    held.append(line.rstrip("\n"))
                    if len(held) >= 50_000:
                        yield pd.DataFrame({"file": file, "line": held})
                        held = []
                yield pd.DataFrame({"file": file, "line": held}, columns=["file", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, line string")


def _open(file: str, content: bytes):
    """The lines of a file, unpacked by its name."""
    import gzip
    import io
    import lzma

    raw = io.BytesIO(content)
    packed = {".xz": lzma.open, ".gz": gzip.open}.get(PurePath(file).suffix.lower())
    return packed(raw, "rt", encoding="utf-8", newline="\n") if packed else io.TextIOWrapper(raw, encoding="utf-8", newline="\n")


def _records(spark: SparkSession, path: str, sep: str, comment: str, doubled: bool) -> DataFrame:
    """(file, f): the rows of files parsed as a whole; comments begin where a row would."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        csv.field_size_limit(1 << 31)
        for pdf in it:
            for file, content in zip(pdf["path"], pdf["content"]):
                inside = False

                def physical(lines=_open(file, content)):
                    nonlocal inside
                    for line in lines:
                        if not inside and (line.strip("\r\n") == "" or comment and line.startswith(comment)):
                            continue
                        inside = True
                        yield line

                held = []
                for row in csv.reader(physical(), delimiter=sep, doublequote=doubled):
                    inside = False
                    held.append(row)
                    if len(held) >= 20_000:
                        yield pd.DataFrame({"file": file, "f": held})
                        held = []
                if held:  # Arrow takes no list from a frame of no rows
                    yield pd.DataFrame({"file": file, "f": held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, f array<string>")


def _fields(line: Column, sep: str, quoting: bool, doubled: bool) -> Column:
    s = re.escape(sep)
    if not quoting:
        return F.split(line, s, -1)
    inner = '(?:[^"]|"")*' if doubled else '[^"]*'
    # A separator before the first field keeps every match from being empty.
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{s}("{inner}"[^{s}]*|[^{s}]*)'), F.lit(1))

    def bare(x: Column) -> Column:
        inside = F.regexp_replace(x, f'(?s)^"({inner})"(.*)$', "$1$2")
        open_end = F.raise_error(F.concat(F.lit("a quoted field goes on over the end of a line; read with multiline: "), F.substring(x, 1, 100)))
        closed = F.when(x.rlike(f'^"{inner}"'), F.replace(inside, F.lit('""'), F.lit('"')) if doubled else inside).otherwise(open_end.cast("string"))
        return F.when(x.startswith('"'), closed).otherwise(x)

    return F.transform(found, bare)


def read(
    spark: SparkSession, path: str, sep: str = "\t", header: bool = True, comment: str = "#", skip_empty: bool = False,
    skip_ragged: bool = False, strict: bool = False, doubled_quotes: bool = True, na: str | None = None, multiline: bool | None = False,
) -> Table:
    """A table of texts.

    comment: lines that begin with it are skipped ("" for none). skip_empty: rows of blank fields are
    no rows. Rows of another width than the header are dropped (skip_ragged), an error (strict) or
    filled up with "" and cut. na: text for empty fields. multiline: files are parsed as a whole, as
    quoted fields may hold line ends; None asks the files whether that is needed.
    """
    if len(sep) != 1:
        raise ValueError("the separator is one character")
    line = F.regexp_replace("line", "\r$", "")
    rows = _lines(spark, path).select("file", line.alias("line"), F.monotonically_increasing_id().alias(ORDER)).filter("line != ''")
    if comment:
        rows = rows.filter(~F.col("line").startswith(comment[0]))
    if multiline is None:
        s = re.escape(sep)
        quoted = rows.filter(F.col("line").contains('"'))
        multiline = not quoted.filter(F.concat(F.lit(sep), F.regexp_replace("line", f'(?<={s}|^)"(?:[^"]|"")*"', "")).rlike(f'{s}"')).isEmpty()
    if multiline:
        parsed = _records(spark, path, sep, comment[:1], doubled_quotes).select("file", "f", F.monotonically_increasing_id().alias(ORDER))
    else:
        parsed = rows.select("file", _fields(F.col("line"), sep, True, doubled_quotes).alias("f"), ORDER)
    first = parsed.limit(1).collect()
    if not first:
        return Table(spark.createDataFrame([], f"{ORDER} bigint"), (), header)
    width = len(first[0].f)
    names = tuple(first[0].f) if header else tuple(f"col{i + 1}" for i in range(width))
    if header and len(spark.read.format("binaryFile").load(path).inputFiles()) > 1:
        heads = parsed.groupBy("file").agg(F.min(F.struct(ORDER, "f")).alias("h")).select("file", "h.*")  # a row per file
        other = heads.filter(F.col("f") != F.array(*[F.lit(n) for n in names])).first()
        if other:
            raise ValueError(f"the header of {other.file} differs from that of {first[0].file}")
        parsed = parsed.join(F.broadcast(heads.select(ORDER)), ORDER, "left_anti")
    elif header:
        parsed = parsed.filter(F.col(ORDER) != first[0][ORDER])
    if skip_empty:
        parsed = parsed.filter(~F.forall("f", lambda x: F.trim(x) == ""))
    if skip_ragged:
        parsed = parsed.filter(F.size("f") == width)
    elif strict:
        wrong = F.raise_error(F.concat(F.lit(f"a row of another width than {width}: "), F.array_join("f", "|")))
        parsed = parsed.withColumn("f", F.when(F.size("f") == width, F.col("f")).otherwise(wrong.cast("array<string>")))
    cells = [F.coalesce(F.get("f", F.lit(i)), F.lit("")) for i in range(width)]
    if na is not None:
        cells = [F.when(c == "", F.lit(na)).otherwise(c) for c in cells]
    return Table(parsed.select(*[c.alias(f"_c{i}") for i, c in enumerate(cells)], ORDER), names, header)


def rendered(t: Table) -> DataFrame:
    """The rows as lines of tab-separated text (column value), nothing quoted, in no order."""
    return t.df.select(F.concat_ws("\t", *[t.cell(i).text for i in range(len(t.names))]).alias("value"), ORDER)


def write(t: Table, path: str, header: bool = True, ordered: bool = False) -> None:
    """Text files of lines; ordered: one file, in the table's order, header first."""
    lines = rendered(t)
    if not ordered:
        lines.select("value").write.mode("overwrite").text(path)
        return
    lines = lines.orderBy(ORDER).select("value")
    if header and t.has_header:
        head = t.df.sparkSession.createDataFrame([("\t".join(t.names),)], "value string")
        lines = head.coalesce(1).union(lines.coalesce(1)).coalesce(1)
    lines.coalesce(1).write.mode("overwrite").text(path)


def lines(t: Table, header: bool = True) -> Iterator[str]:
    """The table as lines in its order, a partition at a time."""
    if header and t.has_header and t.names:
        yield "\t".join(t.names)
    if t.names:
        for r in rendered(t).orderBy(ORDER).select("value").toLocalIterator():
            yield r.value


def rounded(text: str, digits: int) -> str:
    """A number with so many digits behind the point, tiny ones in scientific form; other texts as they are."""
    bare = text.strip()
    if not re.fullmatch(r"(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)", bare, re.A):
        return text
    x = float(bare)
    if x != x or x in (float("inf"), float("-inf")):
        return text
    if x and abs(x) < 10.0 ** -max(digits, 4):
        mantissa, exponent = f"{x:.{digits}e}".split("e")
        return f"{mantissa}e{int(exponent)}"
    out = f"{x:.{digits}f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


def pretty(t: Table, rows: int = 1000, digits: int | None = None) -> str:
    """The first rows as a boxed table."""
    if not t.names:
        return ""
    shown = t.df.orderBy(ORDER).limit(rows).select(*[t.cell(i).text.alias(f"c{i}") for i in range(len(t.names))]).collect()
    body = [[rounded(c, digits) if digits is not None else c for c in r] for r in shown]
    return boxed(list(t.names) if t.has_header else None, body)


def pretty_lines(t: Table, digits: int | None = None) -> Iterator[str]:
    """The whole table as lines of a frame: widths come from one pass, rows a partition at a time from another."""
    if not t.names:
        return
    shown = t.df.select(*[t.cell(i).text.alias(f"c{i}") for i in range(len(t.names))], ORDER)
    if digits is not None:
        short = F.pandas_udf(lambda s: s.map(lambda x: rounded(x, digits)), "string")
        shown = shown.select(*[short(f"c{i}").alias(f"c{i}") for i in range(len(t.names))], ORDER)
    found = shown.agg(*[F.max(F.char_length(f"c{i}")) for i in range(len(t.names))]).first()
    widths = [max(w or 0, len(n) if t.has_header else 0) for w, n in zip(found, t.names)]
    if all(w is None for w in found) and not t.has_header:
        return
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, widths)) + "|"
    yield rule
    if t.has_header:
        yield line(t.names)
        yield rule
    some = False
    for r in shown.orderBy(ORDER).drop(ORDER).toLocalIterator():
        some = True
        yield line(r)
    if some or not t.has_header:
        yield rule


def boxed(header: list[str] | None, body: list[list[str]]) -> str:
    """Rows in a frame; short rows are filled up."""
    table = ([header] if header else []) + body
    if not table:
        return ""
    columns = max(map(len, table))
    table = [[*r, *[""] * (columns - len(r))] for r in table]
    widths = [max(len(r[i]) for r in table) for i in range(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    out = [rule]
    for k, r in enumerate(table):
        out.append("|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, widths)) + "|")
        if k == 0 and header:
            out.append(rule)
    if out[-1] != rule:
        out.append(rule)
    return "\n".join(out)
