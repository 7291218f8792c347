"""Command line: python -m quernel.cli COMMAND ...; text in, text out, - is standard input."""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession

from quernel import operators as ops
from quernel.runtime import SETTINGS
from quernel.sources import text, xlsx
from quernel.table import Table


class _Load(argparse.Action):
    """Files to load, each with the name of its sheet as soon as one is given."""

    def __call__(self, parser, namespace, values, option_string=None):
        setattr(namespace, self.dest, [*(getattr(namespace, self.dest) or []), *[[v, None] for v in values]])


class _Sheet(argparse.Action):
    """Sheets to choose; behind --load the name of the last file that has none."""

    def __call__(self, parser, namespace, values, option_string=None):
        if namespace.load:
            free = [x for x in namespace.load if x[1] is None]
            if not free:
                parser.error("-s must follow a --load FILE")
            free[-1][1] = values
        namespace.sheet = [*(namespace.sheet or []), values]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernel")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, files: str | None = "?", reader: bool = True):
        c = sub.add_parser(name)
        if files:
            c.add_argument("file", nargs=files, default="-" if files == "?" else None)
        if reader:
            c.add_argument("-H", "--no-header", action="store_true")
            c.add_argument("-C", "--comment-char", default="#")
            c.add_argument("-E", "--ignore-empty-row", action="store_true")
            c.add_argument("-I", "--ignore-illegal-row", action="store_true")
        return c

    command("cut").add_argument("-f", "--fields", required=True)
    command("filter").add_argument("-e", "--expr", required=True)
    c = command("mutate")
    c.add_argument("-e", "--expr", action="append", required=True)
    c.add_argument("--overwrite", action="store_true")
    c = command("summarize")
    c.add_argument("-g", "--group")
    c.add_argument("-s", "--stat", action="append", required=True)
    c = command("join", "+")
    c.add_argument("-f", "--fields", required=True)
    c.add_argument("-F", "--select")
    c.add_argument("-k", "--keep", default="")
    c.add_argument("--fill")
    c.add_argument("--sorted", action="store_true")
    c.add_argument("-t", "--threads", type=int, help="accepted; Spark schedules by itself")
    c = command("sort")
    c.add_argument("-k", "--key", action="append", required=True)
    c.add_argument("--unstable", action="store_true", help="accepted; sorts are stable")
    command("slice").add_argument("-r", "--rows", action="append", required=True)
    c = command("melt")
    c.add_argument("-i", "--id", required=True)
    c.add_argument("-v", "--value-cols")
    c.add_argument("--variable", default="variable")
    c.add_argument("--value", default="value")
    c.add_argument("--fill")
    c = command("pivot")
    c.add_argument("-i", "--index", required=True)
    c.add_argument("-c", "--column", required=True)
    c.add_argument("-v", "--value", required=True)
    c.add_argument("--fill")
    command("info").add_argument("-n", "--preview", type=int, default=3)
    command("pretty").add_argument("-r", "--round", type=int)
    c = command("csv")
    c.add_argument("-d", "--delim", default=",")
    c.add_argument("--na")
    c.add_argument("--lazy-quotes", action="store_true")
    c = command("excel", None, reader=False)
    mode = c.add_mutually_exclusive_group(required=True)
    for m in ("sheets", "preview", "dump"):
        mode.add_argument(f"--{m}", metavar="FILE")
    mode.add_argument("--load", nargs="+", action=_Load, metavar="TSV", help="again for each file; a name behind it (-s) is that of its sheet")
    c.add_argument("-H", "--no-header", action="store_true")
    c.add_argument("-s", "--sheet", action=_Sheet)
    c.add_argument("-n", "--head", type=int, default=10)
    c.add_argument("-f", "--fields")
    c.add_argument("--pretty", action="store_true")
    c.add_argument("-r", "--rows")
    c.add_argument("-o", "--out")
    c.add_argument("--na")
    c.add_argument("--dates", choices=("iso", "excel", "raw"))
    c.add_argument("--types", choices=("infer", "string"), default="infer")
    c.add_argument("--formulas", action="store_true")
    c.add_argument("--values", action="store_true")
    c.add_argument("--escape-tabs", action="store_true")
    c.add_argument("--escape-newlines", action="store_true")
    c.add_argument("--max-rows-per-sheet", type=int, default=xlsx.MAX_ROWS)
    return p


STRICT = {"join", "sort", "melt", "pivot", "pretty"}


def _load(spark: SparkSession, a: argparse.Namespace, path: str, spool: str) -> Table:
    if path == "-":
        path = str(Path(spool) / "stdin.tsv")
        with open(path, "wb") as f:
            shutil.copyfileobj(sys.stdin.buffer, f)
    more = {"sep": a.delim, "na": a.na, "doubled_quotes": not a.lazy_quotes} if a.command == "csv" else {}
    t = text.read(
        spark, path, header=not a.no_header, comment=a.comment_char, skip_empty=a.ignore_empty_row, skip_ragged=a.ignore_illegal_row,
        strict=a.command in STRICT and not a.ignore_illegal_row, multiline=None, **more,
    )
    return Table(t.df, t.names, t.has_header, text_mode=True)


def run(a: argparse.Namespace, spark: SparkSession, spool: str):
    """The result as a table, as text or as lines."""
    if a.command == "excel":
        return _excel(a, spark)
    tables = [_load(spark, a, f, spool) for f in (a.file if isinstance(a.file, list) else [a.file])]
    t = tables[0]
    match a.command:
        case "cut":
            return ops.cut(t, a.fields)
        case "filter":
            return ops.keep(t, a.expr)
        case "mutate":
            return ops.mutate(t, *a.expr, overwrite=a.overwrite)
        case "summarize":
            return ops.summarize(t, a.stat, a.group)
        case "join":
            return ops.join(tables, a.fields, a.keep, a.select, a.fill, a.sorted)
        case "sort":
            return ops.sort(t, *a.key)
        case "slice":
            return ops.take(t, ",".join(a.rows))
        case "melt":
            return ops.melt(t, a.id, a.value_cols, a.variable, a.value, a.fill)
        case "pivot":
            return ops.pivot(t, a.index, a.column, a.value, a.fill)
        case "info":
            facts = ops.info(t, a.preview)
            rows = facts.df.select("_c" + str(len(facts.names) - 1)).first()
            shown = ops.cut(facts, ":-2")
            return f"#shape({rows[0] if rows else 0}, {len(t.names)})\n" + "\n".join(text.lines(shown))
        case "pretty":
            return text.pretty_lines(t, a.round)
        case _:
            return t


def _excel(a: argparse.Namespace, spark: SparkSession):
    if a.sheets:
        return "\n".join(f"{n}\t{name}\trows={r}\tcols={c}\ttypes=[{', '.join(k)}]" for n, name, r, c, k in xlsx.list_sheets(a.sheets))
    if a.preview:
        return xlsx.preview(a.preview, a.sheet, a.head, a.dates or "iso", a.formulas, not a.no_header, a.pretty)
    if a.dump:
        return xlsx.read(
            spark, a.dump, (a.sheet or ["1"])[0], not a.no_header, a.fields, a.rows, a.na, a.dates or "iso", a.formulas, a.escape_tabs, a.escape_newlines
        )
    if not a.out:
        raise SystemExit("--load needs -o FILE")
    tables = {}
    for n, (f, name) in enumerate(a.load, 1):
        t = text.read(spark, f, header=not a.no_header, comment="", multiline=None)
        if a.no_header and a.fields:
            heads = xlsx.header_names(a.fields)
            t = Table(t.df, tuple(heads[: len(t.names)]) + t.names[len(heads) :], True)
        if (name or str(n)) in tables:
            raise SystemExit(f"two sheets of the name {name or n}")
        tables[name or str(n)] = t
    xlsx.write(a.out, tables, a.max_rows_per_sheet, a.types, a.dates or "excel", a.na, header=not a.no_header or bool(a.fields))
    return ""


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    defaults = SETTINGS | {"spark.master": "local[*]", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if "spark.master" not in dict(SparkConf().getAll()):  # not started by spark-submit: a small session of its own
        defaults["spark.sql.shuffle.partitions"] = "8"
    builder = SparkSession.builder
    for k, v in defaults.items():
        if k not in dict(SparkConf().getAll()):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as spool:
        out = run(a, spark, spool)
        try:
            for line in text.lines(out) if isinstance(out, Table) else [out] if isinstance(out, str) and out else out or []:
                sys.stdout.write(line + "\n")
            sys.stdout.flush()
        except BrokenPipeError:
            return 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
