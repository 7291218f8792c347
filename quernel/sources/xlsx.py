"""Workbooks: reading, listing, previewing and writing .xlsx with the standard library only.

A workbook is a zip of XML; one task reads one workbook, row by row. Cells keep their kind (empty,
int, float, bool, string, date, duration, error) until they are rendered as text.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernel.functions.selectors import SelectorError, row_spans
from quernel.sources.text import boxed
from quernel.table import ORDER, Table

#: Namespaces, the first day of serial dates, number formats that are dates or times.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DURATION_FORMATS = frozenset([46])
MAX_ROWS = 1_048_576


@dataclass(frozen=True)
class Cell:
    kind: str  # empty int float bool string date duration error
    value: object = None
    formula: str | None = None


EMPTY = Cell("empty")


def letters(n: int) -> str:
    """1 -> A, 27 -> AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def from_letters(text: str) -> int:
    n = 0
    for c in text.upper():
        n = n * 26 + ord(c) - 64
    return n


class Workbook:
    """A workbook's sheets and their cells."""

    def __init__(self, source: bytes | str):
        self.zip = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        path = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
        self.sheets = {s.get("name"): path(targets[s.get(REL + "id")]) for s in book.iter(MAIN + "sheet")}
        pr = book.find(MAIN + "workbookPr")
        self.epoch = EPOCH_1904 if pr is not None and pr.get("date1904") in ("1", "true") else EPOCH
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")):
                self.shared.append("".join(t.text or "" for t in si.iter(MAIN + "t")))
        self.styles = self._styles()

    def _styles(self) -> list[str]:
        """Kind of each cell format: date, duration or plain."""
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(MAIN + "numFmt")}
        out = []
        for xf in root.findall(f"{MAIN}cellXfs/{MAIN}xf"):
            n = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", custom.get(n, "")).lower()
            if n in DURATION_FORMATS or re.search(r"\[[hms]+\]", code):
                out.append("duration")
            elif n in DATE_FORMATS or re.search(r"[ymdhs]", code):
                out.append("date")
            else:
                out.append("plain")
        return out

    def pick(self, which: str) -> str:
        """A sheet's name, by 1-based position or name; a position wins."""
        names = list(self.sheets)
        if which.isdigit() and 1 <= int(which) <= len(names):
            return names[int(which) - 1]
        if which in self.sheets:
            return which
        raise SelectorError(f"no sheet {which!r}")

    def rows(self, sheet: str) -> Iterator[list[Cell]]:
        """The rows of a sheet from the first to the last used one, as wide as their last cell."""
        last = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, el in ET.iterparse(f):
                if el.tag != MAIN + "row":
                    continue
                number = int(el.get("r", last + 1))
                for _ in range(number - last - 1):
                    if last:
                        yield []
                last = number
                row: list[Cell] = []
                for c in el.findall(MAIN + "c"):
                    at = from_letters(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else len(row) + 1
                    row += [EMPTY] * (at - 1 - len(row))
                    row.append(self._cell(c))
                yield row
                el.clear()

    def _cell(self, c) -> Cell:
        kind, v, f = c.get("t", "n"), c.find(MAIN + "v"), c.find(MAIN + "f")
        formula = f.text if f is not None else None
        if kind == "inlineStr":
            return Cell("string", "".join(t.text or "" for t in c.iter(MAIN + "t")), formula)
        if v is None or v.text is None:
            return Cell("empty", None, formula)
        if kind == "s":
            return Cell("string", self.shared[int(v.text)], formula)
        if kind == "str":
            return Cell("string", v.text, formula)
        if kind == "b":
            return Cell("bool", v.text == "1", formula)
        if kind == "e":
            return Cell("error", v.text, formula)
        if kind == "d":
            return Cell("date", dt.datetime.fromisoformat(v.text.rstrip("Z")), formula)
        number, style = float(v.text), int(c.get("s", 0))
        shape = self.styles[style] if style < len(self.styles) else "plain"
        if shape == "date":
            return Cell("date", number, formula)
        if shape == "duration":
            return Cell("duration", number, formula)
        return Cell("int" if number.is_integer() else "float", number, formula)


#: Names of error cells.
ERRORS = {"#DIV/0!": "Div0", "#N/A": "NA", "#NAME?": "Name", "#NULL!": "Null", "#NUM!": "Num", "#REF!": "Ref", "#VALUE!": "Value"}


def _plain(x: float) -> str:
    return str(int(x)) if x.is_integer() and abs(x) < 1e16 else repr(x)


def render(cell: Cell, dates: str = "iso", formulas: bool = False, epoch: dt.datetime = EPOCH) -> str:
    """A cell as text; dates: iso, excel or raw (the serial number)."""
    if formulas and cell.formula is not None:
        return "=" + cell.formula
    v = cell.value
    if cell.kind == "empty":
        return ""
    if cell.kind in ("int", "float"):
        return _plain(v)
    if cell.kind == "bool":
        return "true" if v else "false"
    if cell.kind == "error":
        return "#ERROR:" + ERRORS.get(v, str(v))
    if cell.kind == "duration":
        if dates == "raw":
            return _plain(v)
        ms = round(abs(v) * 86_400_000)
        s, ms = divmod(ms, 1000)
        return f"{'-' if v < 0 else ''}{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" + (f".{ms:03}" if ms else "")
    if cell.kind == "date":
        if dates == "raw" and not isinstance(v, dt.datetime):
            return _plain(v)
        at = v if isinstance(v, dt.datetime) else epoch + dt.timedelta(milliseconds=round(v * 86_400_000))
        if at.time() == dt.time() and (isinstance(v, dt.datetime) or v >= 1):
            return at.strftime("%Y-%m-%d")
        if not isinstance(v, dt.datetime) and 0 <= v < 1:
            return at.strftime("%H:%M:%S")
        return at.strftime("%Y-%m-%dT%H:%M:%S" if dates == "iso" else "%Y-%m-%d %H:%M:%S")
    return str(v)


def _merged(kinds: set[str]) -> str:
    """One label for the kinds of a column."""
    kinds = kinds - {"empty"}
    if not kinds:
        return "empty"
    if kinds <= {"int", "float"}:
        return "float" if "float" in kinds else "int"
    return next(iter(kinds)) if len(kinds) == 1 else "mixed"


def list_sheets(path: str) -> list[tuple[int, str, int, int, list[str]]]:
    """(position, name, rows, columns, kind of each column) of every sheet."""
    book, out = Workbook(path), []
    for n, name in enumerate(book.sheets, 1):
        kinds: list[set] = []
        count = 0
        for row in book.rows(name):
            count += 1
            kinds += [set() for _ in range(len(row) - len(kinds))]
            for k, c in zip(kinds, row):
                k.add(c.kind)
        out.append((n, name, count, len(kinds), [_merged(k) for k in kinds]))
    return out


def preview(
    path: str, sheets: list[str] | None = None, rows: int = 10, dates: str = "iso", formulas: bool = False, header: bool = True, framed: bool = False
) -> str:
    """Header and first rows of sheets, each behind a banner; framed as by pretty."""
    book, parts = Workbook(path), []
    for which in sheets or list(book.sheets):
        name = book.pick(which) if sheets else which
        number = list(book.sheets).index(name) + 1
        shown: list[list[str]] = []
        for row in book.rows(name):
            if len(shown) >= rows + (1 if header else 0):
                break
            shown.append([render(c, dates, formulas, book.epoch) for c in row])
        if framed and shown:
            body = boxed(shown[0] if header else None, shown[1:] if header else shown)
        else:
            body = "\n".join("\t".join(r) for r in shown) or "<empty sheet>"
        parts.append(f"#{number} {name}\n{body}")
    return "\n\n".join(parts)


def _columns(spec: str, names: list[str]) -> list[int]:
    """Sheet columns by name, position or letters, single or as ranges; in sheet order, each once."""

    def one(token: str, default: int) -> int:
        token = token.strip()
        if not token:
            return default
        if token in names:
            return names.index(token)
        if token.isdigit() and 1 <= int(token) <= len(names):
            return int(token) - 1
        if re.fullmatch("[A-Za-z]{1,3}", token) and from_letters(token) <= len(names):
            return from_letters(token) - 1
        raise SelectorError(f"no column {token!r}")

    found: set[int] = set()
    for token in spec.split(","):
        if token.strip() in names or ":" not in token:
            found.add(one(token, -1))
        else:
            a, b = token.split(":", 1)
            found.update(range(one(a, 0), one(b, len(names) - 1) + 1))
    return sorted(found)


def read(
    spark: SparkSession, path: str, sheet: str = "1", header: bool = True, fields: str | None = None, rows: str | None = None,
    na: str | None = None, dates: str = "iso", formulas: bool = False, escape_tabs: bool = False, escape_newlines: bool = False,
) -> Table:
    """One sheet as a table of texts; rows: data rows by place, the header not counted."""

    def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                book, held, n = Workbook(bytes(content)), [], 0
                for row in book.rows(book.pick(sheet)):
                    held.append((n, [render(c, dates, formulas, book.epoch) for c in row]))
                    n += 1
                    if len(held) >= 20_000:
                        yield pd.DataFrame(held, columns=["n", "f"])
                        held = []
                yield pd.DataFrame(held, columns=["n", "f"])

    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "n bigint, f array<string>")
    facts = df.agg(F.max(F.size("f")).alias("w"), F.min_by("f", "n").alias("h"), F.count("n").alias("n")).first()
    width = facts.w or 0
    head = [*(facts.h or []), *[""] * width][:width]
    names = head if header else [f"col{i + 1}" for i in range(width)]
    df = df.filter(F.col("n") > 0) if header else df.withColumn("n", F.col("n") + 1)
    if rows:
        test, total = F.lit(False), facts.n - (1 if header else 0)
        for a, b in row_spans(rows):
            a = 1 if a is None else a if a > 0 else total + 1 + a
            b = total if b is None else b if b > 0 else total + 1 + b
            test = test | F.col("n").between(a, b)
        df = df.filter(test)
    cells = []
    for i in _columns(fields, names) if fields else range(width):
        c = F.coalesce(F.get("f", F.lit(i)), F.lit(""))
        c = F.replace(c, F.lit("\t"), F.lit("\\t")) if escape_tabs else c
        c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n")) if escape_newlines else c
        cells.append((names[i], F.when(c == "", F.lit(na)).otherwise(c) if na is not None else c))
    out = df.select(*[c.alias(f"_c{i}") for i, (_, c) in enumerate(cells)], F.col("n").alias(ORDER))
    return Table(out, tuple(n for n, _ in cells), header)


# ---------------------------------------------------------------- writing


def header_names(spec: str) -> list[str]:
    """Names by a list, or by a range: S1..S5."""
    if ".." not in spec:
        return [x.strip() for x in spec.split(",") if x.strip()]
    ends = [re.fullmatch(r"(.*?)(\d+)", x.strip()) for x in spec.split("..")]
    if len(ends) != 2 or not all(ends) or ends[0][1] != ends[1][1] or int(ends[0][2]) > int(ends[1][2]):
        raise SelectorError(f"no range of names: {spec!r}")
    return [f"{ends[0][1]}{n}" for n in range(int(ends[0][2]), int(ends[1][2]) + 1)]


def _typed(text: str, types: str, dates: str, na: str | None) -> str | None:
    """The XML of a cell's content, by what its text looks like; None for no cell."""
    if text == "" or text == na:
        return None
    if types != "string":
        if dates == "excel":
            for pattern, style in ((r"\d{4}-\d{2}-\d{2}", 1), (r"\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?[Zz]?", 2), (r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?[Zz]?", 3)):
                if re.fullmatch(pattern, text):
                    try:
                        day, _, clock = text.rstrip("Zz").replace("T", " ").rpartition(" ") if style > 1 else (text, "", "")
                        time = dt.time.fromisoformat(clock if clock[1:2] != ":" else "0" + clock) if clock else dt.time()
                        at = dt.datetime.combine(dt.date.fromisoformat(day) if day else EPOCH.date(), time)
                    except ValueError:
                        break
                    return f' s="{style}"><v>{(at - EPOCH) / dt.timedelta(days=1):.15g}</v>'
        if text.lower() in ("true", "false"):
            return f' t="b"><v>{int(text.lower() == "true")}</v>'
        if re.fullmatch(r"[+-]?(0|[1-9]\d{0,18})", text) and -(2**63) <= int(text) < 2**63 or re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+", text):
            return f"><v>{text.lstrip('+')}</v>"
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f' t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is>'


#: Fixed value: the styles part: plain, date, date and time, time.
_STYLES = (
    '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/><xf numFmtId="21" applyNumberFormat="1"/></cellXfs></styleSheet>'
)


def _sheet_xml(out, rows: Iterable[list[str]], types: str, dates: str, na: str | None) -> None:
    out.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
    for n, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{letters(i)}{n}"{x}</c>' for i, t in enumerate(row, 1) if (x := _typed(t, types, dates, na)) is not None)
        out.write(f'<row r="{n}">{cells}</row>'.encode())
    out.write(b"</sheetData></worksheet>")


def write(
    path: str, tables: dict[str, Table], max_rows: int = MAX_ROWS, types: str = "infer", dates: str = "excel", na: str | None = None, header: bool = True
) -> list[str]:
    """One sheet per table, going on in "Name (2)", ... where it has too many rows; gives the sheets' names.

    Rows come a partition at a time, so the driver never holds a table.
    """
    if max_rows < 2:
        raise ValueError("a sheet has at least two rows")
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for title, t in tables.items():
            head = [list(t.names)] if header else []
            shown = t.df.select(*[t.cell(i).text.alias(f"c{i}") for i in range(len(t.names))], ORDER).orderBy(ORDER).drop(ORDER)
            it = (list(r) for r in shown.toLocalIterator())
            more, part = next(it, None), 1
            while part == 1 or more is not None:
                name = title if part == 1 else f"{title} ({part})"
                names.append(name)

                def some(limit=max_rows - len(head)):
                    nonlocal more
                    yield from head
                    for _ in range(limit):
                        if more is None:
                            return
                        yield more
                        more = next(it, None)

                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    _sheet_xml(out, some(), types, dates, na)
                part += 1
        ns = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        ct = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        rels = "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{doc}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships {ns}>{rels}<Relationship Id="rIdS" Type="{doc}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships {ns}><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{ct}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{ct}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{ct}.styles+xml"/>{parts}</Types>')
    return names
