"""Spreadsheet workbooks (Office Open XML) as a Spark data source, on the zip and XML readers of the standard library.

``spark.read.format("workbook")`` gives each pair of workbook and sheet to a task, which reads the sheet as a flow of
rows. ``df.write.format("workbook")`` lets every task write its rows as a fragment of the sheet; the commit joins the
fragments, in order of partitions, and puts the whole workbook in place by one rename. A sheet holds at most 1,048,576
rows by the format, so this is for prices and reports, not for corpora. The path is a folder that all machines share.

Defined cases: the first row with a value names the columns (empty names become ``Unnamed: i``, repeated ones ``name.1``);
rows without any value are left out; a sheet without rows has no columns, and reading it without a schema raises; cells
with an error value are null; a value that does not fit a given schema is null. Nulls and NaN are written as empty cells,
infinite numbers and whole numbers beyond 15 digits as text, a cell's text is at most 32,767 characters (longer raises).
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import math
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MOST_ROWS, MOST_COLUMNS, MOST_TEXT = 1_048_576, 16_384, 32_767
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)

_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_TO_ESCAPE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_NOT_FORMAT = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def local(path: str) -> str:
    """The path of a shared folder as the machine sees it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workbooks are read from and written to a shared folder, not {url.scheme}:")
    return unquote(url.path) if url.scheme else path


# ---- reading --------------------------------------------------------------------------------------------


class Book:
    """One open workbook: its sheets, shared strings and which styles are dates."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        self.names = set(self.zip.namelist())
        book = self._tree("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels").iter(f"{PACKAGE}Relationship")}
        found = [(s.get("name"), targets[s.get(f"{OFFICE}id")]) for s in book.iter(f"{MAIN}sheet")]
        self.sheets = {name: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for name, t in found}
        settings = book.find(f"{MAIN}workbookPr")
        self.epoch = EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else EPOCH
        self.strings = self._strings() if "xl/sharedStrings.xml" in self.names else []
        self.dates = self._date_styles() if "xl/styles.xml" in self.names else set()

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _strings(self) -> list[str]:
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{MAIN}si":
                    out.append(_text(e))
                    e.clear()
        return out

    def _date_styles(self) -> set[int]:
        tree = self._tree("xl/styles.xml")
        own = {int(n.get("numFmtId")) for n in tree.iter(f"{MAIN}numFmt") if re.search("[dmyhs]", _NOT_FORMAT.sub("", n.get("formatCode", "")), re.I)}
        cells = tree.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in own | DATE_FORMATS}

    def rows(self, sheet: str) -> Iterator[dict[int, object]]:
        """Rows that hold a value, as {place of the column: value}; nothing but the row at hand is kept."""
        with self.zip.open(self.sheets[sheet]) as f:
            flow = ElementTree.iterparse(f, ("start", "end"))
            body = None
            for event, e in flow:
                if event == "start" and e.tag == f"{MAIN}sheetData":
                    body = e
                elif event == "end" and e.tag == f"{MAIN}row":
                    place, row = -1, {}
                    for cell in e.iter(f"{MAIN}c"):
                        place = _column(cell.get("r")) if cell.get("r") else place + 1
                        value = self._value(cell)
                        if value is not None:
                            row[place] = value
                    body.clear()
                    if row:
                        yield row

    def _value(self, cell: ElementTree.Element):
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            inner = cell.find(f"{MAIN}is")
            return None if inner is None else _text(inner)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "str":
            return _unescaped(v.text)
        if kind == "b":
            return v.text == "1"
        if kind == "d":
            return dt.datetime.fromisoformat(v.text.rstrip("Z"))
        number = float(v.text)
        if int(cell.get("s", 0)) in self.dates:
            return self.epoch + dt.timedelta(milliseconds=round(number * 86_400_000))
        return number


def _text(e: ElementTree.Element) -> str:
    """The runs of a string; readings (phonetic runs) are no part of it."""
    runs = [r for r in e if r.tag in (f"{MAIN}t", f"{MAIN}r")]
    parts = [r.text if r.tag == f"{MAIN}t" else "".join(t.text or "" for t in r.iter(f"{MAIN}t")) for r in runs]
    return _unescaped("".join(p or "" for p in parts))


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _column(ref: str) -> int:
    """Place from 0 of a cell's reference: A1 is 0, AA7 is 26."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def header(row: dict[int, object]) -> dict[int, str]:
    """Place -> name of every column up to the last one that has a name; repeated names are numbered."""
    out, taken = {}, set()
    for i in range(max(row) + 1):
        base = name = f"Unnamed: {i}" if i not in row else str(_as(row[i], T.StringType()))
        n = 0
        while name in taken:
            n += 1
            name = f"{base}.{n}"
        taken.add(name)
        out[i] = name
    return out


def inferred(rows: Iterator[dict[int, object]]) -> T.StructType:
    """Dates, timestamps, numbers and booleans where all values of a column are such, else text; from all rows."""
    first = next(rows, None)
    if first is None:
        raise ValueError("the sheet is empty: give a schema")
    names, kinds = header(first), {}
    for row in rows:
        for i, v in row.items():
            if isinstance(v, dt.datetime):
                kind = "date" if v.time() == dt.time() else "timestamp"
            else:
                kind = {bool: "boolean", float: "double"}.get(type(v), "string")
            old = kinds.setdefault(i, kind)
            if old != kind:
                kinds[i] = "timestamp" if {old, kind} == {"date", "timestamp"} else "string"
    types = {"date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, types.get(kinds.get(i), T.StringType())) for i, n in names.items()])


def _as(v: object, to: T.DataType):
    """The value in a column's type, null if it does not fit."""
    if v is None:
        return None
    try:
        if isinstance(to, T.StringType):
            if isinstance(v, dt.datetime):
                return v.date().isoformat() if v.time() == dt.time() else v.isoformat(" ")
            if isinstance(v, bool):
                return str(v).lower()
            return f"{v:.0f}" if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)
        if isinstance(to, (T.DateType, T.TimestampType)):
            at = v if isinstance(v, dt.datetime) else dt.datetime.fromisoformat(v)
            # an aware value, so that a task's own time zone plays no part: cells are read in UTC
            return at.date() if isinstance(to, T.DateType) else at.replace(tzinfo=at.tzinfo or dt.timezone.utc)
        if isinstance(to, T.BooleanType):
            return v if isinstance(v, bool) else {"true": True, "false": False, 1.0: True, 0.0: False}.get(v.lower() if isinstance(v, str) else v)
        if isinstance(v, dt.datetime):
            return None
        if isinstance(to, T.DecimalType):
            return Decimal(str(v)).quantize(Decimal(1).scaleb(-to.scale))
        if isinstance(to, T.IntegralType):
            whole = int(v) if isinstance(v, str) else int(v) if float(v).is_integer() else None
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(to), 63)
            return whole if whole is not None and -(1 << bits) <= whole < 1 << bits else None
        return float(v)
    except (ValueError, TypeError, ArithmeticError):
        return None


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.sheet, self.found = schema, options.get("sheet"), files(options)

    def partitions(self) -> list[SheetPartition]:
        return [SheetPartition(f, s) for f in self.found for s in chosen(Book(f), self.sheet, f)]

    def read(self, partition: SheetPartition):
        """Columns are found by name, so workbooks may hold them in any order; those they lack are null."""
        rows = Book(partition.path).rows(partition.sheet)
        first = next(rows, None)
        if first is None:
            return
        places = {n: i for i, n in header(first).items()}
        fields = [(places.get(f.name), f.dataType) for f in self.schema.fields]
        for row in rows:
            yield tuple(_as(row.get(i), to) for i, to in fields)


def files(options: dict) -> list[str]:
    path = local(options["path"])
    found = sorted(glob.glob(os.path.join(path, "*.xlsx")) if os.path.isdir(path) else glob.glob(path) or [path])
    if not found or not all(map(os.path.isfile, found)):
        raise FileNotFoundError(f"no workbook at {path}")
    return found


def chosen(book: Book, sheet: str | None, path: str) -> list[str]:
    """The named sheet, all sheets for ``*``, the first one without a name."""
    if sheet == "*":
        return list(book.sheets)
    if sheet is None:
        return list(book.sheets)[:1]
    if sheet not in book.sheets:
        raise ValueError(f"{path} has no sheet {sheet!r}")
    return [sheet]


# ---- writing --------------------------------------------------------------------------------------------


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def cell(v: object) -> str:
    """A value as a cell; nulls and NaN as an empty one."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.datetime):
        at = v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        return f'<c s="2"><v>{(at - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c s="1"><v>{(dt.datetime.combine(v, dt.time()) - EPOCH).days}</v></c>'
    if isinstance(v, (int, Decimal)) and len(str(abs(v)).replace(".", "")) <= 15 or isinstance(v, float) and math.isfinite(v):
        return f"<c><v>{v!r}</v></c>" if not isinstance(v, Decimal) else f"<c><v>{v:f}</v></c>"
    text = v if isinstance(v, str) else str(v)
    if len(text) > MOST_TEXT:
        raise ValueError(f"a cell holds at most {MOST_TEXT} characters")
    plain = escape(_TO_ESCAPE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{plain}</t></is></c>'


class WorkbookWriter(DataSourceWriter):
    """Fragments are named by task attempt, so a lost or repeated task leaves only a file that no message names."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.target, self.sheet, self.overwrite = local(options["path"]), options.get("sheet", "Sheet1"), overwrite
        if not 1 <= len(self.sheet) <= 31 or re.search(r"[\[\]:*?/\\]", self.sheet):
            raise ValueError(f"{self.sheet!r} is no name of a sheet")
        nested = [f.name for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        if nested or len(schema.fields) > MOST_COLUMNS:
            raise ValueError(f"a sheet can't hold these columns: {nested or len(schema.fields)}")
        self.columns = [f.name for f in schema.fields]
        self.utc = [isinstance(f.dataType, T.TimestampType) for f in schema.fields]
        self.folder = f"{self.target}.{uuid.uuid4().hex}"

    def write(self, iterator) -> Fragment:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        at, n = os.path.join(self.folder, uuid.uuid4().hex), 0
        with open(at, "w", encoding="utf-8") as out:
            for row in iterator:
                # Spark hands timestamps to Python as times of the machine's own zone
                values = (v.astimezone(dt.timezone.utc) if z and v is not None else v for v, z in zip(row, self.utc))
                out.write(f"<row>{''.join(map(cell, values))}</row>\n")
                n += 1
        return Fragment(TaskContext.get().partitionId(), at, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        try:
            if sum(m.rows for m in parts) >= MOST_ROWS:
                raise ValueError(f"a sheet holds at most {MOST_ROWS} rows, its header included")
            os.makedirs(os.path.dirname(os.path.abspath(self.target)), exist_ok=True)
            whole = f"{self.target}.{uuid.uuid4().hex}.tmp"
            with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as out:
                names = self._kept(out)
                with out.open(f"xl/worksheets/sheet{len(names) + 1}.xml", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8") as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>\n<row>{"".join(map(cell, self.columns))}</row>\n')
                    for m in parts:
                        with open(m.path, encoding="utf-8", newline="") as part:
                            shutil.copyfileobj(part, sheet)
                    sheet.write("</sheetData></worksheet>")
                for name, text in frame([*names, self.sheet]).items():
                    out.writestr(name, text)
            os.replace(whole, self.target)
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _kept(self, out: zipfile.ZipFile) -> list[str]:
        """Copies the sheets of a workbook of this writer that is added to; a sheet of the same name may not be there."""
        if self.overwrite or not os.path.exists(self.target):
            return []
        book = Book(self.target)
        if self.sheet.lower() in map(str.lower, book.sheets):
            raise ValueError(f"{self.target} already has a sheet {self.sheet!r}")
        if any(n not in frame(list(book.sheets)) and n not in book.sheets.values() for n in book.names):
            raise ValueError("sheets are added only to workbooks that were written here")
        for i, name in enumerate(book.sheets.values(), 1):
            with book.zip.open(name) as old, out.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as new:
                shutil.copyfileobj(old, new)
        return list(book.sheets)

    def abort(self, messages) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def frame(sheets: list[str]) -> dict[str, str]:
    """The parts of a workbook beside its sheets; styles 1 and 2 are a date and a time."""
    top, n = '<?xml version="1.0" encoding="UTF-8"?>', range(1, len(sheets) + 1)
    kinds, office, sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml", OFFICE[1:-1], "xl/worksheets/sheet"
    overrides = {"xl/workbook.xml": f"{kinds}.sheet.main+xml", "xl/styles.xml": f"{kinds}.styles+xml", **{f"{sheet}{i}.xml": f"{kinds}.worksheet+xml" for i in n}}
    relations = [*((f"s{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in n), ("styles", "styles", "styles.xml")]

    def rels(items):
        return f'{top}<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="{i}" Type="{office}/{kind}" Target="{to}"/>' for i, kind, to in items) + "</Relationships>"

    return {
        "[Content_Types].xml": f'{top}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        + "".join(f'<Override PartName="/{p}" ContentType="{k}"/>' for p, k in overrides.items()) + "</Types>",
        "_rels/.rels": rels([("book", "officeDocument", "xl/workbook.xml")]),
        "xl/_rels/workbook.xml.rels": rels(relations),
        "xl/workbook.xml": f'{top}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="s{i}"/>' for i, s in zip(n, sheets)) + "</sheets></workbook>",
        "xl/styles.xml": f'{top}<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


# ---- the source and its callers -------------------------------------------------------------------------


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        """From the first workbook's sheet; other sheets are read by the names of its columns."""
        first = files(self.options)[0]
        book = Book(first)
        return inferred(book.rows(chosen(book, self.options.get("sheet"), first)[0]))

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """One sheet of a workbook, or of each workbook of a folder or pattern; the first one, or all with ``sheet="*"``."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    if sheet is not None:
        reader = reader.option("sheet", sheet)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with one sheet per table, in their order; one at ``path`` is replaced."""
    mode = "overwrite"
    for name, df in sheets.items():
        df.sparkSession.dataSource.register(Workbook)
        df.write.format("workbook").option("sheet", name).mode(mode).save(path)
        mode = "append"


def price_workbook(spark: SparkSession, folder: str, version: int = 1, currency: str = "usd", names: dict[tuple[int, str], str] | None = None) -> DataFrame:
    """The price table of a version (1 or 2) and currency (usd or eur): four workbooks, under ``names`` of one's own if given."""
    usual = {(v, c): f"prices_{v}_{c}.xlsx" for v in (1, 2) for c in ("usd", "eur")}
    key = version, currency.lower()
    if key not in usual:
        raise ValueError("prices come in versions 1 and 2, in usd and eur")
    return read_workbook(spark, os.path.join(folder, (usual | (names or {}))[key]))
