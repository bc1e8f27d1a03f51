"""Spreadsheets (xlsx) as a Spark data source.

A workbook is an archive of XML.  Each sheet of each file is a partition, which a
task reads as a stream: rows are parsed one after another and leave in Arrow
batches, so only the table of shared strings is held.  The driver reads names of
sheets and the first row.  Types come from a first pass that only notes which
kinds of value each column holds.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "*").load("folder")

Numbers shown as dates become timestamps, in either of the two date systems;
errors and the usual signs of a gap become null.  Names that are missing or
repeated get a number.  With ``sheet`` as ``*`` all sheets are read, each by its
own first row; a column that a sheet lacks is null there.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.texts import FILE_MISSING
from .errors import CorruptedFile, EmptyTable, IngestionError

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
STRICT = "{http://purl.oclc.org/ooxml/spreadsheetml/main}"
RELATION = re.compile(r"\{.*\}id$")
#: Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
#: What in a format is no code: quoted and escaped text, fillers, and brackets other than elapsed time.
_SHOWN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)
BATCH = 4096
NUMBER, WHOLE, DATE, TRUTH, TEXT = "number", "whole", "date", "truth", "text"


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a file; a path without scheme is local."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def files_of(uri: str) -> list[str]:
    store, root = place(uri)
    found = store.get_file_info(root)
    if found.type == pa.fs.FileType.File:
        return [uri]
    if found.type != pa.fs.FileType.Directory:
        raise IngestionError(f"{uri} does not exist")
    head = uri.rstrip("/")
    return [f"{head}/{f.base_name}" for f in sorted(store.get_file_info(pa.fs.FileSelector(root)), key=lambda f: f.path) if f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith("~$")]


def is_date_format(code: str) -> bool:
    return bool(re.search("[ymdhs]", _SHOWN.sub("", code).split(";")[0], re.IGNORECASE)) and code.lower() != "general"


class Workbook:
    """An open archive; parts are read when asked for."""

    def __init__(self, uri: str):
        store, path = place(uri)
        self.file = store.open_input_file(path)
        try:
            self.archive = zipfile.ZipFile(self.file)
            self.book = self._tree("xl/workbook.xml")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
            self.file.close()
            raise CorruptedFile(f"{uri} is no workbook: {error}") from error

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.archive.close()
        self.file.close()

    def _tree(self, part: str) -> ElementTree.Element:
        with self.archive.open(part) as data:
            return ElementTree.parse(data).getroot()

    def sheets(self) -> dict[str, str]:
        """Parts of the archive by the sheets' names, in their order."""
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        found = {}
        for e in self.book.iter():
            if _plain(e.tag) == "sheet":
                target = targets[next(v for k, v in e.attrib.items() if RELATION.search(k))]
                if "chartsheets/" not in target and "dialogsheets/" not in target:
                    found[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        return found

    def shared_strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.archive.namelist():
            return []
        found = []
        with self.archive.open("xl/sharedStrings.xml") as data:
            for _, e in ElementTree.iterparse(data):
                if _plain(e.tag) == "si":
                    found.append(_text(e))
                    e.clear()
        return found

    def date_styles(self) -> list[bool]:
        """Of each style of a cell, whether it shows a date."""
        if "xl/styles.xml" not in self.archive.namelist():
            return []
        root = self._tree("xl/styles.xml")
        custom = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if _plain(e.tag) == "numFmt"}
        cells = next((e for e in root.iter() if _plain(e.tag) == "cellXfs"), [])
        shown = [int(x.get("numFmtId") or 0) for x in cells]
        return [is_date_format(custom[n]) if n in custom else n in DATE_FORMATS for n in shown]

    def epoch(self) -> datetime:
        later = any(_plain(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in self.book.iter())
        return datetime(1904, 1, 1) if later else datetime(1899, 12, 30)

    def rows(self, sheet: str) -> Iterator[dict[int, tuple[str, object]]]:
        """Kind and value of each row's cells by their column, from 0; empty cells are left out."""
        strings = dates = None
        epoch = self.epoch()
        with self.archive.open(self.sheets()[sheet]) as data:
            events = ElementTree.iterparse(data, ("start", "end"))
            parent = None
            for event, e in events:
                name = _plain(e.tag)
                if event == "start":
                    parent = e if name == "sheetData" else parent
                elif name == "row":
                    if strings is None:
                        strings, dates = self.shared_strings(), self.date_styles()
                    row, at = {}, -1
                    for c in e:
                        at = _column(c.get("r")) if c.get("r") else at + 1
                        value = _value(c, strings, dates, epoch)
                        if value is not None:
                            row[at] = value
                    yield row
                    parent.clear()


def _text(e: ElementTree.Element) -> str:
    """Text of an item, without what tells how it is spoken."""
    if _plain(e.tag) == "rPh":
        return ""
    return (e.text or "" if _plain(e.tag) == "t" else "") + "".join(map(_text, e))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str], dates: list[bool], epoch: datetime) -> tuple[str, object] | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        text = _text(cell)
    else:
        held = next((x.text for x in cell if _plain(x.tag) == "v"), None)
        if held is None or kind == "e":
            return None
        if kind == "b":
            return TRUTH, held.strip() in ("1", "true")
        if kind == "d":
            return DATE, datetime.fromisoformat(held.strip().removesuffix("Z"))
        if kind == "n":
            number = float(held)
            style = int(cell.get("s") or 0)
            if style < len(dates) and dates[style] and 0 <= number < 2_958_466:
                day = number + (1 if epoch.year == 1899 and number < 60 else 0)  # the first system has a 29th of February 1900
                return DATE, epoch + timedelta(microseconds=round(day * 86_400_000) * 1000)
            return (WHOLE, int(number)) if number.is_integer() and abs(number) < 2**53 else (NUMBER, number)
        text = strings[int(held)] if kind == "s" else held
    return None if text in FILE_MISSING else (TEXT, text)


def header(row: dict[int, tuple[str, object]]) -> list[str]:
    found: list[str] = []
    for i in range(max(row, default=-1) + 1):
        name = str(row[i][1]) if i in row else f"Unnamed: {i}"
        n = 1
        while (name if n == 1 else f"{name}.{n - 1}") in found:
            n += 1
        found.append(name if n == 1 else f"{name}.{n - 1}")
    return found


@dataclass
class Sheet(InputPartition):
    uri: str
    name: str


def chosen(uri: str, sheet: str) -> list[Sheet]:
    """The sheets that are meant: a name, a number from 0, or all."""
    found = []
    for file in files_of(uri):
        with Workbook(file) as book:
            names = list(book.sheets())
        if sheet != "*" and sheet not in names:
            if not sheet.isdigit() or int(sheet) >= len(names):
                raise IngestionError(f"{file} has no sheet '{sheet}', only {', '.join(names)}")
            names = [names[int(sheet)]]
        elif sheet != "*":
            names = [sheet]
        found += [Sheet(file, n) for n in names]
    return found


class WorkbookSource(DataSource):
    """Options: ``path``; ``sheet``: a name, a number from 0 (the default) or ``*``; ``kinds``: return, for each sheet and column, the kinds of its values."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheets(self) -> list[Sheet]:
        return chosen(self.options["path"], self.options.get("sheet", "0"))

    def schema(self) -> T.StructType | str:
        if self.options.get("kinds"):
            return "column string, kind string"
        names: list[str] = []
        for s in self._sheets():
            with Workbook(s.uri) as book:
                names += [n for n in header(next(book.rows(s.name), {})) if n not in names]
        if not names:
            raise EmptyTable(f"{self.options['path']} has no columns")
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(schema, self._sheets(), bool(self.options.get("kinds")))


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, sheets: list[Sheet], kinds: bool):
        self.fields, self.sheets, self.kinds = [(f.name, f.dataType.simpleString()) for f in schema.fields], sheets, kinds

    def partitions(self) -> list[Sheet]:
        return self.sheets

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        with Workbook(partition.uri) as book:
            rows = book.rows(partition.name)
            names = header(next(rows, {}))
            if self.kinds:
                held = {(i, kind) for row in rows for i, (kind, _) in row.items() if i < len(names)}
                found = sorted(held)
                yield pa.RecordBatch.from_pydict({"column": pa.array([names[i] for i, _ in found], pa.string()), "kind": pa.array([k for _, k in found], pa.string())})
                return
            places = {n: i for i, n in enumerate(names)}
            batch: list[dict] = []
            for row in rows:
                if row:
                    batch.append(row)
                if len(batch) == BATCH:
                    yield self._batch(batch, places)
                    batch = []
            if batch:
                yield self._batch(batch, places)

    def _batch(self, rows: list[dict], places: dict[str, int]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
        made = {"string": as_text, "double": lambda x: float(x)}
        columns = []
        for name, kind in self.fields:
            at, make = places.get(name), made.get(kind, lambda x: x)
            columns.append(pa.array([None if (cell := row.get(at)) is None else make(cell[1]) for row in rows], kinds.get(kind, pa.string())))
        return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in self.fields])


def as_text(value: object) -> str:
    if isinstance(value, datetime):
        return str(value) if value.time() != datetime.min.time() else str(value.date())
    return str(value)


#: Type of a column by the kinds of its values; other mixtures are text.
TYPES = {frozenset({WHOLE}): T.LongType(), frozenset({NUMBER}): T.DoubleType(), frozenset({WHOLE, NUMBER}): T.DoubleType(), frozenset({TRUTH}): T.BooleanType(), frozenset({DATE}): T.TimestampType()}


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet, or with ``*`` all sheets, of a workbook or of a folder's workbooks, with a type for each column."""
    spark.dataSource.register(WorkbookSource)
    source = spark.read.format("workbook").option("sheet", str(sheet))
    names = source.load(path).columns
    held: dict[str, set[str]] = {}
    for r in source.option("kinds", "yes").load(path).collect():  # at most five rows for each sheet and column
        held.setdefault(r["column"], set()).add(r.kind)
    schema = T.StructType([T.StructField(n, TYPES.get(frozenset(held.get(n, ())), T.StringType())) for n in names])
    # Read again rather than cast: text shows a value as the sheet holds it.
    return spark.read.format("workbook").option("sheet", str(sheet)).schema(schema).load(path)


def list_sheets(path: str) -> list[str]:
    with Workbook(path) as book:
        return list(book.sheets())
