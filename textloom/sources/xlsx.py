"""``spark.read.format("xlsx")`` and ``df.write.format("xlsx")``, with the standard library alone.

Reading: a path is a workbook or a folder of workbooks on any file system that Arrow reads (local, HDFS, S3, GCS); a workbook is opened in place, so that its directory and the parts that
are needed are all that is fetched. Option ``sheet`` takes a name or an index from 0 (a sheet that is named like the number wins), or ``*`` for all sheets; without it, the first sheet. Each sheet is a
partition, and its stream is read once, row by row. Sheets with different columns are put together by name; a column that one of them lacks is null there.
The first row names the columns: blank headers become ``Unnamed: i``, repeated ones get ``.1``, ``.2``. A column is boolean, timestamp_ntz, long or double if
all its cells are; a numeric column with blanks is double; anything else is string. ``keepNaStrings=true`` keeps texts such as NA.

Writing: tasks write the rows of their partitions side by side, as parts next to the target on its file system, and the driver joins the parts to one workbook at commit, in the order of the
partitions. A sheet holds a million rows, so results beyond that belong in Parquet; limits of the format raise an error. A target that may not be written gets a name
with ``_writable_`` and the time, unless ``lockedFallback=false``.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

#: The format's limits, and the texts that mean a missing value.
MOST_ROWS, MOST_COLUMNS, MOST_CHARS = 1_048_576, 16_384, 32_767
NA_STRINGS = frozenset(["", "NaN", "-1.#IND", "nan", "#N/A", "n/a", "1.#QNAN", "-nan", "None", "1.#IND", "#NA", "-1.#QNAN", "NULL", "-NaN", "N/A", "#N/A N/A", "<NA>", "NA", "null"])
#: Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH = dt.datetime(1899, 12, 30)
ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def local_path(path: str) -> str:
    path = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    if path.lower().endswith(".xls"):
        raise ValueError(f"{path}: the old .xls format can't be read; save it as .xlsx")
    return path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = local_path(path)
    return fs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]+://", path) else (fs.LocalFileSystem(), os.path.abspath(path))


@contextlib.contextmanager
def _open(path: str) -> Iterator[zipfile.ZipFile]:
    """The workbook, read in place: Arrow's files can be sought, so only what is asked for is fetched."""
    system, at = file_system(path)
    if system.get_file_info(at).type != fs.FileType.File:
        raise FileNotFoundError(f"there is no file {path}")
    with system.open_input_file(at) as f, zipfile.ZipFile(f) as book:
        yield book


def workbooks(path: str) -> list[str]:
    """The path itself, or the workbooks of a folder in the order of their names; none is an error."""
    system, at = file_system(path)
    kind = system.get_file_info(at).type
    if kind == fs.FileType.File:
        return [path]
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and i.base_name.lower().endswith(".xlsx") and not i.base_name.startswith(("~", ".", "_"))] if kind == fs.FileType.Directory else []
    if not found:
        raise FileNotFoundError(f"there is no file {path}" if kind == fs.FileType.NotFound else f"there is no workbook in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in sorted(found)]


def sheet_parts(path: str, sheet: str | None) -> list[str]:
    """The parts of a workbook that an option ``sheet`` means."""
    with _open(path) as book:
        return [part for _, part in sheet_entries(book)] if sheet == "*" else [pick_sheet(book, sheet)]


def sheet_entries(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in workbook order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = rels[s.get(f"{REL}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def pick_sheet(book: zipfile.ZipFile, sheet: str | None) -> str:
    entries = sheet_entries(book)
    if sheet is None:
        return entries[0][1]
    for name, part in entries:
        if name == sheet:
            return part
    if sheet.isdigit() and int(sheet) < len(entries):
        return entries[int(sheet)][1]
    raise ValueError(f"no sheet is called {sheet!r}: there are {[n for n, _ in entries]}")


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    with _open(path) as book:
        return spark.createDataFrame([(i, n) for i, (n, _) in enumerate(sheet_entries(book))], "ordinal int, name string")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{MAIN}numFmt")}
    shows_date = lambda code: bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "").lower()))
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if (f := int(x.get("numFmtId", 0))) in DATE_FORMATS or f in own and shows_date(own[f])}


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[list]:
    """Cells of each row, in place; rows and cells that the file leaves out are None."""
    shared, dates, expected = _shared_strings(book), _date_styles(book), 1
    with book.open(part) as f:
        table = None
        for event, row in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                table = row if row.tag == f"{MAIN}sheetData" else table
                continue
            if row.tag != f"{MAIN}row":
                continue
            at = int(row.get("r", expected))
            for _ in range(at - expected):
                yield []
            expected, cells = at + 1, []
            for c in row.iter(f"{MAIN}c"):
                k = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (k + 1 - len(cells))
                kind, v = c.get("t", "n"), c.findtext(f"{MAIN}v")
                if kind == "inlineStr":
                    cells[k] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif v is None:
                    continue
                elif kind == "s":
                    cells[k] = shared[int(v)]
                elif kind == "b":
                    cells[k] = v == "1"
                elif kind in ("str", "d"):
                    cells[k] = v
                elif kind == "n":
                    x = float(v)
                    cells[k] = EPOCH + dt.timedelta(seconds=round(x * 86400, 3)) if int(c.get("s", -1)) in dates else int(x) if x.is_integer() and abs(x) < 1e15 and "." not in v and "e" not in v.lower() else x
            table.clear()  # rows that have been read
            yield cells


def header_names(cells: list) -> list[str]:
    out: list[str] = []
    for i, c in enumerate(cells):
        name = f"Unnamed: {i}" if c is None or c == "" else str(c)
        base, k = name, 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def _body(rows: Iterator[list], keep_na: bool) -> Iterator[list]:
    """Rows below the header, with None for what is missing; blank rows at the end are left out."""
    blank = []
    for r in rows:
        r = [None if v == "" or not keep_na and isinstance(v, str) and v in NA_STRINGS else v for v in r]
        if all(v is None for v in r):
            blank.append(r)
        else:
            yield from blank
            blank = []
            yield r


LONG, DOUBLE = LongType(), DoubleType()


def part_schema(path: str, part: str, keep_na: bool = False) -> StructType:
    """The columns of a sheet, from one pass that keeps the kinds of cells it has seen, and no rows."""
    with _open(path) as book:
        rows = sheet_rows(book, part)
        header = next(rows, [])
        width, n, seen, filled = len(header), 0, {}, {}
        for r in _body(rows, keep_na):
            n += 1
            width = max(width, len(r))
            for j, v in enumerate(r):
                if v is not None:
                    seen.setdefault(j, set()).add(type(v))
                    filled[j] = filled.get(j, 0) + 1
    names = header_names(header + [None] * (width - len(header)))
    kinds = []
    for j in range(width):
        k, gap = seen.get(j, set()), filled.get(j, 0) < n
        kinds.append(BooleanType() if k == {bool} else TimestampNTZType() if k == {dt.datetime} else LONG if k == {int} and not gap else DOUBLE if k and k <= {int, float} else StringType())
    return StructType([StructField(c, k) for c, k in zip(names, kinds, strict=True)])


def merged_schema(schemas: list[StructType]) -> StructType:
    """All columns by name, in the order in which they first come; kinds that differ are text, numbers apart, and a whole number that is missing somewhere is a double as in a column with blanks."""
    kinds: dict[str, list] = {}
    for s in schemas:
        for f in s:
            kinds.setdefault(f.name, []).append(f.dataType)
    out = []
    for name, k in kinds.items():
        if all(x == k[0] for x in k):
            out.append(StructField(name, DOUBLE if k[0] == LONG and len(k) < len(schemas) else k[0]))
        else:
            out.append(StructField(name, DOUBLE if all(x in (LONG, DOUBLE) for x in k) else StringType()))
    return StructType(out)


def sheet_schema(path: str, sheet: str | None, keep_na: bool = False) -> StructType:
    """The columns of all sheets that ``path`` and ``sheet`` mean."""
    return merged_schema([part_schema(p, part, keep_na) for p in workbooks(path) for part in sheet_parts(p, sheet)])


def part_tuples(path: str, part: str, keep_na: bool, schema: StructType) -> Iterator[tuple]:
    """The rows of a sheet one by one, by the names and kinds of ``schema``; one pass."""
    as_kind = {DoubleType: float, StringType: lambda v: v if isinstance(v, str) else _text(v)}
    convert = [as_kind.get(type(f.dataType), lambda v: v) for f in schema]
    with _open(path) as book:
        rows = sheet_rows(book, part)
        header = next(rows, [])
        names = header_names(header + [None] * len(schema))  # columns without a header are named by their places
        at = [names.index(n) if n in names else -1 for n in schema.names]
        for r in _body(rows, keep_na):
            cells = [r[i] if 0 <= i < len(r) else None for i in at]
            yield tuple(None if v is None else f(v) for v, f in zip(cells, convert, strict=True))


def _text(v) -> str:
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d") if v.time() == dt.time() else v.isoformat(" ")
    return str(v)


class XlsxDataSource(DataSource):
    """Sheets of workbooks, row by row; a sheet is one compressed stream, so it has one reader."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _args(self) -> tuple[str, str | None, bool]:
        return self.options["path"], self.options.get("sheet"), self.options.get("keepnastrings", self.options.get("keepNaStrings", "false")).lower() == "true"

    def schema(self) -> StructType:
        return sheet_schema(*self._args())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._args(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(local_path(self.options["path"]), schema, overwrite, self.options.get("sheet", "Sheet1"), self.options.get("lockedfallback", self.options.get("lockedFallback", "true")).lower() == "true", self.options.get("truncate", "false").lower() == "true")


@dataclass
class _Sheet(InputPartition):
    path: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, args, schema: StructType):
        self.args, self.wanted = args, schema

    def partitions(self) -> list[InputPartition]:
        path, sheet, _ = self.args
        return [_Sheet(p, part) for p in workbooks(path) for part in sheet_parts(p, sheet)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        yield from part_tuples(partition.path, partition.part, self.args[2], self.wanted)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int
    order: int


def cell_xml(v, truncate: bool = False) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    if isinstance(v, dt.datetime):
        return f'<c s="1"><v>{(v.replace(tzinfo=None) - EPOCH).total_seconds() / 86400!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c s="1"><v>{(v - EPOCH.date()).days}</v></c>'
    s = ILLEGAL.sub("", str(v))
    if len(s) > MOST_CHARS:
        if not truncate:
            raise ValueError(f"a cell has {len(s)} characters; the format allows {MOST_CHARS} (option truncate=true cuts them)")
        s = s[:MOST_CHARS]
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(s)}</t></is></c>'


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, sheet: str, fallback: bool, truncate: bool):
        self.path, self.names, self.overwrite, self.sheet, self.fallback, self.truncate = path, schema.names, overwrite, sheet, fallback, truncate
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        if len(self.names) > MOST_COLUMNS:
            raise ValueError(f"the format allows {MOST_COLUMNS} columns")

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, parts = file_system(self.parts)
        system.create_dir(parts)
        path, n = f"{parts}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(path) as f:
            for row in iterator:
                f.write(("<row>" + "".join(cell_xml(v, self.truncate) for v in row) + "</row>").encode())
                n += 1
        return _Part(path, n, TaskContext.get().partitionId())

    def _book(self, target: str, parts: list[_Part]) -> None:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        main = MAIN.strip("{}")
        system, place = file_system(target)
        own = f"{place}.new-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
            z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(self.sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/styles.xml", head + f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write((head + f'<worksheet xmlns="{main}"><sheetData><row>' + "".join(cell_xml(n) for n in self.names) + "</row>").encode())
                for p in parts:
                    with system.open_input_stream(p.path) as g:
                        while data := g.read(1 << 20):
                            f.write(data)
                f.write(b"</sheetData></worksheet>")
        try:
            if isinstance(system, fs.LocalFileSystem) and os.path.exists(place) and not os.access(place, os.W_OK):
                raise PermissionError(target)
            system.move(own, place)
        except PermissionError:
            system.delete_file(own)
            raise

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        try:
            if (n := sum(p.rows for p in parts)) >= MOST_ROWS:
                raise ValueError(f"{n} rows; a sheet holds {MOST_ROWS - 1} below its header; write Parquet")
            system, place = file_system(self.path)
            if system.get_file_info(place).type != fs.FileType.NotFound and not self.overwrite:
                raise FileExistsError(self.path)
            try:
                self._book(self.path, parts)
            except PermissionError:
                if not self.fallback:
                    raise
                base, ext = os.path.splitext(self.path)
                self._book(f"{base}_writable_{dt.datetime.now():%Y%m%d_%H%M%S}{ext}", parts)
        finally:
            self._clean(parts)

    def abort(self, messages: list) -> None:
        self._clean([m for m in messages if m is not None])

    def _clean(self, parts) -> None:
        system, folder = file_system(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)


def _schemas_in_tasks(spark: SparkSession, books: list[str], sheet: str | None) -> StructType:
    """The columns of many workbooks, each looked through by a task of its own; what comes back are schemas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(at, k, part_schema(path, part).json()) for at, path in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, part in enumerate(sheet_parts(path, sheet))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)], ["book", "sheet", "schema"])

    rows = spark.createDataFrame(list(enumerate(books)), "book int, path string").repartition(len(books), "book").mapInArrow(run, "book int, sheet int, schema string")
    return merged_schema([StructType.fromJson(json.loads(r["schema"])) for r in rows.orderBy("book", "sheet").collect()])


def load_excel(spark: SparkSession, path: str, sheet: str | int | None = None, schema: StructType | None = None) -> DataFrame:
    """The sheets of a workbook or of a folder's workbooks as a DataFrame; a missing path or sheet is an error at once."""
    register(spark)
    books, sheet = workbooks(path), None if sheet is None else str(sheet)
    if schema is None and len(books) > 1:
        schema = _schemas_in_tasks(spark, books, sheet)
    reader = spark.read.format("xlsx")
    reader = reader.option("sheet", sheet) if sheet is not None else reader
    return (reader.schema(schema) if schema else reader).load(local_path(path))


def save_excel(df: DataFrame, path: str, sheet: str = "Sheet1", truncate: bool = False) -> None:
    register(df.sparkSession)
    df.write.format("xlsx").mode("overwrite").option("sheet", sheet).option("truncate", str(truncate).lower()).save(path)


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"no column is called {column!r}: there are {df.columns}")


def table_profile(df: DataFrame) -> DataFrame:
    """``n_rows`` and ``n_columns``, as a load reports them."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def load_report(df: DataFrame, path: str) -> DataFrame:
    """``n_rows``, ``n_columns``, ``size_kb`` of the file and ``columns``: what a load tells."""
    size = sum(system.get_file_info(at).size for system, at in map(file_system, workbooks(path)))
    return table_profile(df).select("n_rows", "n_columns", F.lit(round(size / 1024, 1)).alias("size_kb"), F.lit(", ".join(df.columns)).alias("columns"))


def column_list(df: DataFrame) -> DataFrame:
    """``ordinal``, ``name`` of the columns, in order."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "ordinal int, name string")
