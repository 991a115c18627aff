"""Workbooks (.xlsx) as a Spark data source (format ``loomgrid_workbook``), and their writer, on the standard library alone.

A sheet is a partition; its rows stream from the XML. Options: path (a file,
folder or glob that pyarrow.fs can list), sheet (one name; all without it). Rows
are positional: (file, sheet, row, cells array<string>), empty cells null;
``sheet_table`` takes the first row as header. Numbers come as their text, whole
ones without a point, booleans as 1 and 0; characters that XML can't hold are
written in the format's own way (``_x0001_``) and come back. With the option
``fills`` cells are the colours of their fills (RRGGBB) instead.

The writer's tasks turn rows into XML, one file for each partition in the shared
folder; the driver strings these files together.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.stored import shared_folder

SCHEMA = "file string, sheet string, row long, cells array<string>"
# Fixed values of the format: its namespaces, and the most rows of a sheet.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    part: str


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{{{_OFFICE}}}id")]
        found.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


#: What can't stand in XML as it is, and what looks like the escape of such a character.
_ESCAPED = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")


def _text(node) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in node.iter(f"{_MAIN}t")))


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _fill_colours(book: zipfile.ZipFile) -> list[str | None]:
    """The solid fill (RRGGBB) of each cell format."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    fills = []
    for f in root.iter(f"{_MAIN}fill"):
        solid, colour = f.find(f"{_MAIN}patternFill"), f.find(f"{_MAIN}patternFill/{_MAIN}fgColor")
        rgb = colour.get("rgb") if colour is not None and solid.get("patternType") == "solid" else None
        fills.append(rgb[-6:] if rgb else None)
    formats = root.find(f"{_MAIN}cellXfs")
    return [fills[int(x.get("fillId", 0))] for x in (formats if formats is not None else ())]


def sheet_rows(book: zipfile.ZipFile, part: str, fills: bool = False) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of a sheet's rows that have cells; with ``fills`` the colours instead of the texts."""
    colours = _fill_colours(book) if fills else []
    shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    last = 0
    with book.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag != f"{_MAIN}row":
                continue
            last = int(node.get("r") or last + 1)
            cells: list[str | None] = []
            for c in node.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                if fills:
                    style = int(c.get("s", 0))
                    cells[at] = colours[style] if style < len(colours) else None
                elif kind == "inlineStr":
                    cells[at] = _text(c)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else _number(value.text) if kind == "n" else value.text
            if cells:
                yield last, cells
            node.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")
        self.fills = str(options.get("fills", "")).lower() == "true"

    def _open(self, path: str) -> zipfile.ZipFile:
        fs, _ = store(self.path)
        return zipfile.ZipFile(fs.open_input_file(path))  # reads its directory, then the parts that are asked for

    def partitions(self) -> list[InputPartition]:
        fs, path = store(self.path)
        base, pattern = path.rsplit("/", 1) if re.search(r"[*?\[]", path) else (path, "*.xlsx")
        info = fs.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
        found = []
        for f in sorted(files, key=lambda f: f.path):
            with self._open(f.path) as book:
                found += [Sheet(f.path, name, part) for name, part in sheet_parts(book) if self.sheet in (None, name)]
        return found or [Sheet("", "", "")]

    def read(self, partition: Sheet):
        if partition.path:
            with self._open(partition.path) as book:
                for row, cells in sheet_rows(book, partition.part, self.fills):
                    yield partition.path.rsplit("/", 1)[-1], partition.name, row, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgrid_workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(dict(self.options))


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, exclude: tuple[str, ...] = (), fills: bool = False) -> DataFrame:
    """Positional rows of all sheets, or of one, without the excluded ones; with ``fills`` their colours."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("loomgrid_workbook").option("fills", str(fills).lower())
    df = (reader.option("sheet", sheet) if sheet is not None else reader).load(path)
    return df.where(~F.col("sheet").isin(*exclude)) if exclude else df


def positional(cells: DataFrame, n: int) -> DataFrame:
    """Columns c0 to c{n-1} of positional rows."""
    return cells.select("file", "sheet", "row", *(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(n)))


def sheet_table(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet as a table of text: its first row names the columns, rows without any text are left out."""
    cells = read_cells(spark, path, sheet)
    header = cells.orderBy("row").first()
    if header is None:
        raise ValueError(f"{path} has no rows in a sheet {sheet}")
    named = [(i, name) for i, name in enumerate(header["cells"]) if name]
    body = cells.where(F.col("row") > header["row"]).where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return body.select(*(F.get("cells", F.lit(i)).alias(name) for i, name in named))


@dataclass
class Styles:
    """Fills of a sheet as RRGGBB: ``header`` by column (such cells are bold), ``fills`` as (column, condition on the row, colour); the first condition that holds wins."""

    header: dict[str, str] = field(default_factory=dict)
    fills: list[tuple[str, Column, str]] = field(default_factory=list)


def _cell(value, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if isinstance(value, bool):
        return f'<c{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f"<c{s}><v>{value!r}</v></c>"
    text = _ESCAPED.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _style_sheet(formats: list[tuple[str, bool]]) -> str:
    """styles.xml with a cell format for each (colour, bold), from number 1 on."""
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{rgb}"/></patternFill></fill>' for rgb, _ in formats)
    cells = "".join(f'<xf numFmtId="0" fontId="{int(bold)}" fillId="{i}" borderId="0" xfId="0" applyFill="1" applyFont="1"/>' for i, (_, bold) in enumerate(formats, 2))
    return (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts>'
        f'<fills count="{len(formats) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{len(formats) + 1}"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{cells}</cellXfs></styleSheet>'
    )


def _write_parts(df: DataFrame, styles: Styles, formats: list[tuple[str, bool]], folder: str) -> list[tuple[str, int]]:
    """(file, rows) of the rows of ``df`` as XML, in its order; a file for each partition."""
    plain = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}
    number = {(c, k): F.lit(formats.index((rgb, False)) + 1) for k, (c, _, rgb) in enumerate(styles.fills)}
    chosen = []
    for c in df.columns:
        style = F.lit(0)
        for k, (column, on, _) in reversed(list(enumerate(styles.fills))):
            if column == c:
                style = F.when(on, number[c, k]).otherwise(style)
        chosen.append(style)
    values = [F.col(f"`{c}`") if kind in plain else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes]
    named = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values)), *(x.cast("int").alias(f"s{i}") for i, x in enumerate(chosen)))
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = store(folder)
        name, rows, packed = f"{uuid.uuid4().hex}.z", 0, zlib.compressobj(1)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    out.write(packed.compress(f"<row>{''.join(map(_cell, row[:n], row[n:]))}</row>".encode()))
                rows += batch.num_rows
            out.write(packed.flush())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([rows])], names=["part", "name", "n"])

    return [(r.name, r.n) for r in sorted(named.mapInArrow(run, "part int, name string, n long").collect())]  # a row for each partition


def write_workbook(tables: dict[str, DataFrame], path: str, styles: dict[str, Styles] | None = None) -> None:
    """Tables as the sheets of one workbook, with their fills; rows keep the order of the table, and a sheet holds no more than the format allows."""
    styles = {name: (styles or {}).get(name) or Styles() for name in tables}
    formats = sorted({(rgb, True) for s in styles.values() for rgb in s.header.values()} | {(rgb, False) for s in styles.values() for _, _, rgb in s.fills})
    spark = next(iter(tables.values())).sparkSession
    folder = f"{shared_folder(spark)}/loomgrid/sheets-{uuid.uuid4().hex}"
    parts = {name: _write_parts(df, styles[name], formats, folder) for name, df in tables.items()}
    for name, files in parts.items():
        if sum(n for _, n in files) >= MOST_ROWS:
            raise ValueError(f"sheet {name}: more than {MOST_ROWS} rows; write a folder of Parquet or CSV instead")
    fs, where = store(path)
    shared, base = store(folder)
    ids = range(1, len(tables) + 1)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    sheet_kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    with fs.open_output_stream(where) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_kind}worksheet+xml"/>' for i in ids)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{sheet_kind}styles+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{len(ids) + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(ids, tables, strict=True))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/styles.xml", _style_sheet(formats))
        for i, (name, df) in zip(ids, tables.items(), strict=True):
            top = styles[name].header
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                sheet.write(f"<row>{''.join(_cell(c, formats.index((top[c], True)) + 1 if c in top else 0) for c in df.columns)}</row>".encode())
                for file, _ in parts[name]:
                    unpacked = zlib.decompressobj()
                    with shared.open_input_stream(f"{base}/{file}") as raw:
                        while chunk := raw.read(1 << 20):
                            sheet.write(unpacked.decompress(chunk))
                sheet.write(b"</sheetData></worksheet>")
    if any(parts.values()):
        shared.delete_dir(base)
