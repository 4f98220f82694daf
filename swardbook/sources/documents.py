"""Office files as sources and sinks: workbooks, Word tables and the text of old Word files.

Files come as Spark's binaryFile source gives them, (path, content), from any
store that Spark reads, and each is opened in the task that holds it: nothing is
listed, read or unpacked on the driver. Readers give plain rows of text with
their place in the file. Writers give (path, content) for rows of a file.

A file that is no such document gives no rows; missing cells are null; a merged
cell's text stands in every column and row that it covers.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import office

# XML names of the formats.
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
#: Rows handed on at a time.
ROWS = 2000


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a folder whose names fit the pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _rows_of(found: DataFrame, read: Callable[[bytes], Iterator[tuple]], fields: str) -> DataFrame:
    """path and the fields of what read gives for each file."""
    names = ["path", *(f.split()[0] for f in fields.split(", "))]
    types = [pa.string(), *(pa.list_(pa.string()) if "array" in f else pa.int32() if f.endswith(" int") else pa.string() for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    for row in read(content.as_py() or b""):
                        rows.append((path.as_py(), *row))
                        if len(rows) == ROWS:
                            yield full()
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, struct.error):
                    continue
        if rows:
            yield full()

    return found.select("path", "content").mapInArrow(run, f"path string, {fields}")


def _column(ref: str) -> int:
    at = 0
    for c in ref:
        if c.isdigit():
            break
        at = at * 26 + ord(c) - 64
    return at - 1


def _workbook(content: bytes) -> Iterator[tuple]:
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_X}si"):
            shared.append("".join(t.text or "" for t in [*item.findall(f"{_X}t"), *item.findall(f"{_X}r/{_X}t")]))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_X}sheet"):
        part = targets[sheet.get(_REL)]
        part = part.lstrip("/") if part.startswith("/") else f"xl/{part}"
        with book.open(part) as stream:
            number = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_X}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for cell in row.iter(f"{_X}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = cell.find(f"{_X}v"), cell.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_X}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                yield sheet.get("name"), number, cells
                row.clear()


def workbook_rows(found: DataFrame) -> DataFrame:
    """(path, sheet, row_no, cells) of workbooks; row_no counts from 1 as in the sheet."""
    return _rows_of(found, _workbook, "sheet string, row_no int, cells array<string>")


def _word_tables(content: bytes) -> Iterator[tuple]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    for number, table in enumerate(body.findall(f"{_W}tbl")):
        above: list[str | None] = []
        for row_no, row in enumerate(table.findall(f"{_W}tr")):
            cells: list[str | None] = []
            for cell in row.findall(f"{_W}tc"):
                texts = ["".join(x.text or "" if x.tag == f"{_W}t" else "\n" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else "" for x in p.iter()) for p in cell.findall(f"{_W}p")]
                span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue" and len(cells) < len(above)
                text = above[len(cells)] if goes_on else "\n".join(texts)
                cells += [text] * int(span.get(f"{_W}val") if span is not None else 1)
            yield number, row_no, cells
            above = cells


def word_table_rows(found: DataFrame) -> DataFrame:
    """(path, table, row_no, cells) of the tables of Word files, in order; paragraphs of a cell are lines."""
    return _rows_of(found, _word_tables, "table int, row_no int, cells array<string>")


def _streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name."""
    if content[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        return {}
    size, small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    root, _, cutoff, mini_at = struct.unpack_from("<IIII", content, 48)
    more_at, more_n = struct.unpack_from("<II", content, 68)
    sector = lambda k: content[(k + 1) * size : (k + 2) * size]
    numbers = lambda data: struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])
    tables = list(numbers(content[76:512]))
    for _ in range(more_n):
        *some, more_at = numbers(sector(more_at))
        tables += some
    table = [n for k in tables if k < 0xFFFFFFFA for n in numbers(sector(k))]

    def chain(first: int, links: list[int], piece: Callable[[int], bytes]) -> bytes:
        out, seen = [], set()
        while first < len(links) and first not in seen:
            seen.add(first)
            out.append(piece(first))
            first = links[first]
        return b"".join(out)

    folder = chain(root, table, sector)
    entries = []
    for at in range(0, len(folder) - 127, 128):
        length, kind = struct.unpack_from("<HB", folder, at + 64)
        first, n = struct.unpack_from("<IQ", folder, at + 116)
        entries.append((folder[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, first, n))
    packed = next((chain(f, table, sector) for _, kind, f, _ in entries if kind == 5), b"")
    mini = list(numbers(chain(mini_at, table, sector)))
    inside = lambda k: packed[k * small : (k + 1) * small]
    return {name: (chain(f, mini, inside) if n < cutoff else chain(f, table, sector))[:n] for name, kind, f, n in entries if kind == 2}


def _old_text(content: bytes) -> Iterator[tuple]:
    found = _streams(content)
    data = b"".join(found.get(name, b"") for name in ("WordDocument", "1Table", "0Table"))
    lines = (re.sub(r"\s+", " ", m[0].decode("utf-16-le")).strip() for m in re.finditer(rb"(?:[\x20-\x7e]\x00){3,}", data))
    yield from enumerate(line for line in lines if len(line) > 2)


def old_word_lines(found: DataFrame) -> DataFrame:
    """(path, line_no, line): runs of plain letters in the text of Word files of the old format."""
    return _rows_of(found, _old_text, "line_no int, line string")


# Office lists out of files.


def roster(found: DataFrame, sheet: str | None = None) -> DataFrame:
    """office.roster_rows of workbooks with name, address, two old prices, price and notes in columns A to F under a header."""
    rows = workbook_rows(found).filter((F.col("row_no") > 1) & (F.lit(sheet is None) | (F.col("sheet") == F.lit(sheet))))
    cell = lambda k: F.get("cells", F.lit(k))
    return office.roster_rows(rows.select(F.struct("path", "sheet", "row_no").alias("seq"), cell(0).alias("name"), cell(1).alias("address"), cell(4).alias("price"), cell(5).alias("notes")))


def row_order(found: DataFrame) -> DataFrame:
    """office.row_order of the first column of a Word file's first table, under its header; one file is one list."""
    rows = word_table_rows(found).filter("table = 0 AND row_no > 0")
    return office.row_order(rows.select((F.col("row_no") - 1).cast("long").alias("seq"), F.trim(F.get("cells", F.lit(0))).alias("name")).filter("name <> ''"))


def labels(found: DataFrame) -> DataFrame:
    """office.labels of the cells of Word files' first tables."""
    cells = word_table_rows(found).filter("table = 0").select("path", "row_no", F.posexplode("cells").alias("at", "label"))
    return office.labels(cells.select(F.struct("path", "row_no", "at").alias("seq"), "label"))


def phones(found: DataFrame) -> DataFrame:
    """office.phones of the text of old Word files."""
    return office.phones(old_word_lines(found).select(F.col("path").alias("doc"), F.col("line_no").cast("long").alias("line_no"), "line"))


# Writers.


def _text(value: str) -> str:
    return escape(_CONTROL.sub("", value))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
        for name, text in parts.items():
            # a set time, so that a file written twice is the same bytes
            pack.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _package(kind: str, main: str, body: str, more: dict[str, tuple[str, str]]) -> bytes:
    """A package with one main part and parts that it refers to by id: path below its folder, content type and text."""
    folder = main.rpartition("/")[0]
    over = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in [(main, kind), *((f"{folder}/{n}", t) for n, (t, _) in more.items())])
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{over}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
        main: body,
    }
    if more:
        links = "".join(f'<Relationship Id="r{k + 1}" Type="{_OFFICE}/worksheet" Target="{n}"/>' for k, n in enumerate(more))
        parts[f"{folder}/_rels/{main.rpartition('/')[2]}.rels"] = f'<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>'
        parts |= {f"{folder}/{n}": text for n, (_, text) in more.items()}
    return _zip(parts)


def workbook(rows: list[list[str | None]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; every cell is text."""
    line = lambda cells: "<row>" + "".join('<c t="inlineStr"><is><t xml:space="preserve">' + _text(v) + "</t></is></c>" if v is not None else "<c/>" for v in cells) + "</row>"
    main = f'<workbook xmlns="{_X[1:-1]}" xmlns:r="{_OFFICE}"><sheets><sheet name="{_text(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>'
    body = f'<worksheet xmlns="{_X[1:-1]}"><sheetData>{"".join(map(line, rows))}</sheetData></worksheet>'
    return _package("spreadsheetml.sheet.main", "xl/workbook.xml", main, {"worksheets/sheet1.xml": ("spreadsheetml.worksheet", body)})


def word_table(rows: list[list[str | None]]) -> bytes:
    """A Word file of one table; lines of a cell are paragraphs."""
    paragraph = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{_text(t)}</w:t></w:r></w:p>'
    cell = lambda v: "<w:tc>" + "".join(map(paragraph, (v or "").split("\n"))) + "</w:tc>"
    table = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows)
    return _package("wordprocessingml.document.main", "word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body><w:tbl>{table}</w:tbl></w:body></w:document>', {})


def _writer(make: Callable[[list], bytes]):
    @F.pandas_udf(BinaryType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda file: make([list(r["cells"]) for r in file]))

    return run


def packed(rows: DataFrame, make: Callable[[list], bytes], path: Column, order: Column, head: list[str] | None = None) -> DataFrame:
    """(path, content): a file for each path, of rows with cells in their order; what one file holds is gathered for it."""
    listed = rows.groupBy(path.alias("path")).agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "cells"))).alias("rows"))
    only = F.transform("rows", lambda r: F.struct(r["cells"].alias("cells")))
    first = F.array(F.struct(F.array(*map(F.lit, head)).alias("cells"))) if head else F.array().cast("array<struct<cells:array<string>>>")
    return listed.select("path", _writer(make)(F.concat(first, only)).alias("content"))
