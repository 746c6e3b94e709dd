"""Cells of Excel workbooks, both the zipped XML form and the older binary form, as text.

Sheets are read row by row. Shared strings lie in one Arrow column and are looked up
by number, so a sheet of a million rows takes no more memory than its file unpacked.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from tidegate.schema import SRC_ROW

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet from which its size is judged, and rows of a batch.
JUDGED, BATCH = 25, 10_000

Row = list[str | None]


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


class Book:
    """Sheets by name, and their rows from the first, absent ones empty."""

    sheets: dict[str, object]

    def rows(self, sheet: str) -> Iterator[Row]:
        raise NotImplementedError

    def widest(self) -> str:
        """The sheet with the most cells in its first rows; the first of equals."""

        def area(sheet: str) -> int:
            filled = [r for _, r in zip(range(JUDGED), self.rows(sheet)) if any(r)]
            return max(map(len, filled), default=0) * len(filled)

        return max(self.sheets, key=area)


class XmlBook(Book):
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.shared = pa.array(self._shared_strings(), pa.large_string())
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        self.sheets = {s.get("name"): "xl/" + links[s.get(_REL)].removeprefix("/xl/") for s in sheets}

    def _elements(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        """The elements of a part one by one; those that are done with are let go."""
        with self.zip.open(part) as f:
            opened: list[ElementTree.Element] = []
            for event, element in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    opened.append(element)
                    continue
                opened.pop()
                if element.tag == f"{_MAIN}{tag}":
                    yield element
                    if opened:
                        opened[-1].clear()

    def _shared_strings(self) -> Iterator[str]:
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for item in self._elements("xl/sharedStrings.xml", "si"):
                yield "".join(t.text or "" for t in item.iter(f"{_MAIN}t"))

    def _text(self, cell: ElementTree.Element) -> str | None:
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
        value = cell.findtext(f"{_MAIN}v")
        if value is None:
            return None
        if cell.get("t") == "s":
            return self.shared[int(value)].as_py()
        return {"1": "true", "0": "false"}.get(value, value) if cell.get("t") == "b" else value

    def rows(self, sheet: str) -> Iterator[Row]:
        at = 0
        for row in self._elements(self.sheets[sheet], "row"):
            number = int(row.get("r") or at + 1)
            while at + 1 < number:
                at += 1
                yield []
            at = number
            cells: Row = []
            for cell in row.iter(f"{_MAIN}c"):
                place = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (place + 1 - len(cells))
                cells[place] = (self._text(cell) or "").strip() or None
            yield cells


# The binary form: records of a stream in a compound file. Magic numbers, places and record numbers of the format.
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END_OF_CHAIN = 0xFFFFFFFE
BOUND_SHEET, STRINGS, CONTINUE, LABEL_SHARED, NUMBER, RK, MANY_RK, LABEL, BOOL, FORMULA, STRING, END = 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x205, 0x06, 0x207, 0x0A


def compound_stream(content: bytes, *wanted: str) -> bytes:
    """The first stream of one of these names in a compound file."""
    shift, small_shift = struct.unpack_from("<HH", content, 30)
    directory, _, cutoff, small_first, _, more_first, _ = struct.unpack_from("<IIIIIII", content, 48)
    sector = 1 << shift

    def part(k: int) -> bytes:
        return content[(k + 1) * sector : (k + 2) * sector]

    def chain(first: int, table: list[int]) -> Iterator[int]:
        while first < 0xFFFFFFFA and first < len(table):
            yield first
            first = table[first]

    ids, more = list(struct.unpack_from("<109I", content, 76)), more_first
    while more < 0xFFFFFFFA:
        *listed, more = struct.unpack(f"<{sector // 4}I", part(more))
        ids += listed
    table = [x for k in ids if k < 0xFFFFFFFA for x in struct.unpack(f"<{sector // 4}I", part(k))]
    entries = b"".join(map(part, chain(directory, table)))
    small_stream, small_table = b"", [x for k in chain(small_first, table) for x in struct.unpack(f"<{sector // 4}I", part(k))]
    for at in range(0, len(entries), 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        name, (first, size) = entries[at : at + max(length - 2, 0)].decode("utf-16-le"), struct.unpack_from("<II", entries, at + 116)
        if kind == 5:  # the root holds the small streams
            small_stream = b"".join(map(part, chain(first, table)))
        elif name in wanted:
            if size >= cutoff:
                return b"".join(map(part, chain(first, table)))[:size]
            step = 1 << small_shift
            return b"".join(small_stream[k * step : (k + 1) * step] for k in chain(first, small_table))[:size]
    raise ValueError(f"no stream {' or '.join(wanted)}")


class _Parts:
    """The bytes of a record and of those that continue it. Letters that go on in the next part have their width told anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at == len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = ""
        while n:
            if self.at == len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 1
                flags = self.parts[self.k][0]
            width = 1 + (flags & 1)
            here = min(n, (len(self.parts[self.k]) - self.at) // width)
            out += self.take(here * width).decode("utf-16-le" if flags & 1 else "latin-1", "replace")
            n -= here
        self.take(4 * runs + more)
        return out


def _plain(number: float) -> str:
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def _rk(packed: int) -> float:
    number = float((packed >> 2) - (1 << 30) * (packed >> 31)) if packed & 2 else struct.unpack("<d", struct.pack("<II", 0, packed & ~3))[0]
    return number / 100 if packed & 1 else number


class BinaryBook(Book):
    def __init__(self, content: bytes):
        self.stream = compound_stream(content, "Workbook", "Book")
        self.sheets, parts = {}, []
        for kind, data in self._records(0):
            if kind == BOUND_SHEET:
                first, n, wide = struct.unpack_from("<I", data)[0], data[6], data[7] & 1
                self.sheets[data[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")] = first
            elif kind == STRINGS:
                parts = [data]
            elif kind == CONTINUE and parts and last in (STRINGS, CONTINUE):
                parts.append(data)
            last = kind
        strings = _Parts(parts)
        count = struct.unpack("<II", strings.take(8))[1] if parts else 0
        self.shared = pa.array((strings.string() for _ in range(count)), pa.large_string())

    def _records(self, at: int) -> Iterator[tuple[int, bytes]]:
        while at + 4 <= len(self.stream):
            kind, size = struct.unpack_from("<HH", self.stream, at)
            yield kind, self.stream[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == END:
                return

    def _cells(self, sheet: str) -> Iterator[tuple[int, int, str | None]]:
        waiting = None  # the cell whose formula gives the text that comes next
        for kind, data in self._records(self.sheets[sheet]):
            row, column = struct.unpack_from("<HH", data) if len(data) >= 4 else (0, 0)
            if kind == LABEL_SHARED:
                yield row, column, self.shared[struct.unpack_from("<I", data, 6)[0]].as_py()
            elif kind == NUMBER:
                yield row, column, _plain(struct.unpack_from("<d", data, 6)[0])
            elif kind == RK:
                yield row, column, _plain(_rk(struct.unpack_from("<I", data, 6)[0]))
            elif kind == MANY_RK:
                for k in range((len(data) - 6) // 6):
                    yield row, column + k, _plain(_rk(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
            elif kind == LABEL:
                yield row, column, _Parts([data[6:]]).string()
            elif kind == BOOL:
                yield row, column, None if data[7] else ("true" if data[6] else "false")
            elif kind == FORMULA:
                if data[12:14] != b"\xff\xff":
                    yield row, column, _plain(struct.unpack_from("<d", data, 6)[0])
                elif data[6] == 1:
                    yield row, column, "true" if data[8] else "false"
                elif data[6] == 0:
                    waiting = row, column
            elif kind == STRING and waiting:
                yield *waiting, _Parts([data]).string()
                waiting = None

    def rows(self, sheet: str) -> Iterator[Row]:
        at, cells = 0, []
        for row, column, text in self._cells(sheet):  # cells come by row
            while at < row:
                yield cells
                at, cells = at + 1, []
            cells += [None] * (column + 1 - len(cells))
            cells[column] = (text or "").strip() or None
        yield cells


def open_book(content: bytes) -> Book:
    return BinaryBook(content) if content[:8] == COMPOUND else XmlBook(content)


# With Spark


def _packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _by_sheet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, sheet and content: the workbook once for each of its sheets."""
    for batch in batches:
        for content in batch.column("content"):
            for place, sheet in enumerate(open_book(content.as_py()).sheets):
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([sheet], pa.string()), pa.array([content.as_py()], pa.binary())], ["place", "sheet", "content"])


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """place and sheet of a workbook's sheets in order."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = list(open_book(content.as_py()).sheets)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["place", "sheet"])

    return _packed(spark, path).mapInArrow(listed, "place int, sheet string")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """sheet, the row's number (from 1) and cells (array) of the filled rows of all sheets; a task reads one sheet."""
    n = list_sheets(spark, path).count()
    each = _packed(spark, path).mapInArrow(_by_sheet, "place int, sheet string, content binary").repartition(max(n, 1), "place")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet, content in zip(batch.column("sheet").to_pylist(), batch.column("content")):
                held: list[tuple[int, Row]] = []
                for number, row in enumerate(open_book(content.as_py()).rows(sheet), 1):
                    if any(row):
                        held.append((number, row))
                    if len(held) == BATCH:
                        yield told(sheet, held)
                        held = []
                if held:
                    yield told(sheet, held)

    def told(sheet: str, rows: list[tuple[int, Row]]) -> pa.RecordBatch:
        columns = [pa.array([sheet] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["sheet", SRC_ROW, "cells"])

    return each.select("sheet", "content").mapInArrow(unpacked, f"sheet string, {SRC_ROW} long, cells array<string>")


def write_book(rows: DataFrame, path: str) -> None:
    """Rows (sheet, at, cells) as one workbook at a path that executors reach, sheets in the order of their names, rows by ``at``.

    One task writes it, since it is one zip file; rows pass through it in batches. A sheet
    holds 1,048,576 rows at most, as the format has it.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.sax.saxutils import escape

        main, links = _MAIN[1:-1], _REL[1:].rpartition("}")[0]
        store, place = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        names: list[str] = []
        with store.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            part = None
            for batch in batches:
                for sheet, cells in zip(batch.column("sheet").to_pylist(), batch.column("cells").to_pylist()):
                    if not names or names[-1] != sheet:
                        if part:
                            part.write(b"</sheetData></worksheet>")
                            part.close()
                        part = book.open(f"xl/worksheets/s{len(names)}.xml", "w", force_zip64=True)
                        part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                        names.append(sheet)
                    told = "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in cells)
                    part.write(f"<row>{told}</row>".encode())
            if part:
                part.write(b"</sheetData></worksheet>")
                part.close()
            listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(names))
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>{listed}</sheets></workbook>')
            related = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(names)))
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>')
        yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    rows.select("sheet", "at", "cells").repartition(1).sortWithinPartitions("sheet", "at").mapInArrow(packed, "n long").collect()
