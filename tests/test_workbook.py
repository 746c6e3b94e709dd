"""Workbooks of both forms: binary files made here byte by byte, and large sheets written and read by Spark."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegate.sources import workbook as W
from tidegate.sources.readers import SRC_ROW, UnsupportedFile, detect_kind, land


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def wide(text):
    return struct.pack("<HB", len(text), 1) + text.encode("utf-16-le")


def narrow(text):
    return struct.pack("<HB", len(text), 0) + text.encode("latin-1")


def compound(stream, name="Workbook"):
    """A compound file of one stream of 4,096 bytes or more, in sectors of 512."""
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    fats = -(-(len(fat) + 8) // 128)
    assert fats == 1
    entry = lambda name, kind, first, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(116, b"\0") + struct.pack("<II", first, size).ljust(12, b"\0")
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Other", 2, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(stream)) + bytes(128)
    head = (W.COMPOUND + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)).ljust(76, b"\0")
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + directory + stream


def binary_book(sheets):
    """sheets: name -> list of records; shared strings are split in the middle of a text, where its width changes."""
    strings = struct.pack("<II", 9, 4) + narrow("Käufer") + wide("Größe €") + struct.pack("<HBH", 3, 8, 1) + b"abc" + bytes(4) + struct.pack("<HB", 10, 0) + b"split"
    shared = record(W.STRINGS, strings) + record(W.CONTINUE, b"\x01" + "te€xt".encode("utf-16-le"))
    bound = b"".join(record(W.BOUND_SHEET, struct.pack("<IBBBB", 0, 0, 0, len(n), 0) + n.encode("latin-1")) for n in sheets)
    begin = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    at, out, places = len(begin + bound + shared + record(W.END)), b"", []
    for records in sheets.values():
        part = begin + b"".join(records) + record(W.END)
        places.append(at + len(out))
        out += part
    bound = b"".join(record(W.BOUND_SHEET, struct.pack("<IBBBB", p, 0, 0, len(n), 0) + n.encode("latin-1")) for n, p in zip(sheets, places))
    return compound(begin + bound + shared + record(W.END) + out)


def cell(kind, row, column, data):
    return record(kind, struct.pack("<HHH", row, column, 0) + data)


DATA = [
    *[cell(W.LABEL_SHARED, 0, k, struct.pack("<I", k)) for k in range(4)],
    cell(W.NUMBER, 2, 0, struct.pack("<d", 12.0)), cell(W.NUMBER, 2, 1, struct.pack("<d", 0.1)), cell(W.RK, 2, 2, struct.pack("<I", (7 << 2) | 2)), cell(W.RK, 2, 3, struct.pack("<I", (1234 << 2) | 3)),
    record(W.MANY_RK, struct.pack("<HH", 3, 0) + struct.pack("<HI", 0, ((-5 & 0x3FFFFFFF) << 2) | 2) + struct.pack("<HI", 0, struct.unpack("<I", struct.pack("<d", 1.5)[4:])[0] & ~3) + struct.pack("<H", 1)),
    cell(W.LABEL, 3, 2, narrow(" old label ")), cell(W.BOOL, 3, 3, b"\x01\x00"),
    cell(W.FORMULA, 4, 0, struct.pack("<d", 2.5) + bytes(8)), cell(W.FORMULA, 4, 1, b"\x00" + bytes(5) + b"\xff\xff" + bytes(8)), record(W.STRING, wide("said ü")), cell(W.FORMULA, 4, 2, b"\x01\x00\x01" + bytes(3) + b"\xff\xff" + bytes(8)), cell(W.BOOL, 4, 3, b"\x07\x01"),
]
WANTED = [(3, "12", "0.1", "7", "12.34"), (4, "-5", "1.5", "old label", "true"), (5, "2.5", "said ü", "true", None)]


def test_binary_workbooks(spark, tmp_path):
    path = tmp_path / "old.xls"
    path.write_bytes(binary_book({"Info": [cell(W.LABEL, 0, 0, narrow("made"))], "Data": DATA}))
    landed = land(spark, str(path))
    assert landed.kind == "excel" and landed.detail["sheets"] == ["Info", "Data"] and landed.detail["sheet"] == "Data"
    assert landed.frame.columns == [SRC_ROW, "Käufer", "Größe €", "abc", "splitte€xt"]
    assert [tuple(r) for r in landed.frame.orderBy(SRC_ROW).collect()] == WANTED
    assert [r.cells for r in W.read_sheets(spark, str(path)).filter("sheet = 'Info'").collect()] == [["made"]]
    assert detect_kind("x.XLS") == "excel"
    with pytest.raises(UnsupportedFile):
        detect_kind("x.doc")


def test_sheets_of_many_rows(spark, tmp_path):
    """100,000 rows with shared strings, and every sheet read by a task of its own."""
    rows = spark.range(100_000).select(F.lit("Big").alias("sheet"), F.col("id").alias("at"), F.array(F.col("id").cast("string"), F.concat(F.lit("<&> "), F.col("id") % 7), F.lit(None)).alias("cells"))
    path = str(tmp_path / "big.xlsx")
    W.write_book(rows.unionByName(rows.filter("at < 3").withColumn("sheet", F.lit("A & B"))), path)
    assert [r.sheet for r in W.list_sheets(spark, path).orderBy("place").collect()] == ["A & B", "Big"]
    found = W.read_sheets(spark, path)
    big = found.filter("sheet = 'Big'")
    assert big.count() == 100_000 and big.agg(F.sum(F.col("cells")[0].cast("long"))).first()[0] == sum(range(100_000))
    assert big.filter(F.col("cells")[1] != F.concat(F.lit("<&> "), F.col("cells")[0].cast("long") % 7)).isEmpty()
    assert big.filter(F.col(SRC_ROW) != F.col("cells")[0].cast("long") + 1).isEmpty()
    assert found.filter("sheet = 'A & B'").count() == 3


def test_shared_strings_and_gaps(spark, tmp_path):
    main = W._MAIN[1:-1]
    with zipfile.ZipFile(tmp_path / "shared.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{W._REL[1:].rpartition("}")[0]}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="5"><c r="B5" t="s"><v>1</v></c><c r="D5" t="b"><v>1</v></c></row></sheetData></worksheet>')
    found = [(r[SRC_ROW], r.cells) for r in W.read_sheets(spark, str(tmp_path / "shared.xlsx")).orderBy(SRC_ROW).collect()]
    assert found == [(2, [None, "name"]), (5, [None, "rich text", None, "true"])]
