"""CSV, Excel and JSON files as all-string tables with a record number.

Spark reads the files; the driver sees the first bytes only (an Excel sheet, which
no Spark source reads, is unpacked by one task). Record numbers are offsets of
partitions plus places within them, found from counts: no row leaves the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.schema import SRC_ROW
from tidegate.sources.blocks import csv_records, json_records
from tidegate.sources.sniff import SNIFF_BYTES, Sniff, sniff
from tidegate.sources.workbook import Row, open_book

KINDS = {"csv": ("csv", "tsv", "txt"), "excel": ("xlsx", "xlsm", "xls"), "json": ("json", "jsonl", "ndjson")}
#: The characters of code page 1252 where it differs from ISO 8859-1, which Spark reads.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


class UnsupportedFile(ValueError):
    """A file of a kind that is not read."""


@dataclass(frozen=True)
class LandedFrame:
    frame: DataFrame
    kind: str
    detail: dict


def detect_kind(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    for kind, suffixes in KINDS.items():
        if suffix in suffixes:
            return kind
    raise UnsupportedFile(f"{path}: only {', '.join(s for v in KINDS.values() for s in v)} files are read")


def dedupe(names: list[str]) -> list[str]:
    """Stripped names; blank ones are ``column`` and repeats get _1, _2."""
    taken: set[str] = set()
    out = []
    for name in ((n or "").strip() or "column" for n in names):
        fresh, k = name, 0
        while fresh in taken:
            k += 1
            fresh = f"{name}_{k}"
        taken.add(fresh)
        out.append(fresh)
    return out


def head_bytes(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file, through Spark's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = store.open(hadoop)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, store.getFileStatus(hadoop).getLen())))
    finally:
        stream.close()


def with_src_row(rows: DataFrame, first: int, skipped: int = 0) -> DataFrame:
    """Adds the record's number in file order, first for the first one after ``skipped`` records, as the first column.

    rows come straight from a file scan with columns _block (the file block's
    start) and _mono (monotonically_increasing_id). One small aggregation counts
    the records of each partition; records before a partition are its offset.
    """
    part = F.shiftright("_mono", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.min("_block").alias("_at"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_at", "_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    index = F.col("_offset") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    names = [c for c in rows.columns if c not in ("_block", "_mono")]
    kept = numbered.filter(index >= skipped)
    return kept.select((index + (first - skipped)).alias(SRC_ROW), *[F.col("`" + n.replace("`", "``") + "`") for n in names])


def has_odd_quotes(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether a line holds quotes other than those around whole cells, as lines have that a quoted line break cuts."""
    cell = rf'(?:[ \t]*+"(?:[^"]++|"")*+"[ \t]*+|[^"{re.escape(delimiter)}]*+)'
    whole = rf"^{cell}(?:{re.escape(delimiter)}{cell})*+$"
    return not spark.read.text(path).filter(F.col("value").contains('"') & ~F.col("value").rlike(whole)).isEmpty()


def _csv_options(found: Sniff, multiline: bool) -> dict[str, str]:
    return {"sep": found.delimiter, "header": "false", "quote": '"', "escape": '"', "multiLine": str(multiline).lower(), "mode": "PERMISSIVE"}


def _csv_frame(found: Sniff, numbered: DataFrame, cells: list[str], names: list[str]) -> LandedFrame:
    def clean(c: str) -> Column:
        return F.translate(c, _C1, _CP1252).alias(c) if found.encoding == "cp1252" else F.col(c)

    frame = numbered.select(SRC_ROW, *[clean(c) for c in cells]).toDF(SRC_ROW, *names)
    return LandedFrame(frame, "csv", {"encoding": found.encoding, "delimiter": found.delimiter, "header_row": found.header_row, "preamble": list(found.preamble)})


def _single_byte(found: Sniff) -> bool:
    return found.encoding in ("cp1252", "iso-8859-1")


def _above(found: Sniff) -> int:
    """Records above the first row: the header, and what stands before it (blank lines are no records)."""
    return sum(1 for x in found.preamble if x.strip()) + 1


def read_csv(spark: SparkSession, path: str, found: Sniff | None = None, quoted_breaks: bool | None = None) -> LandedFrame:
    """All-string rows; extra cells are dropped, missing and empty ones null.

    quoted_breaks: whether quoted line breaks are looked for (which reads the file in two passes, in blocks); by default where a line has quotes that ask for it.
    """
    head = head_bytes(spark, path)
    found = found or sniff(head)
    if quoted_breaks is None:
        quoted_breaks = has_odd_quotes(spark, path, found.delimiter)
    if not quoted_breaks:
        return _read_csv(spark, path, found, False)
    if b"\r" in head and b"\n" not in head:  # lines that end in carriage returns alone are not split
        return _read_csv(spark, path, found, True)
    names = dedupe(list(found.header))
    plain = [f"c{i}" for i in range(len(names))]
    records = csv_records(spark, path, found.delimiter, _single_byte(found))
    row = F.from_csv("text", ", ".join(f"{c} string" for c in plain), _csv_options(found, True))
    above = _above(found)
    numbered = records.filter(F.col("index") >= above).select((F.col("index") + (found.header_row + 2 - above)).alias(SRC_ROW), row.alias("row")).select(SRC_ROW, "row.*")
    return _csv_frame(found, numbered, plain, names)


def read_whole_csv(spark: SparkSession, path: str, found: Sniff | None = None) -> LandedFrame:
    """As read_csv with quoted line breaks, the file being one task's work."""
    return _read_csv(spark, path, found or sniff(head_bytes(spark, path)), True)


def _read_csv(spark: SparkSession, path: str, found: Sniff, multiline: bool) -> LandedFrame:
    names = dedupe(list(found.header))
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    reader = spark.read.options(**_csv_options(found, multiline), encoding="ISO-8859-1" if _single_byte(found) else "UTF-8")
    rows = reader.schema(plain).csv(path).select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))
    return _csv_frame(found, with_src_row(rows, found.header_row + 2, _above(found)), plain.names, names)


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    if isinstance(kind, T.StructType):
        for f in kind:
            yield from _leaves(f.dataType, (*path, f.name))
    else:
        yield path, kind


def flatten(frame: DataFrame) -> DataFrame:
    """Nested structs as dotted string columns; arrays as compact JSON."""
    taken = [
        (F.to_json(at) if isinstance(kind, T.ArrayType) else at.cast("string")).alias(".".join(path))
        for path, kind in _leaves(frame.schema)
        for at in [F.col(".".join(f"`{p}`" for p in path))]
    ]
    return frame.select(*taken)


def _first_seen(records: list) -> list[str]:
    """Dotted paths of sample records in the order they appear."""
    seen: dict[str, None] = {}

    def walk(x: object, path: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else k)
        elif path:
            seen[path] = None

    for r in records:
        walk(r, "" if isinstance(r, dict) else "value")
    return list(seen)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _head_records(text: str, name: str | None, most: int = 200) -> list:
    """The first whole records in the head of a JSON file: of its array, of the list ``name`` of its object, or the object."""
    decoder, space = json.JSONDecoder(), re.compile(r"[\s,:]*")

    def value(at: int) -> tuple[object, int]:
        return decoder.raw_decode(text, space.match(text, at).end())

    at, found = space.match(text).end(), []
    try:
        if text[at] == "{" and name is None:
            return [value(at)[0]]
        if text[at] == "{":
            key, at = value(at + 1)
            while key != name:
                _, at = value(at)
                key, at = value(at)
            at = space.match(text, at).end()
        at += 1
        while len(found) < most:
            record, at = value(at)
            found.append(record)
    except (ValueError, IndexError):  # the head ends here, or the list
        pass
    return found


def _first_places(rows: DataFrame) -> DataFrame:
    """path and place of each key path's first appearance in rows (place, text); text that is no JSON is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for place, text in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist()):
                try:
                    found = _first_seen([json.loads(text)])
                except ValueError:
                    continue
                for k, path in enumerate(found):
                    seen[path] = min(seen.get(path, 1 << 62), (place << 12) + min(k, 4095))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["path", "place"])

    return rows.mapInArrow(run, "path string, place long").groupBy("path").agg(F.min("place").alias("place"))


def _schema_of(texts: DataFrame) -> T.StructType:
    """The schema of a column of JSON objects, inferred in tasks, every primitive a string."""
    spark = texts.sparkSession
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read.options(primitivesAsString=True)._jreader.json(strings), spark).schema


def _malformed(spark: SparkSession, path: str) -> int:
    """The number of the first line that is no JSON."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"), "value")
    bad = with_src_row(lines, 1).filter((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return bad.agg(F.min(SRC_ROW)).first()[0]


def read_json(spark: SparkSession, path: str) -> LandedFrame:
    """JSON lines, an array, or an object whose longest list holds the records, split among tasks; a row per record, nested keys dotted.

    Columns stand in the order in which the file's records first show their keys.
    """
    head = head_bytes(spark, path).decode("utf-8-sig", "replace")
    lines = path.lower().rsplit(".", 1)[-1] in ("jsonl", "ndjson")
    first, found, name = head.lstrip()[:1], None, None
    if not lines and first in ("[", "{"):
        found = json_records(spark, path, 1 if first == "[" else 2)
    if found is not None:
        pieces, name = found
        whole = F.when(F.col("text").startswith("{"), F.col("text")).otherwise(F.concat(F.lit('{"value":'), "text", F.lit("}")))
        texts = pieces.select("index", whole.alias("text"))
        schema = _schema_of(texts.select("text"))
        numbered = texts.select((F.col("index") + 1).alias(SRC_ROW), F.from_json("text", schema).alias("_r"))
        places = texts.select(F.col("index").alias("place"), "text")
        records = _head_records(head, name)
    else:
        raw = spark.read.options(primitivesAsString=True, multiLine=not lines, mode="PERMISSIVE").json(path)
        if raw.columns == ["_corrupt_record"] or lines and "_corrupt_record" in raw.columns:
            raise ValueError(f"{path}: line {_malformed(spark, path)} is no JSON" if lines else f"{path} is no JSON")
        tagged = raw.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))
        rows = with_src_row(tagged, 1)
        numbered = rows.select(SRC_ROW, F.struct(*[F.col(_quoted(c)) for c in rows.columns if c != SRC_ROW]).alias("_r"))
        texts = spark.read.option("wholetext", not lines).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))
        places = with_src_row(texts, 1).select(F.col(SRC_ROW).alias("place"), "text")
        records = [x for text in head.splitlines()[:200] for x in _parsed(text)] if lines else _head_records(head, None)
    inner = list(_leaves(numbered.schema["_r"].dataType))
    columns = {".".join(p): (F.to_json(at) if isinstance(k, T.ArrayType) else at) for p, k in inner for at in [F.col("_r." + ".".join(map(_quoted, p)))]}
    order = [n for n in _first_seen(records) if n in columns]
    if late := [n for n in columns if n not in order]:  # columns that the head does not show
        shown = {r.path: r.place for r in _first_places(places).filter(F.col("path").isin(late)).collect()}
        order += sorted(late, key=lambda n: (shown.get(n, 1 << 62), n))
    return LandedFrame(numbered.select(SRC_ROW, *[columns[n].alias(n) for n in order]), "json", {"lines": lines})


def _parsed(text: str) -> list:
    try:
        return [json.loads(text)]
    except ValueError:  # the line that the head cuts
        return []


# Excel


def flatten_header(rows: list[Row]) -> tuple[list[str], int]:
    """Column names and how many of the leading rows they take.

    A second header row is read only where the first has gaps, as merged group
    headings leave them; a group's name carries over its gaps.
    """
    filled = [(i, r) for i, r in enumerate(rows[:3]) if any(r)][:2]
    if not filled:
        return [], 0
    (at, top), width = filled[0], max(len(r) for _, r in filled)
    top = top + [None] * (width - len(top))
    if len(filled) == 2:
        below = filled[1][1] + [None] * (width - len(filled[1][1]))
        if any(t is None for t in top) and sum(b is not None for b in below) >= sum(t is not None for t in top):
            names, group = [], ""
            for t, b in zip(top, below):
                group = t or group
                names.append(group if not b or b.lower() == group.lower() else f"{group}_{b}" if group else b)
            return names, filled[1][0] + 1
    return [t or "" for t in top], at + 1


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> LandedFrame:
    """A sheet as strings with its row numbers; one task finds its header, of which alone the driver learns, and one unpacks it."""
    packed = spark.read.format("binaryFile").load(path).select("content")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                book = open_book(content.as_py())
                name = sheet or book.widest()
                names, taken = flatten_header([r for _, r in zip(range(3), book.rows(name))]) if name in book.sheets else ([], 0)
                yield pa.RecordBatch.from_pylist([{"sheet": name, "sheets": list(book.sheets), "names": dedupe(names), "taken": taken}], told)

    told = pa.schema([("sheet", pa.string()), ("sheets", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("taken", pa.int32())])
    name, sheets, names, taken = packed.mapInArrow(describe, "sheet string, sheets array<string>, names array<string>, taken int").first()
    if name not in sheets:
        raise KeyError(name)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held: list[tuple[int, Row]] = []
                for number, row in enumerate(open_book(content.as_py()).rows(name), 1):
                    if number > taken and any(row):
                        held.append((number, (row + [None] * len(names))[: len(names)]))
                    if len(held) == 10_000:
                        yield as_batch(held)
                        held = []
                if held:
                    yield as_batch(held)

    def as_batch(rows: list[tuple[int, Row]]) -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[1][i] for r in rows], pa.string()) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, [SRC_ROW, *[f"c{i}" for i in range(len(names))]])

    schema = f"{SRC_ROW} long" + "".join(f", c{i} string" for i in range(len(names)))
    frame = packed.mapInArrow(unpack, schema).toDF(SRC_ROW, *names)
    return LandedFrame(frame, "excel", {"sheet": name, "sheets": list(sheets), "header_rows": taken})


def land(spark: SparkSession, path: str, sheet: str | None = None) -> LandedFrame:
    kind = detect_kind(path)
    if kind == "csv":
        return read_csv(spark, path)
    return read_json(spark, path) if kind == "json" else read_excel(spark, path, sheet)
