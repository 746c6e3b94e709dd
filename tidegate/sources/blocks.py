"""Records of files whose borders depend on all that stands before them, read by many tasks.

A quoted line break in CSV, and every comma in JSON, ends a record or does not,
depending on whether a quote is open (and on how deep brackets are nested). Spark
splits a file into blocks at a separator that is looked for blindly: line ends
for CSV, closing braces for JSON. Then two passes follow:

1. What a block does is worked out for either state it may begin in: the state it
   ends in, and how many records end in it. Blocks' results, a row each, are
   composed in order on the driver, so each block's own first state and the number
   of records before it are known.
2. Each block gives its records with their numbers. The first and last one of a block may be
   parts of a record; parts of equal number are joined.

No task reads more than a block, and records are numbered as a side effect.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "index long, block long, text string, whole boolean"


def segments(spark: SparkSession, path: str, separator: str, single_byte: bool = False) -> DataFrame:
    """block (its first byte) and value (without the separator) in the order of the file."""
    rows = spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1")) if single_byte else rows


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """Values in batches; a task may hold several blocks, one after another."""
    for batch in batches:
        blocks, values = batch.column("block").to_pylist(), batch.column("value").to_pylist()
        lo = 0
        for k in range(1, len(blocks) + 1):
            if k == len(blocks) or blocks[k] != blocks[lo]:
                yield blocks[lo], values[lo:k]
                lo = k


def _joined(rows: DataFrame, between: str) -> DataFrame:
    """index, text of whole records and of those whose parts lie in several blocks."""
    parts = rows.filter(~F.col("whole")).groupBy("index").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return rows.filter("whole").select("index", "text").unionByName(parts.select("index", F.array_join(F.col("parts.text"), between).alias("text")))


# CSV


def quote_left_open(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open after a line that begins inside or outside one. Quotes count at the start of a cell only; doubled ones are text."""
    at, size = 0, len(line)
    if '"' not in line:
        return inside
    while True:
        if not inside:
            if line[at : at + 1] == '"':
                at += 1
                inside = True
            else:
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
                if at >= size:
                    return False
                continue
        while True:  # to the quote that closes the cell
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            break
        inside = False
        at = line.find(delimiter, at + 1)
        if at < 0:
            return False
        at += len(delimiter)


def _csv_states(delimiter: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block, for a beginning outside and inside quotes: whether it ends inside, and how many records end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list] = {}
        for block, lines in _by_block(batches):
            state = told.setdefault(block, [False, 0, True, 0])
            for line in lines:
                for k, begun in ((0, False), (2, True)):
                    before = state[k]
                    state[k] = quote_left_open(line, before, delimiter)
                    state[k + 1] += not state[k] and (before or bool(line.strip()))
        yield pa.RecordBatch.from_pylist([{"block": b, "out": s[0], "n_out": s[1], "inside": s[2], "n_inside": s[3]} for b, s in told.items()], pa.schema([("block", pa.int64()), ("out", pa.bool_()), ("n_out", pa.int64()), ("inside", pa.bool_()), ("n_inside", pa.int64())]))

    return run


def csv_records(spark: SparkSession, path: str, delimiter: str, single_byte: bool = False) -> DataFrame:
    """index (from 0) and text of a CSV file's records, blank lines left out; quoted line breaks stay in their record."""
    rows = segments(spark, path, "\n", single_byte)
    told = rows.mapInArrow(_csv_states(delimiter), "block long, out boolean, n_out long, inside boolean, n_inside long").collect()  # a row a block
    begins: dict[int, tuple[bool, int]] = {}
    open_, index = False, 0
    for r in sorted(told, key=lambda r: r.block):
        begins[r.block] = open_, index
        open_, index = (r.inside, index + r.n_inside) if open_ else (r.out, index + r.n_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, at, held, head = None, False, 0, [], False

        def left() -> list[tuple]:
            return [(at, block, "\n".join(held), False)] if held else []

        for now, lines in _by_block(batches):
            found = []
            if now != block:
                found += left()
                block, (inside, at), held = now, begins[now], []
                head = inside
            for line in lines:
                if inside or held or line.strip():
                    held.append(line)
                inside = quote_left_open(line, inside, delimiter)
                if held and not inside:
                    found.append((at, block, "\n".join(held).removesuffix("\r"), not head))
                    at, held, head = at + 1, [], False
            yield _records(found)
        yield _records(left())

    # A quote that nothing closes leaves its record open at the end of the file.
    return _joined(rows.mapInArrow(run, RECORD), "\n")


def _records(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["index", "block", "text", "whole"])


# JSON: an array, or an object whose longest list holds the records

_SIGN = re.compile(r'["{}\[\],]|\\.', re.S)


@dataclass
class Walk:
    """The state between two segments: whether a string is open, and how many brackets are."""

    inside: bool = False
    depth: int = 0

    def signs(self, text: str) -> Iterator[tuple[str, int]]:
        """Brackets and commas of a segment that are not in strings, each after the depth is set: (sign, place)."""
        for m in _SIGN.finditer(text):
            sign = m[0]
            if sign == '"':
                self.inside = not self.inside
            elif not self.inside and sign[0] != "\\":
                self.depth += (sign in "[{") - (sign == "]")
                yield sign, m.start()

    def closed(self) -> bool:
        """Takes the brace that ended the segment; whether it counts."""
        self.depth -= not self.inside
        return not self.inside


def _json_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: whether strings change from open to closed over it, and the change of depth for a beginning outside and inside a string."""
    told: dict[int, list] = {}
    for block, values in _by_block(batches):
        state = told.setdefault(block, [False, 0, 0])
        for value in values:
            for m in _SIGN.finditer(value):
                sign = m[0]
                if sign == '"':
                    state[0] = not state[0]
                elif sign in "[{":
                    state[1 + state[0]] += 1
                elif sign == "]":
                    state[1 + state[0]] -= 1
            state[1 + state[0]] -= 1  # the brace that ended the segment
    yield pa.RecordBatch.from_pylist([{"block": b, "turns": s[0], "out": s[1], "inside": s[2]} for b, s in told.items()], pa.schema([("block", pa.int64()), ("turns", pa.bool_()), ("out", pa.int64()), ("inside", pa.int64())]))


_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
#: What a block says of the lists at a level: commas before anything else happens, and then lists that open (with their keys), commas, and lists that close.
LEAD, OPEN, COMMAS, CLOSE = range(4)


def _json_events(begins: dict[int, Walk], level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block, place, kind, text and n: what happens in each block to lists at a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block, walk, kind, commas, carried = None, Walk(), LEAD, 0, ""

        def tell(what: int, text: str | None = None, n: int = 0) -> None:
            out.append((block, len(out), what, text, n))

        for now, values in _by_block(batches):
            if now != block:
                if commas:
                    tell(kind, None, commas)
                block, walk, kind, commas = now, Walk(begins[now].inside, begins[now].depth), LEAD, 0
                carried = None if walk.inside else ""  # a key that begins in another block is not known here
            for value in values:
                for sign, at in walk.signs(value):
                    if sign == "," and walk.depth == level and kind is not None:
                        commas += 1
                    elif sign in "[{" and walk.depth == level:
                        if commas:
                            tell(kind, None, commas)
                        commas, kind = 0, COMMAS if sign == "[" else None
                        if sign == "[":
                            key = _KEY.search((carried or "") + value[:at]) if level > 1 else None
                            known = level == 1 or key is not None and (carried is not None or key.start() > 0)
                            tell(OPEN, json.loads(f'"{key[1]}"') if key and known else None, (value[at + 1 :].lstrip()[:1] != "]") + 2 * (not known))
                    elif sign == "]" and walk.depth == level - 1 and kind is not None:
                        if commas:
                            tell(kind, None, commas)
                        tell(CLOSE)
                        commas, kind = 0, None
                if walk.closed() and walk.depth == level - 1:
                    if commas:
                        tell(kind, None, commas)
                    commas, kind = 0, None
                carried = (carried or "") + value + "}" if walk.inside and carried is not None else None if walk.inside else ""
        if commas:
            tell(kind, None, commas)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()))], ["block", "place", "kind", "text", "n"])

    return run


@dataclass
class JsonList:
    """A list that may hold the records: its name, the block it opens in and the how many-th of that block it is, and the commas in each block."""

    name: str | None
    block: int
    nth: int
    filled: bool
    known: bool
    commas: dict[int, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(self.commas.values()) + self.filled


def _lists(events: list, blocks: list[int]) -> tuple[list[JsonList], dict[int, JsonList | None]]:
    """The lists of a file, and for each block the list that is open where it begins."""
    found: list[JsonList] = []
    open_at: dict[int, JsonList | None] = {}
    now, of_block = None, {b: [] for b in blocks}
    for e in events:
        of_block[e.block].append(e)
    for b in blocks:
        open_at[b], nth = now, 0
        for e in sorted(of_block[b], key=lambda e: e.place):
            if e.kind == OPEN:
                now = JsonList(e.text, b, nth, bool(e.n & 1), not e.n & 2)
                found.append(now)
                nth += 1
            elif e.kind == CLOSE:
                now = None
            elif now is not None:
                now.commas[b] = now.commas.get(b, 0) + e.n
    return found, open_at


def _json_elements(begins: dict[int, tuple[Walk, bool, int]], level: int, start: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The elements of one list. begins: of each block its first state, whether the list is open there, and the number of elements that have ended before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, walk, active, at, whole, held, nth = None, Walk(), False, 0, True, [], 0

        def left() -> list[tuple]:
            return [(at, block, text, False)] if active and (text := "".join(held)) else []

        for now, values in _by_block(batches):
            found: list[tuple] = []
            if now != block:
                found += left()
                own, active, at = begins[now]
                block, walk, whole, held, nth = now, Walk(own.inside, own.depth), not active, [], 0
            for value in values:
                lo = 0
                for sign, k in walk.signs(value):
                    if active and (sign == "," and walk.depth == level or sign == "]" and walk.depth == level - 1):
                        held.append(value[lo:k])
                        found.append((at, block, "".join(held), whole))
                        at, held, lo, whole = at + 1, [], k + 1, True
                        active = sign == ","
                    elif sign == "[" and walk.depth == level:
                        if (block, nth) == start:
                            active, lo, held = True, k + 1, []
                        nth += 1
                walk.closed()
                if active:
                    held.append(value[lo:] + "}")
            yield _records(found)
        yield _records(left())

    return run


def json_records(spark: SparkSession, path: str, level: int) -> tuple[DataFrame, str | None] | None:
    """index (from 0) and text of the elements of a JSON file's array (level 1), or of the longest list of its object (level 2; the first in the file of equals), and its name.

    None where the file has no such list, or one whose key cannot be told from one block.
    """
    rows = segments(spark, path, "}")
    told = sorted(rows.mapInArrow(_json_states, "block long, turns boolean, out long, inside long").collect(), key=lambda r: r.block)  # a row a block
    begins, inside, depth = {}, False, 0
    for r in told:
        begins[r.block] = Walk(inside, depth)
        depth += r.inside if inside else r.out
        inside ^= r.turns
    blocks = [r.block for r in told]
    # A row for each list at the level, and a few for each block.
    events = rows.mapInArrow(_json_events(begins, level), "block long, place long, kind int, text string, n long").collect()
    found, open_at = _lists(events, blocks)
    if level == 1:
        found = found[:1]
    if not found or not all(x.known for x in found):
        return None
    chosen = max(found, key=lambda x: x.size)
    starts, ended = {}, 0
    for b in blocks:
        starts[b] = begins[b], open_at[b] is chosen, ended
        ended += chosen.commas.get(b, 0)
    pieces = _joined(rows.mapInArrow(_json_elements(starts, level, (chosen.block, chosen.nth)), RECORD), "")
    return pieces.select("index", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text")).filter("text <> ''"), chosen.name
