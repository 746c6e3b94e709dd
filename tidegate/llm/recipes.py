"""Exact duplicates by content-defined chunk recipes (operator 12).

* Texts are cut where a rolling hash of the last WINDOW bytes has MASK_BITS zero
  bits, so equal passages give equal chunks wherever they stand. A document's recipe
  is its list of chunk hashes; it takes half a percent of the text.
* Only documents whose recipe occurs twice can be copies. Their chunks, each once
  per batch of rows, are grouped by hash and their bytes compared: a hash that two
  different chunks share is a clash, and its chunks get identifiers of their own. So a chunk's
  identifier is verified, and equal lists of identifiers are equal texts.
* Documents are told apart by a bitmap of fixed size before any text moves: what
  passes it is every document of a repeated recipe and few others. No text moves more than
  once, and of a large group of copies each chunk moves once per batch.

Defined cases: a null text is empty, and all empty texts are equal; very long texts
are cut whole; of rows with equal ids and texts one stays, and any id comes
before null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import settled, stored
from tidegate.llm._words import byte_values, chunks

#: Bytes of a chunk: at least, at most; a cut follows one byte of 2 ** MASK_BITS beyond the least.
LEAST, MOST, MASK_BITS = 512, 16384, 11
WINDOW = 32
#: Bits of the map of repeated recipes: 2 ** 23 to 2 ** 26, that is 1 to 8 MB, which go to all tasks.
LEAST_BITS, MOST_BITS = 23, 26


def cut_points(data: np.ndarray, bounds: np.ndarray) -> Iterator[list[int]]:
    """For each text (bounds[i] to bounds[i + 1]) the ends of its chunks; they depend on the text alone."""
    rolled = (byte_values(False) >> np.uint64(32)).astype(np.uint32)[data]
    step = 1
    while step < WINDOW:  # sums over 2, 4, 8, ... bytes, older ones shifted further
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
        step *= 2
    marks = np.flatnonzero(rolled >> np.uint32(32 - MASK_BITS) == 0) + 1
    at = np.searchsorted(marks, bounds)
    for k in range(len(bounds) - 1):
        begin, end = int(bounds[k]), int(bounds[k + 1])
        ends, last = [], begin
        for mark in marks[at[k] : at[k + 1]].tolist():
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark - last >= LEAST:
                last = mark
                ends.append(last)
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if last < end:
            ends.append(end)
        yield ends


def cut(texts: pa.Array) -> Iterator[list[memoryview]]:
    """For each text (null: empty) its chunks in order."""
    for chunk in chunks(texts):
        view, last = memoryview(np.ascontiguousarray(chunk.bytes)), 0
        for k, ends in enumerate(cut_points(chunk.bytes, chunk.bounds)):
            last, found = int(chunk.bounds[k]), []
            for end in ends:
                found.append(view[last:end])
                last = end
            yield found


def _hashed(chunk: memoryview, bits: int) -> bytes:
    """8 bytes, of which the last ``bits`` bits count."""
    found = hashlib.blake2b(chunk, digest_size=8).digest()
    return found if bits == 64 else (int.from_bytes(found) & ((1 << bits) - 1)).to_bytes(8)


def _recipes(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, digests = [], []
            for found in cut(batch.column("text")):
                lists.append(b"".join(_hashed(c, bits) for c in found))
                whole = hashlib.sha256()
                for c in found:
                    whole.update(c)
                digests.append(whole.digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("tag"), pa.array(lists, pa.binary()), pa.array(digests, pa.binary())], ["doc_id", "key", "tag", "recipe", "sha256"])

    return run


def _contents(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """hash and bytes of the chunks of a batch, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[bytes, bytes], None] = {}
            for found in cut(batch.column("text")):
                for c in found:
                    seen[_hashed(c, bits), bytes(c)] = None
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.binary())], ["hash", "content"])

    return run


def _ordered(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """place, hash and bytes of every chunk, after a row of place -1 for each document."""
    schema = pa.schema([("tag", pa.int64()), ("place", pa.int32()), ("hash", pa.binary()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (tag, found) in enumerate(zip(batch.column("tag").to_pylist(), cut(batch.column("text")))):
                rows += [(tag, -1, None, None), *((tag, k, _hashed(c, bits), bytes(c)) for k, c in enumerate(found))]
                at += [i, *[None] * len(found)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", *schema.names])

    return run


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row: an array of 2 ** bits / 64 longs with a bit set for each key. Its size is fixed, however many keys there are."""
    place = F.shiftrightunsigned("key", 64 - bits)
    words = keys.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(1 << bits - 6).join(words, F.col("id") == F.col("word"), "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(listed["bits"].alias("map"))


def _marked(rows: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """The rows whose key's bit is set: those of all keys, and by chance a few more."""
    place = F.shiftrightunsigned("key", 64 - bits)
    word = F.get(_bitmap(keys, bits).scalar(), F.shiftright(place, 6).cast("int"))
    return rows.filter(F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)


def _classes(recipes: DataFrame) -> DataFrame:
    """recipe, stays (doc_id and tag) and group_size of recipes that occur twice or more."""
    stays = F.max(F.struct("doc_id", "tag")).alias("stays")  # null is the smallest
    return recipes.groupBy("recipe").agg(stays, F.count("*").alias("group_size")).filter("group_size > 1")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each document. hash_bits: of a chunk's hash (fewer for tests of clashes). The tables of its steps go when the result is known."""
    return settled(docs.sparkSession, lambda: _duplicates(docs, id_col, text_col, hash_bits))


def _duplicates(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"key": F.xxhash64("text"), "tag": F.monotonically_increasing_id()})
    kind = dict(rows.dtypes)["doc_id"]
    recipes = stored(rows.mapInArrow(_recipes(hash_bits), f"doc_id {kind}, key long, tag long, recipe binary, sha256 binary"))
    repeated = stored(_classes(recipes))
    n = repeated.count()
    if n:
        bits = min(max((8 * n).bit_length(), LEAST_BITS), MOST_BITS)
        keys = recipes.join(repeated.select("recipe"), "recipe", "left_semi").select("key")
        held = _marked(docs.select(text.alias("text")).withColumn("key", F.xxhash64("text")), keys, bits).select("text")
        compared = held.mapInArrow(_contents(hash_bits), "hash binary, content binary").groupBy("hash").agg(F.min("content").alias("a"), F.max("content").alias("b"))
        clashes = stored(compared.filter("a <> b").select("hash"))
        if not clashes.isEmpty():
            recipes = stored(_resolved(rows, clashes, hash_bits))
            repeated = _classes(recipes)
    found = recipes.join(repeated.select("recipe", "stays", "group_size"), "recipe", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("tag") == F.col("stays.tag"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def _resolved(rows: DataFrame, clashes: DataFrame, bits: int) -> DataFrame:
    """doc_id, tag, recipe and sha256 with recipes in which the bytes themselves are the identifiers of chunks whose hash clashes."""
    kind = dict(rows.dtypes)["doc_id"]
    pieces = rows.select("doc_id", "tag", "text").mapInArrow(_ordered(bits), f"doc_id {kind}, tag long, place int, hash binary, content binary")
    told = pieces.join(clashes.withColumn("clash", F.lit(True)), "hash", "left")
    size = F.to_binary(F.lpad(F.hex(F.octet_length("content")), 8, "0"), F.lit("hex"))
    own = F.when(F.col("clash"), F.concat(F.lit(b"\x01"), size, F.col("content"))).otherwise(F.concat(F.lit(b"\x00"), F.col("hash")))
    listed = told.groupBy("tag").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", own.alias("own"), "content"))).alias("parts"))

    def joined(part: str) -> Column:
        return F.aggregate(F.col(f"parts.{part}"), F.lit(b""), lambda a, b: F.concat(a, F.coalesce(b, F.lit(b""))))

    return listed.select("doc_id", "tag", joined("own").alias("recipe"), F.to_binary(F.sha2(joined("content"), 256), F.lit("hex")).alias("sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The ids of the documents that stay."""
    return duplicates(docs).filter("kept").select("doc_id")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
