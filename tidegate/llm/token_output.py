"""Token-id output in Arrow stream files (operator 1).

Documents are range-partitioned by id and sorted. Each task encodes its texts,
packs the ids into sequences of equal length and writes two Arrow stream files
into a folder that all executors share:

* ``part-N.arrows``: batches of ``ids`` (fixed-size list of unsigned 16 or 32
  bit integers) and ``mask`` (fixed-size list of booleans, false on the padding
  that ends a part). The value buffer of a batch is one contiguous array, so a
  memory-mapped reader reaches any sequence without copying.
* ``part-N.index.arrows``: doc_id, first id's place in the part, number of ids.
* ``part-N.batches.arrows``: where each batch ends in ``part-N.arrows``, so that any
  sequence is reached by its number (see Sequences).

A file is written under a temporary name and moved to its own name at the end,
so a repeated task replaces whole files only.

Defined cases: a null text counts as empty and gives the end id alone; a very long text
is cut into pieces like any other and may fill many sequences and batches; the model's added
tokens (such as its end sign) within a text get their own id, as the library gives it; rows
with null ids come first; repeated rows are all written, in text order; an empty
table gives no file and no row; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm._common import shared_dir

END_ID = 0
SEQUENCE = 1024
BATCH_SEQUENCES = 256
#: A worker's cache of encoded text pieces: its entries, and the characters of all of them, at most. A
#: full cache becomes the older one, from which entries that are met again come back.
CACHE_ENTRIES, CACHE_CHARACTERS = 500_000, 8_000_000

# A piece is a run of white space and the run of other characters after it; a word's closing
# signs make a piece of their own. In byte-level BPE pre-tokenisation no token spans the border
# between two such pieces, so pieces can be encoded apart. White space is Unicode's White_Space,
# as the library's splitter has it.
_GAP = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
#: ASCII signs but for the apostrophe, which may begin a token with letters.
_SIGN = r"!-&(-/:-@\[-`{-~"
_PIECES = re.compile(f"[{_GAP}]*[{_LETTER}]+(?=[{_SIGN}]+(?:[{_GAP}]|\\Z))|[{_GAP}]*[^{_GAP}]+|[{_GAP}]+")


class PieceEncoder:
    """Encodes with the tokenizers library, each distinct piece of text once."""

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        # The library takes added tokens out of a text before it splits the rest into words.
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.characters = 0

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; an added token is a piece of its own, and what lies between two is cut apart."""
        if self.added is None or not self.added.search(text):
            return _PIECES.findall(text)
        parts = self.added.split(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else _PIECES.findall(part))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of the wanted type."""
        pieces = [self.cut(x) for x in texts]
        new = set(chain.from_iterable(pieces)).difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES or self.characters > CACHE_CHARACTERS:
            self.older, self.known, self.characters = self.known, {}, 0
            new = set(chain.from_iterable(pieces))
        self.characters += sum(map(len, new))
        for piece in new & self.older.keys():
            self.known[piece] = self.older[piece]
            new.discard(piece)
        fresh = list(new)
        for piece, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self.known[piece] = np.array(found.ids, self.dtype).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


@cache
def piece_encoder(path: str, dtype: str) -> PieceEncoder:
    """One encoder for all tasks of a worker."""
    return PieceEncoder(path, dtype)


def vocabulary_dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _SequenceFile:
    """Collects ids and writes them as fixed-size lists, BATCH_SEQUENCES to a batch (the last one has fewer)."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: np.dtype, length: int):
        self.store, self.path, self.length, self.dtype = store, path, length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.temporary = f"{path}.{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.held: list[bytes] = []
        self.size = self.total = 0
        #: Where each batch ends in the file.
        self.ends: list[int] = []

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.size >= self.length * BATCH_SEQUENCES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        step = self.length if last else self.length * BATCH_SEQUENCES
        whole = len(ids) // step * step
        rest = ids[whole:]
        if last and len(rest):
            ids = np.concatenate((ids, np.zeros(self.length - len(rest), self.dtype)))
            mask = np.ones(len(ids), bool)
            mask[whole + len(rest) :] = False
            whole, rest = len(ids), rest[:0]
        else:
            ids = ids[:whole]
            mask = np.ones(whole, bool)
        if whole:
            for at in range(0, whole, self.length * BATCH_SEQUENCES):
                part = slice(at, at + self.length * BATCH_SEQUENCES)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (ids, mask)]
                self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
                self.ends.append(self.out.tell())
        self.held, self.size = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        shape = pa.schema([("end", pa.int64())])
        named = self.path.removesuffix(".arrows") + ".batches.arrows"
        with self.store.open_output_stream(f"{self.temporary}.batches") as stream, pa.ipc.new_stream(stream, shape) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(self.ends, pa.int64())], schema=shape))
        self.store.move(f"{self.temporary}.batches", named)
        self.store.move(self.temporary, self.path)


def write_tokens(docs: DataFrame, out_uri: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; a row per file: part, n_docs, n_tokens (in part order, parts ascend with doc_id).

    out_uri: a folder on a file system that driver and executors reach (file, hdfs, s3, gs).
    The rows are made by the writing job itself, so run it once (for example with collect()).
    """
    dtype = vocabulary_dtype(tokenizer)
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = _open(out_uri)
        encoder, kind = piece_encoder(tokenizer, dtype), np.dtype(dtype)
        data = index = None
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                store.create_dir(folder, recursive=True)
                data = _SequenceFile(store, f"{folder}/part-{part:06d}.arrows", kind, length)
                place = f"{folder}/part-{part:06d}.index.arrows"
                aside = f"{place}.{uuid.uuid4().hex}"
                shape = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
                stream = store.open_output_stream(aside)
                index = pa.ipc.new_stream(stream, shape)
            texts = batch.column("text").fill_null("")
            for at in range(0, batch.num_rows, 256):
                first, sizes = [], []
                for ids in encoder(texts[at : at + 256].to_pylist()):
                    first.append(data.total)
                    data.add(ids + end)
                    sizes.append(data.total - first[-1])
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id")[at : at + 256], pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], schema=shape))
            n_docs += batch.num_rows
        if data is not None:
            data.close()
            index.close()
            stream.close()
            store.move(aside, place)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([data.total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, "part long, n_docs long, n_tokens long")


def open_part(uri: str, part: int) -> tuple[pa.ipc.RecordBatchStreamReader, pa.Table]:
    """Reader of a part's sequences (memory-mapped where the store is local) and its index."""
    store, folder = _open(uri)
    path = f"{folder}/part-{part:06d}.arrows"
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    with store.open_input_stream(f"{folder}/part-{part:06d}.index.arrows") as stream:
        index = pa.ipc.open_stream(stream).read_all()
    return pa.ipc.open_stream(source), index


def sequence(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, pa.Array]:
    """Ids (a view of the file's own bytes) and mask of one sequence."""
    ids = batch.column("ids")
    length = ids.type.list_size
    values = ids.values.to_numpy(zero_copy_only=True)
    at = (ids.offset + row) * length
    return values[at : at + length], batch.column("mask")[row].values


class Sequences:
    """Random access to all sequences of a folder by number, in part order.

    files: the rows of write_tokens (part, n_docs, n_tokens). A part is opened when it is
    first asked for; ids are views of its own bytes where the store is local.
    """

    def __init__(self, uri: str, files: list, length: int = SEQUENCE):
        self.uri, self.length = uri, length
        self.parts = [(part, -(-tokens // length)) for part, _, tokens in sorted(tuple(f) for f in files)]
        self.ends = np.cumsum([n for _, n in self.parts], dtype=np.int64)
        self.opened: dict[int, tuple] = {}

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def _part(self, k: int) -> tuple:
        if k not in self.opened:
            store, folder = _open(self.uri)
            path = f"{folder}/part-{self.parts[k][0]:06d}"
            source = pa.memory_map(f"{path}.arrows") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(f"{path}.arrows")
            with store.open_input_stream(f"{path}.batches.arrows") as stream:
                ends = pa.ipc.open_stream(stream).read_all().column("end").to_numpy()
            schema = pa.ipc.read_schema(source)
            self.opened[k] = source, schema, [source.tell(), *ends.tolist()]
        return self.opened[k]

    def sequence_at(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.ends, i, side="right"))
        row = i - (int(self.ends[k - 1]) if k else 0)
        source, schema, places = self._part(k)
        source.seek(places[row // BATCH_SEQUENCES])
        return sequence(pa.ipc.read_record_batch(pa.ipc.read_message(source), schema), row % BATCH_SEQUENCES)


def _documents(uri: str, part: int) -> Iterator[tuple[list, list[int], list[np.ndarray]]]:
    """The index rows of a part with their ids, a few batches of the file at a time."""
    reader, index = open_part(uri, part)
    doc_ids, firsts, sizes = (index.column(c).to_pylist() for c in ("doc_id", "first", "n_tokens"))
    held, low, at = np.zeros(0, np.uint32), 0, 0
    for batch in reader:
        ids = batch.column("ids")
        length = ids.type.list_size
        fresh = ids.values.to_numpy(zero_copy_only=True)[ids.offset * length : (ids.offset + len(ids)) * length]
        held = np.concatenate((held, fresh.astype("<u4")))
        done = at
        while done < len(sizes) and firsts[done] + sizes[done] <= low + len(held):
            done += 1
        yield doc_ids[at:done], firsts[at:done], [held[firsts[k] - low : firsts[k] - low + sizes[k]] for k in range(at, done)]
        at = done
        cut = (firsts[at] - low) if at < len(sizes) else len(held)
        held, low = held[cut:], low + cut
    if at < len(sizes):
        raise ValueError(f"part {part} of {uri} ends before its index does")


def read_documents(spark: SparkSession, uri: str, parts: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    parts: (part, ids in the parts before it), a bounded list: one entry per file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                for doc_ids, firsts, ids in _documents(uri, part):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids, pa.int64()),
                            "start": pa.array([base + x for x in firsts], pa.int64()),
                            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        }
                    )

    rows = spark.createDataFrame([(int(p), int(b)) for p, b in parts], "part long, base long")
    return rows.repartition(max(1, len(parts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, out_uri: str | None = None, end_id: int = END_ID, length: int = SEQUENCE, **columns: str) -> DataFrame:
    """Write all documents, then describe each from the files read back."""
    spark = docs.sparkSession
    uri = out_uri or f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    files = sorted(write_tokens(docs, uri, tokenizer, end_id, length, **columns).collect())
    parts, before = [], 0
    for f in files:
        parts.append((f.part, before))
        before += f.n_tokens
    return read_documents(spark, uri, parts)
