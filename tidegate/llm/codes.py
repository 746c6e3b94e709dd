"""Product-quantised vector codes with partial-distance search (operator 11).

Vectors become integers and are cut into PARTS equal consecutive parts, each with a
codebook of its own. A pass over the vectors assigns every part to the nearest
entry; ROUNDS passes also replace each entry by its members' mean. Between passes
only the codebooks (ENTRIES vectors in all) and the tasks' sums per entry move.

The nearest entry is found by partial distances: the positions of a part are taken
in descending variance of the codebook, and a mask drops an entry once what it has
gathered strictly exceeds the complete distance of the best one so far. So entries
at equal distances stay to the end, and the lowest index wins.

Defined cases: rows whose vector is null or holds null, NaN or infinite components
are dropped; so are vectors of another length than that of the smallest kept id (the
code is of equal parts), and all if that length is no multiple of PARTS; a null id sorts last; repeated
rows are rows of their own, and of equal ids the smaller vector comes first; with
fewer than ENTRIES rows codebooks are shorter; null labels are one label; an empty
table gives an empty result; other columns are ignored. Components so large that
their squared distances pass 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Vectors that are compared together.
BLOCK = 2048


def kept(batch: pa.RecordBatch, width: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of a batch's rows with whole finite vectors (of ``width`` components), and their integer vectors."""
    vectors = batch.column("vector")
    flat = vectors.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    whole = np.asarray(pc.is_valid(vectors).to_numpy(zero_copy_only=False)) & (wrong[ends] == wrong[ends - sizes])
    if width is not None:
        whole &= sizes == width
    at = np.flatnonzero(whole)
    return at, [np.floor(SCALE * values[ends[i] - sizes[i] : ends[i]]) for i in at]


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Integer vectors as rows of one matrix; an error where a squared distance could pass 64 bits."""
    x = np.array(rows, np.float64).reshape(len(rows), width)
    if x.size and 4.0 * width * float(np.abs(x).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for 64-bit distances")
    return x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of book and its squared distance, by partial distances."""
    n, k = len(x), len(book)
    if not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    spread = [k * int((c := book[:, j].astype(object)) @ c) - int(c.sum()) ** 2 for j in range(book.shape[1])]
    first, *rest = sorted(range(book.shape[1]), key=lambda j: (-spread[j], j))
    gathered = (x[:, first, None] - book[None, :, first]) ** 2
    # The entry that starts best is completed first; its distance is the best complete one.
    best = ((x - book[np.argmin(gathered, axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(gathered <= best[:, None])
    gathered = gathered[row, entry]
    for j in rest:
        gathered += (x[row, j] - book[entry, j]) ** 2
        left = gathered <= best[row]
        row, entry, gathered = row[left], entry[left], gathered[left]
    bounds = np.searchsorted(row, np.arange(n))
    distance = np.minimum.reduceat(gathered, bounds) if n else np.zeros(0, np.int64)
    found = np.flatnonzero(gathered == distance[row])
    firsts = found[np.searchsorted(row[found], np.arange(n))] if n else found
    return entry[firsts], distance


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: places in the batch, integer vectors by part, codes and squared distances by part."""
    parts, _, size = books.shape
    at, rows = kept(batch, parts * size)
    for lo in range(0, len(at), BLOCK):
        x = matrix(rows[lo : lo + BLOCK], parts * size).reshape(-1, parts, size)
        found = [nearest(x[:, p], books[p]) for p in range(parts)]
        yield at[lo : lo + BLOCK], x, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _summing(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a task, a row per part and used entry: the sum of the parts assigned to it, and their number."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x, codes, _ in _assigned(batch, books):
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, begin = np.unique(codes[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p], begin, axis=0).astype(object)
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        for at in range(size):
            total = pa.array([str(s) for s in sums[part, entry, at]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.full(len(part), at), pa.int32()), total, pa.array(counts[part, entry])], ["part", "entry", "place", "total", "n"])

    return run


def _starting(entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch the kept rows of the ``entries`` smallest ids (ties of the last one included), as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = kept(batch)
            ids = batch.column("vec_id").to_pylist()
            least = sorted((ids[i] is None, ids[i] or 0) for i in at)[:entries]
            taken = [(ids[i], r) for i, r in zip(at, rows) if (ids[i] is None, ids[i] or 0) <= least[-1]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in taken], batch.schema.field("vec_id").type), pa.array([r for _, r in taken], pa.list_(pa.float64()))], ["vec_id", "whole"])

    return run


def _held(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), *more)


def codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as integers by part, entry and position; of no entries where no row can be coded.

    Only ``entries`` vectors, and the sums of as many, reach the driver.
    """
    rows = _held(vectors, id_col, vector_col)
    smallest = rows.mapInArrow(_starting(entries), "vec_id long, whole array<double>").orderBy(F.asc_nulls_last("vec_id"), "whole")
    head = smallest.first()
    width = len(head.whole) if head else 0
    if head is None or width % parts:
        return np.zeros((parts, 0, max(width, parts) // parts), np.int64)
    seeds = smallest.filter(F.size("whole") == width).limit(entries).collect()
    books = matrix([r.whole for r in seeds], width).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.mapInArrow(_summing(books), "part int, entry int, place int, total string, n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", *more: str) -> DataFrame:
    """vec_id, code (a byte per part), error (squared distances of all parts) and the columns ``more`` of the rows that can be coded."""
    rows = _held(vectors, id_col, vector_col, *more)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, codes, distances in _assigned(batch, books):
                others = [batch.column(c).take(pa.array(at)) for c in ("vec_id", *more)]
                code = pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*others, code, pa.array(distances.sum(axis=1), pa.int64())], ["vec_id", *more, "code", "error"])

    named = "".join(f"`{c}` {kinds[c]}, " for c in ("vec_id", *more))
    if not books.shape[1]:
        return rows.limit(0).select("vec_id", *more, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    return rows.mapInArrow(run, f"{named}code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that each code stands for, on the scale of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
            whole = books[np.arange(len(books)), code].reshape(len(code), -1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(whole), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code in hex, error, label_error (of all rows of the label) and the digest of the codebooks."""
    books = codebooks(vectors, id_col, vector_col)
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    coded = stored(encode(plain, books, "vec_id", "vector", "label"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: The same rows for vectors of 64 components.
SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT i, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM kept, range(16) t(p)
), e0 AS (SELECT p, i - 1 AS e, a, b, c, d FROM x WHERE i <= 64), {rounds}, a2 AS ({assign2}),
coded AS (
  SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY i
), books AS (
  SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS digest FROM e2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (i), books
"""
_ASSIGN = (
    "SELECT i, p, min(m) // 64 AS dist, min(m) % 64 AS e FROM (SELECT x.i, x.p, 64 * ((x.a - k.a) * (x.a - k.a) + (x.b - k.b) * (x.b - k.b)"
    " + (x.c - k.c) * (x.c - k.c) + (x.d - k.d) * (x.d - k.d)) + k.e AS m FROM x JOIN e{n} k USING (p)) GROUP BY i, p"
)
_MEAN = "coalesce(CAST((s{c} - ((s{c} % n) + n) % n) // n AS BIGINT), o.{c}) AS {c}"
_UPDATE = (
    "SELECT o.p, o.e, " + ", ".join(_MEAN.format(c=c) for c in "abcd") + " FROM e{n} o LEFT JOIN (SELECT p, e, count(*) AS n, "
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS s{c}" for c in "abcd") + " FROM a{n} JOIN x USING (i, p) GROUP BY p, e) g USING (p, e)"
)
ORACLE = SQL.format(rounds=", ".join(f"a{n} AS ({_ASSIGN.format(n=n)}), e{n + 1} AS ({_UPDATE.format(n=n)})" for n in range(2)), assign2=_ASSIGN.format(n=2))
