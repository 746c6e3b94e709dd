"""Ranking vectors by cosine: exactly, and by an inverted-file index.

Both are one kernel. Queries and vectors that are to be compared share a group (one
for the exact ranking, a cell of the index otherwise). A group's queries are cut
into columns of at most COLUMN_QUERIES and its vectors into rows, and each meets
all parts of the other in one task per pair of parts: a task keeps its column's
queries as a matrix, streams its row's vectors through matrix products, and keeps
the best k of each query. So memory is bounded, a group of any size is shared out,
and the last step ranks a few rows for each query.

Scores are rounded to PLACES decimals, and of equal scores the smaller id comes
first, in the tasks as in the result. A vector that is null, of another length
than the query's, or without a direction has the score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 4
#: Queries that a task holds, and vectors that are multiplied with them together.
COLUMN_QUERIES, BLOCK_VECTORS = 4096, 1024
#: Vectors of a row of tasks, near which a group is cut.
ROW_VECTORS = 1 << 20
#: Vectors from which an index's centres are learned, rounds of learning, and the most centres.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Share of the sample's own links that a search is to find, links of each vector, and vectors of the sample that are tried.
TARGET, LINKS, TRIED = 0.95, 3, 400
SEED = 11
#: Below all scores.
NONE = -(1 << 40)


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of a column as rows of length 1 (or 0: null, of another length than ``width``, not finite)."""
    out = np.zeros((len(vectors), width))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(sizes)
    whole = np.flatnonzero((sizes == width) & np.asarray(pc.is_valid(vectors).to_numpy(zero_copy_only=False)))
    if width and len(whole):
        out[whole] = flat[(ends[whole] - width)[:, None] + np.arange(width)]
        norm = np.sqrt((out * out).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        out[~good] = 0
        out[good] /= norm[good, None]
    return out


def _scores(x: np.ndarray) -> np.ndarray:
    """Cosines as whole numbers of 10 ** -PLACES, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) * 10**PLACES + 0.5)).astype(np.int64)


class Best:
    """The best k (score, id) of each query so far; of equal scores the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries), k), NONE)
        self.ids = np.zeros((len(queries), k), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], len(ids)
        # One number for score and place, all different, so that a partial sort finds the first k.
        rank = _scores(self.queries @ vectors[order].T) * n + np.arange(n - 1, -1, -1)
        if n > self.k:
            at = np.argpartition(rank, n - self.k, axis=1)[:, n - self.k :]
            rank = np.take_along_axis(rank, at, axis=1)
        scores, place = np.divmod(rank, n)
        scores, found = np.concatenate((self.scores, scores), axis=1), np.concatenate((self.ids, ids[n - 1 - place]), axis=1)
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(found, order, axis=1)


def _best_of(k: int):
    """Rows of a task come by cell, its queries (side 0) before its vectors (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best, own = None, [], None, np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None:
                query, at = np.nonzero(best.scores > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(best.ids[query, at]), pa.array(best.scores[query, at])], ["query_id", "id", "points"])

        for batch in batches:
            cells, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    yield from told()
                    cell, held, best = cells[lo], [], None
                if sides[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held:
                    if best is None:
                        table = pa.Table.from_batches(held).combine_chunks()
                        own = table["id"].to_numpy()
                        vectors = table["vector"].combine_chunks()
                        width = int(pc.max(pc.list_value_length(vectors)).as_py() or 0)
                        best = Best(unit_rows(vectors, width), k)
                    for at in range(lo, hi, BLOCK_VECTORS):
                        part = batch.slice(at, min(BLOCK_VECTORS, hi - at))
                        best.add(part.column("id").to_numpy(zero_copy_only=False), unit_rows(part.column("vector"), best.queries.shape[1]))
        yield from told()

    return run


def _within(queries: DataFrame, vectors: DataFrame, k: int, n_queries: DataFrame, n_vectors: DataFrame) -> DataFrame:
    """query_id, id, points of the best k of each task. queries and vectors: grp, id, vector; n_queries and n_vectors: grp, n (one row a group)."""
    sides = n_queries.withColumnRenamed("n", "q").join(n_vectors.withColumnRenamed("n", "v"), "grp")
    parts = sides.select("grp", F.ceil(F.col("q") / COLUMN_QUERIES).alias("columns"), F.ceil(F.col("v") / ROW_VECTORS).alias("rows"))
    session = queries.sparkSession
    # A small table has fewer rows of tasks than there are tasks at a time; then each row is cut further.
    least = int(session.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("rows", F.greatest("rows", F.ceil(F.lit(least) / F.col("columns") / F.sum(F.lit(1)).over(Window.partitionBy()))))

    def dealt(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", F.lit(side)), F.col(own))
        each = rows.join(parts, "grp").withColumn("mine", mine).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        place = F.struct("grp", *((F.col("mine").alias("c"), F.col("met").alias("r")) if side == 0 else (F.col("met").alias("c"), F.col("mine").alias("r"))))
        return each.select(F.xxhash64(place).alias("cell"), F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), "vector")

    both = dealt(queries, "columns", "rows", 0).unionByName(dealt(vectors, "rows", "columns", 1))
    tasks = parts.agg(F.sum(F.col("columns") * F.col("rows"))).first()[0] or 1
    return both.repartition(max(least, min(tasks, 1 << 17)), "cell").sortWithinPartitions("cell", "side").mapInArrow(_best_of(k), "query_id long, id long, points long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "id"))
    score = F.col("points") / F.lit(float(10**PLACES))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", score.alias("score"), F.col("rank").cast("long").alias("rank"))


def _plain(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return frame.select(F.lit(0).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id is not null")


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: for each query vector the k most similar of all rows, found by comparing all (rows without an id are left out)."""
    q, v = _plain(queries, id_col, vector_col), _plain(vectors, id_col, vector_col)
    counts = [x.groupBy("grp").agg(F.count("*").alias("n")) for x in (q, v)]
    return _ranked(_within(q, v, k, *counts), k)


def centres(vectors: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """n directions near which the vectors (rows of length 1) lie: means of the nearest, repeated."""
    rng = np.random.default_rng(seed)
    found = vectors[rng.permutation(len(vectors))[:n]].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        norm = np.sqrt((sums * sums).sum(axis=1))
        found[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return found


def probes_for(centre: np.ndarray, sample: np.ndarray, target: float = TARGET) -> int:
    """The fewest cells in which the most similar of the sample are found for ``target`` of the sample's links."""
    tried = sample[: min(TRIED, len(sample))]
    near = tried @ sample.T
    near[np.arange(len(tried)), np.arange(len(tried))] = -2  # a vector finds itself in its first cell
    links = np.argsort(-near, axis=1)[:, :LINKS]
    place = np.argsort(np.argsort(-(tried @ centre.T), axis=1), axis=1)
    needed = np.take_along_axis(place, np.argmax(sample @ centre.T, axis=1)[links], axis=1).ravel()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1 if len(needed) else 1


class VectorIndex:
    """An inverted file: every vector in the cell of its nearest centre; a query looks into the cells of its nearest ``probes`` centres.

    The centres are learned from a sample of at most SAMPLE vectors, about the root of the number of rows of them and
    at most MOST_CELLS, so they go to all tasks; every row is indexed, and a cell of any size is cut into rows of tasks.
    How many cells a search needs for ``target`` of the links is measured on the sample: few where vectors lie in
    groups, about half where they lie everywhere. In more rows than the sample the nearest are nearer, and more are found.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, target: float = TARGET):
        self.id_col, self.vector_col = id_col, vector_col
        plain = _plain(vectors, id_col, vector_col)
        n = plain.count()
        # A sample by a hash of the ids, the same in every run; one in many rows at any size.
        taken = plain if n <= SAMPLE else plain.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n)) < SAMPLE)
        sample = taken.select("vector").limit(2 * SAMPLE).toArrow()["vector"].combine_chunks()
        self.width = int(pc.max(pc.list_value_length(sample)).as_py() or 0) if len(sample) else 0
        rows = unit_rows(sample, self.width)
        rows = rows[(rows != 0).any(axis=1)] if self.width else rows
        wanted = cells or min(MOST_CELLS, max(1, round(n**0.5)))
        self.centres = centres(rows, min(wanted, len(rows))) if len(rows) else np.zeros((1, self.width))
        self.probes = probes_for(self.centres, rows, target) if len(rows) else 1
        self.rows = self._celled(plain, 1)

    def _celled(self, plain: DataFrame, probes: int) -> DataFrame:
        centre, width = self.centres, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit_rows(batch.column("vector"), width)
                near = np.argpartition(-(x @ centre.T), min(probes, len(centre)) - 1, axis=1)[:, :probes]
                at = np.repeat(np.arange(len(x)), near.shape[1])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), part.column("id"), part.column("vector")], ["grp", "id", "vector"])

        return plain.select("id", "vector").mapInArrow(run, f"grp int, id long, vector {dict(plain.dtypes)['vector']}")

    def write(self, path: str) -> None:
        """The rows by cell, so that a search reads those of its cells alone."""
        self.rows.repartition("grp").write.mode("overwrite").partitionBy("grp").parquet(path)
        self.rows = self.rows.sparkSession.read.parquet(path)

    def search(self, queries: DataFrame, k: int = 3, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank: as cosine_top, of the rows in the cells that are looked into. Scores are exact."""
        asked = self._celled(_plain(queries, self.id_col, self.vector_col), probes or self.probes)
        counts = [x.groupBy("grp").agg(F.count("*").alias("n")) for x in (asked, self.rows)]
        return _ranked(_within(asked, self.rows, k, *counts), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_links and recall: the share of the exact (query_id, id) links that were found, ties of the last rank included by their score."""
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(least, "query_id").filter(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("good"))
    each = least.join(good, "query_id", "left").select("n", F.least(F.coalesce("good", F.lit(0)), F.col("n")).alias("good"))
    return each.agg(F.sum("n").alias("n_links"), (F.sum("good") / F.sum("n")).alias("recall"))
