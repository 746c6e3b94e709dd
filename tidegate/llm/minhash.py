"""MinHash near-duplicates by one-permutation hashing (operator 9).

* A document's set holds hashes of its distinct shingles of five words. Equal
  sets are one node from the start, however many documents share them.
* One permutation: a hash's upper part is its bin and the least hash of a bin its
  value; an empty bin takes the value of a filled one, the first in a
  pseudorandom order of its own (optimal densification).
* Bins are joined to bands; nodes with an equal band meet in a bucket. A bucket
  proposes a star, its centre with every other member, and each proposed pair is
  confirmed on the full sets.
* Stars alone can lose links between two members of which neither is the centre.
  So buckets that still hold more than one component propose further stars, and
  at last the pairs of members of different components (see bucket_components).

Pairs at the threshold of 0.85 meet in no bucket with a probability of 3e-7, more
similar ones less often.

Defined cases: a null text, or one without words, has the empty set and is
linked with nothing; a very long text has all its shingles; shorter texts than five words have one shingle; repeated
rows with an id are one document, and links of any of its texts are its links;
rows with a null id have a null component and are kept; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import settled, stored
from tidegate.llm._graph import bucket_components, components
from tidegate.llm._words import chunks, mix, windows

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: For each bin, its own order of all bins: _RANK[i, j] is the place of bin j in it.
_RANK = np.argsort(np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) * _ODD).reshape(BINS, BINS), axis=1), axis=1).astype(np.int32)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for chunk in chunks(texts):
        starts, ends, doc = chunk.spans()
        hashed = chunk.hashes(starts, ends, fold=True)
        found, first = windows(hashed, doc, words)
        bounds = np.searchsorted(doc[first], np.arange(chunk.hi - chunk.lo + 1))
        at = np.searchsorted(doc, np.arange(chunk.hi - chunk.lo + 1))
        for k in range(chunk.hi - chunk.lo):
            own = found[bounds[k] : bounds[k + 1]]
            if not len(own) and at[k + 1] > at[k]:
                own, _ = windows(hashed[at[k] : at[k + 1]], doc[at[k] : at[k + 1]], int(at[k + 1] - at[k]))
            yield np.unique(own)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS values of a set that is not empty."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))  # sorted: a bin's least hash comes first
    filled = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[filled] = shingles[first]
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        out[empty] = out[filled[np.argmin(_RANK[np.ix_(np.flatnonzero(empty), filled)], axis=1)]]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        total = mix(total + rows[:, k])
    return total.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, one, two, bands = [], [], [], []
        for own in shingle_sets(batch.column("text")):
            sizes.append(len(own))
            one.append(int(np.sum(mix(own)).view(np.int64)) if len(own) else 0)
            two.append(int(np.sum(mix(own ^ _ODD)).view(np.int64)) if len(own) else 0)
            bands.append(band_keys(signature(own)) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_one", "set_two", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [own.tobytes() for own in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["node", "shingles"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as lists. A set that is alike lacks at most ``slack`` of the shingles, since the union is no smaller than the set;
    two that are alike share t / (1 + t) of the sum of their sizes (a little less, for the sake of rounding)."""
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("shingles")]
        slack = [len(x) * (100 - PERCENT) // 100 for x in sets]
        share = [len(x) * PERCENT / (100 + PERCENT) - 1e-6 for x in sets]
        columns = [batch.column("node"), pa.array(slack, pa.int32()), pa.array(share, pa.float64()), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "slack", "share", "tokens"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate((x, y))
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            linked.append(100 * shared >= PERCENT * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("member"), pa.array(linked, pa.bool_())], ["hub", "member", "linked"])


def alike(nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """node, component of nodes (node, n_shingles, bands) that share bands; None if no two do."""
    banded = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))

    def sets(wanted: DataFrame) -> DataFrame:
        rows = docs.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
        return rows.mapInArrow(_sets, "node long, shingles binary")

    def linked(faced: DataFrame) -> DataFrame:
        return faced.select("hub", "member", "shingles_a", "shingles_b").mapInArrow(_compared, "hub long, member long, linked boolean")

    def tokens(held: DataFrame) -> DataFrame:
        return held.mapInArrow(_listed, "node long, slack int, share double, tokens array<long>")

    return bucket_components(banded, sets, linked, tokens, PERCENT)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document; the tables of its steps go when they are known."""
    return settled(docs.sparkSession, lambda: _near_duplicates(docs, id_col, text_col))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(rows.mapInArrow(_sketch, "doc_id long, n_shingles long, set_one long, set_two long, bands array<long>"))
    filled = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_one", "set_two").agg(F.min("doc_id").alias("node"))
    tagged = stored(
        filled.join(classes, ["set_one", "set_two"]).select("doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands"))
    )
    nodes = tagged.filter("bands is not null").select("node", "n_shingles", "bands").distinct()
    grouped = alike(nodes, rows)
    placed = tagged.select("doc_id", "node")
    if grouped is not None:
        placed = placed.join(grouped, "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
    placed = stored(placed.distinct())
    # An id whose rows lie in several components joins them.
    several = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("doc_id", "a")
    across = stored(placed.join(several, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")))
    labels = placed.groupBy("doc_id").agg(F.min("node").alias("component"))
    if not across.isEmpty():
        joined = components(across).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        labels = labels.join(joined, "component", "left").select("doc_id", F.coalesce("joined", "component").alias("component"))
    by_doc = sketch.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return by_doc.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The documents of which near_duplicates keeps the id, with all their columns (one row of an id)."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    # The documents are one column here, so theirs may have any names.
    held = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc"))
    return held.join(kept, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")), "left_semi").select("doc.*")
