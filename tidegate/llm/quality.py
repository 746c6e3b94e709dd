"""Quality classifier: logistic regression on hashed word n-grams (operator 3).

Words are runs of letters and digits or runs of other signs; a document's
features are the distinct hashed unigrams and bigrams of its whole text, each
with weight 1 / sqrt(their number). Weights are learned with
follow-the-regularised-leader (FTRL-proximal) updates over a bounded, documented
sample of labelled rows, in one task, and scores are sparse dot products.

Defined cases: a null or empty text has the bias alone and gets the score of
the bias; rows without a label are scored only; several labels of one id are all
used; an empty or one-sided training set gives scores from what there is (0.5
without any); repeated rows are each scored and have equal scores; a very long text
has BUCKETS features at most; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm._common import stored
from tidegate.llm._words import Chunk, chunks, mix

#: Weights, a power of two; the last place is the bias.
BUCKETS = 1 << 18
#: At most so many labelled rows are learned from: those with the smallest hash of their id; and no more
#: of them than have so many features together (4 bytes each, all in one task; one text has BUCKETS at most).
MAX_TRAINING_ROWS = 12_000
MAX_TRAINING_FEATURES = 24_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.05

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def features(chunk: Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all texts of a chunk, joined, and the bounds of each text's own."""
    starts, ends, doc = chunk.class_spans()
    words = chunk.hashes(starts, ends)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix(words[inside] * _PAIR + words[inside + 1])
    hashed = np.concatenate((words, pairs)) % np.uint64(buckets - 1)
    owner = np.concatenate((doc, doc[inside]))
    keys = np.unique(owner * buckets + hashed.astype(np.int64))
    bounds = np.searchsorted(keys, np.arange(chunk.hi - chunk.lo + 1) * buckets)
    return keys % buckets, bounds


def ftrl(rows: list[tuple[np.ndarray, int]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from (feature places, label) rows, in their order."""
    z, n, weights = np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
    bias = buckets - 1
    for _ in range(epochs):
        for places, label in rows:
            at = np.append(places, bias)
            x = np.full(len(at), 1 / np.sqrt(max(len(places), 1)))
            x[-1] = 0.1
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at], n[at] = zs + g - sigma * w, ns + g * g
    big = np.abs(z) > L1
    weights[big] = (np.sign(z[big]) * L1 - z[big]) / ((BETA + np.sqrt(n[big])) / ALPHA + L2)
    return weights


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_TRAINING_FEATURES) -> np.ndarray:
    """Learns from labelled documents for which ``learn`` (over doc_id) holds.

    The sample is chosen on ids alone (top max_rows by a hash, a bounded sort
    without texts); its features, at most max_features and those of one text more,
    meet in one task. The weights come back to the driver: BUCKETS numbers,
    whatever the input.
    """
    wanted = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(learn)
        .select("doc_id", F.col("quality").cast("int").alias("label"))
        .select("*", F.xxhash64("doc_id", F.lit(11)).alias("place"))
        .orderBy("place", "doc_id", "label")
        .limit(max_rows)
    )
    sample = wanted.join(docs.select("doc_id", "text"), "doc_id")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found, bounds = features(chunk)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
                cut = [batch.column(c)[chunk.lo : chunk.hi] for c in ("place", "doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*cut, lists], ["place", "doc_id", "label", "features"])

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "doc_id", "label"], kind="stable")
        weights = ftrl(list(zip(frame["features"], frame["label"])))
        at = np.flatnonzero(weights)
        return pd.DataFrame({"place": at, "weight": weights[at]})

    hashed = sample.select("place", "doc_id", "label", "text").mapInArrow(places, "place long, doc_id long, label int, features array<int>")
    hashed = stored(hashed)
    # Rows in order until their features are enough; the window is over numbers of at most max_rows rows (and their repeats).
    line = Window.orderBy("place", "doc_id", "label").rowsBetween(Window.unboundedPreceding, -1)
    counted = hashed.select("place", "doc_id", "label", F.size("features").cast("long").alias("n")).groupBy("place", "doc_id", "label").agg(F.sum("n").alias("n"))
    chosen = counted.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).filter(F.col("before") < max_features)
    hashed = hashed.join(chosen.select("place", "doc_id", "label"), ["place", "doc_id", "label"], "left_semi")
    rows = hashed.groupBy(F.lit(0).alias("model")).applyInPandas(lambda frame: learned(frame), "place long, weight double").toPandas()
    weights = np.zeros(BUCKETS)
    weights[rows["place"].to_numpy(np.int64)] = rows["weight"]
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                places, bounds = features(chunk, len(w))
                sizes = np.diff(bounds)
                dots = np.zeros(len(sizes))
                if filled := np.flatnonzero(sizes).tolist():  # each text is summed by itself, so equal texts have equal scores
                    dots[filled] = np.add.reduceat(w[places], bounds[filled]) / np.sqrt(sizes[filled])
                p = 1 / (1 + np.exp(-np.clip(dots + 0.1 * w[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[chunk.lo : chunk.hi], pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scored, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the rows that are not held out."""
    weights = train(docs, labels, ~held_out(F.col("doc_id")), max_rows)
    scored = score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
