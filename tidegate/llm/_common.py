"""Helpers shared by the operators: table access, checkpoint folder, ordered buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class for Java regular expressions.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Whether a job's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of the run that goes on in this thread, where temporary_steps holds one.
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    A temporary folder is set only where the session names none (tests on one machine).
    """
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside the block delete their shuffle files when they end, as nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    For steps that are repeated: a table's size is known when the next step is
    planned, it takes less disk than a checkpoint, and it carries no constraints
    of earlier plans.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    if (held := _steps.get()) is not None:
        held.append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The result of ``build`` as one step table; those that it made on the way are deleted."""
    before = _steps.get()
    with temporary_steps(spark):
        made = build()
        token = _steps.set(before)  # the result belongs to the run outside
        try:
            return None if made is None else stored(made)
        finally:
            _steps.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_steps(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that stored() wrote inside the block when it ends; results are to be written within it.

    Each run has a list of its own, so that runs in several threads leave each other's tables alone.
    """
    token = _steps.set([])
    try:
        yield
    finally:
        for path in _steps.get() or ():
            remove(spark, path)
        _steps.reset(token)


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending cut points of an integer key, near its quantiles."""
    if buckets < 2:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, cuts, 20 * buckets)).first()[0]
    return sorted(set(found or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of cut points at or below ``key`` (null: -1), by binary search in a literal array."""
    if not bounds:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step //= 2
    cuts = F.lit(np.array(bounds, np.int64))  # one literal, however many there are
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(cuts, at + s - 1) <= key), at + s).otherwise(at),
    )
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)
