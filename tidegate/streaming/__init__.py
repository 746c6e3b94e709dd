"""Transforms and checks over streams.

Checks of single rows are the batch run's projection. Uniqueness is kept state: each
key that must be unique has the number of its lines in the state store, so a key that
repeats in a later batch is told of, however far back it began. Keys are counted by
Spark's own streaming aggregation; the lines of repeated ones are ranked where the
report is made, from the rows that the stream has written. A stream's valid and
rejected rows are those of the batch run over all it has read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators.validate import Report, repeated_keys, row_checked, unique_keys, with_uniqueness
from tidegate.plans.spec import MappingSpec
from tidegate.schema import SPARK_TYPES, SRC_ROW, TargetSchema

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keys(rows: DataFrame, schema: TargetSchema) -> DataFrame:
    """which (of the schema's unique_keys), key (as JSON of its fields' texts) and line of each key of each row."""
    each = []
    for k, (names, whole) in enumerate(unique_keys(schema)):
        told = F.struct(F.lit(k).alias("which"), F.to_json(F.struct(*[F.col(f"`{n}`").cast("string").alias(n) for n in names])).alias("key"))
        each.append(told if whole else F.when(F.col(f"`{names[0]}`").isNotNull(), told))
    return rows.select(F.col(SRC_ROW).alias("line"), F.inline(F.array_compact(F.array(*each)))).select("which", "key", "line")


def _append(folder: str):
    """Writes batches by epoch; one that is repeated after a failure replaces its own folder, so every row is written once."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def write_checked(landed: DataFrame, spec: MappingSpec, schema: TargetSchema, folder: str, checkpoint: str, **trigger: Any) -> list[StreamingQuery]:
    """Starts the queries that check a stream of landed rows: one for single rows, and one for repeated keys where the schema has any."""
    spark, trigger = landed.sparkSession, trigger or {"availableNow": True}
    rows = row_checked(landed, spec, schema)
    queries = [rows.writeStream.foreachBatch(_append(f"{folder}/rows")).option("checkpointLocation", f"{checkpoint}/rows").trigger(**trigger).start()]
    if unique_keys(schema):
        before = spark.conf.get(_PROVIDER)
        spark.conf.set(_PROVIDER, _ROCKS)
        try:
            # A repeated key is told of whenever it gets more lines.
            seen = _keys(rows, schema).groupBy("which", "key").agg(F.count("*").alias("n"), F.min("line").alias("first")).filter("n > 1")
            queries.append(seen.writeStream.foreachBatch(_append(f"{folder}/keys")).outputMode("update").option("checkpointLocation", f"{checkpoint}/keys").trigger(**trigger).start())
        finally:
            spark.conf.set(_PROVIDER, before)
    return queries


def checked_so_far(spark: SparkSession, spec: MappingSpec, schema: TargetSchema, folder: str) -> Report:
    """The report over all rows that a stream has written: that of one batch run over them."""
    rows = spark.read.parquet(f"{folder}/rows").drop("epoch")
    if unique_keys(schema):
        now = spark.read.parquet(f"{folder}/keys").groupBy("which", "key").agg(F.max("n").alias("n"))

    def repeats(frame: DataFrame, names: list[str]) -> DataFrame:
        which = [k for k, _ in unique_keys(schema)].index(names)
        texts = F.from_json("key", ", ".join(f"`{n}` string" for n in names))
        own = now.filter(F.col("which") == which).select(texts.alias("k"), "n")
        typed = [F.col(f"k.`{n}`").cast(SPARK_TYPES[schema.field(n).dtype]).alias(f"_k_{n}") for n in names]
        # Of a key whose other lines are not written yet, nothing can be said.
        return repeated_keys(frame, names, counts=own.select(*typed, "n")).filter(F.size("lines") > 1)

    return Report(with_uniqueness(rows, spec, schema, repeats), spec.source_id, schema.slug, spec.version, spec.content_hash())
