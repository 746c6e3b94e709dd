"""Landing: files become Parquet tables with a catalog of sources, profiles, specs and runs.

A workspace is a folder that driver and executors share. Landed data, profiles and
run results are Parquet; the catalog's tables are logs of numbered entries, to which
any number of writers append.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.profile import counted, profile
from tidegate.operators.propose import Encoder, request_hash
from tidegate.operators.validate import Report, check
from tidegate.plans.compile import compile_script, render_module
from tidegate.plans.spec import MappingSpec
from tidegate.schema import SRC_ROW, TargetSchema
from tidegate.sources import store
from tidegate.sources.readers import land, with_src_row

#: Problem groups in the report of a run; all of them are a table beside it.
LISTED_GROUPS = 1000
#: Texts that an encoder is given together.
ENCODED = 64
#: The one table that tasks write; the others are logs, whose entries are put one by one.
CACHE = "embedding_cache"
#: The catalog's tables.
TABLES = {
    "sources": "source_id string, path string, kind string, fingerprint string, detail string, row_count long, created_at double",
    "mapping_specs": "spec_id string, source_id string, version int, parent_id string, content_hash string, spec string, created_by string, created_at double",
    "llm_calls": "call_id string, source_id string, model string, request_hash string, response string, error string, latency_ms double, created_at double",
    "embedding_cache": "content_hash string, model string, vector array<float>",
    "runs": "run_id string, source_id string, spec_version int, content_hash string, rows_in long, rows_out long, rows_rejected long, rows_valid long, report string, created_at double",
}


def fingerprint(spark: SparkSession, path: str) -> str:
    """16 hex digits that tell a file's bytes apart, whatever it holds and in however many tasks it is read.

    The file is taken in lines; each is hashed with its number, so order counts, and hashes are summed, so no task needs another's.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))
    leaf = F.sha2(F.concat(F.col(SRC_ROW).cast("string").cast("binary"), F.lit(b":"), "bytes"), 256)
    parts = [F.sum(F.conv(F.substring(leaf, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    told = with_src_row(lines, 1).agg(F.count("*"), *parts).first()
    return hashlib.sha256(":".join(map(str, (store.size(spark, path), *told))).encode()).hexdigest()[:16]


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Catalog

    def _log(self, name: str) -> store.Log:
        return store.Log(self.spark, f"{self.folder}/catalog/{name}", TABLES[name])

    def table(self, name: str) -> DataFrame:
        """A catalog table; empty before its first row."""
        if name != CACHE:
            return self._log(name).table()
        path = f"{self.folder}/catalog/{name}"
        return self.spark.read.schema(TABLES[name]).parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, *rows: dict) -> None:
        self._log(name).append(*rows)

    # Models

    def logged(self, answer: Callable[[dict], dict], model: str, source_id: str | None = None) -> Callable[[dict], dict]:
        """The answering function of a model, with every call of it noted in llm_calls, failed ones too."""

        def ask(asked: dict) -> dict:
            note, began = {"call_id": uuid.uuid4().hex[:12], "source_id": source_id, "model": model, "request_hash": request_hash(asked)}, time.time()
            try:
                told = answer(asked)
                note["response"] = json.dumps(told, default=str)
                return told
            except Exception as e:
                note["error"] = repr(e)
                raise
            finally:
                self.append("llm_calls", note | {"latency_ms": 1000 * (time.time() - began), "created_at": began})

        return ask

    def cached(self, encode: Encoder, model: str) -> Encoder:
        """The encoder of a model for the few texts of a proposal; only texts whose content is not in the cache are encoded, and then kept there."""

        def vectors(texts: list[str]) -> list[list[float]]:
            frame = self.spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "place int, text string")
            found = {r.place: list(r.vector) for r in self.embedded(frame, encode, model).collect()}
            return [found[k] for k in range(len(texts))]

        return vectors

    def embedded(self, texts: DataFrame, encode: Encoder, model: str, text_col: str = "text") -> DataFrame:
        """The rows with their texts' vectors (null texts have none). Texts whose content the cache lacks are encoded in tasks, each once, and kept.

        ``encode`` runs where the texts are, on lists of at most ENCODED of them.
        """
        keyed = texts.withColumn("_key", F.substring(F.sha2(text_col, 256), 1, 32))
        misses = self._misses(keyed.select("_key", F.col(text_col).alias("text")), model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ENCODED):
                    part = batch.slice(at, ENCODED)
                    found = [[float(x) for x in v] for v in encode(part.column("text").to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array([model] * len(found), pa.string()), pa.array(found, pa.list_(pa.float32()))], ["content_hash", "model", "vector"])

        misses.mapInArrow(run, TABLES[CACHE]).write.mode("append").parquet(f"{self.folder}/catalog/{CACHE}")
        # A text that two runs encoded at once has two equal rows.
        held = self.table(CACHE).filter(F.col("model") == model).groupBy("content_hash").agg(F.first("vector").alias("vector"))
        return keyed.join(held, F.col("_key") == F.col("content_hash"), "left").drop("_key", "content_hash")

    def _misses(self, keyed: DataFrame, model: str) -> DataFrame:
        """_key and text, once, of texts that the cache of a model lacks."""
        held = self.table(CACHE).filter(F.col("model") == model).select(F.col("content_hash").alias("_key"))
        return keyed.filter("_key is not null").join(held, "_key", "left_anti").dropDuplicates(["_key"])

    # Sources

    def landed_path(self, source_id: str) -> str:
        return f"{self.folder}/landed/{source_id}"

    def register(self, path: str, sheet: str | None = None) -> str:
        """Land a file, profile it and note it in the catalog; its new id."""
        source_id = uuid.uuid4().hex[:12]
        landed = land(self.spark, path, sheet)
        landed.frame.write.parquet(self.landed_path(source_id))
        frame = self.frame(source_id)
        with counted(frame) as values:
            profile(frame, values).write.parquet(f"{self.folder}/profiles/{source_id}")
        self.append("sources", {"source_id": source_id, "path": path, "kind": landed.kind, "fingerprint": fingerprint(self.spark, path), "detail": json.dumps(landed.detail), "row_count": frame.count(), "created_at": time.time()})
        return source_id

    def sources(self) -> DataFrame:
        return self.table("sources").orderBy(F.desc("created_at"))

    def source(self, source_id: str) -> dict:
        row = self.table("sources").filter(F.col("source_id") == source_id).first()
        if row is None:
            raise KeyError(f"no source {source_id}")
        return row.asDict()

    def frame(self, source_id: str) -> DataFrame:
        return self.spark.read.parquet(self.landed_path(source_id))

    def profiles(self, source_id: str) -> list[dict]:
        """One dict per column, as the proposer takes them."""
        return [r.asDict(recursive=True) for r in self.spark.read.parquet(f"{self.folder}/profiles/{source_id}").orderBy("ordinal").collect()]

    def preview(self, source_id: str, limit: int = 50) -> DataFrame:
        return self.frame(source_id).orderBy(SRC_ROW).limit(min(limit, 200))

    # Specs

    def save_spec(self, spec: MappingSpec, created_by: str = "human") -> MappingSpec:
        """A new version, unless the head means the same. Of several that are saved at once, each becomes the next version of the one before."""
        saved = spec

        def decide() -> list[dict] | None:
            nonlocal saved
            head = self.head_spec(spec.source_id)
            if head is not None and head.content_hash() == spec.content_hash():
                saved = head
                return None
            number = head.version + 1 if head else 1
            parent = f"{spec.source_id}-v{head.version}" if head else None
            saved = replace(spec, version=number, parent_id=parent, created_by=created_by, _by_field={})
            return [{"spec_id": f"{spec.source_id}-v{number}", "source_id": spec.source_id, "version": number, "parent_id": parent, "content_hash": saved.content_hash(), "spec": json.dumps(saved.to_dict()), "created_by": created_by, "created_at": time.time()}]

        self._log("mapping_specs").commit(decide)
        return saved

    def history(self, source_id: str) -> list[MappingSpec]:
        rows = self.table("mapping_specs").filter(F.col("source_id") == source_id).orderBy(F.desc("version")).collect()
        return [MappingSpec.from_dict(json.loads(r.spec)) for r in rows]

    def head_spec(self, source_id: str) -> MappingSpec | None:
        row = self.table("mapping_specs").filter(F.col("source_id") == source_id).orderBy(F.desc("version")).first()
        return MappingSpec.from_dict(json.loads(row.spec)) if row else None

    # Runs

    def run(self, source_id: str, schema: TargetSchema, spec: MappingSpec | None = None) -> tuple[str, Report]:
        """Transform and validate a source; checked rows are written once and all results read from there.

        valid rows: runs/<id>/valid; problem groups: runs/<id>/groups, of which the report holds their
        number and the LISTED_GROUPS largest; the scripts and the report lie beside them in the catalog row.
        """
        spec = spec or self.head_spec(source_id)
        if spec is None:
            raise KeyError(f"no spec for {source_id}")
        run_id = uuid.uuid4().hex[:12]
        folder = f"{self.folder}/runs/{run_id}"
        report = check(self.frame(source_id), spec, schema)
        report.rows.write.parquet(f"{folder}/checked")
        report = replace(report, rows=self.spark.read.parquet(f"{folder}/checked"))
        report.valid.write.parquet(f"{folder}/valid")
        report.groups().write.parquet(f"{folder}/groups")
        groups = self.spark.read.parquet(f"{folder}/groups")
        counts = report.counts()
        listed = groups.orderBy(F.desc("n"), "first_line", "clause").limit(LISTED_GROUPS).collect()
        told = {"summary": report.summary(counts), "n_groups": groups.count(), "groups": [r.asDict(recursive=True) for r in listed]}
        scripts = {"sql": compile_script(spec, schema, self.landed_path(source_id)), "py": render_module(spec, schema)}
        artifacts = {kind: f"{self.folder}/artifacts/{source_id}/v{spec.version}_{spec.content_hash()}.{kind}" for kind in scripts}
        for kind, text in scripts.items():
            store.write_text(self.spark, artifacts[kind], text)
        told |= {"sql": scripts["sql"], "python": scripts["py"], "artifacts": artifacts}
        self.append("runs", {"run_id": run_id, "source_id": source_id, "spec_version": spec.version, "content_hash": spec.content_hash(), "rows_in": counts["rows_in"], "rows_out": counts["rows_in"], "rows_rejected": counts["rejected"], "rows_valid": counts["valid"], "report": json.dumps(told, default=str), "created_at": time.time()})
        return run_id, report

    def run_of(self, run_id: str) -> dict:
        """A run's row of the catalog, its report read."""
        row = self.table("runs").filter(F.col("run_id") == run_id).first()
        if row is None:
            raise KeyError(f"no run {run_id}")
        return row.asDict() | {"report": json.loads(row.report)}

    def runs(self, source_id: str) -> DataFrame:
        return self.table("runs").filter(F.col("source_id") == source_id).orderBy(F.desc("created_at"))
