"""A corpus pipeline of five stages over ``documents``: rules, lines, near-duplicates, mixing, pieces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import lines, minhash, mixing, pieces, rules
from tidegate.llm._common import remove, shared_dir, table, temporary_steps
from tidegate.llm.queries import tokenizer_path

#: Workers stay for the next stages, so the encoder keeps fewer entries here than on its own.
PIECE_CACHE = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps.

    A null or empty text has no words and goes; rows are judged one by one, so repeated rows and ids, ties,
    null ids and very long texts need nothing of their own; columns of any other names are kept as they are.
    """
    return rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those left without words go.

    Null texts stay null; of equal lines the first by id, then row, then line stays, rows with null ids being
    last, and repeated rows with one id and text are one document; long texts and lines are taken whole.
    """
    return lines.without_repeats(docs, least_chars=lines.LEAST_CHARS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Null and wordless texts are alike to none and stay, as do rows with null ids; all rows of an id go or stay
    together; texts are compared whole; columns of any other names are kept as they are.
    """
    return minhash.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mixture: repeated, whole, or the words that are taken.

    Documents without words, null texts included, have no row; a null source is one of its own; repeated rows each
    have their own words; a very long text spans many blocks and may be taken in part; other columns are repeated.
    """
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row per row; null texts count as empty, and long ones are encoded whole."""
    return pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), cache_entries=PIECE_CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: SQL has neither SimHash and MinHash of these hash functions nor the piece encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read again.

    A stage's input and the tables of its steps are deleted when it is written; the last one's rows stay. An empty
    table goes through all stages and gives an empty result.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with temporary_steps(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
