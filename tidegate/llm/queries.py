"""Queries of the training-data operators for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import codes, collocations, fingerprints, html, lines, minhash, mixing, pieces, quality, recipes, rules, secret_scan, token_output
from tidegate.llm._common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(table(spark, sf_dir, "documents"), least_chars=lines.LEAST_CHARS)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        (~rules.passes(rules.BASE)).alias("base_failed"),
        rules.passes(rules.STANDARD).alias("kept"),
        "failed_bits",
    )


def rules_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the standard policy rejects, alone and beside others."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def rules_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each version of each policy keeps, from one ledger."""
    told = rules.verdicts(rules.ledger(table(spark, sf_dir, "documents")))
    return told.groupBy("policy", "version").agg(F.count("*").alias("n_documents"), F.count_if("kept").alias("n_kept"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_secrets": op2_secrets,
        "op3_quality": op3_quality,
        "op4_pieces": op4_pieces,
        "op5_lines": op5_lines,
        "op6_html": op6_html,
        "op7_rules": op7_rules,
        "rules_ablations": rules_ablations,
        "rules_verdicts": rules_verdicts,
        "op8_mixing": op8_mixing,
        "op9_minhash": op9_minhash,
        "op10_fingerprints": op10_fingerprints,
        "op11_codes": op11_codes,
        "op12_recipes": op12_recipes,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_codes": codes.ORACLE, "op12_recipes": recipes.ORACLE, "op13_collocations": collocations.ORACLE}
