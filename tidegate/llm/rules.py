"""Quality rules with a bitmask ledger (operator 7).

``measure`` reads each text once and records integer measurements. ``ledger``
evaluates every rule once and keeps the failures as bits of one long.
A versioned ``Policy`` is then only a mask over those bits: applying another
policy, or asking what a policy would keep without one rule, needs no text.

Defined cases: a null or empty text has no words and all measurements 0, so it
fails ``few_words``; a very long text is measured whole, by itself; repeated rows are judged one by one; an empty table gives
an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._words import SPACE, Chunk, chunks, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipes", "n_shouts", "n_marks")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(0x41, 0x5B))] = True
_LOWER = np.zeros(256, bool)
_LOWER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Rule:
    """A rule fails a text where ``fails`` holds over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "table_cells", "20 * n_pipes > n_words"),
    Rule(4, "shouting", "100 * n_shouts > 30 * n_words"),
    Rule(5, "exclamations", "100 * n_marks > 30 * n_words"),
    Rule(6, "repeated_lines", "n_dup_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(7, "long_words", "word_chars > 15 * n_words"),
    Rule(8, "short_words", "word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules whose failure rejects a text."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return reduce(lambda m, name: m | 1 << bits[name], self.rules, 0)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))
#: The next version of the standard: the length of words, which scripts without spaces leave open, no longer rejects a text.
STANDARD_2 = Policy("standard", 2, tuple(r.name for r in RULES if r.name not in ("long_words", "short_words")))
POLICIES = (BASE, STANDARD, STANDARD_2)


def _repeated_lines(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _measured(chunk: Chunk, texts: list[str]) -> dict[str, np.ndarray]:
    data = chunk.bytes
    starts, ends, doc = chunk.spans()
    words = chunk.hashes(starts, ends)
    n_words = chunk.per_text(doc)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[chunk.bounds[1:]] - sums[chunk.bounds[:-1]]

    repeated = np.zeros(len(words) + 1, np.int64)
    window, first = windows(words, doc, 3)
    if len(window):
        key = window ^ (doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(repeated, first[twice], 1)
        np.add.at(repeated, first[twice] + 3, -1)
    covered = np.cumsum(repeated)[:-1] > 0

    upper = np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int64)))
    lower = np.concatenate(([0], np.cumsum(_LOWER[data], dtype=np.int64)))
    shout = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    lines = np.array([_repeated_lines(x) for x in texts], np.int64).reshape(-1, 2)
    return {
        "n_words": n_words,
        "word_chars": per_text(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": chunk.per_text(doc[covered]),
        "n_lines": lines[:, 0],
        "n_pipes": per_text(data == ord("|")),
        "n_shouts": chunk.per_text(doc[shout]),
        "n_marks": per_text(data == ord("!")),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for chunk in chunks(texts):
            found = _measured(chunk, texts[chunk.lo : chunk.hi].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[chunk.lo : chunk.hi], *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                ["doc_id", *MEASURES],
            )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the measurements, all longs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measure_batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(docs: DataFrame, **columns: str) -> DataFrame:
    """Measurements and ``failed_bits`` of every rule, evaluated once."""
    return measure(docs, **columns).withColumn("failed_bits", failure_bits())


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def verdicts(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One row per document and policy; no text is read again."""
    named = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), passes(p).alias("kept")) for p in policies])
    return rows.select("doc_id", "failed_bits", F.inline(named))


def ablations(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail no other rule of it.

    One aggregation over the distinct bit patterns; ``seen_with`` is the bitwise
    OR of the patterns in which the rule fails, that is the rules it overlaps.
    """
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in RULES if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    hit = F.col("bits").bitwiseAND(F.col("rule.bit")) != 0
    return (
        patterns.select("bits", "n", each.alias("rule"))
        .groupBy(F.col("rule.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("rule.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
            F.coalesce(F.bit_or(F.when(hit, F.col("bits"))), F.lit(0)).alias("seen_with"),
        )
    )


def keep(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns.

    Rows are judged where they lie (no join), so repeated ids and clashing
    column names are no matter.
    """
    names = docs.columns
    at, rules = names.index(text_col), policy.mask
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [f"c{i}" for i in range(len(names))]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            for chunk in chunks(texts):
                found = _measured(chunk, texts[chunk.lo : chunk.hi].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[chunk.lo : chunk.hi] for i in range(len(names))), *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                    [*fields, *MEASURES],
                )

    types = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in fields), *(f"{m} long" for m in MEASURES)])
    kept = plain.mapInArrow(judged, schema).filter(failure_bits().bitwiseAND(F.lit(rules)) == 0)
    return kept.select(*fields).toDF(*names)
