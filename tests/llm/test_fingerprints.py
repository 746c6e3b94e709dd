"""Fingerprints: contract columns against brute force, likeness against the generalised Jaccard similarity."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tidegate.llm import fingerprints

DOCS = "doc_id long, text string"


def edited_by_brute_force(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((d, t, t[: len(t) - half] + after[:half], after))
    return out


def jaccard(a, b):
    a, b = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", x) if w) for x in (a, b))
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def test_columns_and_likeness_on_all_documents(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 64)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = {d: (t, e, n) for d, t, e, n in edited_by_brute_force(docs.select("doc_id", "text").collect())}
    found = fingerprints.fingerprint(docs).collect()
    assert len(found) == len(wanted)
    errors = []
    for r in found:
        text, edit, after = wanted[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edit), r.near_next - jaccard(text, after)]
    assert abs(sum(errors) / len(errors)) < 0.02 and sum(e * e for e in errors) / len(errors) < 0.01


def test_edge_cases(spark):
    rows = [(5, "same words here"), (4, "same words here"), (3, None), (2, ""), (1, "é😀 ab"), (None, "last"), (7, "x y"), (7, "x y")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("told", F.lit(1)).withColumn("bucket", F.lit(2))
    found = fingerprints.fingerprint(frame).collect()
    wanted = edited_by_brute_force(rows)
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in found) == sorted((d or 0, hashlib.sha256(e.encode()).hexdigest()) for d, _, e, _ in wanted)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].fingerprint == by_id[4].fingerprint != "" and by_id[5].near_next == 1.0
    assert by_id[3].fingerprint == "" and by_id[3].near_next == 1.0 and by_id[4].near_next == 0.0
    assert fingerprints.fingerprint(frame.limit(0)).count() == 0
    single = fingerprints.fingerprint(frame.filter("doc_id = 5")).first()
    assert single.near_next == 1.0 and single.n_chars == 15


def test_rows_without_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 8)
    rows = [(k, f"own words of {k}") for k in range(40)] + [(None, f"no id but text {k}") for k in range(150)] + [(None, None), (None, "no id but text 3")]
    frame = spark.createDataFrame(rows, DOCS)
    place = {r.text: r.place for r in frame.select(F.coalesce("text", F.lit("")).alias("text"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 32).alias("place")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), place[r[1] or ""] if r[0] is None else 0, r[1] or ""))
    wanted = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        wanted.append((str(d), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints.fingerprint(frame).collect()) == sorted(wanted)
    assert fingerprints.neighbours(frame).filter("doc_id is null").select("bucket").distinct().count() > 10


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    found = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame([(2, text), (1, text + " end"), (0, "short")], DOCS)).collect()}
    assert found[2].n_chars == len(text) and found[2].near_next > 0.9 and found[1].near_next == 0.0
