"""Each stage of the pipeline against brute force on its own input, and run() against the stages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import sentencepiece
from pyspark.sql import functions as F
from test_duplicates import assert_lines_left, left_by_brute_force, near_by_brute_force
from test_operators import measured, mix_targets

import corpus_pipeline
from tidegate.llm import _common, _graph, lines, mixing, rules
from tidegate.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, columns = [docs], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], SF)
        assert k == 4 or (out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema])
        out.write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in inputs[:5]]

    kept = {r.doc_id for r in rules.ledger(docs).filter(rules.passes(rules.STANDARD)).collect()}
    base = {d for d, t in rows[0] for m in [measured(t or "")] if m[0] < 50 or 100 * m[4] > 50 * m[0]}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in kept) and not kept & base and len(kept) > 100

    left, _ = left_by_brute_force(rows[1], lines.LEAST_CHARS)
    assert_lines_left(rows[1], dict(rows[2]), left)
    assert all(WORD.search(t) for _, t in rows[2])

    assert sorted(rows[3]) == sorted((d, t) for d, t in rows[2] if d in {n[0] for n in near_by_brute_force(rows[2]) if n[3]})

    source = {r.doc_id: r.source for r in inputs[3].collect()}
    words = {d: Counter(WORD.findall(t)) for d, t in rows[3]}
    sizes, taken, per_doc = defaultdict(int), defaultdict(int), defaultdict(Counter)
    for d, c in words.items():
        sizes[source[d]] += sum(c.values())
    for d, t in rows[4]:
        per_doc[d] += Counter(WORD.findall(t))
        taken[source[d]] += len(WORD.findall(t))
    assert all(c[w] <= 3 * words[d][w] for d, c in per_doc.items() for w in c)
    assert all(abs(taken[s] - t) <= 1 for s, t in mix_targets(sizes).items())
    assert inputs[4].filter(F.length("text") != F.col("n_chars")).isEmpty()

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    ids = [(d, [*model.encode(t), model.eos_id()]) for d, t in rows[4]]
    wanted = sorted((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(model.decode(i).encode()).hexdigest()) for d, i in ids)
    assert sorted(map(tuple, inputs[5].collect())) == wanted
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == wanted


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        empty = out if out.columns == empty.columns else empty


CLASHING = ("_id", "_row", "_copy", "_new", "_rows", "_hash", "_text_hash", "row", "hash", "doc", "of", "key", "place", "copies", "copy", "node", "label", "removed", "_removed", "c0", "size", "n", "number", "fresh", "kept")


def odd_documents(spark):
    rng = random.Random(9)
    prose = lambda n: ". ".join(" ".join(rng.choice(WORDS) for _ in range(12)).capitalize() for _ in range(n // 12 + 1))
    shared = prose(200)
    rows = [(k, prose(120) + ".", "en", ("a", "b", None)[k % 3]) for k in range(30)]
    rows += [(100, shared, "en", "a"), (101, shared, "en", "b"), (100, shared, "en", "b"), (102, None, "en", "a"), (103, "", None, None), (None, prose(150), "en", "a"), (None, None, "en", None), (104, "\n\n \t", "en", "a")]
    rows += [rows[0], rows[0], (105, "\n".join(prose(60) for _ in range(400)), "de", "b")]
    frame = spark.createDataFrame([(d, t, la, s, len(t or "")) for d, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("source", F.lit("none")))
    return frame.withColumns({c: told for c in CLASHING})


WORDS = [f"{a}{b}{c}" for a in ("bel", "cor", "dan", "fer", "gul", "hom") for b in ("a", "e", "i", "o") for c in ("n", "rt", "sk", "m")]


def test_stages_take_odd_rows_and_columns_of_any_names(spark, tmp_path):
    """Null and empty texts, null ids and sources, repeated rows, one id in two sources, a long text, and columns named as the operators' own."""
    docs = odd_documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for given, where in ((docs, "chain"), (odd_documents(spark), "alone")):
            out = stage(spark, given, SF)
            out.write.parquet(str(tmp_path / f"{where}{k}"))
            found = spark.read.parquet(str(tmp_path / f"{where}{k}"))
            if k == 4:
                assert found.count() == given.count()
                continue
            assert found.columns == docs.columns, name
            told = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("source", F.lit("none")))
            for c in CLASHING:
                assert found.filter(F.col(c) != told).isEmpty(), (name, c)
            assert found.count() > 10
        docs = spark.read.parquet(str(tmp_path / f"chain{k}"))


def test_sources_stay_apart_in_the_mixture(spark):
    """One id and text in two sources: each source gives the words that its target says."""
    text = " ".join(f"w{k}" for k in range(600))
    rows = [(1, text, "a"), (1, text, "b"), *((k, f"{text} {k}", "b") for k in range(2, 12))]
    docs = spark.createDataFrame([(d, t, "en", s) for d, t, s in rows], "doc_id long, text string, lang string, source string")
    taken = {(r.source, r.target): r.taken for r in mixing.taken_words(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").filter("doc_id > 1").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()}
    assert set(taken) == {("b", mix_targets({"a": 600, "b": 600 + 10 * 601})["b"])}
    words = {r.source: r.n for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(abs(words[s] - t) <= 1 for s, t in mix_targets({"a": 600, "b": 600 + 10 * 601}).items())
    assert mixing.mixed_documents(docs).filter("doc_id = 1").select("source").distinct().count() == 2


def test_stages_leave_no_tables_behind(spark, tmp_path, monkeypatch):
    """Steps go when a stage's result is known; what stays is a small table each, and the last stage's rows after a run."""
    folder = tmp_path / "shared"
    folder.mkdir()
    for module in (_common, _graph, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{folder}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k in (1, 2):
        corpus_pipeline.STAGES[k][1](spark, docs, SF).write.parquet(str(tmp_path / f"out{k}"))
        assert len(list(folder.iterdir())) == k
    corpus_pipeline.run(spark, SF)
    assert len(list(folder.iterdir())) == 3
