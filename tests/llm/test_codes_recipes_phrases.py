"""Vector codes, chunk recipes and phrases against SQL, against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegate.llm import codes, collocations, queries, recipes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name, table", [("op11_codes", "embeddings"), ("op12_recipes", "documents"), ("op13_collocations", "documents")])
def test_rows_of_the_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    found = queries.queries()[name](spark, SF).select(*columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted.fetchall())) and found.count()


# Vector codes


def coded_by_brute_force(rows):
    """(vec_id, code, error, label_error) of rows (vec_id, vector, label) of vectors of one length, and the digest."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    size = len(kept[0][1]) // 16
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(16)]
    books = [[cut(v)[p] for _, v, _ in kept[:64]] for p in range(16)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assigned(v):
        return [min((far(x, e), k) for k, e in enumerate(book)) for x, book in zip(cut(v), books)]

    for _ in range(2):
        members = [defaultdict(list) for _ in books]
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assigned(v)):
                members[p][k].append(cut(v)[p])
        for p, of in enumerate(members):
            for k, found in of.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found)]
    last = [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), label) for i, v, label in kept for a in [assigned(v)]]
    of_label = Counter()
    for _, _, e, label in last:
        of_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, e, of_label[label]) for i, code, e, label in last], digest


def compared(frame, rows):
    found = codes.compressed(frame).collect()
    wanted, digest = coded_by_brute_force(rows)
    assert sorted(map(repr, ((r.vec_id, r.code, r.error, r.label_error) for r in found))) == sorted(map(repr, wanted))
    assert {r.codebooks_sha256 for r in found} <= {digest}
    return found


def test_codes_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.02, -0.01, 0.0, 0.01, rng.random()]) for _ in range(32)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(500, None, 1), (501, [None] + [0.5] * 31, 1), (502, [float("nan")] + [0.5] * 31, 1), (503, [float("inf")] * 32, 2), (504, [float("-inf")] + [0.0] * 31, None)]
    rows += [rows[3], rows[3], (7, [0.25] * 32, 9), (None, [0.75] * 32, None), (None, [-0.75] * 32, 9)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("code", "error", "of", "vector", "part")})
    assert len(compared(frame, rows)) == 155
    compared(frame.filter("vec_id between 10 and 40"), [r for r in rows if r[0] is not None and 10 <= r[0] <= 40])
    assert codes.compressed(frame.limit(0)).count() == 0 and codes.compressed(frame.filter("vec_id between 500 and 504")).count() == 0


def test_vectors_of_other_lengths_and_sizes(spark):
    rows = [(1, [0.5] * 16, 0), (2, [0.5] * 15, 0), (3, [], 0), (4, [0.25] * 16, 0)]
    assert sorted(r.vec_id for r in codes.compressed(spark.createDataFrame(rows, VECTORS)).collect()) == [1, 4]
    assert codes.compressed(spark.createDataFrame(rows[1:], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.compressed(spark.createDataFrame([(1, [3e37] * 16, 0)], VECTORS)).collect()


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(2)
    for size in (1, 3, 4):
        x, book = rng.integers(-6, 6, (2000, size)), rng.integers(-6, 6, (64, size))
        book[40] = book[7]
        whole = ((x[:, None] - book) ** 2).sum(axis=2)
        entry, distance = codes.nearest(x, book)
        assert (entry == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_codes_come_near_their_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = codes.codebooks(vectors)
    near = {r.vec_id: r.vector for r in codes.decoded(codes.encode(vectors, books), books).collect()}
    own = {r.vec_id: r.embedding for r in vectors.collect()}
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assert sum(apart(near[i], own[i]) for i in own) < 0.5 * sum(apart(own[i], own[(i + 1) % len(own)]) for i in own)


# Chunk recipes


def kept_by_brute_force(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    told = []
    for t, ids in groups.items():
        most = max((d for d in ids if d is not None), default=None)
        kept = 0
        for d in ids:
            stays = d == most and not kept
            kept += stays
            told.append((d, most, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, told))


def odd_documents():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefg \n") for _ in range(300_000))
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (None, "a"), (None, "only"), (None, "only"), (6, "é😀"), (7, "é😀"), (8, "É😀"), (9, long), (10, long), (11, long[:-1]), (12, long + "x"), (13, "x" + long), (14, "y" * 100_000), (15, "y" * 100_000), (16, "y" * 99_999)]
    return rows + [(20, "twice"), (20, "twice"), (20, "other")] + [(100 + k, "copy") for k in range(200)]


@pytest.mark.parametrize("bits", [64, 1])
def test_copies_of_odd_rows(spark, bits):
    rows = odd_documents()
    frame = spark.createDataFrame(rows, DOCS).repartition(6).withColumns({c: F.lit(1) for c in ("tag", "key", "recipe", "stays", "hash", "kept")})
    found = recipes.duplicates(frame, hash_bits=bits)
    assert sorted(repr(tuple(r)) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == kept_by_brute_force(rows)
    assert recipes.duplicates(frame.limit(0), hash_bits=bits).count() == 0


def test_chunks_are_cut_by_content():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    one, two, three = ([bytes(c) for c in found] for found in recipes.cut(pa.array([text, "inserted in front " + text, None])))
    assert b"".join(one) == text.encode() and three == []
    assert all(len(c) <= recipes.MOST for c in one) and all(len(c) >= recipes.LEAST for c in one[:-1])
    assert len(set(one) & set(two)) >= len(one) - 2


# Phrases


def phrases_by_brute_force(rows, least=10, top=2000):
    counts = defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    told = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            told.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(told)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("shard", [1, 40, collocations.SHARD])
def test_phrases_of_odd_rows(spark, monkeypatch, shard):
    rng = random.Random(6)
    vocabulary = ["New", "york", "CITY", "é", "É", "a", "a", "😀", "x\x1fy", "of", "ß"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "-"]) for _ in range(rng.randrange(400)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", "a a a a a a a a a a a a a a"), ("xx", " .,; \n"), ("long", "one two three " * 30_000)] + [("de", "same old words here")] * 40
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4).withColumns({c: F.lit(1) for c in ("phrase", "n", "key", "cell", "kind", "word")})
    found = sorted(tuple(r) for r in collocations.collocations(frame, shard=shard).select(*COLUMNS).collect())
    assert found == phrases_by_brute_force(rows)
    assert collocations.collocations(frame.limit(0)).count() == 0 and collocations.collocations(frame.filter("lang = 'xx'")).count() == 0


def test_full_sketches_lose_nothing(spark, monkeypatch):
    """With few counters for many phrases, most phrases are candidates; the counts decide."""
    monkeypatch.setattr(collocations, "BYTES_A_COUNTER", 1 << 30)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'es'")
    found = sorted(tuple(r) for r in collocations.collocations(docs).select(*COLUMNS).collect())
    assert found == phrases_by_brute_force([(r.lang, r.text) for r in docs.collect()]) and found


def test_scores_are_exact():
    """Products of counts beyond 64 bits; the text says what decimals give."""
    a, left, right = 3_000_000_007, 4_000_000_001, 5_000_000_003
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._scored(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)
