"""Ranking of vectors against brute force, and the recall of the index."""

import random

import pytest

from tidegate.operators import vectors as X

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>"


def by_brute_force(queries, rows, k):
    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    out = []
    for q, v in queries:
        scored = sorted((-round(cosine(v, w), 4), i) for i, w in rows)
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("columns, rows", [(4096, 1 << 20), (3, 7)])
def test_ties_nulls_and_copies(spark, monkeypatch, columns, rows):
    monkeypatch.setattr(X, "COLUMN_QUERIES", columns)
    monkeypatch.setattr(X, "ROW_VECTORS", rows)
    rng = random.Random(8)
    given = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)]
    given += [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [1.0, 2.0]), (-5, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(given, VECTORS).repartition(5)
    asked = frame.filter("vec_id % 5 = 0")
    found = sorted(tuple(r) for r in X.cosine_top(asked, frame, k=4).collect())
    wanted = by_brute_force([r for r in given if r[0] % 5 == 0], given, 4)
    assert [(q, i, round(s, 4), r) for q, i, s, r in found] == [(q, i, round(s, 4) + 0.0, r) for q, i, s, r in wanted]
    assert X.cosine_top(asked.limit(0), frame).count() == 0 and X.cosine_top(asked, frame.limit(0)).count() == 0
    few = X.cosine_top(frame.filter("vec_id < 3"), frame.filter("vec_id in (1, 2)"), k=4)
    assert few.count() == 2 * frame.filter("vec_id < 3").count()


def test_the_index_holds_all_rows_and_finds_most_links(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked, index = vectors.filter("vec_id % 20 = 0"), X.VectorIndex(vectors)
    assert sorted(r.id for r in index.rows.collect()) == sorted(r.vec_id for r in vectors.collect())
    exact = X.cosine_top(asked, vectors)
    assert X.recall(index.search(asked), exact).first().recall >= 0.9
    whole = index.search(asked, probes=len(index.centres))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))
    index.write(str(tmp_path / "index"))
    assert sorted(map(tuple, index.search(asked, probes=len(index.centres)).collect())) == sorted(map(tuple, exact.collect()))


def test_the_index_needs_few_cells_where_vectors_lie_in_groups(spark):
    rng = random.Random(9)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    given = [(i, [x + rng.gauss(0, 0.05) for x in middles[i % 12]]) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    frame = spark.createDataFrame(given, VECTORS)
    index = X.VectorIndex(frame)
    assert index.probes <= len(index.centres) // 3
    asked = frame.filter("vec_id % 20 = 0")
    assert X.recall(index.search(asked), X.cosine_top(asked, frame)).first().recall >= 0.9
    empty = X.VectorIndex(frame.limit(0))
    assert empty.search(asked).count() == 0 and index.search(asked.limit(0)).count() == 0
