"""Line dedup and MinHash near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm import _graph, lines, minhash

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_by_brute_force(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids, links, by_shingle = sorted(sets), [], defaultdict(list)
    for d in ids:
        seen = {e for s in sets[d] for e in by_shingle[s]}
        links += [(d, e) for e in seen if 100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e])]
        for s in sets[d]:
            by_shingle[s].append(d)
    labels = components(ids, links)
    return {(d, len(sets[d]), labels[d], labels[d] == d) for d in ids}


@pytest.mark.parametrize("stars, few", [(0, 0), (0, 3), (_graph.STAR_ROUNDS, _graph.FEW)])
def test_near_duplicates_on_all_documents(spark, monkeypatch, stars, few):
    monkeypatch.setattr(_graph, "STAR_ROUNDS", stars)
    monkeypatch.setattr(_graph, "FEW", few)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {tuple(r) for r in minhash.near_duplicates(docs).collect()}
    assert found == near_by_brute_force(docs.select("doc_id", "text").collect())


def test_near_duplicates_chain_and_edge_cases(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(12):  # a chain: neighbours are linked, its ends are not
        own = list(words)
        for j in range(k):
            own[10 * j] = f"x{j}"
        rows.append((100 - k, " ".join(own)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO\twords"), (6, "two  words "), (7, "one " * 400)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {tuple(r) for r in minhash.near_duplicates(docs.withColumn("node", F.lit(1))).collect()}
    assert found == near_by_brute_force(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    odd = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (9, "a b"), (9, "a b"), (8, "A b")], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in odd) == [(0, 0), (8, 8), (9, 8), (9, 8)]


def test_groups_of_alike_documents_keep_one(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(300):
        own = list(base)
        own[rng.randrange(400)] = f"y{k}"
        rows.append((k, " ".join(own)))
    kept = minhash.distinct_documents(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x")))
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == ["doc_id", "text", "key"]


def normal(line):
    return [w for w in re.split(r"[^\w]+|_+", line.lower()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(a, b, most):
    """Whether the distance is at most ``most``, by the cells near the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        fresh = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            fresh[j] = min(row.get(j, most) + 1, fresh.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]) if j else i)
        row = fresh
        if min(row.values()) > most:
            return False
    return row[len(b)] <= most


def alike_pairs(classes):
    """All pairs of lines at an edit similarity of 0.8 or more: they share a pair of neighbours, and lack few of each other's words."""
    by_pair, found = defaultdict(list), set()
    for k, c in enumerate(classes):
        met = Counter(j for p in {*zip(c, c[1:])} for j in by_pair[p])
        for j, shared in met.items():
            n = max(len(c), len(classes[j]))
            most = n * 20 // 100
            if len({*zip(c, c[1:])}) - shared <= 2 * most and len(set(c) - set(classes[j])) <= most >= len(set(classes[j]) - set(c)) and within(c, classes[j], most):
                found.add((j, k))
        for p in {*zip(c, c[1:])}:
            by_pair[p].append(k)
    return found


def left_by_brute_force(rows, least_chars=None):
    """Texts after line dedup by all pairs, and the number of pairs."""
    lines_of = [(d, i, tuple(normal(x))) for d, t in sorted(rows) if t is not None for i, x in enumerate(t.split("\n"))]
    occurrences = [o for o in lines_of if len(o[2]) >= 5 or least_chars is not None and len("".join(o[2])) >= least_chars]
    classes = list(dict.fromkeys(o[2] for o in occurrences))
    number = {c: k for k, c in enumerate(classes)}
    long = [k for k, c in enumerate(classes) if len(c) >= 5]
    links = [(long[a], long[b]) for a, b in alike_pairs([classes[k] for k in long])]
    labels = components(range(len(classes)), links)
    seen, gone = set(), set()
    for d, i, c in occurrences:
        label = labels[number[c]]
        if label in seen:
            gone.add((d, i))
        seen.add(label)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}, len(links)


@pytest.mark.parametrize("stars, few", [(0, 0), (0, 3), (_graph.STAR_ROUNDS, _graph.FEW)])
def test_lines_against_brute_force(spark, monkeypatch, stars, few):
    monkeypatch.setattr(_graph, "STAR_ROUNDS", stars)
    monkeypatch.setattr(_graph, "FEW", few)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    rng = random.Random(1)
    rows = [tuple(r) for r in docs] + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a b c d\na b c d")]
    for k in range(40):  # copies with single words changed
        text = docs[k].text.split(" ")
        for _ in range(max(1, len(text) // 60)):
            text[rng.randrange(len(text))] = f"new{k}"
        rows.append((2000 + k, " ".join(text)))
    wanted, n_links = left_by_brute_force(rows)
    assert n_links >= 5
    frame = spark.createDataFrame(rows, DOCS)
    told = {r.doc_id: r for r in lines.line_counts(frame).collect()}
    left = {r.doc_id: r.text for r in lines.without_repeats(frame.withColumn("pos", F.lit(1)).withColumn("row", F.lit("r"))).collect()}
    assert_lines_left(rows, left, wanted)
    for d, t in rows:
        now = left.get(d, None if t is None else "")
        assert told[d].n_removed == (0 if t is None else t.count("\n") - now.count("\n") + (d not in left)) and (d not in left or told[d].text_sha256 == hashlib.sha256((now or "").encode()).hexdigest())


def assert_lines_left(rows, left, wanted):
    """Nothing goes that all pairs keep; of what they remove, hardly anything stays."""
    removed = kept = 0
    for d, t in rows:
        if t is None:
            assert d in left and left[d] is None
            continue
        gone = Counter(t.split("\n")) - Counter((wanted[d] or "").split("\n"))
        stays = Counter(left[d].split("\n")) - Counter((wanted[d] or "").split("\n")) if d in left else Counter()
        assert not Counter(wanted[d].split("\n")) - Counter(left.get(d, "").split("\n")) - Counter([""]), d
        removed, kept = removed + sum(gone.values()), kept + sum(stays.values())
    assert kept <= 0.02 * removed, (kept, removed)


@pytest.mark.parametrize("few", [0, _graph.FEW])
def test_lines_that_share_a_passage_are_not_all_compared(spark, monkeypatch, few):
    """A passage of most words brings lines together, also in their SimHashes; their other words tell them apart before any pair is made."""
    rng = random.Random(3)
    vocabulary = [w + v for w in ("an", "be", "co", "di", "er", "fo", "ga") for v in ("lo", "mi", "nu", "pe", "ra", "st", "ur", "ve", "wo")] + ["the", "of", "to"]
    passage = [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(45)]
    made = [[rng.choice(vocabulary) for _ in range(rng.randrange(12, 24))] + passage for _ in range(150)]
    for k in range(10):
        own = list(made[k])
        own[3] = "other"
        made.append(own)
    wanted = components(range(len(made)), alike_pairs([tuple(x) for x in made]))
    pairs, store = [], _graph.stored

    def counted(df):
        out = store(df)
        if "turned" in out.columns:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(_graph, "FEW", few)
    monkeypatch.setattr(_graph, "stored", counted)
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(made)], DOCS)
    found = {r.doc_id for r in lines.line_counts(frame).filter("n_removed > 0").collect()}
    assert found == {k for k, label in wanted.items() if label != k} and 10 <= len(found) < 120
    assert sum(pairs) < len(made) ** 2 / 6, pairs  # a third of all pairs


def test_lines_edge_cases(spark):
    line = "one two three four five six"
    rows = [(2, f"{line}\nshort\n{line.upper()}!", "x"), (1, line, "y"), (None, line, "z"), (3, "short", "u"), (4, f"{line}\nown words of the fourth document", "v"), (4, f"{line}\nown words of the fourth document", "v")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    kept = sorted(((r.doc_id, r.text) for r in lines.without_repeats(frame).collect()), key=str)
    assert kept == [(1, line), (2, "short"), (3, "short"), (4, "own words of the fourth document"), (4, "own words of the fourth document")]
    assert lines.without_repeats(frame.limit(0)).count() == 0
    assert lines.without_repeats(frame).columns == frame.columns


@pytest.mark.parametrize("n", [40, lines.CHUNK_WORDS, lines.CHUNK_WORDS + 1, 3 * lines.CHUNK_WORDS])
def test_long_lines_have_the_majority_hash(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    row = lines.sketched(lines.keyed(spark.createDataFrame([(1, text)], DOCS))).collect()
    assert len(row) == 1 and row[0].n_words == n
    hashed = spark.createDataFrame([(i, f"w{i}") for i in range(n)], "i long, w string").withColumn("s", F.xxhash64("w")).withColumn("v", F.when(F.length("w") <= 3, 1).otherwise(4))
    sums = hashed.agg(F.sum("v").alias("all"), *[F.sum(F.shiftright("s", b).bitwiseAND(F.lit(1)) * F.col("v")).alias(f"b{b}") for b in range(64)]).first()
    assert row[0].s & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sums[f"b{b}"] > sums["all"])


@pytest.mark.parametrize("n, changes", [(5, 1), (10, 2), (20, 4), (40, 8)])
def test_complete_lines_against_all_pairs(spark, n, changes):
    """Every line that is alike by edit distance is found, whatever its SimHash."""
    rng = random.Random(n)
    vocabulary = [f"v{i}" for i in range(60)] + ["of", "the", "a"]
    made = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(n)]
        made.append(base)
        for _ in range(2):
            own = list(base)
            for _ in range(changes):
                at = rng.randrange(len(own))
                kind = rng.randrange(3)
                own[at : at + (kind < 2)] = [] if kind == 1 and len(own) > 5 else [f"x{rng.randrange(9)}"]
            made.append(own)
    made += [["a"] * n, ["a"] * (n - 1) + ["b"], ["a", "b"] * n]
    rows = [(i, " ".join(x)) for i, x in enumerate(made)]
    links = [(i, j) for j in range(len(made)) for i in range(j) if distance(made[i], made[j]) <= int(max(len(made[i]), len(made[j])) * 20 / 100)]
    labels = components(range(len(made)), links)
    found = {r.doc_id for r in lines.line_counts(spark.createDataFrame(rows, DOCS), complete=True).filter("n_removed > 0").collect()}
    assert found == {i for i, label in labels.items() if label != i and len(made[i]) >= 5}


def test_recall_over_all_pairs_of_all_documents(spark):
    """Of the lines of all documents that are alike by edit distance, nearly all are in one group, and no others are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect() if r.text is not None]
    classes = sorted({tuple(normal(x)) for t in texts for x in t.split("\n") if len(normal(x)) >= 5})
    pairs = alike_pairs(classes)
    assert len(pairs) > 300
    wanted = components(range(len(classes)), pairs)
    rows = spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(classes)], DOCS)
    sketched = lines.sketched(lines.keyed(rows)).select("one", F.col("doc_id").alias("class"), "n_words", "s", "pairs", F.struct("doc_id", "row", "pos").alias("first"))
    found = {r["class"]: r.component for r in lines.line_groups(sketched, lines.keyed(rows)).join(sketched.withColumnRenamed("one", "node"), "node").select("class", "component").collect()}
    met = [(a, b) for a, b in pairs if a in found and found[a] == found.get(b)]
    assert len(met) >= 0.98 * len(pairs), (len(met), len(pairs))
    groups = defaultdict(set)
    for k, label in found.items():
        groups[label].add(wanted[k])
    assert all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("n", [5, 6, 10, 20, 50, 200])
def test_recall_at_the_threshold(spark, n):
    """Lines with as many random edits as the similarity allows, of words as they are spread in the documents."""
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()
    vocabulary = [w for r in texts for x in (r.text or "").split("\n") for w in normal(x)]
    rng, rows = random.Random(n), []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(n)]
        own = list(base)
        for at in rng.sample(range(n), n * 20 // 100):
            own[at] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    found = lines.line_counts(spark.createDataFrame(rows, DOCS)).filter("n_removed > 0").count()
    assert found >= 0.9 * 150, found


def test_codes_do_not_decide(spark):
    """Different words of one code count as different."""
    code = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("w")).withColumn("c", lines._code(F.col("w")))
    twins = [sorted(r.l)[:2] for r in code.groupBy("c").agg(F.collect_list("w").alias("l")).filter(F.size("l") > 1).limit(2).collect()]
    (a, b), (c, d) = twins
    base = "one two three four five six seven eight".split()
    rows = [(1, " ".join([*base[:6], a, c])), (2, " ".join([*base[:6], b, d])), (3, " ".join([*base[:6], a, "other"]))]
    assert {r.doc_id: r.n_removed for r in lines.line_counts(spark.createDataFrame(rows, DOCS)).collect()} == {1: 0, 2: 0, 3: 1}


def test_links_are_contracted(spark, monkeypatch):
    """Chains, stars and cliques: all passes together read a small multiple of the links."""
    rng = random.Random(9)
    chain, star = [(i, i + 1) for i in range(1000)], [(5000, 5001 + i) for i in range(1000)]
    clique = [(9000 + i, 9000 + j) for i in range(40) for j in range(i)]
    mixed = list(range(20000, 20800))
    rng.shuffle(mixed)
    loops = [(7, 7), (77777, 77777), (3, 2), (2, 3)]
    edges = chain + star + clique + list(zip(mixed, mixed[1:])) + loops
    kept, store = [], _graph.stored

    def counted(df):
        out = store(df)
        if out.columns == ["x", "y"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(_graph, "stored", counted)
    found = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == components({x for e in edges for x in e}, edges)
    assert len(kept) < 12 and sum(kept) < 3 * kept[0] and kept[-1] == 0


def test_very_long_lines(spark):
    words = [f"w{i}" for i in range(6000)]
    near = list(words)
    for i in range(0, 6000, 10):
        near[i] = f"x{i}"
    far = [w if i % 3 else f"y{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "short " * 20000), (5, "SHORT " * 20000)]
    assert {r.doc_id: r.n_removed for r in lines.line_counts(spark.createDataFrame(rows, DOCS)).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_short_lines_are_exact_classes(spark):
    chinese = "数据处理系统的输出结果需要保存"
    rows = [(1, f"All rights reserved\n{chinese}\nyes\none two three four"), (2, f"all rights reserved.\n{chinese}。\nyes\none two three fore"), (3, "No rights reserved\n--------------")]
    frame = spark.createDataFrame(rows, DOCS)
    left = {r.doc_id: r.text for r in lines.without_repeats(frame, complete=True, least_chars=lines.LEAST_CHARS).collect()}
    assert left == {1: rows[0][1], 2: "yes\none two three fore", 3: rows[2][1]}
