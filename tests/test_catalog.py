"""Catalog logs and their writers, specs as rows, assignment in rounds, profiles over time, cached vectors, fingerprints."""

import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest

from tidegate import queries as Q
from tidegate.functions.ops import CompileError, TransformOp
from tidegate.operators import profile as P
from tidegate.operators import propose as M
from tidegate.plans import spec_table as T
from tidegate.plans.spec import Candidate, FieldMapping, MappingSpec, diff, validate_spec
from tidegate.schema import TargetSchema
from tidegate.sources import store
from tidegate.sources.landing import Workspace, fingerprint

SF = "/root/testdata/sf0.001"


def spec_of(literal, source="s"):
    return MappingSpec(source, "t", 1, (FieldMapping("a", None, literal, (TransformOp("cast", {"dtype": "string"}),)),))


def test_writers_at_once_make_one_history(spark, tmp_path):
    """Each saved spec is the next version of the one before, whoever saves; a spec that means the same is saved once."""
    places = [Workspace(spark, str(tmp_path / "ws")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        saved = list(pool.map(lambda k: places[k % 4].save_spec(spec_of(f"v{k}")), range(12)))
        same = list(pool.map(lambda k: places[k % 4].save_spec(spec_of("equal", "other")), range(6)))
    history = places[0].history("s")
    assert [s.version for s in history] == list(range(12, 0, -1)) and sorted(s.version for s in saved) == list(range(1, 13))
    assert [s.parent_id for s in history] == [*(f"s-v{k}" for k in range(11, 0, -1)), None]
    assert {s.mappings[0].literal for s in history} == {f"v{k}" for k in range(12)}
    assert {s.version for s in same} == {1} and len(places[0].history("other")) == 1


def test_logs_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "GATHERED", 4)
    log = store.Log(spark, str(tmp_path / "log"), "k int, s string")
    assert log.last() == 0 and log.table().count() == 0
    for k in range(10):
        assert log.append({"k": k, "s": "é\n" if k % 2 else None}) == k + 1
    assert sorted(r.k for r in log.table().collect()) == list(range(10)) and log.last() == 10
    assert [n for n in store.names(spark, str(tmp_path / "log")) if n.startswith("upto-")] == [f"upto-{4:020d}", f"upto-{8:020d}"]
    assert log.commit(lambda: None) is None and log.last() == 10
    assert store.put_if_absent(spark, str(tmp_path / "x/once"), "a") and not store.put_if_absent(spark, str(tmp_path / "x/once"), "b")
    assert (tmp_path / "x/once").read_text() == "a" and store.names(spark, str(tmp_path / "x")) == ["once"]


def test_specs_as_rows_hash_and_differ_as_objects(spark):
    odd = ['"', "\\", "\n\t\r\b\f\x01\x7f", "é€😀", "/", "", "plain"]
    specs = [Q.ORDERS_SPEC, Q.LINES_SPEC, *(replace(spec_of(x, f"s{k} {x}"), _by_field={}) for k, x in enumerate(odd))]
    found = {r.source_id: r.content_hash for r in T.content_hashes(T.rows_of(spark, specs)).collect()}
    assert found == {s.source_id: s.content_hash() for s in specs}
    changed = M.with_transforms(Q.ORDERS_SPEC, "status", TransformOp("upper"))
    changed = replace(changed, mappings=tuple(m for m in changed.mappings if m.target_field != "channel"), _by_field={})
    told = {r.target_field: (r.before, r.after) for r in T.differences(T.rows_of(spark, [Q.ORDERS_SPEC]), T.rows_of(spark, [changed])).collect()}
    assert set(told) == {d["target_field"] for d in diff(Q.ORDERS_SPEC, changed)} == {"status", "channel"}
    assert json.loads(told["status"][1].transforms)[-2] == {"args": {}, "op": "upper"} and told["channel"][1] is None


def test_faults_of_specs_as_rows_are_those_of_objects(spark):
    schema = TargetSchema.of({"name": "t", "version": 1, "fields": [{"name": "a", "dtype": "integer"}, {"name": "b", "dtype": "string"}]})
    cast, strip = (lambda t: TransformOp("cast", {"dtype": t})), TransformOp("strip")
    fields = {
        "good": (FieldMapping("a", "A", None, (strip, cast("integer"))), FieldMapping("b")), "missing": (FieldMapping("a"),), "unknown": (FieldMapping("a"), FieldMapping("b"), FieldMapping("c")),
        "none": (FieldMapping("a", "A"), FieldMapping("b")), "last": (FieldMapping("a", "A", None, (cast("integer"), strip)), FieldMapping("b")), "twice": (FieldMapping("a", "A", None, (cast("integer"), cast("integer"))), FieldMapping("b")),
        "type": (FieldMapping("a", None, "1", (cast("string"),)), FieldMapping("b")), "bare": (FieldMapping("a", None, None, (strip,)), FieldMapping("b")),
    }
    specs = [MappingSpec(k, "t", 1, m) for k, m in fields.items()]
    found = {r.source_id: r.fault for r in T.faults(T.rows_of(spark, specs), schema).collect()}
    for s in specs:
        if s.source_id in found:
            with pytest.raises(CompileError):
                validate_spec(s, schema)
        else:
            validate_spec(s, schema)
    assert found == {"missing": "missing", "unknown": "unknown", "none": "cast", "last": "cast", "twice": "cast", "type": "dtype"}


def test_rounds_of_assignment_are_greedy(spark, tmp_path):
    rng = random.Random(1)
    for n in (1, 5, 30):
        rows = [(f"c{i}", f"f{j}", rng.choice([0.1, 0.35, 0.4, 0.5, 0.9])) for i in range(n) for j in range(n + 2) if rng.random() < 0.7]
        wanted = M.assign({c: [Candidate(f, s) for c2, f, s in rows if c2 == c] for c, _, _ in rows})
        found = M.assign_rows(spark.createDataFrame(rows, "column string, field string, score double"), str(tmp_path / str(n))).collect()
        assert sorted((r["field"], r["column"], r.score) for r in found) == sorted((f, c, x.score) for f, (c, x) in wanted.items())
    assert M.assign_rows(spark.createDataFrame([], "column string, field string, score double"), str(tmp_path / "none")).count() == 0


def test_profiles_over_time_are_those_of_the_whole(spark, tmp_path):
    whole = Q.orders_landing(spark, SF)
    state = P.ProfileState(spark, str(tmp_path / "state"))
    cuts = [0, 400, 900, 10_000]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2):  # a file that is added again replaces its part
            state.add(whole.filter(f"_src_row > {lo} and _src_row <= {hi}"), k)
    wanted = [r.asDict(recursive=True) for r in P.profile(whole, P.distinct_values(whole)).collect()]
    assert [r.asDict(recursive=True) for r in state.profile().collect()] == wanted
    assert [r.asDict(recursive=True) for r in state.compact(str(tmp_path / "compact")).profile().collect()] == wanted


def test_texts_are_encoded_once(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    rows = [(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")]
    texts = spark.createDataFrame(rows, "id int, text string")
    encode = lambda found: [[float(len(t)), float(len(found))] for t in found]
    first = {r.id: r.vector for r in ws.embedded(texts, encode, "m").collect()}
    assert {k: v and v[0] for k, v in first.items()} == {1: 1.0, 2: 2.0, 3: 1.0, 4: None, 5: 0.0} and ws.table("embedding_cache").count() == 3

    def refuses(found):
        assert found == ["new"]
        return [[9.0, 9.0]]

    again = ws.embedded(texts.union(spark.createDataFrame([(6, "new")], texts.schema)), refuses, "m")
    assert {r.id: r.vector and r.vector[0] for r in again.collect()}[6] == 9.0 and ws.table("embedding_cache").count() == 4


@pytest.mark.parametrize("blocks", ["1k", "1m"])
def test_any_byte_changes_the_fingerprint(spark, tmp_path, blocks):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rng = random.Random(7)
    data = bytes(rng.randrange(256) for _ in range(5000)) + b"\r\n\n" + b"line\n" * 300
    variants = {"same": data, "end": data[:-1], "more": data + b"\n", "bit": data[:2000] + bytes([data[2000] ^ 1]) + data[2001:], "last": data[:-2] + b"X\n", "swap": data[:-5] + b"lien\n", "turned": data[5003:] + data[:5003], "empty": b""}
    spark.conf.set("spark.sql.files.maxPartitionBytes", blocks)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        prints = {}
        for name, x in (variants | {"data": data}).items():
            (tmp_path / name).write_bytes(x)
            prints[name] = fingerprint(spark, str(tmp_path / name))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert prints["data"] == prints["same"] and len(set(prints.values())) == len(variants) and prints["data"] == test_any_byte_changes_the_fingerprint.__dict__.setdefault("first", prints["data"])


def test_the_date_format_is_the_engines(spark):
    given = {"date_candidates": [{"format": "%m/%d/%Y", "parsed": 5}, {"format": "%d/%m/%Y", "parsed": 9}], "samples": ["01/02/2024"]}
    assert M.engine_date_format(given) == "%d/%m/%Y" and M.engine_date_format({}) is None
