"""Files whose records depend on what stands before them, read in small blocks, against reading them whole."""

import csv
import io
import json
import random

import pytest

from tidegate.sources import blocks as B
from tidegate.sources import readers as R

SMALL = "2k"


@pytest.fixture
def small_blocks(spark):
    """Files are split every two kilobytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", SMALL)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(frame):
    return [tuple(r)[1:] for r in frame.orderBy(R.SRC_ROW).collect()], [r[0] for r in frame.orderBy(R.SRC_ROW).select(R.SRC_ROW).collect()]


@pytest.mark.parametrize("end, seed", [("\n", 1), ("\r\n", 2), ("\n", 3)])
def test_quoted_line_breaks_in_many_blocks(spark, tmp_path, small_blocks, end, seed):
    rng = random.Random(seed)
    cells = ["plain", "", 'said "hi"', "two\nlines", "a,b", '"', "\n\n", "é😀", "long " * 60, 'x\n"y",\n']
    rows = [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(700)]
    rows[300][1] = "one very long cell\n" * 500  # spans several blocks
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "one", "two"], *rows])
    path = tmp_path / "quoted.csv"
    path.write_bytes(out.getvalue().encode())
    landed = R.land(spark, str(path)).frame
    found, numbers = rows_of(landed)
    assert numbers == list(range(2, 702))
    assert found == [tuple(c or None for c in r) for r in rows]
    assert B.segments(spark, str(path), "\n").rdd.getNumPartitions() > 10


def test_lines_with_quotes_inside_cells(spark, tmp_path, small_blocks):
    """As the whole file is read by one task: quotes in the middle of a cell are text, blank lines are no records, and single-byte files are decoded."""
    rng = random.Random(4)
    lines = [f'{i};5" pipe;"q; ""x""\nnext";{rng.choice(["ä", "€", ""])}' if i % 3 else (f"{i};a" if i % 2 else f'{i};"b" c;d;e;f') for i in range(400)]
    text = "id;size;note;sign\n\n" + "\n\n".join(lines) + "\n"
    path = tmp_path / "odd.csv"
    path.write_bytes(text.encode("cp1252"))
    found, numbers = rows_of(R.read_csv(spark, str(path)).frame)
    whole = R.read_whole_csv(spark, str(path)).frame
    assert (found, numbers) == rows_of(whole) and len(found) > 390


def test_quote_states():
    for line, inside, after in (('a,"b', False, True), ('c"', True, False), ('""x', True, True), ('a"b,c', False, False), ('"a""b",c', False, False), ('x",y,"', True, True), ("", True, True), ('"', False, True), ('"x"y,"z', False, True), (",", False, False)):
        assert B.quote_left_open(line, inside, ",") is after, line


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, "utf-8")
    return str(path)


@pytest.mark.parametrize("indent", [None, 1])
def test_json_lists_in_many_blocks(spark, tmp_path, small_blocks, indent):
    rng = random.Random(5)
    odd = ["}", "{[,", '"quoted" }, {', "\\", "é😀", "a\nb", ""]
    records = [{"id": i, "who": {"name": rng.choice(odd), "tags": [1, {"x": "}"}]}, "n": None if i % 4 else 1.5} for i in range(400)]
    records[200]["who"]["name"] = "}{" * 4000
    wanted = [(str(r["id"]), r["who"]["name"], None if r["n"] is None else "1.5") for r in records]
    for name, whole in (("array", records), ("object", {"few": [1, 2], "none": [], "meta": {"a": 1, "b": [3]}, "ro}ws": records, "after": {"x": [1] * 9}, "last": [1]})):
        landed = R.land(spark, written(tmp_path, f"{name}.json", json.dumps(whole, indent=indent, ensure_ascii=False))).frame
        assert landed.columns == [R.SRC_ROW, "id", "who.name", "who.tags", "n"]
        found = landed.orderBy(R.SRC_ROW).collect()
        assert [(r["id"], r["who.name"], r["n"]) for r in found] == wanted and [r[0] for r in found] == list(range(1, 401))
    assert B.segments(spark, str(tmp_path / "array.json"), "}").rdd.getNumPartitions() > 10


def test_small_json_files(spark, tmp_path, small_blocks):
    def landed(name, text):
        frame = R.land(spark, written(tmp_path, name, text)).frame
        return frame.columns[1:], [tuple(r)[1:] for r in frame.orderBy(R.SRC_ROW).collect()]

    assert landed("scalars.json", "[1, \"a\", null, true]")[1][:2] == [("1",), ("a",)]
    assert landed("inner.json", '{"a": [1, 2], "b": ["x"]}') == (["value"], [("1",), ("2",)])
    assert landed("equal.json", '{"b": [{"k": 1}], "a": [{"z": 2}]}') == (["k"], [("1",)])
    assert landed("one.json", '{"a": 1, "b": {"c": "x"}}') == (["a", "b.c"], [("1", "x")])
    assert landed("mixed.json", '[{"a": 1}, 5, {"b": [ ]}]')[1] == [("1", None, None), (None, "5", None), (None, None, "[]")]


def test_columns_by_first_appearance(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(R, "SNIFF_BYTES", 300)
    monkeypatch.setattr("tidegate.sources.sniff.SNIFF_BYTES", 300)
    records = [{"z": "x" * 100, "a": {"b": i}} for i in range(60)]
    records[30] |= {"late": None, "y": 1}
    records[20] |= {"w": {"v": None}}
    records[40] |= {"late": 2, "w": {"v": 3}}
    for name, text in (("order.jsonl", "".join(json.dumps(r) + "\n" for r in records)), ("order.json", json.dumps(records))):
        assert R.land(spark, written(tmp_path, name, text)).frame.columns == [R.SRC_ROW, "z", "a.b", "w.v", "late", "y"]


def test_a_malformed_line_is_named(spark, tmp_path, small_blocks):
    text = "".join(json.dumps({"a": i}) + "\n" for i in range(500))
    lines = text.splitlines()
    lines[321] = '{"a": '
    with pytest.raises(ValueError, match="line 322"):
        R.land(spark, written(tmp_path, "bad.jsonl", "\n".join(lines)))


def test_empty_lists_marks_and_open_quotes(spark, tmp_path, small_blocks):
    def landed(name, content):
        (tmp_path / name).write_bytes(content)
        frame = R.land(spark, str(tmp_path / name)).frame
        return frame.columns[1:], [tuple(r) for r in frame.orderBy(R.SRC_ROW).collect()]

    assert landed("a.json", b"[]") == landed("b.json", b'{"rows": []}') == landed("c.json", b'{"rows": [ ], "x": 1}') == ([], [])
    assert landed("d.json", b"[{}, {}]") == ([], [(1,), (2,)])
    assert landed("e.json", b'\xef\xbb\xbf[{"a": 1}]') == (["a"], [(1, "1")])
    assert landed("f.csv", b'\xef\xbb\xbfid,note\n1,"a\nb"\n') == (["id", "note"], [(2, "1", "a\nb")])
    assert landed("g.csv", b'id,note\n1,"open\n2,x\n') == (["id", "note"], [(2, "1", "open\n2,x")])
    with pytest.raises(ValueError, match="no JSON"):
        landed("h.json", b"5")
