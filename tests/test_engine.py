"""The onboarding engine: ops, compilation, validation, landing, proposals, workspaces."""

import csv
import json
import random
import zipfile
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegate import queries as Q
from tidegate.functions.ops import DATE_LABELS, DUCKDB, OP_ARGS, SPARK, CompileError, TransformOp, date_shape, java_pattern, render
from tidegate.operators import profile as P
from tidegate.operators import propose as M
from tidegate.operators import validate as V
from tidegate.plans import compile as C
from tidegate.plans.spec import FieldMapping, MappingSpec, SpecStore, diff, validate_spec
from tidegate.schema import Constraints, SchemaError, TargetField, TargetSchema, list_schemas, load_schema
from tidegate.sources import readers as R
from tidegate.sources.landing import Workspace, fingerprint
from tidegate.sources.sniff import sniff
from tidegate.sources.workbook import list_sheets

SF = "/root/testdata/sf0.001"


def op(name, **args):
    return TransformOp(name, args)


# Texts and what the ops make of them, which must match.
CASES = [
    (["  a b ", "", None], [op("strip")], ["a b", "", None]),
    (["AbC"], [op("lower")], ["abc"]),
    (["AbC"], [op("upper")], ["ABC"]),
    (["N/A", " n/a ", "x", "", None], [op("null_if", tokens=["N/A", ""])], [None, None, "x", None, None]),
    (["$1,142.00", "0.85 USD", "€ 5", "12 gbp "], [op("strip_currency")], ["1,142.00", "0.85", "5", "12"]),
    (["1,142.00", "5"], [op("parse_decimal")], ["1142.00", "5"]),
    (["1.142,00", "1142.00"], [op("parse_decimal", locale="eu")], ["1142.00", "114200"]),
    (["5%", "7 % ", "8"], [op("parse_percent")], ["5", "7", "8"]),
    (["03/08/2024", "3/8/2024", "13/45/2024", "x"], [op("parse_date", format="%m/%d/%Y")], ["2024-03-08", "2024-03-08", None, None]),
    (["08-Mar-2024"], [op("parse_date", format="%d-%b-%Y")], ["2024-03-08"]),
    (["a", "b", None], [op("map_values", mapping={"a": "1"})], ["1", "b", None]),
    (["a", "b", None], [op("map_values", mapping={"a": "it's"}, default="\\0")], ["it's", "\\0", "\\0"]),
    (["ab-12", "none"], [op("regex_extract", pattern=r"(\d+)")], ["12", None]),
    ([None, "x"], [op("default", value="0")], ["0", "x"]),
]


@pytest.mark.parametrize("values, ops, wanted", CASES, ids=lambda x: x[0].op if isinstance(x[0], TransformOp) else "")
def test_ops_agree_in_both_dialects(spark, values, ops, wanted):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in frame.orderBy("i").select(F.expr(render("`v`", ops, "string"))).collect()] == wanted
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    assert [r[0] for r in con.execute(f"SELECT {render(DUCKDB.name_of('v'), ops, 'string', DUCKDB)} FROM t ORDER BY i").fetchall()] == wanted


def test_every_op_is_in_the_cases():
    assert {o.op for _, ops, _ in CASES for o in ops} | {"cast"} == set(OP_ARGS)


@pytest.mark.parametrize(
    "dtype, values, wanted",
    [
        ("integer", ["12", " +7 ", "12.5", "1e3", "1_000", "", None, "99999999999999999999"], [12, 7, None, None, None, None, None, None]),
        ("decimal", ["12.5", "1e3", "1d", "2.5f", "x", " 3 "], [12.5, 1000.0, None, None, None, 3.0]),
        ("boolean", ["yes", "N", "T", "0", "on"], [True, False, True, False, None]),
        ("date", ["2024-03-08", "2024", "2024/03/08", "2024-02-30"], [date(2024, 3, 8), None, None, None]),
        ("datetime", ["2024-03-08 09:14:00", "2024-03-08"], [datetime(2024, 3, 8, 9, 14), None]),
    ],
)
def test_casts_give_null_for_what_does_not_parse(spark, dtype, values, wanted):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in frame.orderBy("i").select(F.expr(SPARK.cast("v", dtype))).collect()] == wanted


def test_faulty_ops_and_specs_are_refused():
    for bad in (("nope", {}), ("null_if", {}), ("strip", {"x": 1}), ("parse_decimal", {"locale": "fr"}), ("map_values", {"mapping": []})):
        with pytest.raises(ValueError):
            TransformOp(*bad)
    with pytest.raises(CompileError):
        java_pattern("%Q")
    with pytest.raises(CompileError):
        render("v", [op("regex_extract", pattern="(")], "string")
    schema = TargetSchema.of({"name": "s", "version": 1, "fields": [{"name": "a", "dtype": "integer"}]})
    for ops in ((), (op("strip"),), (op("cast", dtype="string"),), (op("cast", dtype="integer"), op("strip"))):
        with pytest.raises(CompileError):
            validate_spec(MappingSpec("x", "s", 1, (FieldMapping("a", "A", None, ops),)), schema)
    with pytest.raises(ValueError):
        FieldMapping("a", "A", "literal")
    assert "map values (mapping a to b)" == op("map_values", mapping={"a": "b"}).describe() and all(o.describe() for _, ops, _ in CASES for o in ops)


def test_schema_rules():
    assert load_schema("orders").slug == "orders_v1" == load_schema("orders_v1").slug and len(load_schema("orders").fields) == 13
    assert [s.slug for s in list_schemas()] == ["orders_v1"]
    with pytest.raises(KeyError):
        load_schema("orders", 9)
    for bad in ({"dtype": "string", "constraints": {"min": 1}}, {"dtype": "integer", "constraints": {"pattern": "x"}}, {"dtype": "string", "constraints": {"pattern": "("}}, {"dtype": "integer", "constraints": {"min": 2, "max": 1}}, {"dtype": "string", "constraints": {"enum": []}}, {"dtype": "text"}, {"dtype": "string", "extra": 1}):
        with pytest.raises(SchemaError):
            TargetField.of({"name": "a"} | bad)
    with pytest.raises(SchemaError):
        TargetSchema.of({"name": "s", "version": 1, "primary_key": ["a"], "fields": [{"name": "a", "dtype": "string"}]})


# The seed, the bad cells, the column names and the counts of the surveyed messy file, which results must match.
MESSY_SEED = 20240315
MESSY_BAD_CELLS = ((7, 9, "13/45/2024"), (25, 9, "soon"), (11, 5, "-4"), (14, 2, ""), (18, 6, "free"), (22, 8, "140%"))
MESSY_COLUMNS = ["Ord #", "Ln", "Cust", "Item SKU", "Description", "Qty", "Price Each", "Curr", "Disc %", "Ordered On", "Shipped", "X7"]
MESSY_FIELDS = ["order_id", "line_number", "customer_id", "sku", "product_name", "quantity", "unit_price", "currency", "discount_pct", "order_date", "ship_date", "status"]
MESSY_COUNTS = {"rows_in": 30, "valid": 24, "rejected": 6, "problems": 6}


def write_messy(path):
    """30 rows as customers send them: code page 1252, a preamble, money, percents, US dates, and six bad cells."""
    rng = random.Random(MESSY_SEED)
    statuses = ["pending", "Shipped", "DELIVERED", "cancelled", "Returned"]
    rows = []
    for i in range(30):
        row = [f"ORD-{101 + i:06d}", "1", f"CUST-{4000 + i}", f"SKU-{1000 + i}", "Dübel 12mm", str(rng.randrange(1, 50)), f"${rng.randrange(1, 3000):,}.50", "USD", f"{rng.randrange(0, 20)}%", f"{rng.randrange(1, 13):02d}/{rng.randrange(13, 28)}/2024", "N/A" if i % 3 else f"{rng.randrange(1, 13):02d}/20/2024", statuses[i % 5]]
        rows.append(row)
    for at, column, value in MESSY_BAD_CELLS:
        rows[at][column] = value
    head = MESSY_COLUMNS
    text = "Export\nKunde: Müller\n\nStand: heute\n" + "\n".join(";".join(r) for r in [head, *rows]) + "\n"
    path.write_bytes(text.encode("cp1252"))


def test_messy_csv_end_to_end(spark, tmp_path):
    write_messy(tmp_path / "orders_messy.csv")
    ws, schema = Workspace(spark, str(tmp_path / "ws")), load_schema("orders")
    sid = ws.register(str(tmp_path / "orders_messy.csv"))
    assert json.loads(ws.source(sid)["detail"])["encoding"] == "cp1252" and ws.source(sid)["row_count"] == 30
    frame = ws.frame(sid)
    assert [r[0] for r in frame.orderBy("_src_row").select("_src_row").collect()] == list(range(6, 36)) and frame.first()["Description"] == "Dübel 12mm"
    spec = ws.save_spec(M.propose(ws.profiles(sid), schema, sid))
    assert {m.source_column: m.target_field for m in spec.mappings if m.is_mapped} == dict(zip(MESSY_COLUMNS, MESSY_FIELDS))
    run_id, report = ws.run(sid, schema)
    assert report.counts() == MESSY_COUNTS
    assert report.summary() == "24 of 30 rows passed. 6 rows were rejected for 6 problems."
    assert [(r.line, r.field) for r in report.ordered_problems.collect()] == [(13, "order_date"), (17, "quantity"), (20, "customer_id"), (24, "unit_price"), (28, "discount_pct"), (31, "order_date")]
    clauses = [r.clause for r in report.ordered_problems.collect()]
    assert clauses[0] == '"Ordered On" is "13/45/2024", which is not a valid date in the format MM/DD/YYYY.'
    assert clauses[1] == '"Qty" is "-4", but quantity must be at least 1.' and clauses[2] == '"Cust" is empty, but customer id is required.'
    assert clauses[3] == '"Price Each" is "free", which is not a number.' and clauses[4] == '"Disc %" is "140%", but discount pct must be at most 100.'
    files = report.write_files(tmp_path / "out", "r", run_id)
    with open(files["rejections"], encoding="utf-8-sig", newline="") as f:
        assert next(csv.reader(f)) == ["line", "column", "value", "problem"]
    assert files["rejections"].read_bytes().startswith(b"\xef\xbb\xbf") and json.loads(files["report"].read_text())["rejected"] == 6
    run = ws.run_of(run_id)
    assert run["rows_valid"] == 24 and run["report"]["n_groups"] == 6 and f"v1_{spec.content_hash()}.sql" in run["report"]["artifacts"]["sql"]
    assert spark.read.text(run["report"]["artifacts"]["py"]).count() > 10
    with pytest.raises(KeyError):
        ws.run_of("none")
    assert ws.runs(sid).count() == 1 and ws.save_spec(spec).version == 1 and ws.head_spec(sid).content_hash() == spec.content_hash()
    assert ws.preview(sid, 3).count() == 3 and len(fingerprint(spark, str(tmp_path / "orders_messy.csv"))) == 16
    con = duckdb.connect()
    script = C.compile_script(spec, schema, f"{ws.landed_path(sid)}/*.parquet", DUCKDB)
    typed = {tuple(r) for r in C.transform(frame, spec, schema).collect()}
    assert {tuple(r) for r in con.execute(script).fetchall()} == typed
    scope = {}
    exec(C.render_module(spec, schema), scope)
    assert {tuple(r) for r in scope["transform"](frame).collect()} == typed
    assert {tuple(r) for r in spark.sql(C.compile_script(spec, schema, ws.landed_path(sid)).split("\n", 1)[1].rstrip().rstrip(";")).collect()} == typed


def test_nested_json(spark, tmp_path):
    rows = [{"orderId": f"ORD-{i:06d}", "customer": {"id": f"CUST-{i:04d}", "name": "Kestrel"}, "price": {"amount": 38.5}, "tags": ["a", "b"], "state": "SHIPPED", **({"quantity": i} if i % 2 else {"qty": i})} for i in range(1, 21)]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    landed = R.land(spark, str(tmp_path / "o.jsonl")).frame
    assert landed.columns == ["_src_row", "orderId", "customer.id", "customer.name", "price.amount", "tags", "state", "quantity", "qty"]
    first = landed.orderBy("_src_row").first()
    assert (first["_src_row"], first["price.amount"], first["tags"], first["qty"]) == (1, "38.5", '["a","b"]', None)
    (tmp_path / "o.json").write_text(json.dumps({"meta": [1], "rows": rows}))
    whole = R.land(spark, str(tmp_path / "o.json")).frame
    assert whole.count() == 20 and whole.columns == landed.columns
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, landed.collect()))


def test_quoted_line_breaks_in_cells(spark, tmp_path):
    rows = [(str(i), f"first\nsecond, {i}" if i % 1000 == 999 else f'say ""{i}""' if i % 7 == 0 else f"plain {i}", "x") for i in range(5000)]
    text = "id,note,mark\n" + "".join(f'{a},"{b}",{c}\n' for a, b, c in rows)
    (tmp_path / "breaks.csv").write_text(text)
    landed = R.land(spark, str(tmp_path / "breaks.csv")).frame.orderBy("_src_row").collect()
    assert [tuple(r) for r in landed] == [(i + 2, a, b.replace('""', '"'), c) for i, (a, b, c) in enumerate(rows)]
    (tmp_path / "plain.csv").write_text('id;note\n1;"a; ""b"""\n2;c\n3; "d" \n')
    assert not R.has_odd_quotes(spark, str(tmp_path / "plain.csv"), ";")
    assert R.has_odd_quotes(spark, str(tmp_path / "breaks.csv"), ",")


def test_json_lists_beyond_the_head(spark, tmp_path):
    """The longest list holds the records, however large the file is."""
    rows = [{"z": f"{i}" * 40, "a": {"k": i}} for i in range(5000)]
    for name, whole in (("late", {"meta": [{"q": "x" * 200_000}], "rows": rows}), ("early", {"rows": rows, "meta": [1, 2]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole))
        landed = R.land(spark, str(tmp_path / f"{name}.json")).frame
        assert landed.count() == 5000 and sorted(landed.columns) == ["_src_row", "a.k", "z"]
        assert landed.filter("_src_row = 4322").first()["a.k"] == "4321"
    assert landed.columns == ["_src_row", "z", "a.k"]
    (tmp_path / "equal.json").write_text(json.dumps({"z": [{"v": 1}], "a": [{"w": 2}], "pad": "x" * 200_000}))
    assert R.land(spark, str(tmp_path / "equal.json")).frame.columns == ["_src_row", "v"]
    (tmp_path / "list.json").write_text(json.dumps([{"z": 1, "a": ["x"] * 3}]))
    assert [tuple(r) for r in R.land(spark, str(tmp_path / "list.json")).frame.collect()] == [(1, "1", '["x","x","x"]')]


def sheet_xml(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows, 1) if any(r))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def test_excel_with_merged_header(spark, tmp_path):
    body = [[f"BST-{i:06d}", str(i), "ART-1"] for i in range(1, 6)]
    sheets = {"Deckblatt": [["Titel"]], "Bestellungen": [["Bestellung", "", "Artikel"], ["Bestellnr", "Pos", "Artikelnr"], *body[:3], ["", "", ""], *body[3:]]}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, 3)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", sheet_xml(rows))
    landed = R.land(spark, str(tmp_path / "b.xlsx"))
    assert landed.frame.columns == ["_src_row", "Bestellung_Bestellnr", "Bestellung_Pos", "Artikel_Artikelnr"] and landed.detail["sheet"] == "Bestellungen"
    assert [tuple(r)[:2] for r in landed.frame.orderBy("_src_row").collect()] == [(3, "BST-000001"), (4, "BST-000002"), (5, "BST-000003"), (7, "BST-000004"), (8, "BST-000005")]
    assert [r.sheet for r in list_sheets(spark, str(tmp_path / "b.xlsx")).orderBy("place").collect()] == list(sheets)


def test_csv_details(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,name,name\n1,"say ""hi"", ok",x,extra\n2,,\n3\n', "utf-8-sig")
    landed = R.land(spark, str(tmp_path / "q.csv")).frame
    assert [tuple(r) for r in landed.orderBy("_src_row").collect()] == [(2, "1", 'say "hi", ok', "x"), (3, "2", None, None), (4, "3", None, None)]
    assert landed.columns == ["_src_row", "id", "name", "name_1"]
    with pytest.raises(R.UnsupportedFile):
        R.detect_kind("a.pdf")
    assert sniff(b"a|b|c\n1|2|3\n").delimiter == "|" and sniff("ä;b\n1;2\n".encode()).encoding == "utf-8" and sniff(b"").column_count == 0


def test_rows_are_numbered_over_many_partitions(spark, tmp_path):
    n = 20_000
    (tmp_path / "n.csv").write_text("id,word\n" + "".join(f"{i},w{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        frame = R.land(spark, str(tmp_path / "n.csv")).frame
        assert frame.filter("_src_row <> cast(id as long) + 2").isEmpty() and frame.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_masks_and_dates():
    from tidegate.functions.ops import DATE_LABELS

    assert java_pattern("%b %d, %Y") == "MMM d, yyyy" and java_pattern("%Y-%m-%dT%H:%M:%SZ") == "yyyy-M-d'T'H:m:s'Z'" and len(DATE_LABELS) == 12


def test_profile(spark):
    rows = [(i, f"ORD-{i:06d}", f"${i},000.50" if i % 2 else "N/A", "yes" if i % 3 else "no", f"{i % 28 + 1:02d}/0{i % 9 + 1}/2024", ["Open", "OPEN", "closed"][i % 3], "a/b.c" * 20) for i in range(1, 41)]
    found = {r["name"]: r.asDict(recursive=True) for r in P.profile(spark.createDataFrame(rows, "_src_row long, id string, price string, flag string, day string, state string, odd string")).collect()}
    assert found["id"]["patterns"] == [{"pattern": r"[A-Z]{3}-\d{6}", "count": 40, "pct": 1.0}] and found["id"]["semantics"] == ["identifier"]
    assert found["price"]["inferred_type"] == "decimal" and found["price"]["null_count"] == 20 and "currency" in found["price"]["semantics"]
    odd = [i * 1000 + 0.5 for i in range(1, 41, 2)]
    assert found["price"]["numeric"]["mean"] == sum(odd) / 20 and found["price"]["numeric"]["max"] == 39000.5
    assert found["flag"]["inferred_type"] == "boolean" and found["day"]["inferred_type"] == "date" and found["day"]["date_candidates"][0]["format"] == "%d/%m/%Y"
    assert "inconsistent_case" in found["state"]["semantics"] and found["state"]["normalized_distinct_count"] == 2
    assert found["state"]["top_values"][0]["value"] == "OPEN" and found["odd"]["patterns"][0]["pattern"].endswith("...") and r"\/" in found["odd"]["patterns"][0]["pattern"]
    empty = P.profile(spark.createDataFrame([], "_src_row long, a string")).collect()
    assert empty == []


def test_duplicate_messages_and_nulls(spark):
    schema = TargetSchema.of({"name": "k", "version": 1, "primary_key": ["a", "b"], "fields": [{"name": "a", "dtype": "string", "nullable": False}, {"name": "b", "dtype": "integer", "nullable": False}, {"name": "c", "dtype": "string", "constraints": {"unique": True, "max_length": 3}}, {"name": "d", "dtype": "string", "nullable": False}]})
    cast = lambda t: (op("cast", dtype=t),)
    spec = MappingSpec("x", "k", 1, (FieldMapping("a", "A", None, cast("string")), FieldMapping("b", "B", None, cast("integer")), FieldMapping("c", "C", None, cast("string")), FieldMapping("d")))
    rows = [(2, "x", "1", "u"), (5, "x", "1", "u"), (9, "x", "1", None), (11, "y", None, None), (12, "y", None, "long"), (13, "z", "7", "é😀é")]
    report = V.check(spark.createDataFrame(rows, "_src_row long, A string, B string, C string"), spec, schema)
    found = [(r.line, r.kind, r.clause) for r in report.ordered_problems.collect()]
    assert (9, "duplicate_key", "a x with b 1 also appears on lines 2 and 5.") in found and (11, "duplicate_key", "a y with b None also appears on line 12.") in found
    assert (2, "duplicate_value", '"C" is "u", which appears on more than one line, but c must be unique.') in found
    assert (12, "length", '"C" is 4 characters long, but c allows at most 3.') in found and not any(line == 13 and kind == "length" for line, kind, _ in found)
    assert sum(kind == "unmapped" for _, kind, _ in found) == 6 and report.counts()["rejected"] == 6
    assert {r.field: r.n for r in report.field_problems().collect()}["a"] == 5
    with pytest.raises(V.StructuralError):
        V.check_structure(spark.createDataFrame([], "a string"), schema)
    many = spark.createDataFrame([(i, "x", "1", None) for i in range(50)], "_src_row long, A string, B string, C string")
    last = V.check(many, spec, schema).problems.filter("kind = 'duplicate_key' and line = 49").first().clause
    assert last.startswith("a x with b 1 also appears on lines 0, 1, 2") and last.endswith("19 and 29 more.")


def test_specs():
    base = Q.ORDERS_SPEC
    literal = MappingSpec("orders", "sales", 1, tuple(FieldMapping("source_system", None, "other", m.transforms) if m.target_field == "source_system" else m for m in base.mappings))
    assert literal.content_hash() != base.content_hash() and diff(base, literal) == []
    store = SpecStore()
    assert store.save(base).version == 1 and store.save(base).version == 1 and store.save(literal).version == 2
    assert store.head("orders").parent_id == "orders-v1" and [s.version for s in store.history("orders")] == [2, 1] and store.get("orders-v1").version == 1
    assert MappingSpec.from_dict(json.loads(json.dumps(base.to_dict()))).content_hash() == base.content_hash()


def test_voices():
    schema = load_schema("orders")
    profile = {"name": "Menge", "inferred_type": "integer", "semantics": [], "top_values": [{"value": "3"}], "samples": ["3"]}
    assert M.name_score("Artikel_Artikelnr", schema.field("sku"))[2] and M.name_score("ln", schema.field("line_number"))[0] == 0.98
    encode = lambda texts: [[float("quantity" in t or "Menge" in t), 1.0] for t in texts]
    cache = {}
    found = M.embedding([profile], schema, encode, cache)
    assert found["Menge"][0].target_field == "quantity" and len(cache) == 14
    assert M.embedding([profile], schema, None) == {} and M.llm([profile], schema, None) == {}
    with pytest.warns(UserWarning):
        assert M.llm([profile], schema, M.replayed("/nonexistent")) == {}
    answer = lambda asked: {"Menge": [{"field": "quantity", "score": 7}, {"field": "nope", "score": 1}]}
    assert M.llm([profile], schema, answer)["Menge"][0].score == 1.0
    spec = M.propose([profile], schema, "s", encode, answer)
    assert spec.mapping("quantity").source_column == "Menge" and spec.mapping("quantity").confidence == 1.0 and not spec.mapping("sku").is_mapped
    assert [p["available"] for p in M.provider_status()] == [True, False, False]


def test_landing_reads_no_whole_file_and_keeps_all_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidegate.sources.landing.LISTED_GROUPS", 2)
    text = "order_id,quantity\n" + "".join(f"ORD-{i},{-i}\n" for i in range(1, 6))
    for name, said in (("a", text), ("same", text), ("turned", text.replace("ORD-1,-1\nORD-2,-2", "ORD-2,-2\nORD-1,-1")), ("moved", text.replace("ORD-1,-1", ",ORD-1-1"))):
        (tmp_path / f"{name}.csv").write_text(said)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10)
    try:
        ws = Workspace(spark, str(tmp_path / "ws"))
        ids = {name: ws.register(str(tmp_path / f"{name}.csv")) for name in ("a", "same", "turned", "moved")}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    prints = {name: ws.source(sid)["fingerprint"] for name, sid in ids.items()}
    assert prints["a"] == prints["same"] and len(set(prints.values())) == 3
    schema = TargetSchema("orders", 1, (TargetField("quantity", "integer", constraints=Constraints(min=0)),))
    run_id, report = ws.run(ids["a"], schema, MappingSpec(ids["a"], "orders", 1, (FieldMapping("quantity", "quantity", None, (op("cast", dtype="integer"),)),)))
    told = json.loads(ws.runs(ids["a"]).first()["report"])
    assert len(told["groups"]) == 2 and told["n_groups"] == report.groups().count() == 5
    assert spark.read.parquet(f"{tmp_path}/ws/runs/{run_id}/groups").count() == 5


def test_model_calls_are_logged_and_vectors_kept(spark, tmp_path):
    ws, schema = Workspace(spark, str(tmp_path / "ws")), load_schema("orders")
    profiles = [{"name": "Qty", "inferred_type": "integer", "samples": ["1", "2"], "top_values": [], "semantics": []}]
    said = {"Qty": [{"field": "quantity", "score": 0.9, "reason": "a count"}]}
    told = M.llm(profiles, schema, ws.logged(lambda asked: said, "m1", "s1"))
    assert told["Qty"][0].target_field == "quantity" and "a count" in M.evidence_summary(told["Qty"][0])

    def broken(asked):
        raise RuntimeError("no answer")

    with pytest.warns(UserWarning):
        assert M.llm(profiles, schema, ws.logged(broken, "m1")) == {}
    calls = {r.error: r for r in ws.table("llm_calls").collect()}
    assert len(calls) == 2 and json.loads(calls[None].response) == said and "no answer" in calls["RuntimeError('no answer')"].error
    assert calls[None].request_hash == M.request_hash(M.request(profiles, schema)) and all(c.latency_ms >= 0 for c in calls.values())

    def encode(texts):
        return [[float(len(t)), 1.0] for t in texts]

    for _ in range(2):
        assert ws.cached(encode, "e1")(["ab", "abc", "ab"]) == [[2.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
        assert ws.table("embedding_cache").count() == 2
    assert ws.cached(encode, "e2")(["ab"]) == [[2.0, 1.0]] and ws.table("embedding_cache").count() == 3

    def refuses(texts):
        raise RuntimeError("asked again")

    assert ws.cached(refuses, "e1")(["abc", "ab"]) == [[3.0, 1.0], [2.0, 1.0]]
    assert M.embedding(profiles, schema, ws.cached(encode, "e1"))["Qty"]


def test_merge_and_assign(spark):
    def c(field, score, voice):
        return M.Candidate(field, score, (), (M.Evidence(voice, score, "why"),))

    voices = {"heuristic": {"A": [c("x", 0.8, "heuristic"), c("y", 0.5, "heuristic")], "B": [c("x", 0.9, "heuristic")]}, "llm": {"A": [c("y", 1.0, "llm")]}, "embedding": {}}
    merged = M.merge(voices, ["A", "B", "C"])
    weights = M.WEIGHTS["heuristic"] + M.WEIGHTS["llm"]
    assert merged["C"] == [] and [(f.target_field, f.score) for f in merged["A"]] == [("y", round((0.45 * 0.5 + 0.35) / weights + 0.08, 4)), ("x", round(0.45 * 0.8 / weights, 4))]
    assert [e.provider for e in merged["A"][0].provenance] == ["llm", "heuristic"]
    taken = M.assign(merged)
    assert {f: column for f, (column, _) in taken.items()} == {"y": "A", "x": "B"}
    assert M.assign({"P": [M.Candidate("z", 0.5)], "Q": [M.Candidate("z", 0.5)], "R": [M.Candidate("w", 0.1)]})["z"][0] == "P" and M.merge({}, []) == {}


def test_reports_hold_every_group(spark, tmp_path):
    schema = TargetSchema.of({"name": "g", "version": 1, "fields": [{"name": "a", "dtype": "integer", "nullable": False}]})
    spec = MappingSpec("x", "g", 1, (FieldMapping("a", "A", None, (op("cast", dtype="integer"),)),))
    report = V.check(spark.range(1500).selectExpr("id + 2 as _src_row", "concat('v', id) as A"), spec, schema)
    told = json.loads(report.write_files(tmp_path, "many")["report"].read_text())
    assert len(told["groups"]) == 1500 == told["rejected"] and told["groups"][0]["clause"] == '"A" is "v0", which is not a whole number.'


def test_late_json_columns_are_in_order(spark, tmp_path):
    pad = "x" * 3000
    rows = [{"z": pad, "n": {"k": i}, **({"late": 1} if i == 80 else {}), **({"early": 2} if i == 70 else {})} for i in range(100)]
    (tmp_path / "late.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "late.json").write_text(json.dumps({"rows": rows}))
    for name in ("late.jsonl", "late.json"):
        assert R.land(spark, str(tmp_path / name)).frame.columns == ["_src_row", "z", "n.k", "early", "late"]


def test_date_shapes_hold_what_is_read(spark):
    """What a format reads has its shape; what has not is not parsed."""
    texts = ["2024-03-05", "2024-3-5", "+12024-03-05", "3/5/2024", "05/03/2024", "5.3.2024", "2024/03/05", "03-05-2024", "05-mar-2024", "5-Mar-2024", "Mar 5, 2024", "MAR 05, 2024", "2024-03-05T1:2:3Z", "2024-03-05t01:02:03z", "2024-03-05T01:02:03+01:00", "2024-03-05T01:02:03+0100", "2024-03-05T01:02:03", "2024-03-05 01:02:03", "31/02/1997", "soon", "123456", "", "CUST-10001", "1/2/3/4"]
    frame = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    for fmt in DATE_LABELS:
        read, shaped, dated, told = zip(*frame.select(F.try_to_timestamp("v", F.lit(java_pattern(fmt))).isNotNull(), F.col("v").rlike(date_shape(fmt)), P._maybe_date(F.col("v")), P.parses_date(F.col("v"), fmt)).collect())
        assert any(read) and read == told and all(s and d for r, s, d in zip(read, shaped, dated) if r)
        assert not any(s for s, t in zip(shaped, texts) if t in ("soon", "123456", "", "1/2/3/4"))


def test_values_are_read_three_times_and_no_digit_is_lost(spark):
    frame = spark.range(100_000).select(F.col("id").alias("_src_row"), F.col("id").cast("string").alias("n"), F.concat(F.lit("1000000000.5"), (F.col("id") % 3).cast("string")).alias("far"), F.concat((F.col("id") % 7).cast("string"), F.lit(",25")).alias("eu"))
    with P.counted(frame) as values:
        kept = P.profile(frame, values)
        # once for what is summed up, once for folded values and once for the foremost ones
        assert kept._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") <= 3
        found = {r["name"]: r.asDict(recursive=True) for r in kept.collect()}
    assert found["n"]["numeric"] == {"min": 0.0, "max": 99999.0, "mean": 49999.5, "stddev": round(((100_000**2 - 1) / 12) ** 0.5, 6)}
    assert found["far"]["numeric"]["stddev"] == round((2 / 3) ** 0.5 / 100, 6) and found["eu"]["inferred_type"] == "european_decimal" and found["eu"]["numeric"]["max"] == 6.25
    assert found["n"]["patterns"][0] == {"pattern": r"\d{5}", "count": 10_000, "pct": 0.5} and found["n"]["pattern_coverage"] == 0.2


def test_folded_values(spark):
    given = ["a", "A", "b", "ß", "ẞ", "İ", "i̇", "1", "2", "-.5", "Σ", "ς", "σ", None, "n/a"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "_src_row long, v string")
    row = P.counts(P.distinct_values(frame)).first()
    assert (row.distinct_count, row.normalized_distinct_count) == (13, frame.filter("v is not null and v <> 'n/a'").select(F.lower("v")).distinct().count())


def test_groups_name_the_first_member_without_sorting_all_twice(spark):
    frame = spark.createDataFrame([(9, "", "b"), (3, "", "b"), (5, "", "a"), (7, "x", "a")], "_src_row long, A string, B string")
    schema = TargetSchema.of({"name": "g", "version": 1, "fields": [{"name": "a", "dtype": "string", "nullable": False}, {"name": "b", "dtype": "string", "constraints": {"enum": ["a"]}}]})
    spec = MappingSpec("x", "g", 1, (FieldMapping("a", "A", None, (op("null_if", tokens=[""]), op("cast", dtype="string"))), FieldMapping("b", "B", None, (op("cast", dtype="string"),))))
    groups = V.check(frame, spec, schema).groups()
    assert "SortAggregate" not in groups._jdf.queryExecution().executedPlan().toString()
    assert [(r.n, r.first_line, r.lines, r.field, r.column, r.value, r.kind) for r in groups.collect()] == [(3, 3, [3, 5, 9], "a", "A", "", "missing"), (2, 3, [3, 9], "b", "B", "b", "not_allowed")]
