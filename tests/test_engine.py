"""The message engine on small fixed inputs: syntax, trees, mapping language, validation, writing, outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from tradewire.functions import syntax, text, transforms
from tradewire.functions.extensions import Extension, ExtensionError, Registry
from tradewire.functions.transforms import Value
from tradewire.operators import envelope, outcome, validate, wire
from tradewire.plans import compiler, diagnostics, dsl, schema
from tradewire.sources import edifact, tables, tabular, trees

ORDER = "UNH+M1+ORDERS:D:96A:UN:EAN008'BGM+220+PO-1+9'DTM+137:20240230:102'NAD+BY+B1::9'NAD+SU+S1'LIN+1++111:EN'QTY+21:2'QTY+59:5'PRI+AAA:1.5'LIN+2++222:EN'QTY+21:3'UNS+S'MOA+86:9.00'UNT+14+M1'"


def texts(spark, *items):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(items)], "source string, text string")


def parsed(spark, *items):
    return edifact.grouped(edifact.messages(texts(spark, *items)))


def segments(spark, *items):
    return [[(s["tag"], [e["v"] if e["c"] is None else list(e["c"]) for e in s["el"]]) for s in r["segs"]] for r in edifact.tokenized(texts(spark, *items)).orderBy("source").collect()]


def test_tokens(spark):
    (got,) = segments(spark, "AAA+a+b:c+'\r\n BBB'CCC+'DDD++x?+y?:z??'EEE+:::W+e?''FFF+1")
    assert got == [("AAA", ["a", ["b", "c"], ""]), ("BBB", []), ("CCC", []), ("DDD", ["", "x+y:z?"]), ("EEE", ["", ["", "", "", "W"], "e'"]), ("FFF", ["1"])]


def test_custom_separators(spark):
    (got,) = segments(spark, "UNA|^.\\ ~\nUNH^1^A|B~BGM^x\\^y+:'~")
    assert got == [("UNH", ["1", ["A", "B"]]), ("BGM", ["x^y+:'"])]


@pytest.mark.parametrize("bad", ["AB+1'", "abc+1'", "BGMX+1'", "BGM-1'", "BGM+1''UNT+1'"])
def test_parse_errors(spark, bad):
    assert edifact.failures(texts(spark, "UNH+1'" + bad)).count() == 1
    assert edifact.messages(texts(spark, "UNH+1'" + bad)).count() == 0


def test_empty_texts(spark):
    assert edifact.messages(texts(spark, "", " \n", None, "UNA:+.? '")).count() == 0


def test_messages(spark):
    one = "UNB+UNOA:3+A+B+240101:1200+9'UNH+1+ORDERS:D'BGM+1'UNT+3+1'UNH+2+INVOIC'UNT+2+2'UNZ+2+9'XXX+1'UNH+3+DESADV:D:96A'BGM+3'"
    rows = edifact.messages(texts(spark, one)).orderBy("msg_idx").collect()
    assert [(r["message_ref"], r["doc_type"], r["version"], r["partial"], len(r["segs"])) for r in rows] == [("1", "ORDERS", "D", False, 3), ("2", None, None, False, 2), ("3", "DESADV", "D_96A", True, 2)]
    assert edifact.warnings(edifact.messages(texts(spark, one))).count() == 1
    assert edifact.messages(texts(spark, "BGM+1'UNT+1+1'")).count() == 0
    with pytest.raises(Exception, match="more than one"):
        edifact.single(edifact.messages(texts(spark, one))).collect()


def test_line_items(spark):
    r = parsed(spark, ORDER, ORDER.replace("ORDERS", "INVOIC")).orderBy("source").collect()
    assert [[s["tag"] for s in g] for g in r[0]["items"]] == [["LIN", "QTY", "QTY", "PRI"], ["LIN", "QTY"]]
    assert [s["tag"] for s in r[0]["root"]] == ["UNH", "BGM", "DTM", "NAD", "NAD", "UNS", "MOA", "UNT"]
    assert r[1]["items"] == [] and len(r[1]["root"]) == 14


def test_positions(spark):
    got = [tuple(r)[1:] for r in edifact.positions(texts(spark, "UNH+1'\r\nBGM+2'\nUNT'")).orderBy("seg_idx").collect()]
    assert got == [(0, "UNH", 3, 1, 4), (1, "BGM", 11, 2, 4), (2, "UNT", 18, 3, 4)]


def mapping(*rules, lookups=None):
    return dsl.parse({"name": "m", "source_type": "EDI", "target_type": "JSON", "rules": list(rules), "lookups": {k: {"name": k, "entries": v} for k, v in (lookups or {}).items()}})


def field(source, target="x", transform=None):
    return {"type": "field", "source": source, "target": target, **({"transform": transform} if transform else {})}


def value(spark, path, **options):
    return compiler.transform(parsed(spark, ORDER), mapping(field(path)), **options).first()["x"]


@pytest.mark.parametrize(("path", "want"), [
    ("/BGM/e2", "PO-1"), ("BGM/e2", "PO-1"), ("/DTM/e1", None), ("/DTM/e1/c2", "20240230"), ("/NAD/e1", "BY"), ("/NAD[3035='SU']/e2", "S1"), ("/NAD['SU']/e2", "S1"), ("/NAD[='SU']/e2", "S1"), ("/NAD[e2='S1']/e1", "SU"),
    ("/NAD[9999='SU']/e2", None), ("/NAD[]/e2", None), ("/NAD[*]/e1", None), ("/LINE_ITEM/QTY[c2='5']/e1/c1", "59"), ("/QTY/e1/c2", None), ("/LINE_ITEM/LIN/e3/c1", "111"), ("/NOPE/e1", None), ("/UNH/e2/c9", None), ("/BGM/e9", None),
])
def test_paths(spark, path, want):
    assert value(spark, path) == want


def test_extended_dialect(spark):
    assert value(spark, "/NAD[*]/e1", extended=True) == "BY"


def test_yaml_and_round_trip():
    m = dsl.parse("name: a\nsource_type: s\ntarget_type: CSV\nrules:\n  - {type: field, source: /BGM/e1, target: t}\n")
    assert dsl.parse(dsl.as_dict(m)) == m
    for bad in ("name: a", "- 1", "name: a\nsource_type: s\ntarget_type: t\nrules: [{type: nope}]", "name: a\nsource_type: s\ntarget_type: t\nrules: [{type: field, source: x}]", "a: ["):
        with pytest.raises(dsl.MappingError):
            dsl.parse(bad)


def test_foreach_forms(spark):
    loop = {"type": "foreach", "source": "/LINE_ITEM", "target": "lines", "rules": [field("LIN/e1", "n"), field("/BGM/e2", "order"), {"type": "foreach", "source": "QTY", "target": "q", "rules": [field("e1/c2", "v")]}]}
    nested = compiler.transform(parsed(spark, ORDER), mapping(loop)).first()
    assert [(x["n"], x["order"], [y["v"] for y in x["q"]]) for x in nested["lines"]] == [("1", "PO-1", ["2", "5"]), ("2", "PO-1", ["3"])]
    flat = compiler.rows(parsed(spark, ORDER), mapping(field("/NAD/e2/c1", "buyer"), loop), number="at").orderBy("n").collect()
    assert [(r["at"], r["buyer"], r["n"], r["order"]) for r in flat] == [(0, "B1", "1", "PO-1"), (1, "B1", "2", "PO-1")]


def test_aggregates(spark):
    rules = [{"type": "aggregate", "source": "/LINE_ITEM/QTY[6063='21']/e1/c2", "target": op, "op": op} for op in dsl.AGGREGATES]
    r = compiler.transform(parsed(spark, ORDER), mapping(*rules)).first()
    assert [r[op] for op in dsl.AGGREGATES] == [5.0, 2, 2.0, 3.0, "2", "3", "2,3"] and r["error"] is None
    bad = compiler.transform(parsed(spark, ORDER), mapping({"type": "aggregate", "source": "/NAD/e1", "target": "x", "op": "sum"})).first()
    assert bad["x"] is None and "/NAD/e1" in bad["error"] and "'BY'" in bad["error"]
    null = compiler.transform(parsed(spark, ORDER), mapping({"type": "aggregate", "source": "/NAD", "target": "x", "op": "max"})).first()
    assert null["error"].endswith("found null")


def test_conditions(spark):
    def met(c):
        return compiler.transform(parsed(spark, ORDER), mapping({"type": "condition", "when": c, "then": [field("/BGM/e1")], "else_rules": []})).first()["x"] is not None

    def c(op, **a):
        return {"op": op, **a}

    assert met(c("exists", field="/BGM/e1")) and not met(c("exists", field="/DTM/e1")) and not met(c("exists", field="/LIN/e2"))
    assert met(c("and", conditions=[])) and not met(c("or", conditions=[])) and met(c("not", condition=c("equals", field="/BGM/e1", value="221")))
    for pattern, want in (("^[0-9]+$", True), ("^22$", False), ("22", True), ("^220$", True), ("^ORD[0-9]+$", False)):
        assert met(c("matches", field="/BGM/e1", pattern=pattern)) is want
    d = spark.createDataFrame([("ORD12",), ("ORD",), ("ORD1x",)], "v string").select(*[compiler.matches(F.col("v"), p).alias(str(i)) for i, p in enumerate(("^ORD[0-9]+$", "^ORD[0-9]{2}$", "^ORD[0-9]{3}$"))])
    assert [tuple(r) for r in d.collect()] == [(True, True, False), (False, False, False), (False, False, False)]


def test_lookups(spark):
    look = {"type": "lookup", "table": "t", "key_source": "/BGM/e1", "target": "x"}
    run = lambda rule, tables_=None: compiler.transform(parsed(spark, ORDER), mapping(rule, lookups={"t": {"220": "order"}} if tables_ is None else tables_)).first()
    assert run(look)["x"] == "order" and run(look)["error"] is None
    assert run({**look, "key_source": "/BGM/e3"})["error"] == "lookup key '9' not found in table 't'"
    assert run({**look, "key_source": "/BGM/e3", "default_value": "d"})["x"] == "d"
    assert "not a string" in run({**look, "key_source": "/DTM/e1", "default_value": "d"})["error"]
    assert "not found" in run({**look, "table": "u"})["error"]


def one(spark, v: Value):
    r = spark.range(1).select(v.column.alias("v"), (F.lit(None).cast("string") if v.error is None else v.error).alias("e")).first()
    return r["v"], r["e"]


def lit(x):
    return Value(F.lit(x).cast("string"))


@pytest.mark.parametrize(("number", "decimals", "sep", "want"), [("1234567", 0, None, "1234567"), ("1234.5678", 2, None, "1234.57"), ("9876.543", 2, ".", "9.876.54"), ("0", 2, ",", "0"), ("-1234.56", 2, ",", "-1,234.56"), ("99.999", 2, None, "100.00"), ("1e3", 1, None, "1000.0"), ("2.675", 2, None, "2.67")])
def test_number_format(spark, number, decimals, sep, want):
    assert one(spark, transforms.number_format(lit(number), decimals, sep)) == (want, None)


def test_transforms(spark):
    assert one(spark, transforms.number_format(lit("x"), 1))[1] is not None and one(spark, transforms.number_format(lit(" 1"), 1))[1] is not None
    assert one(spark, transforms.date_format(lit("20240230"), "YYYYMMDD", "ISO8601")) == ("2024-02-30", None)
    assert one(spark, transforms.date_format(lit("2024-2-3"), "YYYY-MM-DD", "DDMMYYYY")) == ("03022024", None)
    assert one(spark, transforms.date_format(lit("x"), "YYYYMMDD", "ISO8601"))[1] is not None and one(spark, transforms.date_format(lit(None), "YYYYMMDD", "ISO8601")) == (None, None)
    assert one(spark, transforms.split_at(lit("a||b"), "|", 2)) == ("b", None) and one(spark, transforms.split_at(lit("a"), "|", 1))[1] is not None
    assert one(spark, transforms.default(lit(""), "d"))[0] == "d" and one(spark, transforms.default(lit(None), "d"))[0] == "d"
    assert one(spark, transforms.trimmed(lit("  \t a b\n")))[0] == "a b"
    chain = {"op": "chain", "transforms": [{"op": "trim"}, {"op": "uppercase"}, {"op": "conditional", "when": {"op": "contains", "field": "", "value": "A"}, "then": {"op": "lowercase"}}]}
    assert one(spark, transforms.apply(lit(" ab "), chain))[0] == "ab"


def test_double_text(spark):
    rows = spark.createDataFrame([(9.0,), (1e16,), (0.1,), (-2.5,), (1e-7,)], "d double").select(text.double_text(F.col("d"))).collect()
    assert [r[0] for r in rows] == ["9", "10000000000000000", "0.1", "-2.5", "0.0000001"]


def test_extensions(spark):
    r, log = Registry(), []
    r.register(Extension("own", "1", {"f": lambda a: a[0]}, lambda: log.append("in"), lambda: log.append("out")))
    assert one(spark, r.call("string_utils", "substring", [lit("éab"), lit("2"), lit("4")]))[0] == "ab"
    assert one(spark, r.call("string_utils", "substring", [lit("ab"), lit("1"), lit("9")]))[1] == "substring out of bounds"
    assert one(spark, r.call("math_utils", "add", [lit("1"), lit("2.5")]))[0] == 3.5
    for name, f in (("nope", "f"), ("string_utils", "nope")):
        with pytest.raises(ExtensionError):
            r.call(name, f, [])
    r.cleanup_all()
    assert log == ["in", "out"] and r.names() == []


def test_schema_inheritance():
    base = schema.from_string('{"name": "B", "version": "1", "segments": [{"tag": "BGM", "is_mandatory": true, "max_repetitions": 2, "elements": [{"id": "e1"}, {"id": "e2"}]}, {"tag": "UNT"}]}', "json")
    child = schema.from_string("name: C\nversion: '1'\nparent: {name: B, version: '1'}\nsegments:\n  - {tag: BGM, elements: [{id: e2, max_length: 3}]}\n")
    loader = schema.Loader().add(base, child)
    merged = loader.load_merged("C", "1")
    assert [s.tag for s in merged.segments] == ["BGM", "UNT"] and [e.id for e in merged.segments[0].elements] == ["e2", "e1"] and merged.segments[0].is_mandatory and merged.segments[0].max_repetitions == 2
    assert loader.load("C", "1") == child
    with pytest.raises(schema.SchemaError, match="cycle"):
        schema.Loader().add(schema.Schema("A", "1", (), ("B", "1")), schema.Schema("B", "1", (), ("A", "1"))).load_merged("A", "1")
    with pytest.raises(schema.SchemaError, match="missing parent"):
        schema.Loader().add(child).load_merged("C", "1")
    assert schema.version_of("2.10") == (2, 10) and schema.version_of("3") == (3, 0)
    packs = schema.Packs()
    packs.install(schema.Schema("ORDERS", "D96A", (schema.Segment("BGM"), schema.Segment("BGM"))))
    assert packs.choose("orders", "D_96A").name == "ORDERS" and packs.choose("INVOIC", None) is None and packs.doctor() == ["ORDERS: D96A: a tag twice"]


E = schema.Element
SCHEMA = schema.Schema("ORDERS", "D96A", (schema.Segment("UNH", (E("e1", is_mandatory=True), E("e2")), True), schema.Segment("BGM", (E("e1", data_type="n", max_length=2), E("e2"), E("e3"), E("e4", is_mandatory=True)), True), schema.Segment("LIN", (E("e1"), E("e2"), E("e3")), True), schema.Segment("QTY", (E("e1"),), True), schema.Segment("PRI", (E("e1"),), True), schema.Segment("UNS", (E("e1"),)), schema.Segment("ZZZ", (), True)))


def test_validation_order_and_codes(spark):
    rows = validate.issues(parsed(spark, ORDER), SCHEMA).orderBy("no").collect()
    got = [(r["code"], r["path"], r["severity"]) for r in rows if r["code"] != "UNKNOWN_SEGMENT"]
    assert got == [("MAX_LENGTH_VIOLATION", "BGM[1]/e1", "error"), ("MISSING_MANDATORY_ELEMENT", "BGM[1]/e4", "error"), ("MISSING_MANDATORY_SEGMENT", "LINE_ITEM[1]", "error"), ("MISSING_MANDATORY_SEGMENT", "", "error")]
    assert sum(r["code"] == "UNKNOWN_SEGMENT" for r in rows) == 5
    assert validate.issues(parsed(spark, ORDER), SCHEMA, validate.Config(max_errors=2)).filter("severity = 'error'").count() == 2
    assert validate.issues(parsed(spark, ORDER), SCHEMA, validate.Config(continue_on_error=False)).filter("severity = 'error'").count() == 1
    assert validate.issues(parsed(spark, ORDER), SCHEMA, validate.Config("lenient")).filter("severity = 'error'").count() == 0
    s = validate.summary(parsed(spark, ORDER), validate.issues(parsed(spark, ORDER), SCHEMA)).first()
    assert (s["errors"], s["warnings"], s["is_valid"]) == (4, 5, False)


def test_type_rules(spark):
    values = ["", "abÄ", "12", "20240101", "1200", "120000", "12a"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(*[validate.type_holds(F.col("v"), t).alias(t) for t in ("a", "n", "dt", "tm", "an")])
    assert [tuple(r) for r in df.collect()] == [(True, True, False, False, True), (True, False, False, False, True), (False, True, False, False, True), (False, True, True, False, True), (False, True, False, True, True), (False, True, False, True, True), (False, False, False, False, True)]


def test_constraints(spark):
    df = spark.createDataFrame([(None,), ("",), ("ab",), ("abcd",)], "v string")
    got = [[r[0] for r in df.select(c.holds(F.col("v"))).collect()] for c in (schema.Constraint("required", "p"), schema.Constraint("length", "p", 1, 3), schema.Constraint("pattern", "p", pattern="^a"), schema.Constraint("code_list", "p", codes=("ab",)))]
    assert got == [[False, True, True, True], [True, False, True, False], [True, False, True, True], [True, False, True, False]]
    a, b = schema.Constraint("length", "p", 1), schema.Constraint("length", "p", 2)
    assert schema.merge_constraints([a, schema.Constraint("required", "q")], [b]) == [schema.Constraint("required", "q"), b]


def test_envelopes(spark):
    base = "UNB+UNOA:3+A+B+240101:1200+9'UNH+1+ORDERS:D:96A:UN'BGM+1'UNT+3+1'UNZ+1+9'"
    cases = {base: None, base.replace("UNZ+1+9'", ""): "MissingTrailer", base.replace("UNZ+1+9", "UNZ+1+8"): "MismatchedControlReference", base.replace("UNZ+1", "UNZ+2"): "IncorrectMessageCount", base.replace("UNOA", "UNOZ"): "InvalidSyntaxIdentifier", base.replace("UNOA:3", "UNOA:5"): "InvalidSyntaxIdentifier", base[base.index("UNH") :]: "MissingHeader"}
    got = [r["error"] for r in envelope.check_interchanges(edifact.tokenized(texts(spark, *cases))).orderBy("source").collect()]
    assert got == list(cases.values())
    cases = {base: None, base.replace("UNT+3+1", "UNT+3+2"): "MismatchedControlReference", base.replace("UNT+3", "UNT+4"): "IncorrectSegmentCount", base.replace("ORDERS", "NOTONE"): "InvalidMessageType", base.replace("96A:UN", "96A:XX"): "InvalidMessageType"}
    got = [r["error"] for r in envelope.check_messages(edifact.messages(texts(spark, *cases))).orderBy("source").collect()]
    assert got == list(cases.values())


def test_writing(spark):
    r = parsed(spark, ORDER).select(wire.message_text(F.col("segs"), between="")).first()[0]
    assert r == ORDER
    trailing = edifact.messages(texts(spark, "UNH+1+A:B'IMD+F++?+x:?'y+'UNT+3+1'")).select(wire.message_text(F.col("segs"))).first()[0]
    assert trailing == "UNH+1+A:B'\nIMD+F++?+x:?'y'\nUNT+3+1'"
    plans = wire.planned(["BGM.e1", "BGM.e2", "LIN.e1", "LIN.e1", "QTY21.e1", "NAD_BY.e2", "skip_me"])
    assert [(p.tag, sorted(map(str, p.slots))) for p in plans] == [("BGM", ["(1, None)", "(2, None)"]), ("LIN", ["(1, None)"]), ("LIN", ["(1, None)"]), ("QTY", ["(1, 2)"]), ("NAD", ["(2, None)"])]
    with pytest.raises(wire.WireError):
        wire.planned(["NAD_BY.e1"])
    with pytest.raises(wire.WireError):
        wire.planned(["name"])
    row = spark.createDataFrame([("220", None, "10", None)], "`BGM.e1` string, `BGM.e3` string, `QTY21.e1` string, `RFF.e1` string")
    assert wire.mapped_text(row, row.columns).first()["wire"] == "BGM+220'\nQTY+21:10'"
    assert [wire.target_format(t) for t in ("JSON_ORDERS", "CSV", "EANCOM_D96A")] == ["json", "csv", "edifact"] and wire.input_format(None, "a/b.csv", "JSON") == "csv"


def test_csv(spark):
    df = spark.createDataFrame([('1,"a,""b""",x',), ("2,,",), ("",)], "line string")
    assert [r[0] for r in tabular.cells(df).select("cells").collect()] == [["1", 'a,"b"', "x"], ["2", "", ""], [""]]
    got = spark.createDataFrame([("7",), ("1.5",), ("Yes",), ("x",), ("NULL",), ("nan",)], "c string").select(tabular.inferred(F.col("c")).alias("v")).select("v.kind").collect()
    assert [r[0] for r in got] == ["integer", "decimal", "boolean", "string", "null", "decimal"]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,NULL\n2,\"x\ny\"\n")
    df = tabular.read(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "NULL"), ("2", "x\ny")]
    assert tabular.read(spark, str(tmp_path / "a.csv"), tabular.Options(header=False)).columns == ["col_0", "col_1"]
    tabular.write(df, str(tmp_path / "out"))
    assert tabular.read(spark, str(tmp_path / "out")).count() == 2


def test_json_trees(spark):
    data = {"a": 1, "b": [{"c": None}, 2.0, True], "d": 12345678901234567890, "e": 1e20}
    df = spark.createDataFrame([(1, json.dumps(data)), (2, "[1]"), (3, "{"), (4, None), (5, "3")], "doc_id long, text string")
    rows = trees.json_nodes(df).orderBy("doc_id", "node_id").collect()
    got = [(r["path"], r["node_type"], r["vtype"], r["value"]) for r in rows if r["doc_id"] == 1]
    assert got == [("/", "Root", None, None), ("/a", "Field", "integer", "1"), ("/b", "SegmentGroup", None, None), ("/b/item", "Record", None, None), ("/b/item/c", "Field", "null", None), ("/b/item", "Field", "decimal", "2"), ("/b/item", "Field", "boolean", "true"), ("/d", "Field", "string", "12345678901234567890"), ("/e", "Field", "decimal", "100000000000000000000")]
    assert [r["path"] for r in rows if r["doc_id"] == 2] == ["/", "/rows", "/rows/item"] and [r["node_type"] for r in rows if r["doc_id"] == 3] == ["Error"] and [r["path"] for r in rows if r["doc_id"] == 5] == ["/", "/value"]
    assert [r["value"] for r in trees.descend(trees.json_nodes(df), "item", 1).collect()] == ["2"]


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert tables.read(t, {"v": None}).first()["id"] == 2 and tables.read(t, order=["id"], offset=5).count() == 0
    with pytest.raises(tables.TableError):
        tables.update(t, {}, {"v": 1})
    assert sorted(map(tuple, tables.upsert(t, spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), "id").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    d = tables.TableDef('t"x', (tables.ColumnDef("id", "integer", False, True), tables.ColumnDef("v", foreign_key=("o", "k"))))
    assert d.create_sql() == 'CREATE TABLE IF NOT EXISTS "t""x" ("id" INTEGER PRIMARY KEY, "v" TEXT REFERENCES "o"("k"))'
    with pytest.raises(tables.TableError):
        tables.row_error(t.withColumn("z", F.lit(1)), d)
    path = str(tmp_path / "t")
    tables.commit(t, path)
    tables.commit(tables.insert(spark.read.parquet(path), t), path)
    assert spark.read.parquet(path).count() == 4


def test_outcomes(spark):
    rows = spark.createDataFrame([("a", 0, None, False), ("a", 1, "bad", False), ("a", 2, None, True), ("b", 0, None, False)], "source string, msg_idx int, error string, warned boolean")
    marked = outcome.with_outcome(rows, F.col("error"), F.col("warned"))
    assert [outcome.split(marked, p, by).accepted.count() for p, by in (("accept_all", None), ("quarantine", None), ("fail_all", "source"), ("fail_all", None))] == [4, 3, 1, 0]
    assert outcome.until_first_failure(marked, ["msg_idx"], ["source"]).count() == 3
    assert tuple(outcome.batch_summary(marked).first()) == (4, 2, 1, 1, 75.0) and outcome.batch_summary(marked.limit(0)).first()["success_rate"] == 100.0
    q = outcome.quarantined(marked.filter("outcome <> 'ok'"), F.lit("r"), F.col("error"), F.to_timestamp(F.lit("2024-01-01")))
    assert sorted(r["id"] for r in q.collect()) == ["a", "a-2"]
    assert outcome.cleaned(q, F.to_timestamp(F.lit("2024-01-09"))).count() == 0 and outcome.removed(q, ["a"]).count() == 1
    again = q
    for _ in range(3):
        again = outcome.retried(again, again.limit(0))
    assert outcome.retryable(again).count() == 0 and outcome.quarantine_stats(again).first()["permanent"] == 2


def test_diagnostics(spark):
    m = mapping(field("/BGN/e1"), {"type": "condition", "when": {"op": "exists", "field": "/NAD[]/e1"}, "then": [field("/BGM/e1")], "else_rules": []})
    said = diagnostics.lint(m, SCHEMA)
    assert any("did you mean BGM" in s for s in said) and any("match nothing" in s for s in said)
    assert "if exists /NAD[]/e1" in diagnostics.explain(m)
    issues = diagnostics.collected(validate.issues(parsed(spark, ORDER), SCHEMA))
    assert json.loads(diagnostics.json_report(issues))["counts"]["error"] == 4 and json.loads(diagnostics.sarif_report(issues))["version"] == "2.1.0"
    assert "errors: 4" in diagnostics.text_report(issues) and "<table>" in diagnostics.html_report(issues)


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.edi").write_text(ORDER)
    (tmp_path / "b.txt").write_text("no")
    got = edifact.read(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["text"] == ORDER and edifact.read(spark, str(tmp_path), largest=10).first()["error"]


def test_only_referenced_segments_are_cut(spark):
    m = mapping({"type": "foreach", "source": "/LINE_ITEM", "target": "l", "rules": [field("QTY[6063='21']/e1/c2"), {"type": "condition", "when": {"op": "exists", "field": "/BGM/e1"}, "then": [field("/MOA/e1/c2", "m")], "else_rules": []}]})
    assert compiler.tags(m) == {"QTY", "BGM", "MOA"}
    one = lambda tags: edifact.grouped(edifact.messages(texts(spark, ORDER), tags=tags))
    cut = one(compiler.tags(m))
    assert {s["tag"] for s in cut.first()["segs"] if s["el"]} == {"UNH", "QTY", "BGM", "MOA"} and cut.first()["message_ref"] == "M1"
    assert compiler.rows(cut, m).collect() == compiler.rows(one(None), m).collect()
