"""Documents, databases, the lasting quarantine, text stages, reports of many issues, unread files."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tradewire import engine
from tradewire.functions import extensions
from tradewire.operators import documents, envelope, outcome, quarantine, validate, wire
from tradewire.plans import compiler, diagnostics
from tradewire.plans import schema as schemas
from tradewire.sources import database, edifact, tables, trees


def nodes(spark, *texts):
    return trees.json_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_tree_records(spark):
    found = nodes(spark, '[{"a": 1, "b": "x,y"}, {"b": null, "c": 2}]', '[{"a": 3}]')
    assert [r["line"] for r in documents.csv(found).orderBy("record", "doc_id").collect()] == ["a,b", '1,"x,y"', "3,", ","]
    assert documents.csv(found, ["c", "a"], header=False, null="-").filter("doc_id = 0").orderBy("record").first()["line"] == "-,1"
    # No single group: the root's children are the records.
    flat = nodes(spark, '{"first": {"v": 1}, "second": {"v": 2}}')
    assert [tuple(r) for r in documents.rows(flat, {"v": "int"}).orderBy("record").collect()] == [(0, 0, 1), (0, 1, 2)]
    with pytest.raises(documents.HeaderError):
        documents.csv(nodes(spark, "{}"))


def test_visitor(spark):
    tree = [r.asDict() for r in nodes(spark, '{"a": [1, 2], "b": {"c": 3}}').collect()]
    seen = []
    assert documents.walk(tree, lambda n: seen.append("+" + n["name"]), lambda n: seen.append("-" + n["name"]))
    assert seen == ["+document", "+a", "+item", "-item", "+item", "-item", "-a", "+b", "+c", "-c", "-b", "-document"]
    few = []
    assert not documents.walk(tree, lambda n: few.append(n["name"]) or n["name"] != "item") and few == ["document", "a", "item"]


def test_nested_xml(spark):
    assert documents.xml(nodes(spark, '{"xml": "<&>", "1a": null}')).first()["xml"] == "<document><document><_xml>&lt;&amp;&gt;</_xml><_a></_a></document></document>"


SHOP = tables.TableDef("shop", (tables.ColumnDef("id", "integer", False, True), tables.ColumnDef("name", "string", False)))


def test_database(spark, tmp_path):
    path = str(tmp_path / "shop.db")
    db = database.Database(lambda: sqlite3.connect(path, timeout=60))
    db.apply(SHOP, SHOP)
    rows = lambda *x: spark.createDataFrame(list(x), "id long, name string").coalesce(1)
    held = lambda: sorted(sqlite3.connect(path).execute("SELECT id, name FROM shop").fetchall())
    db.write(rows(*[(i, f"n{i}") for i in range(7)]), SHOP, batch=3)
    db.write(rows((1, "one"), (99, "none")), SHOP, "update", "id")
    db.write(rows((2, "two"), (8, "eight")), SHOP, "upsert", "id")
    assert held() == [(0, "n0"), (1, "one"), (2, "two"), (3, "n3"), (4, "n4"), (5, "n5"), (6, "n6"), (8, "eight")]
    with pytest.raises(Exception, match="UNIQUE"):  # the chunk of (20, 0) goes, the one before it stays
        db.write(rows((10, "a"), (11, "b"), (20, "c"), (0, "again")), SHOP, batch=2)
    assert [i for i, _ in held() if i >= 10] == [10, 11]
    for bad in (dict(mode="update"), dict(mode="replace"), dict(batch=0)):
        with pytest.raises(tables.TableError):
            db.write(rows((1, "x")), SHOP, **bad)
    waits, tries = [], []

    def fails():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("not yet")
        return "open"

    assert database.Database(fails, retries=3).open(waits.append) == "open" and waits == [0.1, 0.2, 0.4]
    tries.clear()
    with pytest.raises(OSError):
        database.Database(fails, retries=1).open(waits.append)


def test_upsert_keeps_one(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(1, "b", 2), (1, "z", 1), (2, "c", 1), (None, "m", 1), (None, "m", 1)], "id long, v string, at int")
    assert sorted(map(tuple, tables.upsert(t, new, "id", ["at"]).collect()), key=str) == sorted([(1, "b"), (2, "c"), (None, "n"), (None, "m"), (None, "m")], key=str)
    assert (1, "z") in set(map(tuple, tables.upsert(t, new, "id").collect()))


def test_row_check_of_types(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "id string, name string")
    assert [r[0] for r in df.select(tables.row_error(df, SHOP)).collect()] == [None, "id is not integer", "id must not be null"]


def test_quarantine_store(spark, tmp_path):
    store = quarantine.Store(spark, str(tmp_path / "q"), most_retries=2)
    assert store.list().count() == 0
    bad = lambda *x: outcome.quarantined(spark.createDataFrame(list(x), "source string, payload string"), F.lit("parse"), F.col("payload"), F.to_timestamp(F.lit("2024-01-01")))
    store.add(bad(("in/a.edi", "x" * 300), ("in/b.edi", "y")))
    store.add(bad(("in/a.edi", "z")))
    assert [r["id"] for r in store.list().collect()] == ["in-a-edi", "in-a-edi-2", "in-b-edi"]
    assert len(store.show("in-a-edi").first()["snippet"]) == 243
    refuse = lambda e: e.select("id", F.when(F.col("payload") != "y", "no").alias("error"))
    assert store.retry(refuse).count() == 3 and store.entries().count() == 2
    store.retry(refuse, ["in-a-edi"])
    assert {r["id"]: (r["retry_count"], r["permanent"]) for r in store.entries().collect()} == {"in-a-edi": (2, True), "in-a-edi-2": (1, False)}
    assert tuple(store.stats().first()) == (2, 3, 1)
    store.export(str(tmp_path / "out"))
    assert sorted(json.loads(r[0])["id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["in-a-edi", "in-a-edi-2"]
    assert store.clean("2024-01-03") == 0 and store.clean("2024-03-01") == 2 and store.entries().count() == 0


def test_text_stages(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "bad"), (3, None)], "id long, text string")
    out = {r["id"]: (r["mapped"], r["error"]) for r in extensions.mapped_text(df, "text", lambda t: str(json.loads(t)["a"])).collect()}
    assert out[1] == ("1", None) and out[2][1].startswith("JSONDecodeError") and out[3] == (None, None)
    found = {r["id"]: r["issues"] for r in extensions.validated_text(df, "text", lambda t: [] if t.startswith("{") else [("error", "NOT_JSON", t)]).collect()}
    assert not found[1] and found[2][0]["code"] == "NOT_JSON"


def test_reports_count_everything():
    listed = [{"source": "s", "message_ref": "1", "severity": "warning", "code": "W", "path": "p", "message": "m", "snippet": "BGM+1'"}]
    issues = diagnostics.Issues(listed, {("warning", "W"): 10_001, ("error", "E"): 49})
    got = json.loads(diagnostics.json_report(issues))
    assert got["counts"] == {"error": 49, "warning": 10_001, "info": 0} and not got["is_valid"] and got["unlisted"] == 10_049
    assert "errors: 49" in diagnostics.text_report(issues) and "not listed: 10049" in diagnostics.text_report(issues) and "10050 issues" in diagnostics.html_report(issues)
    run = json.loads(diagnostics.sarif_report(issues))["runs"][0]
    assert run["properties"]["unlisted"] == 10_049 and run["results"][0]["locations"][0]["physicalLocation"]["region"]["snippet"]["text"] == "BGM+1'"
    assert diagnostics.console(listed[0]) == "WARNING s message 1: [W] p: m"


def test_collected_lists_errors_first(spark):
    rows = [("s", i, "r", 0, "warning", "W", "", "m") for i in range(30)] + [("t", 0, "r", 0, "error", "E", "", "m")]
    df = spark.createDataFrame(rows, "source string, msg_idx int, message_ref string, no int, severity string, code string, path string, message string")
    issues = diagnostics.collected(df, 5)
    assert issues[0]["code"] == "E" and issues.total == 31 and issues.counts["error"] == 1
    assert diagnostics.of_severity(df, "error").count() == 1


def test_unread_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        engine.Engine(spark).read_edifact(str(tmp_path / "none"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.edi").write_text("UNH+1+ORDERS:D'BGM+1'UNT+3+1'")
    (tmp_path / "in" / "a.edi").write_text("UNH+2+ORDERS:D'UNT+2+2'")
    assert engine.Engine(spark).read_edifact(str(tmp_path / "in")).count() == 2
    assert [r["source"][-5:] for r in edifact.read(spark, str(tmp_path / "in"), ordered=True).select("source").collect()] == ["a.edi", "b.edi"]
    with pytest.raises(ValueError, match="b.edi"):
        edifact.readable(edifact.read(spark, str(tmp_path / "in"), largest=25))


def test_places(spark):
    texts = spark.createDataFrame([("a", "UNA:+.? '\r\nUNH+1'\r\nBGM+x\ny'\rDTM+1'\n\n"), ("b", "UNH+1'\nbad'")], "source string, text string")
    got = [tuple(r)[1:] for r in edifact.positions(texts.filter("source = 'a'")).orderBy("seg_idx").collect()]
    assert got == [(0, "UNH", 14, 2, 4), (1, "BGM", 22, 3, 4), (2, "DTM", 31, 5, 4)]
    assert [tuple(r) for r in edifact.parse_errors(texts).collect()] == [("b", 1, "expected segment tag (3 characters)", 2, 1)]


def test_patterns_end_at_the_end(spark):
    df = spark.createDataFrame([("123",), ("123\n",)], "v string")
    assert [r[0] for r in df.select(compiler.matches(F.col("v"), "^[0-9]+$")).collect()] == [True, False]


def test_written_documents(spark):
    rows = spark.createDataFrame([("A", 2, "BGM+220+x?'y'"), ("A", 1, "BGM+1'DTM+1'"), ("B", 3, "")], "to string, n int, body string")
    lit = F.lit
    out = {r["to"]: (r["messages"], r["text"]) for r in wire.documents(rows, "to", "n", lit("S"), F.col("to"), lit("240101"), lit("1200"), lit("ORDERS")).collect()}
    assert out["A"] == (2, "UNB+UNOA:3+S+A+240101:1200+00000000000001'\nUNH+000001+ORDERS:D:96A:UN'\nBGM+1'DTM+1'\nUNT+4+000001'\nUNH+000002+ORDERS:D:96A:UN'\nBGM+220+x?'y'\nUNT+3+000002'\nUNZ+2+00000000000001'")
    assert out["B"][1].startswith("UNB+UNOA:3+S+B") and "UNT+2+000001" in out["B"][1]
    texts = spark.createDataFrame([(k, t) for k, (_, t) in out.items()], "source string, text string")
    assert {r["error"] for r in envelope.check_interchanges(edifact.tokenized(texts)).collect()} == {None}
    assert {r["error"] for r in envelope.check_messages(edifact.messages(texts)).collect()} == {None}


def test_wanted_codes_want_all_errors(spark):
    with pytest.raises(ValueError):
        validate.issues(None, None, validate.Config(max_errors=2), only={"EXTRA_ELEMENT"})


def test_retries(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "k int")
    out = {r["k"]: (r["error"], r["attempts"]) for r in outcome.with_retries(df, lambda d, n: d.withColumn("error", F.when(F.col("k") >= n, "no")), 1).collect()}
    assert out == {0: (None, 1), 1: (None, 2), 2: ("no", 2), 3: ("no", 2)}


def test_nodes_know_their_segment(spark):
    texts = spark.createDataFrame([("a", "UNH+1+ORDERS:D'QTY+21:2'QTY+59:5'UNT+4+1'")], "source string, text string")
    found = trees.segment_nodes(edifact.messages(texts)).filter("tag = 'QTY' and name = 'c2'")
    assert [(r["seg_idx"], r["value"]) for r in found.orderBy("seg_idx").collect()] == [(1, "2"), (2, "5")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_rows_read_a_tree_once(spark):
    texts = ['[{"a": 1, "b": 2}, {"b": null}, 5, {}]', '{"x": {"a": 3}}', '{"x": {"a": 4}, "y": 6}', "{", "7", '{"rows": []}']
    out = documents.rows(nodes(spark, *texts), {"a": "int", "b": "int"})
    assert [tuple(r) for r in out.orderBy("doc_id", "record").collect()] == [(0, 0, 1, 2), (0, 1, None, None), (0, 2, None, None), (0, 3, None, None), (1, 0, None, None), (2, 0, 4, None), (2, 1, None, None), (4, 0, None, None), (5, 0, None, None)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_batches_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(trees, "NODES", 3)
    got = trees.json_nodes(spark.createDataFrame([(1, "[1, 2, 3]"), (2, None), (3, "{"), (4, "[4]")], "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["node_id"], r["value"]) for r in got if r["value"]] == [(1, 2, "1"), (1, 3, "2"), (1, 4, "3"), (3, 0, "{"), (4, 2, "4")]


def test_strictness_of_one_check(spark):
    found = edifact.grouped(edifact.messages(spark.createDataFrame([("a", "UNH+1+ORDERS:D'XYZ+1'UNT+3+1'")], "source string, text string")))
    known = schemas.Schema("S", "1", (schemas.Segment("UNH", (), True), schemas.Segment("BGM", (), True), schemas.Segment("UNT", (), True)))
    wanted = {"UNKNOWN_SEGMENT", "MISSING_MANDATORY_SEGMENT"}
    one = validate.issues(found, known, only=wanted)
    assert "MISSING_MANDATORY_ELEMENT" not in one._jdf.queryExecution().optimizedPlan().toString() and "EXTRA_ELEMENT" not in one._jdf.queryExecution().optimizedPlan().toString()
    for level in ("strict", "standard", "lenient"):
        all_ = validate.issues(found, known, validate.Config(level)).filter(F.col("code").isin(*wanted))
        assert sorted(map(tuple, one.select("code", validate.severity_at(level, F.col("severity"))).collect())) == sorted(map(tuple, all_.select("code", "severity").collect()))
