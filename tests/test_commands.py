"""The engine object: batches of files, generation from records, automatic schemas, settings."""

import json

import pytest

from tradewire.engine import Engine, Settings
from tradewire.plans import dsl
from tradewire.plans.schema import Element, Packs, Schema, Segment

GOOD = "UNH+1+ORDERS:D:96A:UN'BGM+220+A'LIN+1'QTY+21:5'UNS+S'UNT+6+1'"
SCHEMA = Schema("ORDERS", "D96A", tuple(Segment(t, tuple(Element(f"e{i}") for i in range(1, 5)), t in ("BGM", "UNH")) for t in ("UNH", "BGM", "LIN", "QTY", "UNS", "UNT")))
MAPPING = {"name": "m", "source_type": "EDI", "target_type": "CSV", "rules": [{"type": "field", "source": "/BGM/e2", "target": "order"}, {"type": "lookup", "table": "t", "key_source": "/BGM/e1", "target": "kind"}], "lookups": {"t": {"name": "t", "entries": {"220": "order"}}}}


@pytest.fixture
def folder(tmp_path):
    for name, text in {"good": GOOD, "broken": "UNH+1'xx'", "no_bgm": GOOD.replace("BGM+220+A'", ""), "other": GOOD.replace("BGM+220", "BGM+999")}.items():
        (tmp_path / f"{name}.edi").write_text(text)
    return str(tmp_path)


def names(df):
    return sorted(r["source"].rsplit("/", 1)[-1] for r in df.collect())


def test_batch_validate(spark, folder):
    packs = Packs()
    packs.install(SCHEMA)
    batch = Engine(spark, packs=packs).batch_validate(folder)
    assert names(batch.accepted) == ["good.edi", "other.edi"] and names(batch.quarantine) == ["broken.edi", "no_bgm.edi"]
    assert tuple(batch.summary().first())[:4] == (4, 2, 0, 2) and batch.exit_code() == 2
    none = Engine(spark, Settings(policy="fail_all"), packs).batch_validate(folder)
    assert none.accepted.count() == 0 and none.quarantine.count() == 4


def test_batch_transform_and_output(spark, folder):
    engine = Engine(spark)
    batch = engine.batch_transform(folder, dsl.parse(MAPPING))
    assert names(batch.accepted) == ["good.edi"] and names(batch.quarantine) == ["broken.edi", "no_bgm.edi", "other.edi"]
    found = engine.parse(spark.createDataFrame([("f", GOOD)], "source string, text string"))
    out = lambda target: engine.output(engine.transform(found, m), m).first()["text"] if (m := dsl.parse({**MAPPING, "target_type": target})) else None
    assert out("CSV") == "A,order" and json.loads(out("JSON_X")) == {"order": "A", "kind": "order"}
    assert json.loads(engine.dump(found).first()["json"])["message_ref"] == "1"


def test_generate(spark):
    rows = spark.createDataFrame([(2, "O1", "b", "7"), (1, "O1", "a", "10")], "no int, doc string, item string, qty string")
    f = lambda s, t: {"type": "field", "source": s, "target": t}
    m = dsl.parse({"name": "g", "source_type": "CSV", "target_type": "EANCOM_ORDERS", "rules": [f("/rows/row/doc", "BGM.e2"), {"type": "foreach", "source": "/rows/row", "target": "l", "rules": [f("no", "LIN.e1"), f("item", "LIN.e3"), f("qty", "QTY21.e1")]}, f("/rows/row/doc", "UNS.e1")]})
    got = [r["text"] for r in Engine(spark).generate(rows, m, ["no"]).orderBy("part", "no").collect()]
    assert got == ["BGM++O1'", "LIN+1++a'\nQTY+21:10'", "LIN+2++b'\nQTY+21:7'", "UNS+O1'"]
    with pytest.raises(dsl.MappingError):
        Engine(spark).generate(rows, dsl.parse(MAPPING), ["no"])


def test_validate_by_pack(spark):
    packs = Packs()
    packs.install(SCHEMA)
    engine = Engine(spark, packs=packs)
    found = engine.parse(spark.createDataFrame([("a", GOOD + "UNH+2+INVOIC:D:96A'ZZZ'UNT+3+2'"), ("b", GOOD.replace("QTY", "QTX"))], "source string, text string"))
    rows = engine.validate(found)
    assert sorted(r["code"] for r in rows.collect()) == ["EMPTY_SEGMENT", "UNKNOWN_SEGMENT"]
    assert "UNKNOWN_SEGMENT" in engine.report(rows) and engine.lint(dsl.parse(MAPPING), SCHEMA) == []


def test_settings():
    data = {"strictness": "strict", "profiles": {"p": {"policy": "accept_all"}}}
    assert Settings.of(data, "p").policy == "accept_all" and Settings.of(data).strictness == "strict"
    assert Settings(strictness="x", max_errors=-1).checked() == ["unknown strictness: x", "max_errors must not be negative"]
    with pytest.raises(ValueError, match="nope"):
        Settings.of({"nope": 1})
