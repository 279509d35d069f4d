"""Some of the driver's queries against their SQL at the smallest scale, and the shape of the registry."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["s05_custom_una", "s13_line_item_groups", "s17_csv_typed", "p09_foreach_lines", "p10_nested_foreach", "f06_condition_else", "j01_lookup_inner", "j05_line_missing_qty", "a07_distinct", "a11_message_counts", "o05_stop_on_first_failure", "t04_date_format", "v12_node_rules", "k03_qualifier_targets", "k30_control_numbers", "b05_quarantine_retried", "m04_generate"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not DATA.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))
    out = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(str(row[i]) for i in at) for row in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_whole_texts_are_escaped(spark, duck):
    from xml.sax.saxutils import escape

    want = {i: t if t is None else escape(t, {'"': "&quot;", "'": "&apos;"}) for i, t in duck.execute("select doc_id, text from documents").fetchall()}
    assert {x["doc_id"]: x["xml"] for x in entry.queries()["u02_escapes"](spark, str(DATA)).collect()} == want


@pytest.mark.parametrize(("name", "shape"), [("t05_number_groups", ",.2f"), ("t11_double_text", ".2f")])
def test_totals_of_all_orders(spark, duck, name, shape):
    totals = duck.execute("select o_orderkey, o_totalprice from orders").fetchall()
    assert any(f"{float(t):.2f}".endswith("0.00") for _, t in totals)
    want = {k: format(float(t), shape).rstrip("0").rstrip(".") for k, t in totals}
    assert {x["key"]: x["value"] for x in entry.queries()[name](spark, str(DATA)).collect()} == want
