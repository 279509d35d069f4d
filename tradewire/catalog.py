"""The engine's queries for the driver, each through the wire format or one of the readers, and SQL on the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire import engine, samples
from tradewire.functions import extensions, syntax, text, transforms
from tradewire.functions.plan import fixed
from tradewire.functions.transforms import Value
from tradewire.operators import documents, envelope, outcome, validate, wire
from tradewire.plans import compiler, diagnostics, dsl
from tradewire.plans import schema as schemas
from tradewire.samples import table
from tradewire.sources import edifact, tables, tabular, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Lines numbered as the samples do.
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def mapping(*rules: dict, lookups: dict[str, dict[str, str]] | None = None, target: str = "CSV") -> dsl.Mapping:
    return dsl.parse({"name": "m", "source_type": "EANCOM_D96A_ORDERS", "target_type": target, "rules": list(rules), "lookups": {n: {"name": n, "entries": e} for n, e in (lookups or {}).items()}})


def field(source: str, target: str, transform: dict | None = None) -> dict:
    return {"type": "field", "source": source, "target": target} | ({"transform": transform} if transform else {})


def each(source: str, target: str, *rules: dict) -> dict:
    return {"type": "foreach", "source": source, "target": target, "rules": list(rules)}


def aggregate(source: str, target: str, op: str) -> dict:
    return {"type": "aggregate", "source": source, "target": target, "op": op}


def when(c: dict, then: list[dict], otherwise: list[dict] | None = None) -> dict:
    return {"type": "condition", "when": c, "then": then, "else_rules": otherwise or []}


def lookup(name: str, key: str, target: str, default: str | None = None) -> dict:
    return {"type": "lookup", "table": name, "key_source": key, "target": target} | ({"default_value": default} if default is not None else {})


def orders(spark: SparkSession, sf_dir: str, m: dsl.Mapping | None = None) -> DataFrame:
    """Parsed and grouped ORDERS messages; for a mapping, only what it reads is cut into elements."""
    return edifact.grouped(edifact.messages(samples.orders_texts(spark, sf_dir), custom=False, tags=compiler.tags(m) if m else None))


def mapped(spark: SparkSession, sf_dir: str, *rules: dict, lookups: dict | None = None) -> DataFrame:
    """One row for each message; o_orderkey from the wire, error dropped by the caller if it has to."""
    m = mapping(field("/BGM/e2", "key"), *rules, lookups=lookups)
    return compiler.transform(orders(spark, sf_dir, m), m).withColumn("key", F.col("key").cast("long"))


def lines(spark: SparkSession, sf_dir: str, *rules: dict, header: tuple[dict, ...] = (), lookups: dict | None = None) -> DataFrame:
    """One row for each line: key and n from the wire."""
    m = mapping(field("/BGM/e2", "key"), *header, each("/LINE_ITEM", "lines", field("LIN/e1", "n"), *rules), lookups=lookups)
    return compiler.rows(orders(spark, sf_dir, m), m).withColumn("key", F.col("key").cast("long")).withColumn("n", F.col("n").cast("long"))


def key_n(*columns: str) -> list[str]:
    return ["key", "n", *columns]


# --- S: sources --------------------------------------------------------------------------------------------------------


@query("s05_tokenize_segments", """
WITH o AS (SELECT count(*) AS o FROM orders), l AS (SELECT count(*) AS l FROM lineitem)
SELECT t.tag, (t.po * o.o + t.pl * l.l)::BIGINT AS n FROM o, l, (VALUES ('UNH',1,0),('BGM',1,0),('DTM',1,0),('RFF',1,0),('NAD',2,0),('CUX',1,0),('LIN',0,1),('PIA',0,1),('QTY',0,2),('PRI',0,1),('MOA',1,1),('UNS',1,0),('CNT',1,0),('UNT',1,0)) t(tag, po, pl)""")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = edifact.tokenized(samples.orders_texts(spark, sf_dir), custom=False)
    return cut.select(F.explode(F.transform("segs", lambda s: s["tag"])).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("s05_custom_una", "SELECT o_orderkey AS key, o_totalprice AS total, o_orderpriority AS priority FROM orders")
def s05_una(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = syntax.Separators("^", "|", ".", "!", " ", "~")
    found = edifact.grouped(edifact.messages(samples.orders_texts(spark, sf_dir, sep=own)))
    out = compiler.transform(found, mapping(field("/BGM/e2", "key"), field("/MOA[5025='86']/e1/c2", "total"), field("/RFF/e1/c2", "priority")))
    return out.select(F.col("key").cast("long").alias("key"), F.col("total").cast("double").alias("total"), "priority")


@query("s08_release_roundtrip", "SELECT doc_id, text FROM documents")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = samples.Writer()
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").cast("string").alias("source"), F.concat(w("UNH", F.col("doc_id").cast("string"), ["GENRAL", "D"]), w("FTX", "AAI", "", "", F.coalesce("text", F.lit(""))), w("UNT", "3", "1")).alias("text"))
    out = compiler.transform(edifact.grouped(edifact.messages(texts, custom=False)), mapping(field("/UNH/e1", "doc_id"), field("/FTX/e4", "text")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query("s09_positions", """
SELECT o_custkey::VARCHAR AS source, count(*)::BIGINT AS messages, (count(*) + 2)::BIGINT AS last_line FROM orders GROUP BY o_custkey""")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = edifact.positions(samples.customer_interchanges(spark, sf_dir))
    return at.groupBy("source").agg(F.count_if(F.col("tag") == "UNH").alias("messages"), F.max("line").cast("long").alias("last_line"))


@query("s10_messages", "SELECT o_custkey::VARCHAR AS source, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS msg_idx, o_orderkey::VARCHAR AS message_ref FROM orders")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edifact.messages(samples.customer_interchanges(spark, sf_dir)).select("source", "msg_idx", "message_ref")


@query("s11_partial_messages", "SELECT o_orderkey::VARCHAR AS message_ref, o_orderkey % 7 = 0 AS partial FROM orders")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edifact.messages(samples.orders_texts(spark, sf_dir, trailer=F.col("o_orderkey") % 7 != 0), custom=False).select("message_ref", "partial")


@query("s12_message_info", "SELECT o_orderkey::VARCHAR AS message_ref, 'ORDERS' AS doc_type, 'D_96A' AS version FROM orders")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edifact.messages(samples.orders_texts(spark, sf_dir), custom=False).select("message_ref", "doc_type", "version")


@query("s13_line_item_groups", "SELECT o_orderkey::VARCHAR AS message_ref, count(l_orderkey)::INTEGER AS items, 11 AS root_segments, (6 * count(l_orderkey))::INTEGER AS item_segments FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("message_ref", F.size("items").alias("items"), F.size("root").alias("root_segments"), F.size(F.flatten("items")).alias("item_segments"))


@query("s14_segment_tree", """
SELECT 'QTY' AS tag, 'c2' AS name, 'Component' AS node_type, sum(l_quantity + l_linenumber)::BIGINT AS total, (2 * count(*))::BIGINT AS n FROM lineitem""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trees.segment_nodes(edifact.messages(samples.orders_texts(spark, sf_dir), custom=False, tags={"QTY"}))
    rows = nodes.filter("tag = 'QTY' and name = 'c2'")
    return rows.groupBy("tag", "name", "node_type").agg(F.sum(F.col("value").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("s15_envelope_unb", "SELECT o_custkey::VARCHAR AS source, o_custkey::VARCHAR AS sender, 'RECEIVER' AS receiver, 'UNOA' AS syntax, 'IC' || o_custkey AS control_ref, count(*)::INTEGER AS messages, CAST(NULL AS VARCHAR) AS error FROM orders GROUP BY o_custkey")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = edifact.tokenized(samples.customer_interchanges(spark, sf_dir), custom=False)
    return envelope.check_interchanges(cut).select("source", "sender", "receiver", "syntax", "control_ref", "messages", "error")


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV lines, every seventh without a segment, every eleventh with a comma and quotes in the name."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit('The "'), F.col("c_name"), F.lit('", Ltd'))).otherwise(F.col("c_name"))
    cells = [F.col("c_custkey").cast("string"), name, F.col("c_nationkey").cast("string"), samples.money(F.col("c_acctbal")), F.when(F.col("c_custkey") % 7 == 0, "NULL").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("F")]
    return c.select(wire.csv_line(cells).alias("line"))


CUSTOMER = [tabular.Field("id", "integer", True), tabular.Field("name", "string", True, max_length=20), tabular.Field("nation", "integer"), tabular.Field("balance", "decimal"), tabular.Field("segment", "string", True), tabular.Field("even", "boolean")]


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tabular.cells(customer_lines(spark, sf_dir))
    return cut.select("cells", *[F.get("cells", F.lit(i)).alias(f.name) for i, f in enumerate(CUSTOMER)])


CUSTOMER_SQL = """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'The "' || c_name || '", Ltd' ELSE c_name END AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_custkey % 2 = 0 AS even FROM customer)
"""


@query("s17_csv_typed", CUSTOMER_SQL + "SELECT id, name, nation, balance, segment, even, CAST(NULL AS VARCHAR) AS error FROM c")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.typed_rows(customer_cells(spark, sf_dir), CUSTOMER)


@query("s19_csv_width", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'missing columns: 2 of 3' WHEN p_partkey % 3 = 1 THEN 'extra columns: 4 of 3' END AS error FROM part")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    line = F.concat(k.cast("string"), F.lit(","), F.col("p_name"), F.when(k % 3 == 0, "").when(k % 3 == 1, ",a,b").otherwise(",a"))
    return tabular.cells(p.select(k.alias("key"), line.alias("line"))).select("key", tabular.width_error(F.col("cells"), 3).alias("error"))


@query("s21_csv_infer", """
SELECT p_partkey AS key, v.place, CASE v.place WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' WHEN 2 THEN 'string' WHEN 3 THEN CASE p_size % 3 WHEN 0 THEN 'boolean' WHEN 1 THEN 'null' ELSE 'integer' END END AS kind,
  CASE WHEN v.place = 0 THEN p_partkey WHEN v.place = 3 AND p_size % 3 = 2 THEN 1 END AS i, CASE WHEN v.place = 1 THEN p_retailprice END AS d, CASE WHEN v.place = 3 AND p_size % 3 = 0 THEN true END AS b, CASE WHEN v.place = 2 THEN p_name END AS s
FROM part, (VALUES (0), (1), (2), (3)) v(place)""")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    last = F.when(F.col("p_size") % 3 == 0, "Yes").when(F.col("p_size") % 3 == 1, r"\N").otherwise("1")
    price = F.concat(samples.money(F.col("p_retailprice")))
    cut = tabular.cells(p.select("p_partkey", wire.csv_line([F.col("p_partkey"), price, F.col("p_name"), last]).alias("line")))
    return cut.select(F.col("p_partkey").alias("key"), F.posexplode("cells").alias("place", "cell")).select("key", "place", tabular.inferred(F.col("cell")).alias("v")).select("key", "place", "v.*")


@query("s23_csv_nulls", "SELECT c_custkey % 7 = 0 AS is_null, count(*) AS n FROM customer GROUP BY 1")
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_cells(spark, sf_dir).groupBy(tabular.is_null(F.col("segment")).alias("is_null")).agg(F.count(F.lit(1)).alias("n"))


@query("s25_csv_row_checks", CUSTOMER_SQL + "SELECT id, CASE WHEN strlen(name) > 20 THEN 'name is over 20 bytes' WHEN segment IS NULL THEN 'segment is required' END AS error FROM c")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_cells(spark, sf_dir).select(F.col("id").cast("long").alias("id"), tabular.row_error(CUSTOMER).alias("error"))


@query("s26_json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def s26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.properties(table(spark, sf_dir, "events"), "props", {"k": "bigint"}).select("event_id", "k")


@query("s27_json_tree", """
SELECT event_id AS doc_id, x.node_id, x.path, x.node_type, CASE WHEN x.node_id = 1 THEN json_extract_string(props, '$.k') END AS value FROM events,
  (VALUES (0, '/', 'Root'), (1, '/k', 'Field')) x(node_id, path, node_type) WHERE x.node_id = 0 OR json_extract_string(props, '$.k') IS NOT NULL""")
def s27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.json_nodes(table(spark, sf_dir, "events"), "event_id", "props").select("doc_id", "node_id", "path", "node_type", "value")


@query("s30_filter_limit_offset", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 ORDER BY s_suppkey LIMIT 5 OFFSET 1")
def s30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(table(spark, sf_dir, "supplier"), {"s_nationkey": 7}, ["s_suppkey"], 5, 1).select("s_suppkey", "s_name")


@query("s31_read_single", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 ORDER BY s_suppkey LIMIT 1")
def s31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_single(table(spark, sf_dir, "supplier"), {"s_nationkey": 3}, ["s_suppkey"]).select("s_suppkey", "s_name")


SUPPLIER = tables.TableDef("supplier", (tables.ColumnDef("s_suppkey", "integer", False, True), tables.ColumnDef("s_name", "string", False), tables.ColumnDef("s_nationkey", "integer", foreign_key=("nation", "n_nationkey")), tables.ColumnDef("s_acctbal", "decimal")))


@query("s32_typed_table", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey::BIGINT END AS s_nationkey, s_acctbal, CASE WHEN s_suppkey % 5 = 0 THEN 's_nationkey is not integer' END AS error FROM supplier")
def s32(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return tables.typed(s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise(F.col("s_nationkey").cast("string"))), SUPPLIER)


@query("s33_table_tree", "SELECT s_suppkey, x.ordinal, x.name, CASE x.ordinal WHEN 0 THEN s_name ELSE s_nationkey::VARCHAR END AS value FROM supplier, (VALUES (0, 's_name'), (1, 's_nationkey')) x(ordinal, name)")
def s33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey")


@query("s34_row_count", "SELECT count(*) AS n FROM supplier")
def s34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_count(table(spark, sf_dir, "supplier"))


# --- P: paths -----------------------------------------------------------------------------------------------------------


@query("p01_field_copy", "SELECT o_orderkey AS key, '220' AS kind, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y%m%d') AS day, CAST(NULL AS VARCHAR) AS missing FROM orders")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, field("/BGM/e1", "kind"), field("/NAD[3035='SU']/e2", "status"), field("/RFF[1153='ON']/e1/c2", "priority"), field("/DTM[2005='137']/e1/c2", "day"), field("/FTX/e1", "missing")).drop("error")


@query("p02_first_match", "SELECT o_orderkey AS key, o_custkey::VARCHAR AS party, CAST(NULL AS VARCHAR) AS composite, '9' AS agency FROM orders")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, field("/NAD/e2/c1", "party"), field("/NAD/e2", "composite"), field("NAD/e2/c3", "agency")).drop("error")


@query("p03_collection", f"SELECT o_orderkey AS key, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM orders LEFT JOIN ({NUMBERED}) l ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, aggregate("/LINE_ITEM/PIA/e2/c1", "flags", "distinct")).select("key", F.array_join(F.sort_array(F.split("flags", ",")), ",").alias("flags"))


@query("p04_absolute_in_foreach", f"SELECT l_orderkey AS key, n, o_orderpriority AS priority, l_quantity AS quantity FROM ({NUMBERED}) JOIN orders ON o_orderkey = l_orderkey")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, field("/RFF/e1/c2", "priority"), field("QTY/e1/c2", "quantity")).select(*key_n("priority"), F.col("quantity").cast("double").alias("quantity"))


@query("p07_selector_qualifier", f"SELECT l_orderkey AS key, n, l_quantity::BIGINT AS ordered, l_linenumber::BIGINT AS number, CAST(NULL AS VARCHAR) AS none FROM ({NUMBERED})")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines(spark, sf_dir, field("QTY[6063='21']/e1/c2", "ordered"), field("QTY['59']/e1/c2", "number"), field("QTY[9999='59']/e1/c2", "none"))
    return out.select("key", "n", F.col("ordered").cast("long").alias("ordered"), F.col("number").cast("long").alias("number"), "none")


@query("p09_foreach_lines", f"""
SELECT l_orderkey AS key, n, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_custkey AS customer, l_partkey AS product, l_returnflag AS flag, l_quantity AS quantity, l_extendedprice AS amount
FROM ({NUMBERED}) JOIN orders ON o_orderkey = l_orderkey""")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines(
        spark, sf_dir, field("/NAD[3035='BY']/e2/c1", "customer"), field("LIN/e3/c1", "product"), field("PIA/e2/c1", "flag"), field("QTY[6063='21']/e1/c2", "quantity"), field("MOA[5025='203']/e1/c2", "amount"),
        header=(field("/DTM[2005='137']/e1/c2", "order_date", {"op": "date_format", "from": "YYYYMMDD", "to": "YYYY-MM-DD"}),),
    )
    return out.select("key", "n", "order_date", F.col("customer").cast("long").alias("customer"), F.col("product").cast("long").alias("product"), "flag", F.col("quantity").cast("double").alias("quantity"), F.col("amount").cast("double").alias("amount"))


@query("p10_nested_foreach", f"SELECT l_orderkey AS key, n, x.q AS qualifier, CASE x.q WHEN '21' THEN l_quantity::BIGINT ELSE l_linenumber END AS amount FROM ({NUMBERED}), (VALUES ('21'), ('59')) x(q)")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapped(spark, sf_dir, each("/LINE_ITEM", "lines", field("LIN/e1", "n"), each("QTY", "quantities", field("e1/c1", "qualifier"), field("e1/c2", "amount"))))
    one = out.select("key", F.inline("lines")).select("key", F.col("n").cast("long").alias("n"), F.inline("quantities"))
    return one.select("key", "n", "qualifier", F.col("amount").cast("long").alias("amount"))


@query("p15_indexed_children", "SELECT event_id AS doc_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.descend(trees.json_nodes(table(spark, sf_dir, "events"), "event_id", "props"), "k", 0).select("doc_id", "value")


# --- F: conditions ------------------------------------------------------------------------------------------------------


def flagged(spark: SparkSession, sf_dir: str, c: dict) -> DataFrame:
    return mapped(spark, sf_dir, when(c, [field("/UNH/e1", "met")], [field("/NONE/e1", "met")])).select("key", F.col("met").isNotNull().alias("met"))


def cond(op: str, **args) -> dict:
    return {"op": op, **args}


IS_O = cond("equals", field="/NAD[3035='SU']/e2", value="O")
HIGH = cond("contains", field="/RFF/e1/c2", value="HIGH")

for name, c, sql in (
    ("f01_exists", cond("exists", field="/LINE_ITEM/LIN/e1"), "o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    ("f02_equals", IS_O, "o_orderstatus = 'O'"),
    ("f03_contains", HIGH, "o_orderpriority LIKE '%HIGH%'"),
    ("f04_matches_digits", cond("matches", field="/UNH/e1", pattern="^[0-9]+$"), "true"),
    ("f04_matches_part", cond("matches", field="/RFF/e1/c2", pattern="SPEC"), "o_orderpriority LIKE '%SPEC%'"),
    ("f04_matches_exact", cond("matches", field="/RFF/e1/c2", pattern="^5-LOW$"), "o_orderpriority = '5-LOW'"),
    ("f05_and_or_not", cond("or", conditions=[cond("and", conditions=[IS_O, HIGH]), cond("not", condition=cond("contains", field="/RFF/e1/c2", value="-"))]), "(o_orderstatus = 'O' AND o_orderpriority LIKE '%HIGH%') OR o_orderpriority NOT LIKE '%-%'"),
):
    QUERIES[name] = lambda spark, sf_dir, c=c: flagged(spark, sf_dir, c)
    SQL[name] = f"SELECT o_orderkey AS key, {sql} AS met FROM orders"


@query("f06_condition_else", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE o_custkey::VARCHAR END AS value, CASE WHEN o_orderstatus = 'O' THEN '220' END AS only_open FROM orders")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, when(IS_O, [field("/RFF/e1/c2", "value"), field("/BGM/e1", "only_open")], [field("/NAD/e2/c1", "value")])).drop("error")


@query("f07_conditional_transform", "SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '5-LOW' THEN lower(o_orderpriority) WHEN o_orderpriority LIKE '%NOT%' THEN 'none' ELSE o_orderpriority END AS value FROM orders")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = {"op": "conditional", "when": cond("matches", field="x", pattern="^NOT"), "then": {"op": "concatenate", "values": [{"type": "literal", "value": "none"}]}}
    return mapped(spark, sf_dir, field("/RFF/e1/c2", "value", {"op": "conditional", "when": cond("equals", field="x", value="5-LOW"), "then": {"op": "lowercase"}, "else_transform": inner})).drop("error")


@query("f08_table_filter", "SELECT c_custkey FROM customer WHERE c_nationkey = 4 AND c_mktsegment = 'BUILDING'")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(table(spark, sf_dir, "customer"), {"c_nationkey": 4, "c_mktsegment": "BUILDING"}).select("c_custkey")


# --- J: look-ups and membership -------------------------------------------------------------------------------------------


FLAGS = {"R": "returned", "A": "accepted"}


@query("j01_lookup_default", f"SELECT l_orderkey AS key, n, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'other' END AS flag FROM ({NUMBERED})")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, lookup("flags", "PIA/e2/c1", "flag", "other"), lookups={"flags": FLAGS}).select(*key_n("flag"))


@query("j01_lookup_inner", f"SELECT l_orderkey AS key, n, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' END AS flag, CASE WHEN l_returnflag = 'N' THEN 'lookup key ''N'' not found in table ''flags''' END AS error FROM ({NUMBERED})")
def j01_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, lookup("flags", "PIA/e2/c1", "flag"), lookups={"flags": FLAGS}).select(*key_n("flag", "error"))


@query("j01_lookup_join", "SELECT c_custkey, n_name AS nation, CAST(NULL AS VARCHAR) AS lookup_error FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j01_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return compiler.looked_up(table(spark, sf_dir, "customer"), side, "c_nationkey", "nation").select("c_custkey", "nation", "lookup_error")


def el(id_: str, kind: str = "an", low: int = 0, high: int = 35, must: bool = False) -> schemas.Element:
    return schemas.Element(id_, id_, kind, low, high, must)


def seg(tag: str, *elements: schemas.Element, must: bool = False) -> schemas.Segment:
    return schemas.Segment(tag, elements, must)


ORDERS = schemas.Schema("ORDERS", "D96A", (
    seg("UNH", el("e1", must=True), el("e2"), must=True), seg("BGM", el("e1"), el("e2", "n", 1, 4), el("e3"), must=True), seg("DTM", el("e1"), must=True), seg("RFF", el("e1")), seg("NAD", el("e1", "a", 2, 3, True), el("e2"), must=True), seg("CUX", el("e1")),
    seg("LIN", el("e1", "n", must=True), el("e2"), el("e3"), must=True), seg("QTY", el("e1"), must=True), seg("PRI", el("e1")), seg("MOA", el("e1")), seg("UNS", el("e1")), seg("CNT", el("e1")), seg("UNT", el("e1", "n"), el("e2"), must=True),
))


def issued(spark: SparkSession, sf_dir: str, schema: schemas.Schema = ORDERS, config: validate.Config = validate.Config(), **options) -> DataFrame:
    return validate.issues(orders(spark, sf_dir), schema, config, **options).withColumn("key", F.col("message_ref").cast("long"))


@query("j03_unknown_segment", f"SELECT l_orderkey AS key, 'PIA[' || (7 + 6 * (n - 1) + 1) || ']' AS path, 'warning' AS severity FROM ({NUMBERED})")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issued(spark, sf_dir, only={"UNKNOWN_SEGMENT"}).select("key", "path", "severity")


@query("j04_missing_mandatory", "SELECT o_orderkey AS key, x.tag FROM orders, (VALUES ('LIN'), ('QTY')) x(tag) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issued(spark, sf_dir, only={"MISSING_MANDATORY_SEGMENT"}).filter("path = ''")
    return rows.select("key", F.regexp_extract("message", "segment '(...)'", 1).alias("tag"))


@query("j05_line_missing_qty", f"SELECT l_orderkey AS key, 'LINE_ITEM[' || (n - 1) || ']' AS path FROM ({NUMBERED}) WHERE l_returnflag = 'R'")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines with flag R lose their quantities before they are checked.
    returned = lambda g: F.exists(g, lambda s: (s["tag"] == "PIA") & (F.get(F.get(s["el"], F.lit(1))["c"], F.lit(0)) == "R"))
    found = orders(spark, sf_dir).withColumn("items", F.transform("items", lambda g: F.when(returned(g), F.filter(g, lambda s: s["tag"] != "QTY")).otherwise(g)))
    rows = validate.issues(found, ORDERS).filter("code = 'MISSING_MANDATORY_SEGMENT' and path like 'LINE%'")
    return rows.select(F.col("message_ref").cast("long").alias("key"), "path")


@query("j07_codelist_semi", "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = validate.Codes({"st_status": ("O", "F")})
    out = mapped(spark, sf_dir, field("/NAD[3035='SU']/e2", "status"))
    return out.filter(~codes.member("st_status", F.col("status"))).select("key", "status")


@query("j07_codelist_nocase", "SELECT event_id, upper(event_type) IN ('CLICK', 'VIEW') AS valid FROM events")
def j07_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = validate.Codes({"k_type": ("Click", "VIEW")}, frozenset({"k_type"}))
    return table(spark, sf_dir, "events").select("event_id", codes.member("k_type", F.col("event_type")).alias("valid"))


@query("j08_ref_match", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'MissingTrailer' WHEN o_orderkey % 3 = 0 THEN 'IncorrectSegmentCount' END AS error FROM orders")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = edifact.messages(samples.orders_texts(spark, sf_dir, trailer=k % 7 != 0, count_shift=F.when(k % 3 == 0, 1).otherwise(0)), custom=False)
    return envelope.check_messages(found).select(F.col("message_ref").cast("long").alias("key"), "error")


@query("j11_conditional_required", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'Field ''DATE'' is required when ''STATUS'' is ''O''' END AS error FROM orders")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    nodes = F.array(node("STATUS", F.col("o_orderstatus")), node("DATE", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderdate"))))
    rules = [validate.Conditional("STATUS", "O", ("DATE",)), validate.Conditional("STATUS", "X", ("NEVER",))]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), validate.conditional_violation(nodes, rules).alias("error"))


# --- A: aggregates --------------------------------------------------------------------------------------------------------


for op, sql, kind in (
    ("sum", "coalesce(sum(l_quantity), 0)", "double"), ("count", "count(l_orderkey)", "long"), ("min", "min(l_quantity)", "double"), ("max", "max(l_quantity)", "double"),
    ("first", "arg_min(l_quantity, n)", "double"), ("last", "arg_max(l_quantity, n)", "double"),
):
    number = {"sum": 1, "count": 2, "min": 3, "max": 4, "first": 5, "last": 6}[op]
    QUERIES[f"a{number:02}_{op}"] = lambda spark, sf_dir, op=op, kind=kind: mapped(spark, sf_dir, aggregate("/LINE_ITEM/QTY[6063='21']/e1/c2", "value", op)).select("key", F.col("value").cast(kind).alias("value"))
    SQL[f"a{number:02}_{op}"] = f"SELECT o_orderkey AS key, {sql} AS value FROM orders LEFT JOIN ({NUMBERED}) l ON o_orderkey = l_orderkey GROUP BY o_orderkey"


@query("a07_distinct", f"""
SELECT o_orderkey AS key, coalesce(string_agg(flag, ',' ORDER BY first_n), '') AS flags FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS flag, min(n) AS first_n FROM ({NUMBERED}) GROUP BY 1, 2) l ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, aggregate("/LINE_ITEM/PIA/e2/c1", "flags", "distinct")).select("key", "flags")


@query("a01_sum_empty", "SELECT o_orderkey AS key, 0.0::DOUBLE AS total, CAST(NULL AS DOUBLE) AS least, 0::BIGINT AS n, '' AS names FROM orders")
def a01_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, aggregate("/TAX/e1", "total", "sum"), aggregate("/TAX/e1", "least", "min"), aggregate("/TAX/e1", "n", "count"), aggregate("/TAX/e1", "names", "distinct")).drop("error")


@query("a01_sum_error", "SELECT o_orderkey AS key, CAST(NULL AS DOUBLE) AS total, 'aggregate sum at ''/RFF/e1/c2'' expected numeric input but found ''' || o_orderpriority || '''' AS error FROM orders")
def a01_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, aggregate("/RFF/e1/c2", "total", "sum")).select("key", "total", "error")


@query("a08_segment_occurs", "SELECT o_orderkey AS key, CASE WHEN n < 2 THEN 'Segment ''LIN'' occurs ' || n || ' times, minimum required is 2' WHEN n > 5 THEN 'Segment ''LIN'' occurs ' || n || ' times, maximum allowed is 5' END AS error FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(F.col("message_ref").cast("long").alias("key"), validate.occurrence_violation(F.col("segs"), [validate.Occurs("LIN", 2, 5)]).alias("error"))


@query("a09_unt_count", "SELECT o_orderkey AS key, (11 + 6 * count(l_orderkey))::INTEGER AS segments, (11 + 6 * count(l_orderkey))::INTEGER AS declared FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.check_messages(edifact.messages(samples.orders_texts(spark, sf_dir), custom=False)).select(F.col("message_ref").cast("long").alias("key"), "segments", F.col("declared_segments").cast("int").alias("declared"))


@query("a10_issue_summary", """
SELECT 'MAX_LENGTH_VIOLATION' AS code, 'error' AS severity, count(*) AS n FROM orders WHERE o_orderkey > 9999 HAVING count(*) > 0 UNION ALL
SELECT 'MIN_LENGTH_VIOLATION', 'error', count(*) FROM orders UNION ALL
SELECT 'MISSING_MANDATORY_SEGMENT', 'error', 2 * count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0 UNION ALL
SELECT 'UNKNOWN_SEGMENT', 'warning', count(*) FROM lineitem""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tight = schemas.merge(ORDERS, schemas.Schema("OWN", "1", (seg("UNS", el("e1", low=2)),)))
    return diagnostics.summary(issued(spark, sf_dir, tight))


@query("a11_message_counts", "SELECT o_orderkey AS key, (CASE WHEN n = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey > 9999 THEN 1 ELSE 0 END)::BIGINT AS errors, n AS warnings, n > 0 AND o_orderkey <= 9999 AS is_valid FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders(spark, sf_dir)
    return validate.summary(found, validate.issues(found, ORDERS)).select(F.col("message_ref").cast("long").alias("key"), "errors", "warnings", "is_valid")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the wire; without lines they fail, partial ones are warned of."""
    found = edifact.grouped(edifact.messages(samples.orders_texts(spark, sf_dir, trailer=F.col("o_orderkey") % 7 != 0), custom=False))
    out = compiler.transform(found, mapping(field("/BGM/e2", "key"), field("/NAD[3035='BY']/e2/c1", "customer"), lookup("kinds", "/LINE_ITEM/LIN/e1", "first_line"), lookups={"kinds": {"1": "one"}}), keep=("partial",))
    rows = out.select(F.col("key").cast("long").alias("key"), F.col("customer").cast("long").alias("customer"), "partial", "error")
    return outcome.with_outcome(rows, F.col("error"), F.col("partial"))


OUTCOME = "SELECT o_orderkey AS key, o_custkey AS customer, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'warned' ELSE 'ok' END AS outcome FROM orders"


@query("a12_batch_summary", f"SELECT count(*) AS processed, count_if(outcome = 'ok')::BIGINT AS succeeded, count_if(outcome = 'warned')::BIGINT AS warned, count_if(outcome = 'failed')::BIGINT AS failed, count_if(outcome <> 'failed') * 100.0::DOUBLE / count(*) AS success_rate FROM ({OUTCOME})")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.batch_summary(outcomes(spark, sf_dir)).withColumn("success_rate", F.col("success_rate").cast("double"))


@query("a13_metrics", f"SELECT count(*) / 4.0::DOUBLE AS files_per_s, sum(key % 3) / 4.0::DOUBLE AS messages_per_s, 4000.0::DOUBLE / count(*) AS avg_ms_per_file, count_if(outcome = 'failed') * 100.0::DOUBLE / count(*) AS error_rate, sum(key % 1000) * 8 / 1e6::DOUBLE / 4.0::DOUBLE AS mbit_per_s FROM ({OUTCOME})")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = outcomes(spark, sf_dir).withColumn("messages", F.col("key") % 3).withColumn("bytes", F.col("key") % 1000)
    out = outcome.metrics(run, 4.0)
    return out.select(*[F.col(c).cast("double").alias(c) for c in ("files_per_s", "messages_per_s", "avg_ms_per_file", "error_rate", "mbit_per_s")])


@query("a15_worst_exit", f"SELECT customer, max(CASE outcome WHEN 'failed' THEN 2 WHEN 'warned' THEN 1 ELSE 0 END) AS exit_code FROM ({OUTCOME}) GROUP BY customer")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("customer").agg(F.max(outcome.exit_code(F.col("outcome"))).alias("exit_code"))


# --- O: order, limits, sets ---------------------------------------------------------------------------------------------


@query("o05_stop_on_first_failure", f"SELECT key, outcome FROM (SELECT *, min(CASE WHEN outcome = 'failed' THEN key END) OVER (PARTITION BY customer) AS stop FROM ({OUTCOME})) WHERE stop IS NULL OR key <= stop")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.until_first_failure(outcomes(spark, sf_dir), ["key"], ["customer"]).select("key", "outcome")


@query("o06_max_errors", f"SELECT l_orderkey AS key, count(*) AS n FROM ({NUMBERED}) WHERE n <= 2 GROUP BY 1")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = validate.Config("strict", max_errors=2)
    known = schemas.Schema("OWN", "1", tuple(schemas.Segment(s.tag, tuple(el(f"e{i + 1}") for i in range(6))) for s in ORDERS.segments))
    return issued(spark, sf_dir, known, strict).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("o07_codelist_union", "SELECT o_orderstatus AS code FROM orders UNION SELECT l_returnflag FROM lineitem")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.code_union((table(spark, sf_dir, "orders"), "o_orderstatus"), (table(spark, sf_dir, "lineitem"), "l_returnflag"))


# --- T, X: scalar functions -----------------------------------------------------------------------------------------------


def record(spark: SparkSession, sf_dir: str, name: str, key: str, source: str, transform: dict) -> DataFrame:
    """A field of a table's rows through a mapping."""
    m = mapping(field(key, "key"), field(source, "value", transform))
    return compiler.transform(table(spark, sf_dir, name), m)


for name, t, key, source, transform, sql in (
    ("t01_upper", "part", "p_partkey", "p_name", {"op": "uppercase"}, "upper(p_name)"),
    ("t02_lower", "part", "p_partkey", "p_type", {"op": "lowercase"}, "lower(p_type)"),
    ("t05_number_format", "customer", "c_custkey", "c_acctbal", {"op": "number_format", "decimals": 1}, "printf('%.1f', c_acctbal)"),
    ("t06_concatenate", "part", "p_partkey", "p_name", {"op": "concatenate", "values": [{"type": "literal", "value": "a"}, {"type": "field", "path": "p"}], "separator": "-"}, "'a-[p]'"),
    ("t07_split", "part", "p_partkey", "p_brand", {"op": "split", "delimiter": "#", "index": 1}, "string_split(p_brand, '#')[2]"),
    ("t10_chain", "part", "p_partkey", "p_name", {"op": "chain", "transforms": [{"op": "split", "delimiter": " ", "index": 0}, {"op": "uppercase"}, {"op": "default", "value": "x"}]}, "upper(string_split(p_name, ' ')[1])"),
    ("x01_reverse", "part", "p_partkey", "p_name", {"op": "extension", "name": "string_utils", "function": "reverse"}, "reverse(p_name)"),
    ("x02_replace", "part", "p_partkey", "p_name", {"op": "extension", "name": "string_utils", "function": "replace", "args": ["ring", "RING"]}, "replace(p_name, 'ring', 'RING')"),
    ("x03_substring", "part", "p_partkey", "p_name", {"op": "extension", "name": "string_utils", "function": "substring", "args": ["1", "4"]}, "substr(p_name, 2, 3)"),
    ("x04_add", "part", "p_partkey", "p_size", {"op": "extension", "name": "math_utils", "function": "add", "args": ["2.5"]}, "p_size + 2.5::DOUBLE"),
    ("x05_multiply", "part", "p_partkey", "p_size", {"op": "extension", "name": "math_utils", "function": "multiply", "args": ["4"]}, "p_size * 4::DOUBLE"),
):
    QUERIES[name] = lambda spark, sf_dir, t=t, key=key, source=source, transform=transform: record(spark, sf_dir, t, key, source, transform).drop("error")
    SQL[name] = f"SELECT {key} AS key, {sql} AS value FROM {t}"


@query("t03_trim", "SELECT p_partkey AS key, p_name AS value FROM part")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" \t "), F.col("p_name"), F.lit("　\n")).alias("v"))
    return p.select(F.col("p_partkey").alias("key"), transforms.trimmed(Value(F.col("v"))).column.alias("value"))


@query("t04_date_format", "SELECT o_orderkey AS key, strftime(o_orderdate, '%d%m%Y') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'not a YYYY-MM-DD date: ''bad''' END AS error FROM orders")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", samples.day(F.col("o_orderdate")))
    a, b = transforms.date_format(Value(F.col("d")), "YYYYMMDD", "DDMMYYYY"), transforms.date_format(Value(F.col("d")), "YYYYMMDD", "ISO8601")
    bad = transforms.date_format(Value(F.when(F.col("o_orderkey") % 2 == 0, "bad").otherwise("2024-02-30")), "YYYY-MM-DD", "YYYYMMDD")
    return o.select(F.col("o_orderkey").alias("key"), a.column.alias("a"), b.column.alias("b"), bad.error.alias("error"))


@query("t05_number_groups", "SELECT o_orderkey AS key, regexp_replace(format('{:,.2f}', o_totalprice), '\\.?0+$', '') AS value FROM orders")
def t05_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), transforms.number_format(Value(F.col("o_totalprice"), "double"), 2, ",").column.alias("value"))


@query("t08_default", "SELECT o_orderkey AS key, 'none' AS value FROM orders")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, field("/FTX/e1", "value", {"op": "default", "value": "none"})).drop("error")


@query("t11_double_text", "SELECT o_orderkey AS key, regexp_replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') AS value FROM orders")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), text.double_text(F.col("o_totalprice")).alias("value"))


@query("u01_closest_segment", "SELECT tag, CASE tag WHEN 'BGN' THEN 'BGM' WHEN 'LINE' THEN 'LIN' WHEN 'QTY' THEN 'QTY' END AS near FROM (VALUES ('BGN'), ('LINE'), ('QTY'), ('WXYZABC')) v(tag)")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("BGN",), ("LINE",), ("QTY",), ("WXYZABC",)], "tag string").select("tag", text.closest(F.col("tag"), ["BGM", "LIN", "QTY"]).alias("near"))


@query("u02_escapes", r"""
SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv,
  replace(replace(replace(replace(text, '?', '??'), '+', '?+'), ':', '?:'), '''', '?''') AS wire FROM documents""")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_xml(t).alias("xml"), text.escape_html(t).alias("html"), text.escape_csv(t).alias("csv"), text.escape_wire(t).alias("wire"))


# --- V: validation -------------------------------------------------------------------------------------------------------


def checked(spark: SparkSession, sf_dir: str, element: schemas.Element) -> DataFrame:
    """Parts as messages `UNH, IMD+<brand>+<name>`; issues of the element at the second place."""
    w = samples.Writer()
    name = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), F.concat(w("UNH", F.col("p_partkey").cast("string"), ["PRODAT", "D"]), w("IMD", F.col("p_brand"), name, "z"), w("UNT", "3", "1")).alias("text"))
    schema = schemas.Schema("PRODAT", "D", (seg("UNH", el("e1"), el("e2")), seg("IMD", el("e1"), element, el("e3")), seg("UNT", el("e1"), el("e2"))))
    rows = validate.issues(edifact.grouped(edifact.messages(texts, custom=False)), schema)
    return rows.select(F.col("source").cast("long").alias("key"), "code", "path", "severity")


NAME = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_size::VARCHAR ELSE p_name END"
for name, element, code, sql in (
    ("v07_mandatory_empty", el("e2", must=True), "MANDATORY_ELEMENT_EMPTY", f"{NAME} = ''"),
    ("v08_min_length", el("e2", low=3), "MIN_LENGTH_VIOLATION", f"strlen({NAME}) < 3"),
    ("v09_max_length", el("e2", high=9), "MAX_LENGTH_VIOLATION", f"strlen({NAME}) > 9"),
    ("v10_type_alpha", el("e2", "a"), "DATA_TYPE_VIOLATION", f"NOT regexp_full_match({NAME}, '[A-Za-z]*')"),
    ("v10_type_numeric", el("e2", "n"), "DATA_TYPE_VIOLATION", f"NOT regexp_full_match({NAME}, '[0-9]*')"),
    ("v10_type_date", el("e2", "dt"), "DATA_TYPE_VIOLATION", f"NOT regexp_full_match({NAME}, '[0-9]{{8}}')"),
    ("v10_type_time", el("e2", "tm"), "DATA_TYPE_VIOLATION", f"NOT regexp_full_match({NAME}, '[0-9]{{4}}|[0-9]{{6}}')"),
):
    QUERIES[name] = lambda spark, sf_dir, element=element: checked(spark, sf_dir, element)
    SQL[name] = f"SELECT p_partkey AS key, '{code}' AS code, 'IMD[1]/e2' AS path, 'error' AS severity FROM part WHERE {sql}"


@query("v04_extra_element", "SELECT o_orderkey AS key, 'BGM[1]/e3' AS path, 2 AS element_pos, 'warning' AS severity FROM orders")
def v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = schemas.Schema("S", "1", (seg("BGM", el("e1"), el("e2")),))
    return issued(spark, sf_dir, short).filter("code = 'EXTRA_ELEMENT'").select("key", "path", "element_pos", "severity")


@query("v05_missing_element", "SELECT o_orderkey AS key, 'UNS[' || (7 + 6 * count(l_orderkey)) || ']/e2' AS path FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = schemas.Schema("S", "1", (seg("UNS", el("e1"), el("e2", must=True)),))
    return issued(spark, sf_dir, long).filter("code = 'MISSING_MANDATORY_ELEMENT'").select("key", "path")


@query("v06_id_mismatch", "SELECT o_orderkey AS key, 'BGM[1]/doc' AS path, 'Expected element ''doc'', found ''e2''' AS message FROM orders")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = schemas.Schema("S", "1", (seg("BGM", el("e1"), el("doc"), el("e3")),))
    return issued(spark, sf_dir, named).filter("code = 'ELEMENT_ID_MISMATCH'").select("key", "path", "message")


@query("v02_tag_mismatch", "SELECT o_orderkey AS key, x.code, x.path FROM orders, (VALUES ('SEGMENT_TAG_MISMATCH', 'BGM'), ('EXTRA_ELEMENT', 'BGM/e3'), ('MAX_LENGTH_VIOLATION', 'BGM/e1')) x(code, path)")
def v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edifact.messages(samples.orders_texts(spark, sf_dir), custom=False)
    bgm = syntax.first_segment(F.col("segs"), "BGM")
    held = validate.single_segment_issues(F.col("bgm"), seg("BGX", el("e1", high=2), el("e2")))
    return fixed(found, bgm=bgm).select(F.col("message_ref").cast("long").alias("key"), F.inline(held)).select("key", "code", "path")


@query("v12_node_rules", """
SELECT p_partkey AS doc_id, x.node_id, 'error' AS severity, x.code FROM part, (VALUES (1, 'TYPE_MISMATCH'), (3, 'EXPECTED_COMPONENT'), (3, 'NULL_COMPONENT_VALUE'), (2, 'NULL_VALUE'), (2, 'EXPECTED_COMPONENT')) x(node_id, code)
WHERE (x.code = 'TYPE_MISMATCH' AND p_partkey % 5 = 0) OR (x.code = 'EXPECTED_COMPONENT' AND ((x.node_id = 3 AND p_partkey % 2 = 0) OR (x.node_id = 2 AND p_partkey % 5 = 0))) OR (x.code = 'NULL_COMPONENT_VALUE' AND p_partkey % 2 = 1 AND p_partkey % 3 = 0) OR (x.code = 'NULL_VALUE' AND p_partkey % 7 = 0)""")
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    node = lambda i, up, kind, vtype: F.struct(F.lit(i).alias("node_id"), F.lit(up).cast("int").alias("parent_id"), kind.alias("node_type"), vtype.cast("string").alias("vtype"))
    null, lit = F.lit(None), F.lit
    tree = F.array(
        node(0, None, lit("Message"), null), node(1, 0, F.when(k % 5 == 0, "Element").otherwise("Segment"), null), node(2, 1, lit("Element"), F.when(k % 7 == 0, "null")),
        node(3, 2, F.when(k % 2 == 0, "Field").otherwise("Component"), F.when(k % 3 == 0, "null").otherwise("string")),
    )
    nodes = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit("/x").alias("path"), F.lit("x").alias("name"), F.inline(tree))
    return validate.node_issues(nodes, validate.Config("strict")).select("doc_id", "node_id", "severity", "code")


@query("v18_empty_segment", "SELECT o_orderkey AS key, 'UNS[3]' AS path FROM orders WHERE o_orderkey % 2 = 0")
def v18(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = samples.Writer()
    k = F.col("o_orderkey")
    text_ = F.concat(w("UNH", k.cast("string"), ["ORDERS", "D"]), w("BGM", "220"), w("DTM", "1"), F.when(k % 2 == 0, "UNS'").otherwise("UNS+S'"), w("UNT", "5", "1"))
    found = edifact.messages(table(spark, sf_dir, "orders").select(k.cast("string").alias("source"), text_.alias("text")), custom=False)
    return validate.schemaless_issues(found).select(F.col("message_ref").cast("long").alias("key"), "path")


@query("v19_parse_warnings", "SELECT o_orderkey AS key, 'PARSE_WARNING' AS code, 'warning' AS severity FROM orders WHERE o_orderkey % 7 = 0")
def v19(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edifact.messages(samples.orders_texts(spark, sf_dir, trailer=F.col("o_orderkey") % 7 != 0), custom=False)
    none = schemas.Schema("S", "1", tuple(schemas.Segment(s.tag, tuple(el(f"e{i + 1}") for i in range(6))) for s in (*ORDERS.segments, seg("PIA"))))
    rows = validate.with_parse_warnings(validate.issues(found, none), edifact.warnings(found))
    return rows.select(F.col("message_ref").cast("long").alias("key"), "code", "severity")


@query("v23_strictness", "SELECT s.strictness, CASE s.strictness WHEN 'lenient' THEN 'warning' WHEN 'strict' THEN 'error' ELSE c.severity END AS severity, c.code, CASE c.code WHEN 'UNKNOWN_SEGMENT' THEN (SELECT count(*) FROM lineitem) ELSE (SELECT 2 * count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) END AS n FROM (VALUES ('strict'), ('standard'), ('lenient')) s(strictness), (VALUES ('UNKNOWN_SEGMENT', 'warning'), ('MISSING_MANDATORY_SEGMENT', 'error')) c(code, severity)")
def v23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages are checked once; a strictness only changes what severity an issue has."""
    found = edifact.grouped(edifact.messages(samples.orders_texts(spark, sf_dir), custom=False, tags=set()))
    counts = validate.issues(found, ORDERS, only={"UNKNOWN_SEGMENT", "MISSING_MANDATORY_SEGMENT"}).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.struct(F.lit(s).alias("strictness"), validate.severity_at(s, F.col("severity")).alias("severity")) for s in ("strict", "standard", "lenient")])
    return counts.select("code", "n", F.inline(levels).alias("strictness", "level")).groupBy("strictness", F.col("level").alias("severity"), "code").agg(F.sum("n").alias("n"))


# --- C: schemas ---------------------------------------------------------------------------------------------------------


@query("c04_schema_merge", "SELECT * FROM (VALUES (0, 'CUX', 1, true), (1, 'BGM', 3, true), (2, 'UNH', 2, true)) v(pos, tag, elements, mandatory)")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = schemas.Schema("BASE", "1", (seg("UNH", el("e1"), el("e2"), must=True), seg("BGM", el("e1"), el("e2"), must=True)))
    child = schemas.Schema("OWN", "1", (seg("CUX", el("e1"), must=True), seg("BGM", el("e2", high=5), el("e9"))), ("BASE", "1"))
    merged = schemas.Loader().add(base, child).load_merged("OWN", "1")
    return spark.createDataFrame([(i, s.tag, len(s.elements), s.is_mandatory) for i, s in enumerate(merged.segments)], "pos int, tag string, elements int, mandatory boolean")


# --- K: sinks ------------------------------------------------------------------------------------------------------------


@query("k01_native_roundtrip", "SELECT o_orderkey::VARCHAR AS source, true AS same FROM orders")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = samples.orders_texts(spark, sf_dir)
    kept = texts.withColumn("wire", F.col("text"))
    found = edifact.messages(kept, custom=False)
    return found.select("source", (wire.message_text(F.col("segs"), between="") == F.col("wire")).alias("same"))


@query("k02_mapped_fields", "SELECT o_orderkey AS key, 'BGM+220+' || o_orderkey || '''' || chr(10) || 'MOA+86:' || o_totalprice::DECIMAL(18,2)::VARCHAR || '''' AS wire FROM orders")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapped(spark, sf_dir, field("/BGM/e1", "BGM.e1"), field("/BGM/e2", "BGM.e2"), field("/MOA/e1/c1", "MOA.e1.c1"), field("/MOA/e1/c2", "MOA.e1.c2"))
    return wire.mapped_text(out, ["BGM.e1", "BGM.e2", "MOA.e1.c1", "MOA.e1.c2"]).select("key", "wire")


@query("k03_qualifier_targets", "SELECT o_orderkey AS key, 'NAD+BY+' || o_custkey || '''' || chr(10) || 'DTM+137:' || strftime(o_orderdate, '%Y%m%d') || ':102''' AS wire FROM orders")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapped(spark, sf_dir, field("/NAD/e2/c1", "NAD_BY.e2"), field("/DTM/e1/c2", "DTM137.e1"), field("/DTM/e1/c3", "DTM137.e1.c2"))
    return wire.mapped_text(out, ["NAD_BY.e2", "DTM137.e1", "DTM137.e1.c2"]).select("key", "wire")


@query("k08_csv_lines", CUSTOMER_SQL + "SELECT id, CASE WHEN name LIKE '%,%' OR name LIKE '%\"%' THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END || ';' || coalesce(segment, '-') AS line FROM c")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tabular.typed_rows(customer_cells(spark, sf_dir), CUSTOMER)
    return rows.select("id", wire.csv_line([F.col("name"), F.col("segment")], ";", "-").alias("line"))


@query("k12_json_output", f"SELECT o_orderkey AS key, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS total, count(l_orderkey) AS n FROM orders LEFT JOIN ({NUMBERED}) ON o_orderkey = l_orderkey GROUP BY 1")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapped(spark, sf_dir, each("/LINE_ITEM", "lines", field("QTY/e1/c2", "q")))
    as_json = out.select(F.to_json(F.struct("key", "lines")).alias("j"))
    back = as_json.select(F.from_json("j", "key long, lines array<struct<q:string>>").alias("d"))
    return back.select("d.key", F.aggregate("d.lines", F.lit(0).cast("long"), lambda a, x: a + x["q"].cast("long")).alias("total"), F.size("d.lines").cast("long").alias("n"))


@query("k14_tree_csv", "SELECT event_id AS doc_id, x.node_id, CASE x.node_id WHEN 0 THEN 'document,Root,' ELSE 'k,Field,' || json_extract_string(props, '$.k') END AS line FROM events, (VALUES (0), (1)) x(node_id) WHERE x.node_id = 0 OR json_extract_string(props, '$.k') IS NOT NULL")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.tree_csv(trees.json_nodes(table(spark, sf_dir, "events"), "event_id", "props"))


@query("k15_tree_xml", "SELECT n_nationkey, '<nation><name>' || n_name || '</name><region>' || n_regionkey || '</region><_st></_st></nation>' AS xml FROM nation")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", wire.xml_record("nation", [("name", F.col("n_name")), ("region", F.col("n_regionkey")), ("1st", F.lit(None))]).alias("xml"))


@query("k16_wire_variant", "SELECT o_orderkey AS key, 'NAD+BY+' || o_custkey || '::9''' AS whole, 'NAD+BY+' || o_custkey || ':9''' AS dropped FROM orders")
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edifact.messages(samples.orders_texts(spark, sf_dir), custom=False)
    nad = syntax.first_segment(F.col("segs"), "NAD")
    blank = F.transform(F.col("nad.el"), lambda e: F.struct(e["v"].alias("v"), F.transform(e["c"], lambda c: F.when(c != "", c)).alias("c")))
    rows = fixed(fixed(found, nad=nad), bare=F.struct(F.lit("NAD").alias("tag"), blank.alias("el")))
    return rows.select(F.col("message_ref").cast("long").alias("key"), wire.segment_text(F.col("nad")).alias("whole"), wire.segment_text(F.col("bare"), trim=False, drop_null=True).alias("dropped"))


@query("m04_generate", """
SELECT 0 AS part, min(s_suppkey) AS s_suppkey, 'BGM+220+' || arg_min(s_name, s_suppkey) || '''' AS text FROM supplier UNION ALL
SELECT 1, s_suppkey, 'LIN+' || s_suppkey || '''' || chr(10) || 'QTY+21:' || s_nationkey || '''' FROM supplier UNION ALL
SELECT 2, min(s_suppkey), 'UNS+S''' FROM supplier""")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda x: {"op": "concatenate", "values": [{"type": "literal", "value": x}]}
    m = mapping(field("s_name", "BGM.e1", lit("220")), field("/rows/row/s_name", "BGM.e2"), each("/rows/row", "lines", field("s_suppkey", "LIN.e1"), field("s_nationkey", "QTY21.e1")), field("s_name", "UNS.e1", lit("S")), target="EANCOM_ORDERS")
    return engine.Engine(spark).generate(table(spark, sf_dir, "supplier"), m, ["s_suppkey"]).select("part", "s_suppkey", "text")


@query("k20_insert", "SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT n_nationkey + 100000, n_name, NULL FROM nation")
def k20(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100000).cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return tables.insert(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), new)


@query("k21_update", "SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 'moved' ELSE s_name END AS s_name, s_nationkey FROM supplier")
def k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.update(table(spark, sf_dir, "supplier"), {"s_nationkey": 7}, {"s_name": "moved"}).select("s_suppkey", "s_name", "s_nationkey")


@query("k22_upsert", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, n_name || ' 3' FROM nation")
def k22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key comes three times; the last by its number stays, though another name is larger."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f" {s}").alias("end")) for i, s in ((3, 3), (1, 9), (2, 1))]))
    new = table(spark, sf_dir, "nation").select("*", each.alias("x")).select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.concat("n_name", "x.end").alias("s_name"), "x.at")
    return tables.upsert(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), new, "s_suppkey", ["at"])


@query("k25_tree_to_rows", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def k25(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"rows": ['), "props", F.lit("]}")).alias("doc"))
    out = documents.rows(trees.json_nodes(listed, "event_id", "doc"), {"k": "bigint"})
    return out.filter("k is not null").select(F.col("doc_id").alias("event_id"), "k")


@query("k27_row_check", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 's_name must not be null' END AS error FROM supplier")
def k27(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")))
    return rows.select("s_suppkey", tables.row_error(rows, SUPPLIER).alias("error"))


@query("k30_control_numbers", "SELECT o_orderkey, lpad((dense_rank() OVER (ORDER BY o_custkey) + 41)::VARCHAR, 14, '0') AS interchange_ref, lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR, 6, '0') AS message_ref FROM orders")
def k30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.control_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 42).select("o_orderkey", "interchange_ref", "message_ref")


@query("k31_una_roundtrip", "SELECT * FROM (VALUES ('UNA:+.? ''', 'UNA:+.? '''), ('UNA^|.! ~', 'UNA^|.! ~'), ('UNH+1', 'UNA:+.? ''')) v(head, una)")
def k31(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("UNA:+.? '",), ("UNA^|.! ~",), ("UNH+1",)], "head string").withColumn("s", syntax.una_struct(F.col("head")))
    return rows.select("head", syntax.una_text(F.col("s")).alias("una"))


# --- B: batches, policies, quarantine -----------------------------------------------------------------------------------


@query("b01_batches", "SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3)::BIGINT AS batch FROM orders")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 3, ["o_orderkey"], ["o_custkey"])


@query("b02_item_results", "SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN CASE WHEN o_orderkey % 4 < 3 THEN 'retry' ELSE 'failed' END ELSE 'failed' END AS result FROM orders")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failed").otherwise("pending")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), s.alias("status"), (F.col("o_orderkey") % 4).alias("retry_count"))
    return outcome.item_results(items, 3).select("key", "result")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = outcomes(spark, sf_dir).filter("outcome = 'failed'").withColumn("source", F.concat(F.lit("in/"), F.col("customer").cast("string"), F.lit(".edi"))).withColumn("msg_idx", F.col("key"))
    q = outcome.quarantined(bad, F.lit("mapping"), F.col("key").cast("string"), F.to_timestamp(F.lit("2024-01-01")))
    return q.withColumn("retry_count", (F.col("payload").cast("long") % 5).cast("int"))


@query("b05_quarantine_retryable", f"""
SELECT 'in-' || customer || '-edi' || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS id, key::VARCHAR AS payload, (key % 5)::INTEGER AS retry_count
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY key) AS r FROM ({OUTCOME}) WHERE outcome = 'failed') WHERE key % 5 < 3""")
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.retryable(entries(spark, sf_dir)).select("id", "payload", "retry_count")


@query("b05_quarantine_retried", f"SELECT key::VARCHAR AS payload, (key % 5 + CASE WHEN key % 5 < 3 THEN 1 ELSE 0 END)::INTEGER AS retry_count, key % 5 >= 2 AS permanent FROM ({OUTCOME}) WHERE outcome = 'failed' AND key % 2 = 0")
def b05_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = entries(spark, sf_dir)
    return outcome.retried(all_, all_.filter("payload % 2 = 1")).select("payload", "retry_count", "permanent")


@query("b06_policy_split", f"""
SELECT p.policy, o.key FROM ({OUTCOME}) o, (VALUES ('accept_all'), ('quarantine'), ('fail_all')) p(policy)
WHERE p.policy = 'accept_all' OR (p.policy = 'quarantine' AND o.outcome <> 'failed') OR (p.policy = 'fail_all' AND o.customer NOT IN (SELECT customer FROM ({OUTCOME}) WHERE outcome = 'failed'))""")
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = outcomes(spark, sf_dir), None
    for p in ("accept_all", "quarantine", "fail_all"):
        one = outcome.split(rows, p, "customer" if p == "fail_all" else None).accepted.select(F.lit(p).alias("policy"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@query("b07_message_outcome", OUTCOME)
def b07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("key", "customer", "outcome")


@query("b11_quarantine_stats", f"SELECT count(*) AS current, sum(key % 5)::BIGINT AS retries, 0::BIGINT AS permanent FROM ({OUTCOME}) WHERE outcome = 'failed'")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.quarantine_stats(entries(spark, sf_dir))


# --- D: diagnostics -----------------------------------------------------------------------------------------------------


@query("d01_lint", "SELECT * FROM (VALUES (0, 'rule 1 (field): selector of QTY in ''/QTY[]/e1'' can match nothing'), (1, 'rule 2 (foreach) > rule 1 (field): segment BGN in ''/BGN/e1'' is not in ORDERS: D96A; did you mean BGM?')) v(no, said)")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = diagnostics.lint(mapping(field("/QTY[]/e1", "a"), each("/LINE_ITEM", "x", field("/BGN/e1", "b"))), ORDERS)
    return spark.createDataFrame(list(enumerate(said)), "no int, said string")


@query("d04_trace", "SELECT o_orderkey AS key, x.rule_no, x.rule_type, CASE x.rule_no WHEN 2 THEN n::INTEGER WHEN 1 THEN (o_orderstatus = 'O')::INTEGER ELSE 1 END AS count, CASE x.rule_no WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN (o_orderstatus = 'O')::VARCHAR END AS output FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), (VALUES (0, 'field'), (1, 'condition'), (2, 'foreach')) x(rule_no, rule_type)")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mapping(field("/BGM/e2", "key"), when(IS_O, [field("/BGM/e1", "x")]), each("/LINE_ITEM", "lines", field("LIN/e1", "n")))
    return diagnostics.trace(orders(spark, sf_dir), m, ("message_ref",)).select(F.col("message_ref").cast("long").alias("key"), "rule_no", "rule_type", "count", "output")


def queries() -> dict[str, Query]:
    from tradewire import catalog_documents  # noqa: F401  adds its own
    from tradewire.streaming import samples as streams

    return QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    from tradewire import catalog_documents  # noqa: F401  adds its own
    from tradewire.streaming import samples as streams

    return SQL | streams.SQL


__all__ = ["extensions", "oracle_sql", "queries"]
