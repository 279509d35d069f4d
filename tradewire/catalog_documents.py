"""Further queries for the driver: written documents and envelopes, trees as records, issues of single kinds, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire import samples
from tradewire.catalog import compiler, edifact, el, envelope, field, issued, mapping, query, schemas, seg, table, trees, validate, wire
from tradewire.operators import documents, outcome


@query("s06_parse_errors", """
SELECT o_orderkey AS key, 1 AS seg_idx, 'expected segment tag (3 characters)' AS error, (1 + o_orderkey % 3)::INTEGER AS line,
  CASE WHEN o_orderkey % 3 = 0 THEN length('UNH+' || o_orderkey || '+ORDERS:D''') + 1 ELSE 1 END::INTEGER AS "column"
FROM orders WHERE o_orderkey % 4 = 0""")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, k = samples.Writer(), F.col("o_orderkey")
    breaks = F.when(k % 3 == 0, "").when(k % 3 == 1, "\r\n").otherwise("\n\r")
    text = F.concat(w("UNH", k.cast("string"), ["ORDERS", "D"]), breaks, F.when(k % 4 == 0, "b1d+1'").otherwise("BGM+1'"), w("UNT", "3", "1"))
    found = edifact.parse_errors(table(spark, sf_dir, "orders").select(k.cast("string").alias("source"), text.alias("text")))
    return found.select(F.col("source").cast("long").alias("key"), "seg_idx", "error", "line", "column")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as JSON texts: an array of their nations."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("all"))
    return trees.json_nodes(n.select("n_regionkey", F.to_json("all").alias("text")), "n_regionkey", "text")


@query("k09_tree_records", """
SELECT CAST(NULL AS BIGINT) AS doc_id, -1 AS record, 'id,name' AS line UNION ALL
SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER, n_nationkey || ',' || n_name FROM nation""")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.csv(regions(spark, sf_dir))


@query("k15_nested_xml", """
SELECT n_regionkey AS doc_id, '<document><document><rows>' || string_agg('<item><id>' || n_nationkey || '</id><name>' || n_name || '</name></item>', '' ORDER BY n_nationkey) || '</rows></document></document>' AS xml
FROM nation GROUP BY 1""")
def k15_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.xml(regions(spark, sf_dir))


@query("k12_documents", """
SELECT o_custkey::VARCHAR AS source, CASE WHEN count(*) = 1 THEN any_value('{"key":"' || o_orderkey || '"}') ELSE '[' || string_agg('{"key":"' || o_orderkey || '"}', ',' ORDER BY o_orderkey) || ']' END AS json
FROM orders GROUP BY 1""")
def k12_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edifact.grouped(edifact.messages(samples.customer_interchanges(spark, sf_dir), custom=False))
    return documents.json(compiler.transform(found, mapping(field("/BGM/e2", "key")), ("source", "msg_idx")), ["key"])


@query("k29_envelope_roundtrip", """
SELECT lpad((dense_rank() OVER (ORDER BY o_custkey) + 6)::VARCHAR, 14, '0') AS control_ref, count(*)::INTEGER AS messages, CAST(NULL AS VARCHAR) AS error, 0::BIGINT AS bad_messages, (3 * count(*))::BIGINT AS declared
FROM orders GROUP BY o_custkey""")
def k29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in written envelopes, one interchange for each customer, read back and checked."""
    w, lit = samples.Writer(), F.lit
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", w("BGM", "220", F.col("o_orderpriority"), lit("x+'y?")).alias("body"))
    made = wire.documents(o, "o_custkey", "o_orderkey", lit("US"), lit("THEM"), lit("240101"), lit("1200"), lit("ORDERS"), first_interchange=7, between="")
    texts = made.select(F.col("o_custkey").cast("string").alias("source"), "text")
    files = envelope.check_interchanges(edifact.tokenized(texts, custom=False)).select("source", "control_ref", "messages", "error")
    each = envelope.check_messages(edifact.messages(texts, custom=False)).groupBy("source").agg(F.count("error").alias("bad_messages"), F.sum(F.col("declared_segments").cast("long")).alias("declared"))
    return files.join(each, "source").drop("source")


@query("v20_envelope_kinds", """
SELECT o_custkey::VARCHAR AS source, CASE WHEN o_custkey % 5 = 0 THEN 'IncorrectMessageCount' WHEN o_custkey % 3 = 0 THEN 'InvalidSyntaxIdentifier' END AS error FROM orders GROUP BY o_custkey""")
def v20_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    texts = samples.customer_interchanges(spark, sf_dir, count_shift=F.when(k % 5 == 0, 1).otherwise(0), syntax=F.when(k % 3 == 0, "UNOX").otherwise("UNOC"))
    return envelope.check_interchanges(edifact.tokenized(texts, custom=False)).select("source", "error")


@query("v20_orphans", """
SELECT o_custkey::VARCHAR AS source, 'OrphanedSegment' AS error, 2 AS count FROM orders GROUP BY o_custkey HAVING o_custkey % 3 = 0
UNION ALL SELECT o_custkey::VARCHAR, 'OrphanedMessage', 1 FROM orders GROUP BY o_custkey HAVING o_custkey % 5 = 0""")
def v20_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("source").cast("long")
    more = [F.when(k % 5 == 0, "UNH+9+ORDERS:D'BGM+1'UNT+3+9'").otherwise(""), F.when(k % 3 == 0, "FTX+1'FTX+2'").otherwise("")]
    texts = samples.customer_interchanges(spark, sf_dir).withColumn("text", F.concat("text", *more))
    return envelope.orphans(edifact.tokenized(texts, custom=False)).select("source", "error", "count")


@query("v20_message_types", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'InvalidMessageType' END AS error FROM orders")
def v20_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, k = samples.Writer(), F.col("o_orderkey")
    key = k.cast("string")
    kind = [F.when(k % 2 == 0, "ORDERZ").otherwise("orders"), "D", "96A", F.when(k % 3 == 0, "XX").otherwise("UN")]
    text = F.concat(w("UNH", key, kind), w("BGM", "1"), w("UNT", "3", key))
    found = edifact.messages(table(spark, sf_dir, "orders").select(key.alias("source"), text.alias("text")), custom=False)
    return envelope.check_messages(found).select(F.col("message_ref").cast("long").alias("key"), "error")


@query("v03_segment_empty", "SELECT o_orderkey AS key, 'UNS[3]' AS path, 'MANDATORY_SEGMENT_EMPTY' AS code FROM orders WHERE o_orderkey % 2 = 0")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, k = samples.Writer(), F.col("o_orderkey")
    text = F.concat(w("UNH", k.cast("string"), ["ORDERS", "D"]), w("BGM", "220"), w("DTM", "1"), F.when(k % 2 == 0, "UNS'").otherwise("UNS+S'"), w("UNT", "5", "1"))
    found = edifact.grouped(edifact.messages(table(spark, sf_dir, "orders").select(k.cast("string").alias("source"), text.alias("text")), custom=False))
    rows = validate.issues(found, schemas.Schema("S", "1", (seg("UNS", el("e1"), must=True),)), only={"MANDATORY_SEGMENT_EMPTY"})
    return rows.select(F.col("message_ref").cast("long").alias("key"), "path", "code")


@query("v11_codelist", """
SELECT o_orderkey AS key, 'BGM[1]/e2' AS path, 'code ''' || o_orderkey || ''' is not in list n_e2' AS message FROM orders WHERE o_orderkey NOT IN (1, 2, 3, 100)""")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = validate.Codes({"n_e2": ("1", "2", "3", "100")})
    return issued(spark, sf_dir, codes=codes, only={"CODELIST_VIOLATION"}).select("key", "path", "message")


@query("v16_occurrences", """
SELECT o_orderkey AS key, 'SEGMENT_ORDER_VIOLATION' AS code, 'Segment ''LIN'' occurs ' || count(*) || ' times, maximum allowed is 3' AS message
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 3""")
def v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issued(spark, sf_dir, occurs=[validate.Occurs("LIN", 0, 3)], only={"SEGMENT_ORDER_VIOLATION"}).select("key", "code", "message")


@query("v17_conditional", """
SELECT o_orderkey AS key, 'CONDITIONAL_RULE_VIOLATION' AS code, 'Field ''LIN/e1'' is required when ''RFF/e1/c2'' is ''5-LOW''' AS message
FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def v17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [validate.Conditional("BGM/e1", "220", ("MOA/e1/c2",)), validate.Conditional("RFF/e1/c2", "5-LOW", ("LIN/e1",))]
    return issued(spark, sf_dir, conditionals=rules, only={"CONDITIONAL_RULE_VIOLATION"}).select("key", "code", "message")


@query("j09_warnings_of_files", "SELECT o_custkey::VARCHAR AS source, count(*) AS n FROM orders GROUP BY 1")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warning that names no message of its file goes to the first one."""
    found = edifact.messages(samples.customer_interchanges(spark, sf_dir), custom=False)
    said = found.select("source", "msg_idx", F.when(F.col("msg_idx") % 2 == 0, F.col("message_ref")).otherwise("?").alias("message_ref"), F.lit("x").alias("message"))
    own = validate.of_first_message(said, found)
    known = found.select("source", "msg_idx", "message_ref").toDF("s", "i", "r")
    met = own.join(known, (F.col("source") == F.col("s")) & (F.col("msg_idx") == F.col("i")) & (F.col("message_ref") == F.col("r")))
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a11_file_counts", """
SELECT o_custkey::VARCHAR AS source, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE count(*) END AS messages, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS errors,
  o_custkey % 4 <> 0 AS is_valid, CASE WHEN o_custkey % 4 = 0 THEN 'empty document' END AS error FROM orders GROUP BY o_custkey""")
def a11_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = samples.customer_interchanges(spark, sf_dir).withColumn("text", F.when(F.col("source").cast("long") % 4 == 0, F.lit("")).otherwise(F.col("text")))
    found = edifact.grouped(edifact.messages(files, custom=False))
    return validate.file_summary(files, found, validate.schemaless_issues(found)).select("source", "messages", "errors", "is_valid", "error")


@query("b08_retries", """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 > 2 THEN 'refused' END AS error, least(o_orderkey % 5 + 1, 3)::INTEGER AS attempts FROM orders""")
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are refused as often as their key says, tried three times."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return outcome.with_retries(items, lambda df, n: df.withColumn("error", F.when(F.col("key") % 5 >= n, "refused")), 2)
