"""Wire messages made from the relational tables: one ORDERS message for each order, or one interchange per customer.

Lines are numbered by all their columns, as (order, line number) is not unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.functions.syntax import DEFAULT, Separators
from tradewire.functions.text import escape_wire

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def day(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


class Writer:
    """Segment expressions under given separators. A list is a composite."""

    def __init__(self, sep: Separators = DEFAULT) -> None:
        self.sep = sep
        self.specials = sep.release + sep.element + sep.component + sep.segment

    def value(self, x: Column | str | list) -> Column:
        if isinstance(x, list):
            return F.concat_ws(self.sep.component, *map(self.value, x))
        return F.lit(x) if isinstance(x, str) else escape_wire(x, self.sep.release, self.specials)

    def __call__(self, tag: str, *elements: Column | str | list) -> Column:
        return F.concat(F.concat_ws(self.sep.element, F.lit(tag), *map(self.value, elements)), F.lit(self.sep.segment))


def orders_texts(spark: SparkSession, sf_dir: str, sep: Separators = DEFAULT, trailer: Column | None = None, count_shift: Column | None = None) -> DataFrame:
    """(source, text, o_custkey): source is the order key as text. trailer: a condition for a UNT; count_shift: added to its count."""
    w = Writer(sep)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*LINE_ORDER).alias("l"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l")).alias("lines"))

    def line(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        text = lambda c: x[c].cast("string")
        return F.concat(
            w("LIN", n, "", [text("l_partkey"), "EN"]), w("PIA", "1", [x["l_returnflag"], "SA"]), w("QTY", ["21", x["l_quantity"].cast("long").cast("string")]), w("QTY", ["59", text("l_linenumber")]),
            w("PRI", ["AAA", money(x["l_extendedprice"] / x["l_quantity"])]), w("MOA", ["203", money(x["l_extendedprice"])]),
        )

    rows = table(spark, sf_dir, "orders").join(grouped, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(grouped.schema["lines"].dataType)))
    key, n = F.col("o_orderkey").cast("string"), F.size("lines")
    count = 11 + 6 * n + (F.lit(0) if count_shift is None else count_shift)
    unt = w("UNT", count.cast("string"), key)
    head = [
        w("UNH", key, ["ORDERS", "D", "96A", "UN", "EAN008"]), w("BGM", "220", key, "9"), w("DTM", ["137", day(F.col("o_orderdate")), "102"]), w("RFF", ["ON", F.col("o_orderpriority")]),
        w("NAD", "BY", [F.col("o_custkey").cast("string"), "", "9"]), w("NAD", "SU", F.col("o_orderstatus")), w("CUX", ["2", "EUR", "9"]),
    ]
    tail = [w("UNS", "S"), w("CNT", ["2", n.cast("string")]), w("MOA", ["86", money(F.col("o_totalprice"))]), unt if trailer is None else F.when(trailer, unt).otherwise("")]
    text = F.concat(*([F.lit(sep.una())] if sep != DEFAULT else []), *head, F.array_join(F.transform("lines", line), ""), *tail)
    return rows.select(key.alias("source"), text.alias("text"), "o_custkey")


def customer_interchanges(spark: SparkSession, sf_dir: str, count_shift: Column | None = None, syntax: Column | None = None) -> DataFrame:
    """(source, text): an interchange for each customer with orders, of header-only messages in order of their keys."""
    w = Writer()
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderdate").alias("o"))
    each = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("o"))
    cust = F.col("o_custkey").cast("string")
    key = lambda x: x["o_orderkey"].cast("string")
    message = lambda x: F.concat(w("UNH", key(x), ["ORDERS", "D", "96A", "UN"]), w("BGM", "220", key(x), "9"), w("DTM", ["137", day(x["o_orderdate"]), "102"]), w("UNT", "4", key(x)))
    shift = F.lit(0) if count_shift is None else count_shift
    text = F.concat(
        w("UNB", [F.lit("UNOA") if syntax is None else syntax, "3"], cust, "RECEIVER", ["240101", "1200"], F.concat(F.lit("IC"), cust)), F.lit("\n"),
        F.array_join(F.transform("o", message), "\n"), F.lit("\n"), w("UNZ", (F.size("o") + shift).cast("string"), F.concat(F.lit("IC"), cust)),
    )
    return each.select(cust.alias("source"), text.alias("text"))
