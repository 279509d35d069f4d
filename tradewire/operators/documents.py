"""Trees of documents (the rows of sources.trees) as CSV records, XML and JSON texts, and a visitor for one tree.

A document's nodes are put together in one task; documents are what is spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewire.functions.text import escape_xml, xml_name
from tradewire.operators.wire import csv_line


class HeaderError(ValueError):
    """A second header, or none to be had."""


# --- records ---------------------------------------------------------------------------------------------------------


def _placed(nodes: DataFrame, *more: str) -> DataFrame:
    """(doc_id, node_id, ordinal, is_record, and more): records, and their children under the node_id of the record.

    The tree is read once and dealt out once, by document: where a node stands is told by its depth.
    """
    depth = F.col("depth")
    near = nodes.filter(depth.between(1, 3)).select("doc_id", "node_id", "parent_id", "ordinal", "depth", (F.col("node_type") == "SegmentGroup").alias("group"), *more)
    own = Window.partitionBy("doc_id")
    groups = (F.count_if(depth == 1).over(own) == 1) & (F.count_if((depth == 1) & F.col("group")).over(own) == 1) & (F.count_if(depth == 2).over(own) > 0)
    at = near.withColumn("is_record", depth == F.when(groups, 2).otherwise(1)).withColumn("is_child", depth == F.when(groups, 3).otherwise(2))
    return at.filter("is_record or is_child").select("doc_id", F.when(F.col("is_record"), F.col("node_id")).otherwise(F.col("parent_id")).alias("node_id"), "ordinal", "is_record", *more)


def records(nodes: DataFrame) -> DataFrame:
    """(doc_id, record, node_id): what stands for a record of each document, numbered from 0 in its order.

    These are the children of the root's only child if that is a group with children, else the root's children.
    """
    return _placed(nodes).filter("is_record").select("doc_id", F.col("ordinal").alias("record"), "node_id")


def headers(nodes: DataFrame) -> list[str]:
    """The names of the first record's fields, in order."""
    own = records(nodes)
    first = own.orderBy("doc_id", "record").limit(1)
    kids = nodes.select("doc_id", F.col("parent_id").alias("node_id"), "ordinal", "name").join(first, ["doc_id", "node_id"])
    return list(dict.fromkeys(r["name"] for r in kids.orderBy("ordinal").select("name").collect()))


def rows(nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(doc_id, record, and the columns): records as rows of a table, absent fields null. columns: name -> Spark type.

    Of a repeated name the first field counts.
    """
    cell = F.when(~F.col("is_record") & F.col("name").isin(*columns), F.struct("ordinal", "name", "value"))
    wide = _placed(nodes, "name", "value").groupBy("doc_id", "node_id").agg(F.max(F.when(F.col("is_record"), F.col("ordinal"))).alias("record"), F.sort_array(F.collect_list(cell)).alias("cells"))
    first = lambda c: F.get(F.filter("cells", lambda x: x["name"] == c), F.lit(0))["value"]
    return wide.select("doc_id", "record", *[first(c).try_cast(k).alias(c) for c, k in columns.items()])


def csv(nodes: DataFrame, names: list[str] | None = None, header: bool = True, delimiter: str = ",", null: str = "") -> DataFrame:
    """(doc_id, record, line): records as lines; the header once for all, as doc_id null, record -1.

    Names come from a schema, else from the first record.
    """
    names = headers(nodes) if names is None else names
    if not names:
        raise HeaderError("no record to take a header from")
    lines = rows(nodes, dict.fromkeys(names, "string")).select("doc_id", "record", csv_line([F.col(f"`{n}`") for n in names], delimiter, null).alias("line"))
    if not header:
        return lines
    top = nodes.sparkSession.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(-1).alias("record"), csv_line([F.lit(n) for n in names], delimiter, null).alias("line"))
    return top.unionByName(lines)


# --- texts -----------------------------------------------------------------------------------------------------------


def xml(nodes: DataFrame) -> DataFrame:
    """(doc_id, xml): the whole tree, each node an element with its value and its children, within <document>."""
    own = nodes.select("doc_id", "node_id", F.col("parent_id"), "ordinal", xml_name(F.col("name")).alias("tag"), F.coalesce(escape_xml(F.col("value")), F.lit("")).alias("text"))

    def one(t: pa.Table) -> pa.Table:
        got = t.sort_by([("parent_id", "ascending"), ("ordinal", "ascending")]).to_pylist()
        below: dict[int | None, list[dict]] = {}
        for r in got:
            below.setdefault(r["parent_id"], []).append(r)
        out = ["<document>"]
        todo: list[dict | str] = list(reversed(below.get(None, [])))
        while todo:
            r = todo.pop()
            if isinstance(r, str):
                out.append(r)
                continue
            out.append(f"<{r['tag']}>{r['text']}")
            todo.append(f"</{r['tag']}>")
            todo += reversed(below.get(r["node_id"], []))
        return pa.table([pa.array([got[0]["doc_id"]], pa.int64()), pa.array(["".join([*out, "</document>"])], pa.string())], names=["doc_id", "xml"])

    return own.groupBy("doc_id").applyInArrow(one, "doc_id long, xml string")


def json(mapped: DataFrame, columns: list[str], by: str = "source", order: str = "msg_idx", pretty: bool = False) -> DataFrame:
    """(by, json): the messages of a source as one text: one of them is an object, several are an array in order."""
    options = {"pretty": "true"} if pretty else {}
    value = F.struct(*[f"`{c}`" for c in columns])
    own = mapped.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, value.alias("value")))).alias("all"))
    values = F.transform("all", lambda x: x["value"])
    return own.select(by, F.when(F.size(values) == 1, F.to_json(values[0], options)).otherwise(F.to_json(values, options)).alias("json"))


# --- a visitor ---------------------------------------------------------------------------------------------------------


def walk(nodes: Iterable[dict], enter: Callable[[dict], bool | None], leave: Callable[[dict], None] | None = None) -> bool:
    """Goes through one document's nodes in pre-order; enter gives False to end the walk. True if it came to the end."""
    above: list[dict] = []

    def up(to: int) -> Iterator[dict]:
        while above and above[-1]["depth"] >= to:
            yield above.pop()

    for n in sorted(nodes, key=lambda n: n["node_id"]):
        for done in up(n["depth"]):
            if leave:
                leave(done)
        if enter(n) is False:
            return False
        above.append(n)
    for done in up(0):
        if leave:
            leave(done)
    return True


