"""Documents of unknown shape as node rows: (doc_id, node_id, parent_id, ordinal, depth, path, name, node_type, vtype, value).

Shapes are not known to the plan, so this is the one reader in Python: Arrow batches in, pre-order rows out, one document
at a time. Known shapes are read as columns instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id long, node_id int, parent_id int, ordinal int, depth int, path string, name string, node_type string, vtype string, value string"
#: Nodes, and characters of texts, after which a batch of nodes is handed on.
NODES, CHARACTERS = 8192, 1 << 22
_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 5]


def number_text(x: float) -> str:
    """Plain digits, no exponent, no `.0`."""
    if x != x or x in (float("inf"), float("-inf")):
        return str(x)
    text = repr(x)
    if "e" in text or "E" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text


def scalar(x: Any) -> tuple[str, str | None]:
    if x is None:
        return "null", None
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    if isinstance(x, int):
        return ("integer", str(x)) if -(1 << 63) <= x < 1 << 63 else ("string", str(x)) if 0 <= x < 1 << 64 else ("decimal", number_text(float(x)))
    if isinstance(x, float):
        return "decimal", number_text(x)
    return "string", x


def walk(data: Any) -> Iterator[tuple]:
    """Objects are SegmentGroup, arrays a SegmentGroup of `item`, objects in arrays Record, scalars Field."""
    count = 0
    todo: list[tuple] = [(data, "document", None, 0, 0, "", "Root")]
    while todo:
        x, name, parent, ordinal, depth, path, role = todo.pop()
        me, count = count, count + 1
        here = f"{path}/{name}" if depth else ""
        kids: list[tuple[str, Any, str]] = []
        vtype = value = None
        if role == "Root":
            kind = "Root"
            kids = [(k, v, "") for k, v in x.items()] if isinstance(x, dict) else [("rows", x, "")] if isinstance(x, list) else [("value", x, "")]
        elif isinstance(x, dict):
            kind = "Record" if role == "item" else "SegmentGroup"
            kids = [(k, v, "") for k, v in x.items()]
        elif isinstance(x, list):
            kind = "SegmentGroup"
            kids = [("item", v, "item") for v in x]
        else:
            kind = "Field"
            vtype, value = scalar(x)
        yield me, parent, ordinal, depth, here or "/", name, kind, vtype, value
        todo += [(v, k, me, i, depth + 1, here, r) for i, (k, v, r) in reversed(list(enumerate(kids)))]


def json_nodes(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that are no JSON give one node of type Error with the text; null texts give nothing."""

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None:
                    continue
                try:
                    found = walk(json.loads(t))
                except ValueError:
                    found = iter([(0, None, 0, 0, "/", "document", "Error", "string", t)])
                held += len(t)
                for n in found:
                    rows.append((i, *n))
                    if len(rows) >= NODES:
                        yield made(rows)
                        rows, held = [], 0
                if held >= CHARACTERS and rows:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return texts.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)


def properties(texts: DataFrame, text_col: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns for paths of JSON texts, without a shape given beforehand; null where a path or type is not there.

    columns: name -> Spark type, for the name's own path, or path and type, as "$.a.b bigint". All on the JVM.
    """
    out = texts.withColumn("json variant", F.try_parse_json(F.col(text_col)))
    for name, kind in columns.items():
        path, _, own = kind.rpartition(" ")
        out = out.withColumn(name, F.try_variant_get("json variant", path or f"$.{name}", own))
    return out.drop("json variant")


def segment_nodes(found: DataFrame) -> DataFrame:
    """The tree of parsed messages in pre-order: message, segments, elements `eN`, components `cN`. All on the JVM.

    Each node has the tag of its segment, so that a choice of segments needs no shuffle and comes before their trees.
    """
    base = found.select("source", "msg_idx", F.explode("segs").alias("s"))
    struct = lambda depth, name, kind, value, order: F.struct(F.lit(depth).alias("depth"), name.alias("name"), F.lit(kind).alias("node_type"), value.alias("value"), order.alias("order"))
    null, zero = F.lit(None).cast("string"), F.lit(-1)
    num = lambda letter, i: F.concat(F.lit(letter), (i + 1).cast("string"))
    elements = F.transform("s.el", lambda e, i: F.concat(F.array(struct(2, num("e", i), "Element", e["v"], F.array(i, zero))), F.coalesce(F.transform(e["c"], lambda c, j: struct(3, num("c", j), "Component", c, F.array(i, j))), F.array().cast("array<struct<depth:int,name:string,node_type:string,value:string,order:array<int>>>"))))
    rows = F.concat(F.array(struct(1, F.col("s.tag"), "Segment", null, F.array(zero, zero))), F.flatten(elements))
    return base.select("source", "msg_idx", F.col("s.idx").alias("seg_idx"), F.col("s.tag").alias("tag"), F.posexplode(rows).alias("pos", "n")).select("source", "msg_idx", "seg_idx", "tag", "pos", "n.depth", "n.name", "n.node_type", "n.value")


def descend(nodes: DataFrame, name: str | None = None, index: int | None = None) -> DataFrame:
    """Children of all nodes, or those of a name, or the index-th (from 0) of a name in each parent."""
    found = nodes.filter(F.col("parent_id").isNotNull())
    if name is not None:
        found = found.filter(F.col("name") == name)
    if index is None:
        return found
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ordinal")) - 1
    return found.withColumn("place", place).filter(F.col("place") == index).drop("place")
