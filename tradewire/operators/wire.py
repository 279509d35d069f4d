"""Writing the wire format and the other text outputs, as expressions over arrays of segments or target columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewire.functions.syntax import DEFAULT, Separators
from tradewire.functions.text import escape_csv, escape_wire, escape_xml, xml_name


def joined(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep, "")


def element_text(e: Column, sep: Separators = DEFAULT, drop_null: bool = False) -> Column:
    specials = sep.release + sep.element + sep.component + sep.segment
    parts = F.filter(e["c"], lambda c: c.isNotNull()) if drop_null else e["c"]
    whole = joined(F.transform(parts, lambda c: escape_wire(c, sep.release, specials)), sep.component)
    return F.coalesce(F.when(e["c"].isNotNull(), whole), escape_wire(e["v"], sep.release, specials), F.lit(""))


def segment_text(s: Column, sep: Separators = DEFAULT, trim: bool = True, drop_null: bool = False) -> Column:
    """Tag, elements, terminator; empty elements at the end go with `trim`."""
    texts = F.transform(s["el"], lambda e: element_text(e, sep, drop_null))
    if trim:
        full = F.filter(F.transform(texts, lambda t, i: F.when(t != "", i + 1)), lambda i: i.isNotNull())
        texts = F.slice(texts, F.lit(1), F.coalesce(F.array_max(full), F.lit(0)))
    return F.concat(s["tag"], F.when(F.size(texts) > 0, F.concat(F.lit(sep.element), joined(texts, sep.element))).otherwise(""), F.lit(sep.segment))


def message_text(segs: Column, sep: Separators = DEFAULT, between: str = "\n", trim: bool = True, drop_null: bool = False) -> Column:
    return joined(F.transform(segs, lambda s: segment_text(s, sep, trim, drop_null)), between)


# --- from mapped targets -------------------------------------------------------------------------------------------


@dataclass
class Planned:
    """A segment that is put together from target columns: slots (element, component or None) -> column name."""

    tag: str
    fixed: dict[tuple[int, int | None], str]
    slots: dict[tuple[int, int | None], str] = field(default_factory=dict)

    def takes(self, at: tuple[int, int | None]) -> bool:
        used = {**self.fixed, **self.slots}
        if at in used:
            return False
        return not any(e == at[0] and (c is None) != (at[1] is None) for e, c in used)


class WireError(ValueError):
    """Targets that cannot be written as segments."""


TARGET = re.compile(r"^([A-Z]{3})([0-9]+|_[A-Za-z0-9]+)?\.e([1-9][0-9]*)(?:\.c([1-9][0-9]*))?$")


def planned(targets: list[str]) -> list[Planned]:
    """Targets in order to segments: consecutive ones merge until a slot is taken, then a new segment starts.

    `NAD_BY` has BY as its first element; `QTY21` has 21 as the first component of its first element, and what is
    mapped to e1 moves behind it.
    """
    out: list[Planned] = []
    owner = None
    for target in targets:
        m = TARGET.match(target)
        if not m:
            continue
        tag, own, e, c = m[1], m[2] or "", int(m[3]), int(m[4]) if m[4] else None
        fixed: dict[tuple[int, int | None], str] = {}
        if own.startswith("_"):
            fixed = {(1, None): own[1:]}
        elif own:
            fixed = {(1, 1): own}
            if e == 1:
                c = 2 if c is None else c + 1
        if not out or owner != (tag, own) or not out[-1].takes((e, c)):
            out.append(Planned(tag, fixed))
            owner = (tag, own)
            if not out[-1].takes((e, c)):
                raise WireError(f"{target} does not fit into a new {tag}{own} segment")
        out[-1].slots[(e, c)] = target
    if not out:
        raise WireError("no target names a segment")
    return out


def planned_text(p: Planned, sep: Separators = DEFAULT) -> Column:
    """Null if none of its columns has a value; gaps are filled, empty ends trimmed."""
    specials = sep.release + sep.element + sep.component + sep.segment
    at = {k: F.lit(v) for k, v in p.fixed.items()} | {k: F.coalesce(escape_wire(F.col(f"`{v}`").cast("string"), sep.release, specials), F.lit("")) for k, v in p.slots.items()}
    parts = []
    for e in range(1, max(k[0] for k in at) + 1):
        own = {c: x for (k, c), x in at.items() if k == e}
        if None in own:
            parts.append(own[None])
        elif own:
            comps = [own.get(c, F.lit("")) for c in range(1, max(own) + 1)]
            # Separators at the end go only if nothing stands behind them: those of released characters stay.
            parts.append(_trimmed(comps, sep.component))
        else:
            parts.append(F.lit(""))
    body = _trimmed(parts, sep.element)
    filled = F.coalesce(*[F.col(f"`{v}`").cast("string") for v in p.slots.values()]).isNotNull()
    return F.when(filled, F.concat(F.lit(p.tag), F.when(body == "", "").otherwise(F.concat(F.lit(sep.element), body)), F.lit(sep.segment)))


def _trimmed(parts: list[Column], sep: str) -> Column:
    texts = F.array(*parts)
    full = F.filter(F.transform(texts, lambda t, i: F.when(t != "", i + 1)), lambda i: i.isNotNull())
    return joined(F.slice(texts, F.lit(1), F.coalesce(F.array_max(full), F.lit(0))), sep)


def mapped_text(df: DataFrame, targets: list[str], out: str = "wire", sep: Separators = DEFAULT) -> DataFrame:
    """A row's mapped targets as wire text in column `out`."""
    segs = [planned_text(p, sep) for p in planned(targets)]
    return df.withColumn(out, F.concat_ws("\n", *segs))


# --- envelopes -----------------------------------------------------------------------------------------------------


def _elements(tag: str, parts: list[Column | None], sep: Separators) -> Column:
    """Optional elements stop at the first gap."""
    kept = []
    for p in parts:
        if p is None:
            break
        kept.append(p)
    return F.concat(F.lit(tag), *[x for p in kept for x in (F.lit(sep.element), p)], F.lit(sep.segment))


def unb(sender: Column, receiver: Column, date: Column, time: Column, reference: Column, syntax: str = "UNOA", version: str = "3", recipient_ref: Column | None = None, application_ref: Column | None = None, sep: Separators = DEFAULT) -> Column:
    return _elements("UNB", [F.lit(f"{syntax}{sep.component}{version}"), sender, receiver, F.concat(date, F.lit(sep.component), time), reference, recipient_ref, application_ref], sep)


def unz(count: Column, reference: Column, sep: Separators = DEFAULT) -> Column:
    return _elements("UNZ", [count.cast("string"), reference], sep)


def unh(reference: Column, kind: Column, version: str = "D", release: str = "96A", agency: str = "UN", association: str | None = None, sep: Separators = DEFAULT) -> Column:
    parts = [kind, F.lit(version), F.lit(release), F.lit(agency), *([F.lit(association)] if association else [])]
    return _elements("UNH", [reference, F.concat_ws(sep.component, *parts)], sep)


def unt(count: Column, reference: Column, sep: Separators = DEFAULT) -> Column:
    return _elements("UNT", [count.cast("string"), reference], sep)


def interchange_text(bodies: Column, header: Column, trailer: Column, sep: Separators = DEFAULT, between: str = "\n", service: bool = False) -> Column:
    """One text from an interchange's header, message texts and trailer; `service`: with the service string in front."""
    return F.concat(F.lit(sep.una() if service else ""), F.concat_ws(between, F.array(header), bodies, F.array(trailer)))


def documents(messages: DataFrame, interchange: str, order: str, sender: Column, receiver: Column, date: Column, time: Column, kind: Column, body: str = "body", first_interchange: int = 1, sep: Separators = DEFAULT, between: str = "\n", syntax: str = "UNOA") -> DataFrame:
    """(interchange, interchange_ref, messages, text): numbered messages within their envelopes, a document for each interchange.

    body: a message's segments without header and trailer, each ended by a terminator. sender ... kind: expressions, the
    first four the same for all messages of an interchange. A document is put together in one task.
    """
    numbered = control_numbers(messages, interchange, order, first_interchange)
    # Released terminators do not end a segment.
    ends = F.size(F.regexp_extract_all(F.regexp_replace(F.col(body), f"\\{sep.release}[\\s\\S]", ""), F.lit(f"\\{sep.segment}"), F.lit(0)))
    message = F.concat_ws(between, unh(F.col("message_ref"), kind, sep=sep), F.when(F.col(body) != "", F.col(body)), unt(ends + 2, F.col("message_ref"), sep))
    rows = numbered.select(F.col(interchange), "interchange_ref", "message_ref", message.alias("text"), sender.alias("sender"), receiver.alias("receiver"), date.alias("date"), time.alias("time"))
    each = rows.groupBy(interchange, "interchange_ref").agg(F.sort_array(F.collect_list(F.struct("message_ref", "text"))).alias("m"), *[F.first(c).alias(c) for c in ("sender", "receiver", "date", "time")])
    head = unb(F.col("sender"), F.col("receiver"), F.col("date"), F.col("time"), F.col("interchange_ref"), syntax, sep=sep)
    return each.select(interchange, "interchange_ref", F.size("m").alias("messages"), interchange_text(F.transform("m", lambda x: x["text"]), head, unz(F.size("m"), F.col("interchange_ref"), sep), sep, between).alias("text"))


#: Ranges that interchanges are numbered in.
RANGES = 64


def control_numbers(rows: DataFrame, interchange: str, order: str, first_interchange: int = 1) -> DataFrame:
    """Adds interchange_ref (14 digits, by the interchange key's order) and message_ref (6 digits, from 1 in each).

    `first_interchange` continues from a stored state. Interchanges are numbered by their counts of distinct keys, so no
    task holds all messages; messages of one interchange are numbered in one task, as gaps are not allowed.
    """
    keys = rows.select(interchange).distinct()
    # Ranges are cut at keys of a small sample, which are written into the plan: a key's range does not depend on how the
    # plan runs. Ranges only have to be small enough for one task each.
    sample = [r[0] for r in keys.filter(F.col(interchange).isNotNull()).orderBy(F.xxhash64(interchange)).limit(RANGES).collect()]
    bounds = F.array(*map(F.lit, sorted(sample))).cast(f"array<{keys.schema[0].dataType.simpleString()}>")
    parts = keys.withColumn("_p", F.when(F.col(interchange).isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(interchange)))))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    numbered = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(interchange))).join(F.broadcast(starts), "_p")  # RANGES rows
    refs = numbered.select(interchange, F.lpad((F.coalesce("_before", F.lit(0)) + F.col("_r") + first_interchange - 1).cast("string"), 14, "0").alias("interchange_ref"))
    message = F.row_number().over(Window.partitionBy(interchange).orderBy(order))
    return rows.withColumn("message_ref", F.lpad(message.cast("string"), 6, "0")).join(refs, interchange)


# --- other formats -------------------------------------------------------------------------------------------------


def csv_line(columns: list[Column], delimiter: str = ",", null: str = "") -> Column:
    return F.concat_ws(delimiter, *[F.coalesce(escape_csv(c.cast("string")), F.lit(null)) for c in columns])


def tree_csv(nodes: DataFrame) -> DataFrame:
    """`name,node_type,value` lines of ir_nodes rows, with their order."""
    return nodes.select("doc_id", "node_id", csv_line([F.col("name"), F.col("node_type"), F.col("value")]).alias("line"))


def xml_element(name: Column | str, body: Column) -> Column:
    n = xml_name(F.lit(name) if isinstance(name, str) else name)
    return F.concat(F.lit("<"), n, F.lit(">"), body, F.lit("</"), n, F.lit(">"))


def xml_record(root: str, columns: list[tuple[str, Column]]) -> Column:
    """One flat record; null columns are empty elements."""
    return xml_element(root, F.concat(*[xml_element(n, F.coalesce(escape_xml(c.cast("string")), F.lit(""))) for n, c in columns]))


def target_format(target_type: str) -> str:
    """The output that a target type names: json, csv, xml, then edifact."""
    tokens_ = re.split(r"[^A-Za-z0-9]+", target_type.upper())
    for kind, names in (("json", ("JSON",)), ("csv", ("CSV",)), ("xml", ("XML",)), ("edifact", ("EDI", "EDIFACT", "EANCOM"))):
        if any(t in names for t in tokens_):
            return kind
    raise WireError(f"no output format in target type {target_type}")


def input_format(flag: str | None, path: str, source_type: str) -> str:
    """A flag, else the file's extension, else the source type names it."""
    if flag:
        return flag.lower()
    extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return {"edi": "edifact", "csv": "csv", "json": "json"}.get(extension) or target_format(source_type)
