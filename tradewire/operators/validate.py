"""Validation: segments against a schema, giving issue rows.

The schema is a literal in the plan. All issues of a message come from one expression over its segments, without a
shuffle; only what looks across messages groups anything. Issues carry (phase, seg_idx, check) so their order, and with it
`max_errors`, is the order in which checks run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewire.functions.plan import fixed
from tradewire.plans.schema import Element, Schema, Segment

ISSUE = "struct<phase:int,seg_idx:int,chk:int,severity:string,code:string,path:string,element_pos:int,component_pos:int,message:string>"
FIELDS = ("severity", "code", "path", "seg_idx", "element_pos", "component_pos", "message")


@dataclass(frozen=True)
class Config:
    """strictness: strict (warnings become errors), standard, lenient (errors become warnings). max_errors 0: no limit."""

    strictness: str = "standard"
    continue_on_error: bool = True
    max_errors: int = 0
    validate_codelists: bool = True
    validate_conditionals: bool = True


@dataclass(frozen=True)
class Occurs:
    tag: str
    low: int = 0
    high: int | None = None


@dataclass(frozen=True)
class Conditional:
    """If the first segment named `trigger` has the value, all `required` ones must have a value."""

    trigger: str
    value: str
    required: tuple[str, ...]


@dataclass
class Codes:
    """Code lists by `<data type>_<element id>`; an unknown list allows everything."""

    lists: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ignore_case: frozenset[str] = frozenset()

    def member(self, name: str, value: Column) -> Column | None:
        codes = self.lists.get(name)
        if codes is None:
            return None
        return F.upper(value).isin(*[c.upper() for c in codes]) if name in self.ignore_case else value.isin(*codes)


def _issue(phase: int, seg: Column | int | None, check: int, severity: str, code: str, path: Column, message: Column, element: int | Column | None = None, component: int | None = None) -> Column:
    num = lambda x: (F.lit(x) if x is None or isinstance(x, int) else x).cast("int")
    return F.struct(num(phase).alias("phase"), num(seg).alias("seg_idx"), num(check).alias("chk"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"), num(element).alias("element_pos"), num(component).alias("component_pos"), message.alias("message"))


def type_holds(value: Column, data_type: str) -> Column:
    """a, n, dt and tm; other types hold always. An empty text is fine for a and n."""
    rules = {"a": r"^\p{IsAlphabetic}*$", "n": "^[0-9]*$", "dt": "^[0-9]{8}$", "tm": "^([0-9]{4}|[0-9]{6})$"}
    return value.rlike(rules[data_type].replace("$", r"\z")) if data_type in rules else F.lit(True)


def element_issues(value: Column, e: Element, path: Column, seg: Column, at: int, codes: Codes | None) -> list[Column]:
    """Checks of one element value, in order; each null where it holds. value: null for composites."""
    size = F.octet_length(value)
    base = 10 * at
    out = []
    if e.is_mandatory:
        out.append(F.when(F.coalesce(value, F.lit("")) == "", _issue(1, seg, base + 1, "error", "MANDATORY_ELEMENT_EMPTY", path, F.lit(f"Mandatory element '{e.id}' ({e.name}) has no value"), at)))
    if e.min_length > 0:
        out.append(F.when(size < e.min_length, _issue(1, seg, base + 2, "error", "MIN_LENGTH_VIOLATION", path, F.concat(F.lit(f"Element '{e.id}' length "), size.cast("string"), F.lit(f" is less than minimum {e.min_length} (data type: {e.data_type})")), at)))
    out.append(F.when(size > e.max_length, _issue(1, seg, base + 3, "error", "MAX_LENGTH_VIOLATION", path, F.concat(F.lit(f"Element '{e.id}' length "), size.cast("string"), F.lit(f" exceeds maximum {e.max_length} (data type: {e.data_type})")), at)))
    if e.data_type in ("a", "n", "dt", "tm"):
        out.append(F.when(~type_holds(value, e.data_type), _issue(1, seg, base + 4, "error", "DATA_TYPE_VIOLATION", path, F.concat(F.lit(f"Element '{e.id}' is not of type {e.data_type}: '"), value, F.lit("'")), at)))
    if codes and (ok := codes.member(f"{e.data_type}_{e.id}", value)) is not None:
        out.append(F.when(~ok, _issue(1, seg, base + 5, "error", "CODELIST_VIOLATION", path, F.concat(F.lit("code '"), value, F.lit(f"' is not in list {e.data_type}_{e.id}")), at)))
    return out


def segment_issues(s: Column, schema: Schema, codes: Codes | None = None, only: set[str] | None = None) -> Column:
    """array<issue> of one segment: its definition's checks, or UNKNOWN_SEGMENT. `only`: the former only where some are among these."""
    here = F.concat(s["tag"], F.lit("["), s["idx"].cast("string"), F.lit("]"))
    unknown = F.array(_issue(1, s["idx"], 0, "warning", "UNKNOWN_SEGMENT", here, F.concat(F.lit("Segment '"), s["tag"], F.lit(f"' is not defined in schema {schema.qualified_name}"))))
    if only is not None and not only & set(PER_SEGMENT) - {"UNKNOWN_SEGMENT"}:
        return F.when(s["tag"].isin(*{x.tag for x in schema.segments}), F.array().cast(f"array<{ISSUE}>")).otherwise(unknown)
    out = None
    for d in {x.tag: x for x in reversed(schema.segments)}.values():
        found = definition_issues(s, d, here, codes)
        out = F.when(s["tag"] == d.tag, found) if out is None else out.when(s["tag"] == d.tag, found)
    return unknown if out is None else out.otherwise(unknown)


def definition_issues(s: Column, d: Segment, here: Column, codes: Codes | None = None) -> Column:
    """array<issue> of a segment under one definition, in the order of the checks."""
    n = F.size(s["el"])
    checks = [F.when(n == 0, _issue(1, s["idx"], 0, "error", "MANDATORY_SEGMENT_EMPTY", here, F.lit(f"Mandatory segment '{d.tag}' has no elements")))] if d.is_mandatory else []
    for i, e in enumerate(d.elements):
        path = F.concat(here, F.lit(f"/{e.id}"))
        if e.id != f"e{i + 1}":
            checks.append(F.when(n > i, _issue(1, s["idx"], 10 * i, "warning", "ELEMENT_ID_MISMATCH", path, F.lit(f"Expected element '{e.id}', found 'e{i + 1}'"), i)))
        own = F.get(s["el"], F.lit(i))
        checks += [F.when(n > i, c) for c in element_issues(own["v"], e, path, s["idx"], i, codes)]
    missing = [F.when(n <= i, _issue(1, s["idx"], 200_000 + i, "error", "MISSING_MANDATORY_ELEMENT", F.concat(here, F.lit(f"/{e.id}")), F.lit(f"Mandatory element '{e.id}' ({e.name}) is missing at position {i}"), i)) for i, e in enumerate(d.elements) if e.is_mandatory]
    nothing = F.array().cast(f"array<{ISSUE}>")
    some = lambda x: F.filter(F.array(*x), lambda y: y.isNotNull()) if x else nothing
    known = len(d.elements)
    extra = F.when(n > known, F.transform(F.sequence(F.lit(known), n - 1), lambda i: _issue(1, s["idx"], 100_000, "warning", "EXTRA_ELEMENT", F.concat(here, F.lit("/e"), (i + 1).cast("string")), F.concat(F.lit("Element 'e"), (i + 1).cast("string"), F.lit("' at position "), i.cast("string"), F.lit(" is not defined in schema")), i))).otherwise(nothing)
    return F.concat(some(checks), extra, some(missing))


def single_segment_issues(s: Column, d: Segment, codes: Codes | None = None) -> Column:
    """One segment held directly against one definition: a wrong tag is an issue too."""
    wrong = F.when(s["tag"] != d.tag, _issue(1, s["idx"], 0, "error", "SEGMENT_TAG_MISMATCH", s["tag"], F.concat(F.lit(f"Expected segment '{d.tag}', found '"), s["tag"], F.lit("'"))))
    return F.concat(F.filter(F.array(wrong), lambda x: x.isNotNull()), definition_issues(s, d, s["tag"], codes))


def node_issues(nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """Issues of tree rows (doc_id, node_id, parent_id, path, name, node_type, vtype) against what stands above them.

    A node right under a message or group must be a segment or group, one under an element a component; in strict mode
    explicit nulls in elements and components are errors.
    """
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("above"))
    rows = nodes.join(up, ["doc_id", "parent_id"], "left")
    n, strict = F.col("node_type"), F.lit(config.strictness == "strict")
    kind = lambda severity, code: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    checks = F.array(
        F.when(F.col("above").isin("Message", "SegmentGroup") & n.isin("Element", "Component"), kind("error", "TYPE_MISMATCH")),
        F.when((F.col("above") == "Element") & (n != "Component"), kind("warning", "EXPECTED_COMPONENT")),
        F.when(strict & (F.col("vtype") == "null") & (n == "Component"), kind("error", "NULL_COMPONENT_VALUE")),
        F.when(strict & (F.col("vtype") == "null") & (n == "Element"), kind("error", "NULL_VALUE")),
    )
    out = rows.select("doc_id", "node_id", "path", F.inline(F.filter(checks, lambda x: x.isNotNull())))
    level = {"strict": "error", "lenient": "warning"}.get(config.strictness)
    return out.withColumn("severity", F.lit(level)) if level else out


def line_item_tags(schema: Schema) -> list[str]:
    """Mandatory tags from LIN up to UNS, CNT or UNT, in the schema's order."""
    tags, inside = [], False
    for s in schema.segments:
        if s.tag == "LIN":
            inside = True
        elif inside and s.tag in ("UNS", "CNT", "UNT"):
            break
        if inside and s.is_mandatory:
            tags.append(s.tag)
    return tags


def code_union(*lists: tuple[DataFrame, str]) -> DataFrame:
    """(code): the distinct codes of columns of tables."""
    out = None
    for df, c in lists:
        one = df.select(F.col(f"`{c}`").alias("code"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def occurrence_violation(segs: Column, rules: list[Occurs]) -> Column:
    """The message of the first rule that is broken."""
    said = []
    for r in rules:
        n = F.size(F.filter(segs, lambda s: s["tag"] == r.tag))  # noqa: B023
        said.append(F.when(n < r.low, F.concat(F.lit(f"Segment '{r.tag}' occurs "), n.cast("string"), F.lit(f" times, minimum required is {r.low}"))))
        if r.high is not None:
            said.append(F.when(n > r.high, F.concat(F.lit(f"Segment '{r.tag}' occurs "), n.cast("string"), F.lit(f" times, maximum allowed is {r.high}"))))
    return F.coalesce(*said)


def conditional_violation(nodes: Column, rules: list[Conditional]) -> Column:
    """The message of the first rule that is broken. nodes: array of structs with name and value."""
    said = []
    for r in rules:
        first = F.get(F.filter(nodes, lambda x: x["name"] == r.trigger), F.lit(0))["value"]  # noqa: B023
        for need in r.required:
            there = F.exists(nodes, lambda x: (x["name"] == need) & x["value"].isNotNull())  # noqa: B023
            said.append(F.when((first == r.value) & ~there, F.lit(f"Field '{need}' is required when '{r.trigger}' is '{r.value}'")))
    return F.coalesce(*said)


#: Codes of checks that go over each segment.
PER_SEGMENT = ("UNKNOWN_SEGMENT", "MANDATORY_SEGMENT_EMPTY", "ELEMENT_ID_MISMATCH", "MANDATORY_ELEMENT_EMPTY", "MIN_LENGTH_VIOLATION", "MAX_LENGTH_VIOLATION", "DATA_TYPE_VIOLATION", "CODELIST_VIOLATION", "EXTRA_ELEMENT", "MISSING_MANDATORY_ELEMENT")


def named_values(segs: Column) -> Column:
    """What conditional rules look at: `TAG` without a value, `TAG/eN` and `TAG/eN/cN` with theirs, in order."""
    item = lambda n, v: F.struct(n.alias("name"), v.cast("string").alias("value"))
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda i: (i + 1).cast("string")

    def element(s: Column, e: Column, i: Column) -> Column:
        here = at(s["tag"], "/e", number(i))
        parts = F.transform(e["c"], lambda c, j: item(at(here, "/c", number(j)), c))
        return F.concat(F.array(item(here, e["v"])), F.coalesce(parts, F.array().cast("array<struct<name:string,value:string>>")))

    return F.flatten(F.transform(segs, lambda s: F.concat(F.array(item(s["tag"], F.lit(None))), F.flatten(F.transform(s["el"], lambda e, i: element(s, e, i))))))


def issues(found: DataFrame, schema: Schema, config: Config = Config(), codes: Codes | None = None, occurs: list[Occurs] | None = None, conditionals: list[Conditional] | None = None, only: set[str] | None = None) -> DataFrame:
    """Issue rows of grouped messages (segs, items): source, msg_idx, message_ref, no, and the fields of an issue.

    Order: occurrence rules, segments, line items, missing segments, conditional rules. `only`: no others than these codes
    are looked for; where none of them is about single segments, these are not gone over.
    """
    rows = _issues(found, schema, config, codes, occurs, conditionals, only)
    return rows if only is None else rows.filter(F.col("code").isin(*only))


def _issues(found: DataFrame, schema: Schema, config: Config, codes: Codes | None, occurs: list[Occurs] | None, conditionals: list[Conditional] | None, only: set[str] | None) -> DataFrame:
    if only is not None and (config.max_errors or not config.continue_on_error):
        raise ValueError("what stops at a number of errors cannot leave checks out")
    codes = codes if config.validate_codelists else None
    nothing = F.array().cast(f"array<{ISSUE}>")
    parts = []
    if occurs:
        said = occurrence_violation(F.col("segs"), occurs)
        parts.append(F.when(said.isNotNull(), F.array(_issue(0, None, 0, "error", "SEGMENT_ORDER_VIOLATION", F.lit(""), said))).otherwise(nothing))
    if only is None or only & set(PER_SEGMENT):
        parts.append(F.flatten(F.transform("segs", lambda s: segment_issues(s, schema, codes, only))))
    tags = line_item_tags(schema)
    if tags and "items" in found.columns:
        lacking = F.transform("items", lambda g, i: F.filter(F.array(*[F.when(~F.exists(g, lambda s: s["tag"] == t), _issue(2, i, k, "error", "MISSING_MANDATORY_SEGMENT", F.concat(F.lit("LINE_ITEM["), i.cast("string"), F.lit("]")), F.lit(f"Mandatory segment '{t}' is missing from segment group 'LINE_ITEM'"))) for k, t in enumerate(tags)]), lambda x: x.isNotNull()))  # noqa: B023
        parts.append(F.transform(F.flatten(lacking), lambda x: x.withField("seg_idx", F.lit(None).cast("int"))))
    need = [s.tag for s in schema.segments if s.is_mandatory]
    if need:
        have = F.transform("segs", lambda s: s["tag"])
        parts.append(F.filter(F.array(*[F.when(~F.array_contains(have, t), _issue(3, None, k, "error", "MISSING_MANDATORY_SEGMENT", F.lit(""), F.lit(f"Mandatory segment '{t}' is missing from document"))) for k, t in enumerate(need)]), lambda x: x.isNotNull()))
    if conditionals and config.validate_conditionals:
        found = fixed(found, named=named_values(F.col("segs")))
        said = conditional_violation(F.col("named"), conditionals)
        parts.append(F.when(said.isNotNull(), F.array(_issue(4, None, 0, "error", "CONDITIONAL_RULE_VIOLATION", F.lit(""), said))).otherwise(nothing))
    return emitted(found, F.concat(*parts) if parts else nothing, config)


def schemaless_issues(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Without a schema: empty segments."""
    empty = F.filter(F.transform("segs", lambda s: F.when(F.size(s["el"]) == 0, _issue(1, s["idx"], 0, "warning", "EMPTY_SEGMENT", F.concat(s["tag"], F.lit("["), s["idx"].cast("string"), F.lit("]")), F.concat(F.lit("Segment '"), s["tag"], F.lit("' has no elements"))))), lambda x: x.isNotNull())
    return emitted(found, empty, config)


def severity_at(strictness: str, severity: Column) -> Column:
    """What a severity is at a strictness."""
    from_, to = {"strict": ("warning", "error"), "lenient": ("error", "warning")}.get(strictness, (None, None))
    return F.when(severity == from_, to).otherwise(severity) if to else severity


def emitted(found: DataFrame, all_: Column, config: Config) -> DataFrame:
    """Severities by strictness, cut where the engine would stop, as rows."""
    if config.strictness in ("strict", "lenient"):
        all_ = F.transform(all_, lambda x: x.withField("severity", severity_at(config.strictness, x["severity"])))
    most = config.max_errors if config.continue_on_error else 1
    rows = fixed(found, all=all_).select("source", "msg_idx", "message_ref", "all")
    if most:
        at = F.filter(F.transform("all", lambda x, i: F.when(x["severity"] == "error", i + 1)), lambda i: i.isNotNull())
        rows = rows.withColumn("all", F.slice("all", F.lit(1), F.coalesce(F.get(at, F.lit(most - 1)), F.size("all"))))
    return rows.select("source", "msg_idx", "message_ref", F.posexplode("all").alias("no", "x")).select("source", "msg_idx", "message_ref", "no", *[f"x.{f}" for f in FIELDS])


def of_first_message(warnings: DataFrame, found: DataFrame) -> DataFrame:
    """Warnings whose reference no message of their source has go to its first message."""
    refs = found.select("source", "message_ref").distinct().withColumn("known", F.lit(True))
    first = found.groupBy("source").agg(F.min(F.struct("msg_idx", "message_ref")).alias("first"))
    matched = warnings.join(refs, warnings["source"].eqNullSafe(refs["source"]) & warnings["message_ref"].eqNullSafe(refs["message_ref"]), "left").select(*[warnings[c] for c in warnings.columns], "known")
    own = F.col("known").isNotNull() | F.col("first").isNull()
    return matched.join(first, "source", "left").select("source", F.when(own, F.col("msg_idx")).otherwise(F.col("first.msg_idx")).alias("msg_idx"), F.when(own, F.col("message_ref")).otherwise(F.col("first.message_ref")).alias("message_ref"), "message")


def with_parse_warnings(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """Adds PARSE_WARNING rows for partial messages."""
    null = F.lit(None)
    more = warnings.select("source", "msg_idx", "message_ref", F.lit(-1).alias("no"), F.lit("warning").alias("severity"), F.lit("PARSE_WARNING").alias("code"), F.lit("").alias("path"), null.cast("int").alias("seg_idx"), null.cast("int").alias("element_pos"), null.cast("int").alias("component_pos"), "message")
    return rows.unionByName(more)


def file_summary(files: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Per file: messages, errors, warnings, is_valid; a file without messages is an error, `empty document`."""
    n = rows.groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    m = found.groupBy("source").agg(F.count(F.lit(1)).alias("messages"))
    zero = F.lit(0).cast("long")
    wide = files.select("source").join(m, "source", "left").join(n, "source", "left")
    empty = F.col("messages").isNull()
    return wide.select("source", F.coalesce("messages", zero).alias("messages"), F.when(empty, F.lit(1).cast("long")).otherwise(F.coalesce("errors", zero)).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (~empty & (F.coalesce("errors", zero) == 0)).alias("is_valid"), F.when(empty, "empty document").alias("error"))


def summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Per message: counts of errors, warnings, and is_valid. Issues are counted before they meet the messages."""
    n = rows.groupBy("source", "msg_idx").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = F.lit(0).cast("long")
    out = found.select("source", "msg_idx", "message_ref").join(n, ["source", "msg_idx"], "left")
    return out.select("source", "msg_idx", "message_ref", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (F.coalesce("errors", zero) == 0).alias("is_valid"))


def first_errors(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group the rows up to its `most`-th error."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)).over(w), F.lit(0))
    return rows.withColumn("before", before).filter(F.col("before") < most).drop("before")
