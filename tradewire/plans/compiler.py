"""Compiles a mapping to DataFrame expressions.

Paths are resolved when the plan is made, against the kind of node the context is: a message (`root` segments and `items`
groups), a line item, a segment, an element, or a plain record with columns. A foreach stays an array of structs
(`nested`), or becomes one row for each match (`rows`); absolute paths inside it are taken out and computed once for each
message. Small look-up tables become map literals, larger ones a left join with a size-checked broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.functions import transforms
from tradewire.functions.extensions import Registry
from tradewire.functions.transforms import Value
from tradewire.plans.dsl import QUALIFIER_KEYS, Mapping, MappingError, Path_, Rule, Step, path_of


def null() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Node:
    """kind: message, group, segment, element, component, record or nothing. columns: of a record, name -> type."""

    kind: str
    column: Column | None = None
    columns: dict[str, str] | None = None
    items: Column | None = None


NOTHING = Node("nothing")


def qualifier(segment: Column) -> Column:
    e = F.get(segment["el"], F.lit(0))
    return F.coalesce(e["v"], F.get(e["c"], F.lit(0)))


def selected(node: Node, step: Step) -> Callable[[Column], Column]:
    """The predicate of a step's selector on a child segment or element."""
    if step.selector is None:
        return lambda x: F.lit(True)
    key, value = step.selector
    if key is None:
        return lambda x: F.lit(False)
    if node.kind in ("message", "group"):
        if key == "c1" or key in QUALIFIER_KEYS:
            return lambda x: F.coalesce(qualifier(x) == value, F.lit(False))
        if key.isdigit():
            return lambda x: F.lit(False)
        n = int(key[1:]) - 1
        if key[0] == "c":
            return lambda x: F.coalesce(F.get(F.get(x["el"], F.lit(0))["c"], F.lit(n)) == value, F.lit(False)) if n >= 0 else F.lit(False)
        return lambda x: F.coalesce(F.get(x["el"], F.lit(n))["v"] == value, F.lit(False)) if n >= 0 else F.lit(False)
    if node.kind == "segment" and key[0] == "c" and key != "c1":
        n = int(key[1:]) - 1
        return lambda x: F.coalesce(F.get(x["c"], F.lit(n)) == value, F.lit(False))
    return lambda x: F.lit(False)


def place(name: str, letter: str) -> int | None:
    """0-based place of eN or cN."""
    return int(name[1:]) - 1 if name[:1] == letter and name[1:].isdigit() and int(name[1:]) > 0 and name[1] != "0" else None


def first_child(node: Node, step: Step) -> Node:
    """The first child that matches; only that one is followed."""
    if node.kind == "message" and step.name == "LINE_ITEM":
        return Node("group", F.get(node.items, F.lit(0))) if step.selector is None else NOTHING
    if node.kind in ("message", "group"):
        ok = selected(node, step)
        return Node("segment", F.get(F.filter(node.column, lambda s: (s["tag"] == step.name) & ok(s)), F.lit(0)))
    if node.kind == "segment" and (n := place(step.name, "e")) is not None:
        e = F.get(node.column["el"], F.lit(n))
        return Node("element", e if step.selector is None else F.when(selected(node, step)(e), e))
    if node.kind == "element" and step.selector is None and (n := place(step.name, "c")) is not None:
        return Node("component", F.get(node.column["c"], F.lit(n)))
    if node.kind == "record" and step.selector is None:
        if step.name in node.columns:
            return Node("scalar " + node.columns[step.name], node.column[step.name] if node.column is not None else F.col(f"`{step.name}`"))
        if step.name in ("rows", "row"):
            return node
    return NOTHING


def children(node: Node, step: Step) -> tuple[str, Column] | None:
    """All matching children: their kind, and an array."""
    if node.kind == "message" and step.name == "LINE_ITEM":
        return ("group", node.items) if step.selector is None else None
    if node.kind in ("message", "group"):
        ok = selected(node, step)
        return "segment", F.filter(node.column, lambda s: (s["tag"] == step.name) & ok(s))
    one = first_child(node, step)
    if one.kind == "element":
        return "element", F.filter(F.array(one.column), lambda e: e.isNotNull())
    if one.kind == "component":
        return "component", F.filter(F.array(one.column), lambda e: e.isNotNull())
    return None


def collection(node: Node, steps: tuple[Step, ...]) -> tuple[str, Column] | None:
    """Every match of a path."""
    found = children(node, steps[0])
    if found is None or len(steps) == 1:
        return found
    kind, array = found
    probe = collection(Node(kind, F.col("x")), steps[1:])
    if probe is None:
        return None
    return probe[0], F.flatten(F.transform(array, lambda x: collection(Node(kind, x), steps[1:])[1]))


def scalar(node: Node) -> Value:
    if node.kind == "element":
        return Value(node.column["v"])
    if node.kind == "component":
        return Value(node.column)
    if node.kind.startswith("scalar "):
        kind = node.kind.split()[1]
        return Value(node.column.cast("double"), "double") if kind in ("double", "float") else Value(node.column.cast("long"), "long") if kind in ("bigint", "int", "smallint", "tinyint") else Value(node.column.cast("string"))
    return Value(null())


def matches(v: Column, pattern: str) -> Column:
    """`matches` of a condition: digits, ORD and digits (with a count), equality for other anchored patterns, else a part."""
    if not (len(pattern) > 1 and pattern.startswith("^") and pattern.endswith("$")):
        return v.contains(pattern)
    inner = pattern[1:-1]
    if inner == "[0-9]+":
        return v.rlike(r"^[0-9]*\z")
    if inner.startswith("ORD") and "[0-9]" in inner:
        after = inner[3:]
        count = after.removeprefix("[0-9]{").split("}")[0] if after.startswith("[0-9]{") and "}" in after else ""
        return v.rlike(f"^ORD[0-9]{{{count}}}\\z" if count.isdigit() and int(count) > 0 else "^ORD\\z(?!^)" if count.isdigit() else "^ORD[0-9]+\\z")
    return v == inner


@dataclass(frozen=True)
class Scope:
    """node: the context; root: the message; hoisted: columns that hold absolute paths already; steps into a foreach."""

    node: Node
    root: Node
    hoisted: dict[str, str] | None = None


class Compiler:
    def __init__(self, mapping: Mapping, extensions: Registry | None = None, extended: bool = False) -> None:
        self.mapping, self.extensions, self.extended = mapping, extensions or Registry(), extended

    def path(self, text: str) -> Path_:
        """In the extended dialect [*] means all, and [n] is left to the first-match rule as a qualifier."""
        p = path_of(text)
        return Path_(p.absolute, tuple(replace(s, selector=None) if s.selector and s.selector[1] == "*" else s for s in p.steps)) if self.extended else p

    def resolve(self, text: str, scope: Scope) -> Value:
        p = self.path(text)
        if p.absolute and scope.hoisted and text in scope.hoisted:
            return Value(F.col(scope.hoisted[text]))
        node = reduce(first_child, p.steps, scope.root if p.absolute else scope.node)
        return scalar(node)

    def condition(self, c: dict, scope: Scope) -> Column:
        op, no = c["op"], F.lit(False)
        if op in ("and", "or"):
            each = [self.condition(x, scope) for x in c["conditions"]]
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), each, F.lit(op == "and"))
        if op == "not":
            return ~self.condition(c["condition"], scope)
        v = self.resolve(c["field"], scope)
        if op == "exists":
            return F.coalesce(v.text != "", no)
        if op == "equals":
            return F.coalesce(v.text == c["value"], no)
        if v.kind != "string":
            return no
        return F.coalesce(v.column.contains(c["value"]) if op == "contains" else matches(v.column, c["pattern"]), no)

    def lookup(self, r: Rule, scope: Scope) -> Value:
        table = self.mapping.lookups.get(r.args["table"])
        key = self.resolve(r.args["key_source"], scope)
        if table is None:
            return Value(null(), "string", F.lit(f"lookup table '{r.args['table']}' not found"))
        entries = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]) if table else F.create_map().cast("map<string,string>")
        found = F.try_element_at(entries, key.text) if table else null()
        error = F.when(key.text.isNull(), F.lit(f"lookup key '{r.args['key_source']}' is not a string"))
        if r.args.get("default_value") is not None:
            found = F.coalesce(found, F.lit(r.args["default_value"]))
        else:
            error = F.coalesce(error, F.when(found.isNull(), F.concat(F.lit("lookup key '"), key.text, F.lit(f"' not found in table '{r.args['table']}'"))))
        return Value(F.when(key.text.isNotNull(), found), "string", key.with_error(error))

    def aggregate(self, r: Rule, scope: Scope) -> Value:
        p, op = self.path(r.args["source"]), r.args["op"]
        found = collection(scope.root if p.absolute else scope.node, p.steps)
        if found is None:
            values = F.array().cast("array<string>")
        else:
            kind, array = found
            values = F.transform(array, lambda x: scalar(Node(kind, x)).text)
        if op == "count":
            return Value(F.size(values).cast("long"), "long")
        if op == "first":
            return Value(F.get(values, F.lit(0)))
        if op == "last":
            return Value(F.get(values, F.size(values) - 1))
        if op == "distinct":
            return Value(F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull())), ","))
        bad = F.filter(values, lambda x: x.isNull() | ~x.rlike(transforms.NUMBER))
        said = F.coalesce(F.concat(F.lit("'"), F.get(bad, F.lit(0)), F.lit("'")), F.lit("null"))
        error = F.when(F.size(bad) > 0, F.concat(F.lit(f"aggregate {op} at '{r.args['source']}' expected numeric input but found "), said))
        numbers = F.transform(values, lambda x: x.try_cast("double"))
        out = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) if op == "sum" else F.array_min(numbers) if op == "min" else F.array_max(numbers)
        return Value(F.when(F.size(bad) == 0, out), "double", error)

    def rule(self, r: Rule, scope: Scope, guard: Column | None) -> list[tuple[str, Value | Column, Column | None, Column | None]]:
        """(target, value or array, error, guard) in order."""
        if r.kind == "block":
            return [x for y in r.rules for x in self.rule(y, scope, guard)]
        if r.kind == "condition":
            met = self.condition(r.args["when"], scope)
            both = lambda c: c if guard is None else guard & c
            return [x for y in r.rules for x in self.rule(y, scope, both(met))] + [x for y in r.else_rules for x in self.rule(y, scope, both(~met))]
        if r.kind == "foreach":
            return [self.nested(r, scope, guard)]
        if r.kind == "lookup":
            v = self.lookup(r, scope)
        elif r.kind == "aggregate":
            v = self.aggregate(r, scope)
        else:
            v = self.resolve(r.args["source"], scope)
            if r.args.get("transform"):
                v = transforms.apply(v, r.args["transform"], self.extensions)
        return [(r.args["target"], v, v.error, guard)]

    def nested(self, r: Rule, scope: Scope, guard: Column | None) -> tuple[str, Value | Column, Column | None, Column | None]:
        p = self.path(r.args["source"])
        found = collection(scope.root if p.absolute else scope.node, p.steps) if p.steps else None
        if found is None:
            return r.args["target"], F.array().cast("array<string>"), None, guard
        kind, array = found
        inner = lambda x: self.struct(r.rules, replace(scope, node=Node(kind, x)))
        fails = inner(F.col("x"))[1] is not None
        out = F.transform(array, lambda x: inner(x)[0])
        error = F.get(F.filter(F.transform(array, lambda x: inner(x)[1]), lambda e: e.isNotNull()), F.lit(0)) if fails else None
        return r.args["target"], out, error, guard

    def columns(self, rules: tuple[Rule, ...], scope: Scope) -> tuple[list[tuple[str, Column]], Column | None]:
        """Target columns in first-seen order (branches with one target are merged), and the first error in rule order."""
        made: dict[str, list[tuple[Value | Column, Column | None]]] = {}
        errors = []
        for r in rules:
            for target, v, error, guard in self.rule(r, scope, None):
                made.setdefault(target, []).append((v, guard))
                if error is not None:
                    errors.append(error if guard is None else F.when(guard, error))
        out = []
        for target, parts in made.items():
            kinds = {v.kind for v, _ in parts if isinstance(v, Value)}
            column = None
            for v, guard in reversed(parts):  # of targets written twice the first stands
                c = v if isinstance(v, Column) else v.column if len(kinds) == 1 else v.text
                column = c if guard is None else F.when(guard, c) if column is None else F.when(guard, c).otherwise(column)
            out.append((target, column))
        return out, F.coalesce(*errors) if errors else None

    def struct(self, rules: tuple[Rule, ...], scope: Scope) -> tuple[Column, Column | None]:
        columns, error = self.columns(rules, scope)
        return F.struct(*[c.alias(n) for n, c in columns]) if columns else F.struct(null().alias("empty")), error


def _absolute(rules: tuple[Rule, ...]) -> list[str]:
    """Absolute scalar paths anywhere below."""
    out: list[str] = []

    def condition(c: dict) -> None:
        if "field" in c:
            out.append(c["field"])
        for x in c.get("conditions", []) + ([c["condition"]] if "condition" in c else []):
            condition(x)

    for r in rules:
        if r.kind == "field":
            out.append(r.args["source"])
        if r.kind == "lookup":
            out.append(r.args["key_source"])
        if r.kind == "condition":
            condition(r.args["when"])
        out += _absolute(r.rules) + _absolute(r.else_rules)
    return [x for x in dict.fromkeys(out) if x.startswith("/")]


def tags(mapping: Mapping) -> set[str]:
    """The segments that a mapping reads: what the parser has to cut into elements for it."""
    from tradewire.plans.diagnostics import paths

    return {s.name for _, p in paths(mapping.rules) for s in path_of(p).steps if len(s.name) == 3 and s.name.isupper()}


def transform(found: DataFrame, mapping: Mapping, keep: tuple[str, ...] = (), extensions: Registry | None = None, extended: bool = False) -> DataFrame:
    """Nested form: a row for each message or record, targets as columns, `error` with the first failure.

    found: `grouped` messages (root, items), or any table whose rows are records.
    """
    scope = _scope(found)
    columns, error = Compiler(mapping, extensions, extended).columns(mapping.rules, scope)
    return found.select(*keep, *[c.alias(n) for n, c in columns], (null() if error is None else error).alias("error"))


def _scope(found: DataFrame) -> Scope:
    if "root" in found.columns and "items" in found.columns:
        root = Node("message", F.col("root"), items=F.col("items"))
    else:
        root = Node("record", None, dict(found.dtypes))
    return Scope(root, root)


def rows(found: DataFrame, mapping: Mapping, keep: tuple[str, ...] = (), extensions: Registry | None = None, extended: bool = False, number: str | None = None) -> DataFrame:
    """Tabular form of a mapping with one foreach on the top level: a row for each match, the other targets beside it.

    `number`: the name of a column for the 0-based place of the match in its message.
    """
    loops = [r for r in mapping.rules if r.kind == "foreach"]
    if len(loops) != 1:
        raise MappingError("the tabular form wants exactly one foreach on the top level")
    compiler, scope, loop = Compiler(mapping, extensions, extended), _scope(found), loops[0]
    if scope.root.kind == "record":
        flat = replace(mapping, rules=tuple(x for r in mapping.rules for x in (r.rules if r is loop else (r,))))
        return transform(found, flat, keep, extensions, extended)
    rest = tuple(r for r in mapping.rules if r is not loop)
    outer, outer_error = compiler.columns(rest, scope)
    hoisted = {p: f"_path{i}" for i, p in enumerate(_absolute(loop.rules))}
    p = compiler.path(loop.args["source"])
    matched = collection(scope.root, p.steps)
    if matched is None:
        raise MappingError(f"foreach over {loop.args['source']} matches nothing")
    kind, array = matched
    wide = found.select(
        *keep, *[c.alias(n) for n, c in outer], *([outer_error.alias("_error")] if outer_error is not None else []),
        *[compiler.resolve(x, scope).text.alias(n) for x, n in hoisted.items()], F.posexplode(array).alias("_place", "_item"),
    )
    inner, error = compiler.columns(loop.rules, Scope(Node(kind, F.col("_item")), scope.root, hoisted))
    errors = [F.col("_error")] * (outer_error is not None) + [error] * (error is not None)
    return wide.select(*keep, *([F.col("_place").alias(number)] if number else []), *[n for n, _ in outer], *[c.alias(n) for n, c in inner], (F.coalesce(*errors) if errors else null()).alias("error"))


def looked_up(df: DataFrame, table: DataFrame, key: str, target: str, default: str | None = None, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The look-up as a join, for tables too large for a literal. table: (key, value). Adds target and lookup_error.

    The table is broadcast only if its keys and values have at most `broadcast_bytes` bytes; otherwise the join shuffles.
    """
    side = table.select(F.col("key").alias("_key"), F.col("value").alias("_value")).dropDuplicates(["_key"])
    size = side.agg(F.sum(F.coalesce(F.octet_length(F.col("_key").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("_value").cast("string")), F.lit(0)) + 32)).first()[0]
    if (size or 0) <= broadcast_bytes:
        side = F.broadcast(side)
    out = df.join(side, F.col(key) == F.col("_key"), "left")
    value = F.col("_value") if default is None else F.when(F.col(key).isNotNull(), F.coalesce("_value", F.lit(default)))
    error = F.when(F.col(key).isNull(), F.lit("lookup key is not a string"))
    if default is None:
        error = F.coalesce(error, F.when(F.col("_value").isNull(), F.concat(F.lit("lookup key '"), F.col(key), F.lit("' not found"))))
    return out.withColumn(target, value).withColumn("lookup_error", error).drop("_key", "_value")
