"""The mapping language: YAML or dicts to plain dataclasses, and back. No Spark here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Fixed values of the language.
AGGREGATES = ("sum", "count", "min", "max", "first", "last", "distinct")
QUALIFIER_KEYS = ("1153", "2005", "3035", "5025", "5125", "6063")
CONDITIONS = {"exists": ("field",), "equals": ("field", "value"), "contains": ("field", "value"), "matches": ("field", "pattern"), "and": ("conditions",), "or": ("conditions",), "not": ("condition",)}
TRANSFORMS = {"uppercase": (), "lowercase": (), "trim": (), "date_format": ("from", "to"), "number_format": ("decimals",), "concatenate": ("values",), "split": ("delimiter", "index"), "default": ("value",), "conditional": ("when", "then"), "chain": ("transforms",), "extension": ("name", "function")}
RULES = {"field": ("source", "target"), "foreach": ("source", "target"), "condition": ("when",), "lookup": ("table", "key_source", "target"), "aggregate": ("source", "target", "op"), "block": ()}


class MappingError(ValueError):
    """A mapping that cannot be read or compiled."""


@dataclass(frozen=True)
class Rule:
    """kind is the rule type; args are its own fields, rules its children, else_rules those of a false condition."""

    kind: str
    args: dict[str, Any] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    else_rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Mapping:
    name: str
    source_type: str
    target_type: str
    rules: tuple[Rule, ...]
    lookups: dict[str, dict[str, str]] = field(default_factory=dict)


def _need(data: Any, kinds: dict[str, tuple[str, ...]], tag: str, what: str) -> str:
    if not isinstance(data, dict) or data.get(tag) not in kinds:
        raise MappingError(f"unknown {what}: {data.get(tag) if isinstance(data, dict) else data!r}")
    missing = [f for f in kinds[data[tag]] if f not in data]
    if missing:
        raise MappingError(f"{what} {data[tag]} lacks {', '.join(missing)}")
    return data[tag]


def check_condition(data: Any) -> dict:
    op = _need(data, CONDITIONS, "op", "condition")
    for c in data.get("conditions", []) if op in ("and", "or") else [data["condition"]] if op == "not" else []:
        check_condition(c)
    return data


def check_transform(data: Any) -> dict:
    op = _need(data, TRANSFORMS, "op", "transform")
    if op == "conditional":
        check_condition(data["when"])
        check_transform(data["then"])
        if data.get("else_transform") is not None:
            check_transform(data["else_transform"])
    for t in data["transforms"] if op == "chain" else []:
        check_transform(t)
    return data


def rule_of(data: Any) -> Rule:
    kind = _need(data, RULES, "type", "rule")
    args = {k: v for k, v in data.items() if k not in ("type", "rules", "then", "else_rules")}
    if kind == "aggregate" and args["op"] not in AGGREGATES:
        raise MappingError(f"unknown aggregate: {args['op']}")
    if kind == "condition":
        check_condition(args["when"])
        return Rule(kind, args, tuple(map(rule_of, data.get("then") or ())), tuple(map(rule_of, data.get("else_rules") or ())))
    if kind == "field" and args.get("transform") is not None:
        check_transform(args["transform"])
    return Rule(kind, args, tuple(map(rule_of, data.get("rules") or ())))


def parse(data: str | dict) -> Mapping:
    """From YAML text, or from what it would load to."""
    if isinstance(data, str):
        import yaml

        try:
            data = yaml.safe_load(data)
        except yaml.YAMLError as e:
            raise MappingError(f"not YAML: {e}") from e
    if not isinstance(data, dict):
        raise MappingError("a mapping is an object")
    missing = [k for k in ("name", "source_type", "target_type", "rules") if k not in data]
    if missing:
        raise MappingError(f"mapping lacks {', '.join(missing)}")
    lookups = {name: {str(k): str(v) for k, v in (x.get("entries") or {}).items()} for name, x in (data.get("lookups") or {}).items()}
    return Mapping(data["name"], data["source_type"], data["target_type"], tuple(map(rule_of, data["rules"])), lookups)


def parse_file(path: str | Path) -> Mapping:
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise MappingError(f"cannot read {path}: {e}") from e


def as_dict(mapping: Mapping) -> dict:
    def rule(r: Rule) -> dict:
        out = {"type": r.kind, **r.args}
        if r.kind == "condition":
            return out | {"then": [rule(x) for x in r.rules], "else_rules": [rule(x) for x in r.else_rules]}
        return out | ({"rules": [rule(x) for x in r.rules]} if r.kind in ("foreach", "block") else {})

    return {"name": mapping.name, "source_type": mapping.source_type, "target_type": mapping.target_type, "rules": [rule(r) for r in mapping.rules], "lookups": {n: {"name": n, "entries": e} for n, e in mapping.lookups.items()}}


@dataclass(frozen=True)
class Step:
    """A path component: a name, and a selector (key, value); a selector that can match nothing has key None."""

    name: str
    selector: tuple[str | None, str] | None = None


def step_of(component: str) -> Step:
    at = component.find("[")
    if at <= 0 or not component.endswith("]"):
        return Step(component)
    name, text = component[:at], component[at + 1 : -1].strip()
    if not text:
        return Step(name, (None, ""))
    key, eq, raw = text.partition("=")
    if not eq:
        return Step(name, ("c1", _literal(text)))
    value, key = _literal(raw), key.strip() or "c1"
    if not value or not re.fullmatch(r"[cCeE]?[0-9]+", key):
        return Step(name, (None, value))
    return Step(name, (key.lower(), value))


def _literal(text: str) -> str:
    return text.strip().strip("'").strip('"')


@dataclass(frozen=True)
class Path_:
    absolute: bool
    steps: tuple[Step, ...]


def path_of(text: str) -> Path_:
    return Path_(text.startswith("/"), tuple(step_of(x) for x in text.split("/") if x))
