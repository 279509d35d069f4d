"""Message schemas: loading, inheritance, merging, registry, packs. Small and plain; they become literals in plans."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any


class SchemaError(ValueError):
    """A schema that cannot be read, or a broken parent chain."""


@dataclass(frozen=True)
class Element:
    id: str
    name: str = ""
    data_type: str = "an"
    min_length: int = 0
    max_length: int = 35
    is_mandatory: bool = False


@dataclass(frozen=True)
class Segment:
    tag: str
    elements: tuple[Element, ...] = ()
    is_mandatory: bool = False
    max_repetitions: int | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    version: str
    segments: tuple[Segment, ...] = ()
    parent: tuple[str, str] | None = None

    @property
    def qualified_name(self) -> str:
        return f"{self.name}: {self.version}"

    def find(self, tag: str) -> Segment | None:
        return next((s for s in self.segments if s.tag == tag), None)


def version_of(text: str) -> tuple[int, int]:
    """major[.minor], both numbers."""
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?", text)
    if not m:
        raise SchemaError(f"not a version: {text}")
    return int(m[1]), int(m[2] or 0)


def schema_of(data: Any) -> Schema:
    if not isinstance(data, dict) or "name" not in data or "version" not in data:
        raise SchemaError("a schema has a name and a version")
    segments = []
    for s in data.get("segments") or ():
        if "tag" not in s:
            raise SchemaError("a segment has a tag")
        elements = tuple(Element(e["id"], e.get("name", ""), e.get("data_type", "an"), int(e.get("min_length", 0)), int(e.get("max_length", 35)), bool(e.get("is_mandatory", False))) for e in s.get("elements") or ())
        segments.append(Segment(s["tag"], elements, bool(s.get("is_mandatory", False)), s.get("max_repetitions")))
    p = data.get("parent")
    return Schema(str(data["name"]), str(data["version"]), tuple(segments), (str(p["name"]), str(p["version"])) if p else None)


def from_string(text: str, kind: str = "yaml") -> Schema:
    try:
        if kind == "json":
            return schema_of(json.loads(text))
        import yaml

        return schema_of(yaml.safe_load(text))
    except SchemaError:
        raise
    except Exception as e:
        raise SchemaError(f"cannot read schema: {e}") from e


def from_file(path: str | Path) -> Schema:
    path = Path(path)
    if path.suffix.lower() not in (".yaml", ".yml", ".json"):
        raise SchemaError(f"unknown schema format: {path.suffix}")
    try:
        return from_string(path.read_text(encoding="utf-8"), "json" if path.suffix.lower() == ".json" else "yaml")
    except OSError as e:
        raise SchemaError(f"cannot read {path}: {e}") from e


def merge_segments(parent: Segment, child: Segment) -> Segment:
    """Elements of the child win by id, and stand first; mandatory if either is."""
    own = {e.id for e in child.elements}
    return Segment(child.tag, (*child.elements, *(e for e in parent.elements if e.id not in own)), parent.is_mandatory or child.is_mandatory, child.max_repetitions if child.max_repetitions is not None else parent.max_repetitions)


def merge(parent: Schema, child: Schema) -> Schema:
    """The child's segments first, then those that only the parent has."""
    own = {s.tag for s in child.segments}
    segments = tuple(merge_segments(p, s) if (p := parent.find(s.tag)) else s for s in child.segments)
    return replace(child, segments=(*segments, *(s for s in parent.segments if s.tag not in own)))


class Loader:
    """Loads by name and version along search paths. Merged and plain schemas are kept apart."""

    def __init__(self, *paths: str | Path) -> None:
        self.paths = [Path(p) for p in paths]
        self.plain: dict[tuple[str, str], Schema] = {}
        self.merged: dict[tuple[str, str], Schema] = {}

    def add(self, *schemas: Schema) -> Loader:
        self.plain |= {(s.name, s.version): s for s in schemas}
        return self

    def load(self, name: str, version: str) -> Schema:
        if (name, version) not in self.plain:
            self.plain[name, version] = self._find(name, version)
        return self.plain[name, version]

    def _find(self, name: str, version: str) -> Schema:
        for folder in self.paths:
            for path in sorted(folder.glob("*")):
                if path.suffix.lower() in (".yaml", ".yml", ".json") and path.stem.lower() in {f"{name}_{version}".lower(), f"{name}-{version}".lower(), f"eancom_{name}_{version}".lower(), name.lower()}:
                    found = from_file(path)
                    if (found.name, found.version) == (name, version):
                        return found
        raise SchemaError(f"schema {name}: {version} not found")

    def chain(self, name: str, version: str) -> list[Schema]:
        """From the schema to its oldest ancestor."""
        out, seen, at = [], [], (name, version)
        while at:
            if at in seen:
                raise SchemaError("cycle in parents: " + " -> ".join(f"{n}: {v}" for n, v in [*seen, at]))
            seen.append(at)
            try:
                out.append(self.load(*at))
            except SchemaError as e:
                raise SchemaError(f"missing parent {at[0]}: {at[1]}" if out else str(e)) from e
            at = out[-1].parent
        return out

    def load_merged(self, name: str, version: str) -> Schema:
        if (name, version) not in self.merged:
            chain = self.chain(name, version)
            found = chain[-1]
            for child in reversed(chain[:-1]):
                found = merge(found, child)
            self.merged[name, version] = found
        return self.merged[name, version]


@dataclass
class Registry:
    """By qualified name."""

    known: dict[str, Schema] = field(default_factory=dict)

    def register(self, *schemas: Schema) -> None:
        self.known |= {s.qualified_name: s for s in schemas}

    def get(self, name: str) -> Schema | None:
        return self.known.get(name)

    def remove(self, name: str) -> Schema | None:
        return self.known.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.known)

    def __contains__(self, name: str) -> bool:
        return name in self.known

    def __len__(self) -> int:
        return len(self.known)


@dataclass(frozen=True)
class Constraint:
    """kind: required, length, pattern or code_list, at a path. Nothing but `required` minds a missing value."""

    kind: str
    path: str
    low: int | None = None
    high: int | None = None
    pattern: str | None = None
    codes: tuple[str, ...] = ()

    def holds(self, value):
        """As a Column over a string column."""
        from pyspark.sql import functions as F

        if self.kind == "required":
            return value.isNotNull()
        size = F.octet_length(value)
        ok = F.lit(True)
        if self.kind == "length":
            ok = ok & (size >= self.low) if self.low is not None else ok
            ok = ok & (size <= self.high) if self.high is not None else ok
        elif self.kind == "pattern":
            ok = value.rlike(self.pattern)
        elif self.kind == "code_list":
            ok = value.isin(*self.codes)
        return value.isNull() | ok


def merge_constraints(parent: list[Constraint], child: list[Constraint]) -> list[Constraint]:
    """By kind and path the child wins."""
    own = {(c.kind, c.path) for c in child}
    return [c for c in parent if (c.kind, c.path) not in own] + list(child)


def merge_codes(parent: list[str], child: list[str]) -> list[str]:
    return sorted({*parent, *child})


class Packs:
    """Schema folders by message type and version, for automatic choice."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Schema] = {}

    def install(self, *schemas: Schema) -> None:
        for s in schemas:
            name = re.sub(r"^EANCOM[ _]?", "", s.name.upper())
            self.known[name, s.version.upper().replace("D_", "D")] = s

    def list(self) -> list[tuple[str, str]]:
        return sorted(self.known)

    def inspect(self, message: str, version: str) -> dict:
        s = self.known[message, version]
        return {"name": s.name, "version": s.version, "segments": len(s.segments), "mandatory": [x.tag for x in s.segments if x.is_mandatory]}

    def doctor(self) -> list[str]:
        """What is wrong with the installed schemas."""
        return [f"{s.qualified_name}: {what}" for s in self.known.values() for what, bad in (("no segments", not s.segments), ("a tag twice", len({x.tag for x in s.segments}) < len(s.segments)), ("minimum over maximum length", any(e.min_length > e.max_length for x in s.segments for e in x.elements))) if bad]

    def choose(self, doc_type: str, version: str | None) -> Schema | None:
        """For a message of this type: its version if that is installed, else the only one there is."""
        same = [s for (n, _), s in sorted(self.known.items()) if n == doc_type.upper()]
        exact = self.known.get((doc_type.upper(), (version or "").upper().replace("D_", "D")))
        return exact or (same[0] if len(same) == 1 else None)
