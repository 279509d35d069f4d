"""Reading a mapping before it runs: lint, explain, trace; and reports of issues. Plain Python over small things."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewire.plans.compiler import Compiler, Node, Scope, _scope, collection
from tradewire.plans.dsl import Mapping, QUALIFIER_KEYS, Rule, path_of
from tradewire.plans.schema import Schema


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def closest(name: str, candidates: list[str], most: int = 2) -> str | None:
    best = min(((edit_distance(name, c), i, c) for i, c in enumerate(candidates)), default=None)
    return best[2] if best and best[0] <= most else None


def paths(rules: tuple[Rule, ...]) -> Iterator[tuple[str, str]]:
    """(where, path) of everything that reads a path."""

    def condition(c: dict, at: str) -> Iterator[tuple[str, str]]:
        if "field" in c:
            yield at, c["field"]
        for x in [*c.get("conditions", []), *([c["condition"]] if "condition" in c else [])]:
            yield from condition(x, at)

    def transform(t: dict, at: str) -> Iterator[tuple[str, str]]:
        for v in t.get("values", []):
            if v.get("type") == "field":
                yield at, v["path"]
        if t.get("when"):
            yield from condition(t["when"], at)
        for x in [*t.get("transforms", []), *[t[k] for k in ("then", "else_transform") if t.get(k)]]:
            yield from transform(x, at)

    for i, r in enumerate(rules):
        at = f"rule {i + 1} ({r.kind})"
        for k in ("source", "key_source"):
            if k in r.args:
                yield at, r.args[k]
        if r.kind == "condition":
            yield from condition(r.args["when"], at)
        if r.args.get("transform"):
            yield from transform(r.args["transform"], at)
        for where, p in paths((*r.rules, *r.else_rules)):
            yield f"{at} > {where}", p


def lint(mapping: Mapping, schema: Schema | None = None) -> list[str]:
    """Selectors that cannot match, and with a schema, tags that it does not have."""
    said = []
    for where, text in paths(mapping.rules):
        for s in path_of(text).steps:
            if s.selector and s.selector[1] != "*":
                key = s.selector[0]
                if key is None:
                    said.append(f"{where}: selector of {s.name} in '{text}' can match nothing")
                elif key.isdigit() and key not in QUALIFIER_KEYS:
                    said.append(f"{where}: selector key {key} in '{text}' is not known")
        first = path_of(text).steps[:1]
        if schema and first:
            tag = first[0].name
            if tag not in ("LINE_ITEM", "*") and tag.isupper() and not schema.find(tag):
                near = closest(tag, [x.tag for x in schema.segments])
                said.append(f"{where}: segment {tag} in '{text}' is not in {schema.qualified_name}" + (f"; did you mean {near}?" if near else ""))
    return said


def explain(mapping: Mapping) -> str:
    out = [f"mapping {mapping.name}: {mapping.source_type} -> {mapping.target_type}"]

    def said(c: dict) -> str:
        if c["op"] in ("and", "or"):
            return "(" + f" {c['op']} ".join(map(said, c["conditions"])) + ")"
        if c["op"] == "not":
            return f"not {said(c['condition'])}"
        return f"{c['op']} {c['field']}" + "".join(f" '{c[k]}'" for k in ("value", "pattern") if k in c)

    def rule(r: Rule, depth: int) -> None:
        pad, a = "  " * depth, r.args
        if r.kind == "condition":
            out.append(f"{pad}if {said(a['when'])}")
            for x in r.rules:
                rule(x, depth + 1)
            if r.else_rules:
                out.append(f"{pad}else")
                for x in r.else_rules:
                    rule(x, depth + 1)
            return
        what = {"field": lambda: f"{a['source']} -> {a['target']}" + (f" by {a['transform']['op']}" if a.get("transform") else ""), "foreach": lambda: f"for each {a['source']} -> {a['target']}", "lookup": lambda: f"look up {a['key_source']} in {a['table']} -> {a['target']}" + (f" else '{a['default_value']}'" if a.get("default_value") is not None else ""), "aggregate": lambda: f"{a['op']} of {a['source']} -> {a['target']}", "block": lambda: "block"}
        out.append(pad + what[r.kind]())
        for x in r.rules:
            rule(x, depth + 1)

    for r in mapping.rules:
        rule(r, 1)
    return "\n".join(out)


def trace(found: DataFrame, mapping: Mapping, keep: tuple[str, ...] = ("source", "msg_idx")) -> DataFrame:
    """A row for each top-level rule and message: rule_no, rule_type, source, target, count, output."""
    scope = _scope(found)
    compiler = Compiler(mapping)
    events = []
    null = F.lit(None).cast("string")
    for i, r in enumerate(mapping.rules):
        a = r.args
        count, output = F.lit(None).cast("int"), null
        if r.kind in ("field", "lookup"):
            read = compiler.resolve(a.get("source", a.get("key_source")), scope)
            count = F.when(read.text.isNotNull(), 1).otherwise(0)
            output = compiler.rule(r, scope, None)[0][1].text
        elif r.kind in ("foreach", "aggregate"):
            p = compiler.path(a["source"])
            got = collection(scope.root, p.steps) if p.steps else None
            count = F.lit(0) if got is None else F.size(got[1])
            output = null if r.kind == "foreach" else compiler.aggregate(r, scope).text
        elif r.kind == "condition":
            met = compiler.condition(a["when"], scope)
            count, output = met.cast("int"), met.cast("string")
        events.append(F.struct(F.lit(i).alias("rule_no"), F.lit(r.kind).alias("rule_type"), F.lit(a.get("source", a.get("key_source"))).cast("string").alias("path"), F.lit(a.get("target")).cast("string").alias("target"), count.cast("int").alias("count"), output.alias("output")))
    return found.select(*keep, F.inline(F.array(*events)))


# --- reports: counts of all issues, and a listing that is cut and says so -------------------------------------------------

SEVERITIES = ("error", "warning", "info")


def of_severity(issues: DataFrame, *severities: str) -> DataFrame:
    return issues.filter(F.col("severity").isin(*severities))


def summary(issues: DataFrame) -> DataFrame:
    """(severity, code, n): counts of all issues."""
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


class Issues(list):
    """Listed issues, with the counts of all there are."""

    def __init__(self, listed: list[dict], counts: dict[tuple[str, str], int] | None = None) -> None:
        super().__init__(listed)
        if counts is None:
            counts = {}
            for i in listed:
                counts[i["severity"], i["code"]] = counts.get((i["severity"], i["code"]), 0) + 1
        self.by_code = counts
        self.total = sum(counts.values())

    @property
    def counts(self) -> dict[str, int]:
        return {s: sum(n for (severity, _), n in self.by_code.items() if severity == s) for s in SEVERITIES}

    @property
    def unlisted(self) -> int:
        return self.total - len(self)


def collected(issues: DataFrame, most: int = 10_000) -> Issues:
    """Counts of all issues (a row for each code), and the first `most`, errors first."""
    counts = {(r["severity"], r["code"]): r["n"] for r in summary(issues).collect()}
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return Issues([r.asDict() for r in issues.orderBy(rank, "source", "msg_idx", "no").limit(most).collect()], counts)


def _issues(issues: list[dict]) -> Issues:
    return issues if isinstance(issues, Issues) else Issues(issues)


def console(i: dict) -> str:
    """An issue as one line."""
    return f"{i['severity'].upper()} {i['source']} message {i['message_ref']}: [{i['code']}]{' ' + i['path'] if i['path'] else ''}: {i['message']}"


def text_report(issues: list[dict]) -> str:
    issues, out = _issues(issues), []
    for severity, n in issues.counts.items():
        if n:
            out.append(f"{severity}s: {n}")
            out += [f"  {i['source']} message {i['message_ref']}: [{i['code']}] {i['path']}: {i['message']}" for i in issues if i["severity"] == severity]
    out += [f"not listed: {issues.unlisted}"] if issues.unlisted else []
    return "\n".join([*out, f"total: {issues.total}"])


def json_report(issues: list[dict]) -> str:
    issues = _issues(issues)
    return json.dumps({"counts": issues.counts, "total": issues.total, "unlisted": issues.unlisted, "is_valid": issues.counts["error"] == 0, "issues": list(issues)}, indent=2, default=str)


def html_report(issues: list[dict]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(i[k]))}</td>" for k in ("source", "message_ref", "severity", "code", "path", "message")) + "</tr>" for i in issues)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Validation report</title></head><body><h1>{_issues(issues).total} issues</h1>{f'<p>not listed: {_issues(issues).unlisted}</p>' if _issues(issues).unlisted else ''}<table>{cells}</table></body></html>"


def snippets(issues: DataFrame, found: DataFrame, size: int = 240) -> DataFrame:
    """Adds snippet: the segment an issue is about, as wire text, up to `size` characters; null where it names none."""
    from tradewire.operators import wire
    from tradewire.operators.outcome import snippet

    texts = found.select("source", "msg_idx", F.transform("segs", wire.segment_text).alias("texts"))
    cut = issues.join(texts, ["source", "msg_idx"], "left")
    return cut.withColumn("snippet", snippet(F.get("texts", F.col("seg_idx")), size)).select(*issues.columns, "snippet")


def sarif_report(issues: list[dict], tool: str = "tradewire") -> str:
    issues = _issues(issues)

    def place(i: dict) -> dict:
        at = {"artifactLocation": {"uri": i["source"]}}
        if i.get("snippet"):
            at["region"] = {"snippet": {"text": i["snippet"]}}
        return {"physicalLocation": at, "logicalLocations": [{"fullyQualifiedName": i["path"]}]}

    results = [{"ruleId": i["code"], "level": {"error": "error", "warning": "warning"}.get(i["severity"], "note"), "message": {"text": i["message"]}, "locations": [place(i)]} for i in issues]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": c} for c in sorted({c for _, c in issues.by_code})]}}, "results": results}
    if issues.unlisted:
        run["properties"] = {"total": issues.total, "unlisted": issues.unlisted}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


__all__ = ["Issues", "Node", "Scope", "closest", "collected", "console", "edit_distance", "explain", "html_report", "json_report", "lint", "paths", "of_severity", "sarif_report", "snippets", "summary", "text_report", "trace"]
