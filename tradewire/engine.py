"""The commands as one object: read, transform, validate, generate, and the batch forms with a report and a quarantine."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.functions.extensions import Registry
from tradewire.operators import outcome, validate, wire
from tradewire.plans import compiler, diagnostics, dsl
from tradewire.plans.dsl import Mapping, MappingError, Rule
from tradewire.plans.schema import Packs, Schema
from tradewire.sources import edifact

REPORTS = {"text": diagnostics.text_report, "json": diagnostics.json_report, "html": diagnostics.html_report, "sarif": diagnostics.sarif_report}


@dataclass(frozen=True)
class Settings:
    """What a configuration file may hold; `checked` says what is wrong with it."""

    strictness: str = "standard"
    policy: str = outcome.QUARANTINE
    max_errors: int = 0
    max_retries: int = 3
    extended: bool = False
    profiles: dict[str, dict] = field(default_factory=dict)

    @staticmethod
    def of(data: dict, profile: str | None = None) -> Settings:
        merged = {k: v for k, v in data.items() if k != "profiles"} | (data.get("profiles", {}).get(profile, {}) if profile else {})
        unknown = set(merged) - set(Settings.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Settings(**merged, profiles=data.get("profiles", {}))

    def checked(self) -> list[str]:
        said = [] if self.strictness in ("strict", "standard", "lenient") else [f"unknown strictness: {self.strictness}"]
        said += [] if self.policy in (outcome.ACCEPT_ALL, outcome.FAIL_ALL, outcome.QUARANTINE) else [f"unknown policy: {self.policy}"]
        return said + [f"{n} must not be negative" for n in ("max_errors", "max_retries") if getattr(self, n) < 0]


@dataclass(frozen=True)
class Batch:
    accepted: DataFrame
    quarantine: DataFrame
    files: DataFrame

    def summary(self) -> DataFrame:
        return outcome.batch_summary(self.files)

    def exit_code(self) -> int:
        return outcome.worst_exit(self.files).first()[0]


def targets(rules: Iterable[Rule]) -> list[str]:
    """Targets below these rules, in order."""
    out: list[str] = []
    for r in rules:
        out += [r.args["target"]] if r.kind in ("field", "lookup", "aggregate") else targets((*r.rules, *r.else_rules)) if r.kind in ("block", "condition") else []
    return list(dict.fromkeys(out))


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings = Settings(), packs: Packs | None = None, extensions: Registry | None = None) -> None:
        self.spark, self.settings, self.packs, self.extensions = spark, settings, packs or Packs(), extensions or Registry()

    def read_edifact(self, path: str) -> DataFrame:
        """Grouped messages of the files under a path. No file, or one that is too large, is an error here; batches go on."""
        return self.parse(edifact.readable(edifact.read(self.spark, path)).select("source", "text"))

    def parse(self, texts: DataFrame) -> DataFrame:
        return edifact.grouped(edifact.messages(texts))

    def dump(self, found: DataFrame, pretty: bool = False) -> DataFrame:
        """Parsed messages as JSON text."""
        return found.select("source", "msg_idx", F.to_json(F.struct("message_ref", "doc_type", "version", "partial", "segs"), {"pretty": str(pretty).lower()}).alias("json"))

    def dry_run(self, mapping: Mapping | str | Path, schema: Schema | None = None) -> dict:
        """What a transform would do, from the mapping alone: its plan, its findings, the format it writes."""
        m = self._mapping(mapping)
        return {"mapping": m.name, "output": wire.target_format(m.target_type), "targets": targets(m.rules), "explain": diagnostics.explain(m), "lint": diagnostics.lint(m, schema)}

    def _mapping(self, mapping: Mapping | str | Path) -> Mapping:
        return mapping if isinstance(mapping, Mapping) else dsl.parse_file(mapping)

    def transform(self, found: DataFrame, mapping: Mapping | str | Path, flat: bool = False, keep: tuple[str, ...] = ("source", "msg_idx")) -> DataFrame:
        """Mapped messages: nested, or with `flat` one row for each match of the loop."""
        m = self._mapping(mapping)
        keep = tuple(c for c in keep if c in found.columns)
        return (compiler.rows if flat else compiler.transform)(found, m, keep, self.extensions, self.settings.extended)

    def output(self, mapped: DataFrame, mapping: Mapping | str | Path, keep: tuple[str, ...] = ("source", "msg_idx")) -> DataFrame:
        """Nested messages as text in the format that the target type names: a JSON object, a CSV line or wire segments."""
        m = self._mapping(mapping)
        kind, names = wire.target_format(m.target_type), [c for c in mapped.columns if c not in (*keep, "error")]
        if kind == "edifact":
            return wire.mapped_text(mapped, names, "text").select(*keep, "text", "error")
        if kind == "json":
            text = F.to_json(F.struct(*[f"`{n}`" for n in names]))
        elif kind == "xml":
            text = wire.xml_record("document", [(n, F.col(f"`{n}`")) for n in names])
        else:
            text = wire.csv_line([F.col(f"`{n}`") for n in names])
        return mapped.select(*keep, text.alias("text"), "error")

    def validate(self, found: DataFrame, schema: Schema | None = None, **rules) -> DataFrame:
        """Issue rows. Without a schema each message type goes by its installed pack, others by no schema."""
        config = validate.Config(self.settings.strictness, max_errors=self.settings.max_errors)
        if schema is not None:
            return validate.issues(found, schema, config, **rules)
        chosen = {name: s for name, _ in self.packs.list() if (s := self.packs.choose(name, None))}
        parts = [validate.issues(found.filter(F.col("doc_type") == name), s, config, **rules) for name, s in chosen.items()]
        rest = found.filter(~F.coalesce(F.col("doc_type").isin(*chosen), F.lit(False))) if chosen else found
        out = validate.schemaless_issues(rest, config)
        for p in parts:
            out = out.unionByName(p)
        return out

    def report(self, issues: DataFrame, kind: str = "text", most: int = 10_000) -> str:
        return REPORTS[kind](diagnostics.collected(issues, most))

    def documents(self, mapped: DataFrame, mapping: Mapping | str | Path, interchange: str, order: str, sender: str, receiver: str, date: str, time: str, kind: str, first: int = 1, keep: tuple[str, ...] = ("source", "msg_idx")) -> DataFrame:
        """Mapped messages as whole wire documents, one for each value of a column: numbered, within their envelopes."""
        names = [c for c in mapped.columns if c not in (*keep, interchange, order, "error")]
        body = wire.mapped_text(mapped, [n for n in names if wire.TARGET.match(n)], "body")
        return wire.documents(body, interchange, order, F.lit(sender), F.lit(receiver), F.lit(date), F.lit(time), F.lit(kind), first_interchange=first)

    def generate(self, rows: DataFrame, mapping: Mapping | str | Path, order: list[str]) -> DataFrame:
        """Wire text from records: (part, order columns, text). Rules before the loop and after it take the first record."""
        m = self._mapping(mapping)
        if wire.target_format(m.target_type) != "edifact":
            raise MappingError(f"cannot generate {m.target_type}")
        loops = [i for i, r in enumerate(m.rules) if r.kind == "foreach"]
        if len(loops) > 1:
            raise MappingError("one loop at most")
        at = loops[0] if loops else len(m.rules)
        first = rows.orderBy(*order).limit(1)
        parts = [(0, first, m.rules[:at]), *([(1, rows, m.rules[at].rules)] if loops else []), (2, first, m.rules[at + 1 :])]
        out = None
        for number, source, rules in parts:
            if rules:
                own = compiler.transform(source, replace(m, rules=tuple(rules)), tuple(order), self.extensions, self.settings.extended)
                text = wire.mapped_text(own, targets(rules), "text").select(F.lit(number).alias("part"), *order, "text", "error")
                out = text if out is None else out.unionByName(text)
        return out

    def file_summary(self, path: str, schema: Schema | None = None) -> DataFrame:
        """Per file: messages, errors, warnings, is_valid; a file without messages is an error."""
        files = edifact.read(self.spark, path)
        found = self.parse(files.filter(F.col("text").isNotNull()).select("source", "text"))
        return validate.file_summary(files, found, self.validate(found, schema))

    def batch_validate(self, path: str, schema: Schema | None = None) -> Batch:
        """Files under a path: outcome of each, messages of accepted ones, entries for the others."""
        files = edifact.read(self.spark, path)
        found = edifact.grouped(edifact.messages(files.filter(F.col("text").isNotNull()).select("source", "text")))
        counts = self.validate(found, schema).groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        return self._batch(files, found, counts)

    def batch_transform(self, path: str, mapping: Mapping | str | Path) -> Batch:
        files = edifact.read(self.spark, path)
        found = edifact.grouped(edifact.messages(files.filter(F.col("text").isNotNull()).select("source", "text")))
        mapped = self.transform(found, mapping, keep=("source", "msg_idx", "partial"))
        counts = mapped.groupBy("source").agg(F.count("error").alias("errors"), F.count_if("partial").alias("warnings"))
        return self._batch(files, mapped, counts)

    def _batch(self, files: DataFrame, rows: DataFrame, counts: DataFrame) -> Batch:
        broken = edifact.failures(files.filter(F.col("text").isNotNull()).select("source", "text")).withColumnRenamed("error", "parse_error")
        zero = F.lit(0)
        wide = files.join(broken, "source", "left").join(counts, "source", "left")
        error = F.coalesce("error", "parse_error", F.when(F.coalesce("errors", zero) > 0, F.concat(F.col("errors").cast("string"), F.lit(" errors"))))
        marked = outcome.with_outcome(wide.withColumn("why", error), F.col("why"), F.coalesce("warnings", zero) > 0, self.settings.strictness).drop("error", "parse_error")
        split = outcome.split(marked, self.settings.policy)
        bad = marked.filter("outcome = 'failed'") if self.settings.policy == outcome.QUARANTINE else split.rejected
        entries = outcome.quarantined(bad, F.coalesce("why", F.lit("rejected with its batch")), F.col("text"))
        return Batch(rows.join(split.accepted.select("source"), "source", "left_semi"), entries, marked.select("source", "outcome", "why"))

    def lint(self, mapping: Mapping | str | Path, schema: Schema | None = None) -> list[str]:
        return diagnostics.lint(self._mapping(mapping), schema)

    def explain(self, mapping: Mapping | str | Path) -> str:
        return diagnostics.explain(self._mapping(mapping))
