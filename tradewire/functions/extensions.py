"""Named, versioned sets of functions on values, with hooks; resolved when a plan is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tradewire.functions.transforms import Value, number

Function = Callable[[list[Value]], Value]


class ExtensionError(KeyError):
    """An unknown extension or function, or a wrong number of arguments."""


@dataclass
class Extension:
    name: str
    version: str
    functions: dict[str, Function] = field(default_factory=dict)
    init: Callable[[], None] | None = None
    cleanup: Callable[[], None] | None = None


class Registry:
    """init runs when an extension is registered, cleanup when it goes."""

    def __init__(self, builtin: bool = True) -> None:
        self.known: dict[str, Extension] = {}
        if builtin:
            self.register(string_utils())
            self.register(math_utils())

    def register(self, x: Extension) -> None:
        if x.init:
            x.init()
        self.known[x.name] = x

    def unregister(self, name: str) -> bool:
        x = self.known.pop(name, None)
        if x and x.cleanup:
            x.cleanup()
        return x is not None

    def cleanup_all(self) -> None:
        for name in list(self.known):
            self.unregister(name)

    def names(self) -> list[str]:
        return sorted(self.known)

    def call(self, name: str, function: str, args: list[Value]) -> Value:
        if name not in self.known:
            raise ExtensionError(f"no extension {name}; there are {', '.join(self.names())}")
        own = self.known[name].functions
        if function not in own:
            raise ExtensionError(f"no function {function} in {name}; there are {', '.join(sorted(own))}")
        return own[function](args)


def _take(args: list[Value], n: int) -> list[Value]:
    if len(args) != n:
        raise ExtensionError(f"{n} arguments are wanted, {len(args)} given")
    return args


def reverse(args: list[Value]) -> Value:
    (s,) = _take(args, 1)
    return Value(F.reverse(s.text), "string", s.error)


def replace(args: list[Value]) -> Value:
    s, a, b = _take(args, 3)
    return Value(F.replace(s.text, a.text, b.text), "string", s.error)


def substring(args: list[Value]) -> Value:
    """Of bytes start to end (exclusive); out of bounds is an error."""
    s, start, end = _take(args, 3)
    a, z = number(start, "start").column.cast("int"), number(end, "end").column.cast("int")
    raw = F.encode(s.text, "UTF-8")
    ok = (a >= 0) & (a <= z) & (z <= F.octet_length(s.text))
    error = F.when(s.text.isNotNull() & ~ok, F.lit("substring out of bounds"))
    return Value(F.when(ok, F.decode(F.substring(raw, a + 1, z - a), "UTF-8")), "string", s.with_error(error))


def _two(args: list[Value], op) -> Value:
    a, b = (number(x, "argument") for x in _take(args, 2))
    null = F.when(a.column.isNull() | b.column.isNull(), F.lit("argument is no number"))
    return Value(op(a.column, b.column), "double", b.with_error(a.with_error(null)))


def string_utils() -> Extension:
    return Extension("string_utils", "1.0.0", {"reverse": reverse, "replace": replace, "substring": substring})


def math_utils() -> Extension:
    return Extension("math_utils", "1.0.0", {"add": lambda x: _two(x, lambda a, b: a + b), "multiply": lambda x: _two(x, lambda a, b: a * b)})


# --- stages over serialized text ---------------------------------------------------------------------------------------


def mapped_text(df: DataFrame, column: str, stage: Callable[[str], str], out: str = "mapped") -> DataFrame:
    """A user's mapper from a document's text to another, by Arrow batches. Adds out, and error where it raised."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, errors = [], []
            for text in b.column(column).to_pylist():
                try:
                    made.append(None if text is None else stage(text))
                    errors.append(None)
                except Exception as e:  # whatever a user's stage raises is the error of its row
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string()), pa.array(errors, pa.string())], names=[*kept, out, "error"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType()), StructField("error", StringType())]))


def validated_text(df: DataFrame, column: str, stage: Callable[[str], list[tuple[str, str, str]]]) -> DataFrame:
    """A user's validator from a document's text to (severity, code, message) findings; adds issues, and error where it raised."""
    kind = pa.list_(pa.struct([("severity", pa.string()), ("code", pa.string()), ("message", pa.string())]))
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for text in b.column(column).to_pylist():
                try:
                    found.append([] if text is None else [dict(zip(("severity", "code", "message"), x, strict=True)) for x in stage(text)])
                    errors.append(None)
                except Exception as e:  # as above
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind), pa.array(errors, pa.string())], names=[*kept, "issues", "error"])

    finding = StructType([StructField(n, StringType()) for n in ("severity", "code", "message")])
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("issues", ArrayType(finding)), StructField("error", StringType())]))
