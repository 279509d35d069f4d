"""CSV: reading strictly or by cell, typed or inferred, checked by row; all from text lines with expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
NULLS = ("", "NULL", r"\N")
TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")
INTEGER, DECIMAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
TYPES = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "string", "datetime": "string", "time": "string"}


@dataclass(frozen=True)
class Options:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    header: bool = True
    encoding: str = "UTF-8"
    nulls: tuple[str, ...] = NULLS
    line_separator: str | None = None

    def spark(self) -> dict[str, str]:
        out = {"sep": self.delimiter, "quote": self.quote, "escape": self.escape, "header": str(self.header).lower(), "encoding": self.encoding, "multiLine": "true", "nullValue": "\0", "emptyValue": "", "mode": "FAILFAST", "enforceSchema": "false"}
        return out | ({"lineSep": self.line_separator} if self.line_separator else {})


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    default: str | None = None


def read(spark: SparkSession, path: str, options: Options = Options(), names: list[str] | None = None) -> DataFrame:
    """All columns as text; a row of another width fails. Without a header columns are col_0, col_1 ..."""
    df = spark.read.options(**options.spark()).csv(path)
    return df if options.header and names is None else df.toDF(*(names or [f"col_{i}" for i in range(len(df.columns))]))


def stream(spark: SparkSession, path: str, names: list[str], options: Options = Options(), per_trigger: int = 100) -> DataFrame:
    """The same as a stream of files."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.readStream.schema(schema).options(**options.spark(), maxFilesPerTrigger=str(per_trigger)).csv(path)


def cells(lines: DataFrame, line: str = "line", options: Options = Options()) -> DataFrame:
    """Adds `cells`: the line's fields. Quotes are taken off, doubled ones undone."""
    d, q = ("\\" + x for x in (options.delimiter, options.quote))
    raw = F.regexp_extract_all(F.concat(F.lit(options.delimiter), F.col(line)), F.lit(f"{d}((?:{q}(?:[^{q}]|{q}{q})*+{q})|[^{d}]*+)"), F.lit(1))
    plain = F.transform(raw, lambda x: F.when(x.startswith(options.quote), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit(options.quote * 2), F.lit(options.quote))).otherwise(x))
    return lines.withColumn("cells", plain)


def width_error(cells_: Column, width: int) -> Column:
    n = F.size(cells_)
    return F.when(n < width, F.concat(F.lit("missing columns: "), n.cast("string"), F.lit(f" of {width}"))).when(n > width, F.concat(F.lit("extra columns: "), n.cast("string"), F.lit(f" of {width}")))


def is_null(c: Column, nulls: tuple[str, ...] = NULLS) -> Column:
    return c.isNull() | c.isin(*nulls)


def boolean(c: Column) -> Column:
    return F.when(F.lower(c).isin(*TRUE), F.lit(True)).when(F.lower(c).isin(*FALSE), F.lit(False))


def typed(c: Column, kind: str, nulls: tuple[str, ...] = NULLS) -> tuple[Column, Column]:
    """(value, error) of a cell under a declared type; dates stay text."""
    v = F.when(~is_null(c, nulls), c)
    if kind == "integer":
        out = F.when(v.rlike(INTEGER), v.try_cast("bigint"))
    elif kind == "decimal":
        out = F.when(v.rlike(DECIMAL), v.try_cast("double"))
    elif kind == "boolean":
        out = boolean(v)
    else:
        return v, F.lit(None).cast("string")
    return out, F.when(v.isNotNull() & out.isNull(), F.concat(F.lit(f"not a {kind}: '"), v, F.lit("'")))


def typed_rows(df: DataFrame, fields: list[Field], keep: tuple[str, ...] = (), nulls: tuple[str, ...] = NULLS) -> DataFrame:
    """Declared types on all fields; `error` has the first cell that is not of its type."""
    made = [(f.name, *typed(F.col(f"`{f.name}`").cast("string"), f.kind, nulls)) for f in fields]
    return df.select(*keep, *[v.alias(n) for n, v, _ in made], F.coalesce(*[e for _, _, e in made]).alias("error"))


def inferred(c: Column, nulls: tuple[str, ...] = NULLS) -> Column:
    """A cell by itself: integer, then decimal, then boolean, then text, as struct<kind, i, d, b, s>."""
    v = F.when(~is_null(c, nulls), c)
    i = F.when(v.rlike(INTEGER), v.try_cast("bigint"))
    d = F.when(i.isNull() & v.rlike(DECIMAL), v.try_cast("double"))
    b = F.when(i.isNull() & d.isNull(), boolean(v))
    kind = F.when(v.isNull(), "null").when(i.isNotNull(), "integer").when(d.isNotNull(), "decimal").when(b.isNotNull(), "boolean").otherwise("string")
    return F.struct(kind.alias("kind"), i.alias("i"), d.alias("d"), b.alias("b"), F.when(kind == "string", v).alias("s"))


def row_error(fields: list[Field], nulls: tuple[str, ...] = NULLS) -> Column:
    """The first of: a required field without a value, a value over its length in bytes."""
    said = []
    for f in fields:
        c = F.col(f"`{f.name}`").cast("string")
        if f.required:
            said.append(F.when(is_null(c, nulls), F.lit(f"{f.name} is required")))
        if f.max_length is not None:
            said.append(F.when(F.octet_length(c) > f.max_length, F.lit(f"{f.name} is over {f.max_length} bytes")))
    return F.coalesce(*said, F.lit(None).cast("string"))


def write(df: DataFrame, path: str, options: Options = Options(), null: str = "") -> None:
    df.write.mode("errorifexists").options(sep=options.delimiter, quote=options.quote, escape=options.escape, header=str(options.header).lower(), nullValue=null).csv(path)
