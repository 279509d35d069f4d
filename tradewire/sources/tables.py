"""Relational tables: reading with filters, writing with insert, update, upsert; checks and DDL.

A changed table is a new DataFrame; `commit` writes it beside the old one and swaps, so a failed write leaves the old one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.functions.text import sql_identifier

TYPES = {"string": "TEXT", "integer": "INTEGER", "decimal": "REAL", "boolean": "BOOLEAN"}
SPARK = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean"}
BATCH = 500


class TableError(ValueError):
    """Rows or filters that do not fit a table."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str = "string"
    nullable: bool = True
    primary_key: bool = False
    foreign_key: tuple[str, str] | None = None


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]

    def create_sql(self) -> str:
        parts = []
        for c in self.columns:
            parts.append(f"{sql_identifier(c.name)} {TYPES[c.kind]}" + " PRIMARY KEY" * c.primary_key + " NOT NULL" * (not c.nullable and not c.primary_key) + (f" REFERENCES {sql_identifier(c.foreign_key[0])}({sql_identifier(c.foreign_key[1])})" if c.foreign_key else ""))
        return f"CREATE TABLE IF NOT EXISTS {sql_identifier(self.name)} ({', '.join(parts)})"

    def spark_sql(self) -> str:
        return ", ".join(f"`{c.name}` {SPARK[c.kind]}" for c in self.columns)


@dataclass(frozen=True)
class Connection:
    """A JDBC source; retries with doubled waits are left to task retries."""

    url: str
    properties: tuple[tuple[str, str], ...] = ()

    def read(self, spark: SparkSession, table: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        options = dict(self.properties)
        if partition:
            column, low, high, n = partition
            return spark.read.jdbc(self.url, table, column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=options)
        return spark.read.jdbc(self.url, table, properties=options)

    def append(self, df: DataFrame, table: str, batch: int = BATCH) -> None:
        if batch < 1:
            raise TableError("a batch has at least one row")
        df.write.option("batchsize", batch).jdbc(self.url, table, mode="append", properties=dict(self.properties))


def matching(filters: dict[str, object]) -> Column:
    """Equality on all columns; None means null."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in filters.items()], F.lit(True))


def read(df: DataFrame, filters: dict[str, object] | None = None, order: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filter, offset, limit. An order makes limits repeatable."""
    out = df.filter(matching(filters)) if filters else df
    out = out.orderBy(*order) if order else out
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def read_single(df: DataFrame, filters: dict[str, object], order: list[str] | None = None) -> DataFrame:
    return read(df, filters, order, 1)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def typed(df: DataFrame, table: TableDef) -> DataFrame:
    """Columns as declared; what cannot be cast is null, and `error` names the first such column."""
    made = []
    for c in table.columns:
        text = F.col(f"`{c.name}`").cast("string")
        v = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint")) if c.kind == "integer" else text.try_cast(SPARK[c.kind])
        made.append((c.name, v, F.when(text.isNotNull() & v.isNull(), F.lit(f"{c.name} is not {c.kind}"))))
    return df.select(*[v.alias(n) for n, v, _ in made], F.coalesce(*[e for _, _, e in made]).alias("error"))


def row_error(df: DataFrame, table: TableDef, partial: bool = False) -> Column:
    """Missing and unknown columns are errors of the plan; nulls in columns that forbid them, then values of another type, are errors of a row."""
    names = {c.name for c in table.columns}
    unknown = [c for c in df.columns if c not in names]
    missing = [c.name for c in table.columns if c.name not in df.columns and not c.nullable]
    if unknown or (missing and not partial):
        raise TableError(f"unknown columns {unknown}, missing columns {[] if partial else missing}")
    said = [F.when(F.col(f"`{c.name}`").isNull(), F.lit(f"{c.name} must not be null")) for c in table.columns if not c.nullable and c.name in df.columns]
    for c in table.columns:
        if c.name in df.columns:
            text = F.col(f"`{c.name}`").cast("string")
            fits = text.rlike(r"^\s*[+-]?\d+\s*$") if c.kind == "integer" else F.lit(True) if c.kind == "string" else text.try_cast(SPARK[c.kind]).isNotNull()
            said.append(F.when(text.isNotNull() & ~fits, F.lit(f"{c.name} is not {c.kind}")))
    return F.coalesce(*said, F.lit(None).cast("string"))


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def update(target: DataFrame, filters: dict[str, object], values: dict[str, object]) -> DataFrame:
    if not filters or not values:
        raise TableError("an update has a filter and values")
    hit = matching(filters)
    kinds = dict(target.dtypes)
    return target.select(*[F.when(hit, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in target.columns])


def upsert(target: DataFrame, rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Incoming rows replace those of their key. Of a repeated key the last by `order` stays, with ties, or without an
    order, the largest by the other columns. Keys that are null never match, and rows with them all stay.
    """
    names = [f"`{c}`" for c in target.columns]
    last = F.max(F.struct(*[F.col(f"`{c}`").alias(f"order {i}") for i, c in enumerate(order or [])], F.struct(*names).alias("row"))).alias("last")
    known = rows.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("of key")).agg(last).select("last.row.*")
    incoming = known.unionByName(rows.filter(F.col(f"`{key}`").isNull()).select(*names))
    return target.join(known.select(key), key, "left_anti").select(*names).unionByName(incoming)


def commit(df: DataFrame, path: str, batches: int | None = None) -> None:
    """Writes beside the table, then swaps: the old rows stand until the new ones are complete."""
    spark = df.sparkSession
    staging, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    (df.repartition(batches) if batches else df).write.parquet(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(jvm.Path(path))
    if had and not fs.rename(jvm.Path(path), jvm.Path(old)):
        raise TableError(f"cannot move {path}")
    if not fs.rename(jvm.Path(staging), jvm.Path(path)):
        if had:
            fs.rename(jvm.Path(old), jvm.Path(path))
        raise TableError(f"cannot put {path} in place")
    if had:
        fs.delete(jvm.Path(old), True)


def rollback(path: str, spark: SparkSession) -> None:
    """Drops what an interrupted commit left."""
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(jvm.Path(f"{path}.new-*")) or []:
        fs.delete(f.getPath(), True)


def cells(df: DataFrame, key: str) -> DataFrame:
    """The `DB` tree of a table: a Record for each row, its columns in name order."""
    names = sorted(c for c in df.columns if c != key)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    return df.select(key, F.posexplode(pairs).alias("ordinal", "c")).select(key, "ordinal", "c.name", "c.value")
