"""Databases by the Python DB-API: DDL, and rows in transactions of a chunk each, from the partitions of a DataFrame.

A task opens its own connection, again and again with doubled waits if it must. A chunk is committed whole or rolled
back. A task that is run again repeats its chunks: updates and upserts then change nothing, inserts into a table with a
key fail rather than double.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row

from tradewire.functions.text import sql_identifier
from tradewire.sources.tables import BATCH, TableDef, TableError

INSERT, UPDATE, UPSERT = "insert", "update", "upsert"


@dataclass(frozen=True)
class Database:
    """connect opens a connection (it is sent to the tasks). Waits before further attempts: 0.1 s x 2**n, n up to 6."""

    connect: Callable[[], Any]
    retries: int = 0
    timeout_s: float = 5.0
    marker: str = "?"

    def open(self, sleep: Callable[[float], None] = time.sleep) -> Any:
        began = time.monotonic()
        for n in range(self.retries + 1):
            try:
                return self.connect()
            except Exception:  # whatever the driver raises
                wait = 0.1 * 2 ** min(n, 6)
                if n == self.retries or time.monotonic() + wait - began > self.timeout_s:
                    raise
                sleep(wait)
        raise AssertionError

    def apply(self, *tables: TableDef) -> None:
        """Creates the tables that are not there, all or none."""
        c = self.open()
        try:
            for t in tables:
                c.cursor().execute(t.create_sql())
            c.commit()
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def write(self, rows: DataFrame, table: TableDef, mode: str = INSERT, key: str | None = None, batch: int = BATCH) -> None:
        """Rows by insert, update or upsert on a key, `batch` of them in a transaction."""
        names = [c.name for c in table.columns if c.name in rows.columns]
        statement, order = self.statement(table, names, mode, key)
        if batch < 1:
            raise TableError("a batch has at least one row")
        unknown = set(rows.columns) - set(names)
        if unknown:
            raise TableError(f"unknown columns {sorted(unknown)}")
        database = self

        def run(part: Iterator[Row]) -> None:
            c = None
            try:
                for chunk in chunks(part, batch):
                    c = c or database.open()
                    try:
                        c.cursor().executemany(statement, [tuple(plain(r[n]) for n in order) for r in chunk])
                        c.commit()
                    except Exception:
                        c.rollback()
                        raise
            finally:
                if c:
                    c.close()

        rows.select(*[f"`{n}`" for n in names]).foreachPartition(run)

    def statement(self, table: TableDef, names: list[str], mode: str, key: str | None) -> tuple[str, list[str]]:
        """SQL with markers, and the columns they take in order."""
        if mode not in (INSERT, UPDATE, UPSERT):
            raise TableError(f"unknown mode: {mode}")
        if mode != INSERT and key not in names:
            raise TableError(f"{mode} wants a key among the columns")
        own, m = sql_identifier(table.name), self.marker
        rest = [n for n in names if n != key]
        into = f"INSERT INTO {own} ({', '.join(map(sql_identifier, names))}) VALUES ({', '.join([m] * len(names))})"
        if mode == INSERT:
            return into, names
        if mode == UPDATE:
            return f"UPDATE {own} SET {', '.join(f'{sql_identifier(n)} = {m}' for n in rest)} WHERE {sql_identifier(key)} = {m}", [*rest, key]
        then = f"DO UPDATE SET {', '.join(f'{sql_identifier(n)} = excluded.{sql_identifier(n)}' for n in rest)}" if rest else "DO NOTHING"
        return f"{into} ON CONFLICT ({sql_identifier(key)}) {then}", names


def plain(x: Any) -> Any:
    """Dates and times as text; other values as they are."""
    return x.isoformat() if hasattr(x, "isoformat") else x


def chunks(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    held: list[Row] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
