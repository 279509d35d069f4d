"""A quarantine that lasts: a folder with the table of entries, which every change replaces as a whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.operators import outcome
from tradewire.sources import tables

SCHEMA = "id string, source string, reason string, retry_count int, permanent boolean, at timestamp, payload string"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    most_retries: int = 3
    most_entries: int = 1000
    days: int = 7

    def entries(self) -> DataFrame:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        there = jvm.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm.Path(self.path))
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def add(self, new: DataFrame) -> None:
        """New entries; an id that is there already gets a further number. A full store takes no more."""
        old = self.entries()
        known = old.select(F.col("id").alias("known"))
        # Ids are the source's name, or that and -2, -3 ...: new ones go on after the highest number of their name.
        base, number = F.regexp_replace("id", "-[0-9]+$", ""), F.coalesce(F.regexp_extract("id", "-([0-9]+)$", 1).try_cast("int"), F.lit(1))
        clash = new.join(known, new["id"] == known["known"], "left_semi")
        highest = old.withColumn("base", base).groupBy("base").agg(F.max(number).alias("high"))
        again = clash.withColumn("base", base).withColumn("n", number).join(highest, "base", "left").withColumn("id", F.concat_ws("-", "base", (F.coalesce("high", F.lit(1)) + F.col("n")).cast("string"))).select(*new.columns)
        fresh = new.join(known, new["id"] == known["known"], "left_anti")
        self._put(outcome.newest(old.unionByName(fresh.unionByName(again)), self.most_entries))

    def list(self) -> DataFrame:
        return outcome.listed(self.entries())

    def show(self, id_: str) -> DataFrame:
        return self.list().filter(F.col("id") == id_)

    def retry(self, process: Callable[[DataFrame], DataFrame], ids: list[str] | None = None) -> DataFrame:
        """process gives (id, error) of retryable entries; those without an error go, the others count up. Returns them."""
        all_ = self.entries()
        chosen = all_ if ids is None else all_.filter(F.col("id").isin(*ids))
        tried = process(outcome.retryable(chosen, self.most_retries)).select("id", "error")
        tried = self.spark.createDataFrame(tried.collect(), "id string, error string")  # at most most_entries rows
        left = outcome.retried(all_.join(tried, "id", "left_semi"), tried.filter(F.col("error").isNull()), self.most_retries)
        self._put(all_.join(tried, "id", "left_anti").unionByName(left))
        return tried

    def remove(self, ids: list[str]) -> None:
        self._put(outcome.removed(self.entries(), ids))

    def clean(self, now: str | None = None) -> int:
        """Drops entries beyond their days; says how many."""
        old = self.entries()
        kept = outcome.cleaned(old, F.current_timestamp() if now is None else F.to_timestamp(F.lit(now)), self.days)
        n = old.count()
        self._put(kept)
        return n - self.entries().count()

    def export(self, path: str) -> None:
        """Payloads and what is known of them as JSON lines, one for each entry."""
        self.entries().orderBy("id").select(F.to_json(F.struct("*")).alias("value")).write.text(path)

    def stats(self) -> DataFrame:
        return outcome.quarantine_stats(self.entries())

    def _put(self, entries: DataFrame) -> None:
        tables.commit(entries.select(*[c.split()[0] for c in SCHEMA.split(", ")]), self.path)
