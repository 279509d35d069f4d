"""What becomes of messages and files: policies, quarantine, batches, retries, counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPT_ALL, FAIL_ALL, QUARANTINE = "accept_all", "fail_all", "quarantine"


@dataclass(frozen=True)
class Split:
    accepted: DataFrame
    rejected: DataFrame


def with_outcome(rows: DataFrame, error: Column, warned: Column | None = None, strictness: str = "standard") -> DataFrame:
    """Adds outcome: ok, warned or failed. In strict mode warnings fail too."""
    w = F.lit(False) if warned is None else warned
    failed = error.isNotNull() | (w if strictness == "strict" else F.lit(False))
    return rows.withColumn("outcome", F.when(failed, "failed").when(w, "warned").otherwise("ok"))


def split(rows: DataFrame, policy: str, by: str | None = None) -> Split:
    """By policy: all rows stay; or one failure rejects all rows of its group (of everything without `by`); or only failed ones go."""
    failed = F.col("outcome") == "failed"
    if policy == ACCEPT_ALL:
        return Split(rows, rows.limit(0))
    if policy == QUARANTINE:
        return Split(rows.filter(~failed), rows.filter(failed))
    if policy != FAIL_ALL:
        raise ValueError(f"unknown policy: {policy}")
    if by is None:
        any_ = rows.agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("any"))
        marked = rows.crossJoin(F.broadcast(any_))  # one row
    else:
        bad = rows.filter(failed).select(by).distinct().withColumn("any", F.lit(True))
        marked = rows.join(bad, by, "left").withColumn("any", F.coalesce("any", F.lit(False)))
    return Split(marked.filter(~F.col("any")).drop("any"), marked.filter("any").drop("any"))


def until_first_failure(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Of each group the rows up to and with the first failed one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.when(F.col("outcome") == "failed", 1).otherwise(0)).over(w), F.lit(0))
    return rows.withColumn("before", before).filter("before = 0").drop("before")


def batch_report(files: DataFrame, quarantined_: DataFrame, outputs: DataFrame) -> DataFrame:
    """batch_summary and the counts of quarantined entries and of outputs."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return batch_summary(files).crossJoin(n(quarantined_, "quarantined")).crossJoin(n(outputs, "outputs"))  # one row each


def batch_summary(files: DataFrame) -> DataFrame:
    """One row: processed, succeeded, warned, failed, success_rate (100 for nothing)."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("outcome") == "ok")
    return files.agg(n.alias("processed"), ok.alias("succeeded"), F.count_if(F.col("outcome") == "warned").alias("warned"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.when(n == 0, F.lit(100.0)).otherwise(F.count_if(F.col("outcome") != "failed") * 100.0 / n).alias("success_rate"))


def exit_code(outcome: Column) -> Column:
    return F.when(outcome == "failed", 2).when(outcome == "warned", 1).otherwise(0)


def worst_exit(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.max(exit_code(F.col("outcome"))), F.lit(0)).alias("exit_code"))


def metrics(run: DataFrame, elapsed_s: float) -> DataFrame:
    """run: (source, messages, bytes, outcome). Rates are 0 where nothing ran."""
    files, t = F.count(F.lit(1)), F.lit(elapsed_s)
    rate = lambda x: F.when(t > 0, x / t).otherwise(0.0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return run.agg(
        rate(files).alias("files_per_s"), rate(total("messages")).alias("messages_per_s"), F.when(files > 0, t * 1000 / files).otherwise(0.0).alias("avg_ms_per_file"),
        F.when(files > 0, F.count_if(F.col("outcome") == "failed") * 100.0 / files).otherwise(0.0).alias("error_rate"), rate(total("bytes") * 8 / 1e6).alias("mbit_per_s"),
    )


# --- quarantine: a table of (id, source, reason, error, retry_count, permanent, at, payload) ----------------------------


def quarantined(rejected: DataFrame, reason: Column, payload: Column, at: Column | None = None) -> DataFrame:
    """Entries with ids from the source's name; further ones of the same name get -2, -3 ..."""
    base = F.regexp_replace("source", "[^A-Za-z0-9]", "-")
    n = F.row_number().over(Window.partitionBy("base").orderBy("source", "order"))
    order = F.col("msg_idx") if "msg_idx" in rejected.columns else F.lit(0)
    rows = rejected.withColumn("base", base).withColumn("order", order)
    id_ = F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string")))
    return rows.select(id_.alias("id"), "source", reason.alias("reason"), F.lit(0).alias("retry_count"), F.lit(False).alias("permanent"), (F.current_timestamp() if at is None else at).alias("at"), payload.alias("payload"))


def by_reason(entries: DataFrame, reason: str) -> DataFrame:
    return entries.filter(F.col("reason") == reason)


def retryable(entries: DataFrame, most: int = 3) -> DataFrame:
    return entries.filter(~F.col("permanent") & (F.col("retry_count") < most))


def retried(entries: DataFrame, succeeded: DataFrame, most: int = 3) -> DataFrame:
    """After a retry: ids that succeeded go, others count up and become permanent at the limit."""
    left = entries.join(succeeded.select("id").distinct(), "id", "left_anti")
    again = ~F.col("permanent") & (F.col("retry_count") < most)
    counted = left.withColumn("retry_count", F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")))
    return counted.withColumn("permanent", F.col("permanent") | (F.col("retry_count") >= most))


def removed(entries: DataFrame, ids: list[str]) -> DataFrame:
    return entries.filter(~F.col("id").isin(*ids)) if ids else entries


def cleaned(entries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return entries.filter(F.col("at") >= now - F.make_interval(days=F.lit(days)))


def newest(entries: DataFrame, most: int = 1000) -> DataFrame:
    """A full store takes no more: the first `most` by time stay."""
    return entries.orderBy("at", "id").limit(most)


def listed(entries: DataFrame) -> DataFrame:
    """By id, with the start of the payload."""
    return entries.select("id", "source", "reason", "retry_count", "permanent", "at", snippet(F.col("payload")).alias("snippet")).orderBy("id")


def quarantine_totals(before: DataFrame, after: DataFrame, cleaned_: DataFrame | None = None) -> DataFrame:
    """One row: total (ever, of these), current, retried (entries with a retry), failed (permanent), cleaned."""
    lost = F.lit(0).cast("long") if cleaned_ is None else F.lit(before.join(cleaned_.select("id"), "id", "left_anti").count())
    total = before.count()
    return after.agg(F.lit(total).cast("long").alias("total"), F.count(F.lit(1)).alias("current"), F.count_if(F.col("retry_count") > 0).alias("retried"), F.count_if("permanent").alias("failed"), lost.cast("long").alias("cleaned"))


def quarantine_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("current"), F.coalesce(F.sum("retry_count"), F.lit(0)).cast("long").alias("retries"), F.count_if("permanent").alias("permanent"))


def snippet(c: Column, size: int = 240) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


# --- batches ----------------------------------------------------------------------------------------------------------


def batches(rows: DataFrame, size: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds batch: consecutive rows of a group, `size` in each."""
    n = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("long"))


def with_retries(items: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], most: int = 3) -> DataFrame:
    """Items with what attempt(items, number) adds, error among it, and attempts: what fails is tried `most` times more."""
    done, left = None, items
    for n in range(1, most + 2):
        tried = attempt(left, n).withColumn("attempts", F.lit(n))
        out = tried if n == most + 1 else tried.filter(F.col("error").isNull())
        done = out if done is None else done.unionByName(out)
        if n <= most:
            left = tried.filter(F.col("error").isNotNull()).select(*items.columns)
            if left.isEmpty():
                break
    return done


def item_results(items: DataFrame, most_retries: int) -> DataFrame:
    """Status to result: success, retry or failed. What was never processed has failed."""
    s = F.col("status")
    return items.withColumn("result", F.when(s == "success", "success").when(s.isin("failed", "retrying") & (F.col("retry_count") < most_retries), "retry").otherwise("failed"))
