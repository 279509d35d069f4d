"""Structured Streaming: files of interchanges in, mapped rows out, control numbers that outlive a query.

The plans are the batch ones; checkpoints hold the file offsets. Writes per micro-batch are keyed by batch id, so a
replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradewire.operators.wire import csv_line
from tradewire.sources import edifact


def texts(spark: SparkSession, path: str, glob: str = "*.edi", per_trigger: int = 100) -> DataFrame:
    """(source, text): new files as they come, `per_trigger` at once."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return raw.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))


def messages(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return edifact.messages(texts(spark, path, **options))


def write(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch through `transform` to Parquet under batch=<id>; with `once` all that is there, then it ends."""

    def one(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_csv(stream: DataFrame, target: str, checkpoint: str, names: list[str], delimiter: str = ",", null: str = "", once: bool = True) -> StreamingQuery:
    """Each micro-batch as CSV lines under batch=<id>, and the header once, under batch=header, before the first of them."""
    lines = stream.select(csv_line([F.col(f"`{n}`") for n in names], delimiter, null).alias("value"))
    header(stream.sparkSession, f"{target}/batch=header", names, delimiter)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").text(f"{target}/batch={number}")

    writer = lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def header(spark: SparkSession, path: str, names: list[str], delimiter: str = ",") -> None:
    """Writes a header that is not there; another one than there is, is an error."""
    line = spark.range(1).select(csv_line([F.lit(n) for n in names], delimiter).alias("value"))
    jvm = spark._jvm.org.apache.hadoop.fs
    if jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path)):
        if spark.read.text(path).collect() != line.collect():
            raise ValueError(f"{path} has another header")
        return
    line.coalesce(1).write.text(path)


def numbered(stream: DataFrame, key: str) -> DataFrame:
    """Adds number: gap-free from 1 for each key, across micro-batches. stream: (key, item)."""
    schema = f"{key} string, item string, number long"

    def one(k: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        # In order of the items of a key's whole micro-batch, however it is cut into frames.
        items = sorted(x for f in frames for x in f["item"].tolist())
        state.update((last + len(items),))
        yield pd.DataFrame({key: [k[0]] * len(items), "item": items, "number": range(last + 1, last + 1 + len(items))})

    return stream.select(F.col(key).cast("string").alias(key), F.col("item").cast("string").alias("item")).groupBy(key).applyInPandasWithState(one, schema, "last long", "append", "NoTimeout")


def progress(query: StreamingQuery) -> dict:
    """Rows and rates of the last micro-batch."""
    p = query.lastProgress or {}
    return {"batch": p.get("batchId"), "rows": p.get("numInputRows", 0), "rows_per_s": p.get("processedRowsPerSecond", 0.0)}
