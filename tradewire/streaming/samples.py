"""Streaming queries for the driver: interchange files written from a table, then read as a stream until they are used up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire import samples
from tradewire.sources import edifact
from tradewire.streaming import stream


def folder(spark: SparkSession) -> str:
    """Below the cluster's shared folder; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tradewire-stream-")


def batch_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' interchanges as text files of many texts each, streamed, parsed and counted by customer."""
    here = folder(spark)
    samples.customer_interchanges(spark, sf_dir).write.mode("overwrite").parquet(f"{here}/in")
    texts = spark.readStream.schema("source string, text string").option("maxFilesPerTrigger", 4).parquet(f"{here}/in")
    query = stream.write(edifact.messages(texts), f"{here}/out", f"{here}/state", lambda b: b.select("source", "msg_idx", "message_ref"))
    query.awaitTermination()
    return spark.read.parquet(f"{here}/out").groupBy("source").agg(F.count(F.lit(1)).alias("messages"))


def control_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered without gaps by type across micro-batches; per type the highest number and the count agree."""
    here = folder(spark)
    samples.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("item")).repartition(3).write.mode("overwrite").parquet(f"{here}/in")
    rows = spark.readStream.schema("key string, item string").option("maxFilesPerTrigger", 1).parquet(f"{here}/in")
    query = stream.write(stream.numbered(rows, "key"), f"{here}/out", f"{here}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{here}/out").groupBy("key").agg(F.max("number").alias("last"), F.countDistinct("number").alias("n"))


def csv_header_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders streamed to CSV lines in several micro-batches; a second start adds no second header."""
    here = folder(spark)
    samples.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartition(4).write.mode("overwrite").parquet(f"{here}/in")
    for _ in range(2):
        rows = spark.readStream.schema("o_orderkey long, o_orderpriority string").option("maxFilesPerTrigger", 2).parquet(f"{here}/in")
        stream.write_csv(rows, f"{here}/out", f"{here}/state", ["o_orderkey", "o_orderpriority"]).awaitTermination()
    lines = spark.read.text(f"{here}/out/batch=*")
    return lines.groupBy((F.col("value") == "o_orderkey,o_orderpriority").alias("is_header")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("different"))


QUERIES = {"st_csv_header_once": csv_header_once, "st_batch_file_stream": batch_file_stream, "st_control_state": control_state}
SQL = {
    "st_csv_header_once": "SELECT true AS is_header, 1::BIGINT AS n, 1::BIGINT AS different UNION ALL SELECT false, count(*), count(DISTINCT o_orderkey || o_orderpriority) FROM orders",
    "st_batch_file_stream": "SELECT o_custkey::VARCHAR AS source, count(*) AS messages FROM orders GROUP BY 1",
    "st_control_state": "SELECT event_type AS key, count(*) AS last, count(*) AS n FROM events GROUP BY 1",
}
