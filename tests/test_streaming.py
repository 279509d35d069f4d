"""Streams of files and state that lasts."""

from pyspark.sql import functions as F

from tradewire.sources import edifact
from tradewire.streaming import stream

MESSAGE = "UNH+{0}+ORDERS:D'BGM+220+{0}'UNT+3+{0}'"


def test_files_as_they_come(spark, tmp_path):
    where = {n: tmp_path / n for n in ("in", "out", "state")}
    where["in"].mkdir()
    for i in range(3):
        (where["in"] / f"{i}.edi").write_text(MESSAGE.format(i))
    run = lambda: stream.write(stream.messages(spark, str(where["in"]), per_trigger=2), str(where["out"]), str(where["state"]), lambda b: b.select("message_ref")).awaitTermination()
    run()
    (where["in"] / "9.edi").write_text(MESSAGE.format(9))
    run()
    assert sorted(r[0] for r in spark.read.parquet(str(where["out"])).select("message_ref").collect()) == ["0", "1", "2", "9"]


def test_numbers_go_on(spark, tmp_path):
    where = {n: str(tmp_path / n) for n in ("in", "out", "state")}
    for batch in range(2):
        spark.createDataFrame([("a", f"{batch}-{i}") for i in range(3)] + [("b", f"{batch}")], "key string, item string").coalesce(1).write.mode("append").parquet(where["in"])
        rows = spark.readStream.schema("key string, item string").parquet(where["in"])
        stream.write(stream.numbered(rows, "key"), where["out"], where["state"]).awaitTermination()
    got = spark.read.parquet(where["out"]).groupBy("key").agg(F.sort_array(F.collect_list("number")).alias("n"))
    assert {r["key"]: r["n"] for r in got.collect()} == {"a": [1, 2, 3, 4, 5, 6], "b": [1, 2]}
    assert edifact.GROUPED
