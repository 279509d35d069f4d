"""What several operators share: Arrow text access, rolling hashes, stable row keys, sizing.

Rows are identified by (id, hash of the text, sequence number among identical rows), so a null or repeated id is
never an error. Where an operator needs an order of documents it is: ids ascending, null ids last, then the hash.
"""

from __future__ import annotations

import ctypes
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = np.iinfo(np.int64).max
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `most` bytes of text each (one row at least)."""
    sizes = _lengths(batch.column(column))
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        done, at = int(ends[to - 1]), to


def give_back() -> None:
    """What this process has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; a worker gives back what it has freed, as the tasks of all later stages use it again."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (in place on a copy)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes mod 2**64 of every run of `width` values, by doubling."""
    h, have = values.astype(np.uint64), 1
    parts: list[tuple[np.ndarray, int]] = []
    todo = width
    while todo:
        if todo & 1:
            parts.append((h, have))
        todo >>= 1
        if todo:
            p = np.uint64(pow(base, have, 1 << 64))
            h = h[:-have] * p + h[have:] if len(h) > have else h[:0]
            have *= 2
    n = max(0, len(values) - width + 1)
    out, at = np.zeros(n, np.uint64), 0
    for h, have in parts:
        out = out * np.uint64(pow(base, have, 1 << 64)) + h[at : at + n]
        at += have
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` values, by doubling."""
    have, m = 1, values
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values of x are in a sorted array that is much longer."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    import zstandard

    head = struct.pack("<B", len(arrays))
    body = b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + np.ascontiguousarray(a).tobytes() for a in arrays)
    return head + zstandard.compress(body, 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n, body, at, out = blob[0], zstandard.decompress(blob[1:]), 0, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", body, at)
        at += 10
        a = np.frombuffer(body, "<" + kind.decode(), size, at)
        at += a.nbytes
        out.append(a)
    return out


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 ... (length[0] of them), start[1] ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    keep = length > 0
    start, length = start[keep].astype(np.int64), length[keep].astype(np.int64)
    first = np.cumsum(length) - length
    step[0] = start[0]
    step[first[1:]] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(step)


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of the input: file sizes for a scan, without a job; the texts' sizes where the plan does not tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        columns = [F.octet_length(text_col)] if text_col in df.columns else []
        size = df.agg(F.sum(sum(columns, F.lit(16)))).first()[0] or 0
    return max(1, int(size))


def partitions(df: DataFrame, each: int = 12 << 20, text_col: str = "text") -> int:
    """How many work units of about `each` bytes of input; never under the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df, text_col) // each))


def _times(x: Column, by: int) -> Column:
    """x * by in 32 bits, for x of 32 bits in a long, without overflow on the way."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(by)
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(by)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(x: Column, by: int) -> Column:
    """32 bits rotated to the right."""
    return F.shiftright(x, by).bitwiseOR(F.shiftleft(x, 32 - by)).bitwiseAND(F.lit(0xFFFFFFFF))


def key_of_partition(p: Column) -> Column:
    """The int that hash partitioning deals to partition p, a number from 0 up to that of the partitions.

    Spark's hash of an int (Murmur3, public) can be undone step by step, and p is its own remainder. With these keys each
    work unit has a task of its own; with 0, 1, 2 ... some tasks would get five units and others none.
    """
    inverse = lambda m: pow(m, -1, 1 << 32)
    steps = [
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)),
        lambda x: _times(x, inverse(0xC2B2AE35)),
        lambda x: x.bitwiseXOR(F.shiftright(x, 13)).bitwiseXOR(F.shiftright(x, 26)),
        lambda x: _times(x, inverse(0x85EBCA6B)),
        lambda x: (x.bitwiseXOR(F.shiftright(x, 16)).bitwiseXOR(F.lit(4)) + F.lit((1 << 32) - 0xE6546B64)).bitwiseAND(F.lit(0xFFFFFFFF)),
        lambda x: _times(x, inverse(5)),
        lambda x: _turned(x, 13).bitwiseXOR(F.lit(42)),
        lambda x: _times(x, inverse(0x1B873593)),
        lambda x: _turned(x, 15),
        lambda x: _times(x, inverse(0xCC9E2D51)),
        lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x),
    ]
    x = p.cast("long")
    for step in steps:  # each within a lambda, as a step reads its argument several times
        x = F.get(F.transform(F.array(x), step), F.lit(0))
    return x.cast("int")


def bucketed(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, id, k2, text): the work units of the operators that go over the texts more than once.

    Buckets are keys that hash partitioning into n deals one to a task. Rows of one document always share a bucket, and a null or hot id is spread by its text.
    """
    h = F.xxhash64(F.col(text_col))
    return docs.select(
        key_of_partition(F.pmod(F.xxhash64(F.col(id_col), h), F.lit(n))).alias("bucket"),
        F.col(id_col).cast("long").alias("id"),
        h.alias("k2"),
        F.col(text_col).alias("text"),
    )


def doc_order(id_: pa.Array, k2: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of one bucket: a sorted order, and the key (id, k2, seq) of each row in that order."""
    i = id_.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    k = k2.to_numpy(zero_copy_only=False)
    order = np.lexsort((k, i))
    i, k = i[order], k[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
    at = np.arange(len(i))
    seq = at - np.maximum.accumulate(np.where(new, at, 0)) if len(i) else at
    return order, i, k, seq.astype(np.int32)


_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where a session in one process names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        import tempfile

        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="tradewire-")
    return _OWN_FOLDER[app]


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: the lineage is cut, nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/tradewire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if path.getName().startswith("tradewire-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled by a job that runs within goes when that job ends, not when the driver collects its garbage.

    For operators that store many tables one after another. Spark computes again what is asked for a second time.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], counts: DataFrame, total: int, how: str = "left") -> DataFrame:
    """left join right on `key`, where right has one row per key and some keys hold a large share of left.

    `counts` has the key and n. At most 1000 keys can hold over a thousandth of `total` rows each, so the rows of right
    for those are broadcast; the rest has no hot key and is shuffled.
    """
    hot = counts.filter(F.col("n") > max(1000, total // 1000)).select(key)
    hot_right = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    head = left.join(F.broadcast(hot), key, "left_semi").join(hot_right, key, how)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return head.unionByName(rest)
