"""Approximate nearest neighbours by cosine: inverted lists, scanned by an adaptive dimension test.

Equal vectors are one candidate with their few smallest ids (no more can be wanted), so a very common vector costs one
row. Candidates are scaled to length one, rotated by a random orthogonal matrix and dealt to the list of their nearest
centroid; a query goes to its `probes` nearest lists. Within a list candidates stand in column blocks. After each block
a query's partial squared distances, scaled up to all dimensions, are tested against its threshold (the k-th distance so
far): rotated dimensions are exchangeable, so a candidate beyond threshold x (1 + e / sqrt(seen))**2 is abandoned with
a bounded chance of error. What is left is scored by the exact cosine of the original vectors, in double precision.

Centroids are fitted on `sample` vectors at most; every vector is indexed. The number of lists to probe is measured on
that sample against brute force; a query whose lists hold fewer than it wants goes to four times as many, until it has
enough or has seen all lists. Lists are cut into blocks of bounded size by a hash, and a list's queries into runs of
bounded size.

Defined results: rows with a null id, or vectors that are null, zero, or hold null or non-finite components, or differ
in length from the most common one (the shorter of equals), take no part. Rows with the query's id are its own, repeated
ones too; a repeated query id is searched once for each distinct vector. Ties go to the smaller id: no cut is made
between equal scores before ids are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewire.llm.common import dropped, hot_join, stored

K = 5
SAMPLE = 32_768
EPSILON = 2.1
COLUMNS = 16
BLOCK = 4096
RUN = 1024


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, own, sample)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(size > 0, new / np.where(size > 0, size, 1), c)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, share: float = 0.98, queries: int = 256) -> int:
    """How many lists hold `share` of the true neighbours of sample vectors among the sample, by brute force.

    Neighbours in all vectors are nearer than those in a sample, so this errs on the side of more lists.
    """
    own = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
    ranks = []
    for a in range(0, min(queries, len(sample)), 32):
        q = sample[a : a + 32]
        near = q @ sample.T
        near[np.arange(len(q)), np.arange(a, a + len(q))] = -np.inf
        best = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]
        place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
        ranks.append(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), share, method="higher")) + 1


def adaptive_scan(query: np.ndarray, columns: list[np.ndarray], k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of at least the k nearest that survive. columns: blocks of (dims, candidates)."""
    n, d = columns[0].shape[1], sum(len(c) for c in columns)
    parts = np.split(query, np.cumsum([len(c) for c in columns])[:-1])
    first = np.arange(min(n, max(4 * k, 64)))
    near = sum(((c[:, : len(first)] - p[:, None]) ** 2).sum(axis=0) for c, p in zip(columns, parts, strict=True))
    if n <= len(first):
        return first, near
    limit = np.partition(near, k - 1)[k - 1]
    at, sums, seen = np.arange(len(first), n), np.zeros(n - len(first)), 0
    for i, (c, p) in enumerate(zip(columns, parts, strict=True)):
        own = c[:, at] if len(at) < n - len(first) else c[:, len(first) :]
        sums = sums + ((own - p[:, None]) ** 2).sum(axis=0)
        seen += len(c)
        bound = limit * (1 + epsilon / np.sqrt(seen)) ** 2 * seen / d if i < len(columns) - 1 else limit * (1 + 1e-9) + 1e-12
        stay = sums <= bound
        at, sums = at[stay], sums[stay]
        if not len(at):
            break
    return np.concatenate([first, at]), np.concatenate([near, sums])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return own.filter(~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def vectors(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, the same for equal rows whatever their place."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, epsilon: float = EPSILON) -> DataFrame:
    """Per query its nearest rows: query_id, rank, vec_id, score. is_query: a condition on the column id."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    own = usable(rows, id_col, vec_col)
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d, total = sizes[0]["d"], sizes[0]["n"]
    key = F.concat(F.hex(F.xxhash64(F.lit(1), "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), "v")))
    own = own.filter(F.size("v") == d).withColumn("key", key)
    # One candidate for each distinct vector: its k + 1 smallest ids; the group limit works before the shuffle too.
    ranked = own.dropDuplicates(["id", "key"]).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= k + 1)
    distinct = stored(ranked.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    queries = own.filter(is_query).select("id", "key")
    n = distinct.count()
    lists = lists or max(1, min(n, sample // 8, int(np.sqrt(n))))
    fit = distinct.orderBy(F.xxhash64("key")).limit(sample).select("v").toPandas()["v"]
    turn = rotation(d)
    learned = unit(np.stack(fit.to_numpy())) @ turn
    c = centroids(learned, lists)
    probes = min(lists, probes or probes_for(learned, c, k))
    shared = spark.sparkContext.broadcast((turn, c))

    def place(batches):
        turn, c = shared.value
        for b in batches:
            if b.num_rows:
                r = unit(vectors(b.column(1), d)) @ turn
                yield pa.RecordBatch.from_arrays([pa.array((r @ c.T).argmax(axis=1), pa.int32()), b.column(0), b.column(1), b.column(2)], names=["list", "key", "v", "ids"])

    def deal(probes: int):
        def run(batches):
            turn, c = shared.value
            for b in batches:
                if b.num_rows:
                    r = unit(vectors(b.column(1), d)) @ turn
                    near = np.argpartition(-(r @ c.T), probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(r), 1))
                    again = b.take(pa.array(np.repeat(np.arange(len(r)), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), again.column(0), again.column(1)], names=["list", "qkey", "q"])

        return run

    placed = stored(distinct.select("key", "v", "ids").mapInArrow(place, "list int, key string, v array<double>, ids array<long>"))
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))

    def scan(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out_key, out_v, out_ids, out_score = [], [], [], []
        if candidates.num_rows and asked.num_rows:
            turn, _ = shared.value
            x, q = vectors(candidates.column("v"), d), vectors(asked.column("q"), d)
            rx, rq = unit(x) @ turn, unit(q) @ turn
            columns = [np.ascontiguousarray(rx[:, a : a + COLUMNS].T) for a in range(0, d, COLUMNS)]
            ids = candidates.column("ids").combine_chunks()
            least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            for i, name in enumerate(asked.column("qkey").to_pylist()):
                at, far = adaptive_scan(rq[i], columns, k + 1, epsilon)
                if len(at) > 4 * k:  # what is as far as the last one stays
                    at = at[far <= np.partition(far, 4 * k - 1)[4 * k - 1] * (1 + 1e-9) + 1e-12]
                exact = cosines(q[i], x[at])
                # Of k + 1 candidates by score and smallest id none is missing whose ids could be wanted.
                best = np.lexsort((least[at], -exact))[: k + 1]
                out_key += [name] * len(best)
                out_v.append(at[best])
                out_score.append(exact[best])
        at = np.concatenate(out_v) if out_v else np.zeros(0, np.int64)
        ids = candidates.column("ids").combine_chunks().take(pa.array(at, pa.int64())) if len(at) else pa.array([], pa.list_(pa.int64()))
        return pa.table([pa.array(out_key, pa.string()), ids, pa.array(np.concatenate(out_score) if out_score else np.zeros(0))], names=["key", "ids", "score"])

    def nearest(asked: DataFrame, probes: int) -> DataFrame:
        """A list's candidates stand in blocks, its queries in runs; every block meets every run."""
        dealt = stored(asked.mapInArrow(deal(probes), "list int, qkey string, q array<double>"))
        runs = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
        plan = blocks.join(runs, "list").collect()  # at most sample / 8 rows
        plans = [F.broadcast(spark.createDataFrame(plan, "list int, blocks int, runs int")) for _ in range(2)]
        block, run = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("qkey"), F.col("runs")).cast("int")
        left = placed.join(plans[0], "list").select("list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "key", "v", "ids")
        right = dealt.join(plans[1], "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), run.alias("run"), "qkey", "q")
        found = left.groupBy("list", "block", "run").cogroup(right.groupBy("list", "block", "run")).applyInArrow(scan, "key string, ids array<long>, score double")
        order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        ranked = found.select("key", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
        out = stored(ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")))
        dropped(dealt)
        return out

    best = None
    asked = distinct.join(queries.select("key").distinct(), "key", "left_semi").select("key", "v")
    while True:
        found = nearest(asked, probes)
        whole = found if probes == lists else found.filter(F.size("near") == k + 1)
        best = whole if best is None else best.unionByName(whole)
        if probes == lists:
            break
        asked = asked.join(whole.select("key"), "key", "left_anti")
        if asked.isEmpty():
            break
        probes = min(lists, 4 * probes)
    asking = queries.distinct()
    given = hot_join(asking, best, "key", asking.groupBy("key").agg(F.count(F.lit(1)).alias("n")), total, "inner")
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    for t in (distinct, placed):
        dropped(t)
    return given.select(F.col("id").alias("query_id"), F.posexplode(kept)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
