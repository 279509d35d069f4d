"""SimHash near-duplicates by deletion-variant signatures.

The fingerprint of a text has a bit where over half of its word shingles' 64-bit hashes have it. Fingerprints link at
`radius` or fewer differing bits. For a radius of 3 the 64 bits are cut into two segments: one of them differs by one
bit at most. Every segment is indexed under each of its variants with one bit left out (a wildcard), so such segments
share a variant; equal variants meet in one task, and the full fingerprints are compared there.

Only distinct fingerprints take part. A bucket (fingerprints under one variant) gives a spanning forest of its links, not
its pairs, and so never more rows than members. Large buckets are cut by the same rule on the other bits until a part is
small enough to be compared in blocks. Forests are joined by alternating large-star and small-star rounds, each written
to the checkpoint folder. Links never come to the driver.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; a null id
takes part, and its component is the smallest id reachable that is not null (null if there is none); repeated rows give
a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.llm.common import ASCII_LOWER, documents, hot_join, partitions, raw_texts, stored, dropped

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Compared pair by pair up to this size, cut further beyond it.
SMALL = 4096


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    import xxhash

    # The word pattern's separators are exactly those of bytes.split().
    words = raw.translate(ASCII_LOWER).split() if raw else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = set_ * 2 > n
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id and the fingerprint as a signed long, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(raw, shingle) for raw in raw_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_groups(fps: np.ndarray, radius: int, shift: int, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that meet in one bucket.

    Up to SMALL members are compared directly. More are cut by one-wildcard variants of the halves of the `bits` bits
    from `shift`, which the bucket does not yet share; each half that is cut leaves fewer bits open, so this ends.
    """
    if len(fps) <= SMALL or bits < 2:
        return compare(fps, radius)
    out = []
    half = bits // 2
    for at, size, rest, rest_size in ((shift, half, shift + half, bits - half), (shift + half, bits - half, shift, half)):
        own = (fps >> np.uint64(at)) & np.uint64((1 << size) - 1)
        for wild in range(size):
            key = own & np.uint64(((1 << size) - 1) ^ (1 << wild))
            order = np.argsort(key, kind="stable")
            k = key[order]
            ends = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            for a, b in zip(ends, ends[1:], strict=False):
                if b - a > 1:
                    out += near_groups(fps[order[a:b]], radius, rest, rest_size)
    return out


def compare(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Walks from member to member through links; each member is reached once."""
    out, left = [], fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                new = left[near]
                out += [(x, y) for y in new]
                todo.extend(new)
                left = left[~near]
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b), a < b: links that span every group of distinct fingerprints. fps: one column, fp."""
    if radius not in (1, 2, 3):
        raise ValueError("two segments differ by one bit at most only for a radius up to 3")
    # 64 variants: half of the bits with one bit left out; the variant's number is above the 32 bits.
    masks = F.array(*[F.lit(0xFFFFFFFF ^ (1 << w)) for w in range(32)])
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    keyed = fps.select("fp", F.explode(F.flatten(F.transform(halves, lambda h, s: F.transform(masks, lambda m, w: h.bitwiseAND(m) + F.shiftleft((s * 32 + w).cast("long"), 32))))).alias("key"))
    met = keyed.repartition(partitions(fps), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            keys, own = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            if held and held[0][0][0] == keys[-1]:  # the bucket goes on
                held.append((keys, own))
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            held.append((keys[:cut], own[:cut]))
            yield linked(held)
            held = [(keys[cut:], own[cut:])]
        yield linked(held)

    def linked(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out: set[tuple[int, int]] = set()
        if held:
            keys, own = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(0, int)
            for a in np.flatnonzero(np.diff(ends) > 1):
                low_half_shared = keys[ends[a]] >> 32 < 32
                for x, y in near_groups(own[ends[a] : ends[a + 1]], radius, 32 if low_half_shared else 0, 32):
                    x, y = int(np.uint64(x).view(np.int64)), int(np.uint64(y).view(np.int64))
                    out.add((min(x, y), max(x, y)))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return met.select("key", "fp").mapInArrow(run, "a long, b long").distinct()


def with_least(stars: DataFrame) -> DataFrame:
    """Adds the least root of each node. Only where a node has very many rows do the joins take it apart."""
    least = stars.groupBy("node").agg(F.min("root").alias("least"), F.count(F.lit(1)).alias("n"))
    total, most = least.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= max(1000, (total or 0) // 1000):
        return stars.join(least.drop("n"), "node")
    return hot_join(stars, least.drop("n"), "node", least.drop("least"), total, "inner")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of an edge but the roots: root is the least node reachable.

    Alternating star rounds; their number grows with the logarithm of the longest path. A round only keeps stars, so
    rows never exceed edges. Each is written to the shared folder, and dropped when the next one stands.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")))
    before = None
    while True:
        # A hub has a row for each of its spokes: least() partly aggregates, and the joins take hubs apart.
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        # Large star: every larger neighbour moves to the least of the neighbourhood.
        large = stored(with_least(both).filter(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.least("node", "least").alias("root")).distinct())
        # Small star: the smaller neighbours and the node itself move to the least of them.
        low = large.groupBy("node").agg(F.min("root").alias("least"))
        small = with_least(large).select(F.col("root").alias("node"), F.col("least").alias("root")).unionByName(low.select("node", F.col("least").alias("root"))).filter(F.col("node") != F.col("root")).distinct()
        new = stored(small)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        for t in (now, large):
            dropped(t)
        now = new
        if state == before:
            return now
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    fps = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")))
    total = rows.count()
    root = components(links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = hot_join(rows, known, "fp", fps.select("fp", "n"), total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
