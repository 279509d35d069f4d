"""Near-duplicate groups of long texts on SimHash: similarity 0.8 or more of five-word shingles.

Candidates come from two indexes. The first is quick and not complete: SimHash fingerprints of sections, runs of shingles
between content-defined cuts, about SECTION long, and whole fingerprints within three bits; texts that meet are compared
by a SimHash of WIDE bits. What it links, and the exact similarity of the shingle sets confirms, is one component from then on, so large groups of copies are small early.

The second is complete: of two sets with a similarity of s or more, in one order of all shingles, the first
n - ceil(s * n) + 1 of each have one in common. These are the keys of a text; the order is by hash, with frequent
shingles (found on a sample) last, which keeps keys rare and does not touch completeness. Texts under one key that are
not in one component yet and whose sizes allow s are pairs; far pairs go by the wide sketch, at a limit that is seven
standard deviations from s or more, and the exact similarity of the shingle sets decides.

Texts with equal shingle sets are one node first. In the first index a group streams through its task: a chunk of members
is linked into trees, only the trees' first members stay for the next chunk. Large groups are dealt by a salt first; the
first members of the salted parts meet in a second round.

Defined results: texts without words are copies of each other; null ids come last in a group, rows repeated entirely are
copies too; extra columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewire.llm import simhash
from tradewire.llm.common import ASCII_LOWER, among, dropped, mix, partitions, raw_texts, shuffles_freed, slices, stored, tidy

SHINGLE = 5
SIMILARITY = 0.8
SECTION = 16
SECTIONS = 8
WIDE = 512
CHUNK = 8192
SALTS = 16
#: Differing bits of the wide sketch above which a pair is not compared exactly. Expected at 0.8 are 78 (96 for 4 shingles of 5).
FAR = 160
#: Shingles in this many texts of a sample (one text in SAMPLE) are frequent; at most MOST_FREQUENT are known.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 200_000
CELLS = 1 << 20
#: Bytes of texts whose shingles a worker holds at once.
HELD = 2 << 20
PAIRS = 1 << 18


def shingle_hashes(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    import xxhash

    words = raw.translate(ASCII_LOWER).split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], simhash.SEED) for s, e in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes, or rows of several each, have each of their bits. Sums of 255 rows fit into bytes."""
    columns = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1)
    out = np.zeros(8 * columns.shape[1], np.int64)
    for at in range(0, len(h), 255):
        out += np.add.reduce(np.unpackbits(columns[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return out


SPREAD = np.array([0x9E3779B97F4A7C15 * (k + 1) % (1 << 64) for k in range(WIDE // 64)], np.uint64)


def wide_sketch(h: np.ndarray) -> np.ndarray:
    """A SimHash of WIDE bits: each word of it from the hashes mixed another way."""
    if not len(h):
        return np.zeros(WIDE // 64, np.uint64)
    return np.packbits(bit_counts(mix(h[:, None] + SPREAD)) * 2 > len(h), bitorder="little").view(np.uint64)


def section_fingerprints(h: np.ndarray, length: int = SECTION, most: int = SECTIONS) -> np.ndarray:
    """Of the sections with the smallest mixed fingerprints; a text without words has the one fingerprint zero."""
    if not len(h):
        return np.zeros(1, np.uint64)
    cut = np.flatnonzero(mix(h) % np.uint64(length) == 0)
    starts = np.unique(np.concatenate([[0], cut]))
    found = []
    for at in range(0, len(starts), 512):
        s = starts[at : at + 512]
        end = int(starts[at + 512]) if at + 512 < len(starts) else len(h)
        bits = np.unpackbits(h[s[0] : end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, s - s[0], axis=0, dtype=np.int32)
        size = np.diff(np.concatenate([s, [end]]))
        found.append(np.packbits(sums * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
    fps = np.unique(np.concatenate(found))
    return fps[np.argsort(mix(fps), kind="stable")[:most]]


def limit(similarity: float = SIMILARITY, bits: int = WIDE) -> int:
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + math.sqrt(bits * p * (1 - p)))


def key_count(n: int, similarity: float) -> int:
    """Of how many first shingles of n every set at this similarity has one among its own."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def similar(x: Column, y: Column, similarity: float) -> Column:
    """Exactly, for arrays without repeats."""
    both = F.size(F.array_intersect(x, y))
    return both >= similarity * (F.size(x) + F.size(y) - both) - 1e-9


def trees(sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parents, children, first members): links that span the groups of these sketches, each walked from its first."""
    a, b, first = [], [], []
    left = np.arange(len(sketch))
    while len(left):
        todo, left = [left[0]], left[1:]
        first.append(todo[0])
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(sketch[left] ^ sketch[x]).sum(axis=1) <= most
            if near.any():
                new = left[near]
                a.append(np.full(len(new), x))
                b.append(new)
                todo.extend(new.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), np.array(first, np.int64)


def _frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of frequent shingles, sorted. Which these are matters for the work only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in raw_texts(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(raw)).view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("text"))
    counts = sample.mapInArrow(tidy(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def _sketched(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    frequent = _frequent(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in (part for b in batches for part in slices(b, "text", HELD)):
            node, size, wide, sections, fps, keys = [], [], [], [], [], []
            for raw in raw_texts(b.column(2)):
                h = shingle_hashes(raw)
                own = np.unique(h)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED))
                size.append(len(own))
                wide.append(wide_sketch(own).tobytes())
                sections.append(section_fingerprints(h).view(np.int64))
                fps.append(int(np.packbits(bit_counts(own) * 2 > len(own), bitorder="little").view(np.int64)[0]) if len(own) else 0)
                late = among(own, frequent)
                keys.append(np.concatenate([own[~late], own[late]])[: key_count(len(own), similarity)].view(np.int64))
            made = [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(wide, pa.binary())]
            made += [pa.array(sections, pa.list_(pa.int64())), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["id", "k2", "node", "size", "wide", "sections", "fp", "keys"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("text"))
    return own.mapInArrow(tidy(run), "id long, k2 long, node long, size int, wide binary, sections array<long>, fp long, keys array<long>")


def _pairs(rows: DataFrame, similarity: float, parts: int) -> DataFrame:
    """rows: key, size, node, part. Pairs (a, b), a < b, under one key, of different parts, whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            own = [c.to_numpy() for c in b.columns]
            if held and held[0][0][0] == own[0][-1]:  # the group goes on
                held.append(own)
                continue
            cut = int(np.searchsorted(own[0], own[0][-1]))
            held.append([c[:cut] for c in own])
            yield from paired(held)
            held = [[c[cut:] for c in own]]
        yield from paired(held)

    def paired(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, size, node, part = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b, n = [], [], 0
        at, step = np.arange(len(key) - 1), 1
        while len(at):
            # Sizes ascend in a group: one that is too large ends it for this member.
            at = at[(key[at] == key[at + step]) & (size[at] >= similarity * size[at + step] - 1e-9)]
            new = at[part[at] != part[at + step]]
            a.append(np.minimum(node[new], node[new + step]))
            b.append(np.maximum(node[new], node[new + step]))
            n, step = n + len(new), step + 1
            at = at[at + step < len(key)]
            if n >= PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = rows.select("key", "size", "node", "part").repartition(parts, "key").sortWithinPartitions("key", "size")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _close(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs whose wide sketches differ in `most` bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for c in ("wa", "wb"))
            keep = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("wide").alias(f"w{c}")), c)
    return pairs.select("a", "b", "wa", "wb").mapInArrow(tidy(run), "a long, b long")


def _exact(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The pairs at `similarity` or more. Sets are made again from the texts of the pairs' nodes, one text for each.

    Pairs of sets are compared on the JVM: batches of them for Python would be the largest of all.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in (part for b in batches for part in slices(b, "text", HELD)):
            own = [np.unique(shingle_hashes(raw)) for raw in raw_texts(b.column("text"))]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), simhash.SEED) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["node", "own"])

    pairs = stored(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = ends.join(nodes.select("node", "k2"), "node").select(F.pmod("k2", F.lit(CELLS)).alias("cell")).distinct()
    texts = docs.select(F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(cells), F.pmod("k2", F.lit(CELLS)) == F.col("cell"), "left_semi").dropDuplicates(["k2"])
    known = stored(texts.select("text").mapInArrow(tidy(sets), "node long, own array<long>").dropDuplicates(["node"]))
    both = pairs
    for c in "ab":
        both = both.join(known.select(F.col("node").alias(c), F.col("own").alias(f"o{c}")), c)
    out = stored(both.filter(similar(F.col("oa"), F.col("ob"), similarity)).select("a", "b"))
    for t in (pairs, known):
        dropped(t)
    return out


def _met(rows: DataFrame, by: list[str], most: int, roots: bool) -> DataFrame:
    """rows: key, salt, node, wide. Links (a, b), and with `roots` the rows that stand for their part of a key (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, wide = None, np.zeros(0, np.int64), np.zeros((0, WIDE // 64), np.uint64)

        def linked() -> tuple[list, np.ndarray]:
            a, b, first = trees(wide, most)
            return [nodes[a], nodes[b]], first

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            own = batch.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if keys[s] != key:
                    (a, b), first = linked()
                    yield made(key, a, b, nodes[first], wide[first], roots)
                    key, nodes, wide = keys[s], own[:0], sketch[:0]
                for at in range(s, e, CHUNK):
                    nodes, wide = np.concatenate([nodes, own[at : min(e, at + CHUNK)]]), np.concatenate([wide, sketch[at : min(e, at + CHUNK)]])
                    if len(nodes) >= CHUNK:
                        (a, b), first = linked()
                        yield made(key, a, b, nodes[:0], wide[:0], roots)
                        nodes, wide = nodes[first], wide[first]
        (a, b), first = linked()
        yield made(key, a, b, nodes[first], wide[first], roots)

    def made(key, a: np.ndarray, b: np.ndarray, nodes: np.ndarray, wide: np.ndarray, roots: bool) -> pa.RecordBatch:
        if not roots:
            nodes, wide = nodes[:0], wide[:0]
        n = len(nodes)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, nodes])), pa.array([*b.tolist(), *[None] * n], pa.int64()), pa.array([None] * len(a) + [key[0] if key else None] * n, pa.int64()), pa.array([None] * len(a) + [x.tobytes() for x in wide], pa.binary())],
            names=["a", "b", "key", "wide"],
        )

    return rows.select("key", "salt", "node", "wide").repartition(partitions(rows), *by).sortWithinPartitions(*by).mapInArrow(tidy(run), "a long, b long, key long, wide binary")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: id, k2 (the text's hash), root: rows with one root are near copies, directly or through others."""
    with shuffles_freed(docs.sparkSession):
        return _groups(docs, id_col, text_col, similarity)


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    most = limit(similarity)
    rows = stored(_sketched(docs, id_col, text_col, similarity))
    # A node is a distinct shingle set; its number comes from the set.
    others = ("size", "wide", "sections", "fp", "keys")
    nodes = stored(rows.groupBy("node").agg(F.min("k2").alias("k2"), *(F.first(c).alias(c) for c in others)))
    keyed = nodes.select(F.explode("sections").alias("key"), "node", "wide", F.pmod("node", F.lit(SALTS)).alias("salt"))
    parts = stored(_met(keyed, ["key", "salt"], most, True))
    again = parts.filter(F.col("b").isNull()).select("key", F.lit(0).cast("long").alias("salt"), F.col("a").alias("node"), "wide")
    across = _met(again, ["key"], most, False)
    near = parts.filter(F.col("b").isNotNull()).select("a", "b").unionByName(across.select("a", "b"))
    # Whole fingerprints within three bits, by the operator; equal ones meet by the fingerprint itself.
    links = simhash.links(nodes.select("fp").distinct())
    one = nodes.groupBy("fp").agg(F.min_by(F.struct("node", "wide"), "node").alias("x")).select("fp", "x.node", "x.wide")
    whole = links.join(one.select(F.col("fp").alias("a"), F.col("node").alias("na"), F.col("wide").alias("wa")), "a").join(one.select(F.col("fp").alias("b"), F.col("node").alias("nb"), F.col("wide").alias("wb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    met = near.unionByName(_close(whole, nodes, most)).filter("a <> b").distinct()
    first = _exact(met, nodes, docs, text_col, similarity)
    dropped(parts)
    part = simhash.components(first)
    # What the first index has not joined, completely.
    placed = nodes.select("node", "size", "keys").join(part, "node", "left").select("node", "size", F.coalesce("root", "node").alias("part"), F.explode("keys").alias("key"))
    rest = _exact(_close(_pairs(placed, similarity, partitions(nodes)), nodes, FAR), nodes, docs, text_col, similarity)
    root = simhash.components(first.unionByName(rest))
    out = stored(rows.select("id", "k2", "node").join(root, "node", "left").select("id", "k2", F.coalesce("root", "node").alias("root")))
    for t in (rows, nodes, first, part, rest, root):
        dropped(t)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without copies: of each group the smallest id stays (null last), of equal rows one."""
    found = groups(docs, id_col, text_col, similarity)
    # One key without nulls for the join and the window, so that texts are dealt once for both.
    key = lambda id_, k2: F.struct(id_.isNull().alias("null"), F.coalesce(id_, F.lit(0)).alias("id"), F.coalesce(k2, F.lit(0)).alias("k2"))
    kept = found.groupBy("root").agg(F.min(key(F.col("id"), F.col("k2"))).alias("near copy key")).select("near copy key").distinct()
    alone = docs.withColumn("near copy key", key(docs[id_col].cast("long"), F.xxhash64(text_col))).join(kept, "near copy key", "left_semi")
    number = F.row_number().over(Window.partitionBy("near copy key").orderBy(F.lit(0)))
    return alone.withColumn("near copy n", number).filter(F.col("near copy n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
