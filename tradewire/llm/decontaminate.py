"""Benchmark decontamination by a distributed positional inverted index over the training documents.

The index is a stored table. A part is a run of documents of bounded size, its words numbered one after another, with a
gap between documents. A row (term, part, n, positions) holds the occurrences of one term in one part, as differences in
variable-length bytes; one more row of a part holds its documents. All terms of all documents are in it.

A query joins this table on its terms. Sums of n say how frequent a test term is in all documents; the rarest term of a
window is its anchor. An item goes to the parts in which an anchor of its windows occurs, and meets there the lists of the
item's terms: lists shifted by their terms' offsets are intersected, from the rarest of the part on. What is left are exact
phrase starts. With a tolerance on each shifted list the same walk gives proximity matches: every term within `slop`
words of its place relative to the anchor. Items are dealt into blocks of about `block_bytes` by a hash of their text, and
a task has the lists of one part and one block, so nothing grows with the benchmark but the number of tasks; nothing is
sent to the driver. A term of all documents has one row in each part.

Defined results: a null or empty text has no words and is not contaminated; null or empty items have no windows; an item
of fewer words than the window is one window; repeated items count once for each item_id; an item with a null id makes
hits like any other and is not counted in n_items; rows with equal or null ids each give their own row; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.llm.common import LOWER, UPPER, documents, dropped, give_back, partitions, raw_texts, runs, slices, stored

WINDOW = 10
SLOP = 4
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
#: Numbers that are packed at once.
RUN = 1 << 16
#: Keys beyond this many are not broadcast.
FEW = 500_000
#: Bytes that are a word: digits, letters and everything beyond ASCII; A-Z become a-z, the rest a space.
WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The same as a pattern for texts whose A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of the row that holds a part's documents; no word is empty.
DOCUMENTS = b""


def words(raw: bytes) -> list[bytes]:
    return raw.translate(WORDS).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**35, seven bits in a byte, the last byte of each under 128; and the number of bytes of each."""
    parts = [_packed(values[at : at + RUN]) for at in range(0, max(1, len(values)), RUN)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[(ends - size)[some] + k] = (values[some] >> (7 * k) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size.astype(np.uint8)


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128) + 1
    begins = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins)


def binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """An Arrow binary column of consecutive runs of data."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


POSTINGS = "part long, term binary, n long, body binary, ids array<long>, sizes array<long>"


def postings(part: int, ids: pa.Array, texts: list[bytes | None], gap: int) -> pa.RecordBatch:
    """The rows of one part."""
    # A factory that held the dictionary would keep all words of the part until the garbage collector runs.
    number: dict[bytes, int] = defaultdict(count().__next__)
    own = [np.array([number[w] for w in words(raw)] if raw else [], np.int32) for raw in texts]
    size = np.fromiter(map(len, own), np.int64, len(own))
    first = np.cumsum(size + gap) - size - gap
    term = np.concatenate([np.zeros(0, np.int32), *own])
    del own
    place = runs(first, size)
    order = np.argsort(term, kind="stable")
    term, place = term[order], place[order]
    del order
    lead = np.ones(len(term), bool)
    lead[1:] = term[1:] != term[:-1]
    step = np.diff(place, prepend=0)
    step[lead] = place[lead]
    begins = np.flatnonzero(lead)
    n = np.diff(np.concatenate([begins, [len(term)]]))
    del place, term
    data, width = packed(np.concatenate([np.diff(first, prepend=0), step]))
    cuts = np.concatenate([[0], len(first) + begins]).astype(np.int64)
    rows = len(n) + 1
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0] + [len(x)] * rows, pa.int32()), x)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, part)), pa.array([DOCUMENTS, *number], pa.binary()), pa.array(np.concatenate([[len(first)], n]).astype(np.int64)),
            binaries(data, np.add.reduceat(width, cuts, dtype=np.int64) if len(width) else np.zeros(rows, np.int64)), lists(ids.cast(pa.int64())), lists(pa.array(size)),
        ],
        names=[x.split()[0] for x in POSTINGS.split(", ")],
    )


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW + SLOP + 1, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored posting table of all words of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in slices(batch, "text", segment_bytes):
                yield postings(part, b.column(0), raw_texts(b.column(1)), gap)
                give_back()
                part += 1

    return stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, POSTINGS))


class Phrases:
    """The distinct windows of some items, as term numbers, with their anchors (-1: a term occurs nowhere)."""

    def __init__(self, items: list[tuple[bytes, list[int], list[str]]], window: int) -> None:
        self.terms: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        self.items: list[set[str]] = []
        self.anchor: list[int] = []
        for line, anchors, names in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in line.split(b" ")]
            for at, anchor in enumerate(anchors):
                key = tuple(ids[at : at + window])
                if anchor >= 0 and key not in seen:
                    seen[key] = len(seen)
                    self.items.append(set())
                    self.anchor.append(anchor)
                if anchor >= 0:
                    self.items[seen[key]].update(names)
        self.phrases = [np.array(k, np.int64) for k in seen]
        names_ = list(self.terms)
        self.key = [int.from_bytes(hashlib.blake2b(b" ".join(names_[t] for t in k), digest_size=8).digest(), "little", signed=True) for k in seen]
        self.grid = np.full((len(seen), window), len(self.terms), np.int64)
        for i, p in enumerate(self.phrases):
            self.grid[i, : len(p)] = p


class Segment:
    """The lists of a part, by term number; terms without one have an empty list."""

    def __init__(self, first: np.ndarray, lists: dict[int, np.ndarray], terms: int) -> None:
        self.first = first
        self.counts = np.zeros(terms + 1, np.int64)
        none = np.zeros(0, np.int64)
        self.lists = [none] * terms
        for t, x in lists.items():
            self.lists[t], self.counts[t] = x, len(x)

    def exact(self, phrase: np.ndarray) -> np.ndarray:
        """Starts of the phrase: shifted lists, from the rarest on."""
        order = np.argsort(self.counts[phrase], kind="stable")
        left = self.lists[phrase[order[0]]] - order[0]
        for o in order[1:]:
            if not len(left):
                break
            there = self.lists[phrase[o]]
            want = left + o
            at = np.searchsorted(there, want)
            left = left[there[np.minimum(at, len(there) - 1)] == want]
        return left

    def near(self, phrase: np.ndarray, anchor: int, slop: int) -> np.ndarray:
        """Where an anchored occurrence would start, if every term lies within `slop` words of its place."""
        left = self.lists[phrase[anchor]] - anchor
        for o in np.argsort(self.counts[phrase], kind="stable"):
            there = self.lists[phrase[o]]
            at = np.searchsorted(there, left + o - slop)
            left = left[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] <= left + o + slop)]
            if not len(left):
                break
        return left


def match(segment: Segment, block: Phrases, slop: int) -> dict[int, tuple[list[tuple[int, int]], set[str], set[int]]]:
    """For documents of the part with a match: word intervals, items found exactly, windows found nearby."""
    found: dict[int, tuple[list[tuple[int, int]], set[str], set[int]]] = defaultdict(lambda: ([], set(), set()))
    if not len(block.phrases):
        return found
    counts = segment.counts.copy()
    counts[len(block.terms)] = 1  # the filler of short windows
    for w in np.flatnonzero(counts[block.grid].min(axis=1) > 0):
        phrase, anchor = block.phrases[w], block.anchor[w]
        near = segment.near(phrase, anchor, slop)
        if not len(near):
            continue  # an exact occurrence is a near one
        for d in set((np.searchsorted(segment.first, near + anchor, side="right") - 1).tolist()):
            found[d][2].add(block.key[w])
        starts = segment.exact(phrase)
        for d, s in zip((np.searchsorted(segment.first, starts, side="right") - 1).tolist(), starts.tolist(), strict=True):
            at = s - int(segment.first[d])
            found[d][0].append((at, at + len(phrase)))
            found[d][1].update(block.items[w])
    return found


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


HITS = "part long, ord int, cover array<struct<s:int,e:int>>, items array<string>, near array<long>"
_HITS = pa.schema([("part", pa.int64()), ("ord", pa.int32()), ("cover", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.int64()))])


def items_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(item, block, words, ids): a row for each distinct text with words, and the ids that have it."""
    texts = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    blocks = max(1, -(-int(texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes))
    own = texts.groupBy("text").agg(F.collect_set("id").alias("ids")).withColumn("words", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)))
    item = F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), "text")), F.hex(F.xxhash64(F.lit(2), "text")))
    return stored(own.filter(F.size("words") > 0).select(item.alias("item"), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), "words", "ids"))


def hits(table: DataFrame, items: DataFrame, window: int, slop: int, parts: int) -> DataFrame:
    """Rows (part, ord, cover, items, near) of the documents with a match; ord counts the documents of a part."""
    words_ = items.select("item", "block", F.posexplode("words").alias("pos", "word")).withColumn("term", F.col("word").cast("binary"))
    use = table.select("part", "term", "n")
    frequent = use.join(words_.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("f"))
    known = words_.join(frequent, "term", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("f", F.lit(0)).alias("f")))).alias("f"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    anchors = F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.array(F.slice(F.col("f.f"), i + 1, F.lit(window))), lambda x: F.when(F.array_min(x) > 0, F.array_position(x, F.array_min(x)).cast("int") - 1).otherwise(F.lit(-1)))[0])
    asked = stored(items.join(known, "item").withColumn("anchors", anchors).filter(F.exists("anchors", lambda a: a >= 0)).select("item", "block", F.array_join("words", " ").alias("line"), "words", "ids", "anchors"))
    seeds = asked.select("item", "block", F.explode(F.filter(F.transform("anchors", lambda a, i: F.when(a >= 0, F.get(F.col("words"), i + a))), lambda x: x.isNotNull())).alias("word")).distinct()
    met = use.join(seeds.withColumn("term", F.col("word").cast("binary")), "term").select("part", "block", "item").distinct()
    sent = met.join(asked.drop("words"), ["item", "block"]).repartition(parts, "part", "block")
    wanted = asked.select("block", F.explode("words").alias("word")).distinct().select("block", F.col("word").cast("binary").alias("term"))
    wanted = wanted.unionByName(asked.select("block").distinct().withColumn("term", F.lit(DOCUMENTS)))
    lists = table.join(wanted, "term").select(F.col("part").alias("in_part"), F.col("block").alias("in_block"), "term", "body").repartition(parts, "in_part", "in_block")
    last_made: dict[tuple, Phrases] = {}

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return _HITS.empty_table()
        asked = asked.sort_by("item")
        key = tuple(asked.column("item").to_pylist())
        if key not in last_made:  # parts often get the same items
            last_made.clear()
            last_made[key] = Phrases([(r["line"].encode(), r["anchors"], r["ids"]) for r in asked.select(["line", "anchors", "ids"]).to_pylist()], window)
        phrases = last_made[key]
        first, lists = np.zeros(0, np.int64), {}
        for term, body in zip(own.column("term").to_pylist(), own.column("body").to_pylist(), strict=True):
            x = np.cumsum(unpacked(np.frombuffer(body, np.uint8)))
            if term == DOCUMENTS:
                first = x
            elif term in phrases.terms:
                lists[phrases.terms[term]] = x
        found = match(Segment(first, lists, len(phrases.terms)), phrases, slop)
        part = own.column("in_part")[0].as_py()
        rows = [{"part": part, "ord": d, "cover": [{"s": s, "e": e} for s, e in covered(c)], "items": sorted(i), "near": sorted(n)} for d, (c, i, n) in sorted(found.items())]
        return pa.Table.from_pylist(rows, _HITS)

    each = lists.groupBy("in_part", "in_block").cogroup(sent.groupBy("part", "block")).applyInArrow(run, HITS)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return each.groupBy("part", "ord").agg(flat("cover").alias("cover"), flat("items").alias("items"), flat("near").alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (distinct windows matched by proximity)."""
    table = index(docs, id_col, text_col, window + slop + 1, segment_bytes)
    items = items_of(benchmark, item_col, item_text, block_bytes)
    found = hits(table, items, window, slop, partitions(docs, text_col=text_col))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("cover", lambda c: F.sequence(c["s"], c["e"] - 1)))))
    marked = stored(found.select("part", "ord", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.sort_array("items"), ",").alias("said"), F.size("near").cast("long").alias("n_near")))
    rows = table.filter(F.col("term") == F.lit(DOCUMENTS)).select("part", F.posexplode(F.arrays_zip("ids", "sizes")).alias("ord", "d")).select("part", "ord", F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))
    dropped(items)
    zero = F.lit(0).cast("long")
    return rows.join(marked, ["part", "ord"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("said", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Words and windows as joined strings; documents' runs of each window length are looked up among the windows. A window
#: is near where its anchor stands and every other word within 4 of its place.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM starts
), lens AS (SELECT DISTINCT n FROM win
), runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS i FROM d, lens)
), hits AS (SELECT r.doc_id, r.n, r.i, win.item_id FROM runs r JOIN win ON win.s = r.s AND win.n = r.n
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id
), found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
), dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), freq AS (SELECT word, count(*) AS f FROM dw GROUP BY word
), ww AS (SELECT s, n, unnest(string_split(s, ' ')) AS word, unnest(range(0, n)) AS o FROM (SELECT DISTINCT s, n FROM win)
), anchored AS (SELECT s, n, arg_min(word, f * 100 + o) AS word, arg_min(o, f * 100 + o) AS a FROM ww JOIN freq USING (word) GROUP BY s, n HAVING count(*) = n
), cand AS (SELECT s, n, doc_id, p - a AS at FROM anchored JOIN dw USING (word)
), near AS (
  SELECT c.doc_id, c.s, c.at FROM cand c JOIN ww USING (s, n) JOIN dw ON dw.doc_id = c.doc_id AND dw.word = ww.word AND dw.p BETWEEN c.at + ww.o - 4 AND c.at + ww.o + 4
  GROUP BY c.doc_id, c.s, c.n, c.at HAVING count(DISTINCT ww.o) = c.n
), near_docs AS (SELECT doc_id, count(DISTINCT s) AS n_near FROM near GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(m.n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN found f USING (doc_id) LEFT JOIN near_docs m USING (doc_id)
"""


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, segment_bytes: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without a word inside an exact occurrence of a benchmark window.

    Contamination is one of texts, so the index holds a hash of each text as its id. Null texts stay, and equal texts go
    or stay together. Hashes of contaminated texts are broadcast only up to FEW.
    """
    key = "contaminated text"
    found = contamination(docs.select(F.xxhash64(text_col).alias("id"), F.col(text_col).alias("text")), benchmark, "id", "text", item_col, item_text, window, slop, segment_bytes, block_bytes)
    bad = stored(found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct())
    side = F.broadcast(bad) if bad.count() <= FEW else bad
    return docs.withColumn(key, F.xxhash64(text_col)).join(side, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
