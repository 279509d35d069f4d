"""Substring dedup over word windows, with a Count-Min prefilter.

A window is `width` consecutive words. First pass: every work unit (a bucket of documents) counts its windows in a
Count-Min sketch of DEPTH rows, as the sorted cells it touches. Sketches are merged in two steps, each over about the
square root of the number of units: a range of cells over a group of units, then a smaller range over all groups. The
answers go back the same way: one bit for each cell, is the merged count over one. So a unit sends and gets blobs in
proportion to that root, and no task or driver holds a whole sketch. A window is estimated repeated if all its cells are;
the estimate is never too low, so none is lost.

Second pass: only windows estimated repeated are grouped, exactly, by their words. Equal windows have the same minimizer,
the least hash of their runs of GRAM words, so consecutive windows with one minimizer are sent as a segment of text, each
distinct one once for a unit. Where a minimizer's segments meet, their windows are compared as texts and the first
occurrence of each stays. Minimizers are counted in the sketch as well, in cells of their own; one that is estimated to
occur over `hot` times is dealt by single windows, so that no group outgrows a task. The unit then removes the words of
the estimated windows that are not first.

Defined results: a null, empty or blank text has no words; nothing is removed from texts under `width` words; documents
are ordered by id, null ids last, then by a hash of the text, then equal rows one after another (so a repeated row is
removed against its first copy); other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.llm.common import among, bucketed, doc_order, documents, input_bytes, key_of_partition, mix, pack, partitions, runs, sliding_min, unpack
from tradewire.llm.groups import MOVED, Group, firsts_of, table

WIDTH = 20
GRAM = 4
DEPTH = 2
#: Cells in a row of the sketch for each byte of compressed input: about 16 for each window. A window that is estimated
#: repeated and is not costs a text of 20 words, cells that are not touched cost next to nothing.
CELLS_A_BYTE = 4
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20
LOW = np.uint64((1 << 20) - 1)
BATCH = 4096
#: Cells that are merged at once.
EACH = 1 << 18
#: Bytes of input in a unit, whose windows take some twenty-five times that in memory (its texts are stored compressed).
UNIT = 9 << 20
HOT = LARGEST = 1 << 16
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: (group, range) of the first step, (range, part) of the second.
SKETCH, MERGED = "grp int, rng int, bucket int, cells binary, counts binary", "rng int, part int, grp int, cells binary, counts binary"
OVER, BITS = "rng int, part int, grp int, bits binary", "bucket int, rng int, bits binary"


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, PIECE + (1 << 16))
            inverse = pow(BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        return cls.up, cls.down


def window_hashes(line: bytes, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window, by differences of prefix sums; long texts piece by piece."""
    n = len(starts) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    first, last = starts[:n], ends[width - 1 :]  # also windows over two documents, which nobody asks for
    out, at = np.empty(n, np.uint64), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(last, int(first[at]) + PIECE, side="right")))
        a, z = int(first[at]), int(last[to - 1])
        up, down = Powers.to(z - a + 1)
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(np.frombuffer(line, np.uint8, z - a, a).astype(np.uint64) * up[: z - a], out=sums[1:])
        out[at:to] = mix((sums[last[at:to] - a] - sums[first[at:to] - a]) * down[first[at:to] - a])
        at = to
    return out


def minimizer_places(h: np.ndarray, windows: int, width: int, gram: int) -> np.ndarray:
    """Of each window the place of its least gram, the leftmost of equals; h: the hashes of all grams."""
    out = []
    for at in range(0, windows, PIECE >> 1):
        part = h[at : min(windows, at + (PIECE >> 1)) + width - gram]
        out.append(at + (sliding_min((part & ~LOW) | np.arange(len(part), dtype=np.uint64), width - gram + 1) & LOW).astype(np.int64))
    return np.concatenate(out)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Unit:
    """The documents of a bucket in their order: all words one after another, each followed by one space, and the windows."""

    def __init__(self, table: pa.Table, width: int) -> None:
        table = table.combine_chunks()
        order, self.ids, self.k2, self.seq = doc_order(table.column("id").combine_chunks(), table.column("k2").combine_chunks())
        self.null = table.column("id").is_null().combine_chunks().to_numpy(zero_copy_only=False)[order]
        self.width, self.gram = width, max(min(GRAM, width), width - 62)  # a mask has 64 bits
        texts = table.column("text").combine_chunks().fill_null("").take(pa.array(order)).cast(pa.large_string()).cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        kind = np.int32 if len(raw) < 1 << 29 else np.int64  # places in the line, which is at most twice as long
        word = ~SPACE[raw]
        new = np.zeros(len(raw) + 1, bool)
        new[at] = True  # a document's end ends a word
        edge = word.copy()
        edge[1:] &= ~word[:-1] | new[1:-1]
        begin = np.flatnonzero(edge).astype(kind)
        edge[:] = word
        edge[:-1] &= ~word[1:] | new[1:-1]
        size = np.flatnonzero(edge).astype(kind) + kind(1) - begin
        del edge, new
        cut = np.searchsorted(begin, at.astype(kind))
        del begin
        self.ends = np.cumsum(size + kind(1), dtype=kind) - kind(1)
        self.starts = self.ends - size
        line = np.full(int(size.sum()) + len(size), 32, np.uint8)
        own = np.ones(len(line), bool)
        own[self.ends] = False
        line[own] = raw[word]
        del own, word, raw, texts, data, size
        self.line = line.tobytes()
        del line
        self.words, self.size = cut[:-1], np.diff(cut)  # of each document: its first word, and how many
        self.windows = np.maximum(self.size - width + 1, 0)
        self.first = np.cumsum(self.windows) - self.windows
        #: Of each window its first word, and its hash.
        self.word = runs(self.words, self.windows).astype(kind)
        self.hashes = self.of_all(width)[self.word]

    def of_all(self, width: int) -> np.ndarray:
        return window_hashes(self.line, self.starts, self.ends, width)

    def segments(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of wanted windows, as runs with one minimizer: the minimizer, the first window, how many."""
        own = np.arange(len(self.word)) if wanted is None else np.flatnonzero(wanted)
        if not len(own):
            return np.zeros(0, np.uint64), own, own
        h = self.of_all(self.gram)
        word = self.word[own]
        place = minimizer_places(h, len(self.starts) - self.width + 1, self.width, self.gram)[word]
        lead = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (word[1:] != word[:-1] + 1)]))
        return h[place[lead]], own[lead], np.diff(np.concatenate([lead, [len(own)]]))

    def cells(self, row: int, width: int) -> np.ndarray:
        """The sketch cell of each window; the rows of the sketch stand one after another."""
        return cells_of(self.hashes, row, width)


def cells_of(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(hashes + np.uint64(0xA0761D6478BD642F * (row + 1) % (1 << 64))) % np.uint64(width) + np.uint64(row * width)


def planes(cells: np.ndarray) -> bytes:
    """Sorted cells as differences, low bytes and the rest apart, which packs well."""
    step = np.diff(cells, prepend=np.uint64(0))
    return pack((step & np.uint64(255)).astype(np.uint8), (step >> np.uint64(8)).astype(np.uint64 if len(step) and int(step.max()) >> 40 else np.uint32))


def from_planes(blob: bytes) -> np.ndarray:
    low, high = unpack(blob)
    return np.cumsum(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(8))


def pieces(cells: list[np.ndarray], each: int = EACH) -> Iterator[tuple[np.ndarray, np.ndarray, list[slice]]]:
    """Sorted arrays merged, about `each` values at a time: the distinct values, the place of each given one among them, and which are given."""
    n = max(1, sum(map(len, cells)) // each)
    low, high = min((int(c[0]) for c in cells if len(c)), default=0), max((int(c[-1]) for c in cells if len(c)), default=0)
    edges = np.array([low + (high - low) * i // n for i in range(1, n)], np.uint64)
    ends = [[0, *np.searchsorted(c, edges).tolist(), len(c)] for c in cells]
    for i in range(n):
        own = [slice(e[i], e[i + 1]) for e in ends]
        every, which = np.unique(np.concatenate([c[o] for c, o in zip(cells, own, strict=True)]), return_inverse=True)
        if len(every):
            yield every, which, own


def summed(which: np.ndarray, counts: list[np.ndarray], own: list[slice]) -> np.ndarray:
    """The counts of a piece's distinct values."""
    return np.minimum(np.bincount(which, np.concatenate([c[o] for c, o in zip(counts, own, strict=True)])), (1 << 32) - 1).astype(np.uint32)


def put(out: list[np.ndarray], own: list[slice], values: np.ndarray) -> None:
    """Hands a piece's values out to where its given ones stand."""
    at = 0
    for o, where in zip(out, own, strict=True):
        o[where] = values[at : at + where.stop - where.start]
        at += where.stop - where.start


def cut(values: np.ndarray, each: int) -> Iterator[tuple[int, slice]]:
    """(range, run of sorted values in it), `each` values wide."""
    part = (values // np.uint64(each)).astype(np.int64)
    ends = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, z in zip(ends, ends[1:], strict=False):
        yield int(part[a]), slice(a, z)


def estimates(units: DataFrame, n: int, width: int, cells: int, hot: int) -> DataFrame:
    """Rows (bucket, rng, bits): for the cells that a unit touches, sorted, in ranges: is the merged count over one (over `hot` for minimizers)."""
    root = math.isqrt(n - 1) + 1
    wide = -(-(DEPTH + 1) * cells // root)
    narrow = -(-wide // root)

    def sketch(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        found, counts = touched(Unit(t, width), cells)
        out = [(bucket % root, r, bucket, planes(found[own]), pack(counts[own])) for r, own in cut(found, wide)]
        return table(list(map(list, zip(*out, strict=True))), SKETCH)

    def merge(t: pa.Table) -> pa.Table:
        given, each = [from_planes(x) for x in t.column("cells").to_pylist()], [unpack(x)[0] for x in t.column("counts").to_pylist()]
        parts = [(every, summed(which, each, own)) for every, which, own in pieces(given)]
        del given, each
        found, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        grp, rng = t.column("grp")[0].as_py(), t.column("rng")[0].as_py()
        out = [(rng, p, grp, planes(found[own]), pack(counts[own])) for p, own in cut(found, narrow)]
        return table(list(map(list, zip(*out, strict=True))), MERGED)

    def over(t: pa.Table) -> pa.Table:
        given, each = [from_planes(x) for x in t.column("cells").to_pylist()], [unpack(x)[0] for x in t.column("counts").to_pylist()]
        often = [np.empty(len(x), bool) for x in given]
        for every, which, own in pieces(given):
            put(often, own, (summed(which, each, own) > np.where(every < np.uint64(DEPTH * cells), 1, hot))[which])
        out = [(t.column("rng")[0].as_py(), t.column("part")[0].as_py(), g, pack(np.packbits(x))) for g, x in zip(t.column("grp").to_pylist(), often, strict=True)]
        return table(list(map(list, zip(*out, strict=True))), OVER)

    def back(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], BITS)
        each = [from_planes(x) for x in t.column("cells").to_pylist()]
        parts = [np.empty(len(x), np.uint8) for x in each]
        bits = {r["part"]: np.unpackbits(unpack(r["bits"])[0]) for r in answers.select(["part", "bits"]).to_pylist()}
        for every, which, own in pieces(each):
            often = np.empty(len(every), np.uint8)
            for p, run in cut(every, narrow):
                often[run], bits[p] = bits[p][: run.stop - run.start], bits[p][run.stop - run.start :]
            put(parts, own, often[which])
        rng = t.column("rng")[0].as_py()
        out = [(b, rng, pack(np.packbits(x), np.array([len(x)]))) for b, x in zip(t.column("bucket").to_pylist(), parts, strict=True)]
        return table(list(map(list, zip(*out, strict=True))), BITS)

    def dealt(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
        """By two numbers under `root`, evenly."""
        return df.withColumn(key, key_of_partition(F.col(a) * root + F.col(b))).repartition(n, key)

    sent = dealt(units.groupBy("bucket").applyInArrow(sketch, SKETCH), "grp", "rng", "key")
    merged = dealt(sent.groupBy("key").applyInArrow(merge, MERGED), "rng", "part", "key")
    answers = dealt(merged.groupBy("key").applyInArrow(over, OVER).withColumnsRenamed({"grp": "to", "rng": "of"}), "to", "of", "answer")
    return sent.groupBy("key").cogroup(answers.groupBy("answer")).applyInArrow(back, BITS)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the values in place: the distinct ones, and how often each stands there."""
    values.sort()
    lead = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[lead], np.diff(lead, append=len(values)).astype(np.uint32)


def touched(unit: Unit, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a unit's windows (counts up to two, no more is asked) and, behind them, of its segments' minimizers."""
    found, counts = [], []
    for row in range(DEPTH):
        own, n = distinct(unit.cells(row, cells))
        found.append(own)
        counts.append(np.minimum(n, 2))
    own, n = distinct(cells_of(unit.segments()[0], DEPTH, cells))
    return np.concatenate([*found, own]), np.concatenate([*counts, n])


def estimated(unit: Unit, cells: int, over: np.ndarray) -> tuple[np.ndarray, int]:
    """From the answers for touched(): which windows are estimated repeated, and where the minimizers' answers begin."""
    wanted, past = np.ones(len(unit.hashes), bool), 0
    for row in range(DEPTH if len(wanted) else 0):
        own = unit.cells(row, cells)
        order = np.argsort(own)
        own = own[order]
        place = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]), dtype=np.int32 if len(own) < 1 << 31 else np.int64)
        del own
        place += past
        past = int(place[-1]) + 1
        wanted[order] &= over[place]
    return wanted, past


def windows_of(text: bytes, width: int = WIDTH) -> int:
    return text.count(b" ") + 2 - width


def first_windows(group: Group, width: int) -> np.ndarray:
    """Of each segment a mask of the windows whose words stand nowhere earlier in the group."""
    n = np.fromiter((windows_of(t, width) for t in group.text), np.int64, len(group))
    mask = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    shared = group.shared()  # a segment has no window twice, as equal windows have their minimizer at the same place
    h, _, _, pos, *_ = group.columns
    order = shared[np.lexsort((pos[shared], group.ranks()[shared], h[shared]))]
    whole: set[bytes] = set()
    seen: set[bytes] = set()
    last = None
    for i, key in zip(order.tolist(), h[order].tolist(), strict=True):
        if key != last:
            whole, seen, last = set(), set(), key
        text = group.text[i]
        if text in whole:
            mask[i] = 0
            continue
        whole.add(text)
        words = text.split(b" ")
        mine = 0
        for k in range(len(words) - width + 1):
            one = b" ".join(words[k : k + width])
            if one not in seen:
                seen.add(one)
                mine |= 1 << k
        mask[i] = mine
    return mask


def repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", cells_a_byte: float = CELLS_A_BYTE, hot: int = HOT, batch: int = BATCH, largest: int = LARGEST) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    n = partitions(docs, UNIT, text_col)
    cells = max(1 << 12, int(input_bytes(docs, text_col) * cells_a_byte))
    units = bucketed(docs, n, id_col, text_col).repartition(n, "bucket")

    def move(t: pa.Table, answers: pa.Table) -> pa.Table:
        import xxhash

        if not t.num_rows:
            return table([], MOVED)
        unit = Unit(t, width)
        answers = answers.sort_by("rng")
        over = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(bits, count=int(size[0])) for bits, size in map(unpack, answers.column("bits").to_pylist()))]).astype(bool)
        wanted, past = estimated(unit, cells, over)
        minimizers = distinct(cells_of(unit.segments()[0], DEPTH, cells))[0]
        h, at, many = unit.segments(wanted)
        often = over[past:][np.searchsorted(minimizers, cells_of(h, DEPTH, cells))]
        del minimizers, wanted
        doc = np.searchsorted(unit.first + unit.windows, at, side="right")
        pos, word = at - unit.first[doc], unit.word[at]
        begin, end = unit.starts[word], unit.ends[word + many + width - 2]
        first: dict[bytes, tuple[int, int, int]] = {}  # in the order of documents: the first occurrence stays
        for key, d, p, w, k, s, e, alone in zip(h.tolist(), doc.tolist(), pos.tolist(), word.tolist(), many.tolist(), begin.tolist(), end.tolist(), often.tolist(), strict=True):
            if alone:
                for i in range(k):
                    one = unit.line[unit.starts[w + i] : unit.ends[w + i + width - 1]]
                    if one not in first:
                        first[one] = (xxhash.xxh3_64_intdigest(one), d, p + i)
            else:
                first.setdefault(unit.line[s:e], (key, d, p))
        if not first:
            return table([], MOVED)
        key, doc, pos = (np.array(x, k) for x, k in zip(zip(*first.values(), strict=True), (np.uint64, np.int64, np.int64), strict=True))
        return table([key.view(np.int64), np.full(len(key), t.column("bucket")[0].as_py()), doc, pos, unit.ids[doc], unit.k2[doc], list(first)], MOVED)

    def remove(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], RESULT)
        unit = Unit(t, width)
        doc, pos, many, mask = (answers.column(c).to_numpy() for c in ("doc", "pos", "windows", "mask"))
        start, mask = unit.first[doc] + pos, mask.view(np.uint64)
        # The estimate is one of a window's hash: what equals a window that was sent was estimated too.
        sent = np.concatenate([np.zeros(0, np.uint64), *(unit.hashes[start[many > i] + i] for i in range(int(many.max(initial=0))))])
        sent = distinct(sent)[0]
        gone = np.concatenate([np.zeros(0, bool), *(among(unit.hashes[i : i + EACH], sent) for i in range(0, len(unit.hashes), EACH))])
        for i in range(int(many.max(initial=0))):
            gone[start[(mask >> np.uint64(i)) & np.uint64(1) == 1] + i] = False
        step = np.zeros(len(unit.starts) + 1, np.int32)
        step[unit.word[gone]] += 1
        step[unit.word[gone] + width] -= 1
        cover = np.cumsum(step[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(cover)])
        removed = before[unit.words + unit.size] - before[unit.words]
        kept = []
        for a, n, lost in zip(unit.words.tolist(), unit.size.tolist(), removed.tolist(), strict=True):
            # Runs of kept words; the line has one space between words.
            edge = np.flatnonzero(np.diff(np.concatenate([[True], cover[a : a + n], [True]]))).tolist() if lost else [0, n] if n else []
            own = [unit.line[unit.starts[a + x] : unit.ends[a + y - 1]] for x, y in zip(edge[::2], edge[1::2], strict=True)]
            kept.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.table([pa.array(unit.ids, pa.int64(), mask=unit.null), pa.array(unit.size), pa.array(removed, pa.int64()), pa.array(kept)], names=[x.split()[0] for x in RESULT.split(", ")])

    bits = estimates(units, n, width, cells, hot).withColumnRenamed("bucket", "unit").repartition(n, "unit")
    moved = units.groupBy("bucket").cogroup(bits.groupBy("unit")).applyInArrow(move, MOVED)
    firsts = firsts_of(moved, n, lambda group: first_windows(group, width), batch, largest, lambda text: windows_of(text, width)).repartition(n, "unit")
    return units.groupBy("bucket").cogroup(firsts.groupBy("unit")).applyInArrow(remove, RESULT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))


#: Windows as joined words. Documents are ordered by doc_id, which is unique.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 19) + 1)) AS i FROM d)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.p2) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (g.p2 IS NULL) AS text
  FROM words LEFT JOIN (SELECT doc_id, p, p AS p2 FROM gone) g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
