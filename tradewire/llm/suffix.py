"""Substring dedup over bytes by collection suffix order, built column by column in sequential files.

Equal `WIDTH`-byte windows have the same minimizer: the least of the hashes of their `GRAM`-byte grams, the leftmost of
equals. Consecutive windows with one minimizer make a segment of under two widths; all its windows can only equal windows
of segments with the same minimizer. So the collection that has to be sorted is dealt by minimizer into collections that
know nothing of each other. No key of a window can make longer slices: it must be a function of its 100 bytes alone.

First pass: units (buckets of documents) send the minimizers they have, a row each; a sum over each minimizer says which
are repeated. Second pass: a unit sends the segments of repeated minimizers, each distinct one once. They meet sorted by
minimizer; equal ones from several units become one, and the distinct ones, where there are several, go as documents of a
collection through the column-wise construction (BCR with longest common prefixes):
in round t one symbol of every document is inserted, that is its suffix of length t. The transform and the prefixes stand
in two files. A round reads them front to back: ranks of the symbols give the places of the new suffixes, the least
prefix since the symbol last stood, and up to where it stands next, give their prefixes. Then it reads them once more and
writes them with the new rows merged in. Only a block of the files, and a row for each document, are in memory. Runs of
prefixes of WIDTH or more are the repeated windows; the first occurrence of each stays. Third pass: units remove what is
not first.

A minimizer that occurs over `hot` times is dealt by single windows instead. Collections have `batch` documents and more;
groups of over `largest` are worked off in parts (see groups).

Defined results: a null or empty text has no bytes; documents are ordered by id, null ids last, then by a hash of the
text, then equal rows one after another; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewire.llm.common import bucketed, doc_order, documents, mix, partitions, raw_texts, rolling, sliding_min
from tradewire.llm.groups import MOVED, Group, firsts_of, table

WIDTH = 100
GRAM = 37
BASE = 0x100000001B3
#: Bytes that are hashed at once; positions take the low bits of the sort key.
PIECE = 1 << 15
LOW = np.uint64((1 << 20) - 1)
BATCH = 1024
HOT = LARGEST = 1 << 16
#: Rows of the files that are read at once.
BLOCK = 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Unit:
    """The documents of a bucket in their order."""

    def __init__(self, table: pa.Table) -> None:
        order, self.ids, self.k2, self.seq = doc_order(table.column("id").combine_chunks(), table.column("k2").combine_chunks())
        self.null = table.column("id").is_null().combine_chunks().to_numpy(zero_copy_only=False)[order]
        self.texts = [raw or b"" for raw in raw_texts(table.column("text").combine_chunks())]
        self.texts = [self.texts[i] for i in order]
        self.parts = list(self.segments())
        empty = np.zeros(0, np.int64)
        #: Of all segments: minimizer, document and start in it, windows; in the order of documents.
        self.h = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in self.parts)])
        self.doc, self.pos, self.windows = (np.concatenate([empty, *(x[i] for x in self.parts)]) for i in (2, 3, 4))

    def segments(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of (data, hash, document, start in it, windows, start in data)."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for d, raw in enumerate(self.texts):
            for at in range(0, max(0, len(raw) - WIDTH + 1), PIECE):
                part = raw[at : at + PIECE + WIDTH - 1]
                if size + len(part) > PIECE and held:
                    yield cut(held)
                    held, size = [], 0
                held.append((d, at, part))
                size += len(part)
        if held:
            yield cut(held)


def cut(held: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = b"".join(x for _, _, x in held)
    size = np.array([len(x) for _, _, x in held])
    begin = np.cumsum(size) - size
    h = mix(rolling(np.frombuffer(data, np.uint8), GRAM, BASE))
    least = sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), WIDTH - GRAM + 1)
    place = (least & LOW).astype(np.int64)
    edge = np.zeros(len(place) + WIDTH + 1, np.int8)
    edge[begin] += 1
    edge[begin + size - WIDTH + 1] -= 1
    valid = np.flatnonzero(np.cumsum(edge)[: len(place)])
    owner = np.searchsorted(begin, valid, side="right") - 1
    own = place[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.concatenate([first, [len(valid)]]))
    start, owner = valid[first], owner[first]
    docs, offsets = np.array([d for d, _, _ in held]), np.array([a for _, a, _ in held])
    return data, h[own[first]], docs[owner], start - begin[owner] + offsets[owner], windows, start


class Columns:
    """Burrows-Wheeler transform and common prefixes of a collection of byte strings, column by column, in files.

    Symbols are shifted by one; 0 marks the start of a string. Suffix order takes ends of strings as smaller than any
    symbol and different from each other.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, folder: str, block: int = BLOCK) -> None:
        """data holds all strings; they must not be empty. folder: where the two files, and their next version, stand."""
        self.data, self.start, self.size, self.m = data, start, size, len(start)
        self.folder, self.block, self.turn, self.rows = folder, block, 0, len(start)
        # UTF-8 has no byte 255. Prefixes are shorter than the longest string.
        self.kinds = {"bwt": np.dtype(np.uint8 if int(data.max(initial=0)) < 255 else np.uint16), "lcp": np.dtype(np.uint8 if int(size.max(initial=0)) < 255 else np.uint32)}
        bwt = data[start + size - 1].astype(self.kinds["bwt"]) + self.kinds["bwt"].type(1)
        self.counts = np.bincount(bwt, minlength=258)
        #: Two versions of each file: one is read while the other is written.
        self.files = [{kind: open(os.path.join(folder, f"{kind}{turn}"), "w+b", buffering=0) for kind in self.kinds} for turn in (0, 1)]
        self.files[0]["bwt"].write(bwt)
        self.files[0]["lcp"].write(np.zeros(self.m, self.kinds["lcp"]))
        at = alive = np.arange(self.m)  # places of the suffixes that were inserted last, ascending
        for t in range(1, int(size.max(initial=0)) + 1):
            at, alive = self.insert(t, at, alive)

    def part(self, kind: str, rows: int) -> np.ndarray:
        """The next rows of a file."""
        out = np.empty(rows, self.kinds[kind])
        self.files[self.turn][kind].readinto(out.view(np.uint8))
        return out

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, transform, prefixes), front to back."""
        for f in self.files[self.turn].values():
            f.seek(0)
        for at in range(0, self.rows, self.block):
            rows = min(self.block, self.rows - at)
            yield at, self.part("bwt", rows), self.part("lcp", rows)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        parts = list(self.blocks())
        return np.concatenate([b for _, b, _ in parts]), np.concatenate([l for _, _, l in parts])

    def close(self) -> None:
        for f in (f for turn in self.files for f in turn.values()):
            f.close()

    def before(self) -> np.ndarray:
        """For each symbol how many rows start with a smaller one, among those whose suffixes stand already or come now."""
        c = self.counts.copy()
        c[0] = self.m
        return np.cumsum(c) - c

    def scan(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the rows at these places: symbol, rank among equal symbols, prefix shared with the row before the new one, and with the one behind (0: none)."""
        none = np.iinfo(self.kinds["lcp"]).max
        symbol, rank = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        mine, theirs = np.zeros(len(at), self.kinds["lcp"]), np.zeros(len(at), self.kinds["lcp"])
        past, since = np.zeros(258, np.int64), np.full(258, none)
        waits, least = np.full(258, -1), np.full(258, none)  # rows whose next equal symbol is in a later block
        alone = self.rows <= self.block
        for begin, b, l in self.blocks():
            lo, hi = np.searchsorted(at, (begin, begin + len(b)))
            p = at[lo:hi] - begin
            order = np.argsort(b, kind="stable")  # by digits, as symbols are small
            place = np.empty(len(b), np.int32)
            place[order] = np.arange(len(b), dtype=np.int32)
            n = np.bincount(b, minlength=258)
            lead = np.cumsum(n) - n
            if not alone:
                up, down = np.minimum.accumulate(l), np.append(np.minimum.accumulate(l[::-1])[::-1], none)
                some = np.flatnonzero((waits >= 0) & (n > 0))
                theirs[waits[some]] = np.minimum(least[some], up[order[lead[some]]]) + 1
                waits[some] = -1
                least = np.minimum(least, up[-1])
            c = b[p].astype(np.int64)
            k = place[p].astype(np.int64)
            r = k - lead[c]
            symbol[lo:hi], rank[lo:hi] = c, past[c] + r
            inside = r > 0
            mine[lo:hi][inside] = least_between(l, order[k[inside] - 1] + 1, p[inside] + 1) + 1
            follows = r + 1 < n[c]
            theirs[lo:hi][follows] = least_between(l, p[follows] + 1, order[k[follows] + 1] + 1) + 1
            if not alone:
                first = ~inside & (past[c] > 0)
                mine[lo:hi][first] = np.minimum(since[c[first]], up[p[first]]) + 1
                last = np.flatnonzero(~follows)
                waits[c[last]], least[c[last]] = lo + last, down[p[last] + 1]
                since = np.minimum(since, up[-1])
                held = np.flatnonzero(n)
                since[held] = down[order[lead[held] + n[held] - 1] + 1]
            past += n
        return symbol, rank, mine, theirs

    def insert(self, t: int, at: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the suffixes of length t in. at: places of those one shorter, of the strings in alive, ascending."""
        symbol, rank, mine, theirs = self.scan(at)
        to = self.before()[symbol] + rank
        behind = np.flatnonzero(theirs)
        sort = np.argsort(to[behind], kind="stable")
        next_at, next_lcp = to[behind][sort] + 1, theirs[behind][sort]
        sort = np.argsort(to, kind="stable")
        to, alive, mine = to[sort], alive[sort], mine[sort]
        left = self.size[alive] > t
        new = np.zeros(len(to), self.kinds["bwt"])
        new[left] = self.data[self.start[alive[left]] + self.size[alive[left]] - t - 1].astype(self.kinds["bwt"]) + self.kinds["bwt"].type(1)
        into = to - np.arange(len(to))  # old rows before each new one
        done = 0
        out = self.files[1 - self.turn]
        for f in out.values():
            f.seek(0)
        for begin, b, l in self.blocks():
            whole = begin + len(b) == self.rows
            end = len(into) if whole else int(np.searchsorted(into, begin + len(b)))
            own = to[done:end] - (begin + done)
            old = np.ones(len(b) + len(own), bool)
            old[own] = False
            bwt, lcp = np.empty(len(old), b.dtype), np.empty(len(old), l.dtype)
            bwt[old], lcp[old] = b, l
            a, z = np.searchsorted(next_at, (begin + done, begin + done + len(old)))
            lcp[next_at[a:z] - begin - done] = next_lcp[a:z]
            bwt[own], lcp[own] = new[done:end], mine[done:end]
            out["bwt"].write(bwt)
            out["lcp"].write(lcp)
            done = end
        self.turn, self.rows = 1 - self.turn, self.rows + len(to)
        self.counts += np.bincount(new, minlength=258)
        return to[left], alive[left]

    def places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, strings, place of each one's suffix of that length), by walking from the empty suffixes."""
        bwt, _ = self.read()
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ended = int(self.counts[0])
        at, alive = np.arange(self.m), np.arange(self.m)
        for t in range(1, int(self.size.max(initial=0)) + 1):
            at = self.m + rank[at].astype(np.int64) - ended
            yield t, alive, at
            left = self.size[alive] > t
            at, alive = at[left], alive[left]


def least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[begin:end] for each pair; begin < end."""
    if not len(begin):
        return np.zeros(0, values.dtype)
    pairs = np.stack([begin, end], axis=1).ravel()
    return np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max).astype(values.dtype), pairs)[::2]


def kept_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, when: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each string a mask: bit i is set if its window at i occurs nowhere earlier. when: document rank << 32 | position."""
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        c = Columns(data, start, size, folder, block)
        group = np.cumsum(c.read()[1] < WIDTH, dtype=np.int32)
        at, string, offset = [], [], []
        for t, alive, place in c.places():
            if t >= WIDTH:
                at.append(group[place])
                string.append(alive)
                offset.append(size[alive] - t)
        c.close()
    at, string, offset = np.concatenate(at), np.concatenate(string), np.concatenate(offset)
    time = when[string] + offset.astype(np.uint64)
    order = np.lexsort((time, at))
    first = np.ones(len(order), bool)
    first[1:] = at[order][1:] != at[order][:-1]
    keep = order[first]
    mask = np.zeros(len(start), np.uint64)
    np.bitwise_or.at(mask, string[keep], np.uint64(1) << offset[keep].astype(np.uint64))
    return mask


MINIMIZERS = "bucket int, h long, times long"


def masks(group: Group, batch: int, block: int) -> np.ndarray:
    """Of each segment the windows that are first here."""
    h, _, _, pos, *_ = group.columns
    size = np.fromiter(map(len, group.text), np.int64, len(group))
    # A segment has no window twice, as equal windows have their minimizer at the same place.
    mask = np.where(size - WIDTH + 1 >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size - WIDTH + 1, 63).astype(np.uint64)) - np.uint64(1))
    shared = group.shared()
    if not len(shared):
        return mask
    when = (group.ranks() << np.uint64(32)) + pos.astype(np.uint64)
    # Documents of a collection are distinct: of equal segments from several units the first one goes in.
    first: dict[bytes, int] = {}
    for i in shared[np.argsort(when[shared], kind="stable")].tolist():
        first.setdefault(group.text[i], i)
    own = np.fromiter(first.values(), np.int64, len(first))
    own = own[np.argsort(h[own], kind="stable")]
    mask[np.setdiff1d(shared, own)] = 0
    lead = np.concatenate([[True], h[own][1:] != h[own][:-1], [True]])
    own = own[~(lead[1:] & lead[:-1])]  # what has its key alone is first
    ends = np.flatnonzero(np.concatenate([h[own][1:] != h[own][:-1], [True]])) + 1 if len(own) else np.zeros(0, np.int64)
    at = 0
    for end in ends.tolist():
        if end - at >= batch or end == len(own):
            some = own[at:end]
            data = np.frombuffer(b"".join([group.text[i] for i in some.tolist()]), np.uint8)
            mask[some] = kept_windows(data, np.cumsum(size[some]) - size[some], size[some], when[some], block)
            at = end
    return mask


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, batch: int = BATCH, largest: int = LARGEST, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n = partitions(docs, text_col=text_col)
    units = bucketed(docs, n, id_col, text_col).repartition(n, "bucket")

    def minimizers(t: pa.Table) -> pa.Table:
        h, times = np.unique(Unit(t).h, return_counts=True)
        return table([np.full(len(h), t.column("bucket")[0].as_py()), h.view(np.int64), times], MINIMIZERS)

    def move(t: pa.Table, repeated: pa.Table) -> pa.Table:
        import xxhash

        if not t.num_rows or not repeated.num_rows:
            return table([], MOVED)
        unit = Unit(t)
        found = repeated.column("h").to_numpy().view(np.uint64)
        order = np.argsort(found)
        found, often = found[order], repeated.column("often").to_numpy()[order]
        first: dict[bytes, tuple[int, int, int]] = {}  # in the order of documents: the first occurrence stays
        for data, h, doc, pos, windows, start in unit.parts:
            at = np.minimum(np.searchsorted(found, h), len(found) - 1)
            take = np.flatnonzero(found[at] == h)
            single = often[at[take]].tolist()
            for key, d, p, w, s, alone in zip(h[take].tolist(), doc[take].tolist(), pos[take].tolist(), windows[take].tolist(), start[take].tolist(), single, strict=True):
                if alone:
                    for i in range(w):
                        one = data[s + i : s + i + WIDTH]
                        if one not in first:
                            first[one] = (xxhash.xxh3_64_intdigest(one), d, p + i)
                else:
                    first.setdefault(data[s : s + w + WIDTH - 1], (key, d, p))
        key, doc, pos = (np.array(x, k) for x, k in zip(zip(*first.values(), strict=True), (np.uint64, np.int64, np.int64), strict=True))
        return table([key.view(np.int64), np.full(len(key), t.column("bucket")[0].as_py()), doc, pos, unit.ids[doc], unit.k2[doc], list(first)], MOVED)

    def remove(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], RESULT)
        unit = Unit(t)
        size = np.array([len(x) for x in unit.texts], np.int64)
        windows = np.maximum(size - WIDTH + 1, 0)
        base = np.cumsum(windows) - windows
        edge = np.zeros(int(windows.sum()) + 1, np.int8)
        doc, pos, mask = (answers.column(c).to_numpy() for c in ("doc", "pos", "mask"))
        mask = mask.view(np.uint64)
        if len(doc):
            # All segments with the minimizer of one that was sent, then what is first.
            starts = base[unit.doc] + unit.pos
            own = np.searchsorted(starts, base[doc] + pos, side="right") - 1
            take = np.isin(unit.h, np.unique(unit.h[own]))
            np.add.at(edge, starts[take], 1)
            np.add.at(edge, starts[take] + unit.windows[take], -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i in range(64):
            some = (mask >> np.uint64(i)) & np.uint64(1) == 1
            gone[base[doc[some]] + pos[some] + i] = False
        out = []
        for d, raw in enumerate(unit.texts):
            id_ = None if unit.null[d] else int(unit.ids[d])
            starts = np.flatnonzero(gone[base[d] : base[d] + windows[d]])
            if not len(starts):
                out.append((id_, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            far = np.flatnonzero(np.diff(starts) > WIDTH)  # runs that touch are one
            a = starts[np.concatenate([[0], far + 1])]
            z = starts[np.concatenate([far, [len(starts) - 1]])] + WIDTH
            kept = b"".join(raw[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True))
            out.append((id_, len(raw), int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest()))
        return table(list(map(list, zip(*out, strict=True))), RESULT)

    total = F.sum("times").over(Window.partitionBy("h"))
    found = units.groupBy("bucket").applyInArrow(minimizers, MINIMIZERS).repartition(n, "h").withColumn("total", total)
    repeated = found.filter("total > 1").select(F.col("bucket").alias("unit"), "h", (F.col("total") > hot).alias("often")).repartition(n, "unit")
    moved = units.groupBy("bucket").cogroup(repeated.groupBy("unit")).applyInArrow(move, MOVED)
    firsts = firsts_of(moved, n, lambda group: masks(group, batch, block), 8 * batch, largest).repartition(n, "unit")
    return units.groupBy("bucket").cogroup(firsts.groupBy("unit")).applyInArrow(remove, RESULT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))


#: Bytes as hex digits; windows are compared by their MD5. Documents are ordered by doc_id, which is unique.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 99))) AS i FROM d)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win
), dup AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM ranked WHERE r > 1
), runs AS (SELECT doc_id, i, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM dup
), spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a AS stop, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans
  UNION ALL SELECT s.doc_id, d.n, s.z FROM (SELECT doc_id, max(z) AS z FROM spans GROUP BY doc_id) s JOIN d USING (doc_id)
), kept AS (SELECT g.doc_id, string_agg(substr(d.h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
), sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
