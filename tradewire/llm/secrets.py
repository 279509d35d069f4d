"""Secret scans: a keyword automaton first, anchored patterns only at its hits, then embedded checksums.

Base kinds, leftmost non-overlapping per kind: `assign` (a key word, a separator and a value of 6 or more characters),
`access` (AKIA and upper-case letters or digits, 20 or more) and `hex` (24 or more lower-case hex digits). Added kinds
carry a checksum, and only valid ones count: `ghp` and `npm` (a prefix, 30 letters or digits, then their CRC32 in six
base-62 digits). The hex kind has no literal, so its automaton keys are all four-digit hex strings: the first hit in a
run is the start of the run.

Defined results: a null text is empty (no spans); empty texts have none; repeated rows and null ids each give their own
row; other columns are not read. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tradewire.llm.common import documents, raw_texts, slices, tidy

# Kinds in the order of the contract, key words, patterns.
KINDS = ("assign", "access", "hex", "ghp", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = re.compile(rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST = {"value": 6, "access": 20, "hex": 24}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@cache
def automaton():
    """Keys are lower case; the value is the kind and how far back the key starts from its last character."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, (0, len(w) - 1))
    a.add_word("akia", (1, 3))
    for w in ("".join(x) for x in product("0123456789abcdef", repeat=4)):
        a.add_word(w, (2, 3))
    for w in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        a.add_word(w, (3, 3))
    a.make_automaton()
    return a


def checksum(body: bytes) -> bytes:
    """CRC32 in six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.encode()


def byte_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    found, past = [], [0, 0, 0, 0]
    for last, (kind, back) in automaton().iter(raw.lower().decode("latin-1")):
        p = last - back
        if p < past[kind]:
            continue
        if kind == 0:
            if m := ASSIGN.match(raw, p):
                past[0] = m.end()
                if m.end(2) - m.start(2) >= LEAST["value"]:
                    found.append((p, 0, m.end()))
        elif kind == 1:
            if m := ACCESS.match(raw, p):
                past[1] = m.end()
                if m.end() - p >= LEAST["access"]:
                    found.append((p, 1, m.end()))
        elif kind == 2:
            if m := HEX.match(raw, p):
                past[2] = m.end()
                if m.end() - p >= LEAST["hex"]:
                    found.append((p, 2, m.end()))
        elif (m := CHECKED.match(raw, p)) and checksum(m[2]) == m[3]:
            past[3] = m.end()
            found.append((p, 4 if m[1] == b"npm" else 3, m.end()))
    return sorted(found)


def spans(raw: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed."""
    found = byte_spans(raw)
    if not found or raw.isascii():
        return [(s, KINDS[k], e) for s, k, e in found]
    points = {at: len(raw[:at].decode("utf-8", "replace")) for s, _, e in found for at in (s, e)}
    return [(points[s], KINDS[k], points[e]) for s, k, e in found]


def redact(raw: bytes) -> bytes:
    """Each maximal run of covered bytes becomes one mark that names the kind of its first span."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in byte_spans(raw):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [raw[at:s], f"[{KINDS[k]}]".encode()]
        at = e
    return b"".join([*out, raw[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of the base kinds, a digest of the base spans, all spans, and the count of checked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for raw in raw_texts(b.column(1)):
                all_ = spans(raw or b"")
                base = [x for x in all_ if x[1] in KINDS[:3]]
                for i, kind in enumerate(KINDS[:3]):
                    rows[i].append(sum(x[1] == kind for x in base))
                said = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
                rows[3].append(hashlib.sha256(said.encode()).hexdigest())
                rows[4].append(",".join(f"{k}:{s}:{e}" for s, k, e in all_))
                rows[5].append(len(all_) - len(base))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(r, pa.int64()) for r in rows[:3]), *(pa.array(r, pa.string()) for r in rows[3:5]), pa.array(rows[5], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; secrets in the text are replaced by marks, a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, text_col, 1 << 22)):
            texts = pa.array([None if raw is None else redact(raw).decode("utf-8", "replace") for raw in raw_texts(b.column(at))], pa.string())
            yield b.set_column(at, text_col, texts)

    return docs.mapInArrow(tidy(run), docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
