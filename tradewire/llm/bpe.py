"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap by `overlap` characters; every chunk is pre-tokenised on its own. Neighbours
then compare the pre-token boundaries they found in their overlap: matching is stateless and looks ahead at most `ahead`
characters, so from the first boundary that both have (and that the left chunk's cut cannot have made) both go on alike.
That point is the seam: each chunk encodes from its left seam to its right one. Where an overlap has no common boundary (a
run of letters longer than the overlap, say) the chunks on both sides stay text, and are encoded as one piece when the
document's pieces are put together, so the result is exact whatever the text. Decoding concatenates the raw bytes of the
ids.

Texts of over `spread` characters are cut into long chunks first, which go to any task; chunks and whole texts are then
cut again, in place, into chunks of CHUNK characters. A text within one chunk has no seam and is one piece.

Pre-tokens never cross a seam, so encoding the text between two seams gives the ids of exactly its own pre-tokens. That
holds for patterns that look ahead by a bounded number of characters. It is known for the public pattern; for any other it
must be given.

Defined results: a null text is empty (no ids); repeated rows and null ids give a row each; other columns are not read.
A document's ids are put together in one task: they take no more than four times its own row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.llm.common import documents, partitions, slices, tidy

#: Chunks in place, and chunks that are dealt to tasks, with their overlaps.
CHUNK, OVERLAP = 1 << 11, 1 << 6
SPREAD, SPREAD_OVERLAP = 1 << 15, 1 << 8
#: Bytes of whole texts that are encoded at once.
SLICE = 1 << 21
#: A match of the public pattern depends on so many characters beyond its start, and fewer beyond its end.
AHEAD = 4


def ahead_of(pattern: str, ahead: int | None = None) -> int:
    """How far a match may look; given, or known for the public pattern."""
    import public_tokenizers

    if ahead is None and pattern != public_tokenizers.PATTERN:
        raise ValueError("say how many characters a match of this pattern may look ahead")
    return AHEAD if ahead is None else ahead


@cache
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(text: str, path: str, pattern: str, ahead: int | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a text, by chunks that are pre-tokenised apart, stitched, and encoded between seams."""
    parts = cut(text, chunk, overlap)
    if len(parts) == 1:
        return encode_piece(text, path, pattern)
    ahead = ahead_of(pattern, ahead)
    found = [boundaries(p, pattern, k == len(parts) - 1, ahead) for k, p in enumerate(parts)]
    seams = [seam(a[a >= chunk] - chunk, b[b <= overlap]) for a, b in zip(found, found[1:], strict=False)]
    done = [between(p, -2 if k == 0 else seams[k - 1], -2 if k == len(parts) - 1 else seams[k], chunk) for k, p in enumerate(parts)]
    return join([(None, t) if open_ else (encode_piece(t, path, pattern).tobytes(), None) for t, open_ in done], path, pattern)


def encode_piece(text: str, path: str, pattern: str) -> np.ndarray:
    return np.array(tokenizer(path, pattern).encode_ordinary(text), "<u4")


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """The concatenated bytes of the ids."""
    return tokenizer(path, pattern).decode_bytes(ids.tolist())


def boundaries(text: str, pattern: str, last: bool, ahead: int) -> np.ndarray:
    """Where matches start and end; without those that the end of a cut chunk may have moved."""
    ends = np.unique(np.array([0, *(x for m in splitter(pattern).finditer(text) for x in m.span())], np.int64))
    return ends if last else ends[ends + ahead < len(text)]


def seam(left: np.ndarray, right: np.ndarray) -> int:
    """The first boundary of both, counted from the start of the overlap; -1 without one."""
    both = np.intersect1d(left, right, assume_unique=True)
    return int(both[0]) if len(both) else -1


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunk k starts at k x chunk and reaches `overlap` characters into the next."""
    return [text[at : at + chunk + overlap] for at in range(0, max(1, len(text)), chunk)]


def between(part: str, left: int, right: int, chunk: int) -> tuple[str, bool]:
    """A chunk's text between two seams (-2: the text's own end), and whether a seam is missing (-1)."""
    return part[max(0, left) : None if right == -2 else chunk + max(0, right)], -1 in (left, right)


def join(parts: list[tuple[bytes | None, str | None]], path: str, pattern: str) -> np.ndarray:
    """Ids of consecutive pieces; pieces that are still text (no seam between them) are encoded as one."""
    out, open_ = [], []
    for ids, text in [*parts, (b"", None)]:
        if text is not None:
            open_.append(text)
            continue
        if open_:
            out.append(encode_piece("".join(open_), path, pattern).tobytes())
            open_ = []
        out.append(ids)
    return np.frombuffer(b"".join(out), "<u4")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, n_tokens long, ids binary"


def _digests(ids: pa.Array, found: list[np.ndarray], path: str, pattern: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(decode(x, path, pattern)).hexdigest() for x in found], pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _tokens(ids: pa.Array, found: list[np.ndarray], path: str, pattern: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "n_tokens", "ids"])


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, overlap: int = SPREAD_OVERLAP, digests: bool = False, ahead: int | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), or with `digests` the SHA-256 of ids and of decoded bytes."""
    ahead = ahead_of(pattern, ahead)
    if not 2 * ahead < overlap < spread:
        raise ValueError("the overlap must be over twice the look-ahead and under the chunk")
    finish, schema = (_digests, DIGEST) if digests else (_tokens, TOKENS)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    long_ = F.coalesce(F.length("text"), F.lit(0)) > spread

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, "text", SLICE)):
            yield finish(b.column(0), [encode(t or "", path, pattern, ahead) for t in b.column(1).to_pylist()], path, pattern)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, k2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = cut(t, spread, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), pa.array([len(parts)] * n, pa.int32()), pa.array(some, pa.string())], names=["id", "k2", "k", "parts", "text"])

    def pretokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk goes to itself, its boundaries in an overlap to the neighbour there."""
        for b in batches:
            for i, k2, k, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ends = boundaries(t, pattern, k == n - 1, ahead)
                head, tail = ends[ends <= overlap].astype("<i8").tobytes(), (ends[ends >= spread] - spread).astype("<i8").tobytes()
                rows = [(k, t, head, tail, None, None, 1)]
                if k:
                    rows.append((k - 1, None, None, None, None, head, 0))
                if k < n - 1:
                    rows.append((k + 1, None, None, None, tail, None, 0))
                ks, texts, *bounds, one = zip(*rows, strict=True)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([i] * m, pa.int64()), pa.array([k2] * m, pa.int64()), pa.array(ks, pa.int32()), pa.array([n] * m, pa.int32()), pa.array(texts, pa.string()), *(pa.array(x, pa.binary()) for x in bounds), pa.array(one, pa.int32())], names=["id", "k2", "k", "parts", "text", "head", "tail", "before", "after", "one"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for r in b.to_pylist():
                head, tail, before, after = (np.frombuffer(r[c] or b"", "<i8") for c in ("head", "tail", "before", "after"))
                left = -2 if r["k"] == 0 else seam(before, head)
                right = -2 if r["k"] == r["parts"] - 1 else seam(tail, after)
                own, open_ = between(r["text"], left, right, spread)
                ids.append(None if open_ else encode(own, path, pattern, ahead).tobytes())
                texts.append(own if open_ else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k2"), b.column("k"), b.column("copies"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["id", "k2", "k", "copies", "ids", "text"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1)
                found = join([(x["ids"], x["text"]) for x in r.column(1)[0].as_py()], path, pattern)
                n = r.column(2)[0].as_py()
                one = finish(r.column(0), [found], path, pattern)
                yield one.take(pa.array([0] * n))

    chunks = own.filter(long_).withColumn("k2", F.xxhash64("text")).mapInArrow(split, "id long, k2 long, k int, parts int, text string")
    n = partitions(docs, text_col=text_col)
    dealt = chunks.repartition(n, "id", "k2", "k").mapInArrow(pretokenize, "id long, k2 long, k int, parts int, text string, head binary, tail binary, before binary, after binary, one int")
    met = dealt.groupBy("id", "k2", "k", "parts").agg(*(F.max(c).alias(c) for c in ("text", "head", "tail", "before", "after")), F.sum("one").alias("copies"))
    coded = met.select("id", "k2", "k", "parts", "text", "head", "tail", "before", "after", "copies").mapInArrow(encode_chunks, "id long, k2 long, k int, copies long, ids binary, text string")
    rest = coded.groupBy("id", "k2").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "text"))).alias("parts"), F.max("copies").alias("copies")).select("id", "parts", "copies").mapInArrow(assemble, schema)
    return own.filter(~long_).mapInArrow(tidy(whole), schema).unionByName(rest)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
