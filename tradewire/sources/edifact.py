"""Interchange files and texts as relations: one row for each message, its segments as an array.

Everything stays on the JVM and needs no shuffle: a file's messages are array slices between its trailers. A file is one
row, so files are what is spread; very large ones are better delivered in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewire.functions import syntax
from tradewire.functions.plan import fixed

#: Message types whose LIN loops are groups, and the tags that end one. Fixed values.
GROUPED = ("ORDERS", "SLSRPT", "ORDRSP")
ENDS = ("UNS", "CNT", "UNT")
LARGEST = 100 << 20
BREAK = re.compile(r"\r\n|\r|\n")


def read(spark: SparkSession, path: str, glob: str = "*.edi", largest: int = LARGEST, ordered: bool = False) -> DataFrame:
    """(source, text, size) of the files under a folder, at any depth, or of one file; larger ones have no text but an error.

    `ordered`: by source.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = raw.load(path) if path.endswith(glob.lstrip("*")) else raw.option("pathGlobFilter", glob).load(path)
    over = F.col("length") > largest
    raw = raw.orderBy("path") if ordered else raw
    return raw.select(F.col("path").alias("source"), F.when(~over, F.decode("content", "UTF-8")).alias("text"), F.col("length").alias("size"), F.when(over, F.concat(F.lit("file of "), F.col("length").cast("string"), F.lit(f" bytes is over {largest}"))).alias("error"))


def tokenized(texts: DataFrame, custom: bool = True, separators: syntax.Separators = syntax.DEFAULT, tags: set[str] | None = None) -> DataFrame:
    """(source, text) -> source, raw, segs, error. `custom`: follow each text's own service string.

    `tags`: only segments with these are cut into elements (and UNH, which names the message); the others have none.
    """
    sep: syntax.Separators | Column = separators
    if custom:
        texts, kept = fixed(texts, sep=syntax.una_struct(F.col("text"))), [c for c in texts.columns if c not in ("raw", "segs", "error", "sep")]
        sep = F.col("sep")
    else:
        kept = [c for c in texts.columns if c not in ("raw", "segs", "error")]
    release = F.lit(sep.release) if isinstance(sep, syntax.Separators) else sep["release"]
    raw = fixed(texts, raw=F.filter(syntax.raw_segments(F.col("text"), sep), lambda x: x.isNotNull()), _plain=~F.contains("text", release))
    bad = F.filter(F.transform("raw", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~syntax.is_tagged(s["x"], sep))
    first = F.when(F.exists("raw", lambda x: ~syntax.is_tagged(x, sep)), F.get(bad, F.lit(0)))
    cut = fixed(raw, bad=first)
    error = F.when(F.col("bad").isNotNull(), F.concat(F.lit("segment "), F.col("bad.i").cast("string"), F.lit(": "), F.when(F.col("bad.x").rlike("^[A-Z]{3}"), "expected element separator or segment terminator after segment tag").otherwise("expected segment tag (3 characters)")))
    none = F.array().cast(f"array<{syntax.ELEMENT}>")

    def segments(plain: bool) -> Column:
        def elements(x: Column) -> Column:
            all_ = syntax.elements_of(x, sep, plain)
            return all_ if tags is None else F.when(F.substring(x, 1, 3).isin("UNH", *sorted(tags - {"UNH"})), all_).otherwise(none)

        return F.transform("raw", lambda x, i: F.struct(i.alias("idx"), F.substring(x, 1, 3).alias("tag"), elements(x).alias("el")))

    # Most texts release nothing: for these the plainer expression does.
    segs = F.when(F.col("_plain"), segments(True)).otherwise(segments(False)) if isinstance(sep, syntax.Separators) else segments(False)
    return fixed(cut, segs=F.when(F.col("bad").isNull(), segs), error=error).select(*kept, "raw", "segs", "error")


def messages(texts: DataFrame, custom: bool = True, separators: syntax.Separators = syntax.DEFAULT, tags: set[str] | None = None) -> DataFrame:
    """(source, text) -> source, msg_idx, message_ref, doc_type, version, partial, segs, and the other columns.

    A message runs from the first UNH after the last trailer to its UNT. What is open at the end of the file is a partial
    message if it has a UNH. Files with a parse error give no messages: see `failures`.
    """
    cut = tokenized(texts, custom, separators, tags).filter(F.col("error").isNull() & (F.size("segs") > 0))
    tags = F.transform("segs", lambda s: s["tag"])
    ends = F.filter(F.transform("segs", lambda s, i: F.when(s["tag"].isin("UNT", "UNZ"), i)), lambda i: i.isNotNull())
    base = fixed(cut, tags=tags, ends=ends)
    last = F.size("segs") - 1
    closed = F.transform("ends", lambda e, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("ends"), k - 1) + 1).alias("a"), e.alias("z"), (F.get(F.col("tags"), e) == "UNT").alias("whole")))
    after = F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1).otherwise(F.lit(0))
    open_ = F.when(after <= last, F.array(F.struct(after.alias("a"), last.alias("z"), F.lit(False).alias("whole")))).otherwise(F.array().cast("array<struct<a:int,z:int,whole:boolean>>"))
    spans = F.concat(F.filter(closed, lambda s: s["whole"]), open_)
    placed = F.transform(spans, lambda s: F.struct((s["a"] + F.array_position(F.slice(F.col("tags"), s["a"] + 1, s["z"] - s["a"] + 1), "UNH").cast("int") - 1).alias("u"), s["a"].alias("a"), s["z"].alias("z"), (~s["whole"]).alias("partial")))
    kept = [c for c in cut.columns if c not in ("text", "raw", "segs", "error")]
    each = fixed(base, spans=F.filter(placed, lambda s: s["u"] >= s["a"]))
    rows = each.select(*kept, "segs", F.posexplode("spans").alias("msg_idx", "span"))
    part = F.transform(F.slice("file", F.col("span.u") + 1, F.col("span.z") - F.col("span.u") + 1), lambda s, i: F.struct(i.alias("idx"), s["tag"].alias("tag"), s["el"].alias("el")))
    own = F.when((F.col("span.u") == 0) & (F.col("span.z") == F.size("file") - 1), F.col("file")).otherwise(part)
    rows = fixed(rows.withColumnRenamed("segs", "file"), partial=F.col("span.partial"), segs=own).select(*kept, "msg_idx", "partial", "segs")
    return with_info(rows)


def with_info(rows: DataFrame) -> DataFrame:
    """Adds message_ref (simple first element of UNH), doc_type and version (from its composite second one)."""
    rows = fixed(rows, unh=F.get("segs", F.lit(0)))  # a message starts with it
    unh = F.col("unh")
    kind, version, release = (syntax.value(unh, 2, n) for n in (1, 2, 3))
    return rows.withColumn("message_ref", syntax.value(unh, 1)).withColumn("doc_type", kind).withColumn("version", F.when(release.isNull(), version).otherwise(F.concat_ws("_", version, release))).drop("unh")


def failures(texts: DataFrame, custom: bool = True) -> DataFrame:
    """(source, error) of the files that do not parse."""
    return tokenized(texts, custom).filter(F.col("error").isNotNull()).select("source", "error")


def warnings(found: DataFrame) -> DataFrame:
    """(source, msg_idx, message_ref, message) for partial messages."""
    return found.filter("partial").select("source", "msg_idx", "message_ref", F.lit("message has no UNT trailer; kept as a partial message").alias("message"))


def single(found: DataFrame) -> DataFrame:
    """Messages of sources that have exactly one; any other source raises."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    return found.withColumn("n", n).withColumn("n", F.when(F.col("n") == 1, F.col("n")).otherwise(F.raise_error(F.lit("more than one message")).cast("long"))).filter("n = 1").drop("n")


def grouped(found: DataFrame, types: tuple[str, ...] = GROUPED) -> DataFrame:
    """Adds root (segments outside line items) and items (an array of segments for each LINE_ITEM).

    LIN opens an item; UNS, CNT, UNT or the next LIN closes it; segments after a closing tag belong to the root.
    """
    segs = F.col("segs")
    events = F.filter(F.transform(segs, lambda s, i: F.when(s["tag"].isin("LIN", *ENDS), F.struct(i.alias("i"), (s["tag"] == "LIN").alias("opens")))), lambda e: e.isNotNull())
    with_events = fixed(found, events=events)
    spans = F.transform("events", lambda e, k: F.struct(e["opens"].alias("opens"), e["i"].alias("a"), F.coalesce(F.get(F.col("events"), k + 1)["i"], F.size("segs")).alias("z")))
    with_spans = fixed(with_events, spans=spans)
    part = lambda s: F.slice(F.col("segs"), s["a"] + 1, s["z"] - s["a"])
    first = F.coalesce(F.get("events", F.lit(0))["i"], F.size("segs"))
    head = F.slice("segs", F.lit(1), first)
    rest = F.flatten(F.transform(F.filter("spans", lambda s: ~s["opens"]), part))
    items = F.transform(F.filter("spans", lambda s: s["opens"]), part)
    is_grouped = F.coalesce(F.col("doc_type").isin(*types), F.lit(False)) if types else F.lit(False)
    kind = found.schema["segs"].dataType.simpleString()
    return fixed(with_spans, root=F.when(is_grouped, F.concat(head, rest)).otherwise(segs), items=F.when(is_grouped, items).otherwise(F.array().cast(f"array<{kind}>"))).drop("events", "spans")


def exploded(found: DataFrame) -> DataFrame:
    """One row for each segment: source, msg_idx, message_ref, seg_idx, tag, el."""
    return found.select("source", "msg_idx", "message_ref", F.inline("segs")).withColumnRenamed("idx", "seg_idx")


def readable(files: DataFrame) -> DataFrame:
    """The files, if there are any and all of them have a text; raises otherwise. Looks at names and sizes only."""
    names = files.select("source", "error")
    if names.isEmpty():
        raise FileNotFoundError("no input files found")
    bad = names.filter(F.col("error").isNotNull()).orderBy("source").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['source']}: {r['error']}" for r in bad))
    return files


PLACES = "source string, seg_idx int, tag string, offset int, line int, column int"


def positions(texts: DataFrame, at_start: bool = False) -> DataFrame:
    """(source, seg_idx, tag, offset, line, column) after each tag, or before it with `at_start`.

    LF, CR and CRLF each end a line. Offsets are characters. A file's tokens are walked once, in its row: running sums
    need no shuffle this way.
    """
    sep = syntax.una_struct(F.col("text"))
    start = F.when(syntax.has_una(F.col("text")), F.lit(9)).otherwise(F.lit(0))
    cut = texts.select("source", start.alias("start"), F.substring("text", F.lit(1), start).alias("head"), syntax.tokens(syntax.without_una(F.col("text")), sep["segment"], sep["release"]).alias("tokens"), sep["segment"].alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, at, head, tokens, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = list(_places(source, at, head, tokens or [], end, at_start))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)) if rows else [[]] * 6, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=[x.split()[0] for x in PLACES.split(", ")])

    return cut.filter(F.col("tokens").isNotNull()).mapInArrow(run, PLACES)


def _places(source: str, at: int, head: str, tokens: list[str], end: str, at_start: bool) -> Iterator[tuple]:
    line, begin, past, n = 1, 0, "", 0

    def step(text: str, offset: int) -> None:
        nonlocal line, begin, past
        if text[:1] == "\n" and past == "\r":
            begin = offset + 1  # the second half of a line end
            text, offset = text[1:], offset + 1
            past = "\n"
        for m in BREAK.finditer(text):
            line, begin = line + 1, offset + m.end()
        past = text[-1:] or past

    step(head, 0)
    for token in tokens:
        own = token.lstrip(" \r\n\t")
        lead = len(token) - len(own)
        cut = lead + (0 if at_start else min(3, len(own)))
        step(token[:cut], at)
        if own:
            yield source, n, own[:3], at + cut, line, at + cut - begin + 1
            n += 1
        step(token[cut:] + end, at + cut)
        at += len(token) + 1


def parse_errors(texts: DataFrame, custom: bool = True) -> DataFrame:
    """(source, seg_idx, error, line, column) of the files that do not parse: where the segment without a proper tag starts."""
    bad = failures(texts, custom).withColumn("seg_idx", F.regexp_extract("error", "^segment ([0-9]+)", 1).cast("int"))
    found = positions(texts.join(bad.select("source"), "source", "left_semi"), at_start=True)
    return bad.join(found, ["source", "seg_idx"]).select("source", "seg_idx", F.regexp_replace("error", "^segment [0-9]+: ", "").alias("error"), "line", "column")
