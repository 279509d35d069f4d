"""Envelopes: interchange and message headers and trailers as structs, and their checks. No shuffle within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.functions.plan import fixed
from tradewire.functions.syntax import first_segment, value

# What headers may name. A message type or agency that is not listed is an issue, so the lists must be these.
SYNTAXES = ("UNOA", "UNOB", "UNOC", "UNOD", "UNOE", "UNOF", "UNOG", "UNOH", "UNOI", "UNOJ", "UNOK")
AGENCIES = ("UN", "EAN", "EDIFICE", "ODETTE", "VDA", "AIAG", "CEFIC", "ECR")
MESSAGE_TYPES = (
    "ORDERS", "ORDRSP", "DESADV", "INVOIC", "SLSRPT", "PRICAT", "RECADV", "REMADV", "INVRPT", "GENRAL", "CONTRL",
    "APERAK", "BANSTA", "HSTAT", "OSTENQ", "OSTRPT", "PARTIN", "PRODAT", "PROINQ", "QALITY", "QUOTES", "REQOTE",
    "SANCRT", "CONITT", "CONDRA", "CONQVY", "COPARN", "COPINO", "COPRAR", "COREOR", "COSHI", "COSMAT", "COSTCO",
    "COSTOR", "CUSCAR", "CUSDEC", "CUSEXP", "CUSRES", "DEBADV", "DEBMUL", "DELFOR", "DELJIT", "DGRECA", "DOCADV",
    "DOCAMA", "DOCAMI", "DOCAMR", "DOCAPP", "FINPAY", "FINSTA", "HANMOV", "ICASRP", "ICSOLI", "IFCSUM", "IFTCCA",
    "IFTDGN", "IFTFCC", "IFTMAN", "IFTMBC", "IFTMBF", "IFTMBP", "IFTMCA", "IFTMCS", "IFTMDG", "IFTMED", "IFTMFS",
    "IFTMMB", "IFTMRC", "IFTMRD", "IFTMVG", "IFTSAI", "IFTSTA", "INSDES", "INSREQ", "IPPOAD", "IPPOMO", "ITRRPT",
    "JAPRES", "JINFDE", "JOBAPP", "JOBCON", "JOBMOD", "JOBOFF", "MEDPID", "MEDREQ", "MEDRPT", "MEQPOS", "MOVINS",
    "ORDCHG", "PASREQ", "PASRPT", "PAXLST", "PAYEXT", "PAYMUL", "PAYORD", "PRODEX", "PROSRV", "RDRMES", "REBORD",
    "RECALC", "RECECO", "RECLAM", "REQDOC", "RESETT", "RESMSG", "RESRSP", "SLSPRT", "SOCADE", "SSIMOD", "STATAC",
    "SUPCOT", "SUPMAN", "SUPRES", "TANSTA", "TAXCON", "TIQREQ", "TIQRPT", "VATDEC", "VESDEP", "WASDIS", "WKGRDC",
)


def reference(seg: Column, n: int) -> Column:
    """A simple element, or the first component of a composite."""
    return F.coalesce(value(seg, n), value(seg, n, 1))


def headers(segs: Column) -> Column:
    """UNB and UNZ of a file's segments as a struct."""
    b, z = first_segment(segs, "UNB"), F.get(F.filter(segs, lambda s: s["tag"] == "UNZ"), F.lit(0))
    return F.struct(
        value(b, 1, 1).alias("syntax"), value(b, 1, 2).alias("syntax_version"), reference(b, 2).alias("sender"), reference(b, 3).alias("receiver"), value(b, 4, 1).alias("date"), value(b, 4, 2).alias("time"), reference(b, 5).alias("control_ref"),
        reference(z, 1).alias("declared_messages"), reference(z, 2).alias("trailer_ref"), b.isNotNull().alias("has_unb"), z.isNotNull().alias("has_unz"),
    )


def message_headers(segs: Column) -> Column:
    h, t = first_segment(segs, "UNH"), F.get(F.filter(segs, lambda s: s["tag"] == "UNT"), F.lit(0))
    return F.struct(
        reference(h, 1).alias("message_ref"), reference(h, 2).alias("type"), value(h, 2, 2).alias("version"), value(h, 2, 3).alias("release"), value(h, 2, 4).alias("agency"), value(h, 2, 5).alias("association"),
        reference(t, 1).alias("declared_segments"), reference(t, 2).alias("trailer_ref"), F.size(segs).alias("segments"), t.isNotNull().alias("has_unt"),
    )


def interchange_error(h: Column, messages: Column) -> Column:
    """The kind of the first failing check, or null."""
    version = h["syntax_version"].try_cast("int")
    return F.coalesce(
        F.when(~h["has_unb"], "MissingHeader"),
        F.when(~h["has_unz"], "MissingTrailer"),
        F.when(~h["control_ref"].eqNullSafe(h["trailer_ref"]), "MismatchedControlReference"),
        F.when(~h["declared_messages"].try_cast("int").eqNullSafe(messages.cast("int")), "IncorrectMessageCount"),
        F.when(~F.coalesce(h["syntax"], F.lit("")).isin(*SYNTAXES) | F.coalesce((version < 1) | (version > 4), F.lit(False)), "InvalidSyntaxIdentifier"),
    )


def orphans(cut: DataFrame) -> DataFrame:
    """(source, error, count): messages outside an interchange, in files that have one, and segments outside a message."""
    start = F.struct(F.lit(False).alias("file"), F.lit(False).alias("message"), F.lit(0).alias("messages"), F.lit(0).alias("segments"))

    def step(a: Column, s: Column) -> Column:
        tag = s["tag"]
        file = F.when(tag == "UNB", True).when(tag == "UNZ", False).otherwise(a["file"])
        message = F.when(tag == "UNH", True).when(tag.isin("UNT", "UNZ"), False).otherwise(a["message"])
        lost = ~a["message"] & ~tag.isin("UNB", "UNZ", "UNG", "UNE", "UNH")
        return F.struct(file.alias("file"), message.alias("message"), (a["messages"] + ((tag == "UNH") & ~a["file"]).cast("int")).alias("messages"), (a["segments"] + lost.cast("int")).alias("segments"))

    rows = fixed(cut, n=F.aggregate("segs", start, step), enclosed=F.exists("segs", lambda s: s["tag"] == "UNB"))
    kinds = F.array(F.struct(F.lit("OrphanedMessage").alias("error"), F.when(F.col("enclosed"), F.col("n.messages")).otherwise(0).alias("count")), F.struct(F.lit("OrphanedSegment").alias("error"), F.col("n.segments").alias("count")))
    return rows.select("source", F.inline(F.filter(kinds, lambda r: r["count"] > 0)))


def message_error(h: Column) -> Column:
    return F.coalesce(
        F.when(~h["has_unt"], "MissingTrailer"),
        F.when(~h["message_ref"].eqNullSafe(h["trailer_ref"]), "MismatchedControlReference"),
        F.when(~h["declared_segments"].try_cast("int").eqNullSafe(h["segments"]), "IncorrectSegmentCount"),
        F.when(~F.upper(F.coalesce(h["type"], F.lit(""))).isin(*MESSAGE_TYPES) | ~F.coalesce(h["agency"], F.lit("")).isin(*AGENCIES), "InvalidMessageType"),
    )


def check_interchanges(files: DataFrame) -> DataFrame:
    """(source, segs of the whole file) -> source, header fields, messages, error."""
    n = F.size(F.filter("segs", lambda s: s["tag"] == "UNH"))
    rows = fixed(files, h=headers(F.col("segs")), messages=n)
    return rows.select("source", "h.*", "messages", interchange_error(F.col("h"), F.col("messages")).alias("error"))


def check_messages(found: DataFrame) -> DataFrame:
    """Messages -> source, msg_idx, header fields, error."""
    rows = fixed(found, h=message_headers(F.col("segs"))).select("source", "msg_idx", "h")
    return rows.select("source", "msg_idx", "h.*", message_error(F.col("h")).alias("error"))
