"""Text helpers as Column expressions: escaping, number text, names. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_text(c: Column) -> Column:
    """A double as the shortest plain text: 9 for 9.0, and no exponent."""
    plain = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    short = c.cast("string")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(38,0)").cast("string"))
        .when(short.contains("E"), plain)
        .otherwise(short)
    )


def escape_wire(c: Column, release: str = "?", specials: str = "?+:'") -> Column:
    """Puts the release character before each special character."""
    return F.regexp_replace(c, f"([{_class(specials)}])", _dollar(release) + "$1")


def unescape_wire(c: Column, release: str = "?") -> Column:
    return F.when(c.contains(release), F.regexp_replace(c, f"{_class(release)}([\\s\\S])", "$1")).otherwise(c)


def _class(chars: str) -> str:
    return "".join("\\" + x if not x.isalnum() else x for x in chars)


def _dollar(x: str) -> str:
    return "\\" + x if x in "\\$" else x


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_xml(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_html(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def escape_csv(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break; quotes doubled."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def xml_name(c: Column) -> Column:
    """Characters that a name cannot have at their place become `_`; one that starts with xml gets one in front; a blank one is `item`."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.-]", "_"), "^[^A-Za-z_]", "_")
    return F.when(clean == "", F.lit("item")).when(F.lower(clean).startswith("xml"), F.concat(F.lit("_"), clean)).otherwise(clean)


def sql_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def safe_id(c: Column) -> Column:
    """What is not a letter or digit becomes a dash."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "-")


def closest(c: Column, candidates: list[str], most: int = 2) -> Column:
    """The candidate with the least edit distance, up to `most`; the first of equals; null without one."""
    scored = F.array(*[F.struct(F.levenshtein(c, F.lit(x)).alias("d"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(candidates)])
    best = F.array_min(F.filter(scored, lambda s: s["d"] <= most))
    return best["x"]
