"""The wire syntax as Column expressions: separators, segments, elements, components.

A text is cut by one regular expression for each level. The separator is put in front of the text, so that every token
starts with one, and the token pattern is possessive: it steps over released characters and never backtracks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewire.functions.text import unescape_wire

ELEMENT = "struct<v:string,c:array<string>>"


@dataclass(frozen=True)
class Separators:
    component: str = ":"
    element: str = "+"
    decimal: str = "."
    release: str = "?"
    reserved: str = " "
    segment: str = "'"

    def una(self) -> str:
        return "UNA" + self.component + self.element + self.decimal + self.release + self.reserved + self.segment

    @staticmethod
    def of_una(text: str) -> Separators | None:
        return Separators(*text[3:9]) if text.startswith("UNA") and len(text) >= 9 else None


DEFAULT = Separators()


def has_una(text: Column) -> Column:
    """A service string is only one at the very start, and has nine characters."""
    return text.startswith("UNA") & (F.length(text) >= 9)


def una_struct(text: Column) -> Column:
    """The separators of each text: its own, or the default ones."""
    own = has_una(text)
    parts = ("component", DEFAULT.component, 4), ("element", DEFAULT.element, 5), ("decimal", DEFAULT.decimal, 6), ("release", DEFAULT.release, 7), ("reserved", DEFAULT.reserved, 8), ("segment", DEFAULT.segment, 9)
    return F.struct(*[F.when(own, F.substring(text, at, 1)).otherwise(F.lit(d)).alias(n) for n, d, at in parts])


def una_text(sep: Column) -> Column:
    """The service string of a struct of separators."""
    return F.concat(F.lit("UNA"), *[sep[n] for n in ("component", "element", "decimal", "release", "reserved", "segment")])


def without_una(text: Column) -> Column:
    return F.when(has_una(text), F.substring(text, F.lit(10), F.length(text))).otherwise(text)


def token_pattern(separator: str | Column, release: str | Column) -> Column:
    """A separator, then a token (group 1) up to the next separator that is not released."""
    if isinstance(separator, str) and isinstance(release, str):
        s, r = (("\\" + x if not x.isalnum() else x) for x in (separator, release))
        return F.lit(f"{s}([^{r}{s}]*+(?:{r}[\\s\\S]?[^{r}{s}]*+)*+)")
    s, r = (F.concat(F.lit("\\"), x) for x in (separator, release))
    return F.concat(s, F.lit("([^"), r, s, F.lit("]*+(?:"), r, F.lit("[\\s\\S]?[^"), r, s, F.lit("]*+)*+)"))


def tokens(text: Column, separator: str | Column, release: str | Column) -> Column:
    """The parts between separators. A text without the release character is split; others go by the pattern."""
    if isinstance(separator, str) and isinstance(release, str):
        matched = F.regexp_extract_all(F.concat(F.lit(separator), text), token_pattern(separator, release), F.lit(1))
        return F.when(text.contains(release), matched).otherwise(F.split(text, "\\" + separator if not separator.isalnum() else separator, -1))
    return F.regexp_extract_all(F.concat(F.lit(separator) if isinstance(separator, str) else separator, text), token_pattern(separator, release), F.lit(1))


def released(c: Column, release: str | Column) -> Column:
    if isinstance(release, str):
        return unescape_wire(c, release)
    return F.when(F.contains(c, release), F.regexp_replace(c, F.concat(F.lit("\\"), release, F.lit("([\\s\\S])")), F.lit("$1"))).otherwise(c)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def raw_segments(text: Column, sep: Separators | Column = DEFAULT) -> Column:
    """Segment texts without the blanks before them; the rest after the last terminator goes if it is blank."""
    s, r = (sep.segment, sep.release) if isinstance(sep, Separators) else (sep["segment"], sep["release"])
    all_ = F.transform(tokens(without_una(text), s, r), lambda x: F.ltrim(x, F.lit(" \r\n\t")))
    return bound(all_, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def elements_of(raw: Column, sep: Separators | Column = DEFAULT, plain: bool = False) -> Column:
    """The elements of a segment text: one component makes a simple element (v), several a composite (c).

    `plain`: there is no release character in the text, so nothing has to be looked at for one. An element that starts with a component separator gives an empty simple element first, as the format's readers do.
    `TAG+` and `TAG` have none.
    """
    e, c, r = (sep.element, sep.component, sep.release) if isinstance(sep, Separators) else (sep["element"], sep["component"], sep["release"])
    element = F.lit(e) if isinstance(e, str) else e
    rest = F.substring(raw, F.lit(4), F.length(raw))
    none = F.lit(None).cast("string")
    undone = (lambda x: x) if plain else (lambda x: released(x, r))
    parted = (lambda x, s: F.split(x, "\\" + s if not s.isalnum() else s, -1)) if plain and isinstance(e, str) else (lambda x, s: tokens(x, s, r))
    simple = lambda x: F.struct(undone(x).alias("v"), F.lit(None).cast("array<string>").alias("c"))
    comp = F.lit(c) if isinstance(c, str) else c

    empty = F.struct(F.lit("").alias("v"), F.lit(None).cast("array<string>").alias("c"))

    def several(x: Column, parts: Column) -> Column:
        whole = F.struct(none.alias("v"), (parts if plain else F.transform(parts, undone)).alias("c"))
        return F.when(F.size(parts) == 1, F.array(simple(x))).when(x.startswith(comp), F.array(empty, whole)).otherwise(F.array(whole))

    def one(x: Column) -> Column:
        return F.when(F.contains(x, comp), bound(parted(x, c), lambda parts: several(x, parts))).otherwise(F.array(simple(x)))

    pieces = F.flatten(F.transform(parted(F.substring(rest, F.lit(2), F.length(rest)), e), one))
    return F.when((rest == "") | (rest == element), F.array().cast(f"array<{ELEMENT}>")).otherwise(pieces)


def is_tagged(raw: Column, sep: Separators | Column = DEFAULT) -> Column:
    """Three upper-case letters, then an element separator or nothing."""
    if isinstance(sep, Separators):
        return raw.rlike(f"^[A-Z]{{3}}(?:\\{sep.element}|\\z)")
    e = sep["element"]
    return F.substring(raw, 1, 3).rlike("^[A-Z]{3}$") & ((F.length(raw) == 3) | (F.substring(raw, 4, 1) == e))


def segments(text: Column, sep: Separators | Column = DEFAULT) -> Column:
    """array<struct<idx, tag, el>> of a whole text."""
    return F.transform(raw_segments(text, sep), lambda x, i: F.struct(i.alias("idx"), F.substring(x, 1, 3).alias("tag"), elements_of(x, sep).alias("el")))


def element(seg: Column, n: int) -> Column:
    """The n-th element, from 1; null beyond the end."""
    return F.get(seg["el"], F.lit(n - 1))


def value(seg: Column, n: int, component: int | None = None) -> Column:
    """The text of a simple element, or of a component (from 1) of a composite."""
    e = element(seg, n)
    return e["v"] if component is None else F.get(e["c"], F.lit(component - 1))


def first_segment(segs: Column, tag: str) -> Column:
    return F.get(F.filter(segs, lambda s: s["tag"] == tag), F.lit(0))
