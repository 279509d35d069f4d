"""Value transforms as Column expressions. Each takes and gives a Value: text, and an error that is null where none.

A failed value is an error, not an exception: the first error of a message decides what happens to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewire.functions.text import double_text

NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
DATES = {"YYYYMMDD": (r"^(.{4})(.{2})(.{2})$", (1, 2, 3)), "YYYY-MM-DD": (r"^([^-]*)-([^-]*)-([^-]*)$", (1, 2, 3)), "DDMMYYYY": (r"^(.{2})(.{2})(.{4})$", (3, 2, 1))}


@dataclass(frozen=True)
class Value:
    """kind: string, double or long; the column has that type. error is a string column or None if nothing can fail."""

    column: Column
    kind: str = "string"
    error: Column | None = None

    @property
    def text(self) -> Column:
        return self.column if self.kind == "string" else double_text(self.column) if self.kind == "double" else self.column.cast("string")

    def with_error(self, error: Column | None) -> Column | None:
        return error if self.error is None else self.error if error is None else F.coalesce(self.error, error)


def number(v: Value, what: str) -> Value:
    """As a double; text that is no number is an error, null stays null."""
    if v.kind != "string":
        return Value(v.column.cast("double"), "double", v.error)
    ok = v.column.rlike(NUMBER)
    error = F.when(v.column.isNotNull() & ~ok, F.concat(F.lit(f"{what}: not a number: '"), v.column, F.lit("'")))
    return Value(F.when(ok, v.column.try_cast("double")), "double", v.with_error(error))


def date_format(v: Value, source: str, target: str) -> Value:
    """Rearranges digits; there is no calendar check."""
    if source not in DATES or target not in (*DATES, "ISO8601"):
        bad = F.when(v.text.isNotNull(), F.lit(f"unsupported date format: {source} to {target}"))
        return Value(F.lit(None).cast("string"), "string", v.with_error(bad))
    pattern, order = DATES[source]
    parts = [F.regexp_extract(v.text, pattern, g) for g in order]
    ok = v.text.rlike(pattern) & parts[0].rlike(r"^[+-]?\d+$") & parts[1].rlike(r"^\+?\d+$") & parts[2].rlike(r"^\+?\d+$")
    y, m, d = (F.format_string(f"%0{w}d", F.when(ok, p.try_cast("int"))) for p, w in zip(parts, (4, 2, 2), strict=True))
    out = F.concat(d, m, y) if target == "DDMMYYYY" else F.concat(y, m, d) if target == "YYYYMMDD" else F.concat_ws("-", y, m, d)
    error = F.when(v.text.isNotNull() & ~ok, F.concat(F.lit(f"not a {source} date: '"), v.text, F.lit("'")))
    return Value(F.when(ok, out), "string", v.with_error(error))


def number_format(v: Value, decimals: int, sep: str | None = None) -> Value:
    """Fixed decimals of the exact binary value; with a separator, groups of three and no trailing zeros."""
    n = number(v, "number_format")
    plain = F.format_number(n.column, decimals)
    if sep is None:
        return Value(F.replace(plain, F.lit(","), F.lit("")), "string", n.error)
    whole, fraction = F.substring_index(plain, ".", 1), F.rtrim(F.when(plain.contains("."), F.element_at(F.split(plain, r"\."), -1)).otherwise(""), F.lit("0"))
    out = F.concat(F.replace(whole, F.lit(","), F.lit(sep)), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    return Value(out, "string", n.error)


def split_at(v: Value, delimiter: str, index: int) -> Value:
    parts = F.split(v.text, re.escape(delimiter) if delimiter else "", -1)
    error = F.when(F.size(parts) <= index, F.concat(F.lit(f"split index {index} out of bounds ("), F.size(parts).cast("string"), F.lit(" parts)")))
    return Value(F.get(parts, F.lit(index)), "string", v.with_error(F.when(v.text.isNotNull(), error)))


def default(v: Value, value: str) -> Value:
    return Value(F.when(v.text.isNull() | (v.text == ""), F.lit(value)).otherwise(v.text), "string", v.error)


def trimmed(v: Value) -> Value:
    return Value(F.regexp_replace(v.text, r"(?U)^\s+|\s+$", ""), "string", v.error)


def piped(v: Value, c: dict) -> Column:
    """The condition of a conditional transform tests the piped value, whatever field it names."""
    op, null = c["op"], F.lit(False)
    if op == "exists":
        return v.column.isNotNull()
    if op == "equals":
        return F.coalesce(v.text == c["value"], null)
    if op in ("contains", "matches") and v.kind != "string":
        return null
    if op == "contains":
        return F.coalesce(v.column.contains(c["value"]), null)
    if op == "matches":
        p = c["pattern"]
        if p in ("^ORD[0-9]+$", "^[0-9]+$"):
            return F.coalesce(v.column.rlike(f"^{'ORD' if 'ORD' in p else ''}[0-9]*$"), null)
        return F.coalesce(v.column.contains(p.lstrip("^").rstrip("$")), null)
    if op == "not":
        return ~piped(v, c["condition"])
    found = [piped(v, x) for x in c["conditions"]]
    out = F.lit(op == "and")
    for x in found:
        out = out & x if op == "and" else out | x
    return out


def apply(v: Value, t: dict, extensions=None) -> Value:
    op = t["op"]
    if op == "uppercase":
        return Value(F.upper(v.text), "string", v.error)
    if op == "lowercase":
        return Value(F.lower(v.text), "string", v.error)
    if op == "trim":
        return trimmed(v)
    if op == "date_format":
        return date_format(v, t["from"], t["to"])
    if op == "number_format":
        return number_format(v, int(t["decimals"]), t.get("thousands_sep"))
    if op == "concatenate":
        parts = [x["value"] if x.get("type") == "literal" else f"[{x['path']}]" for x in t["values"]]
        return Value(F.lit((t.get("separator") or "").join(parts)), "string", v.error)
    if op == "split":
        return split_at(v, t["delimiter"], int(t["index"]))
    if op == "default":
        return default(v, t["value"])
    if op == "chain":
        for x in t["transforms"]:
            v = apply(v, x, extensions)
        return v
    if op == "extension":
        return extensions.call(t["name"], t["function"], [v, *[Value(F.lit(x)) for x in t.get("args", [])]])
    met = piped(v, t["when"])
    yes = apply(v, t["then"], extensions)
    no = apply(v, t["else_transform"], extensions) if t.get("else_transform") else v
    same = yes.kind == no.kind
    null = F.lit(None).cast("string")
    error = None if yes.error is None and no.error is None else F.when(met, null if yes.error is None else yes.error).otherwise(null if no.error is None else no.error)
    return Value(F.when(met, yes.column if same else yes.text).otherwise(no.column if same else no.text), yes.kind if same else "string", error)
