"""JSON objects in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions.text import strip


def unwrap(c: Column, depth: int = 2) -> Column:
    """The object's own text where it was encoded as a JSON string, up to ``depth`` times."""
    for _ in range(depth):
        inner = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>").getItem(0)
        c = F.when(c.rlike(r'^\s*"'), inner).otherwise(c)
    return c


def members(c: Column) -> Column:
    """map<string,string> of an object's members; nested values as compact JSON; null for anything but an object."""
    return F.from_json(unwrap(c), "map<string,string>")


def canonical(v: Column) -> Column:
    """One text for every notation of a member's value: trimmed; numbers alike as number or text; blank, null and [] null."""
    t = strip(v)
    items = F.from_json(t, "array<string>")
    listed = F.to_json(F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != "")))
    number = t.try_cast("decimal(38,10)")
    plain = F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.coalesce(number.cast("string"), t)).otherwise(t)
    out = F.when(t.startswith("["), F.coalesce(listed, t)).otherwise(plain)
    return F.when((out != "") & (out != "[]"), out)
