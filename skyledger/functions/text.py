"""Small text helpers shared by operators; every function maps Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regular-expression class body.
BLANKS = r"\s\x{85}\x{A0}\p{Z}\x{FEFF}"

#: Texts that stand for "no value", in lower case.
FILLERS = (
    "", "-", "--", "---", ".", "?", "??", "???", "#n/a", "#ref!", "#value!", "(none)", "(various)", "n.a.", "n.a", "n/a",
    "na", "n/k", "nil", "no data", "none", "not available", "not known", "not provided", "null", "owner withheld",
    "pending", "private owner", "see remarks", "tba", "tbc", "tbd", "undefined", "unknown", "unspecified", "various",
    "withheld", "xx", "xxx", "xxxx",
)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def is_filler(c: Column) -> Column:
    """True for null, blank and filler texts."""
    return F.coalesce(F.lower(strip(c)).isin(*FILLERS), F.lit(True))


def usable(c: Column) -> Column:
    """The trimmed text, null where it is missing, blank or filler."""
    return F.when(~is_filler(c), strip(c))
