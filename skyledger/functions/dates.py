"""Dates written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions.text import strip

#: Shape of the text and the pattern that reads it.
SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "y.M.d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM y"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, y"),
)


def any_date(c: Column) -> Column:
    """Date of a text in any of SHAPES (a time after an ISO date is dropped); null where none fits or no such day exists."""
    t = F.initcap(F.regexp_replace(F.regexp_replace(strip(c), r"[T ]\d{1,2}:\d{2}.*$", ""), r"\s+", " "))
    out = F.lit(None).cast("date")
    for shape, pattern in reversed(SHAPES):
        out = F.when(t.rlike(shape), F.try_to_date(t, pattern)).otherwise(out)
    return out
