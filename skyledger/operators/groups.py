"""Ordered groups: collected lists and carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def collect_in_order(df: DataFrame, key: str, order: str, value: str, out: str = "values") -> DataFrame:
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(out))


def first_and_rest(values: Column) -> tuple[Column, Column]:
    return F.try_element_at(values, F.lit(1)), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def carry_down(df: DataFrame, key: str | None, order: str, value: str, out: str) -> DataFrame:
    """The last value that isn't blank, within ``key`` if given.

    Without a key the whole table is one run: it is cut into ranges of ``order``, each carried by itself, and the last value
    of earlier ranges, one row a range, fills each range's beginning.
    """
    filled = F.nullif(F.trim(value), F.lit(""))
    if key is not None:
        w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.last(filled, ignorenulls=True).over(w))
    cut = df.withColumn("_range", F.floor(F.col(order) / RANGE))
    inner = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn("_in", F.last(filled, ignorenulls=True).over(inner))
    ends = cut.groupBy("_range").agg(F.max_by("_in", order).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    return cut.join(ends.select("_range", before.alias("_before")), "_range").withColumn(out, F.coalesce("_in", "_before")).drop("_range", "_in", "_before")


#: Length of a range of carry_down.
RANGE = 100_000
