"""Upserts expressed over whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.operators.snapshots import latest_rows


def last_wins(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key (null-safe) the row that a sequence of writes would leave."""
    return latest_rows(batch, keys, order)


def match_key(icao: Column, iata: Column, name: Column) -> Column:
    """What a record is found by: its longer code, else shorter code and name; null where it has neither."""
    return F.when(icao.isNotNull(), F.concat(F.lit("i|"), icao)).when(iata.isNotNull() | name.isNotNull(), F.concat(F.lit("n|"), F.coalesce(iata, F.lit("")), F.lit("|"), F.coalesce(name, F.lit(""))))


def pair_key(icao: Column, iata: Column, name: Column) -> Column:
    """Both codes where there are both, else one code and the name."""
    both = F.concat_ws("|", F.lit("b"), icao, iata)
    return F.when(icao.isNotNull() & iata.isNotNull(), both).when(icao.isNotNull(), F.concat_ws("|", F.lit("i"), icao, name)).when(iata.isNotNull(), F.concat_ws("|", F.lit("a"), iata, name))


def merge(current: DataFrame, batch: DataFrame, key: str, values: list[str], stamp: str, now: Column) -> DataFrame:
    """current with batch laid over it: new and changed rows take ``now`` as ``stamp``, equal ones keep theirs.

    Both sides hold one row per key, of which neither is null; adds column outcome: kept, unchanged, updated or inserted.
    """
    c, b = current.select(key, F.struct(*values).alias("_c"), F.col(stamp).alias("_s")), batch.select(key, F.struct(*values).alias("_b"))
    j = c.join(b, key, "full")
    same = F.col("_c").eqNullSafe(F.col("_b"))
    outcome = F.when(F.col("_b").isNull(), "kept").when(F.col("_c").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    take = F.coalesce("_b", "_c")
    return j.select(key, *[take[v].alias(v) for v in values], F.when(outcome.isin("inserted", "updated"), now).otherwise(F.col("_s")).alias(stamp), outcome.alias("outcome"))


def still_valid(valid_to: Column, as_of: Column) -> Column:
    """Not ended strictly before the day; an open end holds."""
    return valid_to.isNull() | (valid_to >= as_of)


def gated_upsert(current: DataFrame, batch: DataFrame, as_of: str, order: str, values: list[str]) -> DataFrame:
    """Airline versions into their source table.

    ``current``: key, values, valid_to, import_date. ``batch``: key, values, valid_to and ``order``. Into an empty table only
    versions still valid at ``as_of`` go; a known record is updated by versions that hold at its last import, an unknown
    one inserted by versions that hold at ``as_of``; a key with several current rows is left alone.
    """
    day = F.lit(as_of).cast("date")
    n = W.partitionBy("key")
    known = current.withColumn("_n", F.count("*").over(n))
    one = known.where("_n = 1").drop("_n")
    several = known.where("_n > 1").drop("_n")
    empty = current.isEmpty()
    b = batch.where(F.col("key").isNotNull())
    if empty:
        b = b.where(still_valid(F.col("valid_to"), day))
    b = b.join(several.select("key").distinct(), "key", "left_anti")
    b = b.join(one.select("key", F.to_date("import_date").alias("_seen")), "key", "left")
    b = b.where(F.when(F.col("_seen").isNull(), still_valid(F.col("valid_to"), day)).otherwise(still_valid(F.col("valid_to"), F.col("_seen"))))
    last = last_wins(b.select("key", order, "valid_to", *values), ["key"], [order]).drop(order)
    merged = merge(one, last, "key", [*values, "valid_to"], "import_date", F.lit(as_of).cast("timestamp"))
    return merged.unionByName(several.select("key", *values, "valid_to", "import_date", F.lit("kept").alias("outcome")))
