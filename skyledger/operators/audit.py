"""Change log of a table from two of its states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def versions(old: DataFrame, new: DataFrame, key: str, columns: list[str], item_type: str, actor: str | None = None) -> DataFrame:
    """(item_type, item_id, event, whodunnit, object, object_changes): create, update and destroy rows; equal rows log nothing.

    ``object`` is the old row as JSON, ``object_changes`` a JSON object of [old, new] by changed column; both sides hold one
    row per key.
    """
    o = old.select(key, F.struct(*columns).alias("_o"))
    n = new.select(key, F.struct(*columns).alias("_n"))
    j = o.join(n, key, "full").where(~F.col("_o").eqNullSafe(F.col("_n")))
    text = lambda side, c: F.col(side)[c].cast("string")
    changes = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.array(text("_o", c), text("_n", c)).alias("value")) for c in columns]), lambda e: ~e["value"][0].eqNullSafe(e["value"][1]))
    event = F.when(F.col("_o").isNull(), "create").when(F.col("_n").isNull(), "destroy").otherwise("update")
    return j.select(F.lit(item_type).alias("item_type"), F.col(key).alias("item_id"), event.alias("event"), F.lit(actor).cast("string").alias("whodunnit"), F.to_json("_o").alias("object"), F.to_json(F.map_from_entries(changes)).alias("object_changes"), F.transform(changes, lambda e: e["key"]).alias("changed"))


def snapshot_versions(rows: DataFrame, series: str, snapshot: str, key: str, columns: list[str], item_type: str, actor: str | None = None) -> DataFrame:
    """(series, snapshot, and the columns of versions): each snapshot of each series against the one before it in the series.

    ``rows`` hold one row per series, snapshot and key. A series' first snapshot has no predecessor and logs nothing.
    """
    w = W.partitionBy(series).orderBy(snapshot)
    calendar = rows.select(series, snapshot).distinct().select(series, snapshot, F.lead(snapshot).over(w).alias("_next"), F.lag(snapshot).over(w).alias("_before"))
    placed = rows.join(calendar, [series, snapshot])
    at = lambda c: F.struct(F.col(series).alias("series"), F.col(c).alias("snapshot"), F.col(key).alias("key")).alias("_at")
    old = placed.where(F.col("_next").isNotNull()).select(at("_next"), *columns)
    new = placed.where(F.col("_before").isNotNull()).select(at(snapshot), *columns)
    log = versions(old, new, "_at", columns, item_type, actor)
    return log.select(F.col("item_id.series").alias(series), F.col("item_id.snapshot").alias(snapshot), *[F.col("item_id.key").alias("item_id") if c == "item_id" else c for c in log.columns])


def item_history(log: DataFrame, item_type: str, item_id: int) -> DataFrame:
    return log.where((F.col("item_type") == item_type) & (F.col("item_id") == item_id))
