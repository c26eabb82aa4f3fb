"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.functions.jsonx import canonical

#: Calendars of at most so many snapshots are broadcast; longer ones are joined by a shuffle that AQE splits where skewed.
BROADCAST_SNAPSHOTS = 50_000
#: The cell that only says that the record is there.
PRESENCE = ""


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row with the largest ``order`` tuple, by partial aggregation, so that no key is gathered."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def cells(data: Column) -> Column:
    """array<struct<field, value>> of a map's non-empty members in canonical notation, with the presence marker."""
    entries = F.filter(F.transform(F.map_entries(F.coalesce(data, F.expr("map()").cast("map<string,string>"))), lambda e: F.named_struct(F.lit("field"), F.trim(e["key"]), F.lit("value"), canonical(e["value"]))), lambda e: e["value"].isNotNull())
    return F.concat(F.array(F.named_struct(F.lit("field"), F.lit(PRESENCE), F.lit("value"), F.lit(PRESENCE))), entries)


def snapshot_changes(rows: DataFrame, series: list[str], snapshot: str, record: str, data: str, calendar: DataFrame | None = None) -> DataFrame:
    """(*series, snapshot, record, change_kind, changed_fields) of every record that differs from the preceding snapshot.

    ``rows`` hold one row per series, snapshot and record, ``data`` a map<string,string>. Each cell of a record enters its
    own snapshot with +1 and the next one of its series with -1; what doesn't cancel out has changed. Records whose cells
    are all the same cancel out as a whole, before they are unpivoted. ``calendar`` lists the snapshots (series, snapshot)
    where that is cheaper than to read them from ``rows``. A series' first snapshot has no predecessor and yields nothing;
    rows with a null snapshot or record are left out; a null map is a record without members; members that are null or
    blank are absent ones.
    """
    base = rows.where(F.col(snapshot).isNotNull() & F.col(record).isNotNull()).select(*series, snapshot, record, data)
    w = W.partitionBy(*series).orderBy(snapshot)
    listed = (base if calendar is None else calendar.where(F.col(snapshot).isNotNull())).select(*series, snapshot).distinct()
    dates = listed.select(*series, snapshot, F.lead(snapshot).over(w).alias("_next"), F.lag(snapshot).over(w).isNull().alias("_first"))
    if listed.count() <= BROADCAST_SNAPSHOTS:
        dates = F.broadcast(dates)
    signed = F.filter(
        F.array(
            F.struct(F.when(~F.col("_first"), F.col(snapshot)).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")),
        ),
        lambda s: s["at"].isNotNull(),
    )
    key = [*series, snapshot, record]
    side = lambda sign: F.first(F.when(F.col("_sign") == sign, F.col("_c")), ignorenulls=True)
    met = (
        base.join(dates, [*series, snapshot])
        .select(*series, record, F.array_sort(cells(F.col(data))).alias("_c"), signed.alias("_at"))
        .select(*series, record, "_c", F.explode("_at").alias("_s"))
        .select(*series, F.col("_s.at").alias(snapshot), record, F.col("_s.sign").alias("_sign"), "_c")
        .repartition(*key)  # the one shuffle: all sums below find their groups in place
        .groupBy(*key).agg(side(1).alias("_now"), side(-1).alias("_then"))
        .where(~F.col("_now").eqNullSafe(F.col("_then")))
    )
    none = F.array().cast("array<struct<field:string,value:string>>")
    sign = lambda c, n: F.transform(F.coalesce(c, none), lambda e: F.named_struct(F.lit("field"), e["field"], F.lit("value"), e["value"], F.lit("sign"), F.lit(n)))
    unpivoted = met.select(*key, F.inline(F.concat(sign(F.col("_now"), 1), sign(F.col("_then"), -1))))
    summed = unpivoted.groupBy(*key, "field", "value").agg(F.sum("sign").alias("n")).where(F.col("n") != 0)
    marker = F.max(F.when(F.col("field") == PRESENCE, F.col("n")))
    return (
        summed.groupBy(*key)
        .agg(marker.alias("_m"), F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("_f"))
        .select(*key, F.when(F.col("_m") > 0, "added").when(F.col("_m") < 0, "removed").otherwise("changed").alias("change_kind"), F.when(F.col("_m").isNull(), F.col("_f")).otherwise(F.array().cast("array<string>")).alias("changed_fields"))
    )
