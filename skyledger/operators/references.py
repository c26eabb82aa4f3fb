"""References to records that do not exist, or were created only later."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all references is heavy, so there are never more than 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 64


#: Broken keys are broadcast up to this number, which is counted first; more of them meet the references by a split join.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Reference:
    """``child_field`` of ``child_table`` names ``parent_key`` of the parent table."""

    child_table: str
    child_field: str
    parent_table: str
    child_key: str = "id"
    parent_key: str = "id"
    created: str = "created_at"


def _refs(child: DataFrame, ref: Reference) -> DataFrame:
    return child.select(
        F.col(ref.child_key).alias("child_id"), F.col(ref.child_field).cast("long").alias("_key"), F.col(ref.created).alias("_at")
    ).where(F.col("_key").isNotNull())


def _period(at) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(""))


def _heavy_keys(per_key: DataFrame, share: float) -> list[int]:
    """At most 1 / share keys, whatever the size of the data."""
    total = per_key.agg(F.sum("n").alias("n")).head()["n"] or 0
    return [r["_key"] for r in per_key.groupBy("_key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1.0, total * share)).collect()] if total else []


def _parents(parent: DataFrame, ref: Reference) -> DataFrame:
    return parent.where(F.col(ref.parent_key).isNotNull()).groupBy(F.col(ref.parent_key).cast("long").alias("_key")).agg(F.min(ref.created).alias("_born"))


def _split_join(left: DataFrame, right: DataFrame, heavy: list[int], how: str) -> DataFrame:
    """Heavy keys meet their few rows of the right side by broadcast; all other keys, none of them large, by a shuffle on
    the key. ``right`` has one row per key."""
    if not heavy:
        return left.join(right, "_key", how)
    of = lambda df: df.where(F.col("_key").isin(heavy))
    light = left.where(~F.col("_key").isin(heavy)).join(right.where(~F.col("_key").isin(heavy)), "_key", how)
    return light.unionByName(of(left).join(F.broadcast(of(right)), "_key", how))  # at most 1 / HEAVY_SHARE rows


def _broken_keys(groups: DataFrame, parents: DataFrame, heavy: list[int]) -> DataFrame:
    """(_key, _born, state) of keys that some reference names in vain: whose parent is missing, by an anti-join of the
    pre-aggregated keys, or was created after the key's first reference."""
    keys = groups.groupBy("_key").agg(F.min("first").alias("first"))
    missing = _split_join(keys, parents, heavy, "left_anti").select("_key", F.lit(None).cast("timestamp").alias("_born"), F.lit("missing").alias("state"))
    late = _split_join(keys, parents, heavy, "inner").where(F.col("_born") > F.col("first")).select("_key", F.col("_born").cast("timestamp").alias("_born"), F.lit("late").alias("state"))
    return missing.unionByName(late)


def _of_broken_keys(rows: DataFrame, broken: DataFrame, heavy: list[int]) -> DataFrame:
    if broken.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(broken), "_key")
    return _split_join(rows, broken, heavy, "inner")


def _pre_aggregated(child: DataFrame, parent: DataFrame, ref: Reference, heavy_share: float) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """References, their groups by key and period, the broken keys and the heavy ones."""
    refs = _refs(child, ref).withColumn("period", _period(F.col("_at")))
    groups = refs.groupBy("_key", "period").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    heavy = _heavy_keys(groups, heavy_share)
    return refs, groups, _broken_keys(groups, _parents(parent, ref), heavy).persist(), heavy


def broken_references(child: DataFrame, parent: DataFrame, ref: Reference, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row (child_table, child_field, child_id, state, period) per broken reference.

    References are pre-aggregated by key and period, the keys checked, and only references of broken keys looked up again.
    Null references are none; a parent that is there more than once counts from its first creation; where either time is
    null nothing is late; period is '' where the child's time is null. Empty tables: no child, no rows; no parent, all missing.
    """
    refs, _, broken, heavy = _pre_aggregated(child, parent, ref, heavy_share)
    found = _of_broken_keys(refs, broken, heavy).where((F.col("state") == "missing") | (F.col("_born") > F.col("_at")))
    return found.select(F.lit(ref.child_table).alias("child_table"), F.lit(ref.child_field).alias("child_field"), "child_id", "state", "period")


def orphan_report(child: DataFrame, parent: DataFrame, ref: Reference, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """References, missing and late ones per period, from references pre-aggregated by key and period.

    A (key, period) group whose parent was created in another month is late as a whole or not at all; only groups of the
    parent's own month are looked at reference by reference.
    """
    refs, groups, broken, heavy = _pre_aggregated(child, parent, ref, heavy_share)
    month = _period(F.col("_born"))
    whole = _of_broken_keys(groups, broken, heavy).select(
        "period", F.lit(0).alias("n_references"), F.when(F.col("state") == "missing", F.col("n")).otherwise(0).alias("n_missing"),
        F.when((F.col("state") == "late") & (month > F.col("period")) & (F.col("period") != ""), F.col("n")).otherwise(0).alias("n_late"),
    )
    own = _of_broken_keys(refs, broken.where(F.col("state") == "late"), heavy).where((month == F.col("period")) & (F.col("_born") > F.col("_at")))
    within = own.groupBy("period").agg(F.count("*").alias("n_late")).select("period", F.lit(0).alias("n_references"), F.lit(0).alias("n_missing"), "n_late")
    all_ = groups.select("period", F.col("n").alias("n_references"), F.lit(0).alias("n_missing"), F.lit(0).alias("n_late"))
    total = all_.unionByName(whole).unionByName(within).groupBy("period").agg(*[F.sum(c).alias(c) for c in ("n_references", "n_missing", "n_late")])
    return total.select(F.lit(ref.child_table).alias("child_table"), F.lit(ref.child_field).alias("child_field"), "period", "n_references", "n_missing", "n_late")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
