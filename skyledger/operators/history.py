"""Validity history of changing attributes, rebuilt chain by chain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.functions.dates import any_date
from skyledger.functions.text import blank_to_null
from skyledger.operators.snapshots import latest_rows


def _beside(df: DataFrame, what: dict[str, F.Column], order: list[str], step: int) -> DataFrame:
    """Adds columns of the preceding (-1) or following (+1) row of the chain.

    A chain is cut at years, so one that holds a third of all rows is still many windows; a summary of one row per chain
    and year carries values over the cuts.
    """
    row = F.struct(*[c.alias(n) for n, c in what.items()])
    inner = W.partitionBy("chain", "_year").orderBy(*order)
    df = df.withColumn("_row", row)
    pick = F.min_by if step > 0 else F.max_by
    edge = df.groupBy("chain", "_year").agg(pick("_row", F.struct(*order)).alias("_edge"))
    beyond = (F.lead if step > 0 else F.lag)("_edge").over(W.partitionBy("chain").orderBy("_year"))
    edge = edge.select("chain", "_year", beyond.alias("_beyond"))
    near = (F.lead if step > 0 else F.lag)("_row").over(inner)
    out = df.withColumn("_near", near).join(edge, ["chain", "_year"]).withColumn("_near", F.coalesce("_near", "_beyond"))
    return out.select(*[c for c in df.columns if c != "_row"], *[F.col("_near")[n].alias(n) for n in what])


def build_chains(versions: DataFrame, values: list[str]) -> DataFrame:
    """(chain, valid_from, valid_to, *values): periods of every chain, both ends inclusive, null where unknown or open.

    ``versions``: chain, version, pk, start, end (dates), values. An end before its start means that the two were
    exchanged; a version ends at the latest on the day before the next one starts; a version left without a day is
    dropped; versions that follow without a gap with equal values (null-safe) form one period.
    """
    swap = F.col("end") < F.col("start")
    v = versions.select(
        "chain", F.coalesce(F.col("version"), F.lit(0)).alias("_ver"), "pk", *values,
        F.when(swap, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(swap, F.col("start")).otherwise(F.col("end")).alias("end"),
    ).withColumn("_ord", F.coalesce("start", F.lit("0001-01-01").cast("date"))).withColumn("_year", F.year("_ord"))
    order = ["_ord", "_ver", "pk"]
    v = _beside(v, {"_next": F.col("start")}, order, +1)
    v = v.withColumn("end", F.least(F.col("end"), F.date_sub("_next", 1))).drop("_next")
    v = v.where(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") <= F.col("end")))
    same = F.struct(*values)
    v = _beside(v, {"_pend": F.col("end"), "_pval": same}, order, -1)
    v = v.withColumn("_new", F.when(F.coalesce((F.date_add("_pend", 1) == F.col("start")) & F.col("_pval").eqNullSafe(same), F.lit(False)), 0).otherwise(1))
    # Running number of the period within the chain: inside a year, plus what earlier years began.
    years = v.groupBy("chain", "_year").agg(F.sum("_new").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("chain").orderBy("_year").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("_run", F.sum("_new").over(W.partitionBy("chain", "_year").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    v = v.join(years.select("chain", "_year", before.alias("_before")), ["chain", "_year"])
    last = F.struct("_ord", "_ver", "pk")
    return (
        v.groupBy("chain", (F.col("_run") + F.col("_before")).alias("_period"))
        .agg(F.min_by(F.struct("start"), last).alias("_a"), F.max_by(F.struct("end", *values), last).alias("_z"))
        .select("chain", F.col("_a.start").alias("valid_from"), F.col("_z.end").alias("valid_to"), *[F.col("_z")[c].alias(c) for c in values])
    )


#: Attributes whose change begins a new period.
AIRLINE_VALUES = ["name", "3char_code", "2char_code"]


def airline_versions(lines: DataFrame) -> DataFrame:
    """One row per pk: the line delivered last (then of the largest line_id). Lines that are no airlines or name none are left out."""
    kept = lines.where(F.col("pk").startswith("air-") & F.col("key").isNotNull())
    cols = ["key", "version", "validity_from", "validity_to", *AIRLINE_VALUES]
    last = latest_rows(kept.select("pk", "delivered_at", "line_id", *cols), ["pk"], ["delivered_at", "line_id"])
    return last.select(
        F.col("key").alias("chain"), F.trim("version").try_cast("int").alias("version"), "pk", any_date(F.col("validity_from")).alias("start"), any_date(F.col("validity_to")).alias("end"),
        *[blank_to_null(F.col(c)).alias(c) for c in AIRLINE_VALUES],
    )


def airline_history(lines: DataFrame) -> DataFrame:
    """Periods of every airline."""
    return build_chains(airline_versions(lines), AIRLINE_VALUES)


def replace_chains(history: DataFrame, touched: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``history`` with every touched chain replaced as a whole by its rebuilt form."""
    return history.join(touched, "chain", "left_anti").unionByName(rebuilt)


def apply_updates(history: DataFrame, raw: DataFrame, updates: DataFrame, build=airline_history, key: str = "key", is_entity=None) -> DataFrame:
    """Late or corrected ``updates``: only touched entities' raw changes are read again, all their periods are rebuilt.

    ``raw`` are the earlier changes, ``history`` their history. Chains that no update touches are passed through.
    """
    touched = updates.where(is_entity if is_entity is not None else F.lit(True)).select(F.col(key).alias("chain")).where(F.col("chain").isNotNull()).distinct()
    changes = raw.unionByName(updates).join(touched.withColumnRenamed("chain", key), key, "left_semi")
    return replace_chains(history, touched, build(changes))


def delivered_history(lines: DataFrame) -> DataFrame:
    """History of all deliveries, the last of them applied to the earlier ones' history as an update."""
    day = lines.agg(F.max(F.to_date("delivered_at")).alias("d")).head()["d"]
    if day is None:
        return airline_history(lines)
    late = F.coalesce(F.to_date("delivered_at") >= F.lit(day), F.lit(False))
    raw, updates = lines.where(~late), lines.where(late)
    return apply_updates(airline_history(raw), raw, updates, is_entity=F.col("pk").startswith("air-"))


def publish(history: DataFrame, folder: str) -> str:
    """Writes the history as a new version under ``folder`` and then makes it the current one, by renaming a pointer file.

    Readers see the old chains or the new ones, never some of each; a writer that is lost before the rename changes nothing.
    Returns the version's path.
    """
    jvm = history.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(history.sparkSession._jsc.hadoopConfiguration())
    version = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    history.write.parquet(version)
    pointer, fresh = path(f"{folder}/CURRENT"), path(f"{version}.pointer")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), history.sparkSession._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = history.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), options)
    return version


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The history that was published last."""
    return spark.read.parquet(spark.read.text(f"{folder.rstrip('/')}/CURRENT").head()[0])
