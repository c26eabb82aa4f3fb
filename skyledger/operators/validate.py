"""Row rules: accepted rows, and one violation row per broken rule."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.functions.registrations import valid_registration


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column


def present(c: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", "")) > 0, F.lit(False))


def matches_if_present(c: str, pattern: str) -> Column:
    return ~present(c) | F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def aircraft_rules() -> list[Rule]:
    return [
        Rule("icao", F.coalesce(F.col("icao").rlike(r"\A[0-9a-fA-F]{6}\z"), F.lit(False))), Rule("registration", present("registration") & valid_registration(F.col("registration"))),
        Rule("serial_number", present("serial_number")), Rule("owner", present("owner")), Rule("operator", F.col("operator_id").isNotNull()),
        Rule("registration_date", F.col("registration_date").isNotNull()), Rule("status", F.coalesce(F.col("status").between(0, 5), F.lit(True))),
    ]


def operator_rules() -> list[Rule]:
    return [Rule("name", present("name")), Rule("icao_code", matches_if_present("icao_code", r"\A[A-Z0-9]{3}\z")), Rule("iata_code", matches_if_present("iata_code", r"\A[A-Z0-9]{2}\z"))]


def source_rules() -> list[Rule]:
    """Of an operator as a source states it: also at least one code."""
    return [*operator_rules(), Rule("code", present("icao_code") | present("iata_code"))]


def compiles(pattern: Column) -> Column:
    """Whether a callsign pattern is a regular expression; null and blank ones are."""

    @F.pandas_udf("boolean")
    def ok(patterns: pd.Series) -> pd.Series:
        def one(p) -> bool:
            try:
                re.compile(p or "")
            except re.error:
                return False
            return True

        return patterns.map(one)

    return ok(pattern)


def broken(rules: list[Rule]) -> Column:
    """array<string> of the names of broken rules, in their order."""
    return F.array_compact(F.array(*[F.when(~r.ok, F.lit(r.name)) for r in rules]))


def quarantine(df: DataFrame, rules: list[Rule], mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with column errors). ``mode``: quarantine; off accepts all; fail raises on the first bad row."""
    if mode == "off":
        return df, df.withColumn("errors", F.array().cast("array<string>")).limit(0)
    marked = df.withColumn("errors", broken(rules))
    if mode == "fail":
        bad = F.size("errors") > 0
        marked = marked.withColumn("errors", F.when(bad, F.raise_error(F.concat(F.lit("invalid: "), F.array_join("errors", ", "))).cast("array<string>")).otherwise(F.col("errors")))
        return marked.where(F.size("errors") == 0).drop("errors"), marked.limit(0)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def first_writer(df: DataFrame, code: str, order: list[str], out: str = "accepted") -> DataFrame:
    """Adds whether the row is the first of its code, case aside; rows without a code don't compete, and meet in no window."""
    rn = F.row_number().over(W.partitionBy(F.lower(code)).orderBy(*order))
    competing = df.where(present(code)).withColumn(out, rn == 1)
    return competing.unionByName(df.where(~present(code)).withColumn(out, F.lit(True)))


def without_parent(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id", required: bool = True) -> DataFrame:
    """Rows whose parent is missing; null keys count where the parent is required."""
    c = child if required else child.where(F.col(fk).isNotNull())
    return c.join(parent.select(F.col(pk).cast("long").alias("_pk")), F.col(fk).cast("long") == F.col("_pk"), "left_anti")


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: how many rows lack each of the required columns."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def report(accepted: DataFrame, rejected: DataFrame, importer: str) -> DataFrame:
    """One row: importer_type, records_processed, n_errors, success."""
    a, r = accepted.agg(F.count("*").alias("n")), rejected.agg(F.count("*").alias("e"))
    both = a.select("n", F.lit(0).alias("e")).unionByName(r.select(F.lit(0).alias("n"), "e"))
    return both.agg(F.sum(F.col("n") + F.col("e")).alias("records_processed"), F.sum("e").alias("n_errors")).select(F.lit(importer).alias("importer_type"), "records_processed", "n_errors", F.lit(True).alias("success"))
