"""Declarative field mappings, compiled to one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import rules
from skyledger.functions.scalars import alt_names, first_address_line, label_key, last_word_of_last_line, leading_int, null_if_blank, strip_ascii
from skyledger.functions.dates import any_date


@dataclass(frozen=True)
class Field:
    """Source column, target column (the source's name if None) and what is applied to the value."""

    source: str
    target: str | None = None
    function: Callable[[Column], Column] | None = None


def project(df: DataFrame, fields: list[Field], keep: list[str] = (), data: str | None = None) -> DataFrame:
    """Mapped columns only (and ``keep``); absent source columns are null; ``data`` gets all mapped values as one JSON object."""
    cols = []
    for f in fields:
        value = F.col(f"`{f.source}`") if f.source in df.columns else F.lit(None).cast("string")
        cols.append((f.function(value) if f.function else value).alias(f.target or f.source))
    out = df.select(*[F.col(k) for k in keep], *cols)
    if data:
        out = out.withColumn(data, F.to_json(F.struct(*[(f.target or f.source) for f in fields])))
    return out


def pairs_to_record(pairs: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """One row per ``key`` of (key, pos, label, value): labels lose their colon, unmapped ones are dropped, later ones win."""
    label = label_key(F.col("label"))
    by_target = {f.source: f for f in fields}
    last = [
        F.max_by(F.when(label == s, strip_ascii(F.col("value"))), F.when((label == s) & F.col("value").isNotNull(), F.col("pos"))).alias(f"_{i}")
        for i, s in enumerate(by_target)
    ]
    wide = pairs.groupBy(key).agg(*last)
    return wide.select(key, *[(f.function(F.col(f"_{i}")) if f.function else F.col(f"_{i}")).alias(f.target or f.source) for i, f in enumerate(by_target.values())])


AIRLINES_A = [
    Field("Name", "name", lambda c: rules.fold(c, rules.OPERATOR_NAMES)), Field("ICAO", "icao_code", null_if_blank), Field("IATA", "iata_code", strip_ascii),
    Field("PositioningFlightPattern", "positioning_callsign_pattern", null_if_blank), Field("CharterFlightPattern", "charter_callsign_pattern", null_if_blank),
]
AIRLINES_B = [
    Field("3char_code", "icao_code", strip_ascii), Field("2char_code", "iata_code", strip_ascii), Field("num_code", None, strip_ascii), Field("validity_from", None, strip_ascii), Field("validity_to", None, strip_ascii),
    Field("name", None, strip_ascii), Field("name2", "alt_name", strip_ascii), Field("wiki_link", "wikipedia_link", strip_ascii), Field("alt_names", None, alt_names),
]
COUNTRIES = [Field("iso_2char_code"), Field("iso_3char_code"), Field("iso_num_code"), Field("name"), Field("cptl", "capital")]
MAKERS_A = [Field("Code", "icao_code"), Field("Name", "name")]
MAKERS_B = [Field("Code", "icao_code"), Field("Name", "name"), Field("Country", "country")]
REGISTER_CSV = [
    Field("model", None, lambda c: rules.fold(c, rules.MODEL_FAMILY)), Field("icaotypedesig", "type_code", strip_ascii), Field("datefirstreg", "registration_date", any_date), Field("serial", "serial_number", strip_ascii),
    Field("regholdname", "owner", strip_ascii), Field("regopname", "operator_name", lambda c: rules.fold(c, rules.OPERATORS)), Field("engnum", "engine_count", leading_int), Field("engmodel", "engine_model", strip_ascii),
]
REGISTER_PAGE_A = [
    Field("Aircraft model", "model", lambda c: rules.fold(c, rules.MODEL_FAMILY)), Field("ICAO type designator", "type_code"), Field("Date first registered", "registration_date", any_date), Field("Serial", "serial_number"),
    Field("Registration holder", "owner"), Field("Registered operator", "operator_name", lambda c: rules.fold(c, rules.OPERATORS)), Field("Number of engines", "engine_count", leading_int), Field("Engine model", "engine_model"),
]
REGISTER_PAGE_B = [
    Field("Reg Mark", "registration"), Field("Man. Model", "model"), Field("Name and Address", "operator_name", first_address_line), Field("SerialNo", "serial_number"), Field("Mode S Code Country/Aircraft", "icao", last_word_of_last_line),
]
