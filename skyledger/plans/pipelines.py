"""Import pipelines put together from the operators; every one takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import registrations, scalars
from skyledger.functions.dates import any_date
from skyledger.operators import fieldmap, groups, resolve, upsert, validate
from skyledger.sources.text import labelled_pairs, table_rows

_VERSION = ["icao_code", "iata_code", "name", "validity_from", "validity_to", "alt_name", "num_code", "wikipedia_link", "alt_names"]
_AIRLINE = ["name", "icao_code", "iata_code", "positioning_callsign_pattern", "charter_callsign_pattern"]


def empty_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, " + ", ".join(f"{c} array<string>" if c == "alt_names" else f"{c} string" for c in _VERSION) + ", valid_to date, import_date timestamp")


def _mapped_versions(lines: DataFrame) -> DataFrame:
    rows = fieldmap.project(lines.withColumn("row_no", F.monotonically_increasing_id()).where(F.col("pk").startswith("air-")), fieldmap.AIRLINES_B, keep=["row_no"])
    icao, iata = scalars.null_if_blank(F.col("icao_code")), scalars.null_if_blank(F.col("iata_code"))
    return rows.withColumns({"key": upsert.pair_key(icao, iata, F.col("name")), "valid_to": any_date(F.col("validity_to"))})


def import_airline_versions(current: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    """Airline versions of one delivery into their source table; rows that name no code, or no airline, are left out."""
    return upsert.gated_upsert(current, _mapped_versions(lines), as_of, "row_no", _VERSION)


def checked_airline_versions(current: DataFrame, lines: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, rejected rows with errors, report): the same import, where rows that break a rule are collected instead."""
    ok, bad = validate.quarantine(_mapped_versions(lines), validate.source_rules())
    return upsert.gated_upsert(current, ok, as_of, "row_no", _VERSION), bad, validate.report(ok, bad, "OpenTravel")


def import_airlines(current: DataFrame | None, batch: DataFrame, as_of: str) -> DataFrame:
    """Airlines found by longer code, else by shorter code and name, with their callsign patterns; the last row of a key
    holds; equal rows keep their date."""
    batch = batch.select("*", *[F.lit(None).cast("string").alias(c) for c in _AIRLINE if c not in batch.columns])
    keyed = batch.withColumn("key", upsert.match_key(F.col("icao_code"), F.col("iata_code"), F.col("name"))).where(F.col("key").isNotNull())
    last = upsert.last_wins(keyed.select("key", "row_no", *_AIRLINE), ["key"], ["row_no"]).drop("row_no")
    if current is None:
        current = last.limit(0).withColumn("import_date", F.lit(None).cast("timestamp"))
    return upsert.merge(current, last, "key", _AIRLINE, "import_date", F.lit(as_of).cast("timestamp"))


def import_makers(rows: DataFrame, as_of: str) -> DataFrame:
    """Makers of a delimited file that have a code and a name, one per code, the last one."""
    mapped = fieldmap.project(rows, fieldmap.MAKERS_A, keep=["row_no"])
    full = mapped.select("row_no", scalars.null_if_blank(F.col("icao_code")).alias("icao_code"), scalars.null_if_blank(F.col("name")).alias("name")).where(F.col("icao_code").isNotNull() & F.col("name").isNotNull())
    return upsert.last_wins(full, ["icao_code"], ["row_no"]).drop("row_no").withColumn("import_date", F.lit(as_of).cast("date"))


_COUNTRY = ["iso_3char_code", "iso_num_code", "name", "capital"]


def combine_countries(sources: DataFrame, countries: DataFrame, as_of: str) -> DataFrame:
    """Countries by two-letter code with the source's values laid over them."""
    key = F.col("iso_2char_code")
    stamped = countries.where(key.isNotNull()).select("iso_2char_code", *_COUNTRY, "updated_at")
    return upsert.merge(stamped, sources.where(key.isNotNull()).select("iso_2char_code", *_COUNTRY), "iso_2char_code", _COUNTRY, "updated_at", F.lit(as_of).cast("timestamp"))


def makers_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """(icao_code, name, country, alt_names) of a page's table: a blank code carries on, a row without a name is skipped first."""
    rows = pages.select(F.posexplode(table_rows(F.col(html))).alias("pos", "r")).where(F.size("r") >= 2)
    cells = rows.select("pos", F.col("r")[0].alias("code"), F.col("r")[1].alias("full")).where(validate.present("full"))
    carried = groups.carry_down(cells, None, "pos", "code", "icao_code").where(F.col("icao_code").isNotNull())
    g = groups.collect_in_order(carried, "icao_code", "pos", "full", "names")
    first, rest = groups.first_and_rest(F.col("names"))
    return g.select("icao_code", scalars.without_brackets(first).alias("name"), scalars.country_in_brackets(first).alias("country"), F.transform(rest, scalars.without_brackets).alias("alt_names"))


def combine_makers(sources: DataFrame, makers: DataFrame, countries: DataFrame) -> DataFrame:
    """Makers by code with names from the source; the country through the cascade, kept where nothing is found."""
    found = resolve.country_cascade(sources, "icao_code", "country", countries)
    s = sources.join(found.select("icao_code", F.col("country_id").alias("_found")), "icao_code", "left")
    m = makers.select("icao_code", F.struct("name", "alt_names").alias("_old"), F.col("country_id").alias("_kept"))
    j = m.join(s, "icao_code", "full")
    return j.select("icao_code", F.coalesce("name", "_old.name").alias("name"), F.coalesce("alt_names", "_old.alt_names").alias("alt_names"), F.coalesce("_found", "_kept").alias("country_id"))


def import_countries(rows: DataFrame) -> DataFrame:
    """Country rows with name and both letter codes, one per two-letter code, the last one."""
    mapped = fieldmap.project(rows, fieldmap.COUNTRIES, keep=["row_no"])
    full = mapped.where(validate.present("name") & validate.present("iso_2char_code") & validate.present("iso_3char_code"))
    return upsert.last_wins(full, ["iso_2char_code"], ["row_no"]).drop("row_no")


def _register(mapped: DataFrame, types: DataFrame, operators: DataFrame, country_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    mapped = mapped.withColumns({"icao": registrations.registration_to_hex(F.col("registration")), "registration_country_id": F.lit(country_id).cast("long")})
    t = types.groupBy("type_code").agg(F.min("id").alias("aircraft_type_id"))
    o = operators.groupBy(F.col("name").alias("operator_name")).agg(F.min("id").alias("operator_id"))
    known = mapped.join(t, "type_code", "left").join(o, "operator_name", "left").withColumn("status", F.lit(0))
    missing = known.where(F.col("aircraft_type_id").isNull() & F.col("type_code").isNotNull()).groupBy("type_code").agg(F.count("*").alias("n"))
    last = upsert.last_wins(known, ["registration", "serial_number", "aircraft_type_id"], ["row_no"]).drop("row_no")
    ok, bad = validate.quarantine(last, validate.aircraft_rules())
    return ok, bad, missing


def import_register(rows: DataFrame, types: DataFrame, operators: DataFrame, country_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, missing types) of register rows: mapped, with type and operator looked up, one per registration,
    serial number and type. A row of an unknown type goes on without it."""
    mapped = fieldmap.project(rows, fieldmap.REGISTER_CSV, keep=["mark", "row_no"])
    return _register(mapped.withColumn("registration", scalars.with_prefix(F.col("mark"), "VH-")).drop("mark"), types, operators, country_id)


def import_register_pages(pages: DataFrame, types: DataFrame, operators: DataFrame, country_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of a list of registrations (registration with or without prefix, html): each one's page is read pair by pair."""
    listed = pages.select(scalars.with_prefix(F.col("registration"), "VH-").alias("registration"), "html")
    pairs = labelled_pairs(listed, "registration", "html", ("field",), children=True)
    return _register(fieldmap.pairs_to_record(pairs, "registration", fieldmap.REGISTER_PAGE_A).withColumn("row_no", F.lit(0)), types, operators, country_id)
