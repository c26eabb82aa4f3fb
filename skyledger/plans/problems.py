"""Queries of the general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.jsonx import members
from skyledger.functions.text import strip
from skyledger.operators import history, packed, references, snapshots
from skyledger.sources.tables import table

REFERENCES = (
    references.Reference("aircraft", "aircraft_type_id", "aircraft_types"),
    references.Reference("aircraft", "operator_id", "operators"),
    references.Reference("airports", "flight_information_region_id", "flight_information_regions"),
)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_packed(table(spark, sf, "optd_airlines"), "line_id", "alt_names", "alt_name")


def _day(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    h = history.delivered_history(table(spark, sf, "optd_airlines"))
    return h.select(F.col("chain").alias("airline_key"), _day("valid_from"), _day("valid_to"))


def p3_history(spark: SparkSession, sf: str) -> DataFrame:
    """The whole history with the values that held."""
    h = history.delivered_history(table(spark, sf, "optd_airlines"))
    return h.select(F.col("chain").alias("airline_key"), _day("valid_from"), _day("valid_to"), "name", F.col("3char_code").alias("icao_code"), F.col("2char_code").alias("iata_code"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.union_all([references.broken_references(table(spark, sf, r.child_table), table(spark, sf, r.parent_table), r) for r in REFERENCES])


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.union_all([references.orphan_report(table(spark, sf, r.child_table), table(spark, sf, r.parent_table), r) for r in REFERENCES])


def _source_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Of both source tables: per type, month and record the row that holds."""
    parts = []
    for name, ref in (("operator_sources", lambda m: strip(m["source_ref"])), ("country_sources", lambda m: F.upper(strip(m["iso_2char_code"])))):
        t = table(spark, sf, name).select("id", "type", "import_date", members(F.col("data")).alias("data"))
        parts.append(t.select(F.lit(name).alias("source_table"), F.col("type").alias("source_type"), F.date_format("import_date", "yyyy-MM").alias("snapshot"), ref(F.col("data")).alias("record_ref"), "import_date", "id", "data"))
    rows = references.union_all(parts).where(F.col("record_ref") != "")
    # The reference is compared in upper case for countries, so its own spelling is no content.
    rows = rows.withColumn("data", F.map_filter("data", lambda k, v: (F.col("source_table") != "country_sources") | (k != "iso_2char_code")))
    return snapshots.latest_rows(rows, ["source_table", "source_type", "snapshot", "record_ref"], ["import_date", "id"])


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    """All snapshots of both source tables, from two columns: a snapshot is all rows of a type in a month."""
    parts = [table(spark, sf, n).select(F.lit(n).alias("source_table"), F.col("type").alias("source_type"), F.date_format("import_date", "yyyy-MM").alias("snapshot")) for n in ("operator_sources", "country_sources")]
    return references.union_all(parts)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_changes(_source_snapshots(spark, sf), ["source_table", "source_type"], "snapshot", "record_ref", "data", _calendar(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).drop("changed_fields")


def p7_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Changed records per series, snapshot and field."""
    c = _changes(spark, sf).select("source_table", "source_type", "snapshot", F.explode("changed_fields").alias("field_name"))
    return c.groupBy(*c.columns).agg(F.count("*").alias("n_records"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_history, p6_found, p6_report, p7_found, p7_fields)}

_DATE = """CASE
 WHEN regexp_full_match({t}, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN TRY_CAST(try_strptime({t}, '%Y-%m-%d') AS DATE)
 WHEN regexp_full_match({t}, '\\d{4}/\\d{1,2}/\\d{1,2}') THEN TRY_CAST(try_strptime({t}, '%Y/%m/%d') AS DATE)
 WHEN regexp_full_match({t}, '\\d{1,2}\\.\\d{1,2}\\.\\d{4}') THEN TRY_CAST(try_strptime({t}, '%d.%m.%Y') AS DATE)
 WHEN regexp_full_match({t}, '\\d{8}') THEN TRY_CAST(try_strptime({t}, '%Y%m%d') AS DATE)
 WHEN regexp_full_match({t}, '\\d{1,2} [A-Za-z]{3} \\d{4}') THEN TRY_CAST(try_strptime({t}, '%d %b %Y') AS DATE) END"""


def _date(c: str) -> str:
    return _DATE.replace("{t}", f"trim({c})")


_HISTORY = f"""WITH l AS (
 SELECT pk, key, TRY_CAST(trim(version) AS INT) AS ver, {_date('validity_from')} AS f, {_date('validity_to')} AS t,
  nullif(trim(name), '') AS name, nullif(trim("3char_code"), '') AS c3, nullif(trim("2char_code"), '') AS c2
 FROM optd_airlines WHERE pk LIKE 'air-%' AND key IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY pk ORDER BY delivered_at DESC, line_id DESC) = 1),
x AS (SELECT pk, key, coalesce(ver, 0) AS ver, CASE WHEN t < f THEN t ELSE f END AS f, CASE WHEN t < f THEN f ELSE t END AS t, name, c3, c2 FROM l),
y AS (SELECT *, CAST(lead(f) OVER w - INTERVAL 1 DAY AS DATE) AS nxt FROM x WINDOW w AS (PARTITION BY key ORDER BY coalesce(f, DATE '0001-01-01'), ver, pk)),
z AS (SELECT * REPLACE (CASE WHEN t IS NULL THEN nxt WHEN nxt IS NULL THEN t ELSE least(t, nxt) END AS t) FROM y),
v AS (SELECT *, CASE WHEN CAST(lag(t) OVER w + INTERVAL 1 DAY AS DATE) = f AND lag(name) OVER w IS NOT DISTINCT FROM name
  AND lag(c3) OVER w IS NOT DISTINCT FROM c3 AND lag(c2) OVER w IS NOT DISTINCT FROM c2 THEN 0 ELSE 1 END AS fresh
 FROM z WHERE f IS NULL OR t IS NULL OR f <= t WINDOW w AS (PARTITION BY key ORDER BY coalesce(f, DATE '0001-01-01'), ver, pk)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY coalesce(f, DATE '0001-01-01'), ver, pk) AS p FROM v),
h AS (SELECT key, arg_min(ROW(f), (coalesce(f, DATE '0001-01-01'), ver, pk)) AS a, arg_max(ROW(t), (coalesce(f, DATE '0001-01-01'), ver, pk)) AS b,
 any_value(name) AS name, any_value(c3) AS icao_code, any_value(c2) AS iata_code FROM g GROUP BY key, p)
"""

_REFS = [f"""SELECT '{r.child_table}' AS child_table, '{r.child_field}' AS child_field, c.id AS child_id, p.id AS pid, p.created_at > c.created_at AS is_late,
 CASE WHEN p.id IS NULL THEN 'missing' WHEN p.created_at > c.created_at THEN 'late' END AS state, coalesce(strftime(c.created_at, '%Y-%m'), '') AS period
 FROM {r.child_table} c LEFT JOIN {r.parent_table} p ON c.{r.child_field} = p.id WHERE c.{r.child_field} IS NOT NULL""" for r in REFERENCES]  # fmt: skip

_CELLS = """WITH raw AS (
 SELECT 'operator_sources' AS source_table, id, type, import_date, CAST(data AS JSON) AS d FROM operator_sources
 UNION ALL SELECT 'country_sources', id, type, import_date, CAST(data AS JSON) FROM country_sources),
u AS (SELECT * REPLACE (CASE WHEN json_type(d) = 'VARCHAR' THEN CAST(d ->> '$' AS JSON) ELSE d END AS d) FROM raw),
r AS (SELECT source_table, type AS source_type, strftime(import_date, '%Y-%m') AS snapshot, d, id, import_date,
 CASE WHEN source_table = 'operator_sources' THEN trim(d ->> '$.source_ref') ELSE upper(trim(d ->> '$.iso_2char_code')) END AS record_ref FROM u),
k AS (SELECT * FROM r WHERE record_ref <> '' QUALIFY row_number() OVER (PARTITION BY source_table, source_type, snapshot, record_ref ORDER BY import_date DESC, id DESC) = 1),
e AS (SELECT source_table, source_type, snapshot, record_ref, d, unnest(json_keys(d)) AS field FROM k),
w AS (SELECT * EXCLUDE d, trim(json_extract_string(d, '$."' || field || '"')) AS v FROM e WHERE source_table <> 'country_sources' OR field <> 'iso_2char_code'),
c AS (SELECT * REPLACE (CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?') THEN coalesce(CAST(TRY_CAST(v AS DECIMAL(38,10)) AS VARCHAR), v) ELSE v END AS v) FROM w WHERE v <> '' AND v <> '[]'),
s AS (SELECT source_table, source_type, snapshot, lead(snapshot) OVER n AS nxt, lag(snapshot) OVER n AS prv FROM (SELECT DISTINCT source_table, source_type, snapshot FROM k) WINDOW n AS (PARTITION BY source_table, source_type ORDER BY snapshot)),
now AS (SELECT k.source_table, k.source_type, k.snapshot, k.record_ref FROM k),
diff AS (SELECT coalesce(a.source_table, b.source_table) AS source_table, coalesce(a.source_type, b.source_type) AS source_type, coalesce(a.snapshot, b.nxt) AS snapshot, coalesce(a.record_ref, b.record_ref) AS record_ref, a.record_ref IS NOT NULL AS cur, b.record_ref IS NOT NULL AS old
 FROM (SELECT now.* FROM now JOIN s USING (source_table, source_type, snapshot) WHERE prv IS NOT NULL) a
 FULL JOIN (SELECT now.*, s.nxt FROM now JOIN s USING (source_table, source_type, snapshot) WHERE s.nxt IS NOT NULL) b
 ON a.source_table = b.source_table AND a.source_type = b.source_type AND a.snapshot = b.nxt AND a.record_ref = b.record_ref),
f AS (SELECT coalesce(a.source_table, b.source_table) AS source_table, coalesce(a.source_type, b.source_type) AS source_type, coalesce(a.snapshot, b.nxt) AS snapshot, coalesce(a.record_ref, b.record_ref) AS record_ref, coalesce(a.field, b.field) AS field
 FROM (SELECT c.* FROM c JOIN s USING (source_table, source_type, snapshot) WHERE prv IS NOT NULL) a
 FULL JOIN (SELECT c.*, s.nxt FROM c JOIN s USING (source_table, source_type, snapshot) WHERE s.nxt IS NOT NULL) b
 ON a.source_table = b.source_table AND a.source_type = b.source_type AND a.snapshot = b.nxt AND a.record_ref = b.record_ref AND a.field = b.field
 WHERE a.v IS DISTINCT FROM b.v),
both_there AS (SELECT DISTINCT f.* FROM f JOIN diff USING (source_table, source_type, snapshot, record_ref) WHERE cur AND old)
"""

SQL = {
    "p3_found": _HISTORY + "SELECT key AS airline_key, coalesce(strftime(a[1], '%Y-%m-%d'), '') AS valid_from, coalesce(strftime(b[1], '%Y-%m-%d'), '') AS valid_to FROM h",
    "p3_history": _HISTORY + "SELECT key AS airline_key, coalesce(strftime(a[1], '%Y-%m-%d'), '') AS valid_from, coalesce(strftime(b[1], '%Y-%m-%d'), '') AS valid_to, name, icao_code, iata_code FROM h",
    "p6_found": "SELECT child_table, child_field, child_id, state, period FROM (" + " UNION ALL ".join(_REFS) + ") WHERE state IS NOT NULL",
    "p6_report": "SELECT child_table, child_field, period, count(*) AS n_references, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'late') AS n_late FROM (" + " UNION ALL ".join(_REFS) + ") GROUP BY ALL",
    "p7_found": _CELLS + "SELECT source_table, source_type, snapshot, record_ref, CASE WHEN NOT old THEN 'added' WHEN NOT cur THEN 'removed' ELSE 'changed' END AS change_kind FROM diff WHERE NOT old OR NOT cur OR (source_table, source_type, snapshot, record_ref) IN (SELECT (source_table, source_type, snapshot, record_ref) FROM both_there)",
    "p7_fields": _CELLS + "SELECT source_table, source_type, snapshot, field AS field_name, count(*) AS n_records FROM both_there GROUP BY ALL",
}
