"""Queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.text import FILLERS
from skyledger.llm import matching, packing, subjects, survivors, tokens, variants
from skyledger.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    s = survivors.operator_survivors(table(spark, sf, "operator_sources"), table(spark, sf, "source_types"))
    long = s.unpivot(["group_id"], list(survivors.OPERATOR_FIELDS), "field_name", "source_id")
    return long.where(F.col("source_id").isNotNull()).select("group_id", "field_name", "source_id")


#: Codes come from one row together, and the callsign follows from them.
RECORD_BUNDLES = [survivors.Bundle("codes", ("icao_code", "iata_code"), ("callsign",)), survivors.Bundle("callsign", ("callsign",)), survivors.Bundle("name", ("name",)), survivors.Bundle("base", ("head_office", "fleet_size"))]


def p1_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that supply each consistent bundle."""
    return survivors.operator_survivors(table(spark, sf, "operator_sources"), table(spark, sf, "source_types"), RECORD_BUNDLES)


def _typed_names(spark: SparkSession, sf: str) -> DataFrame:
    fields = (("aircraft", "owner"), ("operators", "name"), ("operator_sources", "name"))
    parts = [table(spark, sf, t).select(F.col(c).alias("name")) for t, c in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.name_pairs(variants.name_entities(_typed_names(spark, sf)))


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every mutual candidate pair with its confidence."""
    return matching.match_operators(table(spark, sf, "operator_sources"), table(spark, sf, "operators")).select("source_id", "operator_id", F.round("confidence", 4).alias("confidence"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_operators(table(spark, sf, "operator_sources"), table(spark, sf, "operators")).where(F.col("confidence") >= matching.ACCEPT).select("source_id", "operator_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "subjects"))


QUERIES = {f.__name__: f for f in (p1_found, p1_bundles, p4_found, p5_found, p5_matches, p8_ids, p9_containers, p10_found)}

_FILL = ", ".join(f"'{f}'" for f in FILLERS)
_RAW = f"""WITH raw AS (SELECT id, type, import_date, CAST(data AS JSON) AS d FROM operator_sources),
u AS (SELECT * REPLACE (CASE WHEN json_type(d) = 'VARCHAR' THEN CAST(d ->> '$' AS JSON) ELSE d END AS d) FROM raw),
m AS (SELECT id, upper(regexp_replace(d ->> '$.aoc', '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS aoc, coalesce(t.trust, -1) AS trust, import_date, d FROM u LEFT JOIN source_types t USING (type)),
g AS (SELECT * FROM m WHERE regexp_matches(aoc, '\\p{{N}}')),
n AS (SELECT aoc, min(id) AS group_id FROM g GROUP BY aoc HAVING count(*) > 1),
e AS (SELECT n.group_id, g.id, trust, import_date, unnest(['name', 'icao_code', 'iata_code', 'callsign', 'head_office', 'fleet_size']) AS field_name, d FROM g JOIN n USING (aoc)),
v AS (SELECT * EXCLUDE d, trim(json_extract_string(d, '$.' || field_name)) AS v FROM e),
o AS (SELECT * FROM v WHERE v IS NOT NULL AND CASE WHEN field_name = 'iata_code' THEN regexp_full_match(v, '[A-Za-z0-9]{{2}}') WHEN lower(v) IN ({_FILL}) THEN false
 WHEN field_name = 'icao_code' THEN regexp_full_match(v, '[A-Za-z]{{3}}') WHEN field_name = 'fleet_size' THEN coalesce(TRY_CAST(v AS DOUBLE) <> 0, true) ELSE true END)
"""
_TOP = "trust DESC, import_date DESC NULLS LAST, id"
_WIDE = ", ".join(f"max(o.v) FILTER (o.field_name = '{f}') AS {f}" for f in survivors.OPERATOR_FIELDS)
_BUNDLES = f"""{_RAW}, w AS (SELECT n.group_id, g.aoc AS certificate, g.id, g.trust, g.import_date, {_WIDE} FROM g JOIN n USING (aoc) LEFT JOIN o ON o.id = g.id GROUP BY ALL),
c AS (SELECT group_id, id, f FROM (SELECT *, (icao_code IS NOT NULL)::INT + (iata_code IS NOT NULL)::INT AS f FROM w) WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY f DESC, {_TOP}) = 1),
h AS (SELECT group_id, id FROM (SELECT *, (head_office IS NOT NULL)::INT + (fleet_size IS NOT NULL)::INT AS f FROM w) WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY f DESC, {_TOP}) = 1),
s AS (SELECT group_id, id FROM w WHERE callsign IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_TOP}) = 1),
t AS (SELECT group_id, id FROM w WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_TOP}) = 1),
k AS (SELECT group_id, first(id ORDER BY {_TOP}) AS a_id, first(import_date ORDER BY {_TOP}) AS a_at, max(trust) AS a_t, first(id ORDER BY {_TOP}) FILTER (callsign IS NOT NULL) AS b_id, max(trust) FILTER (callsign IS NOT NULL) AS b_t
 FROM w WHERE icao_code IS NOT NULL AND iata_code IS NOT NULL GROUP BY group_id, icao_code, iata_code),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY a_t + coalesce(b_t, -1) DESC, a_t DESC, a_at DESC NULLS LAST, a_id) = 1)
SELECT certificate, group_id, CASE WHEN c.f = 2 THEN b.a_id ELSE c.id END AS codes, CASE WHEN c.f = 2 THEN b.b_id ELSE s.id END AS callsign, t.id AS name, h.id AS base
FROM (SELECT DISTINCT certificate, group_id FROM w) LEFT JOIN c USING (group_id) LEFT JOIN b USING (group_id) LEFT JOIN s USING (group_id) LEFT JOIN t USING (group_id) LEFT JOIN h USING (group_id)"""
SQL = {
    "p1_bundles": _BUNDLES,
    "p1_found": _RAW + "SELECT group_id, field_name, id AS source_id FROM o QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust DESC, import_date DESC NULLS LAST, id) = 1",
}
