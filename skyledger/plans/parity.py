"""Queries of the reference-data operators over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import registrations, rules, scalars
from skyledger.functions.dates import any_date
from skyledger.functions.jsonx import members
from skyledger.functions.similarity import boost, jaro
from skyledger.operators import audit, fieldmap, groups, resolve, search, upsert, validate
from skyledger.operators.snapshots import latest_rows
from skyledger.plans.problems import _date
from skyledger.sources import text as text_sources
from skyledger.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What an aircraft's status numbers mean, from 0.
STATUSES = ("active", "withdrawn", "hull_loss", "scrapped", "stored", "written_off")


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x00]+|[\\s\\x00]+$', '', 'g')"


def _blank(c: str) -> str:
    return f"nullif({_strip(c)}, '')"


# Projections and filters


@query(f"""SELECT line_id, {_strip('"3char_code"')} AS icao_code, {_strip('"2char_code"')} AS iata_code, {_strip('num_code')} AS num_code, {_strip('validity_from')} AS validity_from,
 {_strip('validity_to')} AS validity_to, {_strip('name')} AS name, {_strip('name2')} AS alt_name, {_strip('wiki_link')} AS wikipedia_link,
 array_to_string(list_filter(p, lambda x, i: (i = 1 OR NOT (contains(p[i - 1], 'sign') OR contains(p[i - 1], 'abbr'))) AND NOT contains(x, '=') AND length(x) >= 3), '; ') AS alt_names
 FROM (SELECT *, CASE WHEN alt_names IS NULL THEN NULL WHEN regexp_replace(alt_names, '\\|+$', '') = '' THEN [] ELSE string_split(regexp_replace(alt_names, '\\|+$', ''), '|') END AS p FROM optd_airlines)""")
def fieldmap_project(spark: SparkSession, sf: str) -> DataFrame:
    return fieldmap.project(table(spark, sf, "optd_airlines"), fieldmap.AIRLINES_B, keep=["line_id"]).withColumn("alt_names", F.array_join("alt_names", "; "))


@query(f"""SELECT id, {_blank('icao_code')} AS icao_code, {_blank('iata_code')} AS iata_code, CASE WHEN {_blank('icao_code')} IS NOT NULL THEN 'i|' || {_blank('icao_code')}
 WHEN {_blank('iata_code')} IS NOT NULL OR name IS NOT NULL THEN 'n|' || coalesce({_blank('iata_code')}, '') || '|' || coalesce(name, '') END AS match_key,
 concat_ws('/', {_blank('icao_code')}, {_blank('iata_code')}) AS codes FROM operator_sources""")
def match_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "operator_sources")
    icao, iata = scalars.null_if_blank(F.col("icao_code")), scalars.null_if_blank(F.col("iata_code"))
    return s.select("id", icao.alias("icao_code"), iata.alias("iata_code"), upsert.match_key(icao, iata, F.col("name")).alias("match_key"), scalars.code_pair(icao, iata).alias("codes"))


@query("SELECT line_id, pk, name FROM optd_airlines WHERE starts_with(pk, 'air-') AND length(trim(coalesce(name, ''))) > 0 AND length(trim(coalesce(\"3char_code\", ''))) > 0 AND length(trim(coalesce(\"2char_code\", ''))) > 0")
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "optd_airlines").where(F.col("pk").startswith("air-"))
    return o.where(validate.present("name") & validate.present("3char_code") & validate.present("2char_code")).select("line_id", "pk", "name")


@query(f"SELECT line_id, pk FROM optd_airlines WHERE pk LIKE 'air-%' AND ({_date('validity_to')} IS NULL OR {_date('validity_to')} >= DATE '2005-01-01')")
def first_load_expiry(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "optd_airlines").where(F.col("pk").startswith("air-"))
    return o.where(upsert.still_valid(any_date(F.col("validity_to")), F.lit("2005-01-01").cast("date"))).select("line_id", "pk")


@query("""SELECT id, CASE WHEN status >= 0 AND status < 6 THEN ['active', 'withdrawn', 'hull_loss', 'scrapped', 'stored', 'written_off'][status + 1] END AS status_name,
 'VH-' || regexp_replace(registration, '^VH-', '') AS prefixed FROM aircraft""")
def enum_decode(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "aircraft")
    labels = list(STATUSES)
    return a.select("id", scalars.decode(F.col("status"), labels).alias("status_name"), scalars.with_prefix(F.regexp_replace("registration", "^VH-", ""), "VH-").alias("prefixed"))


@query("""SELECT id, label, CASE WHEN label = 'active' THEN 'green' WHEN label IN ('stored', 'withdrawn') THEN 'yellow' WHEN label IN ('destroyed', 'scrapped', 'written off') THEN 'red' ELSE 'gray' END AS severity
 FROM (SELECT id, CASE WHEN status >= 0 AND status < 6 THEN ['active', 'withdrawn', 'hull_loss', 'scrapped', 'stored', 'written_off'][status + 1] END AS label FROM aircraft)""")
def severity_bucket(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "aircraft").select("id", scalars.decode(F.col("status"), list(STATUSES)).alias("label"))
    return a.select("id", "label", scalars.severity(F.col("label")).alias("severity"))


@query("SELECT unnest(['Active', 'Withdrawn', 'Hull Loss', 'Scrapped', 'Stored', 'Written Off']) AS label, unnest(['active', 'withdrawn', 'hull_loss', 'scrapped', 'stored', 'written_off']) AS value")
def status_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(s,) for s in STATUSES], "value string")
    return d.select(scalars.titleize(F.col("value")).alias("label"), "value")


@query("SELECT count(*) AS n, count(*) FILTER (name IS NULL) AS name, count(*) FILTER (icao_code IS NULL) AS icao_code, count(*) FILTER (iata_code IS NULL) AS iata_code, count(*) FILTER (import_date IS NULL) AS import_date, count(*) FILTER (data IS NULL) AS data FROM operator_sources")
def not_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "operator_sources")
    return s.agg(F.count("*").alias("n")).crossJoin(validate.null_counts(s, ["name", "icao_code", "iata_code", "import_date", "data"]))  # one row each


@query("SELECT id, coalesce(trim(icao_code), '') <> '' OR coalesce(trim(iata_code), '') <> '' AS has_code FROM operator_sources")
def code_needed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "operator_sources").select("id", (validate.present("icao_code") | validate.present("iata_code")).alias("has_code"))


@query()
def valid_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Callsign patterns of the sources and whether they are regular expressions."""
    m = members(F.col("data"))
    p = table(spark, sf, "operator_sources").select(F.explode(F.array(m["positioning_callsign_pattern"], m["charter_callsign_pattern"])).alias("pattern")).where(F.col("pattern").isNotNull()).distinct()
    return p.select("pattern", validate.compiles(F.col("pattern")).alias("compiles"))


@query()
def operator_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Owners as operators: canonical, titled, found by their leading words, or new."""
    return resolve.search_or_create(table(spark, sf, "aircraft"), "owner", table(spark, sf, "operators"))


# Scalars


def _model_text() -> Column:
    i = F.col("id")
    t = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    n = (i % 400 + 100).cast("string")
    d = (i % 10).cast("string")
    return (
        F.when(i % 6 == 0, t("A3", d, "0-", n)).when(i % 6 == 1, t("B7", d, "7-", n)).when(i % 6 == 2, t("PC-", d, "/47E")).when(i % 6 == 3, t("F28 MK 0", d, "00"))
        .when(i % 6 == 4, t("A-3", d, "0-", n)).otherwise(t("C-212-", n))
    )


_MODEL_SQL = """CASE id % 6 WHEN 0 THEN 'A3' || (id % 10) || '0-' || (id % 400 + 100) WHEN 1 THEN 'B7' || (id % 10) || '7-' || (id % 400 + 100) WHEN 2 THEN 'PC-' || (id % 10) || '/47E'
 WHEN 3 THEN 'F28 MK 0' || (id % 10) || '00' WHEN 4 THEN 'A-3' || (id % 10) || '0-' || (id % 400 + 100) ELSE 'C-212-' || (id % 400 + 100) END"""


@query(f"SELECT id, m AS model, {rules.fold_sql('m', rules.MODEL_FAMILY)} AS family, {rules.fold_sql('m', rules.MODEL_DISPLAY)} AS display, {rules.fold_sql('m', rules.MODEL_ICAO)} AS icao_model FROM (SELECT id, {_MODEL_SQL} AS m FROM aircraft)")
def regex_fold_models(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "aircraft").select("id", _model_text().alias("model"))
    m = F.col("model")
    return a.select("id", "model", rules.fold(m, rules.MODEL_FAMILY).alias("family"), rules.fold(m, rules.MODEL_DISPLAY).alias("display"), rules.fold(m, rules.MODEL_ICAO).alias("icao_model"))


@query(f"SELECT owner, {rules.fold_sql('owner', rules.OPERATORS)} AS operator_name, {rules.fold_sql('owner', rules.MANUFACTURERS)} AS maker_name, {rules.fold_sql('owner', rules.OPERATOR_NAMES)} AS list_name FROM (SELECT DISTINCT owner FROM aircraft WHERE owner IS NOT NULL)")
def regex_fold_names(spark: SparkSession, sf: str) -> DataFrame:
    """Folds over distinct texts, for they repeat."""
    o = table(spark, sf, "aircraft").where(F.col("owner").isNotNull()).select("owner").distinct()
    return o.select("owner", rules.fold(F.col("owner"), rules.OPERATORS).alias("operator_name"), rules.fold(F.col("owner"), rules.MANUFACTURERS).alias("maker_name"), rules.fold(F.col("owner"), rules.OPERATOR_NAMES).alias("list_name"))


_A36 = registrations.ALPHABET


@query(f"""SELECT id, reg AS registration, format('7C{{:04X}}', n) AS icao, reg AS back FROM (SELECT id, n, 'VH-' || substr('{_A36}', (n // 1296)::INT + 1, 1) || substr('{_A36}', ((n % 1296) // 36)::INT + 1, 1) || substr('{_A36}', (n % 36)::INT + 1, 1) AS reg
 FROM (SELECT id, id % 46656 AS n FROM aircraft))""")
def base36_codes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id") % 46656
    at = lambda d: F.substring(F.lit(_A36), (d + 1).cast("int"), F.lit(1))
    a = table(spark, sf, "aircraft").select("id", F.concat(F.lit("VH-"), at(F.floor(n / 1296)), at(F.floor(n % 1296 / 36)), at(n % 36)).alias("registration"))
    code = registrations.registration_to_hex(F.col("registration"))
    return a.select("id", "registration", code.alias("icao"), registrations.hex_to_registration(code).alias("back"))


@query(r"""WITH t AS (SELECT line_id, CASE WHEN regexp_replace(alt_names, '\|+$', '') = '' THEN [] ELSE string_split(regexp_replace(alt_names, '\|+$', ''), '|') END AS p FROM optd_airlines WHERE alt_names IS NOT NULL)
SELECT line_id, array_to_string(list_filter(p, lambda x, i: (i = 1 OR NOT (contains(p[i - 1], 'sign') OR contains(p[i - 1], 'abbr'))) AND NOT contains(x, '=') AND length(x) >= 3), '; ') AS names FROM t""")
def alt_names_parse(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "optd_airlines").where(F.col("alt_names").isNotNull())
    return o.select("line_id", F.array_join(scalars.alt_names(F.col("alt_names")), "; ").alias("names"))


@query()
def titleize_names(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "aircraft").where(F.col("owner").isNotNull()).select("owner").distinct()
    return o.select("owner", scalars.titleize(F.col("owner")).alias("title"))


@query(r"""SELECT id, nullif(regexp_extract(t, '(?m)\((.*?)\)$', 1), '') AS country_text, trim(regexp_replace(t, '(?m)\((.*?)\)$', '', 'g')) AS short FROM (SELECT id, coalesce(trim(name), '') || ' (' || coalesce(country, '') || ')' AS t FROM airports)""")
def bracket_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.coalesce(F.trim("name"), F.lit("")), F.lit(" ("), F.coalesce("country", F.lit("")), F.lit(")"))
    a = table(spark, sf, "airports").select("id", t.alias("t"))
    return a.select("id", scalars.country_in_brackets(F.col("t")).alias("country_text"), scalars.without_brackets(F.col("t")).alias("short"))


def _cabin_sql(n_q: str) -> str:
    cls = f"""CASE WHEN contains('FA', s[1]) THEN 'First Class' WHEN contains('CJRDI', s[1]) THEN 'Business Class' WHEN contains('WP', s[1]) THEN 'Premium Economy' WHEN contains('YHKMLGVSOE{n_q}', s[1]) THEN 'Economy' WHEN s[1] = 'B' THEN 'Basic Economy' ELSE 'Other' END"""
    return f"array_to_string(list_transform(regexp_extract_all(c, '[A-Z][0-9]+'), lambda s: substr(s, 2) || ' ' || {cls}), ', ')"


@query(f"SELECT c AS cabin, {_cabin_sql('NQ')} AS classes, {_cabin_sql('')} AS classes_literal FROM (SELECT DISTINCT cabin_configuration || 'F' || (id % 9) || 'N' || (id % 7) AS c FROM aircraft WHERE cabin_configuration IS NOT NULL)")
def cabin_decode(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    c = F.concat("cabin_configuration", F.lit("F"), (i % 9).cast("string"), F.lit("N"), (i % 7).cast("string"))
    a = table(spark, sf, "aircraft").where(F.col("cabin_configuration").isNotNull()).select(c.alias("cabin")).distinct()
    return a.select("cabin", F.array_join(scalars.cabin_classes(F.col("cabin")), ", ").alias("classes"), F.array_join(scalars.cabin_classes(F.col("cabin"), literal=True), ", ").alias("classes_literal"))


@query(r"""SELECT id, coalesce(TRY_CAST(regexp_extract(serial_number, '^\s*([+-]?\d+)', 1) AS INT), 0) AS serial_int, md5(lower(owner)) AS owner_hash, coalesce(model, '') || ' ' || coalesce(aircraft_name, '') AS full_name FROM aircraft""")
def scalar_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "aircraft").select("id", scalars.leading_int(F.col("serial_number")).alias("serial_int"), scalars.email_hash(F.col("owner")).alias("owner_hash"), scalars.full_name(F.col("model"), F.col("aircraft_name")).alias("full_name"))


@query(f"SELECT line_id, strftime({_date('validity_from')}, '%Y-%m-%d') AS valid_from, strftime({_date('validity_to')}, '%Y-%m-%d') AS valid_to FROM optd_airlines")
def safe_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.date_format(any_date(F.col(c)), "yyyy-MM-dd")
    return table(spark, sf, "optd_airlines").select("line_id", day("validity_from").alias("valid_from"), day("validity_to").alias("valid_to"))


# Upserts


@query("""SELECT type, match_key, id FROM (SELECT id, type, import_date, CASE WHEN icao_code IS NOT NULL THEN 'i|' || icao_code WHEN iata_code IS NOT NULL OR name IS NOT NULL THEN 'n|' || coalesce(iata_code, '') || '|' || coalesce(name, '') END AS match_key FROM operator_sources)
 WHERE match_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type, match_key ORDER BY import_date DESC, id DESC) = 1""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "operator_sources").select("id", "type", "import_date", upsert.match_key(F.col("icao_code"), F.col("iata_code"), F.col("name")).alias("match_key"))
    return upsert.last_wins(s.where(F.col("match_key").isNotNull()), ["type", "match_key"], ["import_date", "id"]).select("type", "match_key", "id")


_COUNTRY_SIDES = """SELECT type, upper(trim(iso_2char_code)) AS iso2, name, capital, iso_3char_code, import_date FROM country_sources WHERE trim(iso_2char_code) <> '' AND import_date {op} TIMESTAMP '2024-05-01'
 QUALIFY row_number() OVER (PARTITION BY type, upper(trim(iso_2char_code)) ORDER BY import_date DESC, id DESC) = 1"""


@query(f"""WITH c AS ({_COUNTRY_SIDES.format(op='<')}), b AS ({_COUNTRY_SIDES.format(op='>=')})
SELECT type, iso2, CASE WHEN b.iso2 IS NULL THEN c.name ELSE b.name END AS name, CASE WHEN b.iso2 IS NULL THEN c.capital ELSE b.capital END AS capital, CASE WHEN b.iso2 IS NULL THEN c.iso_3char_code ELSE b.iso_3char_code END AS iso_3char_code,
 strftime(CASE WHEN outcome IN ('inserted', 'updated') THEN TIMESTAMP '2024-09-01' ELSE c.import_date END, '%Y-%m-%d %H:%M:%S') AS import_date, outcome
FROM (SELECT coalesce(c.type, b.type) AS type, coalesce(c.iso2, b.iso2) AS iso2, c, b, CASE WHEN b.iso2 IS NULL THEN 'kept' WHEN c.iso2 IS NULL THEN 'inserted' WHEN c.name IS NOT DISTINCT FROM b.name AND c.capital IS NOT DISTINCT FROM b.capital AND c.iso_3char_code IS NOT DISTINCT FROM b.iso_3char_code THEN 'unchanged' ELSE 'updated' END AS outcome
 FROM c FULL JOIN b ON c.type = b.type AND c.iso2 = b.iso2)""")
def upsert_merge_changed(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct("type", F.upper(F.trim("iso_2char_code")).alias("iso2")).alias("key")
    s = table(spark, sf, "country_sources").select(key, "name", "capital", "iso_3char_code", "import_date", "id").where("key.iso2 <> ''")
    cut = F.lit("2024-05-01").cast("timestamp")
    side = lambda c: upsert.last_wins(s.where(c), ["key"], ["import_date", "id"]).drop("id")
    m = upsert.merge(side(F.col("import_date") < cut), side(F.col("import_date") >= cut), "key", ["name", "capital", "iso_3char_code"], "import_date", F.lit("2024-09-01").cast("timestamp"))
    return m.select("key.type", "key.iso2", "name", "capital", "iso_3char_code", F.date_format("import_date", "yyyy-MM-dd HH:mm:ss").alias("import_date"), "outcome")


_PAIR_SQL = """CASE WHEN i IS NOT NULL AND a IS NOT NULL THEN concat_ws('|', 'b', i, a) WHEN i IS NOT NULL THEN concat_ws('|', 'i', i, name) WHEN a IS NOT NULL THEN concat_ws('|', 'a', a, name) END"""


@query(f"""WITH l AS (SELECT *, {_PAIR_SQL} AS key FROM (SELECT delivered_at, line_id, name, {_blank('"3char_code"')} AS i, {_blank('"2char_code"')} AS a, {_date('validity_to')} AS valid_to FROM optd_airlines WHERE pk LIKE 'air-%')),
k AS (SELECT * FROM l WHERE key IS NOT NULL),
c AS (SELECT key, name, valid_to, delivered_at FROM k WHERE delivered_at < TIMESTAMP '2023-06-01' QUALIFY row_number() OVER (PARTITION BY key ORDER BY delivered_at DESC, line_id DESC) = 1),
b AS (SELECT k.key, k.name, k.valid_to FROM k LEFT JOIN c USING (key) WHERE k.delivered_at >= TIMESTAMP '2023-06-01' AND (k.valid_to IS NULL OR k.valid_to >= CASE WHEN c.key IS NULL THEN DATE '2024-05-01' ELSE CAST(c.delivered_at AS DATE) END)
 QUALIFY row_number() OVER (PARTITION BY k.key ORDER BY k.line_id DESC) = 1)
SELECT coalesce(c.key, b.key) AS key, CASE WHEN b.key IS NULL THEN c.name ELSE b.name END AS name, CASE WHEN b.key IS NULL THEN 'kept' WHEN c.key IS NULL THEN 'inserted' WHEN c.name IS NOT DISTINCT FROM b.name AND c.valid_to IS NOT DISTINCT FROM b.valid_to THEN 'unchanged' ELSE 'updated' END AS outcome
 FROM c FULL JOIN b ON c.key = b.key""")
def upsert_gated(spark: SparkSession, sf: str) -> DataFrame:
    icao, iata = scalars.null_if_blank(F.col("3char_code")), scalars.null_if_blank(F.col("2char_code"))
    lines = table(spark, sf, "optd_airlines").where(F.col("pk").startswith("air-"))
    k = lines.select("delivered_at", "line_id", "name", any_date(F.col("validity_to")).alias("valid_to"), upsert.pair_key(icao, iata, F.col("name")).alias("key")).where(F.col("key").isNotNull())
    cut = F.lit("2023-06-01").cast("timestamp")
    current = upsert.last_wins(k.where(F.col("delivered_at") < cut), ["key"], ["delivered_at", "line_id"]).select("key", "name", "valid_to", F.col("delivered_at").alias("import_date"))
    return upsert.gated_upsert(current, k.where(F.col("delivered_at") >= cut).drop("delivered_at"), "2024-05-01", "line_id", ["name"]).select("key", "name", "outcome")


# Joins and resolution


_REF_SQL = "trim((CASE WHEN json_type(CAST(data AS JSON)) = 'VARCHAR' THEN CAST(CAST(data AS JSON) ->> '$' AS JSON) ELSE CAST(data AS JSON) END) ->> '$.source_ref')"

_CURRENT_SQL = f"""s AS (SELECT id, type, name, {_blank('icao_code')} AS icao_code, {_blank('iata_code')} AS iata_code FROM (SELECT *, {_REF_SQL} AS ref FROM operator_sources)
 QUALIFY row_number() OVER (PARTITION BY type, CASE WHEN coalesce(ref, '') <> '' THEN 'r' || ref ELSE '#' || id END ORDER BY import_date DESC, id DESC) = 1),
t AS (SELECT type, row_number() OVER (ORDER BY coalesce(max(trust), -1) DESC, type) AS rank FROM (SELECT DISTINCT type FROM operator_sources) LEFT JOIN source_types USING (type) GROUP BY type)"""


def _current(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of each record (type and source_ref) over all months; a row without source_ref is a record of its own."""
    s = table(spark, sf, "operator_sources").select("id", "type", "import_date", "name", "icao_code", "iata_code", F.trim(members(F.col("data"))["source_ref"]).alias("ref"))
    s = s.withColumn("record", F.when(F.coalesce("ref", F.lit("")) != "", F.concat(F.lit("r"), "ref")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    rows = latest_rows(s.drop("ref"), ["type", "record"], ["import_date", "id"])
    return rows.select("id", "type", "name", scalars.null_if_blank(F.col("icao_code")).alias("icao_code"), scalars.null_if_blank(F.col("iata_code")).alias("iata_code"))


def _sides(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    """(type, its current rows), the most trusted type first; a type without known trust last."""
    kinds = table(spark, sf, "operator_sources").select("type").distinct().join(table(spark, sf, "source_types"), "type", "left")
    order = kinds.groupBy("type").agg(F.coalesce(F.max("trust"), F.lit(-1)).alias("trust")).orderBy(F.desc("trust"), "type").collect()  # a fixed list of types
    rows = _current(spark, sf)
    return [(r["type"], rows.where(F.col("type") == r["type"]).drop("type")) for r in order]


def _of_pairs(spark: SparkSession, sf: str, f) -> DataFrame:
    """f(left, right) of every two types, the more trusted one at the left, with both types."""
    sides, out = _sides(spark, sf), None
    for i, (a, left) in enumerate(sides):
        for b, right in sides[i + 1 :]:
            one = f(left, right).select(F.lit(a).alias("l_type"), F.lit(b).alias("r_type"), "*")
            out = one if out is None else out.unionByName(one)
    return out


#: Every character beyond ASCII that names hold, and a control character for each: DuckDB measures likeness by bytes, so
#: each character is made one byte, as the operators count by code points.
_ONE_BYTE = """z AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS f, coalesce(string_agg(chr(n::INT), '' ORDER BY c), '') AS t FROM (SELECT c, CASE WHEN n < 9 THEN n WHEN n < 11 THEN n + 2 ELSE n + 3 END AS n FROM (
 SELECT c, row_number() OVER (ORDER BY c) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(name, '[^\\x00-\\x7F]')) AS c FROM (SELECT name FROM operator_sources UNION ALL SELECT name FROM operators)))))"""


def _merge_step(k: int) -> str:
    """One more source (the k-th by trust) merged into the rows accepted so far."""
    return f"""r{k} AS (SELECT s.id, name, icao_code, iata_code FROM s JOIN t USING (type) WHERE rank = {k}),
x{k} AS (SELECT v.id AS l_id, min(o.id) AS r_id FROM l{k} v JOIN r{k} o ON o.name = v.name AND CASE WHEN v.icao_code IS NULL THEN o.iata_code = v.iata_code ELSE o.icao_code = v.icao_code END GROUP BY v.id),
d{k} AS (SELECT v.id AS l_id, v.icao_code AS li, o.id AS r_id, CASE WHEN v.icao_code IS NOT DISTINCT FROM o.icao_code AND v.iata_code IS NOT DISTINCT FROM o.iata_code THEN 1.0 ELSE jaro_winkler_similarity(translate(v.name, f, z.t), translate(o.name, f, z.t)) END AS c
 FROM l{k} v JOIN r{k} o ON (v.icao_code IS NULL OR v.icao_code = o.icao_code) AND (v.iata_code IS NULL OR v.iata_code = o.iata_code) AND NOT (v.icao_code IS NULL AND v.iata_code IS NULL), z WHERE v.id NOT IN (SELECT l_id FROM x{k})),
m{k} AS (SELECT * FROM x{k} UNION ALL SELECT l_id, r_id FROM (SELECT l_id, r_id, c FROM d{k} WHERE c >= CASE WHEN li IS NOT NULL THEN 0.5 ELSE 0.75 END QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY c DESC, r_id) = 1)),
u{k} AS (SELECT 1 AS part, v.phase, v.id, coalesce(v.name, o.name) AS name, coalesce(v.icao_code, o.icao_code) AS icao_code, coalesce(v.iata_code, o.iata_code) AS iata_code FROM l{k} v LEFT JOIN m{k} m ON m.l_id = v.id LEFT JOIN r{k} o ON o.id = m.r_id
 UNION ALL SELECT 2, {k}, * FROM r{k} WHERE id NOT IN (SELECT r_id FROM m{k})),
e{k} AS (SELECT *, concat_ws(', ', CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END, CASE WHEN icao_code IS NOT NULL AND NOT regexp_full_match(icao_code, '[A-Z0-9]{{3}}') THEN 'icao_code' END, CASE WHEN iata_code IS NOT NULL AND NOT regexp_full_match(iata_code, '[A-Z0-9]{{2}}') THEN 'iata_code' END) AS errors FROM u{k}),
q{k} AS (SELECT * REPLACE (CASE WHEN errors = '' AND icao_code IS NOT NULL AND row_number() OVER (PARTITION BY errors = '', lower(icao_code) ORDER BY part, id) > 1 THEN 'icao_code taken' ELSE errors END AS errors) FROM e{k}),
l{k + 1} AS (SELECT phase, id, name, icao_code, iata_code FROM q{k} WHERE errors = '')"""


_OUT = "phase, id AS src, name, icao_code, iata_code, errors"


@query(f"""WITH {_CURRENT_SQL}, {_ONE_BYTE}, l2 AS (SELECT 1 AS phase, s.id, name, icao_code, iata_code FROM s JOIN t USING (type) WHERE rank = 1), {_merge_step(2)}, {_merge_step(3)}
SELECT {_OUT} FROM q2 WHERE errors <> '' UNION ALL SELECT {_OUT} FROM q3""")
def entity_resolve_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship merge of all sources, the most trusted first: exact, fuzzy and left-over rows with the rules' verdict;
    phase is the place of the source that a row comes from."""
    rows = resolve.combine_all([rows for _, rows in _sides(spark, sf)])
    return rows.select("phase", "src", "name", "icao_code", "iata_code", F.array_join("errors", ", ").alias("errors"))


@query(f"""WITH {_CURRENT_SQL}, r AS (SELECT s.*, rank FROM s JOIN t USING (type))
SELECT l.type AS l_type, o.type AS r_type, l.id AS l_id, min(o.id) AS r_id FROM r l JOIN r o ON l.rank < o.rank AND o.name = l.name AND CASE WHEN l.icao_code IS NULL THEN o.iata_code = l.iata_code ELSE o.icao_code = l.icao_code END GROUP BY ALL""")
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return _of_pairs(spark, sf, resolve.exact_matches)


@query(f"""WITH {_CURRENT_SQL}, {_ONE_BYTE} SELECT DISTINCT s.name AS name_a, o.name AS name_b, round(jaro_winkler_similarity(translate(s.name, f, z.t), translate(o.name, f, z.t)), 6) AS similarity FROM s JOIN operators o ON s.iata_code = o.iata_code, z WHERE s.name <> '' AND o.name <> ''""")
def jaro_winkler_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = _current(spark, sf).select("iata_code", F.col("name").alias("name_a")).where("name_a <> ''")
    o = table(spark, sf, "operators").select("iata_code", F.col("name").alias("name_b")).where("name_b <> ''")
    p = v.join(o, "iata_code").select("name_a", "name_b").distinct().withColumn("_j", jaro(F.col("name_a"), F.col("name_b")))
    return p.select("name_a", "name_b", F.round(boost(F.col("_j"), F.col("name_a"), F.col("name_b")), 6).alias("similarity"))


@query(f"""WITH {_CURRENT_SQL}, p AS (SELECT id, name AS t, list_filter(string_split_regex(name, '\\s+'), lambda w: w <> '') AS w FROM s), e AS (SELECT id, t, unnest(range(1, len(w) + 1)) AS k, w FROM p), x AS (SELECT id, t, array_to_string(w[1:k], ' ') AS name FROM e),
n AS (SELECT name, min(id) AS name_id FROM operators GROUP BY name)
SELECT id, name_id, name, substr(t, length(name) + 2) AS rest FROM x JOIN n USING (name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name_id) = 1""")
def longest_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.longest_prefix(_current(spark, sf), "id", "name", table(spark, sf, "operators"))


@query(f"""WITH {_CURRENT_SQL}, c AS (SELECT DISTINCT type, icao_code FROM s WHERE icao_code IS NOT NULL), p AS (SELECT l.type AS l_type, r.type AS r_type FROM t l JOIN t r ON l.rank < r.rank)
SELECT l_type, r_type, icao_code, CASE WHEN count(*) = 2 THEN 'both' WHEN min(type) = l_type THEN 'left' ELSE 'right' END AS side FROM p JOIN c ON type IN (l_type, r_type) GROUP BY l_type, r_type, icao_code""")
def code_sets(spark: SparkSession, sf: str) -> DataFrame:
    def sets(left: DataFrame, right: DataFrame) -> DataFrame:
        v, o = (d.where(F.col("icao_code").isNotNull()).select("icao_code").distinct() for d in (left, right))
        both = v.withColumn("_v", F.lit(True)).join(o.withColumn("_o", F.lit(True)), "icao_code", "full")
        return both.select("icao_code", F.when(F.col("_o").isNull(), "left").when(F.col("_v").isNull(), "right").otherwise("both").alias("side"))

    return _of_pairs(spark, sf, sets)


@query(f"""SELECT a.id, CAST(c.id AS BIGINT) AS country_id, c.tier FROM (SELECT id, country AS t FROM airports UNION ALL SELECT -id, lower(country) FROM airports UNION ALL SELECT id + 1000000000, regexp_extract(country, '^\\S+') FROM airports) a, LATERAL (SELECT id, CASE WHEN a.t = name THEN 1 WHEN lower(a.t) = lower(name) THEN 2 ELSE 3 END AS tier FROM countries WHERE a.t = name OR lower(a.t) = lower(name) OR lower(name) LIKE '%' || lower(a.t) || '%' ORDER BY 2, 1 LIMIT 1) c""")
def country_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Countries as they stand, in small letters, and by their first word, so that each tier is met."""
    a = table(spark, sf, "airports")
    texts = a.select("id", F.col("country").alias("t")).unionByName(a.select((-F.col("id")).alias("id"), F.lower("country").alias("t"))).unionByName(a.select((F.col("id") + 1000000000).alias("id"), F.regexp_extract("country", r"^\S+", 0).alias("t")))
    return resolve.country_cascade(texts, "id", "t", table(spark, sf, "countries"))


@query("SELECT CAST(aircraft_type_id AS BIGINT) AS aircraft_type_id, count(*) AS n_rows, min(id) AS first_id FROM aircraft WHERE aircraft_type_id IS NOT NULL AND aircraft_type_id NOT IN (SELECT id FROM aircraft_types) GROUP BY 1")
def dim_lookup_missing(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.lookup_or_error(table(spark, sf, "aircraft"), "aircraft_type_id", table(spark, sf, "aircraft_types"), "id")[1]


@query("SELECT n.name, o.id AS dim_id, o.id IS NULL AS created FROM (SELECT DISTINCT owner AS name FROM aircraft WHERE trim(owner) <> '') n LEFT JOIN (SELECT name, min(id) AS id FROM operators GROUP BY name) o USING (name)")
def lookup_or_create(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.lookup_or_create(table(spark, sf, "aircraft"), "owner", table(spark, sf, "operators"), key=F.lit(None).cast("long"))


_DENORM = """SELECT a.id, a.icao, a.registration, a.serial_number, a.owner, a.aircraft_name, a.model, t.name AS type_name, t.type_code, o.name AS operator_name, c.name AS country_name
 FROM aircraft a LEFT JOIN aircraft_types t ON a.aircraft_type_id = t.id LEFT JOIN operators o ON a.operator_id = o.id LEFT JOIN countries c ON a.registration_country_id = c.id"""


def _denormalised(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "aircraft").select("id", "icao", "registration", "serial_number", "owner", "aircraft_name", "model", F.col("aircraft_type_id").cast("long").alias("_t"), F.col("operator_id").cast("long").alias("_o"), F.col("registration_country_id").alias("_c"))
    t = table(spark, sf, "aircraft_types").select(F.col("id").alias("_t"), F.col("name").alias("type_name"), "type_code")
    o = table(spark, sf, "operators").select(F.col("id").alias("_o"), F.col("name").alias("operator_name"))
    c = table(spark, sf, "countries").select(F.col("id").alias("_c"), F.col("name").alias("country_name"))
    return a.join(t, "_t", "left").join(o, "_o", "left").join(c, "_c", "left").drop("_t", "_o", "_c")


@query(_DENORM)
def denormalise(spark: SparkSession, sf: str) -> DataFrame:
    return _denormalised(spark, sf)


@query("SELECT o.id AS operator_id, t.type_code, count(*) AS n FROM operators o JOIN aircraft a ON a.operator_id = o.id JOIN aircraft_types t ON a.aircraft_type_id = t.id GROUP BY ALL")
def through_bag(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "aircraft").select(F.col("operator_id").cast("long").alias("op"), F.col("aircraft_type_id").cast("long").alias("ty"))
    hop = resolve.through(a, "op", table(spark, sf, "operators").select("id"), "id", ["op", "ty"])
    types = resolve.through(hop, "ty", table(spark, sf, "aircraft_types").select("id", "type_code"), "id", ["op", "type_code"])
    return types.groupBy(F.col("op").alias("operator_id"), "type_code").agg(F.count("*").alias("n"))


@query("SELECT id, owner FROM aircraft WHERE operator_id IN (SELECT id FROM operators WHERE icao_code IS NOT NULL AND iata_code IS NOT NULL)")
def semi_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "operators").where("icao_code IS NOT NULL AND iata_code IS NOT NULL").select(F.col("id").alias("_o"))
    return table(spark, sf, "aircraft").join(o, F.col("operator_id").cast("long") == F.col("_o"), "left_semi").select("id", "owner")


@query("SELECT id, name FROM airports WHERE flight_information_region_id IS NULL OR flight_information_region_id NOT IN (SELECT id FROM flight_information_regions)")
def anti_required_parent(spark: SparkSession, sf: str) -> DataFrame:
    return validate.without_parent(table(spark, sf, "airports"), "flight_information_region_id", table(spark, sf, "flight_information_regions")).select("id", "name")


# Groups


@query("SELECT manufacturer_id, l[1] AS first_name, array_to_string(l[2:], '; ') AS others FROM (SELECT manufacturer_id, list(name ORDER BY id) FILTER (name IS NOT NULL) AS l FROM aircraft_types GROUP BY 1)")
def group_collect_ordered(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "aircraft_types")
    keys = t.select("manufacturer_id").distinct()
    g = groups.collect_in_order(t.where(F.col("name").isNotNull()), "manufacturer_id", "id", "name", "l")
    first, rest = groups.first_and_rest(F.col("l"))
    out = keys.join(g, keys.manufacturer_id.eqNullSafe(g.manufacturer_id), "left").select(keys.manufacturer_id, "l")
    return out.select("manufacturer_id", first.alias("first_name"), F.array_join(rest, "; ").alias("others"))


@query("SELECT id, last_value(CASE WHEN id % 5 = 0 THEN nullif(trim(type_code), '') END IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS carried FROM aircraft_types")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "aircraft_types").select("id", F.when(F.col("id") % 5 == 0, F.col("type_code")).alias("code"))
    return groups.carry_down(t, None, "id", "code", "carried").select("id", "carried")


@query("SELECT id, trim(name) AS name, trim(city) AS city, trim(icao_code) AS icao_code FROM airports")
def pair_pivot(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "airports")
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.col(c).alias("value")) for i, (label, c) in enumerate((("Name:", "name"), ("City:", "city"), ("ICAO :", "wmo_code"), ("ICAO:", "icao_code")))])
    fields = [fieldmap.Field("Name", "name"), fieldmap.Field("City", "city"), fieldmap.Field("ICAO", "icao_code")]
    return fieldmap.pairs_to_record(a.select("id", F.inline(pairs)), "id", fields)


# Validation and audit


_RULES_SQL = f"""SELECT count(*) AS n, count(*) FILTER (NOT coalesce(regexp_full_match(icao, '[0-9a-fA-F]{{6}}'), false)) AS icao, count(*) FILTER (NOT coalesce(regexp_matches(registration, '{registrations.registration_pattern()}'), false)) AS registration,
 count(*) FILTER (trim(coalesce(serial_number, '')) = '') AS serial_number, count(*) FILTER (trim(coalesce(owner, '')) = '') AS owner, count(*) FILTER (operator_id IS NULL) AS operator, count(*) FILTER (registration_date IS NULL) AS registration_date, count(*) FILTER (status NOT BETWEEN 0 AND 5) AS status FROM aircraft"""


@query(f"UNPIVOT ({_RULES_SQL}) ON COLUMNS(* EXCLUDE n) INTO NAME rule VALUE n_violations".replace("UNPIVOT", "SELECT rule, n_violations FROM (UNPIVOT", 1) + ")")
def validate_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    a, checks = table(spark, sf, "aircraft"), validate.aircraft_rules()
    wide = a.agg(*[F.count_if(~r.ok).alias(r.name) for r in checks])
    return wide.unpivot([], [r.name for r in checks], "rule", "n_violations")


@query("SELECT id, icao_code, icao_code IS NULL OR trim(icao_code) = '' OR row_number() OVER (PARTITION BY lower(icao_code) ORDER BY id) = 1 AS accepted FROM operators")
def unique_ci_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "operators")
    return validate.first_writer(o.select("id", "icao_code"), "icao_code", ["id"])


@query(f"""SELECT 'aircraft' AS importer_type, count(*) AS records_processed, count(*) FILTER (NOT (coalesce(regexp_full_match(icao, '[0-9a-fA-F]{{6}}'), false) AND coalesce(regexp_matches(registration, '{registrations.registration_pattern()}'), false) AND trim(coalesce(serial_number, '')) <> '' AND trim(coalesce(owner, '')) <> ''
 AND operator_id IS NOT NULL AND registration_date IS NOT NULL AND coalesce(status BETWEEN 0 AND 5, true))) AS n_errors, true AS success FROM aircraft""")
def quarantine_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.report(*validate.quarantine(table(spark, sf, "aircraft"), validate.aircraft_rules()), "aircraft")


@query("SELECT icao, count(*) AS n FROM aircraft WHERE icao IS NOT NULL GROUP BY icao HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validate.repeated(table(spark, sf, "aircraft"), "icao")


@query(f"""WITH m AS (SELECT type, month, ref, name, icao_code, iata_code FROM (SELECT *, {_REF_SQL} AS ref, strftime(import_date, '%Y-%m') AS month FROM operator_sources) WHERE ref <> '' AND month IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY type, month, ref ORDER BY import_date DESC, id DESC) = 1),
c AS (SELECT type, month, lead(month) OVER (PARTITION BY type ORDER BY month) AS after, lag(month) OVER (PARTITION BY type ORDER BY month) AS before FROM (SELECT DISTINCT type, month FROM m)),
o AS (SELECT m.type, after AS month, ref, name, icao_code, iata_code FROM m JOIN c USING (type, month) WHERE after IS NOT NULL), n AS (SELECT m.* FROM m JOIN c USING (type, month) WHERE before IS NOT NULL)
SELECT coalesce(o.type, n.type) AS type, coalesce(o.month, n.month) AS snapshot, coalesce(o.ref, n.ref) AS item_id, CASE WHEN o.ref IS NULL THEN 'create' WHEN n.ref IS NULL THEN 'destroy' ELSE 'update' END AS event,
 concat_ws(',', CASE WHEN o.name IS DISTINCT FROM n.name THEN 'name' END, CASE WHEN o.icao_code IS DISTINCT FROM n.icao_code THEN 'icao_code' END, CASE WHEN o.iata_code IS DISTINCT FROM n.iata_code THEN 'iata_code' END) AS changed
 FROM o FULL JOIN n ON o.type = n.type AND o.month = n.month AND o.ref = n.ref WHERE o.ref IS NULL OR n.ref IS NULL OR o.name IS DISTINCT FROM n.name OR o.icao_code IS DISTINCT FROM n.icao_code OR o.iata_code IS DISTINCT FROM n.iata_code""")
def history_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each month of each type against the type's month before; rows without source_ref can't be followed and are left out."""
    s = table(spark, sf, "operator_sources").select("id", "type", F.date_format("import_date", "yyyy-MM").alias("snapshot"), "import_date", "name", "icao_code", "iata_code", F.trim(members(F.col("data"))["source_ref"]).alias("ref"))
    rows = latest_rows(s.where("ref <> '' AND snapshot IS NOT NULL"), ["type", "snapshot", "ref"], ["import_date", "id"])
    log = audit.snapshot_versions(rows, "type", "snapshot", "ref", ["name", "icao_code", "iata_code"], "OperatorSource")
    return log.select("type", "snapshot", "item_id", "event", F.array_join("changed", ",").alias("changed"))


# Search and pages

_ATTRIBUTES = ["icao", "registration", "serial_number", "owner", "aircraft_name", "model", "type_name", "type_code", "operator_name"]
_WORDS = [("shedanesha", 2, False), ("leasng", 1, True)]


def _search_sql() -> str:
    words = "list_filter(string_split_regex(lower(coalesce(CAST({c} AS VARCHAR), '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    post = " UNION ALL ".join(f"SELECT id, {r} AS attribute, unnest({words.format(c=a)}) AS term FROM d" for r, a in enumerate(_ATTRIBUTES))
    # Each character beyond ASCII counts as one, which no searched word has.
    plain = "regexp_replace(term, '[^ -~]', '?', 'g')"
    hits = " UNION ALL ".join(f"SELECT id, min({d}) AS typos, min(attribute) AS attribute, max(CASE WHEN term = '{w}' THEN 1 ELSE 0 END) AS exact FROM p WHERE {d} IS NOT NULL GROUP BY id" for w, d in (
        (w, f"CASE WHEN term = '{w}' THEN 0 " + (f"WHEN starts_with(term, '{w}') THEN 0 " if last else "") + f"WHEN levenshtein({plain}, '{w}') <= {k} THEN levenshtein({plain}, '{w}') END") for w, k, last in _WORDS))
    return f"WITH d AS ({_DENORM}), p AS ({post}), h AS ({hits}) SELECT id, CAST(count(*) AS INT) AS n_words, CAST(sum(typos) AS INT) AS n_typos, min(attribute) AS best_attribute, CAST(sum(exact) AS INT) AS exact FROM h GROUP BY id"


@query(_search_sql())
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    d = _denormalised(spark, sf).select("id", *_ATTRIBUTES)
    return search.search(search.postings(d, "id", _ATTRIBUTES), "id", " ".join(w for w, _, _ in _WORDS))


@query("SELECT id, registration FROM aircraft WHERE (registration, id) > ('VH-', 0) ORDER BY registration, id LIMIT 25")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.after(table(spark, sf, "aircraft").select("id", "registration"), ["registration", "id"], ("VH-", 0), 25)


@query("SELECT *, CAST(ceil((SELECT count(*) FROM aircraft) / 25.0) AS INT) AS n_pages, false AS is_last_page FROM (SELECT id, registration FROM aircraft ORDER BY registration NULLS FIRST, id LIMIT 25 OFFSET 50)")
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(table(spark, sf, "aircraft").select("id", "registration"), ["registration", "id"], 3, 25)


# Text sources


@query("SELECT CAST(manufacturer_id AS INT) AS manufacturer_id, CAST(row_number() OVER (PARTITION BY manufacturer_id ORDER BY id) - 1 AS INT) AS pos, coalesce(trim(type_code), '') AS code, coalesce(trim(name), '') AS name FROM aircraft_types WHERE manufacturer_id IS NOT NULL")
def html_table(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one table each are built and read back."""
    row = F.concat(F.lit("<tr><td class='x'>"), F.coalesce("type_code", F.lit("")), F.lit("</td>\n<td> <b>"), F.coalesce("name", F.lit("")), F.lit("</b></td></tr>"))
    pages = groups.collect_in_order(table(spark, sf, "aircraft_types").where(F.col("manufacturer_id").isNotNull()).withColumn("row", row), "manufacturer_id", "id", "row", "rows")
    html = F.concat(F.lit("<p><table><tr><th>Code</th><th>Name</th></tr>"), F.array_join("rows", "\n"), F.lit("</table><table><tr><td>no</td></tr></table>"))
    r = pages.select("manufacturer_id", F.posexplode(text_sources.table_rows(html)).alias("pos", "r"))
    return r.select("manufacturer_id", "pos", F.col("r")[0].alias("code"), F.col("r")[1].alias("name"))


@query("SELECT id, coalesce(trim(name), '') AS name, coalesce(trim(city), '') AS city FROM airports")
def html_pairs(spark: SparkSession, sf: str) -> DataFrame:
    div = lambda label, c: F.concat(F.lit(f"<div class='row-header'>{label}:</div><div class='big row-detail'><i>"), F.coalesce(c, F.lit("")), F.lit("</i></div>"))
    pages = table(spark, sf, "airports").select("id", F.concat(F.lit("<fieldset>"), div("Name", "name"), div("City", "city"), F.lit("</fieldset>")).alias("html"))
    pairs = text_sources.labelled_pairs(pages, "id", "html", ("row-header", "row-detail"))
    return fieldmap.pairs_to_record(pairs, "id", [fieldmap.Field("Name", "name"), fieldmap.Field("City", "city")])


