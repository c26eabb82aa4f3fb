"""Field mappings, upserts, resolution, validation, audit, search and text sources."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyledger.operators import audit, fieldmap, groups, resolve, search, upsert, validate
from skyledger.plans import parity, pipelines
from skyledger.sources import text

T = datetime


def test_csv_and_mapping(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Code,Name,ICAO,IATA,PositioningFlightPattern,CharterFlightPattern\nX,"Virgin, Atlantic",VIR ,VS,8\\d\\dP$,9\\d\\d\\d\nY,Abacus,,1B,,\n')
    df = fieldmap.project(text.read_delimited(spark, str(tmp_path / "a.csv")), fieldmap.AIRLINES_A, data="data")
    got = [tuple(r)[:5] for r in df.orderBy("name").collect()]
    assert got == [("Abacus", None, "1B", None, None), ("Virgin, Atlantic", "VIR", "VS", "8\\d\\dP$", "9\\d\\d\\d")]
    (tmp_path / "b.csv").write_text('Code^Name\nA^FOO "BAR" BAZ\nB^"X" Y\nC^\n')
    assert [tuple(r) for r in text.read_delimited(spark, str(tmp_path / "b.csv"), sep="^", liberal=True).orderBy("Code").collect()] == [("A", 'FOO "BAR" BAZ'), ("B", '"X" Y'), ("C", None)]
    (tmp_path / "c.csv").write_text("Mark,Date First-Reg\n0123,2001-02-03\n")
    assert text.read_delimited(spark, str(tmp_path / "c.csv"), symbols=True).collect()[0].asDict() == {"mark": "0123", "date_first_reg": "2001-02-03"}


def airlines(spark, tmp_path, rows):
    head = "pk^validity_from^validity_to^3char_code^2char_code^num_code^name^name2^wiki_link^alt_names"
    p = tmp_path / f"o{abs(hash(str(rows)))}.csv"
    p.write_text("\n".join([head, *["^".join((f"air-{slug}", f, t, i, a, "", n, "", "", "")) for slug, i, a, n, f, t in rows]]) + "\n")
    return text.read_delimited(spark, str(p), sep="^")


CASES = {
    "expired only": ([("vista", "AJD", "GT", "flyvista", "2014-08-04", "2015-05-31")], []),
    "expired and valid": ([("abakan-v1", "ABG", "4R", "Abakan-Avia", "1992-01-01", "2014-07-10"), ("abakan-v2", "ABG", "RL", "Royal Flight", "2014-07-11", "")], [("ABG", "RL", "Royal Flight")]),
    "one longer code": ([("amelia", "AIA", "8R", "Amelia", "2020-02-01", ""), ("avies", "AIA", "U3", "Avies", "", "")], [("AIA", "8R", "Amelia"), ("AIA", "U3", "Avies")]),
    "one shorter code": ([("nj-a", "EJA", "1I", "Netjets Aviation", "", ""), ("nj-e", "NJE", "1I", "Netjets Europe", "", "")], [("EJA", "1I", "Netjets Aviation"), ("NJE", "1I", "Netjets Europe")]),
    "single": ([("qantas", "QFA", "QF", "Qantas", "1921-03-01", "")], [("QFA", "QF", "Qantas")]),
}


@pytest.mark.parametrize("case", CASES)
def test_airline_versions_import(spark, tmp_path, case):
    rows, want = CASES[case]
    got = pipelines.import_airline_versions(pipelines.empty_source(spark), airlines(spark, tmp_path, rows), "2025-01-01").where("outcome <> 'kept'")
    assert sorted((r.icao_code, r.iata_code, r.name) for r in got.collect()) == want


def test_airline_that_ends_later(spark, tmp_path):
    first = pipelines.import_airline_versions(pipelines.empty_source(spark), airlines(spark, tmp_path, [("va", "VOZ", "DJ", "Virgin", "2000-08-31", "")]), "2010-01-01").drop("outcome")
    again = pipelines.import_airline_versions(first, airlines(spark, tmp_path, [("va", "VOZ", "DJ", "Virgin", "2000-08-31", "2012-12-31")]), "2013-01-01").collect()
    assert [(r.validity_from, r.validity_to, r.outcome) for r in again] == [("2000-08-31", "2012-12-31", "updated")]


def test_airlines_import_by_code_or_name(spark):
    rows = [("Abacus", None, "1B"), ("EDS", None, "1C"), ("Radixx", None, "1D"), ("Dynamic", "DYA", "2D"), ("Eastern", "EAL", "2D"), ("Data Systems", "FBW", None), ("Data Network", "FBW", None), (None, None, None)]
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no int, name string, icao_code string, iata_code string")
    got = pipelines.import_airlines(None, batch, "2025-01-01")
    assert sorted((r.icao_code or "", r.iata_code or "", r.name) for r in got.collect()) == [("", "1B", "Abacus"), ("", "1C", "EDS"), ("", "1D", "Radixx"), ("DYA", "2D", "Dynamic"), ("EAL", "2D", "Eastern"), ("FBW", "", "Data Network")]
    again = pipelines.import_airlines(got.drop("outcome"), batch, "2026-01-01")
    assert {r.outcome for r in again.collect()} == {"unchanged"} and {str(r.import_date)[:4] for r in again.collect()} == {"2025"}


S = "id long, name string, icao_code string, iata_code string"


def test_combine(spark):
    left = spark.createDataFrame([(1, "Alpha", "AAA", "A1"), (2, "Beta Air", "BBB", None), (3, "Gamma", None, "G1"), (4, "Delta", None, None), (5, "Echo", "aaa", "E1"), (6, "Other", "AAA", None)], S)
    right = spark.createDataFrame([(10, "Alpha", "AAA", "A9"), (11, "Beta Airways", "BBB", "B1"), (12, "Gamma", "GGG", "G1"), (13, "Gamma", "GGH", "G1"), (14, "Zulu", "ZZZ", "Z1"), (15, None, "NNN", "N1")], S)
    ok, bad = resolve.combine(left, right)
    got = {(r.phase, r.src): (r.name, r.icao_code, r.iata_code) for r in ok.collect()}
    assert got == {(1, 1): ("Alpha", "AAA", "A1"), (1, 2): ("Beta Air", "BBB", "B1"), (1, 3): ("Gamma", "GGG", "G1"), (1, 4): ("Delta", None, None), (2, 13): ("Gamma", "GGH", "G1"), (2, 14): ("Zulu", "ZZZ", "Z1")}
    assert {(r.src, tuple(r.errors)) for r in bad.collect()} == {(5, ("icao_code",)), (6, ("icao_code taken",)), (15, ("name",))}
    ok, bad = resolve.combine(left.limit(0), right.limit(0))
    assert ok.count() == 0 and bad.count() == 0


def test_fuzzy_threshold(spark):
    left = spark.createDataFrame([(1, "Northern Air", None, "N1"), (2, "Qqq", None, "N1")], S)
    right = spark.createDataFrame([(10, "Northern Airlines", "NOR", "N1"), (11, "Northern Airlines", "NOS", "N1")], S)
    assert [(r.l_id, r.r_id) for r in resolve.fuzzy_matches(left, right).collect()] == [(1, 10)]


def test_country_cascade(spark):
    c = spark.createDataFrame([(1, "Niger"), (2, "Nigeria"), (3, "AUSTRALIA")], "id long, name string")
    d = spark.createDataFrame([(1, "Nigeria"), (2, "australia"), (3, "ger"), (4, "None"), (5, None)], "k int, t string")
    assert sorted(tuple(r) for r in resolve.country_cascade(d, "k", "t", c).collect()) == [(1, 2, 1), (2, 3, 2), (3, 1, 3)]


def test_longest_prefix(spark):
    n = spark.createDataFrame([(1, "Piper"), (2, "Piper Aircraft"), (3, "Piper Aircraft")], "id long, name string")
    d = spark.createDataFrame([(1, "Piper Aircraft PA-28"), (2, "Cessna 172"), (3, None), (4, "Piper")], "k int, t string")
    assert sorted(tuple(r) for r in resolve.longest_prefix(d, "k", "t", n).collect()) == [(1, 2, "Piper Aircraft", "PA-28"), (4, 1, "Piper", "")]


def test_validation_modes(spark):
    df = spark.createDataFrame([("A", "ABC", "A1"), ("", "abc", None), (None, None, "")], "name string, icao_code string, iata_code string")
    ok, bad = validate.quarantine(df, validate.operator_rules())
    assert ok.count() == 1 and sorted(tuple(r.errors) for r in bad.collect()) == [("name",), ("name", "icao_code")]
    assert validate.quarantine(df, validate.operator_rules(), "off")[0].count() == 3
    with pytest.raises(Exception, match="invalid"):
        validate.quarantine(df, validate.operator_rules(), "fail")[0].collect()
    assert validate.report(ok, bad, "x").collect()[0].asDict() == {"importer_type": "x", "records_processed": 3, "n_errors": 2, "success": True}


def test_audit(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, n string, m string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", "z"), (4, "d", None)], "id int, n string, m string")
    got = {r.item_id: (r.event, r.object_changes) for r in audit.versions(old, new, "id", ["n", "m"], "X", "me").collect()}
    assert got[2] == ("update", '{"m":["x","z"]}') and got[3][0] == "destroy" and got[4][0] == "create" and 1 not in got


def test_search_and_pages(spark):
    d = spark.createDataFrame([(1, "Qantas Airways", "VH-ABC"), (2, "Quantas", "VH-QAN"), (3, None, "VH-ZZZ")], "id int, owner string, reg string")
    ix = search.postings(d, "id", ["reg", "owner"])
    assert [r.id for r in search.search(ix, "id", "qantas").collect()] == [1, 2]
    assert [r.id for r in search.search(ix, "id", "vh qa").collect()] == [1, 2, 3] or [r.id for r in search.search(ix, "id", "vh qan").collect()][:2] == [2, 1]
    assert [r.id for r in search.search(ix, "id", " ").collect()] == [1, 2, 3]
    p = search.page(d, ["id"], 2, 2).collect()
    assert [(r.id, r.n_pages, r.is_last_page) for r in p] == [(3, 2, True)]


def test_carry_down_across_ranges(spark):
    groups_range, groups.RANGE = groups.RANGE, 3
    try:
        d = spark.createDataFrame([(1, "A"), (2, ""), (4, None), (7, "B"), (9, None), (20, None)], "pos int, code string")
        assert [r.c for r in groups.carry_down(d, None, "pos", "code", "c").orderBy("pos").collect()] == ["A", "A", "A", "B", "B", "B"]
    finally:
        groups.RANGE = groups_range


def test_makers_from_html(spark):
    html = "<table><tr><th>C</th><th>N</th></tr><tr><td>A</td><td>n1 (FRANCE)</td></tr><tr><td></td><td>n2 (FRANCE)</td></tr><tr><td>B</td><td></td></tr><tr><td></td><td>n3</td></tr></table>"
    got = pipelines.makers_from_html(spark.createDataFrame([(html,), (None,), ("",)], "html string")).collect()
    assert [(r.icao_code, r.name, r.country, r.alt_names) for r in got] == [("A", "n1", "FRANCE", ["n2", "n3"])]


def test_register(spark):
    page = "".join(f"<div class='row-header'>{a}:</div><div class='row-detail'>{b}</div>" for a, b in (("Aircraft model", "A320-232"), ("Serial", "12"), ("Number of engines", "2x"), ("Date first registered", "1 Feb 2001"), ("Odd", "x")))
    pairs = text.labelled_pairs(spark.createDataFrame([("VH-ABC", page), ("VH-NIL", None)], "reg string, html string"), "reg", "html", ("row-header", "row-detail"))
    r = fieldmap.pairs_to_record(pairs, "reg", fieldmap.REGISTER_PAGE_A).collect()
    assert len(r) == 1 and (r[0].model, r[0].serial_number, r[0].engine_count, r[0].registration_date) == ("A320-200", "12", 2, date(2001, 2, 1))


def test_register_csv(spark):
    head = "mark string, model string, icaotypedesig string, datefirstreg string, serial string, regholdname string, regopname string, engnum string, engmodel string"
    csv = spark.createDataFrame([("ABC", "A320-232", "A320", "2001-02-03", "0012", "Holder", "ACME PTY LTD", "2", "X"), ("ABD", "Z", "ZZZZ", "", "1", "", None, "", None), ("ABD", "Z", "ZZZZ", "", "1", "H2", None, "", None)], head).withColumn("row_no", F.monotonically_increasing_id())
    types = spark.createDataFrame([(7, "A320")], "id long, type_code string")
    ops = spark.createDataFrame([(3, "ACME")], "id long, name string")
    ok, bad, missing = pipelines.import_register(csv, types, ops, country_id=1)
    assert [(r.registration, r.icao, r.aircraft_type_id, r.operator_id, r.serial_number) for r in ok.collect()] == [("VH-ABC", "7C0026", 7, 3, "0012")]
    assert bad.count() == 1 and [r.type_code for r in missing.collect()] == ["ZZZZ"]
    assert T(2024, 1, 1)


def test_merge_stamps_only_changes(spark):
    c = spark.createDataFrame([("a", 1, T(2020, 1, 1)), ("b", None, T(2020, 1, 1)), ("c", 3, T(2020, 1, 1))], "k string, v int, at timestamp")
    b = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, v int")
    got = {r.k: (r.v, r["at"].year, r.outcome) for r in upsert.merge(c, b, "k", ["v"], "at", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": (1, 2020, "unchanged"), "b": (2, 2024, "updated"), "c": (3, 2020, "kept"), "d": (4, 2024, "inserted")}


def _slow_jaro_winkler(a, b):
    w, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - w), min(len(b), i + w + 1)) if b[j] == c and j not in used), None)
        if j is not None:
            used.add(j)
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    j = (m / len(a) + m / len(b) + (m - sum(x != b[y] for x, y in zip(mine, sorted(used))) // 2) / m) / 3
    prefix = next((k for k in range(4, 0, -1) if a[:k] == b[:k] and min(len(a), len(b)) >= k), 0)
    return j + prefix * 0.1 * (1 - j) if j >= 0.7 else j


def _folder(spark, path):
    """Tables of three types, several months and names with accents."""
    rows = []

    def add(i, kind, day, ref, name, icao, iata):
        rows.append((i, icao, iata, name, kind, T.fromisoformat(day), f'{{"source_ref": "{ref}"}}' if ref else "{}"))

    add(1, "V", "2024-01-05", "a", "Café", "CAF", "C1")
    add(2, "V", "2024-03-05", "a", "Café Álta", "CAF", "C1")
    add(3, "V", "2024-03-05", "b", "Late One", None, "L1")
    add(4, "O", "2024-01-05", "a", "Café Álta", "CAF", None)
    add(5, "O", "2024-02-05", "c", "Cafe Alta", "CAG", "C2")
    add(6, "R", "2024-01-05", "x", "Late Óne", "LAT", "L1")
    add(7, "R", "2024-02-05", "x", "Late Óne", "LAT", "L1")
    add(8, "R", "2024-02-05", "y", "Élan", "ELA", " ")
    add(9, "V", "2024-02-05", "", "Sole", "SOL", None)
    spark.createDataFrame(rows, "id long, icao_code string, iata_code string, name string, type string, import_date timestamp, data string").write.parquet(f"{path}/operator_sources.parquet")
    spark.createDataFrame([("R", 3), ("V", 2), ("O", 1)], "type string, trust int").write.parquet(f"{path}/source_types.parquet")
    spark.createDataFrame([(1, "Café", None, "C1"), (2, "Cafe", None, "C1"), (3, "Élan", "ELA", None)], "id long, name string, icao_code string, iata_code string").write.parquet(f"{path}/operators.parquet")
    c = [(1, "A", "2024-01-01", "at", "Österreich"), (2, "A", "2024-06-01", "AT", "Austria"), (3, "B", "2024-06-01", "at ", "Austria"), (4, "B", "2024-01-01", "FR", "France"), (5, "B", "2024-07-01", "FR", "France")]
    spark.createDataFrame([(i, iso, n, None, None, k, T.fromisoformat(d)) for i, k, d, iso, n in c], "id long, iso_2char_code string, name string, capital string, iso_3char_code string, type string, import_date timestamp").write.parquet(f"{path}/country_sources.parquet")
    return str(path)


def test_whole_tables(spark, tmp_path):
    sf = _folder(spark, tmp_path)
    got = lambda q: {tuple(r) for r in parity.QUERIES[q](spark, sf).collect()}
    assert got("entity_resolve_merge") == {
        (1, 7, "Late Óne", "LAT", "L1", ""), (1, 8, "Élan", "ELA", None, ""), (2, 2, "Café Álta", "CAF", "C1", ""), (2, 3, "Late One", None, "L1", ""), (2, 9, "Sole", "SOL", None, ""), (3, 5, "Cafe Alta", "CAG", "C2", ""),
    }
    assert got("exact_match") == {("V", "O", 2, 4)}
    names = {("Café Álta", "Café"), ("Café Álta", "Cafe")}
    assert got("jaro_winkler_pairs") == {(a, b, round(_slow_jaro_winkler(a, b), 6)) for a, b in names}
    assert got("longest_prefix_join") == {(2, 1, "Café", "Álta"), (4, 1, "Café", "Álta"), (5, 2, "Cafe", "Alta"), (8, 3, "Élan", "")}
    assert got("code_sets") == {
        ("R", "V", "LAT", "left"), ("R", "V", "ELA", "left"), ("R", "V", "CAF", "right"), ("R", "V", "SOL", "right"), ("R", "O", "LAT", "left"), ("R", "O", "ELA", "left"), ("R", "O", "CAF", "right"), ("R", "O", "CAG", "right"),
        ("V", "O", "CAF", "both"), ("V", "O", "SOL", "left"), ("V", "O", "CAG", "right"),
    }
    assert got("history_diff") == {
        ("V", "2024-03", "a", "update", "name"), ("V", "2024-03", "b", "create", "name,iata_code"), ("O", "2024-02", "a", "destroy", "name,icao_code"), ("O", "2024-02", "c", "create", "name,icao_code,iata_code"), ("R", "2024-02", "y", "create", "name,icao_code,iata_code"),
    }
    assert got("upsert_merge_changed") == {
        ("A", "AT", "Austria", None, None, "2024-09-01 00:00:00", "updated"), ("B", "AT", "Austria", None, None, "2024-09-01 00:00:00", "inserted"), ("B", "FR", "France", None, None, "2024-01-01 00:00:00", "unchanged"),
    }


def test_merge_of_all_sources_keeps_rejected_rows(spark):
    side = lambda *r: spark.createDataFrame(r, S)
    got = {(r.phase, r.src, tuple(r.errors)) for r in resolve.combine_all([side((1, "One", "AAA", None), (2, "Two", "aa", None)), side((11, "Other", "aaa", None)), side((21, "One", "AAA", "A1"), (22, None, "CCC", None))]).collect()}
    assert got == {(1, 1, ()), (1, 2, ("icao_code",)), (2, 11, ("icao_code",)), (3, 22, ("name",))}
    assert [tuple(r.errors) for r in resolve.combine_all([side((1, "One", "AAA", None))]).collect()] == [()]


def test_imports_keep_every_field(spark, tmp_path):
    """Callsign patterns and alternative names come along; rows that break a rule are collected."""
    batch = spark.createDataFrame([(1, "Virgin", "VIR", "VS", "8\\d", None)], "row_no int, name string, icao_code string, iata_code string, positioning_callsign_pattern string, charter_callsign_pattern string")
    got = pipelines.import_airlines(None, batch, "2025-01-01").collect()[0]
    assert (got.positioning_callsign_pattern, got.charter_callsign_pattern) == ("8\\d", None)
    head = "pk^validity_from^validity_to^3char_code^2char_code^num_code^name^name2^wiki_link^alt_names"
    (tmp_path / "v.csv").write_text("\n".join([head, "air-pal^^^PAL^PR^^Philippine Airlines^^^en|PAL Express|=en|Air Philippines|", "air-x^^^xx^PX^^Bad Code^^^", "air-y^^^^^^No Code^^^", "not-z^^^ZZZ^ZZ^^Other^^^"]) + "\n")
    table, bad, report = pipelines.checked_airline_versions(pipelines.empty_source(spark), text.read_delimited(spark, str(tmp_path / "v.csv"), sep="^"), "2025-01-01")
    assert [(r.icao_code, r.alt_names) for r in table.collect()] == [("PAL", ["PAL Express", "Air Philippines"])]
    assert sorted((r.name, tuple(r.errors)) for r in bad.collect()) == [("Bad Code", ("icao_code",)), ("No Code", ("code",))]
    assert tuple(report.collect()[0])[:3] == ("OpenTravel", 3, 2)
    makers = spark.createDataFrame([(1, "BOEING", "Old"), (2, "BOEING", "Boeing"), (3, "", "None"), (4, "X", None)], "row_no int, Code string, Name string")
    assert [tuple(r)[:2] for r in pipelines.import_makers(makers, "2025-01-01").collect()] == [("BOEING", "Boeing")]
    schema = "iso_2char_code string, iso_3char_code string, iso_num_code string, name string, capital string"
    src = spark.createDataFrame([("AT", "AUT", "040", "Austria", "Vienna"), ("FR", "FRA", "250", "France", "Paris")], schema)
    old = spark.createDataFrame([("AT", "AUT", "040", "Austria", None), ("ES", "ESP", "724", "Spain", "Madrid")], schema).withColumn("updated_at", F.lit(T(2020, 1, 1)))
    assert {(r.iso_2char_code, r.capital, r.outcome) for r in pipelines.combine_countries(src, old, "2025-01-01").collect()} == {("AT", "Vienna", "updated"), ("FR", "Paris", "inserted"), ("ES", "Madrid", "kept")}


def test_alternative_names_in_fuzzy_matches(spark):
    left = spark.createDataFrame([(1, "Air Philippines", "PAL", None)], S)
    right = spark.createDataFrame([(2, "Zzz", "PAL", "PR", ["Air Philippines"]), (3, "Air Phil", "PAL", "P2", None)], S + ", alt array<string>")
    assert [(r.r_id, r.confidence) for r in resolve.fuzzy_matches(left, right, "alt").collect()] == [(2, 1.0)]
    assert [r.r_id for r in resolve.fuzzy_matches(left, right).collect()] == [3]


def test_lookups_by_canonical_name(spark):
    dim = spark.createDataFrame([(5, "Qantas"), (6, "Qantas Link"), (7, "Acme Air Cargo"), (8, "Acme"), (9, None)], "id long, name string")
    names = spark.createDataFrame([("QANTAS AIRWAYS LIMITED",), ("ACME AIR PTY LTD",), ("NEWCO PTY LTD",), (" ",), (None,), ("NEWCO PTY LTD",)], "owner string")
    got = {r.name: (r.title, r.dim_id, r.created) for r in resolve.search_or_create(names, "owner", dim, F.lit(-1).cast("long")).collect()}
    assert got == {"QANTAS AIRWAYS LIMITED": ("Qantas", 5, False), "ACME AIR PTY LTD": ("Acme Air", 7, False), "NEWCO PTY LTD": ("Newco", -1, True)}
    makers = spark.createDataFrame([(1, "Boeing"), (2, "Textron Aviation"), (3, "Boeing")], "id long, name string")
    df = spark.createDataFrame([("The Boeing Company", 1), ("TEXTRON AVIATION INC", 2), ("Unknown", 3), (None, 4)], "maker string, k int")
    assert {r.k: r.maker_id for r in resolve.lookup_maker(df, "maker", makers).collect()} == {1: 1, 2: 2, 3: None, 4: None}
    types = spark.createDataFrame([(10, 2, "172"), (11, 2, "172"), (12, 1, "172")], "id long, manufacturer_id int, name string")
    models = spark.createDataFrame([(1, "Textron Aviation 172"), (2, "Textron Aviation 999"), (3, "Foo 172")], "k int, model string")
    assert {tuple(r) for r in resolve.lookup_type(models, "k", "model", makers, types).collect()} == {(1, 2, 10), (2, 2, None)}


def test_patterns_and_pages(spark):
    df = spark.createDataFrame([("8\\d{2}",), ("(",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(validate.compiles(F.col("p"))).collect()] == [True, False, True, True]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), (None, 5), ("c", 9)], "x string, id long")
    assert [tuple(r) for r in search.after(rows, ["x", "id"], None, 2).collect()] == [(None, 5), ("a", 1)]
    assert [tuple(r) for r in search.after(rows, ["x", "id"], ("a", 1), 3).collect()] == [("a", 2), ("b", 0), ("c", 9)]


def test_register_pages(spark):
    cell = lambda a, b: f'<div class="field x"><div>{a}</div><div><b>{b}</b><br></div></div>'
    html = cell("Aircraft model", "A320-232") + cell("ICAO type designator", "A320") + cell("Date first registered", "04 Aug 2014") + cell("Serial", "7") + cell("Registration holder", "X") + cell("Registered operator", "QANTAS AIRWAYS")
    pages = spark.createDataFrame([("ABC", html), ("VH-ABD", html)], "registration string, html string")
    types, ops = spark.createDataFrame([(1, "A320")], "id long, type_code string"), spark.createDataFrame([(2, "Qantas")], "id long, name string")
    ok, bad, missing = pipelines.import_register_pages(pages, types, ops, 1)
    assert {(r.registration, r.icao, r.aircraft_type_id, r.operator_id, r.model) for r in ok.collect()} == {("VH-ABC", "7C0026", 1, 2, "A320-200"), ("VH-ABD", "7C0027", 1, 2, "A320-200")} and bad.count() == missing.count() == 0
