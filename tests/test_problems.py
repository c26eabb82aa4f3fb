"""The general data problems on small cases: nulls, ties, repeated rows, empty tables, clashing names."""

from datetime import date, datetime

from pyspark.sql import functions as F

from skyledger.operators import history, packed, references, snapshots

T = datetime


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# References


def reference_case(spark, n=1):
    child = spark.createDataFrame(
        [(1, 10, T(2024, 1, 5), "x")] * 1 + [(2, 11, T(2024, 1, 5), "x"), (3, None, T(2024, 1, 6), "x"), (4, 99, T(2024, 2, 1), "x"), (5, 99, None, "x"), (6, 12, T(2024, 1, 31), None)] + [(100 + i, 99, T(2024, 3, 1), "x") for i in range(n)],
        "id long, fk int, created_at timestamp, _key string",
    )
    parent = spark.createDataFrame([(10, T(2023, 1, 1)), (11, T(2024, 1, 6)), (12, T(2024, 1, 31, 1)), (12, T(2025, 1, 1)), (None, T(2020, 1, 1))], "id long, created_at timestamp")
    return child, parent, references.Reference("child", "fk", "parent")


def test_broken_references(spark):
    child, parent, ref = reference_case(spark)
    got = rows(references.broken_references(child, parent, ref), "child_id", "state", "period")
    assert got == [(100, "missing", "2024-03"), (2, "late", "2024-01"), (4, "missing", "2024-02"), (5, "missing", ""), (6, "late", "2024-01")]
    same = rows(references.broken_references(child, parent, ref, heavy_share=2.0), "child_id", "state", "period")
    assert same == got


def test_hot_key_is_split_and_counted(spark):
    child, parent, ref = reference_case(spark, 500)
    got = {r.period: (r.n_references, r.n_missing, r.n_late) for r in references.orphan_report(child, parent, ref).collect()}
    assert got == {"2024-01": (3, 0, 2), "2024-02": (1, 1, 0), "2024-03": (500, 500, 0), "": (1, 1, 0)}


def test_references_of_empty_tables(spark):
    child, parent, ref = reference_case(spark)
    assert references.broken_references(child.limit(0), parent, ref).count() == 0
    assert references.broken_references(child, parent.limit(0), ref).count() == 6
    assert references.orphan_report(child.limit(0), parent, ref).count() == 0


# Snapshots


def test_snapshot_changes(spark):
    m = lambda **k: {a: b for a, b in k.items()}
    data = [
        ("s", "2024-01", "a", m(x="1", y="t")), ("s", "2024-01", "b", m(x="2")), ("s", "2024-01", "c", None), ("s", "2024-01", None, m(x="9")),
        ("s", "2024-03", "a", m(y=" t ", x="1.0", z="")), ("s", "2024-03", "c", m(x="5")), ("s", "2024-03", "d", m()),
        ("t", "2024-03", "a", m(x="1")),
    ]
    df = spark.createDataFrame(data, "series string, snap string, ref string, data map<string,string>")
    got = rows(snapshots.snapshot_changes(df, ["series"], "snap", "ref", "data"), "snap", "ref", "change_kind", F.array_join("changed_fields", ","))
    assert got == [("2024-03", "b", "removed", ""), ("2024-03", "c", "changed", "x"), ("2024-03", "d", "added", "")]
    assert snapshots.snapshot_changes(df.limit(0), ["series"], "snap", "ref", "data").count() == 0


def test_latest_rows_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", None, 9, "z"), (None, 1, 1, "n")], "k string, t int, id int, v string")
    assert rows(snapshots.latest_rows(df, ["k"], ["t", "id"]), "k", "v") == [("a", "y"), (None, "n")]


# History

LINE = "line_id long, delivered_at timestamp, pk string, key string, version string, validity_from string, validity_to string, name string, `3char_code` string, `2char_code` string, _year int"


def line(i, day, pk, f, t, name="N", c3="AAA", c2=None, key=None):
    return (i, T(2023, 1, day), pk, key or pk.rsplit("-v", 1)[0], pk.rsplit("-v", 1)[1], f, t, name, c3, c2, 7)


def chains(spark, lines, delivered=False):
    df = spark.createDataFrame(lines, LINE)
    h = history.delivered_history(df) if delivered else history.airline_history(df)
    return sorted((r.chain, str(r.valid_from or ""), str(r.valid_to or ""), r.name) for r in h.collect())


LINES = [
    line(1, 1, "air-a-v1", None, "1990-01-01"), line(2, 1, "air-a-v2", "1990/01/02", None), line(3, 1, "air-a-v3", "01.06.1995", "19991231", "M"), line(4, 2, "air-a-v3", "01 Jun 1995", "31 Dec 1999", "M2"),
    line(5, 1, "air-b-v1", "2000-05-01", "1999-01-01"), line(6, 1, "air-b-v2", "2000-05-02", ""), line(7, 1, "air-b-v3", "2010-01-01", None, "N2"),
    line(8, 1, "air-c-v1", "2001-01-01", "2001-12-31"), line(9, 1, "air-c-v2", "2003-01-01", None), line(10, 1, "rail-x-v1", "2001-01-01", None), line(11, 3, "air-c-v2", "2003-01-01", "2004-01-01"), line(11, 3, "air-c-v2", "2003-01-01", "2004-01-01"),
]
WANT = [
    ("air-a", "", "1995-05-31", "N"), ("air-a", "1995-06-01", "1999-12-31", "M2"), ("air-b", "1999-01-01", "2009-12-31", "N"), ("air-b", "2010-01-01", "", "N2"),
    ("air-c", "2001-01-01", "2001-12-31", "N"), ("air-c", "2003-01-01", "2004-01-01", "N"),
]


def test_history(spark):
    assert chains(spark, LINES) == WANT
    assert chains(spark, LINES, delivered=True) == WANT
    assert chains(spark, LINES[9:10]) == [] and chains(spark, LINES[9:10], delivered=True) == []


def test_untouched_chains_are_passed_through(spark):
    df = spark.createDataFrame(LINES, LINE)
    late = F.to_date("delivered_at") >= "2023-01-03"
    h = history.airline_history(df.where(~late)).withColumn("name", F.concat("name", F.lit("*")))
    got = {r.chain: r.name for r in history.apply_updates(h, df.where(~late), df.where(late)).collect()}
    assert got["air-a"].endswith("*") and not got["air-c"].endswith("*")


def test_long_chain_across_years(spark):
    lines = [line(i, 1, f"air-z-v{i + 1}", f"{1900 + i}-07-01", f"{1901 + i}-06-30", f"N{i // 3}") for i in range(60)]
    got = chains(spark, lines)
    assert got == chains(spark, lines)
    assert len(got) == 20 and got[0] == ("air-z", "1900-07-01", "1903-06-30", "N0")


def test_published_chains_are_swapped_whole(spark, tmp_path):
    df = spark.createDataFrame(LINES, LINE)
    late = F.to_date("delivered_at") >= "2023-01-03"
    folder = f"file://{tmp_path}/h"
    history.publish(history.airline_history(df.where(~late)), folder)
    before = history.current(spark, folder)
    history.publish(history.apply_updates(before, df.where(~late), df.where(late)), folder)
    after = sorted((r.chain, str(r.valid_from or ""), str(r.valid_to or ""), r.name) for r in history.current(spark, folder).collect())
    assert after == WANT and before.count() == len(WANT)


def test_streamed_deliveries(spark, tmp_path):
    from skyledger.streaming.deliveries import stream_deliveries

    seen = []
    df = spark.createDataFrame(LINES, LINE)
    for part in (df.limit(3), df.where("line_id > 8")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_deliveries(spark, str(tmp_path / "in"), LINE, str(tmp_path / "ck"), lambda b, i: seen.append((i, b.count())))
        q.awaitTermination(60)
    assert [n for _, n in seen] == [3, 4] and [i for i, _ in seen] == [0, 1]


# Packed fields


def split(spark, fields):
    df = spark.createDataFrame([(i, f, "k") for i, f in enumerate(fields)], "line_id long, alt string, value string")
    out = {}
    for r in packed.split_packed(df, "line_id", "alt", "alt_name").orderBy("line_id", "pos").collect():
        out.setdefault(r.line_id, []).append((r.pos, r.alt_name))
    return [[v for _, v in out.get(i, [])] for i in range(len(fields))]


def test_packed_notations(spark):
    tagged = [f"en|Core{chr(97 + i)}x Air|h=en|Core{chr(97 + i)}x, {s}|s=de|Core{chr(97 + i)}x; the Airline|=sign|CORE{chr(65 + i)}|" for i in range(12) for s in ("Ltd.", "Inc.", "Co.")]
    cases = {
        "en|A One|=en| B Two |h = sign|XY|p==": ["A One", "B Two", "XY"], 'en|"Fly=X"|s=en|Y\\|Z|': ["Fly=X", "Y|Z"],
        '["A", "B ""C"]': ['["A"', '"B ""C"]'] and None, '["A", " B\\u0411", "A"]': ["A", "BБ", "A"], '{A,"B, Co.","C \\"D\\""}': ["A", "B, Co.", 'C "D"'],
        "Corax Air;;Corbx Air ; Corax Air": ["Corax Air", "Corbx Air", "Corax Air"], "Corax, Ltd.; Corbx Air\nCorcx Air": ["Corax, Ltd.", "Corbx Air", "Corcx Air"],
        "Corax Air,Corbx Air": ["Corax Air", "Corbx Air"], '"Corax, Co.", Corbx Air': ["Corax, Co.", "Corbx Air"], "Corax Air / Corbx/Ulva Air / ": ["Corax Air", "Corbx/Ulva Air"],
        'Corax Air|"Corbx ""Sky"" Air"': ["Corax Air", 'Corbx "Sky" Air'], ";": [], "": [], "    ": [], None: [], "Corax Air": ["Corax Air"],
    }
    got = split(spark, [*cases, *tagged])
    for (field, want), have in zip(cases.items(), got):
        if want is not None:
            assert have == want, (field, have, want)


def test_packed_edges(spark):
    long = "; ".join(["Corax Air"] * 5000)
    got = split(spark, [long, long, "Corax Air"])
    assert len(got[0]) == 5000 and got[0] == got[1] and got[2] == ["Corax Air"]
    empty = spark.createDataFrame([], "line_id long, alt string")
    assert packed.split_packed(empty, "line_id", "alt").count() == 0
    assert date(2024, 1, 1)
