import re

import pytest
from pyspark.sql import functions as F

from skyledger.functions import registrations, rules, scalars
from skyledger.functions.dates import any_date
from skyledger.functions.jsonx import canonical, members
from skyledger.functions.similarity import jaro_winkler, one_typo


def values(spark, rows, fn, schema="s string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[1] for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_registration_codes(spark):
    regs = ["VH-AAA", "VH-AAB", "VH-ABA", "VH-BAA", "VH-999", "vh-aaa", "N123", None, ""]
    assert values(spark, regs, registrations.registration_to_hex) == ["7C0000", "7C0001", "7C0024", "7C0510", "7CB63F", None, None, None, None]
    assert values(spark, ["7C0024", "7cb63f", "7CC000", "7Cf", None], registrations.hex_to_registration) == ["VH-ABA", "VH-999", None, None, None]


def test_every_registration_code_comes_back(spark):
    a = registrations.ALPHABET
    df = spark.range(46656).select(F.concat(F.lit("VH-"), *[F.substring(F.lit(a), (F.floor(F.col("id") / d) % 36 + 1).cast("int"), F.lit(1)) for d in (1296, 36, 1)]).alias("r"))
    df = df.select("r", registrations.registration_to_hex(F.col("r")).alias("h")).select("r", "h", registrations.hex_to_registration(F.col("h")).alias("b"))
    assert df.where(~F.col("b").eqNullSafe(F.col("r"))).count() == 0
    assert df.select("h").distinct().count() == 46656


def test_registration_shapes(spark):
    good = ["N12345", "G-ABCD", "VH-ABC", "vh-abc", "C-FABC", "CF-ABC", "JA1234", "JA1234X", "RA-1234", "RA-ABC", "B-1234", "XA-ABC", "RP-C1234", "F-OABC", "2-ABCD", "LXAB"]
    bad = ["", None, "VH-AB1", "N123456", "VH-ABCD", "G-AB1D", "XD-ABC", "ABC", "VH-ABC\n"]
    assert values(spark, good + bad, registrations.valid_registration) == [True] * len(good) + [False] * len(bad)


def test_alt_names(spark):
    text = "en|Long Name|=de|Andere Linie|=sign|XYZW|=en|Last Name|"
    assert values(spark, [text, None, "", "|"], scalars.alt_names) == [["Long Name", "Andere Linie", "Last Name"], None, [], []]
    two = "sign|AAAA|x|abbr|BBBB|Third Name"
    assert values(spark, [two], scalars.alt_names) == [["sign", "abbr", "Third Name"]]
    assert values(spark, [two], lambda c: scalars.alt_names(c, literal=True)) == [["sign", "abbr", "BBBB"]]


def test_brackets_and_lines(spark):
    assert values(spark, ["ACME (FRANCE)", "A (B) (C)", "A", None], scalars.country_in_brackets) == ["FRANCE", "B) (C", None, None]
    assert values(spark, ["ACME (FRANCE)", "A (B) (C)"], scalars.without_brackets) == ["ACME", "A"]
    assert values(spark, ["X Ltd\r\n1 Street"], scalars.first_address_line) == ["X Ltd"]
    assert values(spark, ["New Zealand\nhex  C82 ABC12 \n"], scalars.last_word_of_last_line) == ["ABC12"]


def test_cabin(spark):
    assert values(spark, ["F12J30Y200", "N8", "", None], scalars.cabin_classes) == [["12 First Class", "30 Business Class", "200 Economy"], ["8 Economy"], [], []]
    assert values(spark, ["N8Q2"], lambda c: scalars.cabin_classes(c, literal=True)) == [["8 Other", "2 Other"]]


def test_titles(spark):
    assert values(spark, ["QANTAS_airways", "x-ray camelCase", "the ICAO office", "o'neil (air) ltd", None], scalars.titleize) == ["Qantas Airways", "X Ray Camel Case", "The ICAO Office", "O'neil (Air) Ltd", None]


def test_folds(spark):
    model = lambda r: lambda c: rules.fold(c, r)
    assert values(spark, ["A320-232", "B737-838", "PC-12/47E", "BD-500-1A11", None], model(rules.MODEL_FAMILY)) == ["A320-200", "B737-800", "PC-12", "A220-300", None]
    assert values(spark, ["Piper Aircraft Corp", "Textron Aviation Inc.", "the boeing company", "LEONARDO S.P.A. HELI"], model(rules.MANUFACTURERS)) == ["Piper", "Textron Aviation", "Boeing", "Leonardo"]
    assert values(spark, ["ACME PTY LTD", "QANTAS AIRWAYS LIMITED", "COMMONWEALTH OF AUSTRALIA (DEPARTMENT OF DEFENCE)", "CAPITEQ"], model(rules.OPERATORS)) == ["ACME", "Qantas", "Defence Australia", "Airnorth (Capiteq Pty Ltd)"]
    assert values(spark, ["COMMONWEALTH OF AUSTRALIA (DEPARTMENT OF DEFENCE)"], model(rules.OPERATORS_BRACKETS_AS_GROUPS)) == ["COMMONWEALTH OF AUSTRALIA (DEPARTMENT OF DEFENCE)"]
    assert values(spark, ["Royal Flying Doctor Service (Qld)", "State Of New South Wales Represented By Nsw Police Force"], model(rules.OPERATOR_NAMES)) == ["Royal Flying Doctor Service", "NSW Police Force"]
    assert values(spark, ["A3200-232", "EMB-505", "DA 40"], model(rules.MODEL_DISPLAY)) == ["A3200-200", "EMB-500 Phenom 300", "DA40"]


#: What stands for the parts of an expression that match more than themselves.
SAMPLES = (
    ("(?i)", ""), (r"\z", ""), (".*$", " and more"), (".*", "X/9"), ("(.*)?", ""), ("(.*)", "Central"), (r"(\d{1,2})\d{2}", "1234"), (r"\d{2,3}", "12"), ("[0-9]{2}", "10"), ("[0-9]{3}", "200"), (r"\d+", "12"), (r"\w*", "B2"), ("(-?)", "-"),
    ("([234]", "(2"), (r"\(?", ""), (r"\)?", ""), (r"\.?", "."), (r"\(", "<"), (r"\)", ">"), ("(", ""), (")", ""), ("<", "("), (">", ")"), ("^", ""), ("$", ""),
)


@pytest.mark.parametrize("name", ["MANUFACTURERS", "MODEL_DISPLAY", "MODEL_FAMILY", "MODEL_ICAO", "OPERATORS", "OPERATOR_NAMES"])
def test_every_rule_fires(spark, name):
    """Literal texts, one for each rule and one in front of a second line, against Python's own substitution."""
    table, texts = getattr(rules, name), []
    for expression, _ in table:
        for a, b in SAMPLES:
            expression = expression.replace(a, b)
        texts += [f"ACME {expression}" if expression.startswith(" ") else expression]
    texts += [t + "\nsecond line" for t in texts] + ["nothing", "", "ACME PTY LTD\nsecond line"]
    fired, want = set(), []
    for t in texts:
        for i, (expression, replacement) in enumerate(table):
            new = re.sub(expression.replace(r"\z", r"\Z"), re.sub(r"\\(\d)", r"\\g<\1>", replacement), t, flags=re.M)
            if new != t:
                fired.add(i)
            t = new
        want.append(t)
    assert values(spark, texts, lambda c: rules.fold(c, table)) == want
    assert set(range(len(table))) - fired == SHADOWED.get(name, set())


#: Rules that never fire, since an earlier rule of the table takes every text that they could.
SHADOWED = {"MODEL_ICAO": {2}}


def test_dates_and_numbers(spark):
    texts = ["2014-08-04", "04.08.2014", "2014/08/04", "20140804", "04 Aug 2014", "4 AUG 2014", " 2014-08-04 ", "2014-13-41", "soon", "", None]
    assert [str(v) for v in values(spark, texts, any_date)] == ["2014-08-04"] * 7 + ["None"] * 4
    assert values(spark, ["12ab", " -3", "x", "", None, "99999999999"], scalars.leading_int) == [12, -3, 0, 0, 0, 0]


def test_prefixes_and_labels(spark):
    assert values(spark, ["a  b c", "", None], scalars.token_prefixes) == [["a", "a b", "a b c"], [], []]
    assert values(spark, [" Name : ", "Name:"], scalars.label_key) == ["Name ", "Name"]


def test_json(spark):
    rows = ['{"a": 1, "b": [" x", "y"], "c": null}', '"{\\"a\\": \\"1\\"}"', "[1]", "no json", "", None]
    got = values(spark, rows, members)
    assert got[0] == {"a": "1", "b": '[" x","y"]', "c": None} and got[1] == {"a": "1"} and got[4] is None and got[5] is None
    assert values(spark, ["1", "1.0", " 1 ", "x ", "", "[]", '[" x","y"]', "+61 2", None], canonical) == ["1.0000000000", "1.0000000000", "1.0000000000", "x", None, None, '["x","y"]', "+61 2", None]


PAIRS = [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("abc", "xyz", 0.0), ("", "a", 0.0), ("same", "same", 1.0), ("crate", "trace", 0.733333), (None, "a", None), ("éa", "ea", 0.666667)]


def test_jaro_winkler(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(F.round(jaro_winkler(F.col("a"), F.col("b")), 6)).collect()]
    assert got == pytest.approx([p[2] for p in PAIRS], nan_ok=True) if None not in got else all((x is None and p[2] is None) or x == pytest.approx(p[2], abs=1e-6) for x, p in zip(got, PAIRS))


def test_one_typo(spark):
    rows = [("abcde", "abcde", True), ("abcde", "abce", True), ("abcde", "abdce", True), ("abcde", "abxye", False), ("abcde", "bacdx", False)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert df.where(~one_typo(F.col("a"), F.col("b")).eqNullSafe(F.col("w"))).count() == 0
