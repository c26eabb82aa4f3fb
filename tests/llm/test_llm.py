"""The subpackage on small cases: against brute force, exact round trips and planted cases."""

import math
import random
from collections import Counter
from datetime import datetime
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import matching, packing, subjects, survivors, tokens, variants
from skyledger.llm.components import connected_components
from skyledger.llm.names import Words, abbreviates, learn, skeleton

T = datetime

TEXTS = [
    "A plain text, isn't it?  Two  blanks\n\n\nand 12345 digits.", None, "", " ", "\t\t x\r\n\r\ny", "<|endoftext|> is text", "aaaa" * 700, "é ü  z 漢字仮名 العربية", "🙂🙂 👨‍👩‍👧 x",
    "'ll 's'S 're don't", "﷐﷑ odd", " ", "x" * 3 + " " * 40 + "y", "I   'm   here  .", "ab" * 4000, "\x1c\x1d a\x85b", "a\u1c89b \U0002ebf0c \U00010d40\U00010d411 \ua7cbx",
]


def tokenizer():
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    want = tokenizer()
    assert len(got) == len(TEXTS) * 2
    for i, t in enumerate(TEXTS * 2):
        assert got[i] == (want.encode(t, add_special_tokens=False).ids if t else []), (i, t and t[:40])
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_long_words():
    """Words of thousands of letters without a blank: ids of the whole word, in time that goes with its length."""
    want, enc, r = tokenizer(), tokens.Encoder(tokens.load_merges(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")), random.Random(4)
    letters = ["acgt", "ab", "a", "é漢🙂x", "abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789", "0123456789", "=-_", " "]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in letters for n in (47, 48, 49, 96, 700, 3000)] + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))]
    enc.cut(pa.array(texts))
    enc.learn()
    got = enc.query("SELECT doc, flatten(list(ids ORDER BY p)) AS ids FROM cut JOIN known USING (w) GROUP BY doc")
    got = dict(zip(got.column("doc").to_pylist(), got.column("ids").to_pylist()))
    for i, t in enumerate(texts):
        assert got[i] == want.encode(t, add_special_tokens=False).ids, (i, t[:40])


def test_lengths_equal_the_ids(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = {r.doc_id: len(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.measure(df, "doc_id", "text").collect()} == ids


def test_hilbert_neighbours():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(n**3))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
    assert steps.max() == 1


def test_packing(spark):
    random.seed(1)
    sizes = [0, 0, 2048, 2049, 5000, 1, None] + [random.randint(1, 1500) for _ in range(3000)]
    df = spark.createDataFrame([(i, s or 0, random.randint(0, 99), 5) for i, s in enumerate(sizes)], "doc_id long, n_tokens long, curve long, place int")
    out = packing.pack(df, "doc_id", "n_tokens", "curve", 2048, per_partition=800).collect()
    by_doc, by_bin = Counter(), Counter()
    for r in out:
        by_doc[r.doc_id] += r.n_tokens
        by_bin[r.container_id] += r.n_tokens
    assert all(by_doc[i] == (s or 0) for i, s in enumerate(sizes)) and max(by_bin.values()) <= 2048
    assert len({(r.container_id, r.place) for r in out}) == len(out)
    assert [r.piece for r in sorted(out, key=lambda r: r.piece) if r.doc_id == 4] == [0, 1, 2] and sum(r.doc_id == 5 for r in out) == 1
    assert sum(by_bin.values()) / (2048 * len(by_bin)) > 0.97
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", "curve", 2048).count() == 0


def test_containers_hold_neighbours(spark):
    """Along the curve: what shares a container is near each other, where random company would be a third of the curve apart."""
    random.seed(6)
    n = 6000
    df = spark.createDataFrame([(i, random.randint(50, 1500), random.randint(0, n)) for i in range(n)], "doc_id long, n_tokens long, curve long")
    out = packing.pack(df, "doc_id", "n_tokens", "curve", 2048).join(df.select("doc_id", "curve"), "doc_id").toPandas()
    by = out.groupby("container_id")
    assert by["n_tokens"].sum().max() <= 2048 and out["n_tokens"].sum() / (2048 * len(by)) > 0.98
    assert (by["curve"].max() - by["curve"].min()).median() < n / 30
    big = spark.createDataFrame([(i, 1500, i) for i in range(3000)], "doc_id long, n_tokens long, curve long")  # nothing fits with anything
    assert packing.pack(big, "doc_id", "n_tokens", "curve", 2048).select("container_id").distinct().count() == 3000


SRC = "id long, type string, import_date timestamp, data string, trust int"


def test_survivors(spark):
    rows = [
        (1, "B", T(2024, 1, 1), '{"aoc":"QX-1","name":"One","icao_code":"ABC","fleet_size":"0","callsign":"N/A"}', 9),
        (2, "A", T(2024, 1, 1), '{"aoc":" qx.1","name":" ","icao_code":"AB1","iata_code":"--","fleet_size":5}', 9),
        (3, "B", T(2024, 2, 1), '"{\\"aoc\\": \\"QX 1\\", \\"name\\": \\"Two\\", \\"icao_code\\": null, \\"fleet_size\\": 7}"', 9),
        (4, "B", T(2024, 2, 1), '{"aoc":"QX1","name":"Three"}', 9), (5, "C", T(2025, 1, 1), '{"aoc":"QX-1","name":"Four","callsign":"CALL"}', 9),
        (6, "A", T(2024, 1, 1), '{"aoc":"QX-2","name":"Alone"}', 9), (7, "A", T(2024, 1, 1), '{"aoc":"pending"}', 9), (8, "A", None, None, 9), (9, "A", None, "no json", 9),
    ]
    src = spark.createDataFrame(rows, SRC)
    types = spark.createDataFrame([("A", 3), ("B", 2), ("A", 1)], "type string, trust int")
    r = survivors.operator_survivors(src, types).collect()
    assert len(r) == 1 and r[0].group_id == 1
    assert (r[0].name, r[0].icao_code, r[0].iata_code, r[0].callsign, r[0].fleet_size) == (3, 1, None, 5, 2)
    assert survivors.operator_survivors(src.limit(0), types).count() == 0 and survivors.operator_survivors(src, types.limit(0)).count() == 1


def test_bundles_keep_the_dependency(spark):
    """Against all combinations: the dependent bundle comes with the deciding one."""
    random.seed(3)
    rows = [(i, random.randint(0, 5), random.choice("XYZ"), random.choice(["p", "q", None]), random.randint(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, x string, y string, trust int").withColumn("at", F.lit(T(2024, 1, 1)))
    b = [survivors.Bundle("x", ("x",), ("y",)), survivors.Bundle("y", ("y",))]
    for r in survivors.choose_bundles(df, "g", "id", b, "trust", "at").collect():
        own = [q for q in rows if q[1] == r.g]
        score = lambda v: max(q[4] for q in own if q[2] == v) + max([q[4] for q in own if q[2] == v and q[3]], default=-1)
        x = next(q for q in own if q[0] == r.x)
        assert score(x[2]) == max(score(v) for v in {q[2] for q in own})
        y = [q for q in own if q[0] == r.y]
        assert not y or y[0][2] == x[2]


#: Words as they would be learnt from a large table.
WORDS = Words("air aircraft leasing jet flight management cargo island airways services flying school airlines".split(), given=["ione"], weak=["air"])


def test_name_parts():
    parse = lambda n: WORDS.parse(n)[:4]
    assert parse("Jet Ltd. (Klubruthiche)") == ("F", "klubruthiche", "jet", "")
    assert parse("Benstiregro, William P") == parse("Bill P Benstiregro") == ("P", "benstiregro", "william", "p")
    assert parse("VosenpliporFlt Mgmt") == parse("Vosenplipor Flight Management")
    assert parse("") == parse("--") == ("X", "", "", "")
    # Coined words in any order; names whose words nobody knows.
    assert parse("Blue Falcon Airways") == parse("Falcon Blue Airways") == ("F", "bluefalcon", "airways", "")
    assert WORDS.parse("Blue Falcon Airways")[5] == WORDS.parse("Falcon Blue Awys")[5]
    assert parse("Mueller Logistik Rheinland")[:2] == ("F", "logistikmuellerrheinland")
    assert parse("Smith Brothers") == parse("Brothers, Smith") == ("N", "brotherssmith", "", "")
    assert parse("Klorvan AG") == ("F", "klorvan", "", "") and Words(["agricultural"]).parse("Klorvan Ag Corp")[2] == "agricultural"


def test_abbreviations():
    pairs = [("avn", "aviation", True), ("svcs", "services", True), ("mgt", "management", True), ("transp", "transport", True), ("al", "airlines", True), ("flyg", "flying", True), ("cat", "cargo", False), ("argo", "cargo", False), ("x", "xylo", False)]
    assert all(abbreviates(a, w) == yes for a, w, yes in pairs) and skeleton("phonetic") == skeleton("fonnetik")


def coined(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = [c + v for c in "bdfgklmnprstv" for v in "aeiou"]
    return ["".join(r.choice(parts) for _ in range(5)) for _ in range(n)]


def test_words_are_learnt(spark):
    """What firms do and how people are called, in words that are in no list, is told by the company that words keep."""
    r = random.Random(8)
    trades, people = ["bakery", "foundry", "printworks", "brewery", "ropeworks"], ["aurelio", "brunhilde", "casimir", "dagny"]
    names = [f"{c.title()} {r.choice(trades).title()} {r.choice(['Ltd', 'GmbH', ''])}".strip() for c in coined(300, 1)] + [f"{r.choice(people).title()} {c.title()}" for c in coined(200, 2)]
    w = learn(spark.createDataFrame([(n,) for n in names], "name string"))
    assert w.described == set(trades) and set(people) <= w.given and not w.described & w.given
    groups = [
        ["Zolgrimavo Foundry Ltd", "Zolgrimavo Fndry", "Foundry Zolgrimavo, Limited", "ZOLGRIMAVO FOUNDRY"], ["Zolgrimavo Brewery"],
        ["Casimir Zolgrimavo", "Zolgrimavo, Casimir", "C. Zolgrimavo"], ["Blue Falcon Bakery", "Falcon Blue Bakery", "Blue Falcon Bkry"],
        ["Tarnelukizo Printworks", "Tranelukzio Printworks"], ["Kadu Brewery", "Kaddu Brewery"], ["Otrimekasu Ropeworks", "Otrimekosi Ropeworks", "Otirmekasu Ropeworks"],
    ]
    all_ = [(n,) for n in names] + [(n,) for g in groups for n in g]
    mine = {n for g in groups for n in g}
    got = {(p.name_a, p.name_b) for p in variants.name_pairs(variants.name_entities(spark.createDataFrame(all_, "name string"))).collect() if p.name_a in mine and p.name_b in mine}
    assert got == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}


def test_variants(spark):
    groups = [
        ["Shedanesha Aircraft Leasing Limited", "SHEDANESHA A/C LSG", "Sheadnesha Aircraft Leasing", "Aircraft Leasing Shedanesha", "Shedanesha Air", "Shedánesha Acft Leas., Ltd"],
        ["William P Benstiregro", "Benstiregro, Bill P", "W. P Benstiregro", "Mr William Benstiregro"],
        ["Margaret E Benstiregro", "Peggy E Benstiregro"], ["Klorvan Cargo Jet"], ["Klorvan Island Airways"], ["Klorvan Air"], ["unknown"], ["日本"],
    ]
    names = [n for g in groups for n in g] * 2 + [None, "", "  "]
    df = spark.createDataFrame([(n, "x") for n in names], "name string, entity string")
    got = {(r.name_a, r.name_b) for r in variants.name_pairs(variants.name_entities(df, WORDS)).collect()}
    want = {tuple(sorted((a, b), key=lambda s: s.encode())) for g in groups for a in g for b in g if a != b}
    assert got == want
    assert variants.name_entities(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q"), ("x", "y")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 63


def test_retrieval_is_exact(spark):
    """Every item above the threshold, and its score, against brute force."""
    random.seed(7)
    vocab = [f"t{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    bag = lambda: list(dict.fromkeys(random.choices(vocab, weights, k=6)))
    items, queries = [(i, bag()) for i in range(200)], [(i, bag() + ["new"]) for i in range(50)]
    post = matching.index(spark.createDataFrame(items, "item long, tokens array<string>"), "item", "tokens").cache()
    got = {(r.record, r.item): r.score for r in matching.retrieve(spark.createDataFrame(queries, "record long, tokens array<string>"), "record", post, "item").collect()}
    impact = {(r.token, r.item): r.impact for r in post.collect()}
    ub: dict = {}
    for (t, _), x in impact.items():
        ub[t] = max(ub.get(t, 0), x)
    unseen = np.log1p((200 + 0.5) / 0.5)
    for q, ts in queries:
        own = sum(ub.get(t, unseen) for t in ts)
        for i, _ in items:
            s = sum(impact.get((t, i), 0) for t in ts)
            if abs(s - matching.LEAST_SHARE * own) > 1e-9:
                assert ((q, i) in got) == (s >= matching.LEAST_SHARE * own)
                assert (q, i) not in got or got[q, i] == pytest.approx(s)


def test_nearest_keeps_ties_and_near_ones(spark):
    rows = [(1, i, x) for i, x in enumerate([9.0, 9.0, 9.0, 8.0, 7.0, 6.0, 5.0, 1.0])] + [(2, 0, 4.0), (2, 1, 1.0), (2, 2, 0.5), (2, 3, 0.1)]
    got = {(r.record, r.item) for r in matching.nearest(spark.createDataFrame(rows, "record int, item int, score double"), "record", k=3, near=0.6).collect()}
    assert got == {(1, i) for i in range(6)} | {(2, 0), (2, 1), (2, 2)}


def test_long_postings_are_cut(spark, monkeypatch):
    monkeypatch.setattr(matching, "HEAVY_TOKEN", 7)
    monkeypatch.setattr(variants, "HEAVY_BLOCK", 5)
    post = spark.createDataFrame([("air", i, 1.0) for i in range(60)] + [("x", 3, 2.0)], "token string, item int, impact double")
    must = spark.createDataFrame([(q, t) for q in range(5) for t in ("air", "x")], "record int, token string")
    assert matching._fetched(must, "record", post, "item").count() == 5 * 60
    nodes = spark.createDataFrame([("b", f"n{i:02}", "s") for i in range(23)], "block string, node string, s string")
    assert variants._block_pairs(nodes, ["s"]).count() == 23 * 22 // 2


def test_matching(spark):
    ops = [(1, "Korvanta Cargo Jet", "KOR", "K1"), (2, "Korvanta Island Airways", "KIA", None), (3, "Mestrulo Air Services Limited", None, "M1"), (4, "MESTRULO AIR SVCS", "MES", None), (5, None, None, None), (6, "Zofrinda Flying School", "ZOF", "Z9")]
    src = [
        (10, "Korvanta Cargo Jet Company", "KOR", None, "A", '{"source_ref":"R1"}'), (11, "Korvnata Cargo Jet", "kor", "K1", "A", '{"source_ref":"R2"}'), (12, "Mestrulo Air Services", None, "M1", "A", '{"source_ref":"R3"}'),
        (13, None, "N/A", None, "A", '{"source_ref":"R1"}'), (14, "Plegadi Airlines", "PLG", "P1", "B", None), (15, None, None, None, "B", None), (16, "Zofrinda Flyg Sch.", "ZOE", None, "B", "{}"),
    ]
    o = spark.createDataFrame(ops, "id long, name string, icao_code string, iata_code string")
    s = spark.createDataFrame(src, "id long, name string, icao_code string, iata_code string, type string, data string")
    got = {(r.source_id, r.operator_id) for r in matching.match_operators(s, o, WORDS).where(F.col("confidence") >= matching.ACCEPT).collect()}
    assert got == {(10, 1), (13, 1), (11, 1), (12, 3), (12, 4), (16, 6)}
    assert matching.match_operators(s.limit(0), o).count() == 0 and matching.match_operators(s, o.limit(0)).count() == 0


def test_subjects(spark):
    random.seed(5)
    words = {"food": "dough juice cheese cocoa starch rind".split(), "optics": "prism lens grating mirror slit beam".split(), "energie": "turbine boiler battery inverter well tank".split()}
    filler = "device housing spring lever means wherein claim provided".split()
    docs, truth, labels = [], {}, []
    for i in range(300):
        areas = random.sample(sorted(words), 2 if i % 4 == 0 else 1)
        text = " ".join(random.choices(filler, k=25) + [w for a in areas for w in random.choices(words[a], k=8)])
        other = next(a for a in words if a not in areas)
        if i % 3 == 0:
            text += f". The word {words[other][0]} is not used here in the sense it has for a {words[other][1]}."
        docs.append((i, text, "q"))
        truth[i] = set(areas)
        if i % 5 == 0:
            labels += [(i, f" {a.upper()} ", 1) for a in areas]
    labels += [(1, "nothing known", 1), (None, "food", 1), (9999, "food", 1)]
    docs += [(1000, None, "q"), (1001, "  ", "q"), (1002, "xyz", "q")]
    d = spark.createDataFrame(docs, "doc_id long, text string, terms string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, lf int")
    sub = spark.createDataFrame([(s,) for s in words], "subject string")
    got: dict = {}
    for r in subjects.subject_areas(d, lab, sub).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {1000, 1001, 1002} & set(got)
    assert sum(got.get(i) == t for i, t in truth.items()) / len(truth) > 0.95
    assert subjects.subject_areas(d, lab.limit(0), sub).count() == 0 and subjects.subject_areas(d, lab, sub.limit(0)).count() == 0
    assert subjects.subject_areas(d.limit(0), lab, sub).count() == 0


def test_sentences_of_comparison_are_learnt(spark):
    """Sentences that name another subject only to set the document apart, in wordings that no list has and badly scanned."""
    r = random.Random(9)
    terms = {"bells": "clapper yoke belfry foundry".split(), "boats": "keel rudder transom oarlock".split(), "bees": "hive comb brood smoker".split()}
    usual = ["The {t} is joined to the {u} by a pin.", "A {t} of this kind has been in use for years.", "Behind the {t}\u00a0 lies a {u}, as shown.", "It was found that the {t} wears less"]
    apart = ["Quite unlike our matter, makers of a {t} proceed otherwise.", "Quite  unl1ke our matter, rnakers of a {t} proceed otherwise!", "Makers of a {t} proceed otherwise\u00a0, unlike us;"]
    docs, labels, truth = [], [], {}
    for i in range(400):
        area = r.choice(sorted(terms))
        other = r.choice([a for a in sorted(terms) if a != area])
        pick = lambda a: r.choice(terms[a])
        text = [r.choice(usual).format(t=pick(area), u=pick(area)) for _ in range(5)] + [r.choice(apart).format(t=pick(other)) for _ in range(3 * (i % 2))]
        r.shuffle(text)
        docs.append((i, r.choice([" ", "\n", "<br/>"]).join(x + ("." if not x.endswith((".", "!")) else "") for x in text)))
        truth[i] = {area}
        if i % 4 < 2:
            labels.append((i, area))
    labels.append((500, "bees"))
    docs += [(500, "zzz"), (501, "yyy yyy")]  # a seed without any telling term, and such a document without a label
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    got: dict = {}
    for x in subjects.subject_areas(d, lab, spark.createDataFrame([(a,) for a in terms], "subject string")).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    assert sum(got.get(i) == t for i, t in truth.items()) / len(truth) > 0.97
    assert got[500] == {"bees"} and 501 not in got
    assert subjects.own_text("A keel here. Unlike a hive. More\nof it", frozenset({"unlike"})) == "A keel here.\nMore\nof it"


def test_only_texts_with_tags_are_split_sentence_by_sentence(spark, monkeypatch):
    """Terms are those of own_text, whatever blanks, tags and limits; but own_text itself, which is dear, is for tags alone."""
    r = random.Random(3)
    parts = "Keel rudder HIVE comb-brood unlike Unl1ke ΟΔΟΣ ΑΣ. İst xy abc. def! ghi? (96) foo<br/>bar a<br/>unlike </div> <b>hive</b> ... ﬁne apart".split(" ")
    texts = ["".join(r.choice(parts) + r.choice([" "] * 9 + ["\n", "\r\n", "\u00a0", "\x85", " \n ", "\x1c"]) for _ in range(r.choice([1, 3, 30, 90]))) for _ in range(200)] + ["unlike", "\n\n", "12 34"]
    foreign, model = frozenset({"unlike", "apart"}), {"keel": [0.5, 0.1, 0.6], "hive": [0.1, 0.7, 0.8]}
    words = lambda t: subjects._WORD.findall(t.lower())
    expected = [Counter(words(subjects.own_text(t, foreign)) if not foreign.isdisjoint(words(t)) else words(t)) for t in texts]
    split, own_text = [], subjects.own_text
    monkeypatch.setattr(subjects, "own_text", lambda t, foreign: split.append(t) or own_text(t, foreign))
    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast.side_effect = lambda x: SimpleNamespace(value=x)
    subjects.term_counts(docs, "k", "t", model, foreign)
    work = docs.where.return_value.select.return_value.mapInArrow.call_args[0][0]
    for chunk, remembered in ((10**6, 10**6), (50, 10), (1, 1)):
        monkeypatch.setattr(subjects, "CHUNK", chunk, raising=False)
        monkeypatch.setattr(subjects, "REMEMBERED", remembered, raising=False)
        rows = [x for b in work(iter(pa.table({"k": range(len(texts)), "t": texts}).to_batches(150))) for x in b.to_pylist()]
        assert [x["k"] for x in rows] == list(range(len(texts)))
        for x, n in zip(rows, expected):
            assert dict(zip(x["terms"], x["lf"])) == pytest.approx({w: math.log1p(c) for w, c in n.items()}) and len(x["terms"]) == len(n)
            lf = {w: math.log1p(n[w]) for w in model if w in n}
            total = sum(model[w][2] * c for w, c in lf.items())
            assert x["q"] == (pytest.approx([sum(model[w][i] * c for w, c in lf.items()) / total for i in (0, 1)]) if lf else None)
    assert split and all("<" in t for t in split)


def test_partial_rows_and_joint_dependents(spark):
    """Against all combinations: fuller rows first, and all bundles that follow from one are maximised together."""
    random.seed(11)
    some = lambda v, p: random.choice(v) if random.random() < p else None
    rows = [(i, random.randint(0, 14), some("XYZ", 0.5), some("UV", 0.4), some("pq", 0.6), some("mn", 0.6), random.randint(1, 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g int, x string, z string, y string, w string, trust int").withColumn("at", F.lit(T(2024, 1, 1)))
    b = [survivors.Bundle("a", ("x", "z"), ("y", "w")), survivors.Bundle("y", ("y",)), survivors.Bundle("w", ("w",))]
    got = {r.g: r for r in survivors.choose_bundles(df, "g", "id", b, "trust", "at").collect()}
    for g, r in got.items():
        own = [q for q in rows if q[1] == g]
        filled = lambda q: (q[2] is not None) + (q[3] is not None)
        most = max(map(filled, own))
        if not most:
            assert r.a is None
            continue
        top = lambda key, c: max([q[6] for q in own if (most < 2 or (q[2], q[3]) == key) and q[c] is not None], default=-1)
        score = lambda key: max(q[6] for q in own if (q[2], q[3]) == key) + top(key, 4) + top(key, 5)
        by_id = {q[0]: q for q in own}
        a = by_id[r.a]
        key = a[2:4]
        assert filled(a) == most and (score(key) == max(score(q[2:4]) for q in own if filled(q) == most) if most == 2 else a[6] == max(q[6] for q in own if filled(q) == most))
        for chosen, c in ((r.y, 4), (r.w, 5)):
            assert (chosen is None) == (top(key, c) < 0) and (chosen is None or ((most < 2 or by_id[chosen][2:4] == key) and by_id[chosen][6] == top(key, c)))


def test_matching_of_a_record_with_many_spellings(spark):
    """All rows of a record keep their match, however many spellings and wrong codes its other rows state."""
    random.seed(2)
    name, letters = "Korvanta", "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, "Korvanta Cargo Jet", "KOR", "K1", "A", '{"source_ref":"R1"}')]
    for i in range(2, 60):
        k = random.sample(range(8), 3)
        typed = "".join(random.choice(letters) if j in k else c for j, c in enumerate(name))
        rows.append((i, f"{typed} Cargo Jet", "".join(random.choices(letters, k=3)).upper(), None, "A", '{"source_ref":"R1"}'))
    ops = [(1, "Korvanta Cargo Jet", "KOR", "K1"), (2, "Mestrulo Air Services", "MES", "M1"), (3, "Zofrinda Flying School", "ZOF", "Z9"), (4, "Plegadi Airlines", "PLG", "P1")]
    o = spark.createDataFrame(ops, "id long, name string, icao_code string, iata_code string")
    s = spark.createDataFrame(rows, "id long, name string, icao_code string, iata_code string, type string, data string")
    got = {(r.source_id, r.operator_id) for r in matching.match_operators(s, o, WORDS).where(F.col("confidence") >= matching.ACCEPT).collect()}
    assert got == {(r[0], 1) for r in rows}


def test_fit_reaches_the_minimum():
    """Many pairs of equal names whose codes differ, and of other names whose codes agree: whole Newton steps run away there."""
    # level, shorter code (1 equal, 2 different), share, gap, pairs whose longer codes agree, and differ
    kinds = [
        (3, 0, 0.96, 0.64, 707, 145), (3, 1, 0.97, 0.72, 699, 26), (3, 2, 0.83, 0.59, 36, 137), (0, 0, 0.27, -0.45, 430, 1304), (0, 2, 0.27, -0.6, 59, 650), (0, 1, 0.33, -0.49, 10, 60),
        (2, 0, 0.36, -0.58, 55, 428), (2, 1, 0.66, 0.45, 55, 7), (2, 2, 0.3, -0.6, 5, 370), (1, 0, 0.6, -0.16, 5, 169), (1, 2, 0.53, -0.26, 3, 100),
    ]
    rows = [((1, s, g, level == 3, level == 2, level == 1, i == 1, i == 2), y) for level, i, s, g, a, d in kinds for y, n in ((1, a), (0, d)) for _ in range(n)]
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    prior = np.array(matching.PRIOR_WEIGHTS)
    w = matching._fit(x, y, prior)
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + matching.PRIOR_PAIRS * (w - prior)
    assert np.abs(slope).max() < 1e-3 and np.abs(w).max() < 10


def test_matching_where_operators_share_codes(spark):
    """Two operators have each code: an equal code doesn't make a match of other names, nor a label of one."""
    random.seed(5)
    names = random.sample([f"{x}{y}{z}" for x in "BDKNPRTVZ" for y in "aeiou" for z in "bdfgklmnprtvz"], 400)
    kinds = ("Cargo Jet", "Air Services", "Island Airways", "Flying School")
    ops = [(i, f"{n} {kinds[i // 80 % 4]}", f"K{chr(65 + i % 200 // 20)}{chr(65 + i % 20)}", None) for i, n in enumerate(names)]
    rows = [(10_000 + i, name, code if i % 10 else None, None, "A", f'{{"source_ref":"R{i}"}}') for i, name, code, _ in ops]
    o = spark.createDataFrame(ops, "id long, name string, icao_code string, iata_code string")
    s = spark.createDataFrame(rows, "id long, name string, icao_code string, iata_code string, type string, data string")
    got = {(r.source_id, r.operator_id) for r in matching.match_operators(s, o, WORDS).where(F.col("confidence") >= matching.ACCEPT).collect()}
    assert got == {(10_000 + i, i) for i, *_ in ops}
