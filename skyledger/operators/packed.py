"""Several values packed in one field, with delimiters, quoting and notations that differ from field to field."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Stands for a slash between blanks while a field is cut; a private-use character.
SLASH = "\ue000"
#: Candidate delimiters, as bodies of a regular-expression class.
DELIMITERS = (r"\r\n", r"\t", ";；", ",，、", "|", "¦", "•·", SLASH)
#: A token that begins or continues at least this share of all training values is its own class, so there are at most
#: 1 / TOKEN_SHARE * (tokens a value) of them; any other token is of the class of its shape.
TOKEN_SHARE = 0.002
#: Bits that a delimiter, a way of quoting and a notation cost to name.
DIALECT_BITS = 2.0
#: Bits of a transition after a class that was never seen, at a value's ends and inside it.
ENDS_BITS, UNKNOWN_BITS = 6.0, 16.0
#: Weight of the classes' own frequencies in the smoothed transitions.
PRIOR = 0.02
#: Fields whose parse a worker remembers.
REMEMBERED = 100_000

_BLANK = r" \t\n\x0b\f\r\x85\xa0\p{Z}\ufeff"
_ENDS = regex.compile(rf"^[{_BLANK}]+|[{_BLANK}]+\Z")
#: Notations that say by themselves where each value begins and ends.
_TAGGED = regex.compile(r"^[\s=]*[a-z]{2,8}(?:[-_][A-Za-z0-9]{2,4})?\|(?!\|)")
_TAG = regex.compile(r"^[a-z]{2,8}(?:[-_][A-Za-z0-9]{2,4})?\Z")
_BRACED = regex.compile(r"^\s*\{((?s:.*))\}\s*\Z")
_IN_BRACES = regex.compile(r'"(?:[^"\\]|\\.)*+"|[^",]++')
_QUOTED = regex.compile(r'"[^"]*+"')
_LONE_SLASH = regex.compile(rf"(?:(?<=[{_BLANK}])|^)/(?=[{_BLANK}]|\Z)|(?<=[{_BLANK}])/(?=\S)|(?<=\S)/(?=[{_BLANK}]|\Z)")
_ANY_DELIMITER = regex.compile("[" + "".join(DELIMITERS) + '/"]')
_TOKEN = regex.compile(r"[ \t]/[ \t]|[\r\n\t]|[\p{L}\p{M}\p{N}'.&]+|[^ \t\n\x0b\f\r\p{L}\p{M}\p{N}]")
_SHAPES = [(regex.compile(p), c) for p, c in ((r"[^\p{L}\p{M}\p{N}'.&]+", None), (r"\p{Latin}+", "<AA>"), (r"[\p{Latin}'.&]+", "<Aa>"), (r"\p{N}+", "<9>"), (r"\p{Cyrillic}+", "<cyr>"))]


def _strip(s: str) -> str:
    return _ENDS.sub("", s)


def _cutter(delimiters: str, escapes: bool):
    """Finds the items between unquoted delimiters. A quote that is never closed is an ordinary character."""
    head, stop, tail = (r"\\(?s:.)|", r"\\", r"|\\") if escapes else ("", "", "")
    return regex.compile(f'(?:{head}"[^"]*+"|[^"{stop}{delimiters}]++|"{tail})+').findall


_BY_EQUALS, _BY_BAR = _cutter("=", True), _cutter("|", True)


def _unquote(v: str, escapes: bool = False) -> str:
    t = _strip(v)
    if len(t) > 1 and t[0] == t[-1] == '"':
        t = t[1:-1].replace('""', '"')
    if escapes:
        t = regex.sub(r"\\(.)", r"\1", t)
    return _strip(t)


def _solid(values) -> list[str]:
    return [v for v in values if v]


def _tagged(s: str) -> list[str]:
    """Values of ``tag|value|usage`` items between equal signs."""

    def value(item: str) -> str:
        parts = [_strip(p) for p in _BY_BAR(item + " ")]
        # Nothing before the first bar: its place is empty, and the value is the first part.
        tagged = len(parts) > 1 and _TAG.match(parts[0]) and regex.match(r"[^|]*\|", _strip(item))
        return _unquote(parts[1] if tagged else parts[0], True)

    return _solid(value(i) for i in _BY_EQUALS(s) if _strip(i))


def notation(s: str, listed: list[str] | None) -> tuple[str, list[str]] | None:
    """(name, values) of a field that can be read in a notation of its own; ``listed`` are the items of a JSON list."""
    if listed is not None:
        return "listed", _solid(_strip(x) for x in listed if x is not None)
    m = _BRACED.match(s)
    if m:
        return "braced", _solid(_unquote(i, True) for i in _IN_BRACES.findall(m[1]))
    return ("tagged", _tagged(s)) if _TAGGED.match(s) else None


class _Shapes(dict):
    def __missing__(self, t: str) -> str:
        out = "<?>"
        for pattern, name in _SHAPES:
            if pattern.fullmatch(t) and (name != "<AA>" or t.upper() == t):
                out = name or t
                break
        if len(self) < REMEMBERED:
            self[t] = out
        return out


def _tokens(v: str) -> list[str]:
    return ["<s>", *_TOKEN.findall(v), "</s>"]


@dataclass
class Model:
    """Code lengths in bits: of seen pairs of classes, and of an unseen one after each class."""

    vocabulary: frozenset[str]
    pairs: dict[tuple[str, str], float]
    unseen: dict[str, float]

    def bits(self, value: str, shapes: _Shapes) -> float:
        total, prev = 0.0, None
        for t in _tokens(value):
            c = t if t in self.vocabulary else shapes[t]
            if prev is not None:
                b = self.pairs.get((prev, c))
                if b is None:
                    b = self.unseen.get(prev)
                total += b if b is not None else ENDS_BITS if prev == "<s>" or c == "</s>" else UNKNOWN_BITS
            prev = c
        return total


def _sets(have: list[str]) -> Iterator[tuple[str, ...]]:
    for m in range(1 << len(have)):
        yield tuple(d for i, d in enumerate(have) if m >> i & 1)


class _Parser:
    """Every field by its cheapest dialect."""

    def __init__(self, model: Model):
        self.model, self.shapes = model, _Shapes()
        self.cut: dict[str, object] = {}
        self.split: dict[str, object] = {}
        self.known: dict[str, list[str]] = {}
        self.cost: dict[str, float] = {}
        self.here = [(d, regex.compile(f"[{d}]")) for d in DELIMITERS]

    def _values(self, s: str, delimiters: tuple[str, ...], quotes: bool) -> list[str]:
        d = "".join(delimiters)
        if not quotes:
            if d not in self.split:
                self.split[d] = regex.compile(f"[{d}]").split if d else lambda x: [x]
            return _solid(_strip(x.replace(SLASH, "/")) for x in self.split[d](s))
        if d not in self.cut:
            self.cut[d] = _cutter(d, False) if d else lambda x: [x]
        return _solid(_unquote(x).replace(SLASH, "/") for x in self.cut[d](s))

    def _bits(self, v: str) -> float:
        b = self.cost.get(v)
        if b is None:
            b = self.model.bits(v, self.shapes)
            if len(self.cost) < REMEMBERED:
                self.cost[v] = b
        return b

    def dialects(self, f: str, listed: list[str] | None) -> Iterator[tuple[float, str, list[str]]]:
        """(bits of the dialect, its name, values): the field's notation, if it has one, and every set of delimiters that
        stand outside quotes, with and without regard to quotes."""
        own = notation(f, listed)
        if own:
            yield DIALECT_BITS, own[0], own[1]
        s = _LONE_SLASH.sub(SLASH, f)
        loose = _QUOTED.sub("", s)
        for c in _sets([d for d, p in self.here if p.search(loose)]):
            yield DIALECT_BITS * len(c), f"{c}", self._values(s, c, True)
        if '"' in s:
            for c in _sets([d for d, p in self.here if p.search(s)]):
                yield DIALECT_BITS * (len(c) + 1), f"{c} raw", self._values(s, c, False)

    def values(self, f: str, listed: list[str] | None) -> list[str]:
        out = self.known.get(f)
        if out is None:
            all_ = list(self.dialects(f, listed))
            out = all_[0][2] if len(all_) == 1 else min(all_, key=lambda d: (round(d[0] + sum(map(self._bits, d[2])), 6), -len(d[2]), d[1]))[2]
            if len(self.known) < REMEMBERED:
                self.known[f] = out
        return out


def _fields(rows: DataFrame, field: str) -> DataFrame:
    """(_f, _j): fields that aren't null or blank, with the items of those that are JSON lists."""
    f = F.col("_f")
    listed = F.when(f.rlike(r"^\s*\["), F.from_json(f, "array<string>")).alias("_j")
    return rows.select(F.col(field).alias("_f")).where(f.rlike(r"[^\s\x{85}\x{A0}\p{Z}\x{FEFF}]")).select("_f", listed)


def _listed(j) -> list[str] | None:
    return None if j is None else list(j)


def train(rows: DataFrame, field: str) -> Model:
    """Code lengths from the values of fields in a notation of their own and of fields without any delimiter, each once.

    The driver gets the frequent tokens, whose number TOKEN_SHARE bounds, and the pairs of their classes.
    """

    def training(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: set[str] = set()
            for s, j in zip(f["_f"], f["_j"]):
                own = notation(s, _listed(j))
                # A field without any delimiter is a value, too.
                out.update(own[1] if own else [] if _ANY_DELIMITER.search(s) else [_strip(s)])
            yield pd.DataFrame({"value": list(out)}, dtype=object)

    def counted(classes):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n: Counter = Counter()
            for f in frames:
                for v in f["value"]:
                    n.update(classes(_tokens(v)))
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["prev", "cur", "n"])

        return lambda df: df.mapInPandas(work, "prev string, cur string, n long").groupBy("prev", "cur").agg(F.sum("n").alias("n"))

    values = _fields(rows, field).distinct().mapInPandas(training, "value string").distinct().persist()
    try:
        tokens = counted(lambda ts: {(t, "") for t in ts})(values)
        total = values.count()
        frequent = frozenset(r["prev"] for r in tokens.where(F.col("n") >= max(2.0, TOKEN_SHARE * total)).collect()) | {"<s>", "</s>"}

        def pairs(ts: list[str]) -> list[tuple[str, str]]:
            shapes = _Shapes()
            cs = [t if t in frequent else shapes[t] for t in ts]
            return list(zip(cs, cs[1:]))

        seen = {(r["prev"], r["cur"]): r["n"] for r in counted(pairs)(values).collect()}
    finally:
        values.unpersist()
    totals: Counter = Counter()
    kinds: Counter = Counter()
    for (p, _), n in seen.items():
        totals[p] += n
        kinds[p] += 1
    mass = {p: totals[p] + PRIOR * (kinds[p] + 1) for p in totals}
    return Model(frequent, {pc: math.log2(mass[pc[0]] / (n + PRIOR)) for pc, n in seen.items()}, {p: math.log2(m / PRIOR) for p, m in mass.items()})


def split_packed(rows: DataFrame, key: str, field: str, out: str = "value", model: Model | None = None) -> DataFrame:
    """(key, pos, out): one row per value of ``field``, pos counting from 1.

    Every field is parsed by each dialect: its notation, if it looks like one (a JSON list, braces, tagged items), and each
    set of its delimiters, quotes heeded or not. It takes the one with the shortest description: its values' bits, by the
    code lengths of token transitions (``train``, unless a ``model`` is given), plus the dialect's own. Ties go to the
    dialect with more values, then to its name. Rows are parsed where they are, without a shuffle. Null and blank fields
    and empty places yield no row. A private-use character U+E000 in a field reads as a slash.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model or train(rows, field))  # bounded, see train

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _Parser(shared.value)
        for f in frames:
            found = [parser.values(s, _listed(j)) for s, j in zip(f["_f"], f["_j"])]
            many = [len(v) for v in found]
            yield pd.DataFrame({key: f[key].repeat(many), "pos": [p for n in many for p in range(1, n + 1)], out: [v for vs in found for v in vs]})

    f = F.col("_f")
    named = rows.select(F.col(key), F.col(field).alias("_f")).where(f.rlike(r"[^\s\x{85}\x{A0}\p{Z}\x{FEFF}]"))
    named = named.select(key, "_f", F.when(f.rlike(r"^\s*\["), F.from_json(f, "array<string>")).alias("_j"))
    return named.mapInPandas(work, StructType([rows.schema[key], StructField("pos", IntegerType()), StructField(out, StringType())]))
