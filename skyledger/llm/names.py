"""Parts of names that people typed: of a firm the coined and the descriptive words, of a person given and family name.

Which words describe, and which are given names, is learnt from the names themselves: such words stand beside many
different others, a coined or family name beside few. Given names stand in front or after a comma, descriptive words don't.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is common where it stands beside at least this share of all names' number of different partners, and beside at
#: least so many; so there are at most (words a name) / COMMON_SHARE common words, whatever the number of names.
COMMON_SHARE, COMMON_LEAST = 0.003, 8
#: A common word is a given name from this share of places in front or after a comma.
FRONT_SHARE = 0.5
#: A descriptive word in at least this share of the firms' names, and beside another one in this share of its own, tells
#: nothing by itself.
WEAK_SHARE, WEAK_BESIDE = 0.2, 0.5

#: Legal forms, left out of comparison.
LEGAL = ("ag", "bv", "co", "company", "corp", "corporation", "gmbh", "hldg", "hldgs", "hold", "holding", "holdings", "inc", "incorporated", "limited", "llc", "ltd", "nv", "plc", "proprietary", "pty", "sarl", "srl")
#: Nicknames and their given names.
NICKNAMES = {
    "alec": "alexander", "alex": "alexander", "sandy": "alexander", "gus": "augustin", "ben": "benedict", "callie": "calliope", "chris": "christopher", "kit": "christopher",
    "dot": "dorothea", "dora": "dorothea", "dorothy": "dorothea", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "liz": "elizabeth", "lisa": "elizabeth", "ferdi": "ferdinand",
    "fred": "frederick", "freddy": "frederick", "fritz": "frederick", "gabe": "gabriel", "harry": "harald", "hal": "harald", "etta": "henrietta", "hetty": "henrietta", "inge": "ingeborg",
    "jon": "jonathan", "jo": "josephine", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "leo": "leonardo", "maggie": "margaret", "meg": "margaret",
    "peggy": "margaret", "mick": "michael", "mike": "michael", "nick": "nicholas", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "bob": "robert", "rob": "robert", "bobby": "robert",
    "ros": "rosalind", "roz": "rosalind", "rosie": "rosalind", "ted": "theodore", "theo": "theodore", "uli": "ulrike", "tina": "valentina", "val": "valentina", "mina": "wilhelmina", "willa": "wilhelmina",
    "bill": "william", "billy": "william", "will": "william", "zach": "zachary", "zack": "zachary", "hughie": "hugo", "yann": "yannick", "quin": "quentin",
    "jim": "james", "jack": "john", "dick": "richard", "rick": "richard", "tom": "thomas", "tony": "anthony", "steve": "steven", "dan": "daniel", "dave": "david", "ed": "edward", "joe": "joseph", "sam": "samuel",
}
#: Titles.
TITLES = frozenset("mr mrs ms miss dr prof sir capt captain".split())

#: Legal forms that stand at the end alone; anywhere else the word may abbreviate another one.
AT_END = frozenset(("ag", "nv"))

_LEGAL = frozenset(LEGAL)
_TOKEN = re.compile(r"\w+(?:/\w\b)?")
_SEAM = re.compile(r"^(\w*[^\W\d_A-Z])([A-Z]\w+)$")


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o")


def tokens(s: str) -> list[str]:
    """Words of a folded name; "a/c" is one word "ac", "&" and "and" are none."""
    return [w.replace("/", "") for w in _TOKEN.findall(re.sub(r"\s*/\s*(?=\w\b)", "/", s.replace("'", "").replace("’", ""))) if w != "and"]


def typos(a: str, b: str) -> int:
    """Letters added, left out, replaced or exchanged with their neighbour."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


def abbreviates(t: str, w: str) -> bool:
    """Whether t is the word w cut off, or contracted: its letters in their order, with its last one or without vowels inside."""
    if not (1 < len(t) < len(w)) or t[0] != w[0]:
        return False
    if w.startswith(t):
        return True
    if t[-1] != w[-1] and re.search("[aeiou]", t[1:]):
        return False
    letters = iter(w)
    return all(c in letters for c in t)


def skeleton(word: str) -> str:
    """Phonetic code: first letter and consonant sounds, doubled ones once."""
    s = word.replace("ph", "f").replace("ck", "k").replace("th", "t").replace("sh", "s").replace("ch", "c")
    s = s[:1] + re.sub(r"[aeiouyh\W]", "", s[1:])
    return re.sub(r"(.)\1+", r"\1", s.translate(str.maketrans("qcvwzdg", "kkffstk")))


def _shorter(w: str) -> set[str]:
    """The word and all that it leaves without one letter: words one typo apart share one of these."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def _whole(t: str, described) -> str | None:
    """The descriptive word that t abbreviates: cut off before contracted, then the shortest."""
    return min((w for w in described if w[0] == t[0] and abbreviates(t, w)), key=lambda w: (not w.startswith(t), len(w), w), default=None)


class Words:
    """Common words and what they mean; parses names.

    ``described``: descriptive words, ``same``: other common words and the descriptive ones that they stand for, ``given``:
    given names beside those of the nickname table, ``weak``: descriptive words that tell nothing by themselves.
    """

    def __init__(self, described=(), same: dict[str, str] | None = None, given=(), weak=()):
        self.described, self.same, self.weak = frozenset(described), dict(same or {}), frozenset(weak)
        self.given = frozenset(w for w in given if w not in NICKNAMES) | frozenset(NICKNAMES.values())
        self._near: dict[str, set[str]] = defaultdict(set)
        self._near_given: dict[str, set[str]] = defaultdict(set)
        for w in (*self.described, *(x for x in LEGAL if len(x) > 5)):
            if len(w) > 3:
                for v in _shorter(w):
                    self._near[v].add(w)
        for w in (*self.given, *NICKNAMES):
            if len(w) > 4:
                for v in _shorter(w):
                    self._near_given[v].add(w)
        ends = sorted((w for w in (*self.described, *LEGAL) if len(w) > 4), key=lambda w: (-len(w), w))
        self._known_end = re.compile("^(.{5,}?)(" + "|".join(map(re.escape, ends)) + ")$")
        self._memo: dict[str, str] = {}
        self._memo_given: dict[str, str] = {}
        self._memo_glued: dict[str, str] = {}

    @classmethod
    def of_counts(cls, described: dict[str, int], given=()) -> Words:
        """A common word that abbreviates a more common one, or is one typo from it, is that word."""
        kept, same = [], {}
        for w in sorted(described, key=lambda w: (-described[w], w)):
            whole = _whole(w, kept) or next((x for x in kept if len(w) > 4 and abs(len(x) - len(w)) <= 1 and typos(x, w) <= 1), None)
            if whole:
                same[w] = whole
            else:
                kept.append(w)
        return cls(kept, same, given)

    def __reduce__(self):
        return Words, (sorted(self.described), self.same, sorted(self.given), sorted(self.weak))

    def word(self, t: str) -> str:
        """The descriptive word or legal form that t stands for, else t."""
        if t in self.described or t in _LEGAL or t in self.given or t in NICKNAMES:
            return t
        out = self._memo.get(t)
        if out is None:
            out = self.same.get(t) or _whole(t, self.described)
            if out is None and len(t) > 3:
                near = {w for v in _shorter(t) for w in self._near.get(v, ()) if typos(t, w) <= 1}
                out = min(near, default=None)
            out = out or t
            if len(self._memo) < 500_000:
                self._memo[t] = out
        return out

    def _known(self, t: str) -> bool:
        w = self.word(t)
        return w in self.described or w in _LEGAL

    def unglued(self, word: str) -> str:
        """The word with a blank before a descriptive word or legal form that was typed without one."""
        out = self._memo_glued.get(word)
        if out is None:
            out, m, low = word, _SEAM.match(word), fold(word)
            if m and len(m[1]) > 3 and self._known(fold(m[2])):
                out = f"{m[1]} {m[2]}"
            elif self.word(low) == low and low not in self.given:
                m = self._known_end.match(low)
                out = f"{m[1]} {m[2]}" if m else word
            if len(self._memo_glued) < 500_000:
                self._memo_glued[word] = out
        return out

    def given_name(self, t: str) -> str:
        """The given name that t is, a nickname's own or the one a typo away; else t."""
        if len(t) == 1 or t in self.given or t in NICKNAMES:
            return NICKNAMES.get(t, t)
        out = self._memo_given.get(t)
        if out is None:
            near = {w for v in _shorter(t) for w in self._near_given.get(v, ()) if typos(t, w) <= 1} if len(t) > 3 else ()
            out = min((NICKNAMES.get(w, w) for w in near), default=t)
            if len(self._memo_given) < 500_000:
                self._memo_given[t] = out
        return out

    def parse(self, name: str) -> tuple[str, str, str, str, str, str]:
        """(kind, core, rest, middle, typed, code).

        Firm: 'F', coined words in order of the alphabet, descriptive words as they stand, ''. Person: 'P', family name, given
        name (nicknames as given names, an initial as one letter), middle initial. Two names of which none is known as a
        given one: 'N', both in order of the alphabet. ``typed`` is the core in the order typed, ``code`` the phonetic codes
        of the core's sorted words. A name without letters or digits: 'X' and empty parts.
        """
        s = fold(re.sub(r"\w{8,}", lambda m: self.unglued(m[0]), name))
        words = tokens(re.sub(r"[&+]", " and ", s))
        if not words:
            return "X", "", "", "", "", ""
        known = [self.word(w) for w in words]
        for i, w in enumerate(words[:-1]):
            if w in AT_END:
                known[i] = _whole(w, self.described) or w
        sure = [k in _LEGAL or (k in self.described and (len(w) > 3 or w == k) and i > 0) for i, (w, k) in enumerate(zip(words, known))]
        sure = any(sure) or (known[0] in self.described and words[0] == known[0]) or (len(words) > 1 and words[-1] != known[-1] and len(words[-1]) > 1) or sum(k in self.described for k in known) > 1
        letters = [w for w in words if len(w) > 1 and w not in TITLES]
        people = any(self.given_name(w) in self.given for w in letters)
        if sure or (len(letters) > 2 and not people):
            rest = [k for k in known if k in self.described] if sure else []
            core = [w for w, k in zip(words, known) if k not in self.described and k not in _LEGAL] if sure else words
            return "F", "".join(sorted(core)), " ".join(rest), "", "".join(core), "".join(skeleton(w) for w in sorted(core))
        words = [w for w in words if w not in TITLES] or words
        if len(words) == 1:
            return "F", words[0], "", "", words[0], skeleton(words[0])
        if not letters:
            return "X", "".join(words), "", "", "", ""
        front = [w for w in tokens(s.split(",", 1)[0]) if w not in TITLES]
        strange = [w for w in letters if self.given_name(w) not in self.given]
        if len(letters) > 1 and not people:
            return "N", "".join(sorted(letters)), "", "".join(sorted(w for w in words if len(w) == 1)), "".join(letters), "".join(skeleton(w) for w in sorted(letters))
        if "," in s and len(front) == 1 and len(front[0]) > 1:
            family = front[0]
        else:
            family = strange[-1] if strange else letters[-1]
        others = list(words)
        others.remove(family)
        given = next((w for w in others if len(w) > 1), others[0] if others else "")
        if given:
            others.remove(given)
        middle = others[0][0] if others else ""
        return "P", family, self.given_name(given), middle, family, skeleton(family)


def _statistics(names: DataFrame, seen: dict[str, int] | None) -> DataFrame:
    """(word, n, front, partners) of a partition's names: without ``seen`` how many names hold a word; with the numbers of
    the frequent words, for those also how often they stand in front, and the codes of their names' rarest other words."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        front: Counter = Counter()
        partners: dict[str, set[str]] = defaultdict(set)
        for f in frames:
            for name in f["name"]:
                s = fold(name)
                words = tokens(re.sub(r"[&+]", " and ", s))
                if seen is None:
                    n.update(w for w in set(words) if len(w) > 1)
                    continue
                after = tokens(s.split(",", 1)[1])[:1] if "," in s else []
                for w in set(words) & seen.keys():
                    n[w] += 1
                    front[w] += words[0] == w or after == [w]
                    others = [x for x in words if x != w and len(x) > 1 and x not in _LEGAL]
                    if others:
                        partners[w].add(skeleton(min(others, key=lambda x: (seen.get(x, 0), -len(x), x))))
            if len(n) > 1_000_000:
                yield pd.DataFrame([(w, c, front[w], list(partners[w])) for w, c in n.items()], columns=["word", "n", "front", "partners"])
                n.clear(), front.clear(), partners.clear()
        yield pd.DataFrame([(w, c, front[w], list(partners[w])) for w, c in n.items()], columns=["word", "n", "front", "partners"])

    return names.select("name").mapInPandas(work, "word string, n long, front long, partners array<string>")


def learn(names: DataFrame) -> Words:
    """Common words of the distinct, non-null texts of column ``name``.

    What comes to the driver is bounded: a frequent word is in COMMON_SHARE of all names at least, so there are at most
    (mean number of words) / COMMON_SHARE of them.
    """
    total = names.count()
    least = max(COMMON_LEAST, COMMON_SHARE * total)
    frequent = _statistics(names, None).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    seen = {r["word"]: r["n"] for r in frequent.collect()}
    if not seen:
        return Words()
    stats = _statistics(names, seen)
    partners = stats.select("word", F.explode("partners").alias("p")).distinct().groupBy("word").agg(F.count("*").alias("partners"))
    rows = stats.groupBy("word").agg(F.sum("n").alias("n"), F.sum("front").alias("front")).join(partners, "word").where(F.col("partners") >= least).collect()
    rows = [r for r in rows if r["word"] not in _LEGAL and r["word"] not in TITLES]
    given = {r["word"]: r["n"] for r in rows if r["front"] >= FRONT_SHARE * r["n"]}
    described = {r["word"]: r["n"] for r in rows if r["word"] not in given}
    words = Words.of_counts(described, given)
    if words.described:
        held = F.array_intersect(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w) for w in sorted(words.described)]))
        firms = names.select(held.alias("_h")).where(F.size("_h") > 0)
        n = firms.count()
        many = firms.select(F.explode("_h").alias("word"), (F.size("_h") > 1).alias("_b")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("_b").alias("b"))
        words.weak = frozenset(r["word"] for r in many.collect() if r["n"] >= WEAK_SHARE * n and r["b"] >= WEAK_BESIDE * r["n"])
    return words
