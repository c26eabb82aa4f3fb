"""Scalar functions of field mappings; Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ruby's white space for strip.
_EDGE = r"^[\s\x00]+|[\s\x00]+$"
#: Acronyms that titles keep.
ACRONYMS = ("ICAO", "FIR", "ACARS", "CASA", "CAANZ", "VRS")


def strip_ascii(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def null_if_blank(c: Column) -> Column:
    return F.nullif(strip_ascii(c), F.lit(""))


def leading_int(c: Column) -> Column:
    """The whole number that a text begins with, else 0; null and numbers out of range count 0."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, "_", ""), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def titleize(c: Column) -> Column:
    """Underscores, hyphens and humps part words; each begins with a capital; acronyms stay. Not after an apostrophe."""
    t = F.regexp_replace(c, r"([A-Z\d]+)([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(t, r"([a-z\d])([A-Z])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"[_\-]+", " "), r"\s+", " ")
    words = F.split(strip_ascii(t), " ")

    def word(w: Column) -> Column:
        low = F.lower(w)
        plain = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))
        inner = F.regexp_extract(low, r"^([^\p{L}\p{N}]+)(.*)$", 1)
        rest = F.substring(low, F.length(inner) + 1, F.length(low))
        bracketed = F.concat(inner, F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))
        return F.when(F.upper(w).isin(*ACRONYMS), F.upper(w)).when(inner != "", bracketed).otherwise(plain)

    return F.array_join(F.transform(words, word), " ")


def first_address_line(c: Column) -> Column:
    """Of lines that end in CR LF only the first stays, as pair by pair."""
    return F.regexp_replace(c, r"(?dm)^(.*)\r\n(.*)$", "$1")


def last_word_of_last_line(c: Column) -> Column:
    t = F.regexp_replace(c, r"\s+$", "")
    return F.element_at(F.split(F.element_at(F.split(t, "\n"), -1), r"\s+"), -1)


def country_in_brackets(c: Column) -> Column:
    """What stands between the first opening and a line's closing bracket; null without."""
    return F.nullif(F.regexp_extract(c, r"(?dm)\((.*?)\)$", 1), F.lit(""))


def without_brackets(c: Column) -> Column:
    return strip_ascii(F.regexp_replace(c, r"(?dm)\((.*?)\)$", ""))


def alt_names(c: Column, literal: bool = False) -> Column:
    """Names of a bar-separated list: what follows a token with 'sign' or 'abbr' is dropped, then tokens with an equal sign
    or shorter than three. ``literal`` deletes the flagged places one by one, so later ones miss by those before."""
    parts = F.regexp_replace(c, r"\|+$", "")
    parts = F.when(parts == "", F.array().cast("array<string>")).otherwise(F.split(parts, r"\|"))
    marks = lambda t, word, i: F.when(F.contains(t, F.lit(word)), F.array(i + 1)).otherwise(F.array().cast("array<int>"))
    junk = F.flatten(F.transform(parts, lambda t, i: F.concat(marks(t, "sign", i), marks(t, "abbr", i))))
    if literal:
        kept = F.aggregate(junk, parts, lambda acc, j: F.filter(acc, lambda _, i: i != j))
    else:
        kept = F.filter(parts, lambda _, i: ~F.array_contains(junk, i))
    return F.filter(kept, lambda t: ~F.contains(t, F.lit("=")) & (F.length(t) >= 3))


#: Cabin letters and classes.
CABINS = (("FA", "First Class"), ("CJRDI", "Business Class"), ("WP", "Premium Economy"), ("YHKMLGVSOE", "Economy"), ("B", "Basic Economy"))


def cabin_classes(c: Column, literal: bool = False) -> Column:
    """'12 First Class' and so on of F12J30; N and Q are economy, or, ``literal``, others."""
    sections = F.filter(F.split(c, "(?=[A-Z])"), lambda s: s != "")

    def name(s: Column) -> Column:
        letter = F.regexp_extract(s, r"([A-Z])(\d+)", 1)
        out = F.lit("Other")
        for letters, cls in reversed(CABINS):
            own = letters + ("NQ" if cls == "Economy" and not literal else "")
            out = F.when(letter.isin(*own), F.lit(cls)).otherwise(out)
        return F.concat(F.regexp_extract(s, r"([A-Z])(\d+)", 2), F.lit(" "), out)

    return F.coalesce(F.transform(sections, name), F.array().cast("array<string>"))


def email_hash(c: Column) -> Column:
    return F.md5(F.lower(c))


def token_prefixes(c: Column) -> Column:
    """'a', 'a b', 'a b c' of 'a b c'."""
    t = F.filter(F.split(strip_ascii(c), r"\s+"), lambda w: w != "")
    return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: F.array_join(F.slice(t, 1, i), " "))).otherwise(F.array().cast("array<string>"))


def code_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("/", a, b)


def full_name(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit("")))


def preferred(first: Column, second: Column, literal: bool = False) -> Column:
    """The first source's value, the second's where it is null; ``literal`` never falls back."""
    return first if literal else F.coalesce(first, second)


def decode(c: Column, labels: list[str]) -> Column:
    """Label of a whole number that counts from 0; null outside the list."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), F.when((c >= 0) & (c < len(labels)), c + 1).otherwise(len(labels) + 1))


def with_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def label_key(c: Column) -> Column:
    """A label without its final colon."""
    return F.regexp_replace(strip_ascii(c), r"(?m):$", "")


def severity(status: Column) -> Column:
    """Colour of a status' label."""
    return F.when(status == "active", "green").when(status.isin("stored", "withdrawn"), "yellow").when(status.isin("destroyed", "scrapped", "written off"), "red").otherwise("gray")
