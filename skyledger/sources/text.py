"""Delimited text and HTML extracts as DataFrames of strings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, sep: str = ",", liberal: bool = False, symbols: bool = False) -> DataFrame:
    """A file with a header, every cell a string, empty unquoted cells null; nothing is inferred.

    ``liberal`` keeps stray quotes inside a cell; ``symbols`` writes headers in lower case with underscores.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True)
    if liberal:
        reader = reader.option("unescapedQuoteHandling", "STOP_AT_DELIMITER")
    df = reader.csv(path)
    if symbols:
        df = df.toDF(*[symbol(c) for c in df.columns])
    return df


def symbol(header: str) -> str:
    return "_".join(header.strip().lower().replace("-", " ").split())


def table_rows(html: Column) -> Column:
    """array<array<string>>: cell texts of the first table's rows that hold no header cell (simple markup)."""
    first = F.regexp_extract(html, r"(?is)<table.*?</table>", 0)
    rows = F.regexp_extract_all(first, F.lit(r"(?is)<tr.*?</tr>"), F.lit(0))
    body = F.filter(rows, lambda r: ~r.rlike(r"(?is)<th[\s>]") & r.rlike(r"(?is)<td"))
    return F.transform(body, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), cell_text))


def cell_text(cell: Column) -> Column:
    t = F.regexp_replace(cell, r"(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


class _Cells(HTMLParser):
    """Texts of the elements of given classes, or of these elements' own children, in order."""

    def __init__(self, classes: frozenset[str], children: bool):
        super().__init__(convert_charrefs=True)
        self.classes, self.depth, self.texts, self.least = classes, 0, [], 2 if children else 1

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag not in ("br", "img", "hr", "input", "meta", "link")
        elif self.classes & set((dict(attrs).get("class") or "").split()):
            self.depth = 1
        else:
            return
        if self.depth == self.least and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.texts.append("")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag not in ("br", "img", "hr", "input", "meta", "link")))

    def handle_data(self, data):
        if self.depth >= self.least:
            self.texts[-1] += data


def labelled_pairs(pages: DataFrame, key: str, html: str, classes: tuple[str, ...], children: bool = False) -> DataFrame:
    """(key, pos, label, value): elements of ``classes``, or their children, two by two; an odd last one has a null value.
    General HTML."""
    wanted = frozenset(classes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, page in zip(f[key], f[html]):
                p = _Cells(wanted, children)
                p.feed(page or "")
                for i in range(0, len(p.texts), 2):
                    out.append((k, i // 2, p.texts[i], p.texts[i + 1] if i + 1 < len(p.texts) else None))
            yield pd.DataFrame(out, columns=[key, "pos", "label", "value"])

    return pages.select(key, html).mapInPandas(work, f"{key} {pages.schema[key].dataType.simpleString()}, pos int, label string, value string")
