"""Full-text search over denormalised rows, and pages of its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(term, key, attribute, pos): attribute is the rank of the searchable column, pos the place of the word."""

    def placed(attribute: str, rank: int) -> Column:
        return F.transform(words(F.col(attribute)), lambda w, p: F.named_struct(F.lit("term"), w, F.lit("attribute"), F.lit(rank), F.lit("pos"), p.cast("int")))

    parts = [placed(a, r) for r, a in enumerate(attributes)]
    return rows.select(key, F.inline(F.concat(*parts)))


def search(index: DataFrame, key: str, query: str, limit: int | None = None) -> DataFrame:
    """(key, n_words, n_typos, best_attribute, exact), best first.

    Words match whole or within the allowed typos, the last one also as a prefix; more words found, fewer typos, an earlier
    attribute and exact words come first, then the key. A query without words returns every row of the index.
    """
    terms = [w for w in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split()]
    if not terms:
        return index.select(key).distinct().select(key, F.lit(0).alias("n_words"), F.lit(0).alias("n_typos"), F.lit(0).alias("best_attribute"), F.lit(0).alias("exact")).orderBy(key)
    # Words are matched against the distinct terms; the postings are met once, by the terms that match.
    t = F.col("term")
    near = []
    for i, w in enumerate(terms):
        k = 2 if len(w) >= 9 else 1 if len(w) >= 5 else 0
        d = F.levenshtein(t, F.lit(w), k)
        typos = F.when(t == w, 0).when(t.startswith(w), 0).otherwise(F.when(d >= 0, d)) if i == len(terms) - 1 else F.when(t == w, 0).otherwise(F.when(d >= 0, d))
        near.append(F.struct(F.lit(i).alias("word"), typos.alias("typos"), (t == w).cast("int").alias("exact")))
    matches = index.select("term").distinct().select("term", F.inline(F.filter(F.array(*near), lambda n: n["typos"].isNotNull())))
    hits = index.join(matches, "term").groupBy(key, "word").agg(F.min("typos").alias("typos"), F.min("attribute").alias("attribute"), F.max("exact").alias("exact"))
    ranked = hits.groupBy(key).agg(F.count("*").cast("int").alias("n_words"), F.sum("typos").cast("int").alias("n_typos"), F.min("attribute").alias("best_attribute"), F.sum("exact").cast("int").alias("exact"))
    out = ranked.orderBy(F.desc("n_words"), "n_typos", "best_attribute", F.desc("exact"), key)
    return out.limit(limit) if limit else out


def after(df: DataFrame, order: list[str], last: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows behind the row ``last`` (its values of ``order``, none of them null) without counting off the
    pages before; the first ones for None. Nulls of the first column come first."""
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, last):
            beyond = beyond | (equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        df = df.where(beyond)
    return df.orderBy(*order).limit(size)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in the order given, with pages in all and whether it is the last."""
    total = df.count()
    pages = max(1, -(-total // size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumns({"n_pages": F.lit(pages), "is_last_page": F.lit(number >= pages)})
