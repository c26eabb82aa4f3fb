"""Lookups and joins that put sources together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skyledger.functions import rules
from skyledger.functions.scalars import preferred, titleize, token_prefixes
from skyledger.functions.similarity import jaro_winkler
from skyledger.operators.search import words
from skyledger.operators.validate import broken, operator_rules, present

#: Least similarity of names by whether the longer code takes part.
WITH_CODE, WITHOUT_CODE = 0.5, 0.75


def _lowest(df: DataFrame, key: str, item: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(item).alias(item))


def exact_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id) of equal longer code and name, or, where the left has no longer code, shorter code and name; lowest right id."""
    by = lambda kind, code: F.when(F.col(code).isNotNull() & F.col("name").isNotNull(), F.struct(F.lit(kind).alias("k"), F.col(code).alias("c"), F.col("name").alias("n")))
    one = F.when(F.col("icao_code").isNotNull(), by("i", "icao_code")).otherwise(by("a", "iata_code"))
    l = left.select(F.col("id").alias("l_id"), one.alias("_key")).where(F.col("_key").isNotNull())  # noqa: E741
    r = right.select(F.col("id").alias("r_id"), F.explode(F.array_compact(F.array(by("i", "icao_code"), by("a", "iata_code")))).alias("_key"))
    return _lowest(l.join(r, "_key").select("l_id", "r_id"), "l_id", "r_id")


def fuzzy_matches(left: DataFrame, right: DataFrame, alt: str | None = None) -> DataFrame:
    """(l_id, r_id, confidence): best candidate that shares every code the left states, by one equi-join on the codes stated.

    Confidence 1 where both codes are equal, null with null too; else the greatest Jaro-Winkler similarity of the left's
    name with the right's names, from WITH_CODE or WITHOUT_CODE; ties go to the lowest right id.
    """
    names = F.concat(F.array("name"), F.coalesce(F.col(alt), F.array().cast("array<string>"))) if alt else F.array("name")
    i, a = F.col("icao_code"), F.col("iata_code")
    none = F.lit(None).cast("string")
    key = lambda x, y: F.struct(x.alias("i"), y.alias("a"))
    coded = i.isNotNull() | a.isNotNull()
    l = left.where(coded).select(F.col("id").alias("l_id"), i.alias("l_icao"), a.alias("l_iata"), F.col("name").alias("l_name"), F.to_json(key(i, a)).alias("_key"))  # noqa: E741
    forms = F.array_distinct(F.array(F.to_json(key(i, a)), F.to_json(key(i, none)), F.to_json(key(none, a))))
    r = right.where(coded).select(F.col("id").alias("r_id"), i.alias("r_icao"), a.alias("r_iata"), names.alias("r_names"), F.explode(forms).alias("_key"))
    cand = l.join(r, "_key")
    equal = F.col("l_icao").eqNullSafe(F.col("r_icao")) & F.col("l_iata").eqNullSafe(F.col("r_iata"))
    best_name = F.array_max(F.transform("r_names", lambda n: jaro_winkler(F.col("l_name"), n)))
    scored = cand.select("l_id", "r_id", "l_icao", F.when(equal, F.lit(1.0)).otherwise(best_name).alias("confidence"))
    least = F.when(F.coalesce(F.trim("l_icao"), F.lit("")) != "", WITH_CODE).otherwise(WITHOUT_CODE)
    best = scored.where(F.col("confidence") >= least)
    return best.groupBy("l_id").agg(F.max(F.struct("confidence", (-F.col("r_id")).alias("_m"))).alias("_b")).select("l_id", (-F.col("_b._m")).alias("r_id"), F.col("_b.confidence").alias("confidence"))


def combine_rows(left: DataFrame, right: DataFrame, alt: str | None = None, literal: bool = False) -> DataFrame:
    """Union of matched rows, rows of the left alone and rows of the right alone, with the rules that each breaks.

    Each row has phase (1: from the left, 2: right alone) and src (its id there); the longer code's first writer is found
    among the rows that break no rule, so a rejected row blocks none.
    """
    exact = exact_matches(left, right)
    rest = left.join(exact.select(F.col("l_id").alias("id")), "id", "left_anti")
    matched = exact.unionByName(fuzzy_matches(rest, right, alt).select("l_id", "r_id"))
    columns = ("name", "icao_code", "iata_code")
    l = left.select(F.col("id").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in columns])  # noqa: E741
    r = right.select(F.col("id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in columns])
    both = l.join(matched, "l_id", "left").join(r, "r_id", "full")
    alone = F.col("l_id").isNull()
    picked = [F.when(alone, F.col(f"r_{c}")).otherwise(preferred(F.col(f"l_{c}"), F.col(f"r_{c}"), literal)).alias(c) for c in columns]
    rows = both.select(F.when(alone, 2).otherwise(1).alias("phase"), F.coalesce("l_id", "r_id").alias("src"), *picked).withColumn("errors", broken(operator_rules()))
    # Rows that don't compete for a code stand under keys of their own, not in one group.
    competes = F.when((F.size("errors") == 0) & present("icao_code"), F.concat(F.lit("c"), F.lower("icao_code")))
    rows = rows.withColumn("_code", F.coalesce(competes, F.concat_ws("|", F.lit("r"), "phase", "src")))
    rn = F.row_number().over(W.partitionBy("_code").orderBy("phase", "src"))
    return rows.withColumn("errors", F.when(rn > 1, F.array(F.lit("icao_code taken"))).otherwise(F.col("errors"))).drop("_code")


def combine(left: DataFrame, right: DataFrame, alt: str | None = None, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of combine_rows."""
    rows = combine_rows(left, right, alt, literal)
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def combine_all(sides: list[DataFrame], literal: bool = False) -> DataFrame:
    """combine_rows of any number of sources, one after another: the rows accepted so far are the left of the next source.

    phase is the place (from 1) of the source that a row comes from and src its id there, unique over all sources; a row
    that one step rejects stays rejected and takes no part in the next.
    """
    columns = ["name", "icao_code", "iata_code"]
    origin = sides[0].select(F.col("id").alias("src"), F.lit(1).alias("phase"))
    for k, side in enumerate(sides[1:], 2):
        origin = origin.unionByName(side.select(F.col("id").alias("src"), F.lit(k).alias("phase")))
    left, rows, rejected = sides[0], None, None
    for right in sides[1:] or [sides[0].limit(0)]:
        if rows is not None:
            rows = rows.persist()  # the next step reads its left side at several places
            out = rows.where(F.size("errors") > 0)
            rejected = out if rejected is None else rejected.unionByName(out)
            left = rows.where(F.size("errors") == 0).select(F.col("src").alias("id"), *columns)
        rows = combine_rows(left, right, literal=literal).drop("phase")
    return (rows if rejected is None else rows.unionByName(rejected)).join(origin, "src").select("phase", "src", *columns, "errors")


def country_cascade(df: DataFrame, key: str, text: str, countries: DataFrame) -> DataFrame:
    """(key, country_id, tier): equal name (1), equal but for case (2), or the country's name holds the text (3, where % and _ are
    wildcards); within a tier the lowest id; no row without a hit.

    Distinct texts only are looked up: the first two tiers by equal keys, and what is left by a word of three letters that
    country and text share, if the text has no wildcard and a whole word; only the others meet every country.
    """
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_t")).distinct()
    c = countries.where(F.col("name").isNotNull()).select(F.col("id").alias("country_id"), F.col("name").alias("_n"))
    one = texts.join(c, F.col("_t") == F.col("_n")).groupBy("_t").agg(F.min("country_id").alias("country_id")).withColumn("tier", F.lit(1))
    two = texts.join(c, F.lower("_t") == F.lower("_n")).groupBy("_t").agg(F.min("country_id").alias("country_id")).withColumn("tier", F.lit(2))
    rest = texts.join(two, "_t", "left_anti")
    # Every three letters in a row of the text stand in the name, too; the first three that are letters are the key.
    piece = F.regexp_extract(F.lower("_t"), r"(\p{L}{3})", 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_n") - 2, F.lit(1))), lambda i: F.substring(F.lower("_n"), i, F.lit(3)))
    plain = (piece != "") & ~F.col("_t").rlike(r"[%_\\]")
    like = F.expr("lower(_n) like concat('%', lower(_t), '%')")
    keyed = rest.where(plain).withColumn("_g", piece).join(c.withColumn("_g", F.explode(F.array_distinct(grams))), "_g").where(like)
    odd = rest.where(~plain).join(c, like)
    three = keyed.select("_t", "country_id").unionByName(odd.select("_t", "country_id")).groupBy("_t").agg(F.min("country_id").alias("country_id")).withColumn("tier", F.lit(3))
    best = one.unionByName(two.join(one, "_t", "left_anti")).unionByName(three)
    return df.select(key, F.col(text).alias("_t")).join(best, "_t").select(key, "country_id", "tier")


def longest_prefix(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, name_id, name, rest): the longest leading run of words that is a name, and what follows it; ties to the lowest id."""
    prefixes = df.select(key, F.col(text).alias("_t"), F.explode(token_prefixes(F.col(text))).alias("name"))
    n = names.groupBy("name").agg(F.min("id").alias("name_id"))
    hit = prefixes.join(n, "name").groupBy(key).agg(F.max_by(F.struct("name_id", "name", "_t"), F.struct(F.length("name"), -F.col("name_id"))).alias("_b"))
    rest = F.substring(F.col("_b._t"), F.length("_b.name") + 2, F.length("_b._t"))
    return hit.select(key, F.col("_b.name_id").alias("name_id"), F.col("_b.name").alias("name"), rest.alias("rest"))


def lookup_or_error(df: DataFrame, fk: str, dim: DataFrame, pk: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing keys with the number of rows and the first row's id)."""
    d = dim.select(F.col(pk).cast("long").alias("_pk"))
    found = df.join(d, F.col(fk).cast("long") == F.col("_pk"), "left_semi")
    missing = df.where(F.col(fk).isNotNull()).join(d, F.col(fk).cast("long") == F.col("_pk"), "left_anti").groupBy(F.col(fk).cast("long").alias(fk)).agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"))
    return found, missing


def lookup_or_create(names: DataFrame, name: str, dim: DataFrame, key: Column | None = None) -> DataFrame:
    """(name, dim_id, created): known names with their lowest id; each unknown one a new row with an id stable across runs."""
    known = dim.groupBy("name").agg(F.min("id").alias("_id"))
    distinct = names.where(present(name)).select(F.col(name).alias("name")).distinct()
    return distinct.join(known, "name", "left").select("name", F.coalesce("_id", key if key is not None else F.xxhash64("name")).alias("dim_id"), F.col("_id").isNull().alias("created"))


def search_or_create(names: DataFrame, name: str, dim: DataFrame, key: Column | None = None) -> DataFrame:
    """(name, title, dim_id, created): operators by their canonical, titled names: the row whose name holds most of the
    title's leading words, at least the first one, then the lowest id; where there is none a new row.

    Rows are met by the title's first word alone, the other words are looked up in the row met.
    """
    titled = names.where(present(name)).select(F.col(name).alias("name")).distinct().withColumn("title", titleize(rules.fold(F.col("name"), rules.OPERATORS)))
    q = titled.withColumn("_w", words(F.col("title")))
    d = dim.select(F.col("id").alias("_id"), words(F.col("name")).alias("_have"))
    hits = q.where(F.size("_w") > 0).withColumn("_first", F.col("_w")[0]).join(d.select("_id", "_have", F.explode(F.array_distinct("_have")).alias("_first")), "_first")
    missed = F.transform("_w", lambda w, i: F.when(~F.array_contains("_have", w), i))
    lead = F.coalesce(F.array_min(missed), F.size("_w"))
    best = hits.groupBy("name").agg(F.max_by("_id", F.struct(lead, -F.col("_id"))).alias("_id"))
    fresh = key if key is not None else F.xxhash64("title")
    return titled.join(best, "name", "left").select("name", "title", F.coalesce("_id", fresh).alias("dim_id"), F.col("_id").isNull().alias("created"))


def lookup_maker(df: DataFrame, maker: str, makers: DataFrame) -> DataFrame:
    """Adds maker_id: the lowest id of the maker whose name is the canonical, titled one; null where there is none."""
    found = makers.groupBy(F.col("name").alias("_maker")).agg(F.min("id").alias("maker_id"))
    return df.withColumn("_maker", titleize(rules.fold(F.col(maker), rules.MANUFACTURERS))).join(found, "_maker", "left").drop("_maker")


def lookup_type(df: DataFrame, key: str, text: str, makers: DataFrame, types: DataFrame) -> DataFrame:
    """(key, maker_id, type_id): the maker is the longest leading run of words, the type the maker's one of the name that
    follows, the lowest id; rows without a maker are left out, type_id is null where the maker has no such type."""
    found = longest_prefix(df, key, text, makers).select(key, F.col("name_id").alias("maker_id"), F.col("rest").alias("_t"))
    t = types.groupBy(F.col("manufacturer_id").cast("long").alias("maker_id"), F.col("name").alias("_t")).agg(F.min("id").alias("type_id"))
    return found.join(t, ["maker_id", "_t"], "left").select(key, "maker_id", "type_id")


def through(outer: DataFrame, fk: str, middle: DataFrame, pk: str, columns: list[str]) -> DataFrame:
    """Two-hop join with repeated rows kept."""
    return outer.join(middle.withColumnRenamed(pk, "_pk"), F.col(fk) == F.col("_pk")).select(*columns)
