"""Variant spellings of the names of persons and organisations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.similarity import jaro_winkler, one_typo
from skyledger.functions.text import usable
from skyledger.llm.components import connected_components
from skyledger.llm.names import Words, learn
from skyledger.llm.shared import written

#: Two spellings are alike from a Jaro-Winkler similarity of 1 less this, divided by the length of the longer one: two
#: letters left out or exchanged with their neighbours, or one replaced, or two replaced behind the first four.
UNLIKE = 0.8
#: Spellings up to this length are also met by what one left-out letter leaves; longer ones by either half.
SHORT_NAME = 7
#: Nodes of a block beyond which one side is salted and the other repeated, so that no task holds a whole block.
HEAVY_BLOCK = 2_000


def parsed(names: DataFrame, words: Words) -> DataFrame:
    """(name, kind, core, rest, middle, typed, code) of the distinct names of column ``name``."""
    known = names.sparkSession.sparkContext.broadcast(words)  # bounded, see names.learn

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = known.value
        for f in frames:
            yield pd.DataFrame([w.parse(n) for n in f["name"]], columns=["kind", "core", "rest", "middle", "typed", "code"]).assign(name=f["name"].to_numpy())[["name", "kind", "core", "rest", "middle", "typed", "code"]]

    return names.select("name").mapInPandas(work, "name string, kind string, core string, rest string, middle string, typed string, code string")


def letters(s: Column) -> Column:
    """The letters of a spelling in order of the alphabet."""
    return F.array_join(F.array_sort(F.split(s, "")), "")


def alike(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """Whether Jaro-Winkler takes two spellings for one, by their length; up to three letters only equal ones are. A single
    slip is a further way in, since one that meets the same letter nearby counts as exchanged letters, too.

    Beforehand go pairs that can't be: letters that one spelling has and the other lacks take a third each of 1 / length
    from the similarity, of which a common beginning of p letters gives back a p tenth, so with at most
    3 UNLIKE / (1 - p / 10) of them the sorted letters are no more edits apart.
    """
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    same = lambda k: (F.left(a, F.lit(k)) == F.left(b, F.lit(k)))
    odd = F.lit(int(3 * UNLIKE / 0.6 + 1e-9))
    for p in (3, 2, 1, 0):  # the shortest beginning that differs decides
        odd = F.when(~same(p + 1), int(3 * UNLIKE / (1 - p / 10) + 1e-9)).otherwise(odd)
    apart = F.levenshtein(letters_a, letters_b, int(3 * UNLIKE / 0.6 + 1e-9))
    possible = (longer - shorter <= odd) & (apart >= 0) & (apart <= odd)
    return (a == b) | ((shorter > 3) & possible & (one_typo(a, b) | F.coalesce(jaro_winkler(a, b) >= 1 - UNLIKE / longer, F.lit(False))))


def _keys(spelling: Column, code: Column) -> Column:
    """Blocks of a spelling: its phonetic code; either half, by two lengths, since one slip leaves one half alone; a short one
    also by all that it leaves without one letter."""
    n = F.length(spelling)
    half = F.greatest(F.lit(3), F.floor(n / 2).cast("int"))
    sides = [F.concat(F.lit(mark), (half - d).cast("string"), take(spelling, half - d)) for mark, take in (("h", F.left), ("t", F.right)) for d in (0, 1)]
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), F.substring(spelling, F.lit(1), i - 1), F.substring(spelling, i + 1, n)))
    short = F.when(n.between(4, SHORT_NAME), F.concat(without, F.array(F.concat(F.lit("w"), spelling)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("c"), code)), F.when(n > 3, F.array(*sides)).otherwise(F.array().cast("array<string>")), short))


def _block_pairs(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs a < b of the nodes of each block, with ``columns`` of both as *_a and *_b.

    Blocks of more than HEAVY_BLOCK nodes are cut by a salt on one side, the other side is repeated for each salt; how many
    there are is counted first, so no task holds more than a part of one.
    """
    sizes = blocks.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    parts = F.ceil(F.col("_n") / HEAVY_BLOCK).cast("int")
    sized = blocks.join(sizes.select("block", parts.alias("_parts")), "block")
    left = sized.select("block", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int").alias("_salt"), F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = sized.select("block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"), F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, ["block", "_salt"]).where(F.col("a") < F.col("b")).drop("block", "_salt")


def _similar_edges(nodes: DataFrame) -> DataFrame:
    """Nodes of equal remaining words whose coined or family names are alike; of persons also those whose given names are.

    Blocks of the phonetic codes of the sorted words, and of parts of the spelling, always with the remaining words; all
    pairs of a block are compared by Jaro-Winkler, a pair met in several blocks once.
    """
    words = F.array_join(F.array_sort(F.split("rest", " ")), " ")
    fixed = F.concat_ws("|", F.col("kind"), words, F.col("middle"))
    named = nodes.where(F.col("core") != "")
    # Coined words typed in two orders are compared in order of the alphabet and as typed.
    forms = F.array_distinct(F.array(F.struct(F.col("core").alias("s")), F.struct(F.col("typed").alias("s"))))
    one = named.select("node", fixed.alias("_fixed"), "code", F.inline(forms)).select("node", "s", F.explode(_keys(F.col("s"), F.col("code"))).alias("_k"), "_fixed").select("node", "s", F.concat_ws("|", F.lit("1"), "_k", "_fixed").alias("block"))
    p = nodes.where((F.col("kind") == "P") & (F.length("rest") > 1))
    # The given name's own code is its spelling without vowels.
    code = F.concat(F.left("rest", F.lit(1)), F.regexp_replace(F.substring(F.col("rest"), F.lit(2), F.length("rest")), "[aeiouyh]", ""))
    two = p.select("node", F.col("rest").alias("s"), F.concat_ws("|", "core", "middle").alias("_fixed"), F.explode(_keys(F.col("rest"), code)).alias("_k")).select("node", "s", F.concat_ws("|", F.lit("2"), "_k", "_fixed").alias("block"))
    met = _block_pairs(one.unionByName(two).withColumn("l", letters(F.col("s"))), ["s", "l"]).distinct()
    return met.where(alike(F.col("s_a"), F.col("s_b"), F.col("l_a"), F.col("l_b"))).select("a", "b").distinct()


def _stands_for() -> Column:
    """Whether the shortened form s may stand for the fuller form f (columns *_s and *_f; weak words are left out of ``short_s``)."""
    firm = (F.col("rest_f") != F.col("rest_s")) & ((F.col("short_s") == "") | F.col("rest_f").startswith(F.concat("rest_s", F.lit(" "))))
    given = (F.col("rest_s") == F.col("rest_f")) | ((F.length("rest_s") == 1) & F.col("rest_f").startswith(F.col("rest_s"))) | (F.col("rest_s") == "")
    fuller = (F.length("rest_f") > 1) & ((F.length("rest_s") <= 1) | ((F.col("middle_s") == "") & (F.col("middle_f") != "")))
    person = given & fuller & ((F.col("middle_s") == F.col("middle_f")) | (F.col("middle_s") == "") | (F.col("middle_f") == ""))
    return F.when(F.col("kind") == "F", firm).otherwise(person)


def _short_hits(nodes: DataFrame, weak: frozenset[str]) -> DataFrame:
    """(a, b, off): shortened forms a with each fuller form b that they may stand for; off where the coined names differ."""
    n = nodes.where((F.col("core") != "") & F.col("kind").isin("F", "P"))
    telling = F.array_join(F.filter(F.split("rest", " "), lambda w: ~w.isin(*weak) if weak else F.lit(True)), " ")
    may_be_short = (F.col("kind") == "F") | (F.col("middle") == "") | (F.length("rest") <= 1)
    n = n.select("kind", "node", "core", "rest", "middle", telling.alias("short"), letters(F.col("core")).alias("l"), may_be_short.alias("_s"), (F.col("rest") != "").alias("_f"), F.explode(_keys(F.col("core"), F.col("code"))).alias("block"))
    side = lambda flag, end: n.where(flag).select("kind", "block", F.col("node").alias("a" if end == "s" else "b"), *[F.col(c).alias(f"{c}_{end}") for c in ("core", "rest", "middle", "short", "l")])
    met = side("_s", "s").join(side("_f", "f"), ["kind", "block"]).where((F.col("a") != F.col("b")) & _stands_for()).drop("block").distinct()
    return met.where(alike(F.col("core_s"), F.col("core_f"), F.col("l_s"), F.col("l_f"))).select("a", "b", (F.col("core_s") != F.col("core_f")).alias("off"))


def _short_edges(hits: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges between the components of shortened forms and of the fuller forms, only where these are one component.

    Fuller forms of the very same coined name come first, those alike only where there is none.
    """
    of = lambda end: comps.select(F.col("node").alias(end), F.col("component").alias(f"comp_{end}"))
    open_ = hits.join(of("a"), "a").join(of("b"), "b").where(F.col("comp_a") != F.col("comp_b"))
    least, most = (f(F.when(~F.col("off"), F.col("comp_b"))) for f in (F.min, F.max))
    best = open_.groupBy("a", "comp_a").agg(least.alias("s0"), most.alias("s1"), F.min("comp_b").alias("o0"), F.max("comp_b").alias("o1"))
    one = F.when(F.col("s0").isNotNull(), F.when(F.col("s0") == F.col("s1"), F.col("s0"))).when(F.col("o0") == F.col("o1"), F.col("o0"))
    return best.select(F.col("comp_a").alias("a"), one.alias("b")).where(F.col("b").isNotNull())


def name_entities(names: DataFrame, words: Words | None = None) -> DataFrame:
    """(name, entity) of the distinct usable texts of column ``name``: texts of one person or organisation share an entity.

    Null, blank and filler texts name nobody and are left out. Texts that come down to the same words are one node; nodes
    that Jaro-Winkler takes for one are linked; then shortened forms join the one entity that they can stand for, round by
    round until none joins any more. A name without any letter stays alone. ``words`` are learnt from the names unless given.
    """
    distinct = written(names.where(usable(F.col("name")).isNotNull()).select("name").distinct(), "texts")
    words = words or learn(distinct)
    node = F.when(F.col("kind") == "X", F.concat_ws("|", "kind", "name")).otherwise(F.concat_ws("|", "kind", "core", "rest", "middle"))
    # A firm without any coined word is known by its description alone.
    all_parsed = written(parsed(distinct, words).withColumn("node", node), "names")
    nodes = written(all_parsed.groupBy("node").agg(*[F.min(c).alias(c) for c in ("kind", "core", "rest", "middle", "typed", "code")]), "nodes")
    comp = _all_nodes(nodes, connected_components(_similar_edges(nodes)))
    hits = written(_short_hits(nodes, words.weak), "hits")
    while True:  # what joined before may leave one entity where there were two to choose from
        short = written(_short_edges(hits, comp), "short")
        if short.isEmpty():
            break
        joined = connected_components(short)
        comp = written(comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_j")), "component", "left").select("node", F.coalesce("_j", "component").alias("component")), "comps")
    return all_parsed.select("name", "node").join(comp, "node").select("name", F.col("component").alias("entity"))


def _all_nodes(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Component of every node, its own where it has no edge."""
    return nodes.select("node").join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b) of every two different texts of an entity, name_a the smaller by UTF-8 bytes."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
