"""Records of two sources matched without a common key, by BM25 retrieval over all attributes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from skyledger.functions.jsonx import members
from skyledger.functions.similarity import one_typo
from skyledger.functions.text import is_filler, strip
from skyledger.llm.names import Words, learn
from skyledger.llm.shared import written

#: Usual parameters of BM25.
K1, B = 1.2, 0.3
#: Candidates count from this share of the score that the query's tokens could reach together.
LEAST_SHARE = 0.25
#: A record's nearest items: those of its K best scores, and any other from NEAR of its best score, so that no number of
#: copies of an item under different spellings is cut off.
K, NEAR = 3, 0.6
#: A record is among an item's nearest from this part of the item's largest share.
NEAR_ITEM = 0.3
#: Postings of a token beyond which they are cut by a salt and the queries repeated.
HEAVY_TOKEN = 20_000
#: What the weights are where there are no labels, in the order of FEATURES, and how many labelled pairs that weighs.
PRIOR_WEIGHTS, PRIOR_PAIRS = (-4.0, 2.0, 2.0, 5.0, 2.5, 0.0, 2.0, -1.0), 3.0
#: Pairs that the calibration is fitted on, at most.
FIT_ON = 20_000
#: Start of the longer code's tokens; that code labels the pairs which the calibration is fitted on.
LABEL = "i:"
#: Least confidence of a match.
ACCEPT = 0.4


def code_tokens(icao: Column, iata: Column) -> Column:
    """Codes as tokens by their form, so that a code in the other column counts; fillers and malformed ones don't."""

    def one(c: Column) -> Column:
        u = F.upper(strip(c))
        return F.when(u.rlike("^[A-Z]{3}$") & ~is_filler(c), F.concat(F.lit("i:"), u)).when(u.rlike("^([A-Z0-9][A-Z]|[A-Z][0-9]|[0-9]{2})$"), F.concat(F.lit("a:"), u))

    return F.array_compact(F.array_distinct(F.array(one(icao), one(iata))))


def with_name_parts(df: DataFrame, name: str, words: Words) -> DataFrame:
    """Adds core and rest of a name; both '' where it is missing or a filler."""
    known = df.sparkSession.sparkContext.broadcast(words)  # bounded, see names.learn

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = known.value
        for f in frames:
            parts = [w.parse(n) if isinstance(n, str) and n else ("X", "", "", "") for n in f[name]]
            yield f.assign(core=[p[1] for p in parts], rest=[p[2] for p in parts])

    return df.withColumn(name, F.when(~is_filler(F.col(name)), F.col(name))).mapInPandas(work, StructType([*df.schema.fields, StructField("core", StringType()), StructField("rest", StringType())]))


def name_tokens(core: Column, rest: Column) -> Column:
    """The coined name, its two ends (which one typo leaves alone in part), and the descriptive words."""
    coined = F.when(F.length(core) > 3, F.array(F.concat(F.lit("c:"), core), F.concat(F.lit("h:"), F.left(core, F.lit(5))), F.concat(F.lit("t:"), F.right(core, F.lit(5))))).when(core != "", F.array(F.concat(F.lit("c:"), core)))
    words = F.transform(F.filter(F.split(rest, " "), lambda w: w != ""), lambda w: F.concat(F.lit("d:"), w))
    return F.concat(F.coalesce(coined, F.array().cast("array<string>")), words)


def index(items: DataFrame, item: str, tokens: str) -> DataFrame:
    """Postings (token, item, impact): what each token adds to the BM25 score of an item."""
    n = items.count()
    sized = items.select(item, tokens, F.size(tokens).alias("_len"))
    mean = sized.agg(F.avg("_len")).head()[0] or 1.0
    rows = sized.select(item, "_len", F.explode(tokens).alias("token")).groupBy("token", item).agg(F.count("*").alias("tf"), F.first("_len").alias("_len"))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.lit(mean)))
    return rows.join(df, "token").select("token", item, (idf * gain).alias("impact"))


def _fetched(must: DataFrame, query: str, postings: DataFrame, item: str) -> DataFrame:
    """(query, item) of every item in the postings of a query's tokens; long postings are cut by a salt, so none is one task's."""
    parts = postings.groupBy("token").agg(F.ceil(F.count("*") / HEAVY_TOKEN).cast("int").alias("_parts"))
    p = postings.join(parts, "token").select("token", item, F.pmod(F.xxhash64(item), F.col("_parts")).cast("int").alias("_salt"))
    q = must.select(query, "token").join(parts, "token").select(query, "token", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"))
    return q.join(p, ["token", "_salt"]).select(query, item).distinct()


def retrieve(queries: DataFrame, query: str, postings: DataFrame, item: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """(query, item, score, own, bare, own_bare): every item that scores at least ``least_share`` of what the query's tokens
    could reach; ``bare`` and ``own_bare`` are both without the tokens that label.

    Exact: of each query's tokens, in order of their greatest impact, those that together stay below the threshold can't
    bring an item over it, so only the others fetch candidates; these are then scored by all tokens.
    """
    ub = postings.groupBy("token").agg(F.max("impact").alias("ub"))
    n = postings.agg(F.count_distinct(item)).head()[0]
    # A token that no item has could have been the rarest one, so words that all share can't stand for a whole record.
    unseen = F.log1p((F.lit(n) + 0.5) / 0.5)
    q = queries.select(query, F.explode(F.array_distinct("tokens")).alias("token")).join(ub, "token", "left").withColumn("ub", F.coalesce("ub", unseen))
    w = W.partitionBy(query)
    q = q.withColumn("own", F.sum("ub").over(w)).withColumn("_below", F.sum("ub").over(w.orderBy("ub", "token").rowsBetween(W.unboundedPreceding, 0)))
    q = written(q.withColumn("must", F.col("_below") >= least_share * F.col("own")), "queries")
    cand = _fetched(q.where("must"), query, postings, item)
    have = postings.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("token", "impact"))).alias("_m"))
    labels = F.col("token").startswith(LABEL)
    want = q.groupBy(query).agg(F.collect_list(F.when(~labels, F.col("token"))).alias("_t"), F.collect_list(F.when(labels, F.col("token"))).alias("_l"), F.first("own").alias("own"), F.sum(F.when(labels, 0.0).otherwise(F.col("ub"))).alias("own_bare"))
    score = lambda ts, start: F.aggregate(ts, start, lambda a, t: a + F.coalesce(F.try_element_at(F.col("_m"), t), F.lit(0.0)))
    scored = cand.join(want, query).join(have, item).withColumn("bare", score("_t", F.lit(0.0))).withColumn("score", score("_l", F.col("bare")))
    return scored.select(query, item, "score", "own", "bare", "own_bare").where(F.col("score") >= least_share * F.col("own"))


def nearest(found: DataFrame, query: str, k: int = K, near: float = NEAR) -> DataFrame:
    """Of each query's items those of its k best scores, ties whole, and any others from ``near`` of its best score."""
    w = W.partitionBy(query)
    ranked = found.withColumn("_rank", F.dense_rank().over(w.orderBy(F.desc("score")))).withColumn("_best", F.max("score").over(w))
    return ranked.where((F.col("_rank") <= k) | (F.col("score") >= near * F.col("_best"))).drop("_rank", "_best")


def _level(core_a: Column, rest_a: Column, core_b: Column, rest_b: Column, weak: frozenset[str]) -> Column:
    """3: equal names; 2: a shortened form, or one typo; 1: the coined name alone; 0: neither. Weak words alone shorten any name."""
    typo = (F.length(core_a) > 4) & (F.length(core_b) > 4) & F.coalesce(one_typo(core_a, core_b), F.lit(False))
    words = lambda r: F.array_sort(F.split(r, " "))
    same = words(rest_a) == words(rest_b)
    short = lambda s, f: (s == "") | s.isin(*weak) | f.startswith(F.concat(s, F.lit(" ")))
    part = short(rest_a, rest_b) | short(rest_b, rest_a)
    named = (core_a != "") & (core_b != "")
    return F.when(named & (core_a == core_b) & same, 3).when(named & (((core_a == core_b) & part) | (typo & same)), 2).when(named & ((core_a == core_b) | typo), 1).otherwise(0)


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 60, ridge: float = PRIOR_PAIRS) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to ``prior`` as by ``ridge`` pairs.

    A whole step can overshoot where nearly all pairs are told apart, and then the next ones run away; so a step is halved
    until the loss falls. The loss has one minimum only, so this reaches it.
    """
    loss = lambda v: (np.logaddexp(0, x @ v) - y * (x @ v)).sum() + ridge / 2 * ((v - prior) ** 2).sum()
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        now, part = loss(w), 1.0
        while part > 1e-9 and loss(w - part * d) > now - 1e-4 * part * (g @ d):
            part /= 2
        w -= part * d
        if np.abs(d).max() < 1e-6:
            break
    return w


FEATURES = ("one", "share", "gap", "same", "part", "coined", "iata_same", "iata_other")


def calibrate(pairs: DataFrame, items: int) -> tuple[list[float], float, float, float, float]:
    """Weights of the features, and the log odds that an equal or a different longer code adds, and a different one where
    the names are equal; and those of an item of another name that only its longer code brought among the candidates.

    Pairs whose two records both state the longer code serve as labels of all other evidence: equal or not. The features
    leave that code out, and only pairs that are candidates without it are labels: among those that it fetched, it would
    agree whether they match or not, the more so the more items share a code. The code's own
    odds come from how often it is equal in pairs of equal names and equal shorter codes, against pairs of different names;
    whether equal names with different longer codes are two entities or a mistyped code, the shorter codes of such pairs tell.
    An item of another name that the code fetched was drawn from all items, not from the few that are like the record, and
    its odds are less by that ratio.
    A bounded sample by hash; the fewer labels there are, the nearer the weights stay to PRIOR_WEIGHTS and the odds to 9 of
    10 and 1 of 100.
    """
    known = pairs.where((F.col("icao") != 0) & (F.col("share") >= LEAST_SHARE))
    sample = known.orderBy(F.xxhash64("record", "item")).limit(FIT_ON).select(*FEATURES, "icao").toPandas()
    y = (sample["icao"] > 0).to_numpy(float)
    w = _fit(sample[list(FEATURES)].to_numpy(float).reshape(len(y), len(FEATURES)), y, np.array(PRIOR_WEIGHTS))
    surely = y[((sample["same"] > 0) & (sample["iata_same"] > 0)).to_numpy(bool)]
    other = y[(sample[["same", "part", "coined"]].sum(axis=1) == 0).to_numpy(bool)]
    right = (surely.sum() + 0.9 * 10) / (len(surely) + 10)
    wrong = (other.sum() + 0.01 * 100) / (len(other) + 100)
    wrong = min(wrong, right / 2)
    agree, differ = float(np.log(right / wrong)), float(np.log((1 - right) / (1 - wrong)))
    clash = ((sample["same"] > 0) & (y == 0)).to_numpy(bool)
    told = clash & ((sample["iata_same"] + sample["iata_other"]) > 0).to_numpy(bool)
    x = sample[list(FEATURES)].to_numpy(float).reshape(len(y), len(FEATURES))[clash]
    one = (float(sample["iata_same"][told].sum()) + 1) / (told.sum() + 2)
    base = float((x[:, :-2] @ w[:-2]).mean()) if clash.any() else -differ
    n = pairs.agg(F.count_if((F.col("level") == 0) & (F.col("share") >= LEAST_SHARE)).alias("near"), F.count_distinct("record").alias("records")).head()
    near = (n["near"] + 1) / (n["records"] + 1)
    return w.tolist(), agree, differ, max(differ, float(np.log(one / (1 - one))) - base), min(0.0, float(np.log(near / max(items, 1))))


def match(records: DataFrame, items: DataFrame, weak: frozenset[str] = frozenset()) -> DataFrame:
    """(record, item, confidence) of matching rows; each side has names (array<struct<core, rest>>) and codes (array).

    A record has a row for each spelling and codes that it states; each of these variants is looked up by itself, once for
    all records that state it, and the best one counts, so that further spellings don't weaken a match. An item may match
    several records and the other way about, so copies of an entity all match.
    """
    toks = lambda names, codes: F.concat(F.flatten(F.transform(names, lambda n: name_tokens(n["core"], n["rest"]))), codes)
    postings = written(index(items.select("item", toks(F.col("names"), F.col("codes")).alias("tokens")), "item", "tokens"), "postings")
    stated = records.select("record", F.to_json(F.struct("names", "codes")).alias("variant"), "names", "codes").distinct()
    a = stated.dropDuplicates(["variant"]).select("variant", F.col("names").alias("names_a"), F.col("codes").alias("codes_a"))
    found = written(retrieve(a.select("variant", toks(F.col("names_a"), F.col("codes_a")).alias("tokens")), "variant", postings, "item"), "found")
    b = items.select("item", F.col("names").alias("names_b"), F.col("codes").alias("codes_b"))
    level = F.array_max(F.transform("names_a", lambda x: F.array_max(F.transform("names_b", lambda y: _level(x["core"], x["rest"], y["core"], y["rest"], weak)))))

    def code(kind: str) -> Column:
        mine, theirs = (F.filter(c, lambda x: x.startswith(kind)) for c in ("codes_a", "codes_b"))
        return F.when((F.size(mine) > 0) & (F.size(theirs) > 0), F.when(F.arrays_overlap(mine, theirs), 1).otherwise(-1))

    who = F.array_join(F.transform("names_b", lambda n: F.concat_ws(" ", n["core"], F.array_join(F.array_sort(F.split(n["rest"], " ")), " "))), "|").alias("who")
    # Of a record that states nothing but the longer code, that is all there is.
    bare = F.when(F.col("own_bare") > 0, F.col("bare") / F.col("own_bare")).otherwise(F.col("score") / F.col("own"))
    each = found.join(a, "variant").join(b, "item").select("variant", "item", (F.col("score") / F.col("own")).alias("score"), bare.alias("bare"), F.coalesce(level, F.lit(0)).alias("level"), code(LABEL).alias("icao"), code("a:").alias("iata"), who)
    any_ = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    # All that comes from one record has one hash partition; of its variants the best one holds for each item.
    pairs = stated.select("record", "variant").join(each, "variant").groupBy("record", "item").agg(F.max("score").alias("score"), F.max("bare").alias("bare"), F.max("level").alias("level"), any_("icao"), any_("iata"), F.min("who").alias("who"))
    pairs = nearest(pairs, "record")
    by_record, by_item = W.partitionBy("record"), W.partitionBy("item")
    best = F.max("bare").over(by_record)
    # The runner-up is the best candidate of another name than the best one; copies of the best are no rivals.
    top = F.max_by("who", F.struct("bare", "item")).over(by_record)
    rival = F.coalesce(F.max(F.when(F.col("who") != F.col("_top"), F.col("bare"))).over(by_record), F.lit(0.0))
    pairs = pairs.withColumn("_best", best).withColumn("_top", top).withColumn("_rival", rival).withColumn("_theirs", F.max("score").over(by_item))
    gap = F.col("bare") - F.when(F.col("who") == F.col("_top"), F.col("_rival")).otherwise(F.col("_best"))
    one = lambda c: c.cast("double")
    pairs = written(
        pairs.select("record", "item", "icao", "iata", "level", F.lit(1.0).alias("one"), F.col("bare").alias("share"), gap.alias("gap"), one(F.col("level") == 3).alias("same"), one(F.col("level") == 2).alias("part"), one(F.col("level") == 1).alias("coined"),
            one(F.col("iata") > 0).alias("iata_same"), one(F.col("iata") < 0).alias("iata_other"), (F.col("score") >= NEAR_ITEM * F.col("_theirs")).alias("mutual")),
        "pairs",
    )
    w, agree, differ, clash, fetched = calibrate(pairs, items.count())
    odds = sum((F.col(f) * x for f, x in zip(FEATURES, w)), F.lit(0.0))
    odds = odds + F.when(F.col("icao") > 0, agree).when((F.col("icao") < 0) & (F.col("same") > 0), clash).when(F.col("icao") < 0, differ).otherwise(0.0)
    odds = odds + F.when((F.col("level") == 0) & (F.col("share") < LEAST_SHARE), fetched).otherwise(0.0)
    return pairs.where("mutual").select("record", "item", "level", "icao", "iata", "share", "gap", (1 / (1 + F.exp(-odds))).alias("confidence"))


def match_operators(sources: DataFrame, operators: DataFrame, words: Words | None = None) -> DataFrame:
    """(source_id, operator_id, confidence): rows of operator_sources with the operators that they describe.

    Each spelling with its codes that rows of a record (type and source_ref) state is looked up by itself, and the best
    match holds for all rows of the record; a row without source_ref is a record of its own. Rows without any usable name or code match nothing. Descriptive words of the names are learnt from both tables
    unless ``words`` are given.
    """
    m = sources.select("id", "type", "name", "icao_code", "iata_code", strip(members(F.col("data"))["source_ref"]).alias("ref"))
    m = m.select("id", "name", F.when(F.coalesce(F.col("ref"), F.lit("")) != "", F.concat_ws("|", "type", "ref")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))).alias("record"), code_tokens(F.col("icao_code"), F.col("iata_code")).alias("codes"))
    members_ = written(m, "rows")
    if words is None:
        both = members_.select("name").unionByName(operators.select("name"))
        words = learn(written(both.where(~is_filler(F.col("name"))).distinct(), "texts"))
    distinct = with_name_parts(members_.select("record", "name", "codes").distinct(), "name", words)
    named = F.when((F.col("core") != "") | (F.col("rest") != ""), F.array(F.struct("core", "rest"))).otherwise(F.array().cast("array<struct<core:string,rest:string>>"))
    records = written(distinct.select("record", named.alias("names"), "codes").distinct(), "records")
    o = with_name_parts(operators.select(F.col("id").alias("item"), "name", code_tokens(F.col("icao_code"), F.col("iata_code")).alias("codes")), "name", words)
    items = written(o.select("item", F.array(F.struct("core", "rest")).alias("names"), "codes"), "items")
    found = match(records, items, words.weak)
    return members_.select("record", F.col("id").alias("source_id")).join(found, "record").select("source_id", F.col("item").alias("operator_id"), "confidence", "level", "icao", "iata", "share", "gap")
