"""Subject areas of documents, by propagating labels over the documents' shared terms.

Two documents are linked by every term that both hold, with the term's weight times its frequency in each; the links are
kept factored as a graph of documents and terms, which holds exactly the same similarities without listing pairs. A link
counts only through terms that are verified to tell subjects apart (MIN_GAIN), so general vocabulary links nothing.

A sentence may name a subject only to set the document apart from it. Which ones do is learnt from the labelled documents:
words whose sentences name other subjects than their document's own far more often than sentences do in general. Sentences
that hold such a word are no part of the graph.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.text import BLANKS, strip
from skyledger.llm.shared import written

#: Labelled documents that the first term weights are fitted on, at most; any more are chosen by hash. All labels clamp.
FIT_ON = 50_000
#: Terms count from this part of what knowing a document's subject tells (the entropy of the subjects in the corpus).
MIN_GAIN = 0.22
#: Rounds of propagation go on until at most this share of the documents changes its subjects, or this often.
SETTLED, ROUNDS = 0.002, 8
#: A word tells of comparison where its sentences name their document's own subjects at most this part as often as all
#: sentences do; as much evidence for the usual as so many documents weigh comes first.
FOREIGN, FOREIGN_PRIOR = 0.4, 3.0
#: Terms and words of comparison that the fit on labelled documents yields, at most: those that tell most.
FIT_TERMS, FIT_WORDS = 200_000, 20_000
#: Term tables of at most so many rows are broadcast.
BROADCAST_TERMS = 100_000
#: Labelled documents are broadcast up to this number of rows of one key and one share per subject.
BROADCAST_SEEDS = 150_000
#: A label is trusted where the document's own terms give its subject at least this share of the largest one's.
TRUSTED = 0.1
#: Subjects are kept from this share of the document's largest one, a trusted label's from TRUSTED.
KEEP = 0.27
#: Prior weight of the corpus's subjects in a term's.
PRIOR = 1.0

#: Pieces of text that are counted at a time, and pieces that a worker remembers before it begins anew; speed and memory only.
CHUNK, REMEMBERED = 200_000, 500_000

_TAG = re.compile(r"<(?:br|/p|/div|/li)\b[^>]*>")
_SENTENCE = re.compile(rf"(?<=[.!?])\s+|\n|{_TAG.pattern}")
_WORD = re.compile(r"[^\W\d_]{3,}")


def own_text(text: str, foreign: frozenset[str]) -> str:
    """The text without the sentences that hold a word of comparison."""
    return "\n".join(x for x in _SENTENCE.split(text) if foreign.isdisjoint(_WORD.findall(x.lower())))


class _Pieces(dict):
    """Blank-separated pieces of text, numbered as they are met, and the lower-case words in them, numbered likewise.

    ``known`` gives words a row of a model, all others have -1.
    """

    def __init__(self, known: dict[str, int], foreign: frozenset[str]) -> None:
        self.known, self.foreign = known, foreign
        self.words: dict[str, int] = {}
        self.rows = array("i")  # by word
        self.at, self.held = array("q", [0]), array("i")  # where a piece's words begin, and the words
        self.ends, self.tells = bytearray(), bytearray()  # by piece: it ends a sentence, it holds a foreign word

    def __missing__(self, piece: str) -> int:
        found = _WORD.findall(piece.lower())
        for w in found:
            n = self.words.get(w)
            if n is None:
                n = self.words[w] = len(self.words)
                self.rows.append(self.known.get(w, -1))
            self.held.append(n)
        self.at.append(len(self.held))
        self.ends.append(piece[-1] in ".!?")
        self.tells.append(not self.foreign.isdisjoint(found))
        n = self[piece] = len(self)
        return n


class _Chunk(NamedTuple):
    """Texts from..to of a batch as words: every word's text and sentence, counted from 0, and its number in ``pieces``."""

    start: int
    stop: int
    pieces: _Pieces
    text: np.ndarray
    sentence: np.ndarray
    word: np.ndarray


def _chunks(texts: list[str], pieces: _Pieces) -> Iterator[_Chunk]:
    """All words of the texts but those of sentences that hold a foreign word, some CHUNK pieces at a time.

    Texts are cut into sentences as by _SENTENCE, except at tags, which callers take out.
    """
    start, ids, lines, ends = 0, array("i"), array("q", [0]), array("q", [0])
    for i, t in enumerate(texts, 1):
        for line in t.split("\n"):
            ids.extend(map(pieces.__getitem__, line.split()))
            lines.append(len(ids))
        ends.append(len(ids))
        if len(ids) < CHUNK and i < len(texts):
            continue
        piece = np.array(ids, np.int32)
        text = np.repeat(np.arange(i - start, dtype=np.int32), np.diff(np.array(ends, np.int64)))
        begins = np.zeros(len(piece) + 1, np.bool_)
        begins[np.array(lines, np.int64)] = True
        begins[1:] |= np.array(pieces.ends, np.bool_)[piece]
        sentence = np.cumsum(begins[:-1], dtype=np.int32) - 1
        apart = np.array(pieces.tells, np.bool_)[piece]
        if apart.any():
            gone = np.zeros(sentence[-1] + 1, np.bool_)
            gone[sentence[apart]] = True
            kept = ~gone[sentence]
            piece, text, sentence = piece[kept], text[kept], sentence[kept]
        at = np.array(pieces.at, np.int64)
        n = np.diff(at)[piece]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word = np.array(pieces.held, np.int32)[np.repeat(at[piece], n) + nth]
        yield _Chunk(start, i, pieces, np.repeat(text, n), np.repeat(sentence, n), word)
        start, ids, lines, ends = i, array("i"), array("q", [0]), array("q", [0])
        if len(pieces) > REMEMBERED:
            pieces = _Pieces(pieces.known, pieces.foreign)


def _pairs(first: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each is there."""
    pair = first.astype(np.int64) * words + word
    pair.sort()
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    pair, n = pair[at], np.diff(at, append=len(pair))
    first = pair // max(words, 1)
    return first, pair - first * words, n


def term_counts(docs: DataFrame, key: str, text: str, model: dict[str, list[float]] | None = None, foreign: frozenset[str] = frozenset()) -> DataFrame:
    """(key, terms array<string>, lf array<float>) of texts that aren't null or blank: terms, each once, and the
    logarithms of one more than their counts, without sentences that hold a ``foreign`` word. With a model of terms also q,
    the subjects' shares among its terms, null where the text has none of them.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((list(model), np.array(list(model.values()) or [[0.0]]))) if model is not None else None  # FIT_TERMS at most

    def untagged(t: str) -> str:
        if foreign and "<" in t and _TAG.search(t) and not foreign.isdisjoint(_WORD.findall(t.lower())):
            return own_text(t, foreign)
        return t

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value if shared else ([], np.zeros((1, 1)))
        k = weights.shape[1] - 1
        pieces = _Pieces({w: i for i, w in enumerate(known)}, foreign)
        for batch in batches:
            for c in _chunks([untagged(t) for t in batch.column(1).to_pylist()], pieces):
                pieces, m = c.pieces, c.stop - c.start
                doc, word, n = _pairs(c.text, c.word, len(pieces.words))
                lf = np.log1p(n)
                at = pa.array(np.searchsorted(doc, np.arange(m + 1)), pa.int32())
                terms = pa.array(list(pieces.words), pa.string()).take(pa.array(word))
                cols = [batch.column(0).slice(c.start, m), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(lf, pa.float32()))]
                if shared:
                    row = np.array(pieces.rows, np.int32)[word]
                    hit = np.flatnonzero(row >= 0)
                    row, doc, lf = row[hit], doc[hit], lf[hit]
                    sums = np.stack([np.bincount(doc, weights[row, i] * lf, m) for i in range(k + 1)], 1)
                    told = sums[:, k] > 0
                    q = (sums[told, :k] / sums[told, k:]).ravel()
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(told * k)), pa.int32()), pa.array(q, pa.float64()), mask=pa.array(~told)))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "terms", "lf", "q"][: len(cols)])

    return docs.where(F.col(text).rlike(rf"[^{BLANKS}]")).select(key, text).mapInArrow(work, f"{key} {kind}, terms array<string>, lf array<float>" + ", q array<double>" * bool(shared))


def foreign_words(docs: DataFrame, labels: DataFrame, key: str, text: str, model: dict[str, list[float]]) -> frozenset[str]:
    """Words whose sentences name other subjects than those of their document; ``labels`` has y, the shares of the labels.

    Each document counts once for a word, by the mean over its sentences that hold the word and a term of the model: the
    share of these terms whose first subject is one of the document's.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: max(range(len(m) - 1), key=m.__getitem__) for t, m in model.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(shared.value, frozenset())
        for batch in batches:
            own = np.array(batch.column(1).to_pylist()) > 0
            for c in _chunks([_TAG.sub("\n", t) if "<" in t else t for t in batch.column(0).to_pylist()], pieces):
                pieces, words = c.pieces, len(c.pieces.words)
                sentence, word, _ = _pairs(c.sentence, c.word, words)
                text_of = np.zeros(sentence.max(initial=-1) + 1, np.int64)
                text_of[c.sentence] = c.text
                subject = np.array(pieces.rows, np.int32)[word]
                telling = subject >= 0
                at = sentence[telling]
                n = np.bincount(at, minlength=len(text_of))
                right = np.bincount(at, own[c.start + text_of[at], subject[telling]], len(text_of)) / np.maximum(n, 1)
                rest = ~telling & (n[sentence] > 0)
                sentence, word = sentence[rest], word[rest]
                pair, of, times = np.unique(text_of[sentence] * words + word, return_inverse=True, return_counts=True)
                mean, word = np.bincount(of, right[sentence], len(pair)) / times, pair % max(words, 1)
                seen = np.bincount(word, minlength=words)
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(list(pieces.words), pa.string()).take(pa.array(some)), pa.array(seen[some], pa.int64()), pa.array(np.bincount(word, mean, words)[some], pa.float64())], names=["word", "n", "own"])

    rows = docs.where(F.col(text).rlike(rf"[^{BLANKS}]")).join(F.broadcast(labels), key).select(text, "y")  # FIT_ON rows at most
    sums = written(rows.mapInArrow(work, "word string, n long, own double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own")), "words")
    usual = sums.agg(F.sum("own") / F.sum("n")).head()[0] or 1.0
    rate = (F.col("own") + FOREIGN_PRIOR * usual) / (F.col("n") + FOREIGN_PRIOR)
    return frozenset(r["word"] for r in sums.where(rate <= FOREIGN * usual).orderBy(F.desc("n"), "word").limit(FIT_WORDS).collect())


def clean_labels(labels: DataFrame, subjects: DataFrame, key: str, subject: str) -> DataFrame:
    """Distinct (key, subject): spelled as in ``subjects`` whatever the case and blanks; labels of no known subject are left out."""
    known = subjects.select(F.col(subject).alias("_known"), F.lower(strip(F.col(subject))).alias("_s")).where(F.col("_s") != "").dropDuplicates(["_s"])
    return labels.where(F.col(key).isNotNull()).select(key, F.lower(strip(F.col(subject))).alias("_s")).distinct().join(known, "_s").select(key, F.col("_known").alias(subject))


def _sum_of(shares: str, names: list[str]) -> list[Column]:
    return [F.sum(F.col(shares)[i]).alias(f"s{i}") for i in range(len(names))]


def _small(df: DataFrame) -> DataFrame:
    """The table to be broadcast where it has been checked to be small; the same join by a shuffle else."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _term_model(sums: DataFrame, names: list[str], base: list[float]) -> DataFrame:
    """(term, g array<double>, w): a verified term's shares of the subjects times its weight, and the weight."""
    least = MIN_GAIN * -sum(b * math.log(b) for b in base)
    n = sum((F.col(f"s{i}") for i in range(len(names))), F.lit(0.0))
    p = [(F.col(f"s{i}") + F.lit(PRIOR * b)) / (n + PRIOR) for i, b in enumerate(base)]
    w = sum((q * F.log(q / F.lit(b)) for q, b in zip(p, base)), F.lit(0.0))
    return sums.select("term", F.array(*p).alias("_p"), w.alias("w")).where(F.col("w") >= least).select("term", F.transform("_p", lambda x: x * F.col("w")).alias("g"), "w")


def _links(rows: DataFrame, keep: list[str]) -> DataFrame:
    pairs = F.explode(F.arrays_zip("terms", "lf")).alias("_e")
    return rows.select(*keep, pairs).select(*keep, F.col("_e.terms").alias("term"), F.col("_e.lf").alias("lf"))


def _sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """(term, s0, s1, ...): what the documents that hold a term pass on to it, added up before the shuffle."""
    return _links(rows, ["shares"]).groupBy("term").agg(*_sum_of("shares", names))


def _sums_by_model(rows: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    """The same, where a document of several subjects passes to a term mostly those that the term already has."""
    joined = _links(rows, ["shares"]).join(_small(model), "term")
    # Plain columns, since lambdas would leave generated code.
    both = [F.col("shares")[i] * F.col("g")[i] for i in range(len(names))]
    flat = joined.select("term", *[b.alias(f"f{i}") for i, b in enumerate(both)], *[F.col("shares")[i].alias(f"x{i}") for i in range(len(names))])
    total = sum((F.col(f"f{i}") for i in range(len(names))), F.lit(0.0))
    flat = flat.withColumn("_t", total)
    return flat.groupBy("term").agg(*[F.sum(F.when(F.col("_t") > 0, F.col(f"f{i}") / F.col("_t")).otherwise(F.col(f"x{i}"))).alias(f"s{i}") for i in range(len(names))])


def _estimate(links: DataFrame, model: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, q array<double>): shares of the subjects among a document's verified terms."""
    joined = links.join(_small(model), "term")
    total = F.sum(F.col("lf") * F.col("w"))
    return joined.groupBy(key).agg(F.array(*[F.sum(F.col("lf") * F.col("g")[i]) / total for i in range(len(names))]).alias("q"))


def _sharpened(q: Column) -> Column:
    square = F.transform(q, lambda x: x * x)
    total = F.aggregate(square, F.lit(0.0), lambda a, x: a + x)
    return F.transform(square, lambda x: x / total)


def _passed_on(q: Column) -> Column:
    """What a document passes on: the subjects that it keeps, the stronger ones more."""
    return _sharpened(F.transform(q, lambda x: F.when(x >= KEEP * F.array_max(q), x).otherwise(F.lit(0.0))))


def _trusted(q: Column, y: Column) -> Column:
    """The labels of a seed that its own terms don't speak against, as shares; null where there is none."""
    ok = F.when(q.isNull(), y).otherwise(F.zip_with(y, q, lambda y, x: F.when(x >= TRUSTED * F.array_max(q), y).otherwise(F.lit(0.0))))
    total = F.aggregate(ok, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(ok, lambda x: x / total))


def _base(shares: DataFrame, names: list[str]) -> list[float]:
    """Shares of the subjects in all that is passed on; never 0."""
    row = shares.agg(*_sum_of("shares", names)).head()
    sums = [float(x or 0.0) for x in row]
    total = sum(sums) or 1.0
    return [max(x / total, 1e-6) for x in sums]


def _fitted(fit: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Terms of labelled documents with their shares of the subjects and weights, FIT_TERMS at most, those that tell most."""
    rows = _term_model(_sums(fit, names), names, _base(fit, names)).orderBy(F.desc("w"), "term").limit(FIT_TERMS).collect()
    return {r["term"]: [*r["g"], r["w"]] for r in rows}


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", rounds: int = ROUNDS) -> DataFrame:
    """(key, subject): the areas of every document whose text isn't null or blank, one or more.

    Labels that a document's own terms don't speak against are clamped: it passes them on in every round and has them in the
    end, whatever its estimate. A document without any term that tells subjects apart has its labels, or no area where it
    has none. Without labels, or without subjects, there are no rows. Rows of one document id are one document; labels of
    unknown documents are ignored.
    """
    names = [r[0] for r in subjects.select(F.col(subject)).where(strip(F.col(subject)) != "").distinct().orderBy(subject).collect()]  # a fixed list of areas
    if not names:
        return docs.select(key, F.lit("").alias(subject)).limit(0)
    seeds = clean_labels(labels, subjects, key, subject).groupBy(key).agg(F.collect_set(subject).alias("_l"))
    seeds = written(seeds.select(key, F.array(*[F.when(F.array_contains("_l", n), 1.0 / F.size("_l")).otherwise(0.0) for n in names]).alias("y")), "seeds")

    # First weights, from a bounded sample of labelled documents, so the driver holds a bounded model.
    sample = written(seeds.orderBy(F.xxhash64(key), key).limit(FIT_ON), "sample")
    labelled = written(docs.join(F.broadcast(sample.select(key)), key, "left_semi").select(key, text), "labelled")
    fit = lambda foreign: written(term_counts(labelled, key, text, None, foreign).join(F.broadcast(sample.withColumnRenamed("y", "shares")), key), "fit")
    foreign = foreign_words(labelled, sample, key, text, _fitted(fit(frozenset()), names))
    first = _fitted(fit(foreign), names)

    # First estimates of all documents as their terms are counted; all terms then learn from all documents.
    flat = written(term_counts(docs, key, text, first, foreign), "terms")
    few = seeds.count() <= BROADCAST_SEEDS
    held = written(flat.select(key, "q").join(F.broadcast(seeds) if few else seeds, key).select(key, _trusted(F.col("q"), F.col("y")).alias("y")).where(F.col("y").isNotNull()), "held")
    known = flat.where(F.col("q").isNotNull())
    own = known.select("terms", "lf", _passed_on(F.col("q")).alias("shares"))
    # Of seeds, what clamping adds to their own estimates.
    more = flat.join(F.broadcast(held) if few else held, key)
    none = F.array(*[F.lit(0.0)] * len(names))
    more = more.select("terms", "lf", F.zip_with("y", F.coalesce(_passed_on(F.col("q")), none), lambda a, b: a - b).alias("shares"))
    both = own.unionByName(more)
    model = written(_term_model(_sums(both, names), names, _base(both, names)), "model")

    # From here on only links through verified terms are carried.
    links = _links(flat, [key]).join(_small(model.select("term")), "term", "left_semi")
    links = written(links.groupBy(key).agg(F.collect_list(F.struct("term", "lf")).alias("_e")).select(key, F.col("_e.term").alias("terms"), F.col("_e.lf").alias("lf")), "links")
    before, n = None, links.count()
    for _ in range(rounds):
        q = written(_estimate(_links(links, [key]), model, key, names), "q")
        if before is not None:
            kept = lambda c: F.transform(c, lambda x: x >= KEEP * F.array_max(c))
            changed = q.join(before.withColumnRenamed("q", "_p"), key, "full").where(~kept(F.col("q")).eqNullSafe(kept(F.col("_p")))).count()
            if changed <= SETTLED * n:
                break
        before = q
        shares = q.join(held, key, "left").select(key, F.coalesce("y", _passed_on(F.col("q"))).alias("shares"))
        shares = written(links.join(shares, key).drop(key), "shares")
        model = written(_term_model(_sums_by_model(shares, model, names), names, _base(shares, names)), "model")
    final = q.join(held, key, "full")
    label = F.array(*[F.lit(n) for n in names])
    scored = final.select(key, F.array_max("q").alias("_top"), F.explode(F.arrays_zip(label.alias("s"), F.coalesce("q", none).alias("x"), F.coalesce("y", none).alias("y"))).alias("_z"))
    return scored.where((F.col("_z.x") >= KEEP * F.col("_top")) | (F.col("_z.y") > 0)).select(key, F.col("_z.s").alias(subject))
