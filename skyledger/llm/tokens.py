"""Byte-pair encoding with a public tokenizer's files, by DuckDB inside each partition.

Texts are cut into words by RE2 expressions; distinct words that the worker hasn't met yet become token-position rows of a
recursive query that joins the merge table and contracts each word's leftmost pair of minimum rank, and that pair's other
occurrences in the word with it, until no pair is left. Words' ids are kept for later texts and put together by ordered
aggregation.

Words longer than PIECE bytes go through the query in pieces. Tokens in a row are the encoding of their bytes if and only
if every two neighbours are that of theirs, so the pieces' tokens are checked where they meet, and where two don't fit the
tokens around are put together and encoded anew, in a window that grows until both its ends fit. So the time goes with the
length of a word, not its square, and the ids are exactly those of the whole word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Folder of the tokenizer files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Texts are handled in pieces of about so many bytes, which bounds a worker's memory (a longer text is its own piece).
CHUNK_BYTES = 10 << 20
#: A worker forgets its words when it knows more than this; they are simply worked out again.
WORDS_KEPT = 1_000_000
#: Bytes of a word, or of a piece of a longer one, that the recursive query works on.
PIECE = 48
#: The query keeps the rows of every step, so words go in batches of at most so many squared bytes (about 60 bytes a row).
BATCH = 2_000_000

#: White space of the tokenizer's word pattern, as RE2 class body.
SPACE = r"\t\n\v\f\r\x{85}\p{Z}"
#: Letters and digits of Unicode 16 that RE2's classes don't have yet.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 "
    "113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0 2EBF0-2EE5D"
)
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def _class(name: str, ranges: str) -> str:
    return rf"\p{{{name}}}" + "".join("\\x{{{}}}-\\x{{{}}}".format(*r.split("-")) for r in ranges.split())


LETTER, DIGIT = _class("L", NEW_LETTERS), _class("N", NEW_DIGITS)


def _byte_letters() -> dict[int, str]:
    """Letter by which the vocabulary file writes each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def load_merges(path: str) -> dict[str, list]:
    """Columns of the merge table (left, right, rank, merged) and of the byte table (hex, id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, rows = model["vocab"], {"l": [], "r": [], "rank": [], "m": []}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        for k, v in zip(rows, (vocab[a], vocab[b], rank, vocab[a + b])):
            rows[k].append(v)
    letters = _byte_letters()
    return rows | {"hex": [f"{b:02X}" for b in range(256)], "id": [vocab[letters[b]] for b in range(256)]}


_FIXPOINT = """
CREATE OR REPLACE TEMP TABLE fresh_ids AS
WITH RECURSIVE s(step, w, pos, tok) AS (
  SELECT 0, f.w, p.pos, b.id
  FROM fresh f, LATERAL (SELECT unnest(range(length(f.h) // 2)) AS pos) p
  JOIN byte_ids b ON b.hex = substr(f.h, 2 * p.pos + 1, 2)
  UNION ALL
  SELECT step + 1, w, pos, CASE WHEN take THEN m ELSE tok END
  FROM (
    SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND (i - coalesce(max(CASE WHEN hit THEN NULL ELSE i END) OVER (PARTITION BY w ORDER BY pos), 0)) % 2 = 1 AS take
      FROM (
        SELECT *, coalesce(rank = least_rank, false) AS hit
        FROM (
          SELECT a.*, g.m, g.rank, min(g.rank) OVER (PARTITION BY a.w) AS least_rank
          FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM s) a
          LEFT JOIN merges g ON a.tok = g.l AND a.nxt = g.r)
        WHERE least_rank IS NOT NULL)))
  WHERE NOT gone)
SELECT w, list(tok ORDER BY pos) AS ids FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM s) WHERE step = last GROUP BY w
"""


#: Each word's place in three hashed dimensions: plus or minus one, nothing for words without letters.
_SIGNS = ", ".join(f"CASE WHEN regexp_matches(w, '\\p{{L}}') THEN 1 - 2 * ((h >> {b}) & 1)::INTEGER ELSE 0 END" for b in (0, 1, 2))


class Encoder:
    """A DuckDB connection with the merge table and the words met so far; one in each Python worker."""

    _own: dict[str, Encoder] = {}

    def __init__(self, merges: dict[str, list]):
        import duckdb

        self.con = duckdb.connect()
        # Nothing spills to the worker's own disk: what is held at once is bounded by CHUNK_BYTES, BATCH and WORDS_KEPT.
        for option in ("threads = 1", "preserve_insertion_order = false", "memory_limit = '800MB'", "temp_directory = ''", "allocator_background_threads = false"):
            self.run(f"SET {option}")
        pairs = pa.table({"l": pa.array(merges["l"], pa.int32()), "r": pa.array(merges["r"], pa.int32()), "rank": pa.array(merges["rank"], pa.int32()), "m": pa.array(merges["m"], pa.int32())})
        single = pa.table({"hex": merges["hex"], "id": pa.array(merges["id"], pa.int32())})
        self.con.register("_pairs", pairs)
        self.con.register("_single", single)
        self.run("CREATE TABLE merges AS SELECT * FROM _pairs")
        self.run("CREATE TABLE byte_ids AS SELECT * FROM _single")
        self.bytes_of = {i: bytes.fromhex(h) for h, i in zip(merges["hex"], merges["id"])}
        for a, b, m in zip(merges["l"], merges["r"], merges["m"]):
            self.bytes_of[m] = self.bytes_of[a] + self.bytes_of[b]
        # A token that two merges make wouldn't be told by its bytes, and pieces couldn't be checked by neighbours.
        self.by_pieces = len(set(merges["m"])) == len(merges["m"])
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    @classmethod
    def own(cls, merges: dict[str, list], key: str) -> Encoder:
        if key not in cls._own:
            cls._own[key] = cls(merges)
        return cls._own[key]

    def forget(self) -> None:
        self.run("CREATE OR REPLACE TABLE known(w VARCHAR, ids INTEGER[], x FLOAT, y FLOAT, z FLOAT)")
        self.n_known = 0

    def cut(self, texts: pa.Array) -> None:
        """Leaves table cut(doc, p, w): the words of each text in order."""
        blob = "".join(t for t in texts.to_pylist() if t)
        # A character that none of these texts has marks where white space is divided; the search always ends.
        mark = next(c for c in map(chr, (*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900), *range(0x100000, 0x10FFFE))) if c not in blob)
        code = f"\\x{{{ord(mark):x}}}"
        words = rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}{code}]+|[{SPACE}]+"
        self.con.register("_texts", pa.table({"doc": pa.array(range(len(texts)), pa.int32()), "t": texts}))
        # Of white space before a word the last character goes with the word, or stands alone.
        marked = f"CASE WHEN regexp_matches(t, '[{SPACE}][{SPACE}][^{SPACE}]') THEN regexp_replace(t, '([{SPACE}])([{SPACE}][^{SPACE}])', '\\1{mark}\\2', 'g') ELSE t END"
        self.run(
            f"CREATE OR REPLACE TEMP TABLE cut AS SELECT doc, generate_subscripts(ws, 1)::INTEGER AS p, unnest(ws) AS w FROM (SELECT doc, regexp_extract_all({marked}, $p) AS ws FROM _texts WHERE t <> '')",
            {"p": words},
        )
        self.con.unregister("_texts")

    def learn(self) -> None:
        """Ids of words that weren't known."""
        if self.n_known > WORDS_KEPT:
            self.forget()
        self.run("CREATE OR REPLACE TEMP TABLE unknown AS SELECT *, sum(strlen(w) * strlen(w)) OVER (ORDER BY strlen(w), w) // $b AS batch FROM (SELECT DISTINCT w FROM cut ANTI JOIN known USING (w))", {"b": BATCH})
        size = f"strlen(w) <= {PIECE}" if self.by_pieces else "true"
        for (batch,) in self.run(f"SELECT DISTINCT batch FROM unknown WHERE {size} ORDER BY batch"):
            self.run(f"CREATE OR REPLACE TEMP TABLE fresh AS SELECT w, hex(encode(w)) AS h FROM unknown WHERE batch = $b AND {size}", {"b": batch})
            self.run(_FIXPOINT)
            self._keep("fresh_ids")
        long = [w for (w,) in self.run(f"SELECT w FROM unknown WHERE NOT ({size})")]
        if long:
            ids = self._long([w.encode() for w in long])
            self.con.register("_long", pa.table({"w": pa.array(long, pa.string()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
            self._keep("_long")
            self.con.unregister("_long")
        self.n_known = self.run("SELECT count(*) FROM known")[0][0]

    def _keep(self, source: str) -> None:
        self.run(f"INSERT INTO known SELECT w, ids, {_SIGNS} FROM (SELECT *, md5_number_lower(lower(trim(w))) AS h FROM {source})")

    def _pieces(self, pieces: set[bytes]) -> dict[bytes, list[int]]:
        """Ids of pieces of words by the recursive query, in batches."""
        out: dict[bytes, list[int]] = {}
        batch: list[str] = []
        held = 0
        for p in [*sorted(pieces, key=len), None]:
            if batch and (p is None or held + len(p) ** 2 > BATCH):
                self.con.register("_fresh", pa.table({"w": batch, "h": batch}))
                self.run("CREATE OR REPLACE TEMP TABLE fresh AS SELECT * FROM _fresh")
                self.con.unregister("_fresh")
                self.run(_FIXPOINT)
                out |= {bytes.fromhex(w): ids for w, ids in self.run("SELECT w, ids FROM fresh_ids")}
                batch, held = [], 0
            if p is not None:
                batch.append(p.hex().upper())
                held += len(p) ** 2
        return out

    def _long(self, words: list[bytes]) -> list[list[int]]:
        """Ids of long words, from those of pieces that are made to fit."""
        cuts = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        ids = self._pieces({p for c in cuts for p in c})
        tokens = [[ids[p] for p in c] for c in cuts]
        # Runs of tokens that are known to be right; where two runs meet is to be checked.
        reach = 4
        if len(self.fits) > WORDS_KEPT:
            self.fits.clear()
        while True:
            meet = {(a[-1], b[0]) for runs in tokens for a, b in zip(runs, runs[1:])} - self.fits.keys()
            if meet:
                whole = {(a, b): self.bytes_of[a] + self.bytes_of[b] for a, b in meet}
                ids = self._pieces(set(whole.values()))
                self.fits |= {ab: ids[w] == [*ab] for ab, w in whole.items()}
            again: list[tuple[int, list[list[int] | bytes]]] = []
            for i, runs in enumerate(tokens):
                out: list[list[int] | bytes] = []
                flat = [t for r in runs for t in r]
                at, bad = 0, []
                for a, b in zip(runs, runs[1:]):
                    at += len(a)
                    if not self.fits[a[-1], b[0]]:
                        bad.append(at)
                if not bad:
                    tokens[i] = [flat]
                    continue
                start = 0
                for k, j in enumerate(bad):
                    lo, hi = max(j - reach, start), min(j + reach, len(flat))
                    if out and lo <= start and k:  # windows that touch are one
                        lo = start
                        window = out.pop() if isinstance(out[-1], bytes) else b""
                    else:
                        window = b""
                        if lo > start:
                            out.append(flat[start:lo])
                    hi = max(hi, lo)
                    out.append(window + b"".join(self.bytes_of[t] for t in flat[lo:hi]))
                    start = hi
                if start < len(flat):
                    out.append(flat[start:])
                again.append((i, out))
            if not again:
                return [runs[0] for runs in tokens]
            ids = self._pieces({x for _, out in again for x in out if isinstance(x, bytes)})
            for i, out in again:
                tokens[i] = [ids[x] if isinstance(x, bytes) else x for x in out]
            reach *= 2

    def run(self, sql: str, values: dict | None = None) -> list:
        """Runs to the end: a connection allows one unfinished result at a time."""
        return self.con.execute(sql, values or {}).fetchall()

    def query(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_BYTES of text."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _merges_on_workers(spark: SparkSession, tokenizers: str, name: str):
    """The merge table is the same size for any data, so it is broadcast."""
    path = f"{tokenizers}/{name}.json"
    return path, spark.sparkContext.broadcast(load_merges(path))


def encode(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row; null and empty texts have an empty list, strings of special tokens are text."""
    path, merges = _merges_on_workers(docs.sparkSession, tokenizers, name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.own(merges.value, path)
        for batch in batches:
            for part in chunks(batch, text):
                enc.cut(part.column(text))
                enc.learn()
                got = enc.query("SELECT doc, flatten(list(ids ORDER BY p)) AS ids FROM cut JOIN known USING (w) GROUP BY doc")
                out = _scatter(got.column("doc").to_numpy(), got.column("ids").combine_chunks(), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(key), out], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def measure(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens, x, y, z): length in tokens, and the sum of the distinct words' hashed places over the root of their number."""
    path, merges = _merges_on_workers(docs.sparkSession, tokenizers, name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        enc = Encoder.own(merges.value, path)
        for batch in batches:
            for part in chunks(batch, text):
                enc.cut(part.column(text))
                enc.learn()
                got = enc.query(
                    "SELECT doc, sum(k * len(ids))::BIGINT AS n_tokens, (sum(x) / sqrt(count(*)))::DOUBLE AS x, (sum(y) / sqrt(count(*)))::DOUBLE AS y, (sum(z) / sqrt(count(*)))::DOUBLE AS z "
                    "FROM (SELECT doc, w, count(*) AS k FROM cut GROUP BY doc, w) JOIN known USING (w) GROUP BY doc"
                )
                at = pa.array(_places(got.column("doc").to_numpy(), part.num_rows))
                cols = [pc.fill_null(got.column(c).combine_chunks().take(at), 0) for c in ("n_tokens", "x", "y", "z")]
                yield pa.RecordBatch.from_arrays([part.column(key), *cols], names=[key, "n_tokens", "x", "y", "z"])

    return docs.select(key, text).mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, x double, y double, z double")


def _places(at, n: int):
    """For each of n rows its place in ``at``, null where it has none."""
    import numpy as np

    back = np.ma.masked_all(n, dtype=np.int64)
    back[at] = np.arange(len(at))
    return back


def _scatter(at, lists: pa.Array, n: int) -> pa.Array:
    """List array of n rows with ``lists`` at rows ``at`` and empty lists elsewhere."""
    import numpy as np

    back = np.full(n, len(lists), dtype=np.int64)
    back[at] = np.arange(len(lists))
    lists = lists.cast(pa.list_(pa.int32()))
    return pa.concat_arrays([lists, pa.array([[]], pa.list_(pa.int32()))]).take(pa.array(back))
