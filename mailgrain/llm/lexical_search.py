"""Ranked lexical search over hashed max-sketches.

The index holds one sketch per document: every distinct term falls on one of `width` coordinates, and a coordinate keeps
the largest term frequency that fell on it, rounded up to a one-byte code. The impact of a term grows with its frequency
and shrinks with the length of the document, so the impact of a coordinate's code is at least that of each of its terms,
and the sum of weight times impact over a query's coordinates is never below the document's score. The width is the
power of two above four times the number of distinct terms: sketches stay equally tight for short and long texts.

A search takes queries in blocks of at most `block` items. For a block every task looks all queries up in a batch of
sketches of one width at once (a matrix product of exact whole numbers below 2^53). Round by round the texts of the
highest bounds are scored exactly, and the k-th best score so far is the threshold of its query: texts whose bound lies
below it need no scoring. The last round takes every text that is left with a bound at or above its threshold, so
nothing is missed. Rounds only take more texts at once, they decide nothing.

Equal texts are scored once and share the score; each counts as a document of its own in the collection's statistics,
and of the ids of one text the k smallest can be in a result. Ids are ordered with null last; rows that repeat an id are
ranked like others. Null text has no terms. Items without terms, or that no document meets, have no rows. Columns beyond
id and text are ignored. Texts are told apart by their 64-bit hash.
"""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, written

# bytes of `[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]` part terms; A-Z become a-z; all others stay
_TERMS = bytes(c if c > 127 else ord(" ") if not chr(c).isalnum() else ord(chr(c).lower()) for c in range(256))
# frequency of a code: exact up to 64, then in steps of an eighth, so that 255 covers any text
_CODED = np.unique(np.concatenate([np.arange(65), np.ceil(64 * 1.125 ** np.arange(1, 191))])).astype(np.int64)
B, K = 75, 1000  # fixed values of the score: percent of length in m, scale of a weight
CANDIDATES = (64, 1024)  # texts a query takes in the first rounds
MOST_KEYS = 1_000_000  # texts that may be broadcast by hash; more are joined by shuffle


def terms(text) -> list:
    """Terms of one text (bytes), in order."""
    return text.translate(_TERMS).split() if text else []


def _place(term: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=4).digest(), "little")


class _Places(dict):
    """Hash of each term met, kept up to a bound per worker."""

    def __missing__(self, term):
        if len(self) > 500_000:
            self.clear()
        got = self[term] = _place(term)
        return got


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(text).alias("key"), text.alias("text"))


def index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n, sketch): one row per document with terms; `n` counts its terms, the sketch is `width` bytes of codes."""

    def run(batches):
        places = _Places()
        for b in batches:
            keys, sizes, sketches = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                width = max(64, 1 << (4 * len(counts) - 1).bit_length())
                at = np.fromiter(map(places.__getitem__, counts), np.int64, len(counts)) & (width - 1)
                code = np.searchsorted(_CODED, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
                sketch = np.zeros(width, np.uint8)
                np.maximum.at(sketch, at, code)
                keys.append(key)
                sizes.append(len(found))
                sketches.append(sketch.tobytes())
            yield arrow_rows(["key", "n", "sketch"], [pa.int64(), pa.int64(), pa.binary()], [keys, sizes, sketches])

    return _texts(docs, text_col).mapInArrow(run, "key long, n long, sketch binary")


def statistics(docs: DataFrame, wanted, text_col: str = "text") -> DataFrame:
    """(term, df) of the terms in `wanted`, over all rows of `docs`: counted per task, then summed."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))  # terms of one block of queries

    def run(batches):
        look, counts = known.value, Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                counts.update(look.intersection(terms(text)))
        yield arrow_rows(["term", "df"], [pa.binary(), pa.int64()], [list(counts), list(counts.values())])

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(K * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _m(n, n_docs, length):
    return 100 - B + (B * n * n_docs) // length


class Block:
    """The queries of one block: per query its terms with their weight times the times they occur."""

    def __init__(self, queries: dict, dfs: dict, n_docs: int, length: int):
        self.items = list(queries)
        self.n_docs, self.length = n_docs, length
        self.terms = {}
        for q, item in enumerate(self.items):
            for term, times in Counter(queries[item]).items():
                if dfs.get(term):
                    self.terms.setdefault(term, []).append((q, weight(n_docs, dfs[term]) * times))
        self.places = {t: _place(t) for t in self.terms}
        self._matrices = {}

    def matrix(self, width: int):
        """(coordinates, weights by coordinate and query) of one sketch width."""
        if width not in self._matrices:
            at = sorted({p & (width - 1) for p in self.places.values()})
            rows = {p: i for i, p in enumerate(at)}
            weights = np.zeros((len(at), len(self.items)))
            for term, uses in self.terms.items():
                for q, w in uses:
                    weights[rows[self.places[term] & (width - 1)], q] += max(w, 0)
            self._matrices[width] = np.array(at, np.int64), weights
        return self._matrices[width]

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds, one row per sketch (all of one width), one column per query."""
        at, weights = self.matrix(sketches.shape[1])
        tf = _CODED[sketches[:, at]]
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[:, None])
        return (impact.astype(np.float64) @ weights).astype(np.int64)

    def scores(self, text) -> dict:
        """Exact scores of one text: query -> score."""
        found = terms(text)
        m, out = _m(len(found), self.n_docs, self.length), Counter()
        for term, tf in Counter(t for t in found if t in self.terms).items():
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            for q, w in self.terms[term]:
                out[q] += w * impact
        return out


def _bounded(sketches: DataFrame, block, floors: dict, done: dict, most: int | None) -> DataFrame:
    """(key, q, bound): texts of each query whose bound reaches its floor and was not taken before.

    A text was taken if its (bound, key) lies before the query's mark in `done`. With `most` only the highest of each task are kept."""
    shared = sketches.sparkSession.sparkContext.broadcast((block, floors, done))

    def taken(q, bound, key, marks):
        if q not in marks:
            return np.zeros(len(key), bool)
        b, k = marks[q]
        return (bound > b) | (bound == b) & (key <= k)

    def run(batches):
        block, floors, marks = shared.value
        kept = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q in floors}
        for b in batches:
            n = b.column(1).to_numpy()
            m = _m(n, block.n_docs, block.length)
            keys = b.column(0).to_numpy()
            column = b.column(2)
            sizes = np.array(pc.binary_length(column))
            for width in np.unique(sizes):
                rows = np.flatnonzero(sizes == width)
                for part in range(0, len(rows), max(1, (1 << 22) // int(width))):  # at most 4 MB of sketches at once
                    some = rows[part:part + max(1, (1 << 22) // int(width))]
                    sketch = np.frombuffer(b"".join(column.take(pa.array(some)).to_pylist()), np.uint8).reshape(-1, width)
                    found = block.bounds(sketch, m[some])
                    for q, floor in floors.items():
                        hit = found[:, q] >= floor
                        if not hit.any():
                            continue
                        key, bound = keys[some[hit]], found[hit, q]
                        free = ~taken(q, bound, key, marks)
                        key, bound = key[free], bound[free]
                        if most is None:
                            if len(key):
                                yield arrow_rows(["key", "q", "bound"], [pa.int64(), pa.int32(), pa.int64()], [key, np.full(len(key), q), bound])
                            continue
                        key, bound = np.concatenate([kept[q][0], key]), np.concatenate([kept[q][1], bound])
                        key, first = np.unique(key, return_index=True)
                        bound = bound[first]
                        best = np.lexsort((key, -bound))[:most]
                        kept[q] = key[best], bound[best]
        if most is not None:
            for q, (key, bound) in kept.items():
                yield arrow_rows(["key", "q", "bound"], [pa.int64(), pa.int32(), pa.int64()], [key, np.full(len(key), q), bound])

    return sketches.mapInArrow(run, "key long, q int, bound long")


def _rescored(texts: DataFrame, chosen: DataFrame, block) -> DataFrame:
    """(key, q, score): exact scores above 0 of the chosen (key, q)."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        block = shared.value
        for b in batches:
            keys, qs, scores = [], [], []
            for key, text, asked in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                found = block.scores(text)
                for q in asked:
                    if found.get(q, 0) > 0:
                        keys.append(key)
                        qs.append(q)
                        scores.append(found[q])
            yield arrow_rows(["key", "q", "score"], [pa.int64(), pa.int32(), pa.int64()], [keys, qs, scores])

    asked = chosen.groupBy("key").agg(F.collect_set("q").alias("asked"))  # at most one entry per query of the block
    few = asked.select("key").count() <= MOST_KEYS
    wanted = texts.join(F.broadcast(asked.select("key")) if few else asked.select("key"), "key", "left_semi")
    once = wanted.groupBy("key").agg(F.first("text").alias("text"))
    return once.join(asked, "key").mapInArrow(run, "key long, q int, score long")


def _top(rows: DataFrame, k: int, *order) -> DataFrame:
    best = Window.partitionBy("q").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searched(texts: DataFrame, sketches: DataFrame, ids: DataFrame, block: Block, k: int) -> DataFrame:
    """(q, rank, id, score) of one block of queries."""
    floors = {q: 1 for q in range(len(block.items))}
    marks, scored = {}, []
    for most in (*CANDIDATES, None):
        found = _bounded(sketches, block, floors, marks, most)
        if most is not None:
            found = _top(found.distinct(), most, F.desc("bound"), "key")
        found = written(found.select("key", "q", "bound").distinct(), "bounds")
        scored.append(written(_rescored(texts, found, block), "scores"))
        if most is None:
            break
        last = found.groupBy("q").agg(F.count("*").alias("n"), F.max(F.struct((-F.col("bound")).alias("b"), "key")).alias("m")).collect()  # one row per query
        everything = scored[0]
        for more in scored[1:]:
            everything = everything.unionByName(more)
        # scores count once per document, so a text with several ids fills several ranks
        copies = everything.join(ids.groupBy("key").agg(F.count("*").alias("copies")), "key")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "key")
        full = copies.withColumn("filled", F.sum("copies").over(order)).where(F.col("filled") >= k)
        threshold = {r.q: r.score for r in full.groupBy("q").agg(F.max("score").alias("score")).collect()}
        floors = {}
        for r in last:
            bound = -r.m.b
            marks[r.q] = (bound, r.m.key)
            if r.n >= most and bound >= threshold.get(r.q, 1):
                floors[r.q] = threshold.get(r.q, 1)
        if not floors:
            break
    everything = scored[0]
    for more in scored[1:]:
        everything = everything.unionByName(more)
    return _top(everything.join(ids, "key"), k, F.desc("score"), F.col("id").asc_nulls_last(), "key", "copy").select("q", "rank", "id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text", block: int = 1000) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of every query; rows of `queries` with the same item are queries of their own."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    texts = _texts(docs, text_col)
    sketches = written(index(docs, text_col), "sketches")
    total = sketches.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
    result = f"{item_col} {dict(queries.dtypes)[item_col]}, rank int, {id_col} {kinds[id_col]}, score long"
    if not total.n:
        return spark.createDataFrame([], result)
    # of the ids of one text only the k smallest can be in a result; a task keeps k per text before the shuffle
    mine = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    ids = mine.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last()))).where(F.col("copy") <= k)
    ids = written(ids, "ids")
    parts = []
    numbered = written(queries.select(F.col(item_col).alias("item"), F.col(query_col).cast("string").alias("text")).withColumn(
        "block", F.pmod(F.xxhash64("item", "text"), F.lit(math.ceil(max(1, queries.count()) / block)))), "queries")
    for (number,) in sorted(numbered.select("block").distinct().collect()):  # about `block` queries each: bounded whatever the number of items
        rows = numbered.where(F.col("block") == number).collect()
        asked = {i: terms((r.text or "").encode()) for i, r in enumerate(rows)}
        wanted = {t for found in asked.values() for t in found}
        dfs = {bytes(r.term): r.df for r in statistics(docs, wanted, text_col).collect()}  # at most the terms of the block
        found = _searched(texts, sketches, ids, Block(asked, dfs, total.n, total.length), k)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"q int, {item_col} {dict(queries.dtypes)[item_col]}")
        parts.append(found.join(F.broadcast(names), "q").select(item_col, "rank", F.col("id").alias(id_col), "score"))
    out = parts[0] if parts else spark.createDataFrame([], result)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
