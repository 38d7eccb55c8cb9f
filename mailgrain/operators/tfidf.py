"""Relational TF-IDF: term counting inside the row, document frequencies by aggregation.

Counting terms needs no shuffle (all tokens of a mail sit in its row); Arrow batches count codes instead of sorting strings. One aggregation over distinct
(mail, term) pairs yields document frequencies with map-side combine. The vocabulary is whole unless
`max_features` caps it. A capped one has a proven size and is broadcast; a whole one is joined by
shuffle, where AQE splits the frequent terms.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import SPACE, WORD, let

TERMS_AT_ONCE = 200_000


def word_tokens(text: Column, stop_words=()) -> Column:
    """Runs of at least two word characters of already normalised text."""
    drop = list(stop_words)
    tokens = F.split(text, rf"[^{WORD}]+", -1)
    keep = lambda w: (F.length(w) >= 2) & ~w.isin(drop) if drop else F.length(w) >= 2
    return F.filter(tokens, keep)


def with_bigrams(tokens: Column) -> Column:
    def extend(s):
        pairs = F.when(F.size(s) >= 2, F.transform(F.sequence(F.lit(0), F.size(s) - 2),
                                                   lambda i: F.concat(F.get(s, i), F.lit(" "), F.get(s, i + 1))))
        return F.concat(s, F.coalesce(pairs, F.array().cast("array<string>")))
    return let(tokens, extend)


def blank_words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, rf"[{SPACE}]+", -1), lambda w: w != "")


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words; a word shorter than `low` counts once as it is."""
    words = blank_words(text)

    def grams(word):
        def build(p):
            size = F.length(p)
            sized = [F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), _piece(p, n)))
                     .otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
            return F.when(size < low, F.array(p)).otherwise(F.concat(*sized))
        return let(F.concat(F.lit(" "), word, F.lit(" ")), build)

    return F.flatten(F.transform(words, grams))


def _piece(p: Column, n: int):
    return lambda i: F.substring(p, i, F.lit(n))


def count_terms(tokens: Column) -> Column:
    """array<struct<term, n>> of distinct tokens, by sorting inside the row."""
    def runs(s):
        last = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda p, k: F.struct(
            F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), last) - p).alias("n"))))
    nothing = F.array().cast("array<struct<term:string,n:int>>")
    return F.when(F.size(tokens) > 0, let(F.array_sort(tokens), runs)).otherwise(nothing)


def postings(df: DataFrame, id_column: str, tokens: Column) -> DataFrame:
    """(id, term, n): one row per mail and distinct term."""
    kind = dict(df.select(id_column).dtypes)[id_column]
    return df.select(id_column, tokens.alias("_tokens")).mapInArrow(_counted, f"`{id_column}` {kind}, term string, n int")


def _counted(batches):
    """Rows of distinct (mail, term) with their counts, a bounded number of terms at a time; a mail is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + TERMS_AT_ONCE, side="right")))
            part, start = batch.slice(start, stop - start), stop
            lists = part.column(1)
            coded = pc.dictionary_encode(lists.flatten())
            width = max(len(coded.dictionary), 1)
            mail = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            key, n = np.unique(mail * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(key // width)), coded.dictionary.take(pa.array(key % width)), pa.array(n, pa.int32())],
                                             [part.schema.names[0], "term", "n"])


def vocabulary(terms: DataFrame, n_docs: Column, min_df: int = 1, max_df: float = 1.0,
               max_features: int | None = None) -> DataFrame:
    """(term, df, cf, idf) inside the document-frequency limits; the largest total counts win, ties by term."""
    counted = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
    kept = counted.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    if max_features is not None:
        kept = kept.orderBy(F.col("cf").desc(), "term").limit(max_features)
    return kept.withColumn("idf", F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def weights(terms: DataFrame, vocab: DataFrame, id_column: str, bounded: bool = False) -> DataFrame:
    """(id, term, w): sublinear tf times idf, each mail scaled to length one."""
    side = F.broadcast(vocab) if bounded else vocab  # bounded: at most max_features rows
    raw = terms.join(side, "term").select(id_column, "term", ((1.0 + F.ln("n")) * F.col("idf")).alias("_w"))
    per_mail = Window.partitionBy(id_column)  # one mail's distinct terms
    return raw.select(id_column, "term", (F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(per_mail))).alias("w"))


def doc_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count("*").cast("double").alias("n")).scalar()


def tfidf(df: DataFrame, id_column: str, tokens: Column, min_df: int, max_df: float = 1.0, max_features: int | None = None):
    """(weights, vocabulary) of one block."""
    terms = postings(df, id_column, tokens)
    vocab = vocabulary(terms, doc_count(df.select(id_column)), min_df, max_df, max_features)
    return weights(terms, vocab, id_column, bounded=max_features is not None), vocab
