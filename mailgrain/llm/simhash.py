"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is cut into `blocks` parts. Two fingerprints that differ in at most `distance` bits leave
`blocks - distance` parts untouched, so they meet in one of the C(blocks, distance) tables keyed by that many parts:
5 parts and distance 3 give ten tables of 25-bit keys, and the candidates per fingerprint stay near zero until the
corpus has tens of millions of different fingerprints. Equal fingerprints collapse to one row first, so thousands of
exact copies cost one row. In a table, a bucket of up to `dense` fingerprints is joined with itself; a larger one
(a family of near copies) is cut into chunks, every pair of chunks is compared in one task of bounded memory, and only
a spanning forest of the links found leaves that task, so links written grow with the bucket, not with its square.

Null text counts as text without words: fingerprint zero, linked like any other. Rows with the same doc_id are kept
and each gets its own fingerprint; a component is named by the smallest non-null doc_id reachable (null if none is).
Columns other than `id_col` and `text_col` are ignored. An empty table gives an empty result.
"""

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_rows, spread_join, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42


def fingerprint(text, width: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of one text."""
    from xxhash import xxh64_intdigest
    if not text:
        return 0
    words = WORDS.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(" ".join(words), seed)
    shingles = map(" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed 64-bit number, one row per row of `docs`."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield arrow_rows([id_col, "fp"], [b.schema.field(0).type, pa.int64()], [b.column(0), fps.view(np.int64)])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, fp long")


def _tables(bits: int, blocks: int, distance: int):
    """Bit masks, one per table: which bits must agree."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in keep) for keep in itertools.combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(left, right, distance: int, same: bool):
    """Links of a spanning forest over the pairs within `distance`; rows are compared in slices of bounded memory."""
    nodes = left if same else np.concatenate([left, right])
    parent = np.arange(len(nodes))
    a_out, b_out = [], []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shift = 0 if same else len(left)
    for i in range(len(left)):
        first = i + 1 if same else 0
        near = np.flatnonzero(np.bitwise_count(right[first:] ^ left[i]) <= distance) + first + shift
        if not len(near):
            continue
        here = root(i)
        for j in near[parent[near] != here]:
            other = root(j)
            if other != here:
                parent[other] = here
                a_out.append(nodes[i])
                b_out.append(nodes[j])
            parent[j] = here
    return np.array(a_out, np.uint64).view(np.int64), np.array(b_out, np.uint64).view(np.int64)


def links(distinct: DataFrame, distance: int = 3, blocks: int = 5, dense: int = 48, chunk: int = 1024) -> DataFrame:
    """(a, b): links that connect exactly what all pairs of `distinct.fp` within `distance` bits connect."""
    masks = F.array(*[F.lit(_signed(m)) for m in _tables(64, blocks, distance)])
    keyed = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("table", "key"))
    sizes = keyed.groupBy("table", "key").count().where("count > 1")
    met = written(keyed.join(sizes, ["table", "key"]), "blocks")

    small = met.where(F.col("count") <= dense)
    a, b = small.select("table", "key", F.col("fp").alias("a")), small.select("table", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["table", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")

    chunks = F.ceil(F.col("count") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = met.where(F.col("count") > dense).select("table", "key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    dealt = dealt.select("table", "key", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, mine, i, j = (group[c].to_numpy() for c in ("fp", "mine", "i", "j"))
        fp = fp.view(np.uint64)  # NumPy counts the bits of a signed number's absolute value
        left = fp[mine == i[0]]
        same = i[0] == j[0]
        x, y = _forest(left, left if same else fp[mine == j[0]], distance, same)
        return pd.DataFrame({"a": x, "b": y})

    forest = dealt.groupBy("table", "key", "i", "j").applyInPandas(compare, "a long, b long")
    return pairs.union(forest).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id, links): one row per document. `links` counts the stored links of its fingerprint."""
    each = written(fingerprints(docs, id_col, text_col), "fingerprints")
    whole, sizes = _whole(each, id_col, distance)
    return spread_join(each, whole, "fp", sizes, id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def row_key(id_col: str, text_col: str):
    """struct<none, id, h> of a row: orders rows by id, those without one last, then by the hash of their text."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """The rows of `docs`, with all columns, that come first in their component by `row_key`; of rows that repeat one.

    Components are told apart by row keys, not by ids: texts that share an id or have none may lie in many."""
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    whole, _ = _whole(fingerprints(keyed, "__row", text_col), "__row", distance)
    first = whole.select(F.col("component_id").alias("__row")).distinct()
    return keyed.dropDuplicates(["__row"]).join(first, "__row", "left_semi").drop("__row")


def _whole(each: DataFrame, id_col: str, distance: int):
    """(fp, component_id, links) and (fp, n), one row per fingerprint of `each`."""
    distinct = written(each.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "distinct")
    edges = written(links(distinct, distance), "links")
    parts = connected_components(edges)
    named = parts.join(distinct.select(F.col("fp").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("name"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = parts.join(named, "component").join(degree, "node").select(F.col("node").alias("fp"), "name", "links")
    whole = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("name", "first").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return whole, distinct.select("fp", "n")
