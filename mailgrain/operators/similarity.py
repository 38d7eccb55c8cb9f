"""Near copies: cosine similarity of TF-IDF vectors at or above a threshold, exactly.

The work never goes through all pairs of a group of copies:

1. Mails with the same vector collapse to the one with the smallest id (a grouped minimum). A group of
   exact or template copies of any size becomes one row.
2. Prefix filter: a vector's terms are ordered from most to least frequent; the frequent head whose norm
   stays below 7/8 of the threshold is not indexed. Two vectors at or above the threshold always share an
   indexed term. An upper bound from the shared indexed terms drops almost all candidates before any full
   product is computed (at 0.8 a cut of 0.7 leaves 1,404 of 853,112 pairs of the 10,000-mail table, a cut
   at the threshold itself 755,435).
3. Star round: every indexed term proposes only (member, first member). Work is linear in the postings, and
   it already joins a campaign of near copies into one component.
4. Remaining candidates must cross components. Per term the largest component is the heavy one, and only
   members outside it are matched with the rest, so a term owned by one campaign costs nothing more. Mails are
   dealt to blocks, and one task matches two blocks: products and bounds stay in it, only candidates leave it. Cells
   are matched a few columns at a time, so the copies of mails on disk at once do not grow with the number of blocks.

Steps 3 and 4 together find exactly the components of the full similarity graph: a pair skipped in
step 4 lies inside one component already.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.base import let
from ..session import durable
from .components import connected_components
from .tfidf import doc_count, postings, vocabulary, word_tokens

HEAD_SHARE = 0.875
ENTRIES_PER_BLOCK = 4_000_000  # indexed terms
PRODUCTS_AT_ONCE = 2_000_000
COLUMNS_AT_ONCE = 2  # of cells
DIGITS = 9  # the order of a sum moves the last bits: similarities are compared after rounding


def term_lists(df: DataFrame, id_column: str, text: str, stop_words=(), min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(id, terms, dfs, ns): terms as 64-bit hashes, most frequent first, with their document frequencies and counts.

    Weights follow from these whole numbers, which take less than half the room of the weights wherever they are stored or shuffled.
    Mails without any kept term have no row: they are similar to nothing.
    """
    terms = postings(df, id_column, word_tokens(F.lower(F.col(text)), stop_words)).withColumn("term", F.xxhash64("term"))
    vocab = vocabulary(terms, doc_count(df.select(id_column)), min_df, max_df).select("term", F.col("df").cast("int").alias("df"))
    # one mail's own terms: bounded by its text; lists of one group keep the same order
    lists = terms.join(vocab, "term").groupBy(F.col(id_column).alias("id")).agg(*[F.collect_list(c).alias(c) for c in ("term", "df", "n")])
    ordered = F.array_sort(F.transform(F.arrays_zip("term", "df", "n"), lambda x: F.struct((-x["df"]).alias("order"), x["term"].alias("term"), x["n"].alias("n"))))
    return lists.select("id", ordered.alias("v")).select("id", F.transform("v", lambda x: x["term"]).alias("terms"), F.transform("v", lambda x: -x["order"]).alias("dfs"), F.transform("v", lambda x: x["n"]).alias("ns"))


def unit_weights(mails: int):
    """Row of `term_lists` -> its weights, scaled to length one."""
    def weights(row):
        raw = F.zip_with(row["dfs"], row["ns"], lambda df, n: (1.0 + F.ln(n)) * (F.ln((1.0 + F.lit(float(mails))) / (1.0 + df)) + 1.0))
        # bound to a variable: a plain column would be inlined and computed again for every element
        return let(raw, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(v, lambda x: x / norm)))
    return weights


def _weighed(lists: DataFrame, mails: int) -> DataFrame:
    return lists.select("id", "terms", unit_weights(mails)({c: F.col(c) for c in ("dfs", "ns")}).alias("ws"))


def unit_vectors(df: DataFrame, id_column: str, text: str, stop_words=(), min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(id, terms, ws): the terms of `term_lists` and weights of unit length."""
    return _weighed(term_lists(df, id_column, text, stop_words, min_df, max_df), df.count())


def equal_vectors(vectors: DataFrame) -> DataFrame:
    """(id, rep): the smallest id with the same vector."""
    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
            terms, ws = lists.flatten().to_numpy(), np.round(batch.column("ws").flatten().to_numpy(), 12)
            keys = [hashlib.sha256(terms[i:j].tobytes() + ws[i:j].tobytes()).digest() for i, j in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], ["id", "_key"])

    keyed = durable(vectors.select("id", "terms", "ws").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, _key binary"))
    first = keyed.groupBy("_key").agg(F.min("id").alias("rep"))
    return durable(keyed.join(first, "_key").select("id", "rep"))


def _first_ones(rows: DataFrame, members: DataFrame) -> DataFrame:
    return rows.join(members.where("id <> rep").select("id"), "id", "left_anti")


def collapse_equal(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id -> rep, vectors of the representatives): equal vectors keep only their smallest id."""
    members = equal_vectors(vectors)
    return members, _first_ones(vectors, members)


def indexed_terms(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, term, w, head): the rare tail of every vector and the norm of the frequent part left out."""
    limit = (HEAD_SHARE * threshold) ** 2
    schema = f"id {dict(vectors.dtypes)['id']}, term long, w double, head double"

    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            terms, w = lists.flatten().to_numpy(), batch.column("ws").flatten().to_numpy()
            run = np.cumsum(w * w)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
            run -= np.repeat(run[first] - w[first] ** 2, np.diff(np.r_[first, len(row)]))
            left = np.zeros(len(lists))
            np.maximum.at(left, row[run < limit], run[run < limit])
            keep = run >= limit
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[keep])), pa.array(terms[keep]), pa.array(w[keep]), pa.array(np.sqrt(left)[row[keep]])], ["id", "term", "w", "head"])

    return vectors.select("id", "terms", "ws").mapInArrow(run, schema)


def _by_mail(entries: DataFrame) -> DataFrame:
    """(id, comp, head, terms, ws, heavy) from rows (id, comp, head, term, w, heavy): one row per mail, its indexed terms as arrays."""
    listed = entries.groupBy("id").agg(F.first("comp").alias("comp"), F.first("head").alias("head"), F.collect_list(F.struct("term", "w", "heavy")).alias("l"))
    return listed.select("id", "comp", "head", F.transform("l", lambda x: x["term"]).alias("terms"), F.transform("l", lambda x: x["w"].cast("float")).alias("ws"), F.transform("l", lambda x: x["heavy"]).alias("heavy"))


class _Block:
    """The mails of one side of a cell and their indexed terms, ordered by mail."""

    def __init__(self, table):
        self.ids, self.comp, self.head = table.column("id"), table.column("comp"), table.column("head").to_numpy()
        lists = table.column("terms").combine_chunks()
        self.mail = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.terms, self.w = lists.flatten().to_numpy(), table.column("ws").combine_chunks().flatten().to_numpy().astype(np.float64)
        self.heavy = table.column("heavy").combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _candidates(left: _Block, right: _Block, same: bool, comps, threshold: float):
    """Places (a, b) of the pairs whose upper bound reaches the threshold.

    Every shared term that is not counted lies in the head of one vector and outside the counted terms of the other, so the
    rest of the product is at most the head norm of the one times the remaining norm of the other.
    """
    order = np.lexsort((right.heavy, right.terms))  # light members of a term first
    terms, mail, w = right.terms[order], right.mail[order], right.w[order]
    low = np.searchsorted(terms, left.terms, side="left")
    count = np.searchsorted(terms, left.terms, side="right") - low
    light = np.concatenate([[0], np.cumsum(~right.heavy[order])])
    count = np.where(left.heavy, light[low + count] - light[low], count)  # two heavy members lie in one component
    ends = np.cumsum(count)
    of_mail = np.flatnonzero(np.r_[left.mail[1:] != left.mail[:-1], True][:len(left.mail)]) + 1  # ends of the mails' entries
    found, start = [], 0
    while start < len(left.mail):
        base = ends[start - 1] if start else 0
        fits = of_mail[(of_mail > start) & (ends[of_mail - 1] <= base + PRODUCTS_AT_ONCE)] if len(of_mail) else of_mail
        stop = int(fits[-1]) if len(fits) else int(of_mail[of_mail > start][0])
        here = np.arange(start, stop)
        start = stop
        n = count[here]
        mine = np.repeat(here, n)
        other = np.repeat(low[here] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b = left.mail[mine], mail[other]
        keep = comps[0][a] != comps[1][b]
        if same:
            keep &= a < b
        a, b, x, y = a[keep], b[keep], left.w[mine[keep]], w[other[keep]]
        key, place = np.unique(a * len(right.head) + b, return_inverse=True)
        if len(key):
            sums = lambda v: np.bincount(place, weights=v, minlength=len(key))
            a, b = key // len(right.head), key % len(right.head)
            dot, ra, rb = sums(x * y), *(np.sqrt(np.maximum(0.0, 1 - sums(v * v))) for v in (x, y))
            rest = np.minimum(ra * rb, np.maximum(left.head[a] * rb, right.head[b] * ra))
            hit = dot + rest >= threshold - 1e-5  # weights came in single precision
            found.append((a[hit], b[hit]))
    return [np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in (zip(*found) if found else ((), ()))]


def _matched(left: DataFrame, right: DataFrame | None, threshold: float, blocks: int, columns: range | None = None) -> DataFrame:
    """(a, b) of all candidate pairs of different components: among the mails of `left`, or between `left` and `right`.

    Both are as `_by_mail` makes them. Mails are dealt to blocks by hash; every pair of blocks is a cell, matched by one task.
    Among the mails of `left`, `columns` keeps to the cells of some columns: about two copies of the mails a column.
    """
    kind = dict(left.dtypes)["id"]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    one = left.withColumn("i", block)
    if right is None:
        cells = one.withColumn("j", F.explode(numbers))
        cells = cells.select(F.least("i", "j").alias("row"), F.greatest("i", "j").alias("col"), (F.col("i") <= F.col("j")).alias("mine"), "*")
        if columns is not None:
            cells = cells.where((F.col("col") >= columns.start) & (F.col("col") < columns.stop))
    else:
        cells = one.select(F.col("i").alias("row"), F.lit(0).alias("col"), F.lit(True).alias("mine"), "*").drop("i").unionByName(
            right.withColumn("row", F.explode(numbers)).withColumns({"col": F.lit(0), "mine": F.lit(False)}))
    within = right is None

    def match(table):
        same = within and table.column("row")[0] == table.column("col")[0]
        mine = _Block(table.filter(table.column("mine")))
        other = mine if same else _Block(table.filter(pc.invert(table.column("mine"))))
        codes = pc.index_in(pa.chunked_array([*mine.comp.chunks, *other.comp.chunks]), pc.unique(pa.chunked_array([*mine.comp.chunks, *other.comp.chunks]))).to_numpy()
        comps = codes[:len(mine.comp)], codes[-len(other.comp):] if len(other.comp) else codes[:0]
        a, b = _candidates(mine, other, same, comps, threshold)
        return pa.table({"a": mine.ids.take(pa.array(a)), "b": other.ids.take(pa.array(b))})

    found = cells.select("row", "col", "mine", "id", "comp", "head", "terms", "ws", "heavy").groupBy("row", "col").applyInArrow(match, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) if within else found


def verify(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, weights=lambda row: row["ws"]) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold: exact products of the full vectors.

    `weights` makes the weights of a row of `left` or `right` where both have met, so that rows travel as they are stored."""
    def whole(rows, name):
        return rows.select(F.col("id").alias(name), F.struct(*[c for c in rows.columns if c != "id"]).alias(f"_{name}"))

    def as_map(name):
        return F.map_from_arrays(F.col(f"_{name}.terms"), weights(F.col(f"_{name}")))
    dot = F.aggregate(F.map_values(F.map_zip_with(as_map("a"), as_map("b"), lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), lambda a, x: a + x)
    return pairs.join(whole(left, "a"), "a").join(whole(right, "b"), "b").select("a", "b", F.round(dot, DIGITS).alias("similarity")).where(F.col("similarity") >= threshold)


def star_edges(index: DataFrame, lists: DataFrame, threshold: float, weights) -> DataFrame:
    """Verified (member, first member of shared indexed terms) edges.

    This round only has to join the bulk of every campaign, so it proposes a pair when the terms the first
    member leads already carry a good part of the product; whatever it leaves out is found across components.
    """
    pivots = index.groupBy("term").agg(F.min_by(F.struct("id", "w"), "id").alias("p"))
    pairs = index.join(pivots, "term").where(F.col("id") != F.col("p.id")).groupBy(
        F.col("p.id").alias("a"), F.col("id").alias("b")).agg(F.sum(F.col("w") * F.col("p.w")).alias("dot"))
    return verify(durable(pairs.where(F.col("dot") >= threshold / 3).select("a", "b")), lists, lists, threshold, weights)


def crossing_edges(index: DataFrame, lists: DataFrame, components: DataFrame, threshold: float, weights) -> DataFrame:
    """Verified edges between different components, heavy component of every term on one side only."""
    placed = index.join(components, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    sizes = placed.groupBy("term", "comp").agg(F.count("*").alias("m"))
    heavy = sizes.groupBy("term").agg(F.max_by("comp", F.struct("m", "comp")).alias("heavy"), F.count("*").alias("comps"))
    mixed = placed.join(heavy.where("comps > 1"), "term").withColumn("heavy", F.col("comp") == F.col("heavy"))
    return verify(_crossing_candidates(durable(_by_mail(mixed)), threshold), lists, lists, threshold, weights)


def _crossing_candidates(mails: DataFrame, threshold: float) -> DataFrame:
    """All candidates, a few columns of cells at a time: blocks grow in number, but the copies on disk at once do not."""
    blocks = _block_count(mails.agg(F.sum(F.size("terms"))).first()[0] or 0)
    rounds = [range(i, min(i + COLUMNS_AT_ONCE, blocks)) for i in range(0, blocks, COLUMNS_AT_ONCE)]
    return reduce(DataFrame.unionByName, [durable(_matched(mails, None, threshold, blocks, columns)) for columns in rounds])


def _block_count(entries: int) -> int:
    """Blocks of bounded size, and enough of them to use all slots."""
    return int(entries // ENTRIES_PER_BLOCK) + (4 if entries > 100_000 else 1)


def near_copy_edges(df: DataFrame, id_column: str, text: str = "text", threshold: float = lx.NEAR_COPY_SIMILARITY,
                    stop_words=tuple(lx.STOP_WORDS["en"]), min_df: int = 2, max_df: float = 0.5):
    """(members, edges): edges connect exactly the components of the similarity graph of the distinct vectors."""
    lists, mails = durable(term_lists(df, id_column, text, stop_words, min_df, max_df)), df.count()
    members = equal_vectors(_weighed(lists, mails))
    reps, weights = durable(_first_ones(lists, members)), unit_weights(mails)
    index = indexed_terms(_weighed(reps, mails), threshold)  # made from the lists wherever it is read: cheaper than a copy on disk
    stars = durable(star_edges(index, reps, threshold, weights))
    first = connected_components(stars).withColumnRenamed("node", "id")
    crossing = durable(crossing_edges(index, reps, first, threshold, weights))
    return members, stars.unionByName(crossing)


def near_copy_groups(df: DataFrame, id_column: str, text: str = "text", **options) -> DataFrame:
    """(id, grp) for every mail: the smallest id among the mails connected by near copies."""
    members, edges = near_copy_edges(df, id_column, text, **options)
    components = connected_components(edges).withColumnRenamed("node", "rep")
    placed = members.join(components, "rep", "left").select("id", F.coalesce("component", "rep").alias("grp"))
    return df.select(F.col(id_column).alias("id")).join(placed, "id", "left").select(
        F.col("id").alias(id_column), F.coalesce("grp", "id").alias("grp"))


def drop_cross_copies(df: DataFrame, other: DataFrame, id_column: str, text: str = "text", **options) -> DataFrame:
    """Rows of `df` whose near-copy group holds no row of `other` (ids unique over both)."""
    both = df.select(id_column, text, F.lit(False).alias("_other")).unionByName(
        other.select(id_column, text, F.lit(True).alias("_other")))
    groups = durable(near_copy_groups(both, id_column, text, **options).join(both.select(id_column, "_other"), id_column))
    tainted = groups.where("_other").select("grp").distinct()
    kept = groups.where("NOT _other").join(tainted, "grp", "left_anti").select(id_column)
    return df.join(kept, id_column, "left_semi")


def _across(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs between two sides; the right one goes part by part, so that a cell holds a bounded part of both."""
    blocks, parts = _block_count(left.count()), int(right.count() // ENTRIES_PER_BLOCK) + 1
    left, right = _by_mail(left), _by_mail(right)
    if parts == 1:
        return durable(_matched(left, right, threshold, blocks))
    left, part = durable(left), F.pmod(F.xxhash64("id"), F.lit(parts))
    return reduce(DataFrame.unionByName, [durable(_matched(left, right.where(part == i), threshold, blocks)) for i in range(parts)])


def near_copy_ids(df: DataFrame, other: DataFrame, id_column: str, text: str = "text",
                  threshold: float = lx.NEAR_COPY_SIMILARITY, stop_words=()) -> DataFrame:
    """Ids of `df` that are at least `threshold` similar to some row of `other` (IDF over both sets).

    One witness is enough: rows that match the first posting of a shared term are settled; only the
    unsettled ones are compared with the remaining postings.
    """
    both = df.select(id_column, text, F.lit(0).alias("_side")).unionByName(other.select(id_column, text, F.lit(1).alias("_side")))
    lists, mails = term_lists(both, id_column, text, stop_words), both.count()
    sided, weights = durable(lists.join(both.select(F.col(id_column).alias("id"), "_side"), "id")), unit_weights(mails)
    mine, theirs = (sided.where(F.col("_side") == side).drop("_side") for side in (0, 1))
    members, others = equal_vectors(_weighed(mine, mails)), equal_vectors(_weighed(theirs, mails))
    mine, theirs = durable(_first_ones(mine, members)), durable(_first_ones(theirs, others))
    here, there = indexed_terms(_weighed(mine, mails), threshold), indexed_terms(_weighed(theirs, mails), threshold)
    pivots = there.groupBy("term").agg(F.min_by(F.struct("id", "w"), "id").alias("p"))
    proposals = here.join(pivots, "term").groupBy(F.col("id").alias("a"), F.col("p.id").alias("b")).agg(F.sum(F.col("w") * F.col("p.w")).alias("dot"))
    near = durable(proposals.where(F.col("dot") >= threshold / 2).select("a", "b"))
    settled = durable(verify(near, mine, theirs, threshold, weights).select(F.col("a").alias("id")).distinct())
    shared = there.select("term").distinct()
    open_rows = here.join(settled, "id", "left_anti").join(shared, "term", "left_semi")
    open_rows, there = (x.withColumns({"comp": F.lit(side), "heavy": F.lit(False)}) for side, x in enumerate((open_rows, there)))
    late = _across(open_rows, there, threshold)
    late = verify(late, mine, theirs, threshold, weights).select(F.col("a").alias("id")).distinct()
    hits = settled.unionByName(late).withColumnRenamed("id", "rep")
    return members.join(hits, "rep", "left_semi").select(F.col("id").alias(id_column))


def drop_near_copies(df: DataFrame, other: DataFrame, id_column: str, text: str = "text", **options) -> DataFrame:
    return df.join(near_copy_ids(df, other, id_column, text, **options), id_column, "left_anti")
