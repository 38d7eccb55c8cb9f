"""Benchmark decontamination by winnowing, on built-in functions only.

Items are cut into windows of `window` consecutive words (an item with fewer words is one window). A document word is
hit if it lies inside any occurrence of any window.

1. Winnowing: every run of `window` words keeps the smallest hash of its `k`-grams. Equal runs keep equal hashes, so a
   document that holds an item's window always shares its fingerprint; only places whose minimum changes (or that lie
   `window - k + 1` words after the last kept one) are emitted.
2. Fingerprints of documents meet the distinct fingerprints of the items in a join.
3. Extension: around every match the candidate windows are cut out and joined with the items' windows by their words,
   so equal hashes alone never count.

Items shorter than the window form a second class with its own `k` and window, sized by the shortest of them.

Documents are matched by (id, hash of the text): rows that repeat get the same answer each, rows that share an id but
not the text their own. Null and word-free texts have no words and no hits; null or word-free items give no window.
A null item id counts as the string 'null'. Other columns are ignored. Empty tables give empty or hit-free results.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # a word is a run of anything else
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of `text` after lower-casing A-Z. (Splitting is several times faster here than extracting matches.)"""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), BETWEEN), ""), F.array().cast("array<string>"))


def winnow(words: Column, window: int, k: int) -> Column:
    """array<struct<at, hash>>: the kept fingerprint of every run of `window` words; see the module text."""
    spread = window - k + 1

    def hashes(w):
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        smallest = lambda h: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.least(*[F.get(h, i + j) for j in range(spread)]) if spread > 1 else F.get(h, i))
        return let(grams, smallest)

    def kept(m):
        marked = F.transform(m, lambda h, i: F.when((i % spread == 0) | (h != F.get(m, i - 1)), F.struct(i.alias("at"), h.alias("hash"))))
        return F.filter(marked, lambda x: x.isNotNull())

    empty = F.array().cast("array<struct<at:int,hash:bigint>>")
    return let(words, lambda w: F.when(F.size(w) >= window, let(hashes(w), kept)).otherwise(empty))


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n, item): every window of every item as its words joined by blanks, with its number of words."""
    worded = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = worded.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, window))).alias("run"))
    return cut.select(F.array_join("run", " ").alias("window"), F.size("run").alias("n"), "item").distinct()


def _classes(windows: DataFrame, window: int):
    """(window, k, lengths) per class: the full windows, and the shorter items if there are any."""
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `window` values
    out = [(window, min(5, window), [window])] if window in lengths else []
    short = [n for n in lengths if n < window]
    if short:
        out.append((short[0], (short[0] + 1) // 2, short))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, items): hit words and the sorted ids of the items that occur, one row per document."""
    return _counted(docs, items, window, id_col, text_col, item_id_col, item_text_col).select(F.col("id").alias(id_col), "n_words", "n_hit", "items")


def _counted(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`contamination` as (id, h, n_words, n_hit, items), with the hash of the text."""
    windows = item_windows(items, window, item_id_col, item_text_col)
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    found = None
    for size, k, lengths in _classes(windows, window):
        marks = windows.where(F.col("n").isin(lengths)).select(F.explode(winnow(words_of(F.col("window")), size, k)["hash"]).alias("hash")).distinct()
        prints = keyed.select("id", "h", F.explode(winnow(words_of(F.col("text")), size, k)).alias("p"))
        near = prints.select("id", "h", F.col("p.at").alias("at"), F.col("p.hash").alias("hash")).join(marks, "hash")
        # a kept place stands for the runs that start up to window - k words later; a longer item may begin earlier
        spots = near.select("id", "h", F.struct(
            (F.col("at") - (max(lengths) - size)).alias("first"), (F.col("at") + (size - k)).alias("last"),
            F.array(*[F.lit(n) for n in lengths]).alias("lengths")).alias("spot"))
        found = spots if found is None else found.union(spots)
    if found is None:
        return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.size(words_of(text)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    spots = found.groupBy("id", "h").agg(F.collect_set("spot").alias("spots"))
    same = (F.col("d.id").eqNullSafe(F.col("s.id"))) & (F.col("d.h") == F.col("s.h"))

    # extension: exact words, only for documents with a match
    suspects = keyed.alias("d").join(spots.alias("s"), same).select("d.id", "d.h", words_of(F.col("d.text")).alias("w"), "s.spots").dropDuplicates(["id", "h"])
    # a range is one number, so that telling ranges apart hashes them instead of comparing all
    step = window + 1
    ranges = F.flatten(F.transform("spots", lambda s: F.flatten(F.transform(
        F.sequence(F.greatest(s["first"], F.lit(0)), s["last"]), lambda i: F.transform(s["lengths"], lambda n: i.cast("long") * step + n)))))
    places = F.transform(F.array_distinct(ranges), lambda r: F.struct(F.floor(r / step).cast("int").alias("at"), (r % step).cast("int").alias("n")))
    inside = F.filter(places, lambda r: r["at"] + r["n"] <= F.size("w"))
    tried = suspects.select("id", "h", F.explode(F.transform(inside, lambda r: F.struct(
        r["at"].alias("at"), r["n"].alias("n"), F.array_join(F.slice(F.col("w"), r["at"] + 1, r["n"]), " ").alias("window")))).alias("r"))
    owners = windows.groupBy("window", "n").agg(F.collect_set("item").alias("items"))
    hits = tried.select("id", "h", "r.*").join(owners, ["window", "n"]).groupBy("id", "h").agg(
        F.collect_list(F.struct("at", "n")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))))
    hits = hits.select("id", "h", covered.cast("long").alias("n_hit"), "items")
    counted = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.size(words_of(text)).cast("long").alias("n_words"))
    return counted.alias("d").join(hits.alias("s"), same, "left").select(
        "d.id", "d.h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated: no hit word, or fewer than one word in 20 hit. Rows go by (id, hash of the text)."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = _counted(docs.select(id_col, text_col), items, **options).where(contaminated()).select(F.col("id").alias("__bad"), F.col("h").alias("__h")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")) & (F.xxhash64(text_col) == F.col("__h")), "left_anti")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
