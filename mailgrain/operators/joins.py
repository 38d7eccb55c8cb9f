"""Joins, set operations and exact duplicate removal."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key
from ..functions.urls import is_ip_host


def first_per_key(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """Keep the first row of every key in `order`.

    A grouped `min_by` instead of a ranked window: partial aggregation keeps one row per key and
    map task, so a key that holds a third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(key, "_row.*").select(*df.columns)


def first_by_content(df: DataFrame, text: str = "text", order: str = "id", exclude: DataFrame | None = None) -> DataFrame:
    """(content_key, order) of the first mail of every content key, without the keys of `exclude`.

    Only keys and ids are shuffled, with partial aggregation per task.
    """
    keyed = df.select(order, content_key(F.col(text)).alias("content_key"))
    if exclude is not None:
        keyed = keyed.join(exclude.select("content_key").distinct(), "content_key", "left_anti")
    return keyed.groupBy("content_key").agg(F.min(order).alias(order))


def drop_exact_copies(df: DataFrame, text: str = "text", order: str = "id", exclude: DataFrame | None = None) -> DataFrame:
    """The rows chosen by `first_by_content`: an equi-join on the unique `order` column, so texts move at most once."""
    return df.join(first_by_content(df, text, order, exclude), order).select(*df.columns)


def unresolved_hosts(links: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Links to named hosts that the resolution snapshot does not know."""
    named = links.where((F.col("host") != "") & ~is_ip_host(F.col("host")))
    return named.join(snapshot.select("host").distinct(), "host", "left_anti")


def lookup_flags(df: DataFrame, table: DataFrame, key: str, flags, order: str) -> DataFrame:
    """Left join of boolean flags by key: the first duplicate wins, unmatched rows get false."""
    first = first_per_key(table.select(key, order, *flags), key, order).select(
        key, F.lit(True).alias("matched"), *flags)
    joined = df.join(first, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in [*flags, "matched"]})


def cross_with_values(df: DataFrame, name: str, values) -> DataFrame:
    """One row per value of a fixed, short parameter list (thresholds, costs, rates)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def cross_with_structs(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Like `cross_with_values` for a fixed list of named parameter tuples."""
    items = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])
    return df.withColumn("_p", F.explode(items)).select(*df.columns, "_p.*")


def paired_predictions(a: DataFrame, b: DataFrame, key: str, label: str, condition_a: Column, condition_b: Column) -> DataFrame:
    """(key, label, pred_a, pred_b) of two prediction sets on the same mails."""
    left = a.select(key, label, condition_a.alias("pred_a"))
    return left.join(b.select(key, condition_b.alias("pred_b")), key)


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct column (a scalar subquery, not a join)."""
    return df.select(F.struct(*df.columns)).scalar()
