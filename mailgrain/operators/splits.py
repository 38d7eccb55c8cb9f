"""Deterministic hashed samples, splits and folds. Order comes from md5, never from row position."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from .curves import running_totals
from .joins import one_row


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, group: str, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """At most `n` rows of every group. Spark keeps only the n best rows per task before the shuffle."""
    order = Window.partitionBy(group).orderBy(hash_order(F.col(id_column), seed), id_column)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def sample_source(df: DataFrame, source: str, name: str, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Sample one source down to `n` rows, keep every other source whole."""
    chosen = sample_per_group(df.where(F.col(source) == name), source, id_column, n, seed)
    return df.where(F.col(source) != name).unionByName(chosen)


def _group_positions(groups: DataFrame, keys, group: str, size: str, seed: int) -> DataFrame:
    """Rows filled before each group when groups are laid out in hashed order inside `keys`."""
    ordered = groups.withColumn("_order", hash_order(F.col(group), seed))
    run = running_totals(ordered, keys, "_order", [size], descending=False)
    return run.withColumn("filled", F.col(f"{size}_run") - F.col(size)).drop(f"{size}_run", "_order")


def group_split(df: DataFrame, group: str, seed: int = 42, fractions=lx.SPLIT_FRACTIONS) -> DataFrame:
    """Column `part` (0, 1, 2): whole groups fill the slices in hashed order, chosen by rows filled before."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    placed = _group_positions(sizes, [], group, "size", seed)
    n = one_row(sizes.agg(F.sum("size").alias("n")))["n"]
    edges, so_far = [], 0.0
    for f in fractions[:-1]:
        so_far += f
        edges.append(so_far)
    part = F.lit(0)
    for e in edges:
        part = part + F.when(F.col("filled") >= F.lit(e) * n, 1).otherwise(0)
    return df.join(placed.select(group, part.alias("part")), group)


def grouped_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Column `fold`: no group is split; inside every class mix the folds get equal row counts."""
    groups = df.groupBy(group).agg(F.count("*").alias("size"), F.sum(F.col(label)).alias("_pos"))
    mix = F.when(F.col("_pos") == 0, "negative").when(F.col("_pos") == F.col("size"), "positive").otherwise("mixed")
    groups = groups.withColumn("stratum", mix).drop("_pos")
    placed = _group_positions(groups, ["stratum"], group, "size", seed)
    totals = groups.groupBy("stratum").agg(F.sum("size").alias("_n"))
    fold = F.least(F.floor(F.col("filled") * k / F.col("_n")), F.lit(k - 1)).cast("int")
    return df.join(placed.join(totals, "stratum").select(group, fold.alias("fold")), group)


def stratified_split(df: DataFrame, id_column: str, label: str, seed: int = 42, fractions=lx.SPLIT_FRACTIONS) -> DataFrame:
    """Column `part`: row-level split with the class shares kept."""
    rows = df.select(label, id_column, F.lit(1).alias("one"))
    placed = _group_positions(rows, [label], id_column, "one", seed)
    totals = df.groupBy(label).agg(F.count("*").alias("_n"))
    share = F.col("filled") / F.col("_n")
    part = (F.when(share < fractions[0], 0).when(share < fractions[0] + fractions[1], 1).otherwise(2)).cast("int")
    return df.join(placed.join(totals, label).select(id_column, part.alias("part")), id_column)
