"""Helpers shared by the operators: tables written to the shared folder, ordered prefix sums, Arrow streams."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write `df` as Parquet into the session's shared folder and read it back; this cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_prefix(df: DataFrame, order, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one in `order` (which must make rows distinct,
    or leave only equal rows tied). Rows are ranged over partitions and written once; only one total per
    partition is summed in a single place."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(out))


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, by, most: int = 1000, ways: int = 64) -> DataFrame:
    """Inner join of `rows` with `table` (one row per key) where a few keys may hold most of `rows`.

    `counts` has (key, n): rows per key. Keys with more than one in `most` of all rows are hot; there are fewer than
    `most` of them, so their list may be broadcast. Their rows go to `ways` tasks by a hash of `by`, and their row of
    `table` goes to each of those; all other keys are joined as they are. Null keys match nothing."""
    total = counts.agg(F.sum("n").alias("__n"))
    hot = F.broadcast(counts.where(F.col("n") * most > total.scalar()).select(key, F.lit(ways).alias("__ways")))
    way = F.when(F.col("__ways").isNotNull(), F.pmod(F.xxhash64(by), F.col("__ways")).cast("int")).otherwise(0)
    left = rows.join(hot, key, "left").withColumn("__way", way).drop("__ways")
    right = table.join(hot, key, "left").withColumn("__way", F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1))).drop("__ways")
    return left.join(right, [key, "__way"]).drop("__way")


def arrow_rows(names, types, columns):
    """A record batch from Python lists or NumPy arrays."""
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
