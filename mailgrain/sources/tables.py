"""Columnar scans."""

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Scan a Parquet table.

    `spread` is for CPU-heavy text work on input that arrives in fewer splits than there are cores
    (one small file with one row group). A cluster-sized scan has more splits than cores and is
    left alone, so no text is ever shuffled there.
    """
    df = spark.read.parquet(path)
    if spread:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
    return df
