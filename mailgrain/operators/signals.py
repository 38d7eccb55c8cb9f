"""Rates of boolean, possibly undefined signals and the rule that calls a signal promising."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.stats import share, wilson


def signal_rates(df: DataFrame, signals, group: str) -> DataFrame:
    """(group, signal, k, n, rate, lo, hi): undefined values leave the denominator."""
    wide = df.groupBy(group).agg(*[F.count_if(F.col(s)).alias(f"k_{s}") for s in signals], *[F.count(s).alias(f"n_{s}") for s in signals])
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"k_{s}").alias("k"), F.col(f"n_{s}").alias("n")) for s in signals])
    long = wide.select(group, F.explode(rows).alias("r")).select(group, "r.*")
    lo, hi = wilson(F.col("k"), F.col("n"))
    return long.withColumns({"rate": share(F.col("k"), F.col("n")), "lo": lo, "hi": hi})


def value_histogram(df: DataFrame, columns, group: str) -> DataFrame:
    """Counts of every recorded value per column, undefined ones as "missing"."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in columns])
    return df.select(group, F.explode(rows).alias("r")).groupBy(group, "r.column", "r.value").agg(F.count("*").alias("n"))


def promising_signals(rates: DataFrame, group: str, phishing: str, other: str) -> DataFrame:
    """Promising: at least 5% of phishing and three times the other rate, which is floored at one mail."""
    two = rates.groupBy("signal").agg(
        F.max(F.when(F.col(group) == phishing, F.col("rate"))).alias("phishing_rate"),
        F.max(F.when(F.col(group) == other, F.col("rate"))).alias("other_rate"),
        F.max(F.when(F.col(group) == other, F.col("n"))).alias("_n"))
    ratio = F.col("phishing_rate") / F.greatest(F.col("other_rate"), 1.0 / F.greatest(F.col("_n"), F.lit(1)))
    return two.withColumn("ratio", F.round(ratio, 2)).withColumn(
        "promising", (F.col("phishing_rate") >= lx.MIN_SIGNAL_RATE) & (ratio >= lx.MIN_SIGNAL_RATIO)).drop("_n")
