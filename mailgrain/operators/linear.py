"""Linear text models in relational form: coefficients, scores and explanations as tables.

A coefficient table has one row per feature (`term`, `coef`, optionally `block`). Everything here is a join of
postings with that table; a vocabulary capped by `max_features` keeps it small enough to broadcast.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complement_nb(weights: DataFrame, labels: DataFrame, id_column: str, label: str = "label", alpha: float = 0.3) -> DataFrame:
    """(term, coef): log-odds weight of class 1 of a complement naive Bayes fit on term weights."""
    sums = weights.join(labels.select(id_column, label), id_column).groupBy("term").agg(
        F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0.0)).alias("_s1"),
        F.sum(F.when(F.col(label) == 0, F.col("w")).otherwise(0.0)).alias("_s0"))
    totals = sums.agg(F.struct((F.sum("_s1") + alpha * F.count("*")).alias("t1"), (F.sum("_s0") + alpha * F.count("*")).alias("t0"))).scalar()
    # the complement of class 1 is class 0 and the other way round
    coef = F.ln((F.col("_s1") + alpha) / totals["t1"]) - F.ln((F.col("_s0") + alpha) / totals["t0"])
    return sums.select("term", coef.alias("coef"))


def margins(weights: DataFrame, coefficients: DataFrame, id_column: str) -> DataFrame:
    """(id, margin): sum of weight times coefficient."""
    return weights.join(coefficients, "term").groupBy(id_column).agg(F.sum(F.col("w") * F.col("coef")).alias("margin"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def top_coefficients(coefficients: DataFrame, k: int = 20) -> DataFrame:
    """The k strongest features in both directions (a top-k report)."""
    up = coefficients.orderBy(F.col("coef").desc(), "term").limit(k).withColumn("side", F.lit("phishing"))
    down = coefficients.orderBy(F.col("coef").asc(), "term").limit(k).withColumn("side", F.lit("legitimate"))
    return up.unionByName(down)


def source_audit(weights: DataFrame, corpora: DataFrame, features: DataFrame, id_column: str, corpus: str = "corpus") -> DataFrame:
    """Per feature: number of mails, most frequent corpus (first by name on ties) and its share."""
    used = weights.join(F.broadcast(features.select("term")), "term")  # at most two top-k lists
    counted = used.join(corpora.select(id_column, corpus), id_column).groupBy("term", corpus).agg(F.count("*").alias("n"))
    first = F.min_by(F.struct(corpus, "n"), F.struct(-F.col("n"), F.col(corpus)))
    return counted.groupBy("term").agg(F.sum("n").alias("emails"), first.alias("t")).select(
        "term", "emails", F.col(f"t.{corpus}").alias("top_corpus"), (F.col("t.n") / F.col("emails")).alias("top_share"))


def block_contributions(weights: DataFrame, coefficients: DataFrame, groups: DataFrame, id_column: str, group: str, block: Column) -> DataFrame:
    """Mean logit contribution of every feature block per group; mails without a block count as 0."""
    sums = weights.join(coefficients, "term").join(groups.select(id_column, group), id_column).groupBy(
        group, block.alias("block")).agg(F.sum(F.col("w") * F.col("coef")).alias("s"))
    sizes = groups.groupBy(group).agg(F.count("*").alias("mails"))
    return sums.join(sizes, group).select(group, "block", "mails", (F.col("s") / F.col("mails")).alias("mean_logit"))


def top_pushes(weights: DataFrame, coefficients: DataFrame, ids: DataFrame, id_column: str, min_share: float = 0.25, k: int = 12) -> DataFrame:
    """Features with the highest mean contribution among those present in at least `min_share` of a group."""
    n = ids.agg(F.count("*").cast("double").alias("n")).scalar()
    grouped = weights.join(ids.select(id_column), id_column).join(coefficients, "term").groupBy("term").agg(
        (F.sum(F.col("w") * F.col("coef")) / n).alias("mean_contribution"), (F.count("*") / n).alias("share_of_emails"))
    return grouped.where(F.col("share_of_emails") >= min_share).orderBy(F.col("mean_contribution").desc(), "term").limit(k)


def explain(weights: DataFrame, coefficients: DataFrame, id_column: str, k: int = 5) -> DataFrame:
    """The k features that push each mail most towards phishing; only positive contributions."""
    pushed = weights.join(coefficients, "term").withColumn("contribution", F.col("w") * F.col("coef")).where("contribution > 0")
    order = Window.partitionBy(id_column).orderBy(F.col("contribution").desc(), "term")
    return pushed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(id_column, "rank", "term", "contribution")
