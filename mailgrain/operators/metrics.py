"""Grouped evaluation: confusion counts, rates with intervals, calibration, policies, bootstrap."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import ratio
from ..functions.policy import expected_cost
from ..functions.stats import jeffreys_precision_draws, precision_at_prevalence, share, wilson
from .curves import running_totals
from .joins import cross_with_values, one_row


def confusion(df: DataFrame, flagged: Column, label: str = "label", keys=()) -> DataFrame:
    y = F.col(label)
    return df.groupBy(*keys).agg(
        F.count_if(flagged & (y == 1)).alias("tp"), F.count_if(flagged & (y == 0)).alias("fp"),
        F.count_if(~flagged & (y == 0)).alias("tn"), F.count_if(~flagged & (y == 1)).alias("fn"))


def with_rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and false-alarm rate (zero-safe) with Wilson intervals."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = {
        "precision": F.round(ratio(tp, tp + fp), digits), "recall": F.round(ratio(tp, tp + fn), digits),
        "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), digits), "fpr": F.round(ratio(fp, fp + tn), digits),
    }
    for name, k, n in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("fpr", fp, fp + tn)):
        out[f"{name}_lo"], out[f"{name}_hi"] = wilson(k, n)
    return counts.withColumns(out)


def flagged_rates(df: DataFrame, flagged: Column, keys=()) -> DataFrame:
    """Record k, n, rate (null for n = 0) and interval per key."""
    counts = df.groupBy(*keys).agg(F.count_if(flagged).alias("k"), F.count("*").alias("n"))
    return with_share(counts)


def with_share(counts: DataFrame) -> DataFrame:
    lo, hi = wilson(F.col("k"), F.col("n"))
    return counts.withColumns({"rate": share(F.col("k"), F.col("n")), "lo": lo, "hi": hi})


def breakdown(df: DataFrame, flagged: Column, dimensions) -> DataFrame:
    """Flagged rate by each dimension in one pass over grouping sets."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.count_if(flagged).alias("k"), F.count("*").alias("n"), F.grouping_id().alias("_g"))
    last = len(dimensions) - 1
    which = F.coalesce(*[F.when(F.col("_g") == (2 ** (last + 1) - 1) - 2 ** (last - i), d) for i, d in enumerate(dimensions)])
    value = F.coalesce(*[F.when(F.col("_g") == (2 ** (last + 1) - 1) - 2 ** (last - i), F.col(d).cast("string"))
                         for i, d in enumerate(dimensions)])
    return with_share(grouped.select(which.alias("dimension"), value.alias("value"), "k", "n"))


def mcnemar_counts(paired: DataFrame, label: str = "label", keys=()) -> DataFrame:
    y = F.col(label) == 1
    a, b = F.col("pred_a") == y, F.col("pred_b") == y
    return paired.groupBy(*keys).agg(F.count_if(a & ~b).alias("only_a_correct"), F.count_if(~a & b).alias("only_b_correct"))


def probability_bin(p: Column, bins: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(p * bins), F.lit(bins - 1))).cast("int")


def reliability(df: DataFrame, score: str, label: str = "label", bins: int = 10, keys=()) -> DataFrame:
    p = F.col(score)
    return df.groupBy(*keys, probability_bin(p, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"),
        F.sum((p - F.col(label)) ** 2).alias("_sq"))


def calibration(df: DataFrame, score: str, label: str = "label", keys=()) -> DataFrame:
    """Brier score and expected calibration error from one pass over ten bins."""
    bins = reliability(df, score, label, keys=keys)
    return bins.groupBy(*keys).agg(
        F.round(F.sum("_sq") / F.sum("n"), 4).alias("brier"),
        F.round(F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))) / F.sum("n"), 4).alias("ece"))


def policy_rates(df: DataFrame, bands: dict, score: str, label: str = "label", keys=()) -> DataFrame:
    """Missed, false-alarm and review rates of every named (lo, hi) band: one scan, one wide aggregation."""
    p, y = F.col(score), F.col(label)
    aggs = [F.count_if(y == 1).alias("P"), F.count_if(y == 0).alias("N")]
    for i, (lo, hi) in enumerate(bands.values()):
        flag, review = p >= hi, (p > lo) & ~(p >= hi)
        aggs += [F.count_if(~flag & ~review & (y == 1)).alias(f"m{i}"), F.count_if(flag & (y == 0)).alias(f"f{i}"),
                 F.count_if(review & (y == 1)).alias(f"rp{i}"), F.count_if(review & (y == 0)).alias(f"rl{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                              F.col(f"m{i}").alias("m"), F.col(f"f{i}").alias("f"), F.col(f"rp{i}").alias("rp"), F.col(f"rl{i}").alias("rl"))
                     for i, (name, (lo, hi)) in enumerate(bands.items())])
    out = df.groupBy(*keys).agg(*aggs).select(*keys, "P", "N", F.explode(rows).alias("r"))
    return out.select(*keys, F.col("r.policy").alias("policy"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"),
                      ratio(F.col("r.m"), F.col("P")).alias("fnr"), ratio(F.col("r.f"), F.col("N")).alias("fpr"),
                      ratio(F.col("r.rp"), F.col("P")).alias("review_phishing"), ratio(F.col("r.rl"), F.col("N")).alias("review_legit"))


def policy_costs(rates: DataFrame, cost_ratio, prevalence, review_cost=0.0) -> DataFrame:
    cost = expected_cost(F.col("fnr"), F.col("fpr"), F.col("review_phishing"), F.col("review_legit"), cost_ratio, prevalence, review_cost)
    return rates.withColumn("cost_per_1000", 1000 * cost)


def bootstrap_policy_rates(df: DataFrame, bands: dict, score: str, label: str = "label", replicates: int = 2000, seed: int = 0, keys=()) -> DataFrame:
    """Stratified bootstrap of policy rates, paired across policies.

    Rates depend on a mail only through its class and the interval between neighbouring band limits
    it falls into. Resampling n mails is therefore the same as one multinomial draw over those few
    interval counts: one aggregation over the mails, then `replicates` small draws, whatever n is.
    """
    limits = sorted({float(x) for band in bands.values() for x in band})
    p = F.col(score)
    # position 2i+1 is "equal to limit i", even positions are the open intervals around it
    place = F.lit(0)
    for x in limits:
        place = place + F.when(p > x, 2).when(p == x, 1).otherwise(0)
    counts = df.groupBy(*keys, (place + F.when(F.col(label) == 1, 2 * len(limits) + 1).otherwise(0)).alias("k")).agg(F.count("*").alias("n"))
    table = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))  # a bounded number of cells
    named = list(bands.items())
    width = 2 * len(limits) + 1

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def draw(replicate: pd.Series, counts: pd.Series) -> pd.Series:
        middle = np.empty(width)
        middle[0], middle[-1] = -np.inf, np.inf
        for i, x in enumerate(limits):
            middle[2 * i + 1] = x
            if i + 1 < len(limits):
                middle[2 * i + 2] = (x + limits[i + 1]) / 2
        out = []
        for b, c in zip(replicate, counts):
            cells = dict(c)
            full = np.array([cells.get(k, 0) for k in range(2 * width)], dtype=float)
            rng = np.random.default_rng([seed, int(b)])
            legit, phish = full[:width], full[width:]
            s0 = rng.multinomial(int(legit.sum()), legit / max(legit.sum(), 1)) / max(legit.sum(), 1)
            s1 = rng.multinomial(int(phish.sum()), phish / max(phish.sum(), 1)) / max(phish.sum(), 1)
            rows = []
            for _, (lo, hi) in named:
                flag = middle >= hi
                review = (middle > lo) & ~flag
                rows.append([s1[~flag & ~review].sum(), s0[flag].sum(), s1[review].sum(), s0[review].sum()])
            out.append(rows)
        return pd.Series(out)

    # one row of counts becomes one small row per replicate, spread over the tasks
    replicas = table.select(*keys, "counts", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).repartition("replicate")
    drawn = replicas.withColumn("rates", draw("replicate", "counts"))
    names = F.lit([n for n, _ in named])
    rows = drawn.select(*keys, "replicate", F.explode(F.arrays_zip(names.alias("policy"), F.col("rates").alias("rates"))).alias("r"))
    value = lambda i: F.get(F.col("r.rates"), F.lit(i))
    return rows.select(*keys, "replicate", F.col("r.policy").alias("policy"), value(0).alias("fnr"), value(1).alias("fpr"),
                       value(2).alias("review_phishing"), value(3).alias("review_legit"))


def percentile_interval(value: Column) -> tuple[Column, Column]:
    return F.percentile(value, 0.025), F.percentile(value, 0.975)


def score_blocks(df: DataFrame, score: str, label: str = "label", blocks: int = 4096) -> DataFrame:
    """(block, pos, neg, area): at most `blocks` + 1 consecutive ranges of scores with about equal mail counts.

    `area` counts the block's own pairs of a positive above a negative, ties half. A score never spans two blocks; with
    no more different scores than `blocks` every score that holds its share is a block of its own."""
    counted = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"), F.count("*").alias("n"))
    placed = running_totals(counted, [], "score", ["n"], descending=False)
    total = one_row(placed.agg(F.sum("n").alias("n")))["n"]
    placed = placed.withColumn("block", F.floor((F.col("n_run") - F.col("n")) * blocks / total))
    below = Window.partitionBy("block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # one block's scores
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2.0)
    return placed.withColumn("pairs", pairs).groupBy("block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("area"))


def bootstrap_auc(df: DataFrame, score: str, label: str = "label", replicates: int = 2000, seed: int = 0, blocks: int = 4096) -> DataFrame:
    """ROC-AUC of every stratified bootstrap replicate.

    A replicate redraws both classes as one multinomial over score blocks, so its cost depends on the number of blocks
    alone. Pairs from different blocks are exact. Pairs inside a block count with the block's own share of ordered
    pairs; they are less than one in `blocks` of all pairs where classes are mixed. Draws depend on the seed and the
    replicate only, never on how data are dealt.
    """
    table = score_blocks(df, score, label, blocks).agg(F.array_sort(F.collect_list(F.struct("block", "pos", "neg", "area"))).alias("cells"))  # at most blocks + 1 rows

    @F.pandas_udf("double")
    def draw(replicate: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for b, c in zip(replicate, cells):
            pos, neg, area = (np.array([x[k] for x in c], dtype=float) for k in ("pos", "neg", "area"))
            if not pos.sum() or not neg.sum():
                out.append(np.nan)
                continue
            rng = np.random.default_rng([seed, int(b)])
            p, n = (rng.multinomial(int(x.sum()), x / x.sum()).astype(float) for x in (pos, neg))
            inside = np.divide(area, pos * neg, out=np.zeros_like(area), where=pos * neg > 0)
            out.append(float((p * (np.cumsum(n) - n)).sum() + (p * n * inside).sum()) / (p.sum() * n.sum()))
        return pd.Series(out)

    replicas = table.select("cells", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).repartition("replicate")
    return replicas.select(F.col("replicate").cast("long").alias("replicate"), F.nanvl(draw("replicate", "cells"), F.lit(None)).alias("auc"))


def prevalence_table(counts: DataFrame, prevalences, draws: int = 20000, blocks: int = 20) -> DataFrame:
    """Precision at realistic phishing shares with a Jeffreys interval, from confusion counts."""
    keys = [c for c in counts.columns if c not in ("tp", "fp", "tn", "fn")]
    crossed = cross_with_values(counts, "prevalence", [float(p) for p in prevalences])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    point = precision_at_prevalence(ratio(tp, tp + fn), ratio(fp, fp + tn), F.col("prevalence"))
    blocked = crossed.withColumn("precision", F.round(point, 4)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    drawn = blocked.withColumn("_v", F.explode(jeffreys_precision_draws(
        tp, fn, fp, tn, F.col("prevalence"), F.lit(draws // blocks), F.col("_b"))))
    lo, hi = percentile_interval(F.col("_v"))
    return drawn.groupBy(*keys, "prevalence").agg(F.first("precision").alias("precision"), F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


# ---------------------------------------------------------------- tests and summaries over sets, folds and policies
def chi_square(df: DataFrame, flagged: Column, group: str) -> DataFrame:
    """(statistic, freedom) of flagged against the groups; two groups get the continuity correction, an empty
    expectation adds nothing."""
    counts = df.groupBy(group).agg(F.count_if(flagged).alias("k"), F.count("*").alias("n"))
    total = one_row(counts.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("g")))
    part = F.try_divide(total["k"], total["n"])
    e1, e0 = F.col("n") * part, F.col("n") * (1 - part)
    gap = F.abs(F.col("k") - e1)
    gap = F.when(total["g"] == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    term = F.coalesce(F.try_divide(gap ** 2, e1), F.lit(0.0)) + F.coalesce(F.try_divide(gap ** 2, e0), F.lit(0.0))
    return counts.withColumn("_x", term).agg(F.sum("_x").alias("statistic"), (F.count("*") - 1).alias("freedom"))


def f1_scores(df: DataFrame, flags: dict, label: str = "label", keys=("fold",)) -> DataFrame:
    """F1 per key of every named decision; 0 where nothing is positive and nothing flagged."""
    y = F.col(label) == 1
    return df.groupBy(*keys).agg(*[ratio(2 * F.count_if(f & y), F.count_if(y) + F.count_if(f)).alias(name) for name, f in flags.items()])


def spread(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Mean, population deviation and range over repetitions (seeds or folds)."""
    return df.agg(*[F.round(f(value), digits).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))])


def paired_difference(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Mean of `a`, mean of b - a over the same folds, and their standard errors."""
    d, root = F.col(b) - F.col(a), F.sqrt(F.count("*"))
    return df.agg(F.round(F.avg(a), digits).alias("mean_a"), F.round(F.stddev_samp(a) / root, digits).alias("se_a"),
                  F.round(F.avg(d), digits).alias("difference"), F.round(F.stddev_samp(d) / root, digits).alias("se_difference"))


def top_errors(df: DataFrame, flagged: Column, score: str, id_column: str, keys, n: int = 8, label: str = "label") -> DataFrame:
    """The `n` lowest-scored misses and highest-scored alarms of every key (a top-k report)."""
    wrong = df.where((F.col(label) == 1) != flagged).withColumn("kind", F.when(F.col(label) == 1, "miss").otherwise("alarm"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.when(F.col("kind") == "miss", F.col(score)).otherwise(-F.col(score)), id_column)
    ranked = wrong.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
    return ranked.select(*keys, "kind", "rank", id_column, F.col(score).alias("score"))


def risk_coverage(df: DataFrame, steps: list, score: str, cost_ratio: float, prevalence: float, digits: int = 6) -> DataFrame:
    """(step, coverage, total_cost) for a list of (review cost, lower limit, upper limit)."""
    rates = policy_rates(df, {f"{i:04d}": (lo, hi) for i, (_, lo, hi) in enumerate(steps)}, score)
    step = F.col("policy").cast("int")
    review = prevalence * F.col("review_phishing") + (1 - prevalence) * F.col("review_legit")
    cost = expected_cost(F.col("fnr"), F.col("fpr"), F.col("review_phishing"), F.col("review_legit"), cost_ratio, prevalence, F.get(F.lit([c for c, _, _ in steps]), step))
    return rates.select(step.alias("step"), F.round(1 - review, digits).alias("coverage"), F.round(1000 * cost, digits).alias("total_cost"))


def adoption(counts: DataFrame, p_value: str = "p", sets: int = 2, level: float = 0.05) -> DataFrame:
    """Adopt b when at least `sets` sets improve and none is significantly worse (McNemar counts with p-values)."""
    gain, loss = F.col("only_b_correct") > F.col("only_a_correct"), F.col("only_a_correct") > F.col("only_b_correct")
    better, worse = F.count_if(gain), F.coalesce(F.bool_or((F.col(p_value) < level) & loss), F.lit(False))
    return counts.agg(better.alias("better_sets"), F.count("*").alias("sets"), worse.alias("any_worse"), ((better >= sets) & ~worse).alias("adopted"))
