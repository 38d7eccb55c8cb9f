"""Whole analyses composed of the operators: model studies and evaluation reports as tidy tables.

Mails are scored once into a table; everything after scoring is grouped aggregation. Loops run over fixed
lists (models, folds, seeds), never over data.
"""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import policy as pol
from ..functions.stats import fisher_p, mcnemar_p
from ..models import text_model as tm
from ..operators import curves as cv
from ..operators import metrics as mt
from ..operators import splits as sp
from ..session import durable


def stack(parts) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_score(prepared, train: DataFrame, test: DataFrame, options, keep=("label", "source")) -> DataFrame:
    model = tm.TextModel(options).fit(prepared, train)
    key = prepared.id_column
    return durable(model.raw_scores(prepared, test).join(test.select(key, *keep), key))


def best_threshold(scored: DataFrame) -> float:
    return cv.curve_summary(cv.score_curve(scored)).first().best_f1_threshold


def report(scored: DataFrame, threshold: float, **names) -> DataFrame:
    """Rates with intervals plus both areas under the curve, one row."""
    rates = mt.with_rates(mt.confusion(scored, F.col("score") >= threshold))
    area = cv.curve_summary(cv.score_curve(scored)).select(F.round("roc_auc", 4).alias("roc_auc"), F.round("pr_auc", 4).alias("pr_auc"))
    both = rates.select(F.lit(1).alias("_one"), "*").join(area.select(F.lit(1).alias("_one"), "*"), "_one").drop("_one")
    return both.select(*[F.lit(v).alias(k) for k, v in names.items()], F.lit(float(threshold)).alias("threshold"), *both.columns)


def compare_models(mails: DataFrame, prepared, variants: dict, group: str, rule_scores: DataFrame, main: str) -> DataFrame:
    """Every variant on the same grouped 70/15/15 split, the threshold from validation.

    Further rows: the rules with a tuned and with their own threshold, and the mix of rules and `main` with the given weight and
    with the weight of the best validation F1 (the last of equal ones).
    """
    parts = durable(sp.group_split(mails, group))
    train, rest = parts.where("part = 0"), parts.where("part > 0")
    key = prepared.id_column

    def judged(name):
        return fit_score(prepared, train, rest, variants[name], ("label", "source", "part"))

    scored = dict(zip(variants, tm.side_by_side([partial(judged, name) for name in variants])))
    scored["rules"] = durable(rest.join(rule_scores, key).select(key, F.col("rule_score").cast("double").alias("score"), "label", "source", "part"))
    both = durable(scored[main].join(rule_scores, key))
    mixed = lambda w: both.withColumn("score", pol.hybrid_score(F.col("score"), F.col("rule_score"), w))
    weights = [round(0.05 * i, 2) for i in range(21)]
    grid = stack(mixed(w).where("part = 1").select(F.lit(w).alias("weight"), "score", "label") for w in weights)
    curves = cv.curve_summary(cv.score_curve(grid, keys=["weight"]), ["weight"]).select("weight", F.col("best_f1").alias("f1"))
    tuned = cv.best_weight(curves).first().weight
    scored |= {"hybrid": mixed(lx.HYBRID_WEIGHT), "hybrid, tuned weight": mixed(tuned)}
    rows = [partial(report, table.where("part = 2"), best_threshold(table.where("part = 1")), model=name) for name, table in scored.items()]
    rows.append(partial(report, scored["rules"].where("part = 2"), lx.RULE_VERDICT_SCORE, model="rules, own threshold"))
    return stack(row() for row in rows)


def fold_report(mails: DataFrame, prepared, options, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """F1 per fold at 0.5 and its mean and deviation."""
    folded = durable(sp.grouped_folds(mails, group, "label", folds, seed))
    oof = tm.oof_scores(prepared, folded.select(prepared.id_column, "label", "fold"), options, folds)
    return mt.with_rates(mt.confusion(oof, F.col("score") >= 0.5, keys=["fold"])).agg(
        F.count("*").alias("folds"), F.round(F.avg("f1"), 4).alias("mean_f1"), F.round(F.stddev_pop("f1"), 4).alias("std_f1"))


def transfer(prepared, train: DataFrame, test: DataFrame, options, name: str) -> DataFrame:
    """Train on one corpus, test on another, threshold 0.5."""
    return report(fit_score(prepared, train, test, options), 0.5, training=name)


def adaptation(prepared, source: DataFrame, target: DataFrame, options, group: str) -> DataFrame:
    """Three training mixes: source only, half of the target only, both; tested on the other half.

    Groups stay whole; a fifth of the target's first half chooses every threshold.
    """
    slices = durable(sp.group_split(target, group, fractions=(0.4, 0.1, 0.5)))
    half = slices.where("part = 0").drop("part")
    mixes = {"source only": source, "half target": half, "both": source.unionByName(half)}

    def judged(name):
        scored = fit_score(prepared, mixes[name], slices.where("part > 0"), options, ("label", "source", "part"))
        return report(scored.where("part = 2"), best_threshold(scored.where("part = 1")), training=name)

    return stack(tm.side_by_side([partial(judged, name) for name in mixes]))


def false_alarm_study(prepared, train: dict, val: DataFrame, test: DataFrame, versions: dict) -> DataFrame:
    """Flag rate per source for every version at the best-F1 point and at 1% validation false alarms.

    `versions`: name -> (options, name of the training set in `train`).
    """
    def judged(name):
        options, mix = versions[name]
        scored = fit_score(prepared, train[mix], val.unionByName(test), options, ("label", "source", "part"))
        point = cv.curve_summary(cv.score_curve(scored.where("part = 1")), fpr_limit=0.01).first()
        points = (("max F1", F.col("score") >= point.best_f1_threshold), ("FPR 1%", F.col("score") > F.lit(point.cut_above)))
        return stack(mt.flagged_rates(scored.where("part = 2 AND label = 0"), flagged, ["source"]).select(
            F.lit(name).alias("model"), F.lit(operating).alias("operating_point"), "*") for operating, flagged in points)

    return stack(tm.side_by_side([partial(judged, name) for name in versions]))


def paired_tests(a: DataFrame, b: DataFrame, threshold_a: float, threshold_b: float, key: str, groups=("label",)) -> DataFrame:
    """Exact paired tests of two scored tables on the same mails."""
    paired = a.select(key, *groups, (F.col("score") >= threshold_a).alias("pred_a")).join(
        b.select(key, (F.col("score") >= threshold_b).alias("pred_b")), key)
    counts = mt.mcnemar_counts(paired, keys=[g for g in groups if g != "label"] or ["label"])
    return counts.withColumn("p_value", F.round(mcnemar_p("only_a_correct", "only_b_correct"), 4))


def cv_variants(mails: DataFrame, prepared, variants: dict, group: str, folds: int, seed: int = 42) -> DataFrame:
    """Mean fold F1 of every variant and the paired difference to the first one."""
    folded = durable(sp.grouped_folds(mails, group, "label", folds, seed).select(prepared.id_column, "label", "fold"))

    def folds_of(name):
        oof = tm.oof_scores(prepared, folded, variants[name], folds)
        return mt.with_rates(mt.confusion(oof, F.col("score") >= 0.5, keys=["fold"]), 6).select(F.lit(name).alias("model"), "fold", "f1")

    tables = tm.side_by_side([partial(folds_of, name) for name in variants], at_once=3)
    rows = durable(stack(tables))
    base = rows.where(F.col("model") == next(iter(variants))).select("fold", F.col("f1").alias("base"))
    d = F.col("f1") - F.col("base")
    return rows.join(base, "fold").groupBy("model").agg(
        F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_samp("f1") / F.sqrt(F.count("*")), 6).alias("se"),
        F.round(F.avg(d), 6).alias("paired_difference"), F.round(F.stddev_samp(d) / F.sqrt(F.count("*")), 6).alias("paired_se"))


def keep_default_unless_better(cells: DataFrame, default: str) -> DataFrame:
    """The best cell wins only when it beats the default by more than one standard error."""
    best = F.max_by(F.struct("model", "mean_f1", "se"), F.struct(F.col("mean_f1"), F.col("model")))
    base = F.max(F.when(F.col("model") == default, F.col("mean_f1")))
    return cells.agg(best.alias("b"), base.alias("base")).select(
        F.col("b.model").alias("best"), F.col("b.mean_f1").alias("best_f1"), F.col("base").alias("default_f1"),
        F.when(F.col("b.mean_f1") - F.col("base") > F.col("b.se"), F.col("b.model")).otherwise(default).alias("selected"))


def threshold_stability(scored: DataFrame, group: str, seeds, rules=("max", "plateau"), folds: int = 5) -> DataFrame:
    """Threshold per seed and rule on re-drawn grouped folds of the same scores, then its spread."""
    rows = []
    for seed in seeds:
        folded = sp.grouped_folds(scored.drop("fold"), group, "label", folds, seed)
        curve = durable(cv.f1_grid_curve(folded, "score"))
        rows += [cv.plateau_threshold(curve, rule=r).select(F.lit(r).alias("rule"), "threshold") for r in rules]
    return stack(rows).groupBy("rule").agg(
        F.count("*").alias("seeds"), F.round(F.avg("threshold"), 4).alias("mean"), F.round(F.stddev_pop("threshold"), 4).alias("std"),
        F.round(F.min("threshold"), 4).alias("low"), F.round(F.max("threshold"), 4).alias("high"))


def holdout_report(scores: DataFrame, threshold: float) -> DataFrame:
    """Rates per hold-out set and decider from one tidy table (set_name, decider, label, score)."""
    counts = mt.confusion(scores, F.col("score") >= F.when(F.col("decider") == "rules", lx.RULE_VERDICT_SCORE).otherwise(threshold), keys=["set_name", "decider"])
    area = cv.curve_summary(cv.score_curve(scores, keys=["set_name", "decider"]), ["set_name", "decider"])
    return mt.with_rates(counts).join(area.select("set_name", "decider", F.round("roc_auc", 4).alias("roc_auc")), ["set_name", "decider"])


def generated_mail_test(scored: DataFrame, flagged, reference: tuple) -> DataFrame:
    """Flag rates by generator, theme and link class; the overall rate against a reference count by Fisher's test."""
    parts = mt.breakdown(scored, flagged, ["generator", "theme", "links"])
    k, n = reference
    overall = scored.agg(F.count_if(flagged).alias("k"), F.count("*").alias("n"))
    test = overall.withColumn("p", fisher_p("k", F.col("n") - F.col("k"), F.lit(k), F.lit(n - k)))
    row = mt.with_share(test.select(F.lit("all").alias("dimension"), F.lit("all").alias("value"), "k", "n", F.round("p", 6).alias("p_vs_reference")))
    return parts.withColumn("p_vs_reference", F.lit(None).cast("double")).unionByName(row)


def decision_policy(scored: DataFrame, train_share: float, threshold: float, cells, review_cost: float, replicates: int = 2000, keys=()) -> DataFrame:
    """Costs of the fixed threshold, the cost threshold and the review band per cell, with bootstrap intervals."""
    rows = []
    for cost_ratio, prevalence in cells:
        k = pol.odds(prevalence) / pol.odds(train_share)
        t1 = 1.0 / (1.0 + cost_ratio * k)
        bands = {"fixed": (threshold, threshold), "cost": (t1, t1)}
        if review_cost < cost_ratio / (1 + cost_ratio):
            back = lambda p: (pol.odds(p) / k) / (1 + pol.odds(p) / k)
            bands["review"] = (back(review_cost / cost_ratio), back(1 - review_cost))
        point = mt.policy_costs(mt.policy_rates(scored, bands, "score"), cost_ratio, prevalence, review_cost).drop("lo", "hi")
        draws = mt.policy_costs(mt.bootstrap_policy_rates(scored, bands, "score", replicates=replicates), cost_ratio, prevalence, review_cost)
        lo, hi = mt.percentile_interval(F.col("cost_per_1000"))
        interval = draws.groupBy("policy").agg(F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))
        rows.append(point.join(interval, "policy").select(
            F.lit(float(cost_ratio)).alias("cost_ratio"), F.lit(float(prevalence)).alias("prevalence"), "policy",
            F.round("cost_per_1000", 4).alias("cost_per_1000"), "lo", "hi"))
    return stack(rows)
