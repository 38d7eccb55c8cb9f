"""Decision studies: what alarm thresholds cost on every set, how far they stay from the best possible, and a second stage.

A set is a group of scored mails, (set_name, label, score). Everything chosen is chosen on the training set; the other sets
only judge. Mails are aggregated once per step; what is collected is one row per cost cell.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as pol
from ..functions.stats import mcnemar_p
from ..operators import curves as cv
from ..operators import metrics as mt
from ..operators.joins import one_row

FIXED, BY_COST, CHEAPEST, REVIEW = "P0", "P1", "P2", "review"


def _cost_limit(cost_ratio: float, prevalence: float, train_share: float) -> float:
    return 1.0 / (1.0 + cost_ratio * pol.odds(prevalence) / pol.odds(train_share))


def _review_limits(cost_ratio, review_cost, prevalence, train_share):
    """The band sent to an analyst, or None where a review costs more than it can save."""
    if review_cost >= cost_ratio / (1 + cost_ratio):
        return None
    k = pol.odds(prevalence) / pol.odds(train_share)
    back = lambda p: pol.odds(p) / (k + pol.odds(p))
    return back(review_cost / cost_ratio), back(1 - review_cost)


def cell_policies(training: DataFrame, cells, train_share: float, threshold: float) -> list[dict]:
    """Per cell the fixed threshold (P0), the one that follows from the costs (P1) and the cheapest on the training scores (P2)."""
    cells = [(float(r), float(p)) for r, p in cells]
    named = [{"cost_ratio": r, "prevalence": p} for r, p in cells]
    found = {(x.cost_ratio, x.prevalence): x.threshold for x in cv.min_cost_threshold(training, "score", "label", named).collect()}  # one row per cell
    out = []
    for r, p in cells:
        for policy, t in ((FIXED, threshold), (BY_COST, _cost_limit(r, p, train_share)), (CHEAPEST, found.get((r, p), threshold))):
            out.append({"cost_ratio": r, "prevalence": p, "policy": policy, "lo": float(t), "hi": float(t), "review_cost": 0.0})
    return out


def _bands(policies: list[dict]):
    """({band name: limits}, table of policies with their band): equal limits are counted once."""
    limits = sorted({(x["lo"], x["hi"]) for x in policies})
    names = {b: f"b{i}" for i, b in enumerate(limits)}
    return {name: b for b, name in names.items()}, [{**x, "band": names[x["lo"], x["hi"]]} for x in policies]


def _priced(spark, rates: DataFrame, policies: list[dict]) -> DataFrame:
    """`rates` of bands (column policy) as costs per 1,000 mails of the policies that use them."""
    table = spark.createDataFrame(policies, "cost_ratio double, prevalence double, policy string, lo double, hi double, review_cost double, band string")
    rates = rates.drop("lo", "hi").withColumnRenamed("policy", "band")
    cost = pol.expected_cost(F.col("fnr"), F.col("fpr"), F.col("review_phishing"), F.col("review_legit"), F.col("cost_ratio"), F.col("prevalence"), F.col("review_cost"))
    return rates.join(F.broadcast(table), "band").drop("band").withColumn("cost", 1000 * cost)  # three rows per cell


def decision_costs(scored: DataFrame, training: str, cells, train_share: float, threshold: float) -> DataFrame:
    """Costs of P0, P1 and P2 per set and cell, beside the trivial policy and the best threshold of the set itself.

    (set_name, cost_ratio, prevalence, policy, threshold, fnr, fpr, cost, trivial_cost, oracle_cost, regret); the training set has no
    oracle and no regret. Costs are per 1,000 mails in units of one false alarm.
    """
    policies = cell_policies(scored.where(F.col("set_name") == training), cells, train_share, threshold)
    bands, policies = _bands(policies)
    priced = _priced(scored.sparkSession, mt.policy_rates(scored, bands, "score", keys=["set_name"]), policies)
    named = [{"cost_ratio": float(r), "prevalence": float(p)} for r, p in cells]
    oracle = cv.min_cost_threshold(scored.where(F.col("set_name") != training), "score", "label", named, keys=["set_name"])
    oracle = oracle.select("set_name", "cost_ratio", "prevalence", (1000 * F.col("cost")).alias("oracle_cost"))
    return priced.join(oracle, ["set_name", "cost_ratio", "prevalence"], "left").select(
        "set_name", "cost_ratio", "prevalence", "policy", F.col("hi").alias("threshold"), "fnr", "fpr", "cost",
        (1000 * pol.trivial_cost(F.col("cost_ratio"), F.col("prevalence"))).alias("trivial_cost"), "oracle_cost",
        (F.col("cost") - F.col("oracle_cost")).alias("regret"))


def cost_differences(scored: DataFrame, training: str, cells, train_share: float, threshold: float, primary, review_costs, replicates: int = 2000) -> DataFrame:
    """(set_name, cost_ratio, prevalence, review_cost, compared, difference, lo, hi): P1 - P0 in every cell, review - P1 in the primary one.

    Both policies of a difference see the same resampled mails, so the interval is a paired one.
    """
    r0, p0 = (float(x) for x in primary)
    policies, pairs = [], []
    for r, p in ((float(r), float(p)) for r, p in cells):
        t = _cost_limit(r, p, train_share)
        base = {"cost_ratio": r, "prevalence": p, "review_cost": 0.0}
        policies += [{**base, "policy": FIXED, "lo": float(threshold), "hi": float(threshold)}, {**base, "policy": BY_COST, "lo": t, "hi": t}]
        pairs.append((r, p, 0.0, BY_COST, FIXED))
    t = _cost_limit(r0, p0, train_share)
    for c in map(float, review_costs):
        band = _review_limits(r0, c, p0, train_share)
        if band is not None:
            base = {"cost_ratio": r0, "prevalence": p0, "review_cost": c}
            policies += [{**base, "policy": REVIEW, "lo": band[0], "hi": band[1]}, {**base, "policy": BY_COST, "lo": t, "hi": t}]
            pairs.append((r0, p0, c, REVIEW, BY_COST))
    spark, by = scored.sparkSession, ["set_name", "cost_ratio", "prevalence", "review_cost"]
    bands, policies = _bands(policies)
    wanted = F.broadcast(spark.createDataFrame(pairs, "cost_ratio double, prevalence double, review_cost double, a string, b string"))  # one row per pair

    def gaps(rates, keys):
        priced = _priced(spark, rates, policies).join(wanted, ["cost_ratio", "prevalence", "review_cost"])
        cost = lambda side: F.max(F.when(F.col("policy") == F.col(side), F.col("cost")))
        return priced.groupBy(*keys, "a", "b").agg((cost("a") - cost("b")).alias("gap"))

    point = gaps(mt.policy_rates(scored, bands, "score", keys=["set_name"]), by)
    drawn = gaps(mt.bootstrap_policy_rates(scored, bands, "score", replicates=replicates, keys=["set_name"]), [*by, "replicate"])
    lo, hi = mt.percentile_interval(F.col("gap"))
    spread = drawn.groupBy(*by, "a").agg(F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))
    return point.join(spread, [*by, "a"]).select(*by, F.concat("a", F.lit(" - "), "b").alias("compared"), F.round("gap", 6).alias("difference"), "lo", "hi")


def adoption(differences: DataFrame, training: str, primary, review_cost: float, sets: int = 2) -> DataFrame:
    """(policy, lower_sets, significantly_higher, qualifies): cheaper on at least `sets` sets and on none significantly dearer.

    The review band qualifies only if the cost threshold it is built on does.
    """
    r, p = (float(x) for x in primary)
    rows = differences.where((F.col("set_name") != training) & (F.col("cost_ratio") == r) & (F.col("prevalence") == p))
    checks = lambda which: rows.where(which).agg(F.count_if(F.col("difference") < 0).alias("lower_sets"), F.count_if(F.col("lo") > 0).alias("significantly_higher"))
    holds = (F.col("lower_sets") >= sets) & (F.col("significantly_higher") == 0)
    first = checks(F.col("compared") == f"{BY_COST} - {FIXED}").select(F.lit(BY_COST).alias("policy"), "*", holds.alias("qualifies"))
    base = one_row(first.select("qualifies"))["qualifies"]
    second = checks((F.col("compared") == f"{REVIEW} - {BY_COST}") & (F.col("review_cost") == float(review_cost)))
    return first.unionByName(second.select(F.lit(REVIEW).alias("policy"), "*", (holds & base).alias("qualifies")))


def sender_stage(scored: DataFrame, training: str, threshold: float, share: float = 0.05) -> DataFrame:
    """Production against a higher bar for verified senders without a suspicious sign, per set and label.

    `scored`: (set_name, label, score, verified, suspicious). The bar is the `share` percentile of the training set's positive
    mails that would be relieved, never below `threshold`; without any such mail it is `threshold`.
    """
    relieved = F.col("verified") & ~F.col("suspicious")
    eligible = scored.where((F.col("set_name") == training) & (F.col("label") == 1) & relieved)
    bar = F.greatest(F.lit(float(threshold)), one_row(cv.percentiles(eligible, "score", {"bar": share}))["bar"])
    rows = scored.where(F.col("set_name") != training).withColumn("bar", bar)
    base = F.col("score") >= threshold
    stage = F.col("score") >= pol.relieved_threshold(F.col("verified"), F.col("suspicious"), threshold, F.col("bar"))
    right = lambda flagged: flagged == (F.col("label") == 1)
    counts = rows.groupBy("set_name", "label", "bar").agg(
        F.count("*").alias("n"), F.count_if("verified").alias("verified"), F.count_if(relieved).alias("relieved"),
        F.count_if(base).alias("base"), F.count_if(stage).alias("stage"),
        F.count_if(right(stage) & ~right(base)).alias("only_stage_correct"), F.count_if(right(base) & ~right(stage)).alias("only_base_correct"))
    return counts.withColumn("p_value", F.round(mcnemar_p("only_stage_correct", "only_base_correct"), 4))


def sender_decision(stages: DataFrame, level: float = 0.05) -> DataFrame:
    """(lost_recall_sets, cleared_sets, qualifies): no set of positives significantly loses, every set of negatives gains significantly."""
    significant: Column = F.col("p_value") < level
    lost = F.count_if((F.col("label") == 1) & significant & (F.col("only_base_correct") > F.col("only_stage_correct")))
    cleared = F.count_if((F.col("label") == 0) & significant & (F.col("only_stage_correct") > F.col("only_base_correct")))
    negatives = F.count_if(F.col("label") == 0)
    return stages.agg(lost.alias("lost_recall_sets"), cleared.alias("cleared_sets"), ((lost == 0) & (cleared == negatives) & (negatives > 0)).alias("qualifies"))
