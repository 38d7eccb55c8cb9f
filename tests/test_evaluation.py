"""Metrics, thresholds, splits and policies: closed forms, brute force and invariants."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.functions import policy as pol
from mailgrain.functions import stats
from mailgrain.operators import curves as cv
from mailgrain.operators import metrics as mt
from mailgrain.operators import splits as sp


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    data = [(i, int(rng.random() < 0.3), i % 5) for i in range(600)]
    data = [(i, y, f, round(min(0.999, max(0.001, rng.gauss(0.65 if y else 0.35, 0.2))), 3)) for i, y, f in data]
    return spark.createDataFrame(data, "id long, label int, fold int, score double").persist()


def rows_of(df):
    return [(r.label, r.score) for r in df.collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_mcnemar_closed_form(spark):
    assert value(spark, stats.mcnemar_p(F.lit(10), F.lit(0))) == pytest.approx(2 / 2 ** 10)
    assert value(spark, stats.mcnemar_p(F.lit(0), F.lit(0))) == 1.0
    assert round(value(spark, stats.mcnemar_p(F.lit(11), F.lit(3))), 4) == 0.0574


def test_fisher_and_chi_square(spark):
    assert value(spark, stats.fisher_p(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) == pytest.approx(0.4857142857)
    start = time.time()
    assert 0.3 < stats._fisher(250_000_000, 250_000_100, 250_020_000, 249_990_000) < 0.4 and time.time() - start < 5
    assert stats._fisher(0, 0, 0, 0) == 1.0 and stats._fisher(5, 0, 0, 5) == pytest.approx(2 / 252)
    assert value(spark, stats.chi_square_p(F.lit(3.841459), F.lit(1))) == pytest.approx(0.05, abs=1e-6)
    assert value(spark, stats.chi_square_p(F.lit(5.991465), F.lit(2))) == pytest.approx(0.05, abs=1e-6)


def test_wilson(spark):
    lo, hi = stats.wilson(F.lit(0), F.lit(50))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r.lo == 0.0 and 0.05 < r.hi < 0.09
    lo, hi = stats.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r.lo is None and r.hi is None


def test_curve_against_brute_force(scored):
    data = rows_of(scored)
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    got = cv.curve_summary(cv.score_curve(scored), fpr_limit=0.05).first()
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got.roc_auc == pytest.approx(auc)

    def f1(t):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        return 2 * tp / (tp + fp + len(pos))
    best = max(f1(t) for t in {s for _, s in data})
    assert got.best_f1_threshold == min(t for t in {s for _, s in data} if abs(f1(t) - best) < 1e-12)
    allowed = math.floor(0.05 * len(neg))
    assert got.cut_above == sorted(neg, reverse=True)[allowed]
    assert sum(s > got.cut_above for s in neg) <= allowed


def test_f1_grid_against_brute_force(scored):
    curve = {(r.fold, r.cell): r.f1 for r in cv.f1_grid_curve(scored, "score").collect()}
    data = [(r.fold, r.label, r.score) for r in scored.collect()]
    for cell in (0, 137, 490, 777, 980):
        t = (cell + 10) / 1000
        for fold in range(5):
            rows = [(y, s) for f, y, s in data if f == fold]
            tp = sum(y and s >= t for y, s in rows)
            fp = sum((not y) and s >= t for y, s in rows)
            fn = sum(y and s < t for y, s in rows)
            assert curve[(fold, cell)] == pytest.approx(2 * tp / max(2 * tp + fp + fn, 1))


def test_plateau_is_contiguous_to_the_peak(spark):
    data = [(k, c, 0.9 if 300 <= c <= 400 or c == 600 else 0.5) for k in range(3) for c in range(981)]
    data = [(k, c, f + (0.01 if c == 350 else 0)) for k, c, f in data]
    curve = spark.createDataFrame(data, "fold int, cell int, f1 double")
    r = cv.plateau_threshold(curve).first()
    assert r.peak == pytest.approx(0.36) and r.plateau_lo == r.plateau_hi == pytest.approx(0.36)


def test_min_cost_matches_brute_force(scored):
    grid = cv.cost_grid()
    data = rows_of(scored)
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    got = cv.min_cost_threshold(scored, "score", "label", [{"cost_ratio": 10.0, "prevalence": 0.05}]).first()
    cost = lambda t: 0.05 * 10 * sum(s < t for s in pos) / len(pos) + 0.95 * sum(s >= t for s in neg) / len(neg)
    assert got.cost == pytest.approx(min(cost(t) for t in grid))
    assert cost(got.threshold) == pytest.approx(got.cost)


def test_calibration_of_perfect_bins(spark):
    data = [(i, int(i % 10 < k), k / 10 + 0.05) for k in range(10) for i in range(1000)]
    r = mt.calibration(spark.createDataFrame(data, "id long, label int, score double"), "score").first()
    assert r.ece == pytest.approx(0.05, abs=1e-6)


def test_policy_arithmetic(spark):
    back = pol.shift_probability(pol.shift_probability(F.lit(0.3), 0.01, 0.4), 0.4, 0.01)
    assert value(spark, back) == pytest.approx(0.3)
    assert value(spark, pol.cost_threshold(1, 0.4, 0.4)) == pytest.approx(0.5)
    band = value(spark, pol.review_band(100, 0.25, 0.01, 0.4))
    single = value(spark, pol.cost_threshold(100, 0.01, 0.4))
    assert band.lo < single < band.hi
    assert value(spark, pol.review_band(1, 0.5, 0.01, 0.4)) is None


def test_policy_bootstrap_is_centred_and_paired(scored):
    bands = {"a": (0.5, 0.5), "b": (0.3, 0.7)}
    point = {r.policy: r for r in mt.policy_rates(scored, bands, "score").collect()}
    draws = mt.bootstrap_policy_rates(scored, bands, "score", replicates=400).groupBy("policy").agg(
        F.avg("fnr").alias("fnr"), F.avg("fpr").alias("fpr"), F.avg("review_legit").alias("rl")).collect()
    for r in draws:
        assert r.fnr == pytest.approx(point[r.policy].fnr, abs=0.01)
        assert r.fpr == pytest.approx(point[r.policy].fpr, abs=0.01)
        assert r.rl == pytest.approx(point[r.policy].review_legit, abs=0.01)


def test_auc_bootstrap_is_centred(scored):
    point = cv.curve_summary(cv.score_curve(scored)).first().roc_auc
    r = mt.bootstrap_auc(scored, "score", replicates=300).agg(F.avg("auc").alias("m"), F.stddev("auc").alias("s")).first()
    assert r.m == pytest.approx(point, abs=0.01) and 0.005 < r.s < 0.05


def test_auc_bootstrap_equals_resampling_rows(spark):
    rng = np.random.default_rng(7)
    label = (rng.random(400) < 0.3).astype(int)
    score = np.round(rng.normal(label * 1.2, 1.0), 1)  # with ties
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")

    def area(p, n):
        return float(((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n)))

    p, n = score[label == 1], score[label == 0]
    brute = [area(rng.choice(p, len(p)), rng.choice(n, len(n))) for _ in range(2000)]
    for blocks in (4096, 64):  # every score a block of its own, and about 6 mails a block
        got = [r.auc for r in mt.bootstrap_auc(df, "score", blocks=blocks).collect()]
        assert len(got) == 2000
        for q in (2.5, 50, 97.5):
            assert np.percentile(got, q) == pytest.approx(np.percentile(brute, q), abs=0.006)
    cells = mt.score_blocks(df, "score", blocks=64)
    assert cells.count() <= 65
    # the draws follow seed and replicate, not the number of partitions
    first = {r.replicate: r.auc for r in mt.bootstrap_auc(df, "score", replicates=20).collect()}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {r.replicate: r.auc for r in mt.bootstrap_auc(df, "score", replicates=20).collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_auc_bootstrap_of_one_class_has_no_value(spark):
    df = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert {r.auc for r in mt.bootstrap_auc(df, "score", replicates=5).collect()} == {None}


def test_jeffreys_interval_without_false_alarms(spark):
    counts = spark.createDataFrame([(90, 0, 500, 10)], "tp long, fp long, tn long, fn long")
    r = mt.prevalence_table(counts, [0.01]).first()
    assert r.precision == 1.0 and 0 < r.lo < r.hi <= 1.0


def test_groups_never_split(spark):
    rng = random.Random(3)
    data = [(i, int(rng.random() < 0.4), f"g{rng.randint(0, 60)}") for i in range(900)]
    df = spark.createDataFrame(data, "id long, label int, grp string")
    for out, column in ((sp.grouped_folds(df, "grp", "label", 5), "fold"), (sp.group_split(df, "grp"), "part")):
        assert out.count() == 900
        assert out.groupBy("grp").agg(F.countDistinct(column).alias("n")).where("n > 1").isEmpty()
    sizes = {r.part: r.n for r in sp.group_split(df, "grp").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert 0.6 < sizes[0] / 900 < 0.8
    shares = sp.stratified_split(df, "id", "label").groupBy("part").agg(F.avg("label").alias("y"), F.count("*").alias("n")).collect()
    assert max(r.y for r in shares) - min(r.y for r in shares) < 0.02 and len(shares) == 3


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(str(k), float(v)) for k in range(3) for v in rng.integers(0, 20, 5 + 40 * k)] + [("0", None), ("single", 3.5)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"a": 0.025, "b": 0.5, "c": 1.0}
    for r in cv.percentiles(df, "v", shares, ["k"]).collect():
        own = [v for k, v in data if k == r.k and v is not None]
        assert [r.a, r.b, r.c] == pytest.approx([np.quantile(own, q) for q in shares.values()])
    assert cv.percentiles(df.where("false"), "v", {"a": 0.5}).first().a is None


def test_adoption_and_chi_square_on_empty_cells(spark):
    counts = spark.createDataFrame([(1, 9, 0.02), (2, 8, 0.1), (9, 1, 0.02)], "only_a_correct int, only_b_correct int, p double")
    assert mt.adoption(counts).first().adopted is False
    assert mt.adoption(counts.where("only_a_correct < 9")).first().adopted is True
    same = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "g string, s double")
    assert mt.chi_square(same, F.col("s") > 2, "g").first().statistic == 0.0


def test_verdict_percentages_round_the_product(spark):
    """A score whose percentage falls a last bit short of a tie: 0.0715 * 100 is 7.1499..., times ten it is 71.5."""
    from types import SimpleNamespace

    from mailgrain.catalog.evaluation import verdict_text
    table = spark.createDataFrame([(1, 0.0715), (2, 0.5135), (3, 0.25), (4, 1.0)], "doc_id long, score_a double")
    said = {r.doc_id: r.verdict.split(": ")[1].split("%")[0] for r in verdict_text(SimpleNamespace(scored=table)).collect()}
    assert said == {1: "7.2", 2: "51.4", 3: "25.0", 4: "100.0"}
