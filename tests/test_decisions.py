"""Decision and second-stage studies and the first-seen stream against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.operators import metrics as mt
from mailgrain.plans import decision as dc
from mailgrain.streaming import scoring as st

SHARE, FIXED = 0.4, 0.5
CELLS = [(1, 0.01), (100, 0.01), (10, 0.05)]


def _data():
    rng = random.Random(3)
    out = []
    for name, n, shift in (("train", 400, 0.0), ("a", 150, 0.1), ("b", 150, -0.1)):
        for _ in range(n):
            y = int(rng.random() < 0.4)
            out.append((name, y, round(min(0.999, max(0.001, rng.gauss((0.7 if y else 0.3) + shift, 0.2))), 3)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(_data(), "set_name string, label int, score double")


def _cost(rows, lo, hi, r, p, c=0.0):
    y, s = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    flag, review = s >= hi, (s > lo) & (s < hi)
    fnr, fpr = (~flag & ~review)[y == 1].mean(), flag[y == 0].mean()
    return 1000 * (p * (r * fnr + c * review[y == 1].mean()) + (1 - p) * (fpr + c * review[y == 0].mean()))


def test_costs_and_regret(scored):
    data = {}
    for row in _data():
        data.setdefault(row[0], []).append(row)
    got = dc.decision_costs(scored, "train", CELLS, SHARE, FIXED).collect()
    assert len(got) == 3 * len(CELLS) * 3
    grid = 1 / (1 + np.exp(-np.linspace(np.log(1e-4 / (1 - 1e-4)), -np.log(1e-4 / (1 - 1e-4)), 2001)))
    for g in got:
        assert g.cost == pytest.approx(_cost(data[g.set_name], g.threshold, g.threshold, g.cost_ratio, g.prevalence))
        assert g.trivial_cost == pytest.approx(1000 * min(g.prevalence * g.cost_ratio, 1 - g.prevalence))
        best = min(_cost(data[g.set_name], t, t, g.cost_ratio, g.prevalence) for t in grid)
        if g.set_name == "train":
            assert g.oracle_cost is None and g.regret is None
            assert g.policy != "P2" or g.cost == pytest.approx(best)
        else:
            assert g.oracle_cost == pytest.approx(best) and g.regret == pytest.approx(g.cost - best)
    one = next(g for g in got if g.policy == "P1" and g.cost_ratio == 100)
    assert one.threshold == pytest.approx(1 / (1 + 100 * (0.01 / 0.99) / (0.4 / 0.6)))


def test_paired_differences_and_adoption(spark, scored):
    diffs = dc.cost_differences(scored, "train", CELLS, SHARE, FIXED, (100, 0.01), [0.25, 5.0], replicates=400)
    got = {(r.set_name, r.cost_ratio, r.prevalence, r.compared): r for r in diffs.collect()}
    assert len(got) == 3 * (len(CELLS) + 1)  # a review at 5 costs more than it saves
    rows = [x for x in _data() if x[0] == "a"]
    t = 1 / (1 + 100 * (0.01 / 0.99) / (0.4 / 0.6))
    r = got["a", 100.0, 0.01, "P1 - P0"]
    assert r.difference == pytest.approx(_cost(rows, t, t, 100, 0.01) - _cost(rows, 0.5, 0.5, 100, 0.01), abs=1e-5)
    rng = np.random.default_rng(1)
    pos, neg = [x for x in rows if x[1]], [x for x in rows if not x[1]]
    draws = []
    for _ in range(400):
        again = [pos[i] for i in rng.integers(0, len(pos), len(pos))] + [neg[i] for i in rng.integers(0, len(neg), len(neg))]
        draws.append(_cost(again, t, t, 100, 0.01) - _cost(again, 0.5, 0.5, 100, 0.01))
    lo, hi = np.percentile(draws, [2.5, 97.5])
    assert abs(r.lo - lo) < 0.25 * (hi - lo) and abs(r.hi - hi) < 0.25 * (hi - lo)

    made = [("train", 9.0, 1.0, 2.0), ("a", -1.0, -2.0, 1.0), ("b", -1.0, -2.0, -0.5)]
    table = spark.createDataFrame([(n, 100.0, 0.01, 0.0, "P1 - P0", d, lo, hi) for n, d, lo, hi in made]
                                  + [(n, 100.0, 0.01, 0.25, "review - P1", 1.0, 0.5, 2.0) for n in ("a", "b")],
                                  "set_name string, cost_ratio double, prevalence double, review_cost double, compared string, difference double, lo double, hi double")
    verdict = {r.policy: r.qualifies for r in dc.adoption(table, "train", (100, 0.01), 0.25).collect()}
    assert verdict == {"P1": True, "review": False}
    worse = table.withColumn("lo", F.when(F.col("set_name") == "b", 0.1).otherwise(F.col("lo")))
    assert not any(r.qualifies for r in dc.adoption(worse, "train", (100, 0.01), 0.25).collect())


def test_keys_do_not_change_the_bootstrap(scored):
    bands = {"x": (0.4, 0.4), "y": (0.2, 0.7)}
    keyed = mt.bootstrap_policy_rates(scored, bands, "score", replicates=5, keys=["set_name"]).where("set_name = 'a'").drop("set_name")
    alone = mt.bootstrap_policy_rates(scored.where("set_name = 'a'"), bands, "score", replicates=5)
    assert sorted(keyed.collect()) == sorted(alone.collect())


def test_sender_stage(spark):
    train = [("train", 1, 0.5 + i / 100, True, False) for i in range(41)] + [("train", 1, 0.99, False, False), ("train", 0, 0.9, True, False)]
    bar = float(np.percentile([0.5 + i / 100 for i in range(41)], 5))
    legit = [("x", 0, 0.505, True, False)] * 8 + [("x", 0, 0.6, True, True), ("x", 0, 0.1, True, False)]
    positive = [("x", 1, 0.51, True, False), ("x", 1, 0.9, True, False), ("x", 1, 0.51, False, False)]
    frame = spark.createDataFrame(train + legit + positive, "set_name string, label int, score double, verified boolean, suspicious boolean")
    stages = dc.sender_stage(frame, "train", 0.5)
    got = {r.label: r for r in stages.collect()}
    assert got[0].bar == pytest.approx(bar) and (got[0].n, got[0].relieved, got[0].base, got[0].stage) == (10, 9, 9, 1)
    assert (got[0].only_stage_correct, got[0].only_base_correct) == (8, 0) and got[0].p_value == pytest.approx(2 / 2 ** 8, abs=1e-4)
    assert (got[1].base, got[1].stage, got[1].only_base_correct) == (3, 2, 1)
    assert dc.sender_decision(stages).first().asDict() == {"lost_recall_sets": 0, "cleared_sets": 1, "qualifies": True}
    none = dc.sender_stage(frame.withColumn("verified", F.lit(False)), "train", 0.5)
    assert all(r.bar == 0.5 and r.base == r.stage for r in none.collect())


def test_first_rows_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None if i == 7 else f"2025-01-{rng.randint(1, 28):02d} 00:00:00", rng.choice(["A b", "a  B", "c", "d e"])) for i in range(60)]
    rows += [(99, "2024-01-01 00:00:00", "c"), (98, "2024-01-01 00:00:00", "c"), (97, None, "alone"), (96, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "id long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = st.mail_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    st.run_available(st.first_so_far(stream, "ts", "id", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    first = st.settled(spark.read.parquet(str(tmp_path / "out")), "ts", "id").collect()
    want = {}
    for i, ts, text in rows:
        if text is not None:
            key = "".join(text.split()).lower()
            want[key] = min(want.get(key, ("9", 1000)), (ts or "9", i))
    assert sorted(r.id for r in first) == sorted(i for _, i in want.values())
    assert 98 in {r.id for r in first} and 97 in {r.id for r in first}
