"""Near copies against brute force, including a campaign that holds a third of all mails."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import components as cc
from mailgrain.operators import joins as jn
from mailgrain.operators import similarity as sim
from mailgrain.operators import tfidf as tf


def make_mails(n=150, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(30)]
    mails = []
    for i in range(n):
        if i % 3 == 0:  # the hot campaign: small edits of one text
            body = list(base)
            for _ in range(rng.randint(0, 4)):
                body[rng.randrange(len(body))] = rng.choice(words)
        elif i % 7 == 0:
            body = base[:rng.randint(10, 25)] + [rng.choice(words) for _ in range(15)]
        else:
            body = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        mails.append((i, " ".join(body)))
    mails += [(n, mails[1][1]), (n + 1, mails[1][1].upper())]
    return mails


def vectors(mails, min_df, max_df):
    counts = {i: Counter(w for w in t.lower().split() if len(w) >= 2) for i, t in mails}
    df = Counter(w for c in counts.values() for w in c)
    n = len(mails)
    out = {}
    for i, c in counts.items():
        v = {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items() if min_df <= df[w] <= max_df * n}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {w: x / norm for w, x in v.items()} if norm else {}
    return out


def brute_groups(mails, threshold=0.8):
    v = vectors(mails, 2, 0.5)
    label = {i: i for i, _ in mails}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(v)
    for x in ids:
        for y in ids:
            if x < y and round(sum(w * v[y].get(k, 0) for k, w in v[x].items()), 9) >= threshold:
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [5, 11])
def test_groups_equal_brute_force(spark, seed):
    mails = make_mails(seed=seed)
    df = spark.createDataFrame(mails, "doc_id long, text string")
    got = {r.doc_id: r.grp for r in sim.near_copy_groups(df, "doc_id").collect()}
    assert got == brute_groups(mails)


def test_held_out_copies_equal_brute_force(spark):
    mails = make_mails(seed=9)
    test_ids = {i for i, _ in mails if i % 4 == 1}
    v = vectors(mails, 1, 1.0)
    want = {x for x in v if x not in test_ids and any(round(sum(w * v[y].get(k, 0) for k, w in v[x].items()), 9) >= 0.8 for y in test_ids)}
    df = spark.createDataFrame(mails, "doc_id long, text string")
    test = df.where(F.col("doc_id") % 4 == 1)
    got = {r.doc_id for r in sim.near_copy_ids(df.where(F.col("doc_id") % 4 != 1), test, "doc_id").collect()}
    assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, i) for i in range(2, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in cc.connected_components(df).collect()}
    assert {got[i] for i in range(100, 181)} == {100} and {got[i] for i in range(1, 60)} == {1}


def test_term_counts_and_grams(spark):
    df = spark.createDataFrame([("bb aa bb c",), ("",)], "t string")
    a, b = df.select(tf.count_terms(tf.word_tokens(F.col("t"))).alias("r")).collect()
    assert [(x.term, x.n) for x in a.r] == [("aa", 1), ("bb", 2)] and b.r == []
    (g,) = spark.createDataFrame([("ab a",)], "t string").select(tf.char_grams(F.col("t")).alias("r")).collect()
    assert sorted(g.r) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " a", "a ", " a "])
    (w,) = spark.createDataFrame([("aa bb cc",)], "t string").select(tf.with_bigrams(tf.word_tokens(F.col("t"))).alias("r")).collect()
    assert w.r == ["aa", "bb", "cc", "aa bb", "bb cc"]


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "a  B"), (2, "c")], "id long, text string")
    assert {r.id for r in jn.drop_exact_copies(df, order="id").collect()} == {1, 2}


def test_flag_lookup_first_duplicate_wins(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, k string")
    table = spark.createDataFrame([("x", 5, False), ("x", 2, True)], "k string, o long, f boolean")
    got = {r.id: (r.f, r.matched) for r in jn.lookup_flags(df, table, "k", ["f"], "o").collect()}
    assert got == {1: (True, True), 2: (False, False)}


def test_blocks_of_mails_give_the_same_candidates_as_one_task(spark):
    """Candidates leave a cell, products do not: however the mails are dealt, every similar pair of different components is met."""
    mails = make_mails(90)
    df = spark.createDataFrame(mails, "id long, text string")
    reps = sim.collapse_equal(sim.unit_vectors(df, "id", "text", (), 2, 0.5))[1]
    index = sim.indexed_terms(reps, 0.8)
    entries = sim._by_mail(index.withColumns({"comp": F.col("id") % 40, "heavy": F.lit(False)})).persist()
    pairs = {n: {tuple(r) for r in sim._matched(entries, None, 0.8, n).collect()} for n in (1, 3, 5)}
    assert pairs[1] == pairs[3] == pairs[5]
    v = vectors(mails, 2, 0.5)
    kept = {r.id for r in reps.select("id").collect()}
    similar = {(a, b) for a in kept for b in kept if a < b and a % 40 != b % 40 and sum(w * v[b].get(k, 0) for k, w in v[a].items()) >= 0.8}
    assert similar and similar <= pairs[1] and len(pairs[1]) < len(kept) * (len(kept) - 1) / 4


def test_cells_go_a_few_columns_at_a_time_and_lose_no_candidate(spark, monkeypatch):
    """Every round reads at most about two copies of the mails a column; before, one query held a copy per block."""
    df = spark.createDataFrame(make_mails(90), "id long, text string")
    index = sim.indexed_terms(sim.unit_vectors(df, "id", "text", (), 2, 0.5), 0.8)
    entries = sim._by_mail(index.withColumns({"comp": F.col("id") % 40, "heavy": F.lit(False)})).persist()
    whole = {tuple(r) for r in sim._matched(entries, None, 0.8, 6).collect()}
    asked = []
    plain = sim._matched
    monkeypatch.setattr(sim, "ENTRIES_PER_BLOCK", 150)
    monkeypatch.setattr(sim, "_matched", lambda *a: asked.append((a[3], a[4])) or plain(*a))
    assert {tuple(r) for r in sim._crossing_candidates(entries, 0.8).collect()} == whole
    (blocks,) = {b for b, _ in asked}
    assert blocks > 4 and [j for _, c in asked for j in c] == list(range(blocks)) and all(len(c) <= sim.COLUMNS_AT_ONCE for _, c in asked)


def test_a_lineage_cut_leaves_no_shuffle_files_behind(spark):
    from mailgrain.session import CLEAN_SHUFFLES, durable
    before = spark.conf.get(CLEAN_SHUFFLES)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    blocks = lambda: set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines())
    there = blocks()
    kept = durable(df)
    assert not {b for b in blocks() - there if "shuffle_" in b} and spark.conf.get(CLEAN_SHUFFLES) == before
    assert kept.count() == 700 == df.count()


def test_postings_count_a_bounded_number_of_terms_at_a_time(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tf, "TERMS_AT_ONCE", 4)
    lists = [["a", "b", "a"], [], None, ["b"], ["c"] * 9, ["é", "a"]]
    out = list(tf._counted([pa.RecordBatch.from_pydict({"id": list(range(6)), "_tokens": pa.array(lists, pa.list_(pa.string()))})]))
    assert len(out) == 3
    found = {(r["id"], r["term"]): r["n"] for b in out for r in b.to_pylist()}
    assert found == {(i, t): l.count(t) for i, l in enumerate(lists) if l for t in l}
