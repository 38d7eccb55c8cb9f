"""LSH forest, max-sketch search and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import components as cc
from mailgrain.llm import conversation_repair as cr
from mailgrain.llm import lexical_search as ls
from mailgrain.llm import lsh_forest as lf

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- near-duplicates
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        first = min(ids) if ids else None
        out.append((d, len(sets[i]), first if sets[i] else d, d == (first if sets[i] else d)))
    return sorted(out, key=repr)


def family_rows(seed):
    """One family of near copies with few to many edits, texts that share a passage, exact copies, and others."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    for i in range(140, 200):
        rows.append((i, " ".join(passage + [word() for _ in range(rng.randrange(4, 12))])))
    for i in range(200, 240):
        rows.append((i, " ".join(word() for _ in range(rng.randrange(1, 40)))))
    rows += [(240, rows[3][1]), (241, rows[3][1].upper()), (242, "one"), (243, "One"), (244, "a b c"), (245, "a b c d"), (246, ""), (247, None), (248, " \t"),
             (None, rows[3][1]), (None, None), (None, "other null text of its own"), (5, rows[201][1]), (5, rows[5][1]), (249, "Ä b c d e"), (250, "ä b c d e")]
    return rows


@pytest.mark.parametrize("seed,window,most", [(1, 2, 1_000_000), (2, 8, 1_000_000), (1, 2, 0)])
def test_forest_equals_brute_force(spark, monkeypatch, seed, window, most):
    monkeypatch.setattr(lf, "MOST_KEYS", most)
    rows = family_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("component", F.lit(2))
    got = sorted((tuple(r) for r in lf.near_duplicates(df, window=window).collect()), key=repr)
    assert got == brute_components(rows)


def test_forest_of_an_empty_table(spark):
    assert lf.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingle_sets_of_long_texts():
    text = " ".join(f"t{i % 7000}" for i in range(60_000))
    s = lf.shingle_set(text.encode())
    assert len(s) == 7000 and (np.diff(s.astype(object)) > 0).all()
    assert lf.signature(s).shape == (64,)


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_components_of_chain_and_star(spark, small):
    edges = [(i, i + 1) for i in range(100, 150)] + [(1, i) for i in range(2, 40)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert {got[i] for i in range(100, 151)} == {100} and {got[i] for i in range(1, 40)} == {1}


# ---------------------------------------------------------------- search
def find_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    found = [(d, find_terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, t in found:
            tf, m = Counter(t), 25 + (75 * len(t) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in find_terms(text) if tf[x])
            if s > 0:
                scored.append((-s, d is None, d, -s))
        out += [(item, i + 1, d, -s) for i, (s, _, d, _) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("candidates,block", [((64, 1024), 1000), ((2, 5), 1000), ((1, 3), 2)])
def test_search_equals_brute_force(spark, monkeypatch, candidates, block):
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "gämma", "中文", "x1", *[f"v{rng.randrange(60)}" for _ in range(6)]])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(30)]  # equal texts fill ranks by id
    docs += [(None, docs[7][1]), (7, docs[7][1]), (300, None), (301, " .,- "), (302, "alpha " * 5000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(8)] + [(8, None), (9, "nowhere"), (10, docs[7][1]), (None, "alpha")]
    monkeypatch.setattr(ls, "CANDIDATES", candidates)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("sketch", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in ls.search(df, q, block=block).collect()), key=repr)
    assert got == brute_search(docs, items)


def test_bounds_hold_for_every_sketch(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"v{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 400)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    queries = {0: [b"v1", b"v2", b"v2", b"v77"], 1: [b"v3"]}
    total = sum(len(find_terms(t)) for _, t in docs)
    block = ls.Block(queries, {b"v1": 50, b"v2": 40, b"v77": 3, b"v3": 20}, 60, total)
    by_key = {r.key: r for r in ls.index(df).collect()}
    keys = {r.text: r.k for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    for _, text in docs:
        r, exact = by_key[keys[text]], block.scores(text.encode())
        bound = block.bounds(np.frombuffer(r.sketch, np.uint8).reshape(1, -1), np.array([ls._m(r.n, 60, total)]))[0]
        assert all(bound[q] >= exact.get(q, 0) for q in queries)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(docs, items).collect() == []
    assert ls.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []


# ---------------------------------------------------------------- conversations
def brute_repair(rows):
    """The contract by trying every edit."""
    kept = []
    text_of = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        hit = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if hit:
            row = (turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            kept += [row] * (2 if hit == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marks = set(), []
    for _, role, text in kept:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        marks.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        shape = "".join(r[0] for r in out)
        if not re.fullmatch("(s?(ua)*u?)?", shape):
            return
        if i == len(kept) and re.fullmatch("(s?(ua)+)?", shape):
            best = min([best or (cost, audit, out), (cost, audit, out)], key=lambda b: b[:2])
        if audit[-2:] != "II":
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", out + [f"{role}:"])
        if i < len(kept):
            _, role, text = kept[i]
            go(i + 1, cost + 2, audit + "D", out)
            if marks[i] in ("", "truncated"):
                more = 5 if marks[i] else 0
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + more, audit + "K", out + [f"{role}:{text}"])
                for r in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", out + [f"{r}:{text}"])

    best = (5 * len(kept) + 1, "~", [])
    go(0, 0, "", [])
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    return (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def conversation_rows(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(conversations), None]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, None if rng.random() < 0.1 else turn + (rng.random() < 0.2), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         rng.choice(["Yes.", "No way", "ok!", "  \n", "", None, "über?", "same.", "tail. \n"])))
    return rows


@pytest.mark.parametrize("seed,block_rows", [(1, 1 << 20), (2, 2), (3, 1)])
def test_repairs_equal_brute_force(spark, seed, block_rows):
    rows = conversation_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("fault", F.lit(9))
    made = cr.repaired(df, block_rows=block_rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in made.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == {c: brute_repair(g) for c, g in groups.items()}


def test_a_giant_conversation_spills_blocks(spark):
    n = 3000
    df = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    a, b = (cr.repaired(df, block_rows=k).first() for k in (100, 1 << 20))
    assert a == b and len(a.audit) > 0.9 * n


def test_repair_of_an_empty_table(spark):
    assert cr.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
