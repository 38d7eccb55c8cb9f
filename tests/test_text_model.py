"""Text models against dense vectors of the same definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.models import solver
from mailgrain.models import text_model as tm
from mailgrain.models import term_index as ti

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def mails(spark):
    rng = random.Random(3)
    data = []
    for i in range(70):
        low = 0 if i % 2 else 20
        data.append((i, i % 2, i % 5, " ".join(rng.choice(WORDS[low:low + 40]) for _ in range(rng.randint(0, 25)))))
    return spark.createDataFrame(data, "doc_id long, label int, fold int, text string").persist()


def dense(texts, train):
    """Unit rows of sublinear tf-idf over words and pairs; vocabulary and idf from the rows of `train`."""
    lists = [t.split() for t in texts]
    lists = [l + [f"{a} {b}" for a, b in zip(l, l[1:])] for l in lists]
    terms = sorted({t for l in lists for t in l})
    counts = np.array([[l.count(t) for t in terms] for l in lists], dtype=float)
    df, n = (counts[train] > 0).sum(axis=0), int(train.sum())
    keep = (df >= 2) & (df <= 0.95 * n)
    x = np.where(counts[:, keep] > 0, 1 + np.log(np.maximum(counts[:, keep], 1)), 0) * (np.log((1 + n) / (1 + df[keep])) + 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def optimum(x, y, reg, steps=60):
    """Newton's method on the balanced logistic loss."""
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    z = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], reg), 0.0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.lstsq(z.T @ (z * (share * p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (share * (p - y)) + ridge * w, rcond=None)[0]
    return w


def test_folds_fitted_together_reach_the_optimum_of_each_and_keep_no_terms_on_the_driver(spark, mails):
    options = tm.ModelOptions(use_char=False, use_rules=False)
    prepared = tm.prepare(mails, options)
    scored = {r.doc_id: r.score for r in tm.oof_scores(prepared, mails, options, 5).collect()}
    rows = mails.orderBy("doc_id").collect()
    y, fold = np.array([r.label for r in rows]), np.array([r.fold for r in rows])
    assert len(scored) == len(rows)
    for k in range(5):
        x = dense([r.text for r in rows], fold != k)
        w = optimum(x[fold != k], y[fold != k], 1 / (16.0 * (fold != k).sum()))
        want = 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ w)))
        assert [scored[i] for i in np.flatnonzero(fold == k)] == pytest.approx(want[fold == k].tolist(), abs=5e-3)
    model = tm.TextModel(options).fit(prepared, mails)
    terms = model.coefficients().count()
    assert terms > len(rows)
    held = [v for v in [*vars(model).values(), *model.fitted.values()] if isinstance(v, np.ndarray)]
    assert held and all(v.size <= len(rows) for v in held)  # one number per mail; before, weights of all terms


def test_products_equal_dense_gram_matrix(spark, mails):
    options = tm.ModelOptions(use_char=False, use_rules=False)
    prepared = tm.prepare(mails, options)
    n = prepared.size
    train = np.array([[i % 3 != 0 for i in range(n)]])
    fits = ti.Fits((), ("word",), (2, 5), 2, train, {}, {})
    fits.scale = ti.fit_scales(prepared.index, fits)
    v = np.random.default_rng(1).normal(size=(1, n))
    got = ti.gram_products(prepared.index, fits, spark.sparkContext.broadcast(fits), v, [0])
    x = dense([r.text for r in mails.orderBy("doc_id").collect()], train[0])
    assert got[0] == pytest.approx(x @ (x.T @ v[0]))


def test_a_pass_reads_columns_without_spelling_out_their_terms(spark, mails):
    """Before, every pass made a Python string of every term and a logarithm for every entry."""
    index = tm.prepare(mails, tm.ModelOptions(use_rules=False)).index
    n = mails.count()
    fits = ti.Fits((), ("word", "char"), (2, 5), 2, np.array([[i % 3 != 0 for i in range(n)]]), {}, {})
    seen = 0
    for batch in index.toArrow().to_batches():
        for i in range(batch.num_rows):
            record = ti.Record(batch, i)
            idf = fits.idf(record, 0)
            assert "terms" not in vars(record)
            inside = fits.train[0][record.rows].astype(int)
            df = np.array([inside[a:a + k].sum() for a, k in zip(record.starts, record.lens)])
            low, high = ti.BLOCKS[record.block]
            m = int(fits.train[0].sum())
            keep = (df >= low) & (df <= high * m)
            assert idf == pytest.approx(np.where(keep, np.log((1 + m) / (1 + df)) + 1, 0))
            assert (record.frequencies() == 1.0 + np.log(record.counts.astype(float))).all()
            seen += len(record.terms)
    assert seen > 100


def test_fits_that_have_no_room_together_go_one_after_another(spark, mails, monkeypatch):
    """Before, the vectors of all folds, and of all models side by side, were on the driver at once, whatever the number of mails."""
    options = tm.ModelOptions(use_char=False, use_rules=False, max_iter=4)
    prepared = tm.prepare(mails, options)
    scores = lambda: {r.doc_id: r.score for r in tm.oof_scores(prepared, mails, options, 5).collect()}
    want, asked, whole = scores(), [], ti.gram_products
    monkeypatch.setattr(ti, "gram_products", lambda index, fits, shared, vectors, which: asked.append(len(which)) or whole(index, fits, shared, vectors, which))
    monkeypatch.setattr(tm, "_ROOM", tm._Room(2 * 8 * prepared.size * tm.SOLVER_VECTORS))
    assert scores() == pytest.approx(want)
    assert max(asked) == 2 and tm._ROOM.used == 0


def test_passes_leave_no_queries_in_the_driver(spark, mails):
    """Before, every pass of a fit was a query with a shuffle: the driver kept its plan and metrics, and threads waited for it."""
    prepared = tm.prepare(mails, tm.ModelOptions())
    n = prepared.size
    fits = ti.Fits(tuple(c for c in prepared.rows.columns if c not in ("num", "doc_id")), ("word", "char"), (2, 5), 2, np.ones((1, n), dtype=bool), {}, {})
    fits.scale = ti.fit_scales(prepared.index, fits)
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    shared = spark.sparkContext.broadcast(fits)
    bus.waitUntilEmpty()
    before = store.executionsCount()
    first, again = (ti.gram_products(prepared.index, fits, shared, np.ones((1, n)), [0]) for _ in range(2))
    bus.waitUntilEmpty()
    assert store.executionsCount() == before
    assert first == pytest.approx(again) and np.count_nonzero(first) == n
    assert "terms" not in ti._passes(prepared.index, fits).columns


def test_rule_features_of_versions_that_share_names_are_made_side_by_side(spark, mails):
    """Before, version 1 beside a later one failed: both have a `keyword_score`."""
    from mailgrain.functions.features import feature_names, with_features
    options = tm.ModelOptions(use_text=False, feature_version=4)
    prepared = tm.prepare(mails, options, versions=(1,))
    for version in (4, 1):
        names = feature_names(version)
        want = with_features(mails.select("doc_id", "text"), version).select("doc_id", *names).orderBy("doc_id").collect()
        assert prepared.rows.select("doc_id", *names).orderBy("doc_id").collect() == want
    model = tm.TextModel(tm.ModelOptions(use_text=False, feature_version=1, max_iter=3)).fit(prepared, mails)
    assert {r.term for r in model.coefficients().collect()} == {f"rules__{n}" for n in feature_names(1)}


def test_columns_keep_near_mails_in_a_byte_each(spark):
    """Before, every entry took four bytes for its mail, in every pass."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    mails_of = [np.sort(rng.choice(300_000, k, replace=False)).astype(np.int32) for k in (3, 2_000, 250_000, 1, 40_000)] + [np.array([0, 299_999], dtype=np.int32)]
    terms, halves = [f"t{i}" for i in range(len(mails_of))], ([], [])
    for rows in mails_of:
        for half, part in zip(halves, (rows[1::2], rows[::2])):
            half.append(part)
    batches = [ti._batch([("char", 4, terms, np.array([len(x) for x in half], dtype=np.int32).tobytes(), np.concatenate(half).tobytes(), ti._stored((np.concatenate(half) % 7 + 1).astype(np.uint8)))]) for half in halves]
    made = ti._merged(pa.Table.from_batches(batches)).to_batches()[0]
    found, stored = {}, 0
    for i in range(made.num_rows):
        record = ti.Record(made, i)
        again = ti.Record.of((record.block, record.bucket, None, *(bytes(made.column(c)[i].as_buffer()) for c in ("sizes", "lens", "rows", "counts"))))
        assert (again.rows == record.rows).all() and (again.counts == record.counts).all()
        stored += len(made.column("rows")[i].as_buffer())
        found |= {t: (record.rows[a:a + k], record.counts[a:a + k]) for t, a, k in zip(record.terms, record.starts, record.lens)}
    assert set(found) == {t for t, rows in zip(terms, mails_of) if len(rows) >= ti.BLOCKS["char"][0]}
    for t, (rows, counts) in found.items():
        want = mails_of[terms.index(t)]
        assert (rows == want).all() and (counts == want % 7 + 1).all()
    assert stored < 2 * sum(len(rows) for rows, _ in found.values())


def test_character_terms_by_numbers_equal_those_by_strings():
    """Before, every gram of every word was a Python string."""
    words = ["ab", "a", "é日本", "\U0001f600x", "zzzzzzzz", "banana"]
    for low, high in ((2, 5), (3, 5), (4, 6), (1, 2), (5, 5)):
        (code, each, terms), (other, sizes, known) = ti._spelled(words, low, high), ti._spelled_by_strings(words, low, high)
        assert (each == sizes).all() and len(set(terms)) == len(terms)
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends):
            assert sorted(terms[c] for c in code[a:b]) == sorted(known[c] for c in other[a:b])
    assert ti._spelled(["".join(map(chr, range(0x4e00, 0x9000)))], 2, 5) is None


def test_weights_of_terms_are_computed_once_a_fit(spark, mails):
    """Before, every pass counted the mails of every term again."""
    prepared = tm.prepare(mails, tm.ModelOptions())
    fits = ti.Fits(tuple(c for c in prepared.rows.columns if c not in ("num", "doc_id")), ("word", "char"), (2, 5), 2, np.ones((2, prepared.size), dtype=bool), {}, {})
    fits.scale = ti.fit_scales(prepared.index, fits)
    shared, v = spark.sparkContext.broadcast(fits), np.random.default_rng(2).normal(size=(2, prepared.size))
    first = ti.gram_products(prepared.index, fits, shared, v, [0, 1])
    kept = fits.weights
    again = ti.gram_products(prepared.index, fits, shared, v[1:], [1])
    assert again[0] == pytest.approx(first[1]) and fits.weights is kept and kept.is_cached
    ti.release(fits)
    assert fits.weights is None and not kept.is_cached
    assert ti.gram_products(prepared.index, fits, shared, v, [0, 1]) == pytest.approx(first)


def test_character_terms_equal_the_column_function(spark, rows):
    from mailgrain.operators import tfidf as tf
    df = rows(["ab abc ab", "a", "", "é日本 x\ty  zzzzzzzz"])
    options = tm.ModelOptions(use_rules=False)
    tokens = tm._tokens(df.withColumnRenamed("id", "num"), options, "text")
    got = {(r.num, r.term): r.n for r in ti.postings(tokens, ("char",), (2, 5)).collect()}
    want = {(r.id, r.term): r.n for r in tf.postings(df, "id", tf.char_grams(F.col("text"), 2, 5)).collect()}
    assert got == want


def test_a_capped_vocabulary_keeps_the_largest_totals(spark, mails):
    options = tm.ModelOptions(use_char=False, use_rules=False, max_features=15, max_iter=5)
    prepared = tm.prepare(mails, options)
    whole = tm.TextModel(tm.ModelOptions(use_char=False, use_rules=False, max_iter=1)).fit(prepared, mails)
    known = {r.term for r in whole.coefficients().collect()}
    totals = {}
    for r in mails.collect():
        words = r.text.split()
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            totals[f"word__{t}"] = totals.get(f"word__{t}", 0) + 1
    want = sorted(known, key=lambda t: (-totals[t], t))[:15]
    assert {r.term for r in tm.TextModel(options).fit(prepared, mails).coefficients().collect()} == set(want)


@pytest.mark.parametrize("loss", ["logreg", "svm"])
def test_solver_lowers_the_objective_below_any_small_change(loss):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 12))
    y = (x[:, 0] + 0.5 * rng.normal(size=80) > 0).astype(float)
    share, reg = np.full(80, 1 / 80), 0.01
    run = solver.solve(y, share, reg, loss, 400, 1e-8)
    r = next(run)
    try:
        while True:
            r = run.send(x @ (x.T @ r))
    except StopIteration as end:
        a, b = end.value
    value = lambda w, b: solver.LOSSES[loss](x @ w + b, 2 * y - 1, share)[0] + reg / 2 * w @ w
    w = x.T @ a
    assert all(value(w + 0.05 * rng.normal(size=12), b + 0.05 * rng.normal()) > value(w, b) - 1e-4 for _ in range(200))
