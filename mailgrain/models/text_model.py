"""Linear text classifiers: word and character TF-IDF joined with bounded rule features.

Terms stay in tables and tasks (`term_index`); fits keep a few numbers per mail on the driver (`solver`).
"""

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.features import feature_names, with_features
from ..functions.policy import platt
from ..functions.text import clean_text, format_normalised_text, model_tokens_text
from ..operators import tfidf as tf
from ..operators.curves import f1_grid_curve, plateau_threshold
from ..operators.linear import explain as explain_terms
from ..operators.linear import sigmoid
from ..operators.metrics import calibration
from ..operators.splits import grouped_folds
from ..session import durable
from . import solver
from . import term_index as ti

CLEAN_STEPS = ("reply", "dates", "format")
CLASSIFIERS = ("logreg", "svm", "nb")
SMALL_VOCABULARY = 300_000
METADATA = "feature_schema int, threshold double, vocab_size int, bias double, slope double, intercept double, options string, meta string"


@dataclass(frozen=True)
class ModelOptions:
    classifier: str = "logreg"
    use_text: bool = True
    use_char: bool = True
    use_rules: bool = True
    feature_version: int = 2
    C: float = 16.0
    max_features: int | None = None  # no limit unless set
    char_ngram: tuple = (2, 5)
    stop_words: tuple = ()
    clean: tuple = ()
    max_iter: int = 200

    def __post_init__(self):
        unknown = set(self.clean) - set(CLEAN_STEPS)
        if unknown:
            raise ValueError("unknown clean step: " + ", ".join(sorted(unknown)))
        if self.classifier not in CLASSIFIERS:
            raise ValueError("unknown classifier: " + self.classifier)
        if not self.use_text and not self.use_rules:
            raise ValueError("need at least one feature group")
        if self.classifier == "nb" and self.use_rules:
            raise ValueError("naive Bayes needs non-negative features: text only")


@dataclass
class Prepared:
    """Model-independent inputs of a set of mails: `rows` (number, id, raw rule features) and the index of their term columns."""
    rows: DataFrame
    index: DataFrame
    id_column: str
    size: int


def _tokens(mails: DataFrame, options: ModelOptions, text: str) -> DataFrame:
    """Columns `_word` and `_char`: the words whose n-grams are the terms."""
    if not options.use_text:
        return mails
    clean = (format_normalised_text if "format" in options.clean else model_tokens_text)(F.col(text))
    rows = mails.withColumn("_clean", clean)
    listed = {"word": tf.word_tokens(F.col("_clean"), options.stop_words), "char": tf.blank_words(F.col("_clean"))}
    return rows.withColumns({f"_{b}": F.coalesce(listed[b], F.array().cast("array<string>")) for b in _blocks(options)}).withColumn("chars", F.length("_clean"))


def _blocks(options: ModelOptions) -> tuple:
    return tuple(b for b in ti.BLOCKS if options.use_text and (b == "word" or options.use_char))


def _cleaned(df: DataFrame, options: ModelOptions, text: str) -> DataFrame:
    steps = set(options.clean)
    return df.withColumn(text, clean_text(F.col(text), "reply" in steps, "dates" in steps)) if steps & {"reply", "dates"} else df


def prepare(df: DataFrame, options: ModelOptions, id_column: str = "doc_id", text: str = "text", versions=()) -> Prepared:
    """Count terms and compute rule features once; fits only read these.

    `versions` adds the rule features of other versions for fits that use them.
    """
    numbers = df.select(id_column).orderBy(id_column).rdd.map(lambda r: r[0]).zipWithIndex()
    numbered = durable(df.sparkSession.createDataFrame(numbers, df.select(id_column, F.lit(0).cast("long").alias("num")).schema))
    mails = _cleaned(df, options, text).select(id_column, text)
    names = []
    if options.use_rules:
        for v in dict.fromkeys([options.feature_version, *versions]):
            more = [n for n in feature_names(v) if n not in names]
            had = mails.select(id_column, text, F.struct(F.lit(None).alias("_"), *names).alias("_had"))  # versions share names
            mails = with_features(had, v, text).select(id_column, text, *[f"_had.{n}" for n in names], *more)
            names += more
    rows = durable(mails.join(numbered, id_column).select("num", id_column, *names)) if names else numbered
    tokens = _tokens(_cleaned(df, options, text).select(id_column, text).join(numbered, id_column), options, text)
    return Prepared(rows, ti.build(tokens, rows, _blocks(options), options.char_ngram, names), id_column, numbered.count())


@dataclass
class TextModel:
    options: ModelOptions
    terms: DataFrame | None = None  # (block, term, idf, mean, sd, coef); made from the fit when first asked for
    bias: float = 0.0
    slope: float | None = None
    intercept: float | None = None
    threshold: float = 0.5
    meta: dict | None = None
    fitted: dict = field(default_factory=dict)

    # ------------------------------------------------------------ fit and score
    def fit(self, prepared: Prepared, labels: DataFrame) -> "TextModel":
        """`labels`: (id, label) of the training mails; vocabulary, scaling and weights come from these only."""
        own = labels.select(prepared.id_column, F.col("label").cast("double").alias("label"), F.lit(-1).alias("fold"))
        return _fit(prepared, own, self.options, [-1], [self])[0]

    def raw_scores(self, prepared: Prepared, ids: DataFrame) -> DataFrame:
        """(id, score): probability of class 1, or the margin of the linear SVM."""
        key = prepared.id_column
        if self.fitted.get("prepared") is prepared:
            margin = prepared.rows.sparkSession.sparkContext.broadcast(self.fitted["margin"])  # one number per mail

            @F.pandas_udf("double")
            def looked_up(num: pd.Series) -> pd.Series:
                return pd.Series(margin.value[num.to_numpy()])
            found = prepared.rows.select(key, looked_up("num").alias("margin"))
        else:
            found = self._joined(ti.index_postings(prepared.index, _blocks(self.options)), prepared.rows, key)
        return self._as_score(found.join(ids.select(key), key, "left_semi"), key)

    def _as_score(self, found: DataFrame, key: str) -> DataFrame:
        margin = F.col("margin")
        return found.select(key, (margin if self.options.classifier == "svm" else sigmoid(margin)).alias("score"))

    def _calibrated(self, raw: DataFrame) -> DataFrame:
        return raw if self.slope is None else raw.withColumn("score", platt(F.col("score"), self.slope, self.intercept))

    def scores(self, prepared: Prepared, ids: DataFrame) -> DataFrame:
        return self._calibrated(self.raw_scores(prepared, ids))

    def _vocabulary(self) -> DataFrame:
        """The table of terms, made from the fit on first use."""
        if self.terms is None:
            f = self.fitted
            shared = f["prepared"].index.sparkSession.sparkContext.broadcast(f["fits"])
            self.terms = ti.term_table(f["prepared"].index, f["fits"], shared, f["k"], f["coefficients"])
            shared.destroy()
        return self.terms

    def _rules(self) -> list:
        """(name, mean, deviation, coefficient) of the rule features, in their order."""
        names = feature_names(self.options.feature_version) if self.options.use_rules else []
        found = {r.term: r for r in self._vocabulary().where("block = 'rules'").collect()} if names else {}  # one row per feature
        return [(n, found[n].mean, found[n].sd, found[n].coef) for n in names]

    def _scaled(self, name, mean, sd):
        z = (F.col(name) - F.lit(mean)) / F.lit(sd or 1.0)
        limit = lx.FEATURE_CLIP if self.options.feature_version >= 2 else float("inf")
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), z))

    def _rule_margin(self):
        return sum((self._scaled(n, mean, sd) * coef for n, mean, sd, coef in self._rules()), F.lit(self.bias))

    def _weighted(self, postings: DataFrame) -> DataFrame:
        """(num, block, term, raw, coef): sublinear tf-idf before it is scaled to length one."""
        return postings.join(self._vocabulary().where("block <> 'rules'"), ["block", "term"]).select(
            "num", "block", "term", ((1.0 + F.ln("n")) * F.col("idf")).alias("raw"), "coef")

    def _joined(self, postings: DataFrame, rows: DataFrame, key: str) -> DataFrame:
        """(id, margin) by a join of postings with the table of terms."""
        sums = self._weighted(postings).groupBy("num", "block").agg(F.sum(F.col("raw") * F.col("coef")).alias("p"), F.sum(F.col("raw") * F.col("raw")).alias("q"))
        text = sums.groupBy("num").agg(F.sum(F.col("p") / F.sqrt("q")).alias("_text"))
        return rows.join(text, "num", "left").select(key, (F.coalesce("_text", F.lit(0.0)) + self._rule_margin()).alias("margin"))

    def score_mails(self, mails: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """Scores of mails the model has never seen: one narrow stage with the terms of a small vocabulary, a join with a large one."""
        o, blocks = self.options, _blocks(self.options)
        rows = _cleaned(mails, o, text).select(id_column, text)
        names = feature_names(o.feature_version) if o.use_rules else []
        if names:
            rows = with_features(rows, o.feature_version, text).select(id_column, text, *names)
        rows = _tokens(rows, o, text)
        texts = self._vocabulary().where("block <> 'rules'")
        if texts.count() > SMALL_VOCABULARY:
            numbered = durable(rows.select(id_column, *names, *[f"_{b}" for b in blocks], F.monotonically_increasing_id().alias("num")))
            return self._calibrated(self._as_score(self._joined(ti.postings(numbered, blocks, o.char_ngram), numbered, id_column), id_column))
        known = rows.sparkSession.sparkContext.broadcast({(r.block, r.term): (r.idf, r.coef) for r in texts.toLocalIterator()})

        def run(batches):
            for batch in ti.slices(batches, blocks):
                total = np.zeros(batch.num_rows)
                for _, mail, code, n, terms in ti.counts_of(batch, blocks, o.char_ngram, numbered=False):
                    pairs = np.array([known.value.get((_, t), (0.0, 0.0)) for t in terms]).reshape(-1, 2)
                    raw = (1.0 + np.log(n)) * pairs[code, 0]
                    square = np.bincount(mail, weights=raw * raw, minlength=len(total))
                    part = np.bincount(mail, weights=raw * pairs[code, 1], minlength=len(total))
                    total += np.divide(part, np.sqrt(square), out=np.zeros_like(part), where=square > 0)
                yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(total + batch.column("_rules").to_numpy())], [id_column, "margin"])

        kind = dict(rows.dtypes)[id_column]
        found = rows.select(id_column, *[f"_{b}" for b in blocks], self._rule_margin().cast("double").alias("_rules")).mapInArrow(run, f"`{id_column}` {kind}, margin double")
        return self._calibrated(self._as_score(found, id_column))

    # ------------------------------------------------------------ what a model says
    def coefficients(self, spark: SparkSession | None = None) -> DataFrame:
        """(term, coef): the vocabulary and the rule features with their weights."""
        return self._vocabulary().select(F.concat_ws("__", "block", "term").alias("term"), "coef")

    def weights_table(self, prepared: Prepared) -> DataFrame:
        """(id, term, w) of every mail: the values behind the vectors; rule features only where the raw value is not 0."""
        key = prepared.id_column
        raw = self._weighted(ti.index_postings(prepared.index, _blocks(self.options)))
        norms = raw.groupBy("num", "block").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        text = raw.join(norms, ["num", "block"]).select("num", F.concat_ws("__", "block", "term").alias("term"), (F.col("raw") / F.col("norm")).alias("w"))
        out = text.join(prepared.rows.select("num", key), "num").select(key, "term", "w")
        rules = [F.when(F.col(n) != 0, F.struct(F.lit(f"rules__{n}").alias("term"), self._scaled(n, mean, sd).alias("w"))) for n, mean, sd, _ in self._rules()]
        if rules:
            out = out.unionByName(prepared.rows.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("e")).select(key, "e.term", "e.w"))
        return out

    def explain(self, prepared: Prepared, k: int = 5) -> DataFrame:
        return explain_terms(self.weights_table(prepared), self.coefficients(), prepared.id_column, k)

    # ------------------------------------------------------------ persistence
    def save(self, path: str) -> None:
        """The table of terms and settings below one folder."""
        if self.options.classifier != "logreg":
            raise ValueError("only the production classifier is saved")
        spark = SparkSession.getActiveSession()
        self._vocabulary().write.mode("overwrite").parquet(f"{path}/terms")
        row = {"feature_schema": lx.FEATURE_SCHEMA, "threshold": float(self.threshold), "vocab_size": self._vocabulary().where("block <> 'rules'").count(), "bias": self.bias,
               "slope": self.slope, "intercept": self.intercept, "options": json.dumps(asdict(self.options)), "meta": json.dumps(self.meta or {})}
        spark.createDataFrame([row], METADATA).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextModel":
        row = spark.read.parquet(f"{path}/metadata").first()
        if row.feature_schema != lx.FEATURE_SCHEMA:
            raise ValueError(f"model {path} was saved with feature schema {row.feature_schema}, this code uses {lx.FEATURE_SCHEMA}: train it again")
        stored = json.loads(row.options)
        options = ModelOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()})
        return cls(options, spark.read.parquet(f"{path}/terms"), row.bias, row.slope, row.intercept, row.threshold, json.loads(row.meta))


def _combined(a, smoothing=None):
    """Coefficients of a fit whose weights are the combination `a` of its mails."""
    def coefficients(own, record, k, idf):
        if record.block == "rules":
            return np.array([idf @ a[record.rows]])  # `idf` holds the scaled values
        return record.sums(record.frequencies() * (a * own.scale[record.block][k])[record.rows]) * idf
    return coefficients


def _complement(label, totals, smoothing=0.3):
    """Complement naive Bayes: log share of the other class; `totals` per fit as in `term_sums`."""
    def coefficients(own, record, k, idf):
        n, s1, s0 = totals[k]
        of = lambda c: ti.class_sums(own, record, k, idf, label, c)
        return np.log((of(1) + smoothing) / (s1 + smoothing * n)) - np.log((of(0) + smoothing) / (s0 + smoothing * n))
    return coefficients


class _Room:
    """Bytes that the solvers' vectors may take on the driver, over all fits that run side by side; a fit that needs more goes alone."""

    def __init__(self, size: int):
        self.size, self.used, self.changed = size, 0, threading.Condition()

    @contextmanager
    def taken(self, size: int):
        with self.changed:
            self.changed.wait_for(lambda: not self.used or self.used + size <= self.size)
            self.used += size
        try:
            yield
        finally:
            with self.changed:
                self.used -= size
                self.changed.notify_all()


SOLVER_VECTORS = 40  # of a number a mail: six pairs of steps and gradients (four each), and those of a round
_ROOM = _Room(192 << 20)


def _fit(prepared: Prepared, labels: DataFrame, options: ModelOptions, folds: list, models: list | None = None) -> list:
    """One model per entry of `folds`, fitted together: it learns from the labelled rows of all other folds (-1: of all).

    A pass over the index serves as many fits as have room on the driver, which holds a few numbers per mail and fit, and no terms.
    """
    key, n = prepared.id_column, prepared.size
    given = prepared.rows.select(key, "num").join(labels, key).select("num", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold")).toArrow()  # three numbers per mail
    label, fold, there = np.full(n, -1.0), np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=bool)
    num = given.column("num").to_numpy()
    label[num], fold[num], there[num] = given.column("label").to_numpy(), given.column("fold").to_numpy(), True
    train = np.stack([there & ((fold != k) | (k < 0)) for k in folds])
    names = tuple(feature_names(options.feature_version)) if options.use_rules else ()
    fits = ti.Fits(names, _blocks(options), options.char_ngram, options.feature_version, train, {}, {})
    if options.max_features is not None:
        fits.cuts = ti.vocabulary_cuts(prepared.index, fits, options.max_features)
    fits.scale = ti.fit_scales(prepared.index, fits)
    shared = prepared.index.sparkSession.sparkContext.broadcast(fits)
    biases = [0.0] * len(folds)
    if options.classifier == "nb":
        coefficients = [_complement(label, ti.term_sums(prepared.index, fits, shared, label))] * len(folds)
        margin = ti.margins(prepared.index, fits, shared, coefficients[0])
    else:
        def problem(k):
            y, size = label[train[k]], int(train[k].sum())
            per_class = {c: int((y == c).sum()) or size for c in (0, 1)}  # two classes
            share = np.where(y == 1, 1 / (2.0 * per_class[1]), 1 / (2.0 * per_class[0]))
            reg = 1.0 / ((options.C if options.classifier == "logreg" else 0.5) * size)
            return solver.solve(y, share / share.sum(), reg, options.classifier, options.max_iter)

        def spread(values, k):
            out = np.zeros(n)
            out[train[k]] = values
            return out

        each = 8 * n * SOLVER_VECTORS
        together = max(1, _ROOM.size // max(each, 1))
        weights, margin = [], np.zeros((len(folds), n))
        for at in range(0, len(folds), together):
            ks = list(range(at, min(at + together, len(folds))))

            def product(vectors, which):
                which = [ks[i] for i in which]
                found = ti.gram_products(prepared.index, fits, shared, [spread(v, k) for v, k in zip(vectors, which)], which)
                return [row[train[k]] for row, k in zip(found, which)]

            with _ROOM.taken(each * len(ks)):
                solved = solver.solve_together([problem(k) for k in ks], product)
            weights += [spread(a, k) for k, (a, _) in zip(ks, solved)]
            biases[at:at + len(ks)] = [float(b) for _, b in solved]
            margin[ks] = ti.gram_products(prepared.index, fits, shared, weights[at:], ks)
        coefficients = [_combined(a) for a in weights]
    shared.destroy()
    ti.release(fits)
    out = models or [TextModel(options) for _ in folds]
    for k, model in enumerate(out):
        rows = int(train[k].sum())
        model.bias, model.terms = biases[k], None
        model.fitted = {"prepared": prepared, "fits": fits, "k": k, "coefficients": coefficients[k], "margin": margin[k] + biases[k]}
        model.meta = {"phishing_share_in_training": round(float((label[train[k]] == 1).sum()) / max(rows, 1), 4), "rows": rows}
    return out


def side_by_side(jobs, at_once: int = 5) -> list:
    """Results of independent jobs, submitted together so that Spark fills its slots from all of them."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda job: job(), jobs))


def oof_scores(prepared: Prepared, folded: DataFrame, options: ModelOptions, folds: int) -> DataFrame:
    """(id, label, fold, score): every mail scored by a model that has seen neither it nor its group.

    `folded` has (id, label, fold). The folds are fitted together.
    """
    return _judged_folds(prepared, folded, _fit(prepared, folded, options, list(range(folds))))


def _judged_folds(prepared: Prepared, folded: DataFrame, models: list) -> DataFrame:
    key = prepared.id_column

    def one_fold(k):
        test = folded.where(F.col("fold") == k)
        return models[k].raw_scores(prepared, test).join(test.select(key, "label", "fold"), key)

    return durable(reduce(DataFrame.unionByName, [one_fold(k) for k in range(len(models))]))


def fit_platt(scored: DataFrame, score: str = "score", label: str = "label") -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic fit on the logit of out-of-fold scores."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(
        scored.select(F.ln(p / (1 - p)).alias("z"), F.col(label).cast("double").alias("label")))
    rows = rows.select("features", "label").persist()
    fitted = LogisticRegression(regParam=1e-9, standardization=False, maxIter=100, tol=1e-9).fit(rows)
    rows.unpersist()
    return float(fitted.coefficients[0]), float(fitted.intercept)


def fit_with_cv_threshold(df: DataFrame, options: ModelOptions, group: str, folds: int = 5, seed: int = 42,
                          id_column: str = "doc_id", rule: str = "plateau", calibrate: bool = True):
    """(model, out-of-fold scores): grouped folds, calibration, threshold on calibrated scores, refit on all rows."""
    prepared = prepare(df, options, id_column)
    folded = durable(grouped_folds(df.select(id_column, "label", group), group, "label", folds, seed).select(id_column, "label", "fold"))
    *parts, model = _fit(prepared, folded, options, [*range(folds), -1])  # the last one learns from all rows
    oof = _judged_folds(prepared, folded, parts)
    slope = intercept = None
    scored = oof
    if calibrate:
        slope, intercept = fit_platt(oof)
        scored = oof.withColumn("score", platt(F.col("score"), slope, intercept))
    scored = durable(scored)
    chosen = plateau_threshold(f1_grid_curve(scored, "score"), rule=rule).first()
    model.slope, model.intercept, model.threshold = slope, intercept, chosen.threshold
    quality = calibration(scored, "score").first()
    model.meta.update(folds=folds, rule=rule, peak=chosen.peak, peak_f1=chosen.peak_f1, plateau=[chosen.plateau_lo, chosen.plateau_hi],
                      brier=quality.brier, ece=quality.ece)
    return model, prepared, scored
