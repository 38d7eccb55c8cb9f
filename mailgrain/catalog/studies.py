"""Queries of the composite analyses, with the production model: words, characters, rules and near-copy groups."""

from dataclasses import replace
from functools import partial
from itertools import product

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import headers as hd
from ..functions import html as ht
from ..functions import text as tx
from ..functions.features import with_url_features
from ..functions.privacy import mask_personal
from ..functions.rules import with_rules
from ..functions.stats import mcnemar_p
from ..models import text_model as tm
from ..operators import curves as cv
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import signals as sg
from ..operators import similarity as sim
from ..operators import splits as sp
from ..plans import corpus as cp
from ..plans import studies as sd
from ..session import durable
from .evaluation import MCNEMAR_SQL, T_A, T_B, TRAIN_SHARE, scored_sql
from .registry import query
from .rules import URLS_V4
from .rules_sql import rules_sql
from .signals import SIGNALS, SUSPICIOUS, VERIFIED
from .views import with_views


_RATED = [*hd.SIGNALS, "verified"]
HEADER_STUDY_SQL = with_views(["mail_headers"], """SELECT signal, phishing_rate, other_rate, round(ratio, 2) AS ratio, phishing_rate >= 0.05 AND ratio >= 3 AS promising FROM (
 SELECT p.signal, p.rate AS phishing_rate, o.rate AS other_rate, p.rate / greatest(o.rate, 1.0 / greatest(o.n, 1)) AS ratio FROM rates p JOIN rates o ON o.signal = p.signal AND o.grp = 'other' WHERE p.grp = 'phishing') q""", SIGNALS + [
    ("grouped", f"SELECT h.*, {VERIFIED} AS verified, CASE WHEN l.toxic = 1 THEN 'phishing' ELSE 'other' END AS grp FROM header_signals h JOIN labels l USING (doc_id)"),
    ("rates", " UNION ALL ".join(f"SELECT grp, '{s}' AS signal, count({s}) AS n, round(count(*) FILTER ({s}) / count({s}), 4) AS rate FROM grouped GROUP BY grp" for s in _RATED))])
SENDER_STAGE_SQL = with_views(["mail", "mail_headers", "scored"], f"""SELECT label, t_v, count(*) AS n, count(*) FILTER (v AND NOT s) AS relieved, count(*) FILTER (score_a >= {T_A}) AS base,
 count(*) FILTER (score_a >= CASE WHEN v AND NOT s THEN greatest({T_A}, t_v) ELSE {T_A} END) AS stage FROM (
 SELECT c.label, c.score_a, f.v, f.s FROM scored c JOIN (SELECT doc_id, {VERIFIED} AS v, {SUSPICIOUS} AS s FROM header_signals JOIN url_features USING (doc_id)) f USING (doc_id)) q,
 (VALUES (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE), (1.01::DOUBLE)) b(t_v) GROUP BY label, t_v""", SIGNALS + URLS_V4)
SECOND_MODEL_SQL = scored_sql(f"""SELECT label, only_a_correct, only_b_correct, round({MCNEMAR_SQL}, 4) AS p_value FROM (
 SELECT label, count(*) FILTER (a AND NOT b) AS only_a_correct, count(*) FILTER (NOT a AND b) AS only_b_correct FROM (
  SELECT label, (score_b >= {T_B}) = (label = 1) AS a, (score_a >= {T_A}) = (label = 1) AS b FROM scored) q GROUP BY label) d""")


def _labelled(t):
    return t.mail.where("label IS NOT NULL").select("doc_id", "source", "lang", "label", "text")


MAIN = tm.ModelOptions(feature_version=3)
VARIANTS = {
    "rules LR": replace(MAIN, use_text=False), "text NB": replace(MAIN, classifier="nb", use_rules=False),
    "text SVM": replace(MAIN, classifier="svm", use_rules=False), "text LR": replace(MAIN, use_rules=False),
    "text and rules SVM": replace(MAIN, classifier="svm"), "text and rules LR": MAIN}


def _grouped(t):
    mails = durable(_labelled(t))
    return durable(mails.join(sim.near_copy_groups(mails, "doc_id"), "doc_id"))


def _inputs(t, version=4, others=()):
    """Labelled mails with their near-copy group, and the model inputs; a version above 1 holds the columns of those from 2 on."""
    mails = _grouped(t)
    return mails, tm.prepare(mails, replace(MAIN, feature_version=version), versions=others)


def _rule_scores(mails):
    return with_rules(mails.select("doc_id", "text")).select("doc_id", F.col("score").alias("rule_score"))


@query("q1_corpus_preparation", None)
def corpus_preparation(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "source", "text", F.coalesce("toxic", F.lit(0)).alias("label"))
    n = F.pmod(F.xxhash64("source"), F.lit(10))  # whole sources: four tenths, then two tenths for each other corpus
    split = lambda low, high: rows.where((n >= low) & (n < high))
    return cp.sizes(cp.prepare_corpora(split(0, 4), split(4, 6), split(6, 8), split(8, 10)))


@query("q2_model_comparison", None)
def model_comparison(t):
    mails, prepared = _inputs(t, 3)
    return sd.compare_models(mails.drop("text"), prepared, VARIANTS, "grp", durable(_rule_scores(mails)), "text and rules LR")


@query("q3_fold_report", None)
def fold_report(t):
    mails, prepared = _inputs(t, 3)
    return sd.fold_report(mails.drop("text"), prepared, MAIN, "grp")


@query("q4_cross_corpus", None)
def cross_corpus(t):
    """Every variant trained on English mail and tested on all other mail, and the other way round."""
    mails, prepared = _inputs(t, 3)
    en, other = mails.where("lang = 'en'"), mails.where("lang <> 'en'")
    ways = {"en": (en, other), "other": (other, en)}
    jobs = [partial(sd.transfer, prepared, *ways[way], VARIANTS[name], f"{way}: {name}") for way, name in product(ways, VARIANTS)]
    return sd.stack(tm.side_by_side(jobs))


@query("q5_domain_adaptation", None)
def domain_adaptation(t):
    mails, prepared = _inputs(t, 3)
    rows = mails.select("doc_id", "source", "label", "grp", "lang")
    return sd.adaptation(prepared, rows.where("lang <> 'en'").drop("lang"), rows.where("lang = 'en'").drop("lang"), MAIN, "grp")


@query("q6_second_language", None)
def second_language(t):
    """Row-level stratified split of the non-English mails, with the share of mails the rules see at all."""
    mails = durable(_labelled(t).where("lang <> 'en'"))
    prepared = tm.prepare(mails, MAIN)
    parts = durable(sp.stratified_split(mails.drop("text"), "doc_id", "label"))
    share = jn.one_row(with_rules(mails.select("text")).agg(F.avg((F.col("score") > 0).cast("double")).alias("s")))["s"]

    def judged(name):
        scored = sd.fit_score(prepared, parts.where("part = 0"), parts.where("part > 0"), VARIANTS[name], ("label", "source", "part"))
        return sd.report(scored.where("part = 2"), sd.best_threshold(scored.where("part = 1")), model=name)

    return sd.stack(tm.side_by_side([partial(judged, name) for name in VARIANTS])).withColumn("rules_fire_on", F.round(share, 4))


@query("q7_false_alarms", None)
def false_alarms(t):
    """Rule features 1 to 3, and the training mails without and with one language, at two operating points."""
    mails, prepared = _inputs(t, 4, (1,))
    parts = durable(sp.group_split(mails.drop("text"), "grp"))
    train, val, test = (parts.where(F.col("part") == i) for i in range(3))
    version = lambda v: replace(MAIN, feature_version=v)
    return sd.false_alarm_study(prepared, {"all": train, "without fr": train.where("lang <> 'fr'")}, val, test, {
        "v1": (version(1), "without fr"), "v2": (version(2), "without fr"), "v2 on all": (version(2), "all"), "v3 on all": (version(3), "all")})


@query("q8_recall_study", None)
def recall_study(t):
    """Rule features 2 and 3 with and without further training mails; the version with the best validation F1 is selected.

    `only_here` and `only_v2` count the test mails that just one of the version and the first version judges right (exact paired test).
    """
    mails, prepared = _inputs(t)
    parts = durable(sp.group_split(mails.drop("text"), "grp"))
    train, rest = parts.where("part = 0"), parts.where("part > 0")
    less = train.where("lang <> 'fr'")
    versions = {"v2": (2, less), "v3": (3, less), "v2 on all": (2, train), "v3 on all": (3, train)}

    def judged(name):
        number, rows = versions[name]
        scored = sd.fit_score(prepared, rows, rest, replace(MAIN, feature_version=number), ("label", "source", "part"))
        return scored, cv.curve_summary(cv.score_curve(scored.where("part = 1"))).first()

    found = dict(zip(versions, tm.side_by_side([partial(judged, name) for name in versions])))
    first, start = found["v2"]
    right = lambda table, at, name: table.where("part = 2").select("doc_id", ((F.col("score") >= at) == (F.col("label") == 1)).alias(name))
    rows = []
    for name, (scored, best) in found.items():
        paired = right(scored, best.best_f1_threshold, "a").join(right(first, start.best_f1_threshold, "b"), "doc_id")
        tests = paired.agg(F.count_if(F.expr("a AND NOT b")).alias("only_here"), F.count_if(F.expr("b AND NOT a")).alias("only_v2"))
        tests = tests.withColumn("p_value", F.round(mcnemar_p("only_here", "only_v2"), 4)).withColumn("model", F.lit(name))
        rows.append(sd.report(scored.where("part = 2"), best.best_f1_threshold, model=name, validation_f1=best.best_f1).join(tests, "model"))
    table = durable(sd.stack(rows))
    chosen = jn.one_row(table.agg(F.max_by("model", F.struct("validation_f1", "model")).alias("m")))["m"]
    return table.withColumn("selected", F.col("model") == chosen)


@query("q9_grid_search", None)
def grid_search(t):
    """Twelve cross-validated cells on the mails outside the test slice; the default stays unless one beats it by a standard error."""
    mails, prepared = _inputs(t, 3)
    outside = sp.group_split(mails.drop("text"), "grp").where("part < 2").drop("part")
    cells = {f"C={c:g}, {cap} terms, {low}-{high}": replace(MAIN, C=c, max_features=cap, char_ngram=(low, high))
             for c, cap, (low, high) in product((1.0, 4.0, 16.0), (50000, 200000), ((3, 5), (2, 5)))}
    return sd.keep_default_unless_better(sd.cv_variants(outside, prepared, cells, "grp", 5), "C=16, 50000 terms, 2-5")


@query("q9_near_copy_inflation", None)
def near_copy_inflation(t):
    """The same model on a random split and on a split that keeps near-copy groups together."""
    mails, prepared = _inputs(t, 3)
    rows = mails.drop("text")
    splits = {"random": durable(sp.stratified_split(rows, "doc_id", "label")), "grouped": durable(sp.group_split(rows, "grp"))}

    def judged(name):
        parts = splits[name]
        scored = sd.fit_score(prepared, parts.where("part = 0"), parts.where("part > 0"), MAIN, ("label", "source", "part"))
        return sd.report(scored.where("part = 2"), sd.best_threshold(scored.where("part = 1")), split=name)

    return sd.stack(tm.side_by_side([partial(judged, name) for name in splits]))


@query("q10_url_feature_study", None)
def url_feature_study(t):
    mails, prepared = _inputs(t)
    return sd.cv_variants(mails.drop("text"), prepared, {f"v{v}": replace(MAIN, feature_version=v) for v in (3, 4)}, "grp", 5)


def _tidy_scores(t):
    rules = with_rules(t.mail.where("label IS NOT NULL")).select("doc_id", "label", F.col("lang").alias("set_name"), F.lit("rules").alias("decider"), F.col("score").cast("double").alias("score"))
    model = t.scored.select("doc_id", "label", F.col("lang").alias("set_name"), F.lit("model").alias("decider"), F.col("score_a").alias("score"))
    return rules.unionByName(model)


HOLDOUT_SQL = f"""SELECT set_name, decider, count(*) FILTER (label = 1 AND f) AS tp, count(*) FILTER (label = 0 AND f) AS fp, count(*) FILTER (label = 0 AND NOT f) AS tn, count(*) FILTER (label = 1 AND NOT f) AS fn,
 round(count(*) FILTER (label = 1 AND f) / count(*) FILTER (label = 1), 4) AS recall, round(count(*) FILTER (label = 0 AND f) / count(*) FILTER (label = 0), 4) AS fpr FROM (
 SELECT lang AS set_name, 'rules' AS decider, label, score >= 50 AS f FROM mail_rules WHERE label IS NOT NULL UNION ALL
 SELECT d.lang, 'model', l.toxic, round(0.35 * l.toxic + 0.65 * ((l.doc_id * 7919 + 13) % 1000) / 1000.0, 6) >= {T_A} FROM labels l JOIN documents d ON d.doc_id = l.doc_id) q GROUP BY set_name, decider"""


@query("q11_holdout_report", rules_sql(HOLDOUT_SQL))
def holdout_report(t):
    """Rules and a model on every set, from one tidy score table."""
    return sd.holdout_report(_tidy_scores(t), T_A).select("set_name", "decider", "tp", "fp", "tn", "fn", "recall", "fpr")


@query("q12_lockbox_report", None)
def lockbox_report(t):
    """One run on the set that shares no near-copy group with anything else."""
    docs = durable(t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "text"))
    kept = sim.drop_cross_copies(docs.where("lang = 'fr'"), docs.where("lang <> 'fr'"), "doc_id").select("doc_id")
    return sd.holdout_report(durable(_tidy_scores(t).join(kept, "doc_id", "left_semi")), T_A)


@query("q13_threshold_stability", None)
def threshold_stability(t):
    return sd.threshold_stability(t.scored.select("doc_id", "label", "source", F.col("score_a").alias("score")), "source", (1, 2, 3, 4, 5))


@query("q14_commercial_mail", None)
def commercial_mail(t):
    """Masked, deduplicated, sender-capped inbox mail: signal rates of links and HTML by class of sender."""
    headers = t.mail_headers
    inbox = t.mail.join(headers, "doc_id").where(hd.in_inbox(F.col("header_block")))
    sender = hd.sender_domain(hd.header_value(F.col("header_block"), "From"))
    masked = inbox.select("doc_id", sender.alias("sender"), mask_personal(F.col("text"), F.col("header_block")).alias("text"))
    kept = durable(sp.sample_per_group(jn.drop_exact_copies(masked, order="doc_id"), "sender", "doc_id", lx.SENDER_CAP))
    english = tx.with_language_ratios(kept).select("doc_id", "english")
    html = ht.with_html_signals(t.html_mail).withColumnRenamed("page_id", "doc_id").select("doc_id", "form", "hidden_text", "image_heavy", "link_text_domain_mismatch", "meta_refresh")
    links = with_url_features(kept).select("doc_id", (F.col("url_free_hosting_fraction") > 0).alias("free_hosting"), (F.col("url_redirect_param") > 0).alias("redirect_param"))
    rows = links.join(english, "doc_id").join(html, "doc_id", "left").withColumn("grp", F.when(F.col("english"), "English").otherwise("not English"))
    return sg.signal_rates(rows, ["free_hosting", "redirect_param", "form", "hidden_text", "image_heavy", "link_text_domain_mismatch", "meta_refresh"], "grp")


@query("q15_training_mixes", None)
def training_mixes(t):
    """Candidate training mixes, each with its own cross-validated threshold, tested on held-out near-copy groups."""
    mails = _grouped(t)
    rows = durable(sp.grouped_folds(mails, "grp", "label", 5))
    test, rest = rows.where("fold = 0").drop("fold"), rows.where("fold <> 0").drop("fold")
    mixes = {"P0": rest, "P1": rest.where("lang <> 'fr'"), "P2": rest.where("lang <> 'fr' OR label = 0"), "P3": rest.where("lang = 'en' OR label = 1")}

    def judged(name):
        model, _, _ = tm.fit_with_cv_threshold(mixes[name], MAIN, "grp")
        scored = durable(model.score_mails(test).join(test.select("doc_id", "label"), "doc_id"))
        return sd.report(scored, model.threshold, training=name)

    return sd.stack(tm.side_by_side([partial(judged, name) for name in mixes], at_once=2))


@query("q16_tone_variants", None)
def tone_variants(t):
    """The production model, without stop words, without characters and without both, each with its own threshold."""
    mails = durable(sp.group_split(_grouped(t), "grp"))
    train, test = mails.where("part < 2").drop("part"), mails.where("part = 2").drop("part")
    english = tuple(lx.STOP_WORDS["en"])
    variants = {"production": MAIN, "M1": replace(MAIN, stop_words=english), "M2": replace(MAIN, use_char=False), "M3": replace(MAIN, stop_words=english, use_char=False)}

    def judged(name):
        model, _, _ = tm.fit_with_cv_threshold(train, variants[name], "grp")
        scored = durable(model.score_mails(test).join(test.select("doc_id", "label"), "doc_id"))
        return sd.report(scored, model.threshold, model=name)

    return sd.stack(tm.side_by_side([partial(judged, name) for name in variants], at_once=2))


@query("q17_header_study", HEADER_STUDY_SQL)
def header_study(t):
    rows = hd.with_header_signals(t.mail_headers).join(t.labels, "doc_id").withColumn("grp", F.when(F.col("toxic") == 1, "phishing").otherwise("other"))
    rates = sg.signal_rates(rows.withColumn("verified", hd.verified_sender()), [*hd.SIGNALS, "verified"], "grp")
    return sg.promising_signals(rates, "grp", "phishing", "other")


@query("q18_sender_stage", SENDER_STAGE_SQL)
def sender_stage(t):
    """Second stage for verified senders and its sensitivity to the higher bar."""
    links = with_url_features(t.mail.where("label IS NOT NULL").select("doc_id", "text")).select("doc_id", "url_free_hosting_fraction")
    flags = hd.with_header_signals(t.mail_headers).join(links, "doc_id").select(
        "doc_id", hd.verified_sender().alias("verified"), hd.suspicious_sender(F.col("url_free_hosting_fraction")).alias("suspicious"))
    rows = t.scored.join(flags, "doc_id")
    bars = jn.cross_with_values(rows, "t_v", [0.9, 0.95, 0.99, 0.999, 1.01])
    stage = F.col("score_a") >= F.when(F.col("verified") & ~F.col("suspicious"), F.greatest(F.lit(T_A), F.col("t_v"))).otherwise(T_A)
    return bars.groupBy("label", "t_v").agg(F.count("*").alias("n"), F.count_if(F.col("verified") & ~F.col("suspicious")).alias("relieved"),
                                          F.count_if(F.col("score_a") >= T_A).alias("base"), F.count_if(stage).alias("stage"))


@query("q19_generated_mail", None)
def generated_mail(t):
    rows = t.scored.join(t.mail.select("doc_id", "text"), "doc_id").select(
        F.col("lang").alias("generator"), F.col("source").alias("theme"), tx.link_class(F.col("text")).alias("links"), "score_a")
    return sd.generated_mail_test(rows, F.col("score_a") >= T_A, (199, 214))


@query("q20_decision_policy", None)
def decision_policy(t):
    return sd.decision_policy(t.scored.select("label", F.col("score_a").alias("score")), TRAIN_SHARE, T_A, [(r, p) for p in lx.PREVALENCES for r in lx.COST_RATIOS], 0.25)


@query("q21_shortcut_study", None)
def shortcut_study(t):
    """Rule risk of positive mails with each appended template, with and without reply-structure removal."""
    base = t.mail.where("label = 1").select("doc_id", "text")
    appended = tx.append_templates(base).unionByName(base.withColumn("template", F.lit("none")))
    rows = []
    for name, frame in (("as is", appended), ("cleaned", appended.withColumn("text", tx.clean_text(F.col("text"))))):
        flagged = mt.flagged_rates(with_rules(frame), F.col("score") >= lx.RULE_VERDICT_SCORE, ["template"])
        rows.append(flagged.select(F.lit(name).alias("variant"), "*"))
    return sd.stack(rows)


@query("q22_train_report", None)
def train_report(t):
    """Calibration before and after, threshold, and paired test of model against rules."""
    mails = _grouped(t)
    model, prepared, scored = tm.fit_with_cv_threshold(mails, MAIN, "grp")
    rules = with_rules(mails).select("doc_id", F.col("score").cast("double").alias("score"))
    test = sd.paired_tests(scored, rules, model.threshold, float(lx.RULE_VERDICT_SCORE), "doc_id")
    return test.withColumns({"threshold": F.lit(model.threshold), "ece": F.lit(model.meta["ece"]), "brier": F.lit(model.meta["brier"])})


@query("c5_second_model_adoption", SECOND_MODEL_SQL)
def second_model_adoption(t):
    a = t.scored.select("doc_id", "label", F.col("score_a").alias("score"))
    return sd.paired_tests(t.scored.select("doc_id", "label", F.col("score_b").alias("score")), a, T_B, T_A, "doc_id")
