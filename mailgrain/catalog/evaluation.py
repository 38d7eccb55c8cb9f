"""Queries of joins, metrics, windows, thresholds and decision policies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import policy as pol
from ..functions.rules import with_rules
from ..functions.stats import chi_square_p, fisher_p, mcnemar_p, precision_at_prevalence
from ..functions.text import content_key
from ..operators import curves as cv
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import splits as sp
from .registry import query
from .rules_sql import rules_sql
from .text import LANGUAGE
from .views import with_views

T_A, T_B = 0.5, 0.55
TRAIN_SHARE = 0.4


def _r(column, digits=6):
    return F.round(column, digits)


def scored_sql(body, extra=()):
    return with_views(["scored"], body, extra)


# ---------------------------------------------------------------- joins and set operations
KEYED = [("keyed", r"SELECT doc_id, source, lang, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_key FROM documents")]


@query("j1_exact_dedup", with_views([], "SELECT min(doc_id) AS doc_id, content_key FROM keyed GROUP BY content_key", KEYED))
def exact_dedup(t):
    """The first mail of every content key."""
    return jn.first_by_content(t.documents, order="doc_id")


@query("j2_exclude_keys", with_views([], """SELECT min(doc_id) AS doc_id, content_key FROM keyed
WHERE content_key NOT IN (SELECT content_key FROM keyed WHERE source = 'src3') GROUP BY content_key""", KEYED))
def exclude_keys(t):
    docs = t.documents.select("doc_id", "source", "text")
    held = docs.where("source = 'src3'").select(content_key(F.col("text")).alias("content_key"))
    return jn.first_by_content(docs, order="doc_id", exclude=held)


@query("j7_flag_lookup", with_views([], """SELECT k.doc_id, coalesce(f.toxic, false) AS toxic, coalesce(f.good, false) AS good, f.content_key IS NOT NULL AS matched
FROM keyed k LEFT JOIN (SELECT content_key, arg_min(l.toxic = 1, k2.doc_id) AS toxic, arg_min(l.quality = 1, k2.doc_id) AS good
 FROM keyed k2 JOIN labels l ON l.doc_id = k2.doc_id GROUP BY content_key) f ON f.content_key = k.content_key""", KEYED))
def flag_lookup(t):
    """Flags found by content key; the first duplicate wins, unmatched mails get false."""
    docs = t.documents.select("doc_id", content_key(F.col("text")).alias("content_key"))
    table = docs.join(t.labels, "doc_id").select("doc_id", "content_key", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("good"))
    return jn.lookup_flags(docs, table, "content_key", ["toxic", "good"], "doc_id").select("doc_id", "toxic", "good", "matched")


@query("j8_audit_sample", """SELECT l.quality AS audit_label, count(*) AS mails, sum(d.n_chars)::BIGINT AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.quality""")
def audit_sample(t):
    """Hand labels joined to the mails by their stable id."""
    return t.labels.select("doc_id", F.col("quality").alias("audit_label")).join(t.documents.select("doc_id", "n_chars"), "doc_id").groupBy(
        "audit_label").agg(F.count("*").alias("mails"), F.sum("n_chars").alias("chars"))


def _paired(t):
    s = t.scored
    return jn.paired_predictions(s.select("doc_id", "label", "score_a", "lang", "fold"), s.select("doc_id", "score_b"), "doc_id", "label",
                                 F.col("score_a") >= T_A, F.col("score_b") >= T_B)


@query("j9_paired_predictions", scored_sql(f"SELECT doc_id, label, score_a >= {T_A} AS pred_a, score_b >= {T_B} AS pred_b FROM scored"))
def paired_predictions(t):
    return _paired(t)


_CELLS = [{"cost_ratio": r, "prevalence": p} for p in lx.PREVALENCES for r in lx.COST_RATIOS]
_CELL_SQL = "(VALUES " + ", ".join(f"({c['cost_ratio']}::DOUBLE, {c['prevalence']}::DOUBLE)" for c in _CELLS) + ") c(cost_ratio, prevalence)"


@query("j10_crossed_costs", scored_sql(f"""SELECT lang, cost_ratio, prevalence, round(1000 * (prevalence * cost_ratio * fnr + (1 - prevalence) * fpr), 6) AS cost_per_1000
FROM (SELECT lang, count(*) FILTER (label = 1 AND score_a < {T_A}) / count(*) FILTER (label = 1) AS fnr,
 count(*) FILTER (label = 0 AND score_a >= {T_A}) / count(*) FILTER (label = 0) AS fpr FROM scored GROUP BY lang) q, {_CELL_SQL}"""))
def crossed_costs(t):
    """Sets x cost ratios x prevalences: the mails are aggregated before the parameters multiply the rows."""
    rates = mt.policy_rates(t.scored, {"t": (T_A, T_A)}, "score_a", keys=["lang"])
    crossed = jn.cross_with_structs(rates, _CELLS)
    costed = mt.policy_costs(crossed, F.col("cost_ratio"), F.col("prevalence"))
    return costed.select("lang", "cost_ratio", "prevalence", _r("cost_per_1000").alias("cost_per_1000"))


@query("j11_positives_plus_other_negatives", scored_sql("""SELECT 'B' AS set_name, label, count(*) AS mails FROM
(SELECT * FROM scored WHERE lang = 'en' AND label = 1 UNION ALL SELECT * FROM scored WHERE lang <> 'en' AND label = 0) q GROUP BY label"""))
def set_b(t):
    s = t.scored
    b = s.where("lang = 'en' AND label = 1").unionByName(s.where("lang <> 'en' AND label = 0"))
    return b.groupBy(F.lit("B").alias("set_name"), "label").agg(F.count("*").alias("mails"))


@query("j12_key_sets", with_views([], """SELECT lang, count(*) FILTER (shared) AS shared_keys, count(*) FILTER (NOT shared) AS own_keys FROM (
SELECT DISTINCT lang, content_key, content_key IN (SELECT content_key FROM keyed WHERE doc_id IN (SELECT doc_id FROM labels)) AS shared FROM keyed) q GROUP BY lang""", KEYED))
def key_sets(t):
    docs = t.documents.select("doc_id", "lang", content_key(F.col("text")).alias("content_key"))
    marked = docs.join(t.labels.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left").groupBy("lang", "content_key").agg(F.coalesce(F.bool_or("labelled"), F.lit(False)).alias("labelled"))
    # one row per key: its languages, and whether a labelled mail has it (a missing key equals none)
    keys = marked.groupBy("content_key").agg(F.collect_list(F.struct("lang")).alias("langs"), (F.bool_or("labelled") & F.col("content_key").isNotNull()).alias("shared"))
    return keys.select(F.explode_outer("langs").alias("l"), "shared").groupBy("l.lang").agg(F.count_if("shared").alias("shared_keys"), F.count_if(~F.col("shared")).alias("own_keys"))


@query("j13_keyword_dimension", rules_sql("""SELECT term, count(*) AS mails, CAST(sum(n) AS BIGINT) AS hits, CAST(8 * sum(n) AS BIGINT) AS points
FROM keyword_counts WHERE n > 0 GROUP BY term"""))
def keyword_dimension(t):
    """Fixed lists act as dimensions; totals per term."""
    # an inner explode would infer a filter that computes all counts once more per keyword, below the projections
    hits = with_rules(t.mail).select(F.explode_outer("keyword_hits").alias("term", "n")).where("term IS NOT NULL")
    return hits.groupBy("term").agg(
        F.count("*").alias("mails"), F.sum("n").alias("hits"), (F.sum("n") * lx.KEYWORD_POINTS).alias("points"))


@query("s14_all_corpora", """SELECT corpus, count(*) AS mails, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS corpus, text FROM documents
UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) q GROUP BY corpus""")
def all_corpora(t):
    parts = [t.table(n).select(F.lit(n).alias("corpus"), "text") for n in ("documents", "conversations", "benchmark")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("corpus").agg(F.count("*").alias("mails"), F.sum(F.length("text")).alias("chars"))


# ---------------------------------------------------------------- aggregations
CONFUSION = [("counts", f"""SELECT lang, count(*) FILTER (label = 1 AND score_a >= {T_A}) AS tp, count(*) FILTER (label = 0 AND score_a >= {T_A}) AS fp,
 count(*) FILTER (label = 0 AND score_a < {T_A}) AS tn, count(*) FILTER (label = 1 AND score_a < {T_A}) AS fn FROM scored GROUP BY lang""")]


def wilson_sql(k, n, name):
    centre = f"({k} / {n} + 3.8416 / (2.0 * {n})) / (1 + 3.8416 / {n})"
    half = f"1.96 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})"
    return (f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {centre} - {half}), 4) END AS {name}lo, "
            f"CASE WHEN {n} > 0 THEN round(least(1.0, {centre} + {half}), 4) END AS {name}hi")


@query("a1_confusion", scored_sql("SELECT * FROM counts", CONFUSION))
def confusion(t):
    return mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"])


@query("a2_rates", scored_sql("""SELECT lang, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
 round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS fpr FROM counts""", CONFUSION))
def rates(t):
    return mt.with_rates(mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"])).select("lang", "precision", "recall", "f1", "fpr")


CURVE = [
    ("by_score", "SELECT lang, score_a AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY ALL"),
    ("curve", """SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY lang ORDER BY score DESC) AS fp,
   sum(pos) OVER (PARTITION BY lang) AS p_all, sum(neg) OVER (PARTITION BY lang) AS n_all FROM by_score"""),
]


def _curve(t):
    return cv.score_curve(t.scored, "score_a", keys=["lang"])


@query("a3_roc_auc", scored_sql("""SELECT l.lang, a.roc_auc FROM (SELECT DISTINCT lang FROM scored) l LEFT JOIN (
 SELECT p.lang, round(avg(CASE WHEN p.score_a > n.score_a THEN 1.0 WHEN p.score_a = n.score_a THEN 0.5 ELSE 0.0 END), 6) AS roc_auc
 FROM (SELECT * FROM scored WHERE label = 1) p JOIN (SELECT * FROM scored WHERE label = 0) n ON n.lang = p.lang GROUP BY p.lang) a ON a.lang = l.lang"""))
def roc_auc(t):
    return cv.curve_summary(_curve(t), ["lang"]).select("lang", _r("roc_auc").alias("roc_auc"))


@query("a4_pr_auc", scored_sql("SELECT lang, CASE WHEN max(p_all) > 0 AND max(n_all) > 0 THEN round(sum(pos / p_all * tp / (tp + fp)), 6) END AS pr_auc FROM curve GROUP BY lang", CURVE))
def pr_auc(t):
    return cv.curve_summary(_curve(t), ["lang"]).select("lang", _r("pr_auc").alias("pr_auc"))


@query("a5_wilson", scored_sql(f"SELECT lang, {wilson_sql('tp', '(tp + fn)', 'recall_')}, {wilson_sql('fp', '(fp + tn)', 'fpr_')} FROM counts", CONFUSION))
def wilson_rates(t):
    out = mt.with_rates(mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"]))
    return out.select("lang", "recall_lo", "recall_hi", "fpr_lo", "fpr_hi")


DISCORDANT = [("discordant", f"""SELECT lang, count(*) FILTER (a AND NOT b) AS only_a_correct, count(*) FILTER (NOT a AND b) AS only_b_correct FROM (
 SELECT lang, (score_a >= {T_A}) = (label = 1) AS a, (score_b >= {T_B}) = (label = 1) AS b FROM scored) q GROUP BY lang""")]
MCNEMAR_SQL = """CASE WHEN only_a_correct + only_b_correct = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0)))
 FROM (SELECT only_a_correct + only_b_correct AS n, unnest(range(0, least(only_a_correct, only_b_correct) + 1)) AS i) z)) END"""


@query("a6_mcnemar", scored_sql(f"SELECT lang, only_a_correct, only_b_correct, round({MCNEMAR_SQL}, 4) AS p_value FROM discordant", DISCORDANT))
def mcnemar(t):
    counts = mt.mcnemar_counts(_paired(t).join(t.scored.select("doc_id", "lang"), "doc_id"), keys=["lang"])
    return counts.withColumn("p_value", _r(mcnemar_p("only_a_correct", "only_b_correct"), 4))


BINS = [("bins", "SELECT lang, CAST(least(floor(score_a * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score_a) AS mean_predicted, avg(label) AS observed, sum((score_a - label) ** 2) AS sq FROM scored GROUP BY ALL")]


@query("a7_calibration", scored_sql("SELECT lang, round(sum(sq) / sum(n), 4) AS brier, round(sum(n * abs(mean_predicted - observed)) / sum(n), 4) AS ece FROM bins GROUP BY lang", BINS))
def calibration(t):
    return mt.calibration(t.scored, "score_a", keys=["lang"])


@query("a8_reliability", scored_sql("SELECT lang, bin, n, round(mean_predicted, 6) AS mean_predicted, round(observed, 6) AS observed FROM bins", BINS))
def reliability(t):
    out = mt.reliability(t.scored, "score_a", keys=["lang"])
    return out.select("lang", "bin", "n", _r("mean_predicted").alias("mean_predicted"), _r("observed").alias("observed"))


@query("a9_source_flag_rates", rules_sql(f"""SELECT source, decider, count(*) AS n, count(*) FILTER (flagged) AS k, round(count(*) FILTER (flagged) / count(*), 4) AS rate, {wilson_sql('count(*) FILTER (flagged)', 'count(*)', '')}
FROM (SELECT m.source, 'rules' AS decider, score >= 50 AS flagged FROM mail_rules m WHERE label IS NOT NULL UNION ALL
 SELECT d.source, 'score_a', 0.35 * l.toxic + 0.65 * ((l.doc_id * 7919 + 13) % 1000) / 1000.0 >= {T_A} FROM labels l JOIN documents d ON d.doc_id = l.doc_id) q GROUP BY source, decider"""))
def source_flag_rates(t):
    rules = with_rules(t.mail.where("label IS NOT NULL")).select("source", F.lit("rules").alias("decider"), (F.col("score") >= 50).alias("flagged"))
    model = t.scored.select("source", F.lit("score_a").alias("decider"), (F.col("score_a") >= T_A).alias("flagged"))
    return mt.flagged_rates(rules.unionByName(model), F.col("flagged"), ["source", "decider"])


@query("a10_english_rollup", with_views(["scored"], f"""SELECT CASE WHEN grouping(english) = 1 THEN 'all' WHEN english THEN 'English' ELSE 'not English' END AS subset,
 count(*) AS n, count(*) FILTER (score_a >= {T_A}) AS k, round(count(*) FILTER (score_a >= {T_A}) / count(*), 4) AS rate FROM scored s JOIN english_docs e ON e.doc_id = s.doc_id GROUP BY ROLLUP (english)""", LANGUAGE))
def english_rollup(t):
    from ..functions.text import with_language_ratios
    english = with_language_ratios(t.documents.select("doc_id", "text")).select("doc_id", "english")
    rows = t.scored.join(english, "doc_id").rollup("english").agg(
        F.grouping("english").alias("_all"), F.count_if(F.col("score_a") >= T_A).alias("k"), F.count("*").alias("n"))
    subset = F.when(F.col("_all") == 1, "all").when(F.col("english"), "English").otherwise("not English")
    return mt.with_share(rows.select(subset.alias("subset"), "k", "n")).select("subset", "k", "n", "rate")


@query("a11_breakdown", scored_sql(f"""SELECT dimension, value, count(*) AS n, count(*) FILTER (f) AS k, round(count(*) FILTER (f) / count(*), 4) AS rate, {wilson_sql('count(*) FILTER (f)', 'count(*)', '')}
FROM (SELECT 'source' AS dimension, source AS value, score_a >= {T_A} AS f FROM scored UNION ALL SELECT 'lang', lang, score_a >= {T_A} FROM scored
 UNION ALL SELECT 'fold', CAST(fold AS VARCHAR), score_a >= {T_A} FROM scored) q GROUP BY dimension, value"""))
def breakdown(t):
    return mt.breakdown(t.scored, F.col("score_a") >= T_A, ["source", "lang", "fold"])


CONTINGENCY = [("cells", f"SELECT lang, score_a >= {T_A} AS f, count(*) AS n FROM scored GROUP BY ALL"),
               ("full_cells", "SELECT l.lang, f.f, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang FROM cells) l, (SELECT DISTINCT f FROM cells) f LEFT JOIN cells c ON c.lang = l.lang AND c.f = f.f"),
               ("expected", "SELECT *, sum(n) OVER (PARTITION BY lang) * sum(n) OVER (PARTITION BY f) / sum(n) OVER () AS e FROM full_cells")]


def _chi_square(t):
    return mt.chi_square(t.scored, F.col("score_a") >= T_A, "lang")


@query("a12_chi_square", scored_sql("SELECT round(sum((n - e) ** 2 / e), 6) AS statistic, count(DISTINCT lang) - 1 AS freedom FROM expected", CONTINGENCY))
def chi_square(t):
    return _chi_square(t).select(_r("statistic").alias("statistic"), "freedom")


@query("a12_chi_square_p", None)
def chi_square_with_p(t):
    return _chi_square(t).withColumn("p_value", _r(chi_square_p("statistic", "freedom")))


@query("a13_fisher", scored_sql(f"""SELECT lang, round((SELECT sum(p) FROM (SELECT exp(lgamma(r + 1.0) + lgamma(n - r + 1.0) + lgamma(c + 1.0) + lgamma(n - c + 1.0) - lgamma(n + 1.0)
   - lgamma(x + 1.0) - lgamma(r - x + 1.0) - lgamma(c - x + 1.0) - lgamma(n - r - c + x + 1.0)) AS p, exp(lgamma(r + 1.0) + lgamma(n - r + 1.0) + lgamma(c + 1.0) + lgamma(n - c + 1.0) - lgamma(n + 1.0)
   - lgamma(a + 1.0) - lgamma(r - a + 1.0) - lgamma(c - a + 1.0) - lgamma(n - r - c + a + 1.0)) AS p0
  FROM (SELECT a, a + b AS r, a + c1 AS c, a + b + c1 + d AS n, unnest(range(greatest(0, a + c1 - c1 - d), least(a + b, a + c1) + 1)) AS x) z) y WHERE p <= p0 * (1 + 1e-7)), 6) AS p_value
FROM (SELECT lang, count(*) FILTER (label = 1 AND score_a >= {T_A}) AS a, count(*) FILTER (label = 1 AND score_a < {T_A}) AS b,
 count(*) FILTER (label = 0 AND score_a >= {T_A}) AS c1, count(*) FILTER (label = 0 AND score_a < {T_A}) AS d FROM scored GROUP BY lang) q"""))
def fisher(t):
    c = mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"])
    return c.select("lang", _r(fisher_p("tp", "fn", "fp", "tn")).alias("p_value"))


@query("a14_corpus_sizes", scored_sql("""SELECT source, count(*) AS mails, CAST(sum(label) AS BIGINT) AS positive, count(DISTINCT lang) AS groups,
 CAST(sum(CASE WHEN size >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS in_groups FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS size FROM scored) q GROUP BY source"""))
def corpus_sizes(t):
    """Mails, positives, groups and members of groups of two or more (two-level aggregation)."""
    groups = t.scored.groupBy("source", "lang").agg(F.count("*").alias("size"), F.sum("label").alias("pos"))
    return groups.groupBy("source").agg(
        F.sum("size").alias("mails"), F.sum("pos").alias("positive"), F.count("*").alias("groups"),
        F.sum(F.when(F.col("size") >= 2, F.col("size")).otherwise(0)).alias("in_groups"))


@query("a15_percentiles", scored_sql("""SELECT lang, round(quantile_cont(score_a, 0.025), 6) AS p025, round(quantile_cont(score_a, 0.05), 6) AS p05,
 round(median(score_a), 6) AS p50, round(quantile_cont(score_a, 0.975), 6) AS p975 FROM scored GROUP BY lang"""))
def percentiles(t):
    found = cv.percentiles(t.scored, "score_a", {"p025": 0.025, "p05": 0.05, "p50": 0.5, "p975": 0.975}, ["lang"])
    return found.select("lang", *[_r(n).alias(n) for n in ("p025", "p05", "p50", "p975")])


FOLD_F1 = [("fold_f1", f"""SELECT fold, 2 * count(*) FILTER (label = 1 AND score_a >= {T_A}) / (count(*) FILTER (label = 1) + count(*) FILTER (score_a >= {T_A})) AS f1_a,
 2 * count(*) FILTER (label = 1 AND score_b >= {T_B}) / (count(*) FILTER (label = 1) + count(*) FILTER (score_b >= {T_B})) AS f1_b FROM scored GROUP BY fold""")]


def _fold_f1(t):
    return mt.f1_scores(t.scored, {"f1_a": F.col("score_a") >= T_A, "f1_b": F.col("score_b") >= T_B})


@query("a16_seed_summary", scored_sql("SELECT round(avg(f1_a), 6) AS mean, round(stddev_pop(f1_a), 6) AS std, round(min(f1_a), 6) AS low, round(max(f1_a), 6) AS high FROM fold_f1", FOLD_F1))
def seed_summary(t):
    return mt.spread(_fold_f1(t), "f1_a")


@query("a17_fold_differences", scored_sql("""SELECT round(avg(f1_a), 6) AS mean_a, round(stddev_samp(f1_a) / sqrt(count(*)), 6) AS se_a,
 round(avg(f1_b - f1_a), 6) AS difference, round(stddev_samp(f1_b - f1_a) / sqrt(count(*)), 6) AS se_difference FROM fold_f1""", FOLD_F1))
def fold_differences(t):
    return mt.paired_difference(_fold_f1(t), "f1_a", "f1_b")


_PREV_SQL = "(VALUES " + ", ".join(f"({p}::DOUBLE)" for p in lx.PREVALENCES) + ") v(prevalence)"


@query("a18_precision_at_prevalence", scored_sql(f"""SELECT lang, prevalence, round(tp / (tp + fn) * prevalence / (tp / (tp + fn) * prevalence + fp / (fp + tn) * (1 - prevalence)), 6) AS precision
FROM counts, {_PREV_SQL}""", CONFUSION))
def precision_by_prevalence(t):
    c = jn.cross_with_values(mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"]), "prevalence", lx.PREVALENCES)
    tpr, fpr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("fp", F.col("fp") + F.col("tn"))
    return c.select("lang", "prevalence", _r(precision_at_prevalence(tpr, fpr, F.col("prevalence"))).alias("precision"))


@query("a19_jeffreys_intervals", None)
def jeffreys(t):
    """20,000 posterior draws per set and prevalence, in blocks spread over the tasks."""
    return mt.prevalence_table(mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"]), lx.PREVALENCES)


@query("a20_pr_auc_at_prevalence", scored_sql("SELECT lang, CASE WHEN max(p_all) > 0 AND max(n_all) > 0 THEN round(sum(pos / p_all * tp / (tp + 99.0 * p_all / n_all * fp)), 6) END AS pr_auc FROM curve GROUP BY lang", CURVE))
def pr_auc_at_prevalence(t):
    return cv.curve_summary(_curve(t), ["lang"], prevalence=0.01).select("lang", _r("pr_auc").alias("pr_auc"))


@query("a21_prevalence_table", None)
def prevalence_table(t):
    table = mt.prevalence_table(mt.confusion(t.scored, F.col("score_a") >= T_A, keys=["lang"]), lx.PREVALENCES)
    curve = _curve(t)
    areas = None
    for p in lx.PREVALENCES:
        part = cv.curve_summary(curve, ["lang"], prevalence=p).select("lang", F.lit(p).alias("prevalence"), F.round("pr_auc", 4).alias("pr_auc"))
        areas = part if areas is None else areas.unionByName(part)
    return table.join(areas, ["lang", "prevalence"])


BANDS = {"single": (T_A, T_A), "narrow": (0.4, 0.6), "wide": (0.2, 0.8)}
_BAND_SQL = "(VALUES " + ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in BANDS.items()) + ") b(policy, lo, hi)"
RATES = [("rates", f"""SELECT lang, policy, lo, hi, count(*) FILTER (label = 1 AND score_a < hi AND NOT (score_a > lo)) / count(*) FILTER (label = 1) AS fnr,
 count(*) FILTER (label = 0 AND score_a >= hi) / count(*) FILTER (label = 0) AS fpr,
 count(*) FILTER (label = 1 AND score_a > lo AND score_a < hi) / count(*) FILTER (label = 1) AS review_phishing,
 count(*) FILTER (label = 0 AND score_a > lo AND score_a < hi) / count(*) FILTER (label = 0) AS review_legit FROM scored, {_BAND_SQL} GROUP BY lang, policy, lo, hi""")]


@query("a22_policy_rates", scored_sql("SELECT lang, policy, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr, round(review_phishing, 6) AS review_phishing, round(review_legit, 6) AS review_legit FROM rates", RATES))
def policy_rates(t):
    out = mt.policy_rates(t.scored, BANDS, "score_a", keys=["lang"])
    return out.select("lang", "policy", *[_r(c).alias(c) for c in ("fnr", "fpr", "review_phishing", "review_legit")])


@query("a23_expected_cost", scored_sql("""SELECT lang, policy, round(1000 * c, 6) AS cost_per_1000, 10.0 AS trivial_per_1000, round(1000 * (c - min(c) OVER (PARTITION BY lang)), 6) AS regret FROM (
 SELECT *, 0.01 * (100 * fnr + 0.25 * review_phishing) + 0.99 * (fpr + 0.25 * review_legit) AS c FROM rates) q""", RATES).replace("10.0 AS trivial", "round(1000 * least(0.01 * 100, 0.99), 6)::DOUBLE AS trivial"))
def expected_cost(t):
    out = mt.policy_costs(mt.policy_rates(t.scored, BANDS, "score_a", keys=["lang"]), 100, 0.01, 0.25)
    best = F.min("cost_per_1000").over(Window.partitionBy("lang"))  # one row per policy
    return out.select("lang", "policy", _r("cost_per_1000").alias("cost_per_1000"), _r(1000 * pol.trivial_cost(100, 0.01)).alias("trivial_per_1000"),
                      _r(F.col("cost_per_1000") - best).alias("regret"))


@query("a24_bootstrap_policies", None)
def bootstrap_policies(t):
    """Paired bootstrap intervals of cost per policy."""
    draws = mt.policy_costs(mt.bootstrap_policy_rates(t.scored, BANDS, "score_a"), 100, 0.01, 0.25)
    lo, hi = mt.percentile_interval(F.col("cost_per_1000"))
    return draws.groupBy("policy").agg(F.count("*").alias("replicates"), _r(F.avg("cost_per_1000")).alias("mean"), _r(lo).alias("lo"), _r(hi).alias("hi"))


@query("a24_bootstrap_difference", None)
def bootstrap_difference(t):
    draws = mt.policy_costs(mt.bootstrap_policy_rates(t.scored, BANDS, "score_a"), 100, 0.01, 0.25)
    wide = draws.groupBy("replicate").agg(*[F.max(F.when(F.col("policy") == p, F.col("cost_per_1000"))).alias(p) for p in BANDS])
    d = F.col("wide") - F.col("single")
    lo, hi = mt.percentile_interval(d)
    return wide.agg(_r(F.avg(d)).alias("difference"), _r(lo).alias("lo"), _r(hi).alias("hi"))


@query("a25_bootstrap_auc", None)
def bootstrap_auc(t):
    draws = mt.bootstrap_auc(t.scored, "score_a")
    lo, hi = mt.percentile_interval(F.col("auc"))
    return draws.agg(F.count("*").alias("replicates"), _r(F.avg("auc")).alias("mean"), _r(lo).alias("lo"), _r(hi).alias("hi"))


@query("a29_nonzero_rule_share", rules_sql("SELECT source, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM mail_rules GROUP BY source"))
def nonzero_share(t):
    return with_rules(t.mail).groupBy("source").agg(_r(F.avg((F.col("score") > 0).cast("double"))).alias("share"))


@query("a30_flagged_record", scored_sql(f"""SELECT source, count(*) FILTER (score_a >= {T_A}) AS k, count(*) AS n, round(count(*) FILTER (score_a >= {T_A}) / count(*), 4) AS rate,
 {wilson_sql(f'count(*) FILTER (score_a >= {T_A})', 'count(*)', '')} FROM scored WHERE label = 1 GROUP BY source"""))
def flagged_record(t):
    return mt.flagged_rates(t.scored.where("label = 1"), F.col("score_a") >= T_A, ["source"])


# ---------------------------------------------------------------- windows, splits, thresholds
@query("w1_top_errors", scored_sql(f"""SELECT lang, kind, rank, doc_id, score FROM (SELECT lang, kind, doc_id, score_a AS score,
 row_number() OVER (PARTITION BY lang, kind ORDER BY CASE WHEN kind = 'miss' THEN score_a ELSE -score_a END, doc_id) AS rank FROM (
 SELECT *, CASE WHEN label = 1 THEN 'miss' ELSE 'alarm' END AS kind FROM scored WHERE (label = 1) <> (score_a >= {T_A})) e) q WHERE rank <= 8"""))
def top_errors(t):
    """The eight lowest-scored misses and highest-scored alarms of every set (a top-k report)."""
    return mt.top_errors(t.scored, F.col("score_a") >= T_A, "score_a", "doc_id", ["lang"])


@query("w2_sender_cap", """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':42'), doc_id) AS r FROM documents) q WHERE r <= 30""")
def sender_cap(t):
    return sp.sample_per_group(t.documents.select("doc_id", "source"), "source", "doc_id", lx.SENDER_CAP)


@query("w2_sample_source", """SELECT source, count(*) AS mails, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':42'), doc_id) AS r FROM documents) q
WHERE source <> 'src1' OR r <= 20 GROUP BY source""")
def sample_source(t):
    kept = sp.sample_source(t.documents.select("doc_id", "source"), "source", "src1", "doc_id", 20)
    return kept.groupBy("source").agg(F.count("*").alias("mails"), F.sum("doc_id").alias("id_sum"))


GROUPED = [("g", "SELECT doc_id, label, source || '-' || lang AS grp FROM scored"),
           ("sizes", "SELECT grp, count(*) AS size, sum(label) AS pos, md5(grp || ':42') AS o FROM g GROUP BY grp")]


def _grouped(t):
    return t.scored.select("doc_id", "label", "source", F.concat_ws("-", "source", "lang").alias("grp"))


@query("w3_group_split", scored_sql("""SELECT g.doc_id, CAST((CASE WHEN filled >= 0.7 * n THEN 1 ELSE 0 END) + (CASE WHEN filled >= 0.85 * n THEN 1 ELSE 0 END) AS INTEGER) AS part FROM g JOIN (
 SELECT grp, sum(size) OVER (ORDER BY o) - size AS filled, sum(size) OVER () AS n FROM sizes) p ON p.grp = g.grp""", GROUPED))
def group_split(t):
    return sp.group_split(_grouped(t), "grp").select("doc_id", "part")


FOLDS = GROUPED + [("strata", "SELECT *, CASE WHEN pos = 0 THEN 'negative' WHEN pos = size THEN 'positive' ELSE 'mixed' END AS stratum FROM sizes"),
                   ("placed", "SELECT grp, sum(size) OVER (PARTITION BY stratum ORDER BY o) - size AS filled, sum(size) OVER (PARTITION BY stratum) AS n FROM strata")]


@query("w4_grouped_folds", scored_sql("SELECT g.doc_id, CAST(least(floor(filled * 5 / n), 4) AS INTEGER) AS fold FROM g JOIN placed p ON p.grp = g.grp", FOLDS))
def grouped_folds(t):
    return sp.grouped_folds(_grouped(t), "grp", "label", 5).select("doc_id", "fold")


@query("w5_stratified_split", scored_sql("""SELECT doc_id, CAST(CASE WHEN s < 0.7 THEN 0 WHEN s < 0.7 + 0.15 THEN 1 ELSE 2 END AS INTEGER) AS part FROM (
 SELECT doc_id, (row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42')) - 1) / count(*) OVER (PARTITION BY label) AS s FROM scored) q"""))
def stratified_split(t):
    return sp.stratified_split(t.scored, "doc_id", "label").select("doc_id", "part")


@query("w6_sender_folds", scored_sql("SELECT g.source, count(*) AS mails, min(fold) AS fold, count(DISTINCT fold) AS folds FROM (SELECT s.source, CAST(least(floor(filled * 5 / n), 4) AS INTEGER) AS fold FROM scored s JOIN placed p ON p.grp = s.source) g GROUP BY g.source",
    [("sizes", "SELECT source AS grp, count(*) AS size, sum(label) AS pos, md5(source || ':42') AS o FROM scored GROUP BY source")] + FOLDS[2:]))
def sender_folds(t):
    out = sp.grouped_folds(t.scored.select("doc_id", "label", "source"), "source", "label", 5)
    return out.groupBy("source").agg(F.count("*").alias("mails"), F.min("fold").alias("fold"), F.countDistinct("fold").alias("folds"))


GRID = [
    ("grid", "SELECT unnest(range(0, 981)) AS cell"),
    ("points", "SELECT fold, cell, (cell + 10) / 1000.0::DOUBLE AS threshold FROM (SELECT DISTINCT fold FROM scored) f, grid"),
    ("grid_counts", """SELECT p.fold, p.cell, p.threshold, count(*) FILTER (label = 1 AND score_a >= threshold) AS tp, count(*) FILTER (label = 0 AND score_a >= threshold) AS fp,
      count(*) FILTER (label = 1) AS p_all FROM points p JOIN scored s ON s.fold = p.fold GROUP BY ALL"""),
    ("grid_f1", "SELECT fold, cell, threshold, tp, fp, 2.0 * tp / greatest(tp + fp + p_all, 1) AS f1 FROM grid_counts"),
    ("grid_mean", "SELECT cell, round(avg(f1), 12) AS mean, stddev_samp(f1) AS sd, count(*) AS folds FROM grid_f1 GROUP BY cell"),
    ("peak", "SELECT arg_max(struct_pack(cell := cell, mean := mean, sd := sd, folds := folds), struct_pack(m := mean, c := -cell)) AS p FROM grid_mean"),
    ("bad", "SELECT cell FROM grid_mean, peak WHERE mean < p.mean - p.sd / sqrt(p.folds)"),
    ("run", "SELECT p.cell AS best, coalesce((SELECT max(cell) FROM bad WHERE cell < p.cell) + 1, 0) AS lo, coalesce((SELECT min(cell) FROM bad WHERE cell > p.cell) - 1, 980) AS hi, p FROM peak"),
]


@query("w7_f1_grid", scored_sql("SELECT fold, CAST(cell AS INTEGER) AS cell, threshold, tp, fp, round(f1, 6) AS f1 FROM grid_f1", GRID))
def f1_grid(t):
    return cv.f1_grid_curve(t.scored, "score_a").select("fold", "cell", "threshold", "tp", "fp", _r("f1").alias("f1"))


@query("w8_best_f1_threshold", scored_sql("SELECT lang, arg_max(score, struct_pack(f := round(2.0 * tp / (tp + fp + p_all), 12), s := -score)) AS threshold, round(max(2.0 * tp / (tp + fp + p_all)), 6) AS best_f1 FROM curve GROUP BY lang", CURVE))
def best_f1(t):
    return cv.curve_summary(_curve(t), ["lang"]).select("lang", F.col("best_f1_threshold").alias("threshold"), _r("best_f1").alias("best_f1"))


@query("w9_threshold_for_fpr", scored_sql("""SELECT lang, min(score_a) AS cut_above, 0 + count(*) FILTER (r <= floor(0.05 * n)) AS allowed FROM (SELECT lang, score_a, row_number() OVER (PARTITION BY lang ORDER BY score_a DESC) AS r,
 count(*) OVER (PARTITION BY lang) AS n FROM scored WHERE label = 0) q WHERE r <= floor(0.05 * n) + 1 GROUP BY lang"""))
def threshold_for_fpr(t):
    """The score an alarm must exceed so that at most 5% of the legitimate mails are flagged."""
    curve = _curve(t)
    out = cv.curve_summary(curve, ["lang"], fpr_limit=0.05)
    sizes = curve.groupBy("lang").agg(F.floor(F.first("N") * 0.05).alias("allowed"))
    return out.join(sizes, "lang").select("lang", "cut_above", "allowed")


@query("w10_plateau_threshold", scored_sql("""SELECT (best + 10) / 1000.0::DOUBLE AS peak, round(p.mean, 4) AS peak_f1, (lo + 10) / 1000.0::DOUBLE AS plateau_lo, (hi + 10) / 1000.0::DOUBLE AS plateau_hi,
 round(p.sd / sqrt(p.folds), 5) AS f1_se, round(((lo + 10) / 1000.0::DOUBLE + (hi + 10) / 1000.0::DOUBLE) / 2, 4) AS threshold FROM run""", GRID))
def plateau(t):
    return cv.plateau_threshold(cv.f1_grid_curve(t.scored, "score_a"))


COST_SQL = [
    ("lg", "SELECT i, 1 / (1 + exp(-(ln(1e-4 / (1 - 1e-4)) - 2 * ln(1e-4 / (1 - 1e-4)) * i / 2000.0))) AS threshold FROM (SELECT unnest(range(0, 2001)) AS i) q"),
    ("lc", "SELECT i, threshold, count(*) FILTER (label = 1 AND score_a < threshold) / count(*) FILTER (label = 1) AS fnr, 1 - count(*) FILTER (label = 0 AND score_a < threshold) / count(*) FILTER (label = 0) AS fpr FROM lg, scored GROUP BY ALL"),
    ("costs", f"SELECT *, prevalence * cost_ratio * fnr + (1 - prevalence) * fpr AS cost FROM lc, {_CELL_SQL}"),
    ("best", "SELECT *, min(cost) OVER (PARTITION BY cost_ratio, prevalence) AS low, i - row_number() OVER (PARTITION BY cost_ratio, prevalence, abs(cost - mn) <= 1e-15 + 1e-9 * abs(mn) ORDER BY i) AS island, abs(cost - mn) <= 1e-15 + 1e-9 * abs(mn) AS ok FROM (SELECT *, min(cost) OVER (PARTITION BY cost_ratio, prevalence) AS mn FROM costs) q"),
    ("runs", "SELECT cost_ratio, prevalence, min(i) AS lo, max(i) AS hi, min(low) AS cost FROM best WHERE ok GROUP BY cost_ratio, prevalence, island"),
    ("longest", "SELECT cost_ratio, prevalence, arg_max(struct_pack(lo := lo, hi := hi, cost := cost), struct_pack(n := hi - lo, s := -lo)) AS r FROM runs GROUP BY cost_ratio, prevalence"),
]


@query("w11_min_cost_threshold", scored_sql("SELECT cost_ratio, prevalence, round(threshold, 6) AS threshold, round(r.cost, 6) AS cost FROM longest JOIN lg ON lg.i = (r.lo + r.hi) // 2", COST_SQL))
def min_cost(t):
    out = cv.min_cost_threshold(t.scored, "score_a", "label", _CELLS)
    return out.select("cost_ratio", "prevalence", _r("threshold").alias("threshold"), _r("cost").alias("cost"))


WEIGHTS = [i / 20 for i in range(21)]
HYBRID_SQL = [
    ("hs", "SELECT w / 20.0::DOUBLE AS weight, label, round(w / 20.0::DOUBLE * score_a * 100 + (1 - w / 20.0::DOUBLE) * least(score_b * 120, 100.0), 9) AS score FROM scored, (SELECT unnest(range(0, 21)) AS w) q"),
    ("hb", "SELECT weight, score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM hs GROUP BY weight, score"),
    ("hc", "SELECT weight, score, sum(pos) OVER o AS tp, sum(n) OVER o AS flagged, sum(pos) OVER (PARTITION BY weight) AS p FROM hb WINDOW o AS (PARTITION BY weight ORDER BY score DESC)"),
    ("hw", "SELECT weight, arg_max(score, struct_pack(f := round(2.0 * tp / (flagged + p), 12), s := -score)) AS threshold, round(max(2.0 * tp / (flagged + p)), 9) AS f1 FROM hc GROUP BY weight"),
]


def _hybrid(t):
    rows = jn.cross_with_values(t.scored, "weight", WEIGHTS).withColumn(
        "score", F.round(pol.hybrid_score(F.col("score_a"), F.col("score_b") * 120, F.col("weight")), 9))
    best = cv.curve_summary(cv.score_curve(rows, keys=["weight"]), ["weight"])
    return best.select("weight", F.col("best_f1_threshold").alias("threshold"), F.round("best_f1", 9).alias("f1"))


@query("w12_hybrid_weights", scored_sql("SELECT weight, threshold, f1 FROM hw", HYBRID_SQL))
def hybrid_weights(t):
    return _hybrid(t)


@query("w13_best_weight", scored_sql("SELECT arg_max(weight, struct_pack(f := f1, w := weight)) AS weight, max(f1) AS f1 FROM hw", HYBRID_SQL))
def best_weight(t):
    """The last weight with the highest F1 wins."""
    return cv.best_weight(_hybrid(t))


def _numeric_band(r, c, pi, share):
    if c >= r / (1 + r):
        return None
    k = pol.odds(share) / pol.odds(pi)

    def shift(p):
        p = min(max(p, 1e-12), 1 - 1e-12)
        o = pol.odds(p) * k
        return o / (1 + o)
    return shift(c / r), shift(1 - c)


CURVE_COSTS = [100 / 101 * i / 49 for i in range(50)]
CURVE_BANDS = {f"{i:02d}": _numeric_band(100, c, 0.01, TRAIN_SHARE) or (1 / (1 + 100 * pol.odds(0.01) / pol.odds(TRAIN_SHARE)),) * 2
               for i, c in enumerate(CURVE_COSTS)}
_RC_SQL = "(VALUES " + ", ".join(f"({i}, {c!r}::DOUBLE, {CURVE_BANDS[f'{i:02d}'][0]!r}::DOUBLE, {CURVE_BANDS[f'{i:02d}'][1]!r}::DOUBLE)" for i, c in enumerate(CURVE_COSTS)) + ") b(step, c, lo, hi)"


@query("w14_risk_coverage", scored_sql(f"""SELECT CAST(step AS INTEGER) AS step, round(1 - rate, 6) AS coverage, round(1000 * (auto + c * rate), 6) AS total_cost FROM (
 SELECT step, c, 0.01 * rp + 0.99 * rl AS rate, 0.01 * 100 * fnr + 0.99 * fpr AS auto FROM (SELECT step, c,
 count(*) FILTER (label = 1 AND score_a < hi AND NOT (score_a > lo)) / count(*) FILTER (label = 1) AS fnr, count(*) FILTER (label = 0 AND score_a >= hi) / count(*) FILTER (label = 0) AS fpr,
 count(*) FILTER (label = 1 AND score_a > lo AND score_a < hi) / count(*) FILTER (label = 1) AS rp, count(*) FILTER (label = 0 AND score_a > lo AND score_a < hi) / count(*) FILTER (label = 0) AS rl
 FROM scored, {_RC_SQL} GROUP BY step, c) q) p"""))
def risk_coverage(t):
    steps = [(c, *CURVE_BANDS[f"{i:02d}"]) for i, c in enumerate(CURVE_COSTS)]
    return mt.risk_coverage(t.scored, steps, "score_a", 100, 0.01)


# ---------------------------------------------------------------- decision policy
@query("c1_shifted_probability", scored_sql(f"""SELECT doc_id, round(o / (1 + o), 9) AS shifted FROM (SELECT doc_id, (greatest(1e-12, least(1 - 1e-12, score_a)) / (1 - greatest(1e-12, least(1 - 1e-12, score_a))))
 * (0.01 / 0.99) / ({TRAIN_SHARE} / {1 - TRAIN_SHARE}) AS o FROM scored) q"""))
def shifted(t):
    return t.scored.select("doc_id", F.round(pol.shift_probability(F.col("score_a"), 0.01, TRAIN_SHARE), 9).alias("shifted"))


@query("c2_cost_thresholds", scored_sql(f"""SELECT cost_ratio, prevalence, round(1 / (1 + cost_ratio * (prevalence / (1 - prevalence)) / (share / (1 - share))), 9) AS threshold
FROM (SELECT avg(label) AS share FROM scored) q, {_CELL_SQL}"""))
def cost_thresholds(t):
    """Thresholds at the training share measured on the labelled mails."""
    share = t.scored.agg(F.avg("label").alias("share"))
    crossed = jn.cross_with_structs(share, _CELLS)
    return crossed.select("cost_ratio", "prevalence", F.round(pol.cost_threshold(F.col("cost_ratio"), F.col("prevalence"), F.col("share")), 9).alias("threshold"))


_BAND_PARAMS = [{"cost_ratio": r, "review_cost": c} for r in (1.0, 100.0) for c in (*lx.REVIEW_COSTS, 0.995)]
_BAND_PARAM_SQL = "(VALUES " + ", ".join(f"({p['cost_ratio']}::DOUBLE, {p['review_cost']}::DOUBLE)" for p in _BAND_PARAMS) + ") b(cost_ratio, review_cost)"


@query("c3_review_bands", scored_sql(f"""SELECT cost_ratio, review_cost, CASE WHEN review_cost < cost_ratio / (1 + cost_ratio) THEN round(o1 / (1 + o1), 9) END AS lo,
 CASE WHEN review_cost < cost_ratio / (1 + cost_ratio) THEN round(o2 / (1 + o2), 9) END AS hi FROM (SELECT cost_ratio, review_cost,
 (review_cost / cost_ratio) / (1 - review_cost / cost_ratio) * k AS o1, (1 - review_cost) / review_cost * k AS o2 FROM (SELECT (avg(label) / (1 - avg(label))) / (0.01 / 0.99) AS k FROM scored) q, {_BAND_PARAM_SQL}) p"""))
def review_bands(t):
    share = t.scored.agg(F.avg("label").alias("share"))
    crossed = jn.cross_with_structs(share, _BAND_PARAMS)
    band = pol.review_band(F.col("cost_ratio"), F.col("review_cost"), 0.01, F.col("share"))
    return crossed.withColumn("band", band).select("cost_ratio", "review_cost", F.round("band.lo", 9).alias("lo"), F.round("band.hi", 9).alias("hi"))


@query("c4_second_stage", scored_sql(f"""SELECT label, count(*) AS n, count(*) FILTER (score_a >= {T_A}) AS base, count(*) FILTER (score_a >= CASE WHEN v AND NOT s THEN t_v ELSE {T_A} END) AS stage, round(max(t_v), 6) AS t_v
FROM (SELECT *, doc_id % 3 = 0 AS v, doc_id % 4 = 0 AS s FROM scored) q, (SELECT greatest({T_A}, quantile_cont(score_a, 0.05)) AS t_v FROM scored WHERE label = 1 AND doc_id % 3 = 0 AND NOT (doc_id % 4 = 0)) p GROUP BY label"""))
def second_stage(t):
    """The bar for verified, unsuspicious senders is the 5th percentile of their phishing scores, at least t."""
    rows = t.scored.withColumns({"v": F.col("doc_id") % 3 == 0, "s": F.col("doc_id") % 4 == 0})
    fifth = cv.percentiles(rows.where("label = 1 AND v AND NOT s"), "score_a", {"q": 0.05})
    bar = jn.one_row(fifth.select(F.greatest(F.lit(T_A), F.col("q")).alias("t_v")))["t_v"]
    stage = F.col("score_a") >= pol.relieved_threshold(F.col("v"), F.col("s"), T_A, bar)
    flagged = rows.select("label", (F.col("score_a") >= T_A).alias("b"), stage.alias("g"), bar.alias("t_v"))
    return flagged.groupBy("label").agg(F.count("*").alias("n"), F.count_if("b").alias("base"), F.count_if("g").alias("stage"), _r(F.max("t_v")).alias("t_v"))


@query("c5_adoption_rule", scored_sql(f"""SELECT count(*) FILTER (only_b_correct > only_a_correct) AS better_sets, count(*) AS sets, coalesce(bool_or(p < 0.05 AND only_a_correct > only_b_correct), false) AS any_worse,
 count(*) FILTER (only_b_correct > only_a_correct) >= 2 AND NOT coalesce(bool_or(p < 0.05 AND only_a_correct > only_b_correct), false) AS adopted FROM (SELECT *, {MCNEMAR_SQL} AS p FROM discordant) q""", DISCORDANT))
def adoption_rule(t):
    """Adopt when at least two sets improve and none is significantly worse."""
    counts = mt.mcnemar_counts(_paired(t).join(t.scored.select("doc_id", "lang"), "doc_id"), keys=["lang"]).withColumn("p", mcnemar_p("only_a_correct", "only_b_correct"))
    return mt.adoption(counts)


@query("m13_hybrid_score", scored_sql("SELECT doc_id, round(0.6 * score_a * 100 + 0.4 * least(score_b * 120, 100.0), 6) AS hybrid FROM scored"))
def hybrid_score(t):
    return t.scored.select("doc_id", _r(pol.hybrid_score(F.col("score_a"), F.col("score_b") * 120, lx.HYBRID_WEIGHT)).alias("hybrid"))


@query("m10_platt_apply", scored_sql("SELECT doc_id, round(1 / (1 + exp(-(1.3279 * ln(greatest(1e-6, least(1 - 1e-6, score_a)) / (1 - greatest(1e-6, least(1 - 1e-6, score_a)))) - 0.1654))), 6) AS probability FROM scored"))
def platt_apply(t):
    return t.scored.select("doc_id", _r(pol.platt(F.col("score_a"), 1.3279, -0.1654)).alias("probability"))


@query("m14_verdict_text", scored_sql(f"""SELECT doc_id, score_a >= {T_A} AS is_phishing, 'ML phishing probability: ' || CAST(CAST(round(score_a * 100, 1) AS DECIMAL(9, 1)) AS VARCHAR) || '% -> ' || CASE WHEN score_a >= {T_A} THEN 'PHISHING' ELSE 'legit' END || ' (threshold 0.5)' AS verdict FROM scored"""))
def verdict_text(t):
    flagged = F.col("score_a") >= T_A
    tenths = F.round(F.col("score_a") * 100 * 10, 0)  # the product decides a tie, not the decimal digits of the percentage
    text = F.concat(F.lit("ML phishing probability: "), (tenths / 10).cast("decimal(9,1)").cast("string"), F.lit("% -> "),
                    F.when(flagged, "PHISHING").otherwise("legit"), F.lit(f" (threshold {T_A})"))
    return t.scored.select("doc_id", flagged.alias("is_phishing"), text.alias("verdict"))
