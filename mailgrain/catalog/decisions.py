"""Queries of the decision and second-stage studies: English mails are the training set, the other languages judge."""

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import headers as hd
from ..functions.features import with_url_features
from ..plans import decision as dc
from ..session import durable
from .evaluation import _CELL_SQL, COST_SQL, MCNEMAR_SQL, T_A, TRAIN_SHARE, scored_sql
from .registry import query
from .rules import URLS_V4
from .signals import SIGNALS, SUSPICIOUS, VERIFIED
from .views import with_views

CELLS = [(r, p) for p in lx.PREVALENCES for r in lx.COST_RATIOS]
PRIMARY, PRIMARY_REVIEW, TRAINING = (100.0, 0.01), 0.25, "en"

_OK = "abs(cost - mn) <= 1e-15 + 1e-9 * abs(mn)"
DECISION_SQL = COST_SQL[:1] + [
    ("sets", "SELECT lang AS set_name, label, score_a AS score FROM scored"),
    ("at_grid", "SELECT set_name, i, coalesce(count(*) FILTER (label = 1 AND score < threshold) / nullif(count(*) FILTER (label = 1), 0), 0) AS fnr, "
     "coalesce(1 - count(*) FILTER (label = 0 AND score < threshold) / nullif(count(*) FILTER (label = 0), 0), 0) AS fpr FROM lg, sets GROUP BY set_name, i"),
    ("grid_costs", f"SELECT *, min(cost) OVER (PARTITION BY set_name, cost_ratio, prevalence) AS mn FROM (SELECT *, prevalence * cost_ratio * fnr + (1 - prevalence) * fpr AS cost FROM at_grid, {_CELL_SQL}) q"),
    ("optimal", f"SELECT *, i - row_number() OVER (PARTITION BY set_name, cost_ratio, prevalence ORDER BY i) AS island FROM grid_costs WHERE {_OK}"),
    ("stretches", "SELECT set_name, cost_ratio, prevalence, min(i) AS lo, max(i) AS hi, min(mn) AS cost FROM optimal GROUP BY set_name, cost_ratio, prevalence, island"),
    ("cheapest", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_name, cost_ratio, prevalence ORDER BY hi - lo DESC, lo) AS k FROM stretches) q JOIN lg ON lg.i = (lo + hi) // 2 WHERE k = 1"),
    ("policies", f"""SELECT cost_ratio, prevalence, 'P0' AS policy, {T_A}::DOUBLE AS threshold FROM {_CELL_SQL}
 UNION ALL SELECT cost_ratio, prevalence, 'P1', 1 / (1 + cost_ratio * (prevalence / (1 - prevalence)) / ({TRAIN_SHARE} / {1 - TRAIN_SHARE})) FROM {_CELL_SQL}
 UNION ALL SELECT cost_ratio, prevalence, 'P2', threshold FROM cheapest WHERE set_name = '{TRAINING}'"""),
    ("rated", "SELECT set_name, cost_ratio, prevalence, policy, threshold, count(*) FILTER (label = 1 AND score < threshold) / count(*) FILTER (label = 1) AS fnr, "
     "count(*) FILTER (label = 0 AND score >= threshold) / count(*) FILTER (label = 0) AS fpr FROM sets, policies GROUP BY ALL"),
]
_COSTS_SQL = scored_sql("""SELECT r.set_name, r.cost_ratio, r.prevalence, policy, round(r.threshold, 6) AS threshold, round(r.fnr, 6) AS fnr, round(r.fpr, 6) AS fpr,
 round(1000 * (r.prevalence * r.cost_ratio * r.fnr + (1 - r.prevalence) * r.fpr), 6) AS cost, round(1000 * least(r.prevalence * r.cost_ratio, 1 - r.prevalence), 6) AS trivial_cost,
 round(1000 * c.cost, 6) AS oracle_cost, round(1000 * (r.prevalence * r.cost_ratio * r.fnr + (1 - r.prevalence) * r.fpr) - 1000 * c.cost, 6) + 0.0 AS regret
 FROM rated r LEFT JOIN cheapest c ON c.set_name = r.set_name AND c.cost_ratio = r.cost_ratio AND c.prevalence = r.prevalence AND c.set_name <> 'en'""", DECISION_SQL)


def _sets(t):
    return durable(t.scored.select(F.col("lang").alias("set_name"), "label", F.col("score_a").alias("score")))


@query("q20_decision_costs", _COSTS_SQL)
def decision_costs(t):
    """Fixed, cost-derived and cheapest threshold in all twelve cells on every set, with regret against the set's own best."""
    out = dc.decision_costs(_sets(t), TRAINING, CELLS, TRAIN_SHARE, T_A)
    rounded = ("threshold", "fnr", "fpr", "cost", "trivial_cost", "oracle_cost", "regret")
    return out.select("set_name", "cost_ratio", "prevalence", "policy", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in rounded])


@query("q20_cost_differences", None)
def cost_differences(t):
    """Paired bootstrap differences of the policies in every cell, review bands in the primary one."""
    return dc.cost_differences(_sets(t), TRAINING, CELLS, TRAIN_SHARE, T_A, PRIMARY, lx.REVIEW_COSTS)


@query("q20_adoption", None)
def policy_adoption(t):
    return dc.adoption(durable(cost_differences(t)), TRAINING, PRIMARY, PRIMARY_REVIEW)


def _senders(t):
    links = with_url_features(t.mail.where("label IS NOT NULL").select("doc_id", "text")).select("doc_id", "url_free_hosting_fraction")
    flags = hd.with_header_signals(t.mail_headers).join(links, "doc_id").select(
        "doc_id", hd.verified_sender().alias("verified"), hd.suspicious_sender(F.col("url_free_hosting_fraction")).alias("suspicious"))
    return durable(t.scored.join(flags, "doc_id").select(F.col("lang").alias("set_name"), "label", F.col("score_a").alias("score"), "verified", "suspicious"))


SENDER_SQL = URLS_V4 + [
    ("senders", f"SELECT c.lang AS set_name, c.label, c.score_a AS score, f.v, f.s FROM scored c JOIN (SELECT doc_id, {VERIFIED} AS v, {SUSPICIOUS} AS s FROM header_signals JOIN url_features USING (doc_id)) f USING (doc_id)"),
    ("bars", f"SELECT greatest({T_A}::DOUBLE, quantile_cont(score, 0.05)) AS bar FROM senders WHERE set_name = '{TRAINING}' AND label = 1 AND v AND NOT s"),
    ("judged", f"SELECT set_name, label, bar, v, s, score >= {T_A} AS base, score >= CASE WHEN v AND NOT s THEN bar ELSE {T_A} END AS stage FROM senders, bars WHERE set_name <> '{TRAINING}'"),
    ("stages", """SELECT set_name, label, round(bar, 9) AS bar, count(*) AS n, count(*) FILTER (v) AS verified, count(*) FILTER (v AND NOT s) AS relieved, count(*) FILTER (base) AS base, count(*) FILTER (stage) AS stage,
 count(*) FILTER (stage = (label = 1) AND base <> (label = 1)) AS only_a_correct, count(*) FILTER (base = (label = 1) AND stage <> (label = 1)) AS only_b_correct FROM judged GROUP BY set_name, label, bar"""),
    ("tested", f"SELECT *, round({MCNEMAR_SQL}, 4) AS p_value FROM stages"),
]


def _sender_sql(body):
    return with_views(["mail", "mail_headers", "scored"], body, SIGNALS + SENDER_SQL)


@query("q18_sender_bar", _sender_sql("SELECT set_name, label, bar, n, verified, relieved, base, stage, only_a_correct AS only_stage_correct, only_b_correct AS only_base_correct, p_value FROM tested"))
def sender_bar(t):
    """Second stage with the bar at the 5th percentile of relieved training positives, and an exact paired test per set."""
    return dc.sender_stage(_senders(t), TRAINING, T_A).withColumn("bar", F.round("bar", 9))


@query("q18_sender_decision", _sender_sql("""SELECT lost AS lost_recall_sets, cleared AS cleared_sets, lost = 0 AND cleared = negatives AND negatives > 0 AS qualifies FROM (
 SELECT count(*) FILTER (label = 1 AND p_value < 0.05 AND only_b_correct > only_a_correct) AS lost, count(*) FILTER (label = 0 AND p_value < 0.05 AND only_a_correct > only_b_correct) AS cleared,
 count(*) FILTER (label = 0) AS negatives FROM tested) q"""))
def sender_decision(t):
    return dc.sender_decision(dc.sender_stage(_senders(t), TRAINING, T_A))
