"""Queries of the rule engine and the feature vectors."""

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.features import feature_names, standardise_and_clip, with_features, with_url_features
from ..functions.rules import rule_verdict, with_rules
from ..functions.urls import (brand_in_foreign_domain, host_of, is_free_hosting, is_ip_host, is_shortener, raw_urls,
                              registered_domain)
from ..operators.joins import unresolved_hosts
from ..session import durable
from .registry import query
from .rules_sql import (LINKS, RULES, foreign_brand, free_hosting, keywords_sql, links_sql, reg_domain, rules_sql)
from .views import with_views


def _links(t):
    return with_rules(t.mail).select("doc_id", F.posexplode("urls").alias("pos", "u")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "u.*")


@query("risk_by_source", rules_sql("""SELECT source, risk, count(*) AS mails, round(avg(score), 6) AS mean_score
FROM mail_rules GROUP BY source, risk"""))
def risk_by_source(t):
    """Which sources carry how much risky mail?"""
    return with_rules(t.mail).groupBy("source", "risk").agg(
        F.count("*").alias("mails"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("r1_keyword_hits", keywords_sql("SELECT doc_id, term, n FROM keyword_counts WHERE n > 0"))
def keyword_hits(t):
    return with_rules(t.mail).select("doc_id", F.explode("keyword_hits").alias("term", "n"))


@query("r1_keyword_score", rules_sql("SELECT doc_id, hits, keyword_score FROM mail_rules"))
def keyword_score(t):
    hits = F.aggregate(F.map_values("keyword_hits"), F.lit(0), lambda a, b: a + b)
    return with_rules(t.mail).select("doc_id", hits.alias("hits"), "keyword_score")


@query("r2_url_extraction", links_sql("SELECT doc_id, pos, url FROM link_first"))
def url_extraction(t):
    return _links(t).select("doc_id", "pos", "url")


@query("r3_url_inspection", links_sql("""SELECT doc_id, pos, url, scheme, host, scheme_score, issue_score,
  array_to_string(issues, '; ') AS issues FROM link_checks"""))
def url_inspection(t):
    return _links(t).withColumn("issues", F.array_join("issues", "; "))


@query("r4_domain_warnings", rules_sql("""SELECT doc_id, n_warnings, warnings, url_score FROM mail_rules"""))
def domain_warnings(t):
    return with_rules(t.mail).select(
        "doc_id", F.size("domain_warnings").alias("n_warnings"), F.array_join("domain_warnings", "; ").alias("warnings"), "url_score")


@query("r5_shortener_links", links_sql("SELECT doc_id, url, host FROM link_checks WHERE usable AND is_short"))
def shortener_links(t):
    return _links(t).where(is_shortener(F.col("host"))).select("doc_id", "url", "host")


@query("r6_ip_host_links", links_sql("SELECT doc_id, url, host FROM link_checks WHERE is_ip"))
def ip_host_links(t):
    return _links(t).where(is_ip_host(F.col("host"))).select("doc_id", "url", "host")


@query("r7_ip_addresses", rules_sql("""SELECT doc_id, ip_score, CAST(n_ips AS INTEGER) AS n_ips FROM mail_rules"""))
def ip_addresses(t):
    return with_rules(t.mail).select("doc_id", "ip_score", F.size("ips").alias("n_ips"))


def _single(name, column, extra=""):
    @query(name, rules_sql(f"SELECT doc_id, {column}{extra} FROM mail_rules"))
    def run(t):
        columns = ["doc_id", column] + ([extra.strip(", ")] if extra else [])
        return with_rules(t.mail).select(*columns)


_single("r8_subject_line", "subject_score", ", subject")
_single("r9_shouting", "shouting_score")
_single("r10_punctuation", "punctuation_score")
_single("r11_attachments", "attachment_score")
_single("r12_free_mail_senders", "address_score")
_single("r13_base64_runs", "blob_score")
_single("r14_many_links", "many_links_score")


@query("r15_rule_totals", rules_sql("""SELECT doc_id, keyword_score, url_score, ip_score, subject_score, shouting_score, punctuation_score,
  attachment_score, address_score, blob_score, many_links_score, score, risk FROM mail_rules"""))
def rule_totals(t):
    return with_rules(t.mail).select(
        "doc_id", "keyword_score", "url_score", "ip_score", "subject_score", "shouting_score", "punctuation_score",
        "attachment_score", "address_score", "blob_score", "many_links_score", "score", "risk")


@query("r16_rule_verdicts", rules_sql("""SELECT source, count(*) AS mails, count(*) FILTER (score >= 50) AS flagged,
  count(*) FILTER (risk IN ('HIGH', 'CRITICAL')) AS high_or_critical FROM mail_rules GROUP BY source"""))
def rule_verdicts(t):
    return with_rules(t.mail).groupBy("source").agg(
        F.count("*").alias("mails"), F.count_if(rule_verdict(F.col("score"))).alias("flagged"),
        F.count_if(F.col("risk").isin("HIGH", "CRITICAL")).alias("high_or_critical"))


@query("r17_notes", rules_sql("""SELECT doc_id, CAST(len(details) AS INTEGER) AS n_notes, array_to_string(details, ' | ') AS notes
FROM mail_rules"""))
def notes(t):
    return with_rules(t.mail).select(
        "doc_id", F.size("details").alias("n_notes"), F.array_join("details", " | ").alias("notes"))


@query("r18_unresolved_hosts", with_views(["mail"], """SELECT doc_id, count(*) AS links, CAST(5 * count(*) AS BIGINT) AS points
FROM link_checks WHERE usable AND NOT is_ip AND host NOT IN
 (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) FROM pages) GROUP BY doc_id""", LINKS))
def unresolved(t):
    """Hosts missing from a resolution snapshot (here: the hosts of `pages`) add points per link."""
    snapshot = t.pages.select(host_of(F.col("url")).alias("host"))
    return unresolved_hosts(_links(t), snapshot).groupBy("doc_id").agg(
        F.count("*").alias("links"), (F.lit(lx.DOMAIN_WARNING_POINTS) * F.count("*")).cast("long").alias("points"))


HOSTS = LINKS + [("hosts", "SELECT DISTINCT host FROM link_checks WHERE usable")]


def _hosts(t):
    return t.mail.select(F.explode(F.array_distinct(F.transform(raw_urls(F.col("text")), host_of))).alias("host")).where(
        "host <> ''").distinct()


@query("f1_registered_domain", with_views(["mail"], f"SELECT host, {reg_domain('host')} AS domain FROM hosts", HOSTS))
def registered(t):
    return _hosts(t).select("host", registered_domain(F.col("host")).alias("domain"))


@query("f2_free_hosting", with_views(["mail"], f"SELECT host FROM hosts WHERE {free_hosting('host')}", HOSTS))
def hosting(t):
    return _hosts(t).where(is_free_hosting(F.col("host")))


@query("f3_brand_in_foreign_domain", with_views(
    ["mail"], f"SELECT host FROM (SELECT host, regexp_split_to_array(host, '[.-]') AS tokens, {reg_domain('host')} AS reg FROM hosts) q WHERE {foreign_brand('tokens', 'reg')}", HOSTS))
def foreign_brands(t):
    return _hosts(t).where(brand_in_foreign_domain(F.col("host")))


URLS_V4 = LINKS + [
    ("host_all", rf"""SELECT a.doc_id, a.url, c.host, {reg_domain('c.host')} AS reg, regexp_split_to_array(c.host, '[.-]') AS tokens
  FROM link_all a JOIN link_checks c ON c.doc_id = a.doc_id AND c.url = a.url WHERE c.usable AND NOT c.is_ip"""),
    ("url_vector", f"""SELECT doc_id,
  count(DISTINCT CASE WHEN {free_hosting('host')} THEN host END) / count(DISTINCT host) AS url_free_hosting_fraction,
  max(CASE WHEN regexp_matches(url, '{lx.REDIRECT_PATTERN}') THEN 1.0 ELSE 0.0 END) AS url_redirect_param,
  max(CASE WHEN regexp_matches(url, '{lx.PERCENT_PATTERN}') THEN 1.0 ELSE 0.0 END) AS url_pct_encoded,
  least(max(length(host) - length(replace(host, '-', ''))), 4) / 4.0 AS url_max_host_hyphens,
  least(max(greatest(0, (length(host) - length(replace(host, '.', ''))) - (length(reg) - length(replace(reg, '.', ''))))), 4) / 4.0 AS url_max_subdomain_depth,
  max(CASE WHEN {foreign_brand('tokens', 'reg')} THEN 1.0 ELSE 0.0 END) AS url_brand_in_foreign_domain,
  max(CASE WHEN contains(host, 'xn--') THEN 1.0 ELSE 0.0 END) AS url_punycode,
  ln(1 + count(DISTINCT reg)) AS url_distinct_domains_log FROM host_all GROUP BY doc_id"""),
    ("url_features", "SELECT m.doc_id, m.source, m.label, " + ", ".join(
        f"coalesce({n}, 0.0) AS {n}" for n in lx.URL_FEATURES) + " FROM mail m LEFT JOIN url_vector v ON v.doc_id = m.doc_id"),
]


def _rounded(names):
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def _round_columns(names):
    return [F.round(n, 6).alias(n) for n in names]


@query("f4_url_features", with_views(["mail"], f"SELECT doc_id, {_rounded(lx.URL_FEATURES)} FROM url_features", URLS_V4))
def url_feature_rows(t):
    return with_url_features(t.mail).select("doc_id", *_round_columns(lx.URL_FEATURES))


V1_SQL = """hits AS keyword_hit_count, n_urls AS url_count, n_http AS http_url_count, n_issues AS url_issue_count, n_ips AS ip_count,
  n_warnings AS domain_warning_count, len(details) AS detail_count, ln(1 + length(text)) AS text_length_log,
  CASE WHEN n_words > 0 THEN n_caps / n_words ELSE 0.0 END AS caps_word_ratio, n_bang AS exclamation_count,
  CASE WHEN coalesce(subject, '') <> '' THEN 1.0 ELSE 0.0 END AS has_subject"""
V2_SQL = """ln(1 + score) AS rule_score_log, keyword_score, ln(1 + hits) AS keyword_hits_log, CASE WHEN n_urls > 0 THEN 1.0 ELSE 0.0 END AS has_url,
  ln(1 + n_urls) AS url_count_log, CASE WHEN n_urls > 0 THEN n_http / n_urls ELSE 0.0 END AS http_url_fraction,
  CASE WHEN n_urls > 0 THEN n_suspicious / n_urls ELSE 0.0 END AS suspicious_url_fraction, max_issue AS max_url_issue_score, ip_url, shortener_url,
  CASE WHEN n_hosts > 0 THEN n_warned / n_hosts ELSE 0.0 END AS domain_warning_fraction,
  CASE WHEN len(list_filter(list_concat(text_ips, ip_hosts), lambda i: NOT list_contains(hosts, i))) > 0 THEN 1.0 ELSE 0.0 END AS ip_in_text,
  len(details) AS detail_count, ln(1 + length(text)) AS text_length_log,
  CASE WHEN n_words > 0 THEN n_caps / n_words ELSE 0.0 END AS caps_word_ratio, ln(1 + n_bang) AS exclamation_log"""
LURE_SQL = ", ".join(
    f"ln(1 + len(regexp_extract_all(text, '(?i){p}'))) AS lure_{n}" for n, p in lx.LURE_PATTERNS.items()) + r""",
  CASE WHEN length(trim(CASE WHEN prefix(text, 'Subject:') AND contains(text, chr(10) || chr(10))
    THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END, ' ' || chr(9) || chr(10) || chr(13))) < 300 THEN 1.0 ELSE 0.0 END AS short_body"""
FEATURES = RULES + [
    ("features_v1", f"SELECT doc_id, score AS rule_score, keyword_score, url_score, {V1_SQL} FROM mail_rules"),
    ("features_v2", f"SELECT doc_id, {V2_SQL} FROM mail_rules"),
    # RE2 word edges are ASCII: accented letters become plain ones first
    ("features_lure", f"SELECT doc_id, {LURE_SQL} FROM (SELECT doc_id, regexp_replace(text, '[\u00c0-\u024f]', 'z', 'g') AS text FROM mail) m"),
]


@query("f5_features_v1", with_views(["mail"], f"SELECT doc_id, {_rounded(lx.FEATURES_V1)} FROM features_v1", FEATURES))
def features_v1(t):
    return with_features(t.mail, 1).select("doc_id", *_round_columns(lx.FEATURES_V1))


@query("f6_features_v2", with_views(["mail"], f"SELECT doc_id, {_rounded(lx.FEATURES_V2)} FROM features_v2", FEATURES))
def features_v2(t):
    return with_features(t.mail, 2).select("doc_id", *_round_columns(lx.FEATURES_V2))


@query("f7_lure_features", with_views(["mail"], f"SELECT doc_id, {_rounded(lx.LURE_FEATURES)} FROM features_lure", FEATURES))
def lure_features(t):
    return with_features(t.mail, 3).select("doc_id", *_round_columns(lx.LURE_FEATURES))


@query("f8_features_v4", with_views(["mail"], f"""SELECT doc_id, {_rounded(feature_names(4))}
FROM features_v2 JOIN features_lure USING (doc_id) JOIN url_features USING (doc_id)""",
    FEATURES + [c for c in URLS_V4 if c not in LINKS]))
def features_v4(t):
    return with_features(t.mail, 4).select("doc_id", *_round_columns(feature_names(4)))


_RATE_NAMES = lx.URL_FEATURES


@query("f9_url_feature_rates", with_views(["mail"], "SELECT source, label, count(*) AS mails, " + ", ".join(
    f"round(avg(CASE WHEN {n} > 0 THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n in _RATE_NAMES)
    + " FROM url_features WHERE url_distinct_domains_log > 0 AND label IS NOT NULL GROUP BY source, label", URLS_V4))
def url_feature_rates(t):
    with_links = with_url_features(t.mail.where("label IS NOT NULL")).where("url_distinct_domains_log > 0")
    return with_links.groupBy("source", "label").agg(
        F.count("*").alias("mails"), *[F.round(F.avg((F.col(n) > 0).cast("double")), 6).alias(n) for n in _RATE_NAMES])


@query("f10_scaled_features", with_views(["mail"], "SELECT doc_id, " + ", ".join(
    f"round(greatest(-3.0, least(3.0, ({n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1.0 ELSE s_{n} END)), 5) AS {n}" for n in lx.FEATURES_V2)
    + " FROM features_v2, (SELECT " + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in lx.FEATURES_V2) + " FROM features_v2) s", FEATURES))
def scaled_features(t):
    features = durable(with_features(t.mail, 2).select("doc_id", *lx.FEATURES_V2))  # some numbers a mail, read for the moments and again
    scaled = standardise_and_clip(features, lx.FEATURES_V2)
    return scaled.select("doc_id", *[F.round(n, 5).alias(n) for n in lx.FEATURES_V2])


@query("u1_custom_keywords", keywords_sql("""SELECT doc_id, CAST(least(8 * sum(n), 45) AS INTEGER) AS keyword_score FROM keyword_counts
GROUP BY doc_id""", ("Meeting", "Reminder", "ready, enable", "server", "the")))
def custom_keywords(t):
    """The keyword list is a parameter of the rule scorer."""
    scored = with_rules(t.mail, keywords=("Meeting", "Reminder", "ready, enable", "server", "the"))
    return scored.select("doc_id", "keyword_score")


@query("u4_url_rows", links_sql("SELECT doc_id, pos, scheme, host, scheme_score + issue_score AS total_score FROM link_checks"))
def url_rows(t):
    """One mail to many link rows."""
    return _links(t).select("doc_id", "pos", "scheme", "host", (F.col("scheme_score") + F.col("issue_score")).alias("total_score"))
