"""DuckDB text of the rule engine: links one row each, then one row per mail."""

from .. import lexicons as lx
from .views import with_views


def text_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def reg_domain(host):
    """Registered domain of a host expression."""
    p = f"list_filter(string_split(lower({host}), '.'), lambda p: p <> '')"
    return (f"(CASE WHEN len({p}) >= 3 AND length({p}[-1]) = 2 AND list_contains({text_list(lx.SECOND_LEVEL_LABELS)}, {p}[-2]) "
            f"THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END)")


def free_hosting(host):
    tests = " OR ".join(f"{host} = '{d}' OR suffix({host}, '.{d}')" for d in lx.FREE_HOSTING)
    return f"(regexp_matches({host}, '{lx.REGIONAL_BUCKET_PATTERN}') OR {tests})"


def foreign_brand(tokens, reg):
    tests = " OR ".join(
        f"(list_contains({tokens}, '{b}') AND split_part({reg}, '.', 1) <> '{b}' AND {reg} NOT IN ({quoted(o)}))"
        for b, o in lx.BRAND_DOMAINS.items())
    return f"({tests})"


IP_HOST = r"regexp_matches(host, '^(\+?0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|-0+)(\.(\+?0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|-0+)){3}$')"
SHORT = "(" + " OR ".join(f"host = '{s}' OR suffix(host, '.{s}')" for s in lx.SHORTENERS) + ")"
CHEAP = f"(contains(host, '.') AND list_contains({text_list(lx.CHEAP_TLDS)}, split_part(host, '.', -1)))"

LINKS = [
    ("link_all", r"""SELECT doc_id, pos, regexp_replace(raw, '[.,;:!?)]+$', '') AS url FROM (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS raw FROM (
    SELECT doc_id, regexp_extract_all(text, '(?i)https?://[^\s<>"'')\]]+') AS l FROM mail) a) b"""),
    ("link_first", "SELECT doc_id, url, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS pos FROM link_all GROUP BY doc_id, url"),
    ("link_parsed", r"""SELECT doc_id, pos, url, malformed,
  CASE WHEN malformed THEN '' ELSE lower(split_part(url, ':', 1)) END AS scheme,
  CASE WHEN malformed THEN '' ELSE lower(split_part(after_user, ':', 1)) END AS host,
  CASE WHEN contains(after_user, ':') THEN regexp_replace(substr(after_user, strpos(after_user, ':') + 1), '^0+([0-9])', '\1') ELSE '' END AS port,
  length(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')) AS path_length
 FROM (SELECT *, regexp_replace(authority, '^.*@', '') AS after_user, contains(authority, '[') AS malformed
  FROM (SELECT *, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS authority FROM link_first) a) b"""),
    ("link_flags", f"""SELECT *, NOT malformed AND host <> '' AS usable,
  NOT malformed AND host <> '' AND {IP_HOST} AS is_ip, {SHORT} AS is_short, {CHEAP} AS cheap,
  port <> '' AND (TRY_CAST(CASE WHEN regexp_matches(port, '^[0-9]+$') THEN port END AS BIGINT) IS NULL
    OR TRY_CAST(port AS BIGINT) > 65535) AS bad_port FROM link_parsed"""),
    ("link_checks", r"""SELECT *, CASE WHEN malformed THEN 10 WHEN scheme = 'http' THEN 15 ELSE 5 END AS scheme_score,
  odd_port, list_filter([
    CASE WHEN malformed THEN 'Malformed URL' END,
    CASE WHEN scheme = 'http' THEN 'Uses HTTP (unencrypted)' END,
    CASE WHEN NOT malformed AND host = '' THEN 'Missing hostname' END,
    CASE WHEN is_ip THEN 'URL points to IP address instead of domain' END,
    CASE WHEN usable AND contains(url, '@') THEN 'URL contains @ (possible credential hiding)' END,
    CASE WHEN usable AND is_short THEN 'URL shortener detected' END,
    CASE WHEN usable AND length(host) > 60 THEN 'Unusually long hostname' END,
    CASE WHEN usable AND regexp_matches(host, '[0-9]{4,}') THEN 'Hostname contains long digit sequence' END,
    CASE WHEN usable AND bad_port THEN 'Invalid port in URL' END,
    CASE WHEN usable AND odd_port THEN 'Non-standard port: ' || port END,
    CASE WHEN usable AND path_length > 80 THEN 'Very long URL path' END], lambda x: x IS NOT NULL) AS issues,
  CASE WHEN malformed THEN 10 WHEN host = '' THEN 10 ELSE
    CASE WHEN is_ip THEN 25 ELSE 0 END + CASE WHEN contains(url, '@') THEN 15 ELSE 0 END
    + CASE WHEN is_short THEN 10 ELSE 0 END + CASE WHEN length(host) > 60 THEN 8 ELSE 0 END
    + CASE WHEN regexp_matches(host, '[0-9]{4,}') THEN 6 ELSE 0 END + CASE WHEN bad_port OR odd_port THEN 8 ELSE 0 END
    + CASE WHEN path_length > 80 THEN 5 ELSE 0 END END AS issue_score,
  CASE WHEN usable AND NOT is_ip THEN list_filter([
    CASE WHEN cheap THEN 'suspicious TLD (.' || split_part(host, '.', -1) || ')' END,
    CASE WHEN length(host) - length(replace(host, '.', '')) >= 4 THEN 'many subdomains (possible obfuscation)' END,
    CASE WHEN length(host) - length(replace(host, '-', '')) >= 3 THEN 'many hyphens in domain' END,
    CASE WHEN regexp_matches(host, '""" + lx.TYPO_BRAND_PATTERN + r"""') THEN 'possible brand typosquatting' END,
    CASE WHEN cheap AND (contains(host, 'bank') OR contains(host, 'paypal') OR contains(host, 'secure')) THEN 'financial keyword on cheap TLD' END
    ], lambda x: x IS NOT NULL) ELSE [] END AS messages
 FROM (SELECT *, port <> '' AND NOT bad_port AND TRY_CAST(port AS BIGINT) NOT IN (0, 80, 443) AS odd_port FROM link_flags) q"""),
    ("link_warnings", """SELECT doc_id, host || ': ' || message AS warning, min(pos * 10 + k) AS pos FROM (
  SELECT doc_id, pos, host, unnest(range(1, len(messages) + 1)) AS k, unnest(messages) AS message FROM link_checks) w
 GROUP BY ALL"""),
]


def keyword_cte(keywords=lx.KEYWORDS):
    rows = ", ".join(f"('{k.lower()}')" for k in keywords)
    return [
        ("mail_low", r"SELECT *, lower(text) AS low, string_split_regex(lower(text), '[^\p{L}\p{N}_]+') AS toks FROM mail"),
        ("keyword_counts", f"""SELECT doc_id, term, CASE WHEN contains(term, ' ')
    THEN CAST((length(low) - length(replace(low, term, ''))) // length(term) AS INTEGER)
    ELSE CAST(len(list_filter(toks, lambda x: x = term)) AS INTEGER) END AS n
  FROM mail_low, (VALUES {rows}) k(term)"""),
    ]


RISKY = " + ".join([f"CASE WHEN contains(low, '{x}') THEN 18 ELSE 0 END" for x in lx.RISKY_EXTENSIONS]
                   + [f"CASE WHEN contains(low, '{x}') THEN 10 ELSE 0 END" for x in lx.BAIT_PHRASES])
RISKY_NOTES = "list_filter([" + ", ".join(
    [f"CASE WHEN contains(low, '{x}') THEN 'Mentions risky attachment type: {x}' END" for x in lx.RISKY_EXTENSIONS]
    + [f"CASE WHEN contains(low, '{x}') THEN 'Attachment bait phrase: \"{x}\"' END" for x in lx.BAIT_PHRASES]
) + "], lambda x: x IS NOT NULL)"
INSTITUTION = "(" + " OR ".join(f"contains(low, '{w}')" for w in lx.INSTITUTION_WORDS) + ")"
BRAND = "(" + " OR ".join(f"contains(low, '{w}')" for w in lx.SENDER_BRAND_WORDS) + ")"

RULES = keyword_cte() + LINKS + [
    ("keyword_totals", "SELECT doc_id, CAST(sum(n) AS INTEGER) AS hits, CAST(least(sum(n) * 8, 45) AS INTEGER) AS keyword_score FROM keyword_counts GROUP BY doc_id"),
    ("link_totals", """SELECT doc_id, CAST(count(*) AS INTEGER) AS n_urls, CAST(sum(scheme_score + issue_score + 5 * len(messages)) AS INTEGER) AS url_score,
  CAST(sum(len(issues)) AS INTEGER) AS n_issues, CAST(sum(CASE WHEN scheme = 'http' THEN 1 ELSE 0 END) AS INTEGER) AS n_http,
  CAST(sum(CASE WHEN issue_score > 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_suspicious, max(issue_score) AS max_issue,
  max(CASE WHEN is_ip THEN 1.0 ELSE 0.0 END) AS ip_url, max(CASE WHEN usable AND is_short THEN 1.0 ELSE 0.0 END) AS shortener_url,
  count(DISTINCT CASE WHEN host <> '' THEN host END) AS n_hosts,
  count(DISTINCT CASE WHEN len(messages) > 0 THEN host END) AS n_warned,
  list(DISTINCT CASE WHEN host <> '' THEN host END) AS hosts,
  list(host ORDER BY pos) FILTER (is_ip) AS ip_hosts FROM link_checks GROUP BY doc_id"""),
    ("warning_totals", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n_warnings, string_agg(warning, '; ' ORDER BY pos) AS warnings FROM link_warnings GROUP BY doc_id"),
    ("mail_parts", r"""SELECT m.doc_id, m.source, m.lang, m.label, m.text, low, hits, keyword_score,
  coalesce(n_urls, 0) AS n_urls, coalesce(url_score, 0) AS url_score, coalesce(n_issues, 0) AS n_issues, coalesce(n_http, 0) AS n_http,
  coalesce(n_suspicious, 0) AS n_suspicious, coalesce(max_issue, 0) AS max_issue, coalesce(ip_url, 0.0) AS ip_url, coalesce(shortener_url, 0.0) AS shortener_url,
  coalesce(n_hosts, 0) AS n_hosts, coalesce(n_warned, 0) AS n_warned, coalesce(n_warnings, 0) AS n_warnings, coalesce(warnings, '') AS warnings,
  coalesce(hosts, []) AS hosts, coalesce(ip_hosts, []) AS ip_hosts,
  list_filter(regexp_extract_all(text, '[0-9.]+'), lambda r: regexp_full_match(r, '((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])')) AS text_ips,
  CASE WHEN regexp_matches(text, '(?i)(^|\n)subject:') THEN trim(regexp_extract(text, '(?i)(^|\n)subject:([^\n\r]*)', 2)) END AS subject,
  regexp_extract_all(text, '[A-Za-z]{4,}') AS words,
  len(regexp_extract_all(text, '!!!')) AS n_bang3, len(regexp_extract_all(text, '\?\?\?')) AS n_quest3,
  length(text) - length(replace(text, '$', '')) AS n_dollar, length(text) - length(replace(text, '!', '')) AS n_bang,
  list_filter(regexp_extract_all(low, '""" + lx.EMAIL_PATTERN + r"""'), lambda e: split_part(e, '@', 2) IN (""" + quoted(lx.FREE_MAIL_DOMAINS) + r""")) AS free_mails
 FROM mail_low m JOIN keyword_totals k ON k.doc_id = m.doc_id LEFT JOIN link_totals l ON l.doc_id = m.doc_id
 LEFT JOIN warning_totals w ON w.doc_id = m.doc_id"""),
    ("mail_scores", f"""SELECT *, CASE WHEN len(text_ips) > 0 THEN 20 ELSE 0 END AS ip_score,
  len(list_distinct(list_concat(text_ips, ip_hosts))) AS n_ips,
  CASE WHEN length(regexp_replace(coalesce(subject, ''), '[^\\p{{L}}]', '', 'g')) > 5
    AND length(regexp_replace(subject, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(subject, '[^\\p{{L}}]', '', 'g')) > 0.7 THEN 15 ELSE 0 END AS subject_caps,
  CASE WHEN contains(coalesce(subject, ''), '!!!') OR contains(coalesce(subject, ''), '???') THEN 10 ELSE 0 END AS subject_loud,
  list_filter({text_list(lx.PRESSURE_PHRASES)}, lambda p: contains(lower(coalesce(subject, '')), p))[1] AS pressure,
  len(words) AS n_words, len(list_filter(words, lambda w: w = upper(w))) AS n_caps,
  CASE WHEN n_bang3 >= 2 OR n_quest3 >= 2 THEN 8 WHEN n_dollar >= 5 THEN 6 ELSE 0 END AS punctuation_score,
  least({RISKY}, 35) AS attachment_score, {RISKY_NOTES} AS attachment_notes,
  {INSTITUTION} AND len(free_mails) > 0 AS institution,
  NOT {INSTITUTION} AND {BRAND} AND len(free_mails) > 0 AS brand_sender,
  CASE WHEN regexp_matches(text, '[A-Za-z0-9+/]{{80,}}={{0,2}}') THEN 10 ELSE 0 END AS blob_score,
  CASE WHEN n_urls >= 4 THEN 12 ELSE 0 END AS many_links_score FROM mail_parts"""),
    ("mail_totals", """SELECT *, subject_caps + subject_loud + CASE WHEN pressure IS NOT NULL THEN 8 ELSE 0 END AS subject_score,
  CASE WHEN n_words >= 3 AND n_caps / n_words > 0.35 THEN 12 ELSE 0 END AS shouting_score,
  CAST(least(CASE WHEN institution THEN len(free_mails) * 12 WHEN brand_sender THEN 8 ELSE 0 END, 25) AS INTEGER) AS address_score FROM mail_scores"""),
    ("mail_rules", """SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  list_concat(list_filter([CASE WHEN subject_caps > 0 THEN 'Subject is mostly ALL CAPS' END,
    CASE WHEN subject_loud > 0 THEN 'Subject has excessive punctuation' END,
    CASE WHEN pressure IS NOT NULL THEN 'Subject contains pressure phrase: "' || pressure || '"' END,
    CASE WHEN shouting_score > 0 THEN 'Lots of ALL CAPS words in body' END,
    CASE WHEN punctuation_score = 8 THEN 'Repeated !!! or ??? in message' WHEN punctuation_score = 6 THEN 'Many dollar signs (common in scam templates)' END,
    CASE WHEN attachment_score > 0 THEN array_to_string(attachment_notes, '; ') END], lambda x: x IS NOT NULL),
   list_concat(CASE WHEN institution THEN list_transform(free_mails, lambda e: 'Free email domain but message mentions institution: ' || e) ELSE [] END,
   list_filter([CASE WHEN brand_sender THEN 'Brand name in text but sender-style email is free provider' END,
    CASE WHEN blob_score > 0 THEN 'Long base64-like block found (could hide content)' END,
    CASE WHEN many_links_score > 0 THEN 'Many links in one message (' || n_urls || ')' END], lambda x: x IS NOT NULL))) AS details
 FROM (SELECT *, keyword_score + url_score + ip_score + subject_score + shouting_score + punctuation_score + attachment_score
   + address_score + blob_score + many_links_score AS score FROM mail_totals) t"""),
]


def rules_sql(body):
    return with_views(["mail"], body, RULES)


def links_sql(body):
    return with_views(["mail"], body, LINKS)


def keywords_sql(body, keywords=lx.KEYWORDS):
    return with_views(["mail"], body, keyword_cte(keywords))
