"""Queries of HTML, header and sender signals."""

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import headers as hd
from ..functions import html as ht
from ..functions.features import with_url_features
from ..operators import signals as sg
from .registry import query
from .rules import URLS_V4
from .rules_sql import foreign_brand, quoted, reg_domain
from .views import with_views

HTML_FLAGS = [("flags", r"""SELECT page_id, regexp_matches(html, '(?i)<form\b') AS form, regexp_matches(html, '(?i)<input\b[^>]*\btype\s*=\s*["'']?password\b') AS password_input,
 regexp_matches(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') AS meta_refresh, regexp_matches(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']?\s*(?:javascript|data):') AS script_or_data_link,
 CAST(len(regexp_extract_all(html, '(?i)<img\b')) AS INTEGER) AS images FROM html_mail""")]
_ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>"""


def _any_host(x):
    full = f"(CASE WHEN contains({x}, '://') THEN {x} ELSE 'http://' || {x} END)"
    return rf"lower(split_part(regexp_replace(regexp_extract({full}, '^[a-zA-Z]+://([^/?#]*)', 1), '^.*@', ''), ':', 1))"


ANCHORS = [
    ("anchor_lists", f"SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS h, regexp_extract_all(html, '{_ANCHOR}', 2) AS x FROM html_mail"),
    ("anchors", r"SELECT page_id, trim(unnest(h)) AS href, regexp_replace(regexp_replace(unnest(x), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM anchor_lists"),
    ("anchor_hosts", rf"SELECT *, {_any_host('text')} AS shown, {_any_host('href')} AS target FROM anchors"),
    ("anchor_tests", rf"""SELECT *, regexp_full_match(text, '(?i)\s*(https?://)?(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)+(/\S*)?\s*') AND prefix(lower(href), 'http') AND shown <> '' AND target <> ''
   AND {reg_domain('shown')} <> {reg_domain('target')} AS mismatch, prefix(lower(href), 'http') AND target <> '' AND {foreign_brand("regexp_split_to_array(lower(text), '[^a-z0-9]+')", reg_domain('target'))} AS brand FROM anchor_hosts"""),
]


@query("h1_html_flags", with_views(["html_mail"], "SELECT * FROM flags", HTML_FLAGS))
def html_flags(t):
    return t.html_mail.select("page_id", *[c.alias(n) for n, c in ht.html_flags_native(F.col("html")).items()])


@query("h2_hidden_text", None)
def hidden_text(t):
    return ht.with_html_signals(t.html_mail).select("page_id", "hidden_text")


@query("h3_image_heavy", None)
def image_heavy(t):
    return ht.with_html_signals(t.html_mail).select("page_id", "image_heavy", "has_html", "html_only")


@query("t2_html_text_exact", None)
def html_text_exact(t):
    text = t.html_mail.select("page_id", ht.html_text(F.col("html")).alias("r"))
    return text.select("page_id", F.length("r").alias("n_chars"), F.md5("r").alias("digest"))


@query("h4_link_text_mismatch", with_views(["html_mail"], "SELECT page_id, bool_or(mismatch) AS mismatch FROM anchor_tests GROUP BY page_id HAVING bool_or(mismatch)", ANCHORS))
def link_mismatch(t):
    found = ht.link_text_mismatch(ht.anchors_native(F.col("html")))
    return t.html_mail.select("page_id", found.alias("mismatch")).where("mismatch")


@query("h5_brand_text_foreign_link", with_views(["html_mail"], "SELECT page_id, bool_or(brand) AS brand_link FROM anchor_tests GROUP BY page_id HAVING bool_or(brand)", ANCHORS))
def brand_link(t):
    return t.html_mail.select("page_id", ht.brand_link_mismatch(ht.anchors_native(F.col("html"))).alias("brand_link")).where("brand_link")


@query("h6_html_only", with_views(["html_mail"], r"SELECT page_id, html <> '' AS has_html, html <> '' AND trim(plain) = '' AS html_only FROM html_mail"))
def html_only(t):
    return t.html_mail.select("page_id", ht.has_html(F.col("html")).alias("has_html"), ht.html_only(F.col("html"), F.col("plain")).alias("html_only"))


def _header(name):
    return rf"regexp_extract_all(header_block, '(?im)^{name}:[ \t]*([^\n]*)', 1)"


_ADDRESS = r"CASE WHEN contains(v, '@') THEN lower(regexp_replace(regexp_extract(v, '([^\s<>,;\"]+@[^\s<>,;\"]+)', 1), '^.*@', '')) ELSE '' END"


def _host_sql(name):
    return _ADDRESS.replace("v", f"coalesce({_header(name)}[1], '')").replace(r"\"", '"')


SIGNALS = [
    ("parsed", rf"""SELECT doc_id, {_host_sql('From')} AS from_host, {_host_sql('Return-Path')} AS return_host, {_header('Authentication-Results')} AS auth, {_header('DKIM-Signature')} AS dkim,
   regexp_extract_all(array_to_string({_header('Reply-To')}, ' '), '@([A-Za-z0-9.-]+)', 1) AS reply FROM mail_headers"""),
    ("domains", rf"""SELECT doc_id, from_host, {reg_domain('from_host')} AS f, {reg_domain('return_host')} AS rp, auth, dkim, list_transform(reply, lambda h: {reg_domain('h')}) AS reply,
   list_transform(dkim, lambda s: {reg_domain(r"regexp_extract(s, '(?:^|;)\s*d\s*=\s*([A-Za-z0-9.-]+)', 1)")}) AS signed, array_to_string(auth, ' ') AS a FROM parsed"""),
    ("results", "SELECT *, " + ", ".join(rf"CASE WHEN regexp_matches(a, '(?i)\b{m}\s*=\s*[a-z]+') THEN lower(regexp_extract(a, '(?i)\b{m}\s*=\s*([a-z]+)', 1)) END AS recorded_{m}" for m in lx.AUTH_MECHANISMS) + " FROM domains"),
    ("header_signals", f"""SELECT doc_id, from_host, recorded_spf, recorded_dkim, recorded_dmarc, len(auth) = 0 AS no_auth_results, recorded_spf <> 'pass' AS spf_not_pass, recorded_dkim <> 'pass' AS dkim_not_pass,
   recorded_dmarc <> 'pass' AS dmarc_not_pass, len(dkim) = 0 AS no_dkim_signature, f <> '' AND NOT list_contains(signed, f) AS dkim_not_aligned, f <> '' AND rp <> '' AND rp <> f AS return_path_not_aligned,
   f <> '' AND len(list_filter(reply, lambda d: d <> f)) > 0 AS reply_to_other_domain, f IN ({quoted(lx.SENDER_FREE_MAIL)}) AS from_freemail FROM results"""),
]
_NAMES = ", ".join(hd.SIGNALS)


@query("h7_sender_domain", with_views(["mail_headers"], "SELECT f AS sender, count(*) AS mails FROM domains GROUP BY f", SIGNALS))
def sender_domain(t):
    return t.mail_headers.groupBy(hd.sender_domain(hd.header_value(F.col("header_block"), "From")).alias("sender")).agg(F.count("*").alias("mails"))


@query("h8_recorded_results", with_views(["mail_headers"], "SELECT doc_id, recorded_spf, recorded_dkim, recorded_dmarc FROM header_signals", SIGNALS))
def recorded_results(t):
    return hd.with_header_signals(t.mail_headers).select("doc_id", "recorded_spf", "recorded_dkim", "recorded_dmarc")


@query("h9_header_signals", with_views(["mail_headers"], f"SELECT doc_id, {_NAMES} FROM header_signals", SIGNALS))
def header_signals(t):
    return hd.with_header_signals(t.mail_headers).select("doc_id", *hd.SIGNALS)


VERIFIED = "coalesce(NOT dmarc_not_pass, false) AND NOT dkim_not_aligned"


@query("h10_verified_sender", with_views(["mail_headers"], f"SELECT doc_id, {VERIFIED} AS verified FROM header_signals", SIGNALS))
def verified(t):
    return hd.with_header_signals(t.mail_headers).select("doc_id", hd.verified_sender().alias("verified"))


SUSPICIOUS = f"""{foreign_brand("regexp_split_to_array(from_host, '[.-]')", reg_domain('from_host'))} OR contains(from_host, 'xn--') OR url_free_hosting_fraction > 0 OR reply_to_other_domain"""


@query("h11_suspicious_sender", with_views(["mail", "mail_headers"], f"SELECT doc_id, {VERIFIED} AS verified, {SUSPICIOUS} AS suspicious FROM header_signals JOIN url_features USING (doc_id)", SIGNALS + URLS_V4))
def suspicious(t):
    links = with_url_features(t.mail.select("doc_id", "text")).select("doc_id", "url_free_hosting_fraction")
    rows = hd.with_header_signals(t.mail_headers).join(links, "doc_id")
    return rows.select("doc_id", hd.verified_sender().alias("verified"), hd.suspicious_sender(F.col("url_free_hosting_fraction")).alias("suspicious"))


LABELLED = [("grouped", "SELECT h.*, CASE WHEN l.toxic = 1 THEN 'phishing' ELSE 'other' END AS grp FROM header_signals h JOIN labels l USING (doc_id)"),
            ("rates", " UNION ALL ".join(f"SELECT grp, '{s}' AS signal, count(*) FILTER ({s}) AS k, count({s}) AS n, round(count(*) FILTER ({s}) / count({s}), 4) AS rate FROM grouped GROUP BY grp" for s in hd.SIGNALS))]


def _labelled(t):
    return hd.with_header_signals(t.mail_headers).join(t.labels, "doc_id").withColumn("grp", F.when(F.col("toxic") == 1, "phishing").otherwise("other"))


@query("h12_signal_rates", with_views(["mail_headers"], "SELECT grp, signal, k, n, rate FROM rates", SIGNALS + LABELLED))
def signal_rates(t):
    return sg.signal_rates(_labelled(t), hd.SIGNALS, "grp").select("grp", "signal", "k", "n", "rate")


@query("h12_recorded_values", with_views(["mail_headers"], " UNION ALL ".join(
    f"SELECT grp, 'recorded_{m}' AS \"column\", coalesce(recorded_{m}, 'missing') AS value, count(*) AS n FROM grouped GROUP BY ALL" for m in lx.AUTH_MECHANISMS), SIGNALS + LABELLED))
def recorded_values(t):
    return sg.value_histogram(_labelled(t), [f"recorded_{m}" for m in lx.AUTH_MECHANISMS], "grp")


@query("h13_promising_signals", with_views(["mail_headers"], """SELECT signal, phishing_rate, other_rate, round(ratio, 2) AS ratio, phishing_rate >= 0.05 AND ratio >= 3 AS promising FROM (
SELECT p.signal, p.rate AS phishing_rate, o.rate AS other_rate, p.rate / greatest(o.rate, 1.0 / greatest(o.n, 1)) AS ratio FROM rates p JOIN rates o ON o.signal = p.signal AND o.grp = 'other' WHERE p.grp = 'phishing') q""", SIGNALS + LABELLED))
def promising(t):
    return sg.promising_signals(sg.signal_rates(_labelled(t), hd.SIGNALS, "grp"), "grp", "phishing", "other")


@query("h14_inbox_filter", with_views(["mail_headers"], r"""SELECT doc_id, contains(header_block, 'X-Apple-Movetofolder: INBOX') AS placed,
 contains(header_block, 'X-Apple-Movetofolder: INBOX') AND regexp_matches(lower(header_block), 'dmarc=pass\b') AS kept FROM mail_headers"""))
def inbox(t):
    return t.mail_headers.select("doc_id", hd.in_inbox(F.col("header_block"), False).alias("placed"), hd.in_inbox(F.col("header_block")).alias("kept"))
