"""Queries of text functions, language test, privacy masks and label normalisation."""

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..functions.html import html_text_native
from ..functions.privacy import mask_numbers, mask_recipients, recipient_variants, redact
from .registry import query
from .rules_sql import quoted, text_list
from .views import with_views

# non-ASCII letters become plain ones where RE2 would see a word edge inside a word
PLAIN = r"regexp_replace(text, '[À-ɏ]', 'z', 'g')"
URL_SQL = r"""(?i)https?://[^\s<>"'')\]]+"""


def _digest(name, sql_expr, fn, view="mail", key="doc_id"):
    """Length and md5 of a text result: whole texts are compared without moving them to the driver."""
    @query(name, with_views([view], f"SELECT {key}, CAST(length(r) AS INTEGER) AS n_chars, md5(r) AS digest FROM (SELECT {key}, {sql_expr} AS r FROM {view}) q"))
    def run(t):
        out = t.view(view).select(key, fn(F.col("text" if view != "html_mail" else "html")).alias("r"))
        return out.select(key, F.length("r").alias("n_chars"), F.md5("r").alias("digest"))


_T7 = rf"regexp_replace(text, '{URL_SQL}', ' URLTOKEN ', 'g')"
_digest("t7_mask_urls", _T7, tx.mask_urls)
_digest("t8_model_text", rf"lower(regexp_replace({_T7}, '(?im)^subject:', ' ', 'g'))", tx.model_tokens_text)
_T3 = (r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n[\s\v]*\n+', chr(10) || chr(10), 'g'), "
       r"'^[\s\v]+|[\s\v]+$', '', 'g')")
_digest("t3_clean_whitespace", _T3, tx.clean_whitespace)
_T10 = (r"regexp_replace(regexp_replace(regexp_replace(text, '\b(?:19|20)\d{2}\s*-\s*\d{1,2}\s*-\s*\d{1,2}\b', ' datetoken ', 'g'), "
        r"'\b\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*(?:\d{4}|\d{2})\b', ' datetoken ', 'g'), '\b(?:19[5-9]\d|20[0-4]\d)\b', ' yeartoken ', 'g')")
_digest("t10_mask_dates", _T10, tx.mask_dates)
_T12 = (rf"lower(trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace({_T7}, "
        r"'<[^<>]{0,500}>', ' ', 'g'), '(?i)&(?:[a-z]+|#\d+);', ' ', 'g'), '(?im)^subject:', ' ', 'g'), '<>', '  '), "
        r"'([^\p{L}\p{N}_\s])', ' \1 ', 'g'), '\s+', ' ', 'g')))")
_digest("t12_format_normalised", _T12, tx.format_normalised_text)
_T2 = (r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![a-z][^>]*>', '', 'g')")
_T2 = rf"""regexp_replace({_T2}, '(?is)<a\b[^>]*\bhref\s*=\s*["''](http[^"'']*)["''][^>]*>', ' \1 ', 'g')"""
_T2 = rf"regexp_replace(regexp_replace({_T2}, '(?i)</(?:p|br|div|tr|li)\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _T2 = f"replace({_T2}, '{_name}', '{_value}')"
_digest("t2_html_text_native", _T2, html_text_native, view="html_mail", key="page_id")


@query("t5_raw_mail_test", with_views(["mail_headers"], f"""SELECT doc_id, true AS raw_headers, false AS raw_text FROM mail_headers"""))
def raw_mail_test(t):
    """A header block is recognised as raw mail, the document text alone is not."""
    blocks = t.mail_headers.select("doc_id", tx.has_mail_headers(F.col("header_block")).alias("raw_headers"))
    texts = t.documents.select("doc_id", tx.has_mail_headers(F.col("text")).alias("raw_text"))
    return blocks.join(texts, "doc_id")


REPLY_LINES = [
    ("cut_mail", r"""SELECT mail_id, regexp_replace(text, '(?i)(?:-\s*){3,}(?:original message|forwarded message|forwarded by[^-\n]*)\s*(?:-\s*){2,}', ' ', 'g') AS text FROM reply_mail"""),
    ("lines", r"""SELECT mail_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT mail_id, string_split(text, chr(10)) AS l FROM cut_mail) q"""),
    ("lines2", r"""SELECT mail_id, i, CASE WHEN i = 0 THEN regexp_replace(line, '(?i)^(\s*(?:subject\s*:)?\s*)(?:(?:re|fwd?)\s*:\s*)+', '\1') ELSE line END AS line FROM lines"""),
    ("marked", r"""SELECT *, regexp_matches(line, '^\s*>') AS quoted, length(line) <= 300 AND regexp_matches(line, '(?i)wrote:\s*$') AS wrote,
   i > 0 AND regexp_matches(line, '(?i)^\s*(?:from|sent|to|cc|date|subject)\s*:') AS header FROM lines2"""),
    ("neighbours", r"""SELECT *, lead(wrote AND NOT quoted) OVER w AS next_wrote, lead(header) OVER w AS next_header, lag(header) OVER w AS prev_header
   FROM marked WINDOW w AS (PARTITION BY mail_id ORDER BY i)"""),
    ("decided", r"""SELECT *, quoted OR wrote OR (prefix(ltrim(line), 'On ') AND coalesce(next_wrote, false))
   OR (header AND (coalesce(next_header, false) OR coalesce(prev_header, false))) AS dropped FROM neighbours"""),
    ("stripped", r"""SELECT mail_id, CASE WHEN trim(coalesce(string_agg(line, '' ORDER BY i) FILTER (NOT dropped AND NOT (i = 0 AND regexp_matches(line, '(?i)^\s*subject:'))), '')) = ''
     THEN string_agg(CASE WHEN i = 0 THEN line ELSE regexp_replace(line, '^\s*(?:>\s*)+', '') END, chr(10) ORDER BY i)
     ELSE string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped) END AS text FROM decided GROUP BY mail_id"""),
    ("clean_reply", r"SELECT mail_id, regexp_replace(text, '\s+$', '') AS text FROM stripped"),
]


@query("t9_strip_reply_structure", with_views(
    ["reply_mail"], "SELECT mail_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM clean_reply", REPLY_LINES))
def strip_reply(t):
    out = t.reply_mail.select("mail_id", tx.strip_reply_structure(F.col("text")).alias("r"))
    return out.select("mail_id", F.length("r").alias("n_chars"), F.md5("r").alias("digest"))


@query("t11_clean_texts", with_views(
    ["reply_mail"], f"SELECT mail_id, CAST(length(r) AS INTEGER) AS n_chars, md5(r) AS digest FROM (SELECT mail_id, {_T10} AS r FROM clean_reply) q", REPLY_LINES))
def clean_texts(t):
    out = t.reply_mail.select("mail_id", tx.clean_text(F.col("text")).alias("r"))
    return out.select("mail_id", F.length("r").alias("n_chars"), F.md5("r").alias("digest"))


@query("t13_subject_line", with_views(["mail"], r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|\n)subject:')
  THEN trim(regexp_extract(text, '(?i)(^|\n)subject:([^\n\r]*)', 2)) END AS subject FROM mail"""))
def subject(t):
    return t.mail.select("doc_id", tx.subject_line(F.col("text")).alias("subject"))


LANGUAGE = [
    ("words", r"SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nl}\p{No}]+'), lambda w: w <> '') AS w FROM documents"),
    ("ratios", "SELECT doc_id, lang, " + ", ".join(
        f"len(list_filter(w, lambda x: list_contains({text_list(sw)}, x))) / greatest(len(w), 1) AS r_{lang}"
        for lang, sw in lx.STOP_WORDS.items()) + " FROM words"),
    ("english_docs", "SELECT *, r_en >= 0.03 AND r_en > greatest(" + ", ".join(f"r_{x}" for x in lx.STOP_WORDS if x != "en") + ") AS english FROM ratios"),
]


@query("t14_language_test", with_views([], "SELECT doc_id, english, " + ", ".join(
    f"round(r_{x}, 6) AS ratio_{x}" for x in lx.STOP_WORDS) + " FROM english_docs", LANGUAGE))
def language_test(t):
    out = tx.with_language_ratios(t.documents.select("doc_id", "text"))
    return out.select("doc_id", "english", *[F.round(f"ratio_{x}", 6).alias(f"ratio_{x}") for x in lx.STOP_WORDS])


@query("t14_english_share", with_views([], """SELECT lang, count(*) AS mails, count(*) FILTER (english) AS english,
round(count(*) FILTER (english) / count(*), 6) AS share FROM english_docs GROUP BY lang""", LANGUAGE))
def english_share(t):
    out = tx.with_language_ratios(t.documents.select("lang", "text"))
    return out.groupBy("lang").agg(F.count("*").alias("mails"), F.count_if("english").alias("english"),
                                   F.round(F.count_if("english") / F.count("*"), 6).alias("share"))


_TAGGED = "concat('Subject: ', CASE WHEN doc_id % 2 = 0 THEN '[Python-announce] ' ELSE '' END, 'x ', text, ' Subject: [Python-announce] y')"


@query("t15_list_tags", with_views([], f"""SELECT doc_id, md5(CASE WHEN strpos(r, 'Subject: [Python-announce] ') > 0 THEN
  substr(r, 1, strpos(r, 'Subject: [Python-announce] ') - 1) || 'Subject: ' || substr(r, strpos(r, 'Subject: [Python-announce] ') + 27) ELSE r END) AS digest
FROM (SELECT doc_id, {_TAGGED} AS r FROM documents) q"""))
def list_tags(t):
    """Only the first tagged subject loses its tag."""
    return t.documents.select("doc_id", F.md5(tx.strip_list_tags(F.expr(_TAGGED))).alias("digest"))


@query("t16_content_keys", r"""SELECT key AS content_key, count(*) AS mails FROM (
SELECT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents) q GROUP BY key""")
def content_keys(t):
    return t.documents.groupBy(tx.content_key(F.col("text")).alias("content_key")).agg(F.count("*").alias("mails"))


@query("t17_case_variants", None)
def case_variants(t):
    return t.documents.select(F.explode(F.array("source", "lang")).alias("term")).distinct().select(
        "term", F.explode(tx.case_variants(F.col("term"))).alias("variant"))


_TEMPLATE_ROWS = ", ".join(f"('{k}', '" + v.replace("'", "''") + "')" for k, v in lx.APPEND_TEMPLATES.items())


@query("t18_append_templates", with_views(["mail"], f"""SELECT doc_id, template, md5(text || suffix) AS digest
FROM mail, (VALUES {_TEMPLATE_ROWS}) v(template, suffix) WHERE label = 1"""))
def append(t):
    out = tx.append_templates(t.mail.where("label = 1").select("doc_id", "text"))
    return out.select("doc_id", "template", F.md5("text").alias("digest"))


_SUBJ = r"""regexp_replace(regexp_replace(CASE WHEN prefix(text, 'Subject:') THEN trim(substr(split_part(text, chr(10) || chr(10), 1), 9)) ELSE '' END,
 '[A-Za-z0-9._%+-]+(?:@| at )[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<email>', 'g'), '(?i)(?:https?://|www\.)\S+', '<link>', 'g')"""
_BODY = r"""CASE WHEN NOT prefix(text, 'Subject:') THEN text WHEN contains(text, chr(10) || chr(10)) THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE '' END"""


@query("t19_public_summary", with_views(["mail"], rf"""SELECT doc_id, 'Subject: ' || CASE WHEN s = '' THEN '(none)'
  WHEN length(s) > 100 THEN rtrim(substr(s, 1, 100)) || '…' ELSE s END || ' [body: ' ||
  length(regexp_replace(b, '^\s+|\s+$', '', 'g')) || ' chars, ' || len(regexp_extract_all(b, '(?i)(?:https?://|www\.)\S+')) || ' links]' AS summary
FROM (SELECT doc_id, {_SUBJ} AS s, {_BODY} AS b FROM mail) q"""))
def summary(t):
    return t.mail.select("doc_id", tx.public_summary(F.col("text")).alias("summary"))


_BRACKETED = "CASE WHEN doc_id % 3 = 0 THEN concat('Dear [Customer Name], ', text) ELSE text END"


@query("t20_link_class", with_views(["mail"], rf"""SELECT links, count(*) AS mails FROM (SELECT CASE WHEN regexp_matches(r, '(?i)https?://\S') THEN 'real link'
 WHEN regexp_matches(r, '\[[^\]]{{2,40}}\]') THEN 'placeholder only' ELSE 'no link' END AS links FROM (SELECT {_BRACKETED} AS r FROM mail) q) p GROUP BY links"""))
def link_class(t):
    return t.mail.groupBy(tx.link_class(F.expr(_BRACKETED)).alias("links")).agg(F.count("*").alias("mails"))


_NAMED_SOURCE = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'kaggle' WHEN 1 THEN 'spamassassin_easy_ham' WHEN 2 THEN 'nazario_older' ELSE source END"


@query("t21_corpus_names", with_views(["mail"], f"""SELECT corpus, count(*) AS mails FROM (SELECT CASE WHEN s = 'kaggle' AND label = 1 THEN 'Kaggle phishing'
 WHEN s = 'kaggle' THEN 'Kaggle legitimate' WHEN prefix(s, 'spamassassin') THEN 'SpamAssassin ham' WHEN prefix(s, 'nazario') THEN 'Nazario 2019–2024'
 ELSE 'Mailing lists 2024' END AS corpus FROM (SELECT label, {_NAMED_SOURCE} AS s FROM mail WHERE label IS NOT NULL) q) p GROUP BY corpus"""))
def corpus_names(t):
    rows = t.mail.where("label IS NOT NULL").withColumn("s", F.expr(_NAMED_SOURCE))
    return rows.groupBy(tx.corpus_of(F.col("s"), F.col("label")).alias("corpus")).agg(F.count("*").alias("mails"))


_RAW_LABEL = "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN ' Phishing Email ' WHEN 1 THEN 'HAM' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN 'False' ELSE '' END"


@query("s1_label_synonyms", f"""SELECT raw, CAST(CASE WHEN trim(lower(raw)) IN ({quoted(lx.POSITIVE_LABELS)}) THEN 1
 WHEN trim(lower(raw)) IN ({quoted(lx.NEGATIVE_LABELS)}) THEN 0 END AS INTEGER) AS label, count(*) AS mails
FROM (SELECT {_RAW_LABEL} AS raw FROM documents) q GROUP BY ALL""")
def label_synonyms(t):
    rows = t.documents.select(F.expr(_RAW_LABEL).alias("raw"))
    return rows.groupBy("raw", tx.normalised_label(F.col("raw")).alias("label")).agg(F.count("*").alias("mails"))


_FILE = "concat(source, '-users-20', CAST(10 + doc_id % 5 AS STRING), '-0', CAST(1 + doc_id % 9 AS STRING), '.mbox')"


@query("s6_source_from_file_name", f"""SELECT 'osgeo_' || regexp_split_to_array(f, '-20[0-9][0-9]-')[1] AS source,
 'apache_' || array_to_string(string_split(f, '-')[1:2], '-') AS list, count(*) AS files FROM (SELECT {_FILE} AS f FROM documents) q GROUP BY ALL""")
def source_from_file_name(t):
    f = F.expr(_FILE)
    return t.documents.groupBy(tx.source_from_file_name(f, "osgeo_").alias("source"),
                               tx.project_and_list(f, "apache_").alias("list")).agg(F.count("*").alias("files"))


_PERSONAL = "concat(text, ' monkeys jose@monkey.org Monkey phishing@pot')"


@query("p1_recipient_scrub", rf"""SELECT doc_id, md5(regexp_replace(regexp_replace({_PERSONAL}, '(?i)jose(@monkey\.org)?|monkey\.org|\bmonkey\b', '', 'g'), '(?i)phishing@pot', '', 'g')) AS digest FROM documents""")
def recipient_scrub(t):
    return t.documents.select("doc_id", F.md5(tx.strip_anonymiser(tx.strip_recipient(F.expr(_PERSONAL)))).alias("digest"))


@query("p2_redaction", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])(?i:verify|contact|invoice)($|[^\p{L}\p{N}_])', '\1\2', 'g'),
 '(^|[^\p{L}\p{N}_])(?i:verify|contact|invoice)($|[^\p{L}\p{N}_])', '\1\2', 'g')) AS digest
FROM (""" + with_views(["mail"], "SELECT * FROM mail") + ") m")
def redaction(t):
    return t.mail.select("doc_id", F.md5(redact(F.col("text"), ["verify", "contact", "invoice"])).alias("digest"))


@query("p3_recipient_variants", with_views(["mail_headers"], """SELECT doc_id, unnest(list_distinct([a, replace(a, '@', '%40'), replace(a, '@', '%2540'),
 rtrim(to_base64(encode(a)), '='), translate(rtrim(to_base64(encode(a)), '='), '+/', '-_'), split_part(a, '@', 1)])) AS variant
FROM (SELECT doc_id, 'user' || (doc_id % 97) || '@example.net' AS a FROM mail_headers) q"""))
def variants(t):
    return t.mail_headers.select("doc_id", F.explode(recipient_variants(F.col("header_block"))).alias("variant"))


_SPOILED = "concat(text, ' write to user', CAST(doc_id % 97 AS STRING), '@example.net or 4111 1111 1111 1111, id 12345678901 https://a.example/12345678901?u=', CAST(doc_id AS STRING))"


@query("p4_personal_masks", None)
def personal_masks(t):
    """Recipients and numbers outside links; checked row by row against the standard library in the tests."""
    rows = t.mail.withColumn("text", F.expr(_SPOILED)).join(t.mail_headers, "doc_id")
    out = rows.select("doc_id", F.length("text").alias("n_before"),
                      mask_numbers(mask_recipients(F.col("text"), F.col("header_block"))).alias("r"))
    return out.select("doc_id", "n_before", F.length("r").alias("n_after"), F.md5("r").alias("digest"))


@query("p5_subject_masks", with_views(["mail"], rf"""SELECT doc_id, regexp_replace(regexp_replace(s, '[A-Za-z0-9._%+-]+(?:@| at )[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}', '<email>', 'g'),
 '(?i)(?:https?://|www\.)\S+', '<link>', 'g') AS masked FROM (SELECT doc_id, split_part(text, chr(10), 1) || ' x at example.org www.y.example' AS s FROM mail) q"""))
def subject_masks(t):
    first = F.concat(F.substring_index("text", "\n", 1), F.lit(" x at example.org www.y.example"))
    return t.mail.select("doc_id", tx.mask_addresses(first).alias("masked"))
