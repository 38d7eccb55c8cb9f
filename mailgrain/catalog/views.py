"""Derived test views over the driver's tables, in SQL that Spark and DuckDB both run.

Whole texts, whole tables: every document becomes one mail whose body is the complete document.
"""

import re

from ..sources.tables import read_parquet

VIEWS = {
    "mail": """
SELECT doc_id, source, lang, toxic AS label,
  CASE WHEN subject IS NULL THEN concat(lure, ' ', body)
       ELSE concat('Subject: ', subject, chr(10), chr(10), lure, chr(10), body) END AS text
FROM (SELECT d.doc_id, d.source, d.lang, l.toxic, d.text AS body,
  CASE CAST(d.doc_id % 5 AS INT)
    WHEN 0 THEN 'ACTION REQUIRED FINAL NOTICE' WHEN 1 THEN concat('Re: notes ', CAST(d.doc_id AS STRING))
    WHEN 2 THEN 'Weekly summary' WHEN 3 THEN 'Is this yours???' ELSE NULL END AS subject,
  CASE CAST(d.doc_id % 12 AS INT)
    WHEN 0 THEN 'Please VERIFY your password and login to the account at http://10.20.30.40/secure/login?user=a@bank.example'
    WHEN 1 THEN 'Dear customer, account SUSPENDED: click http://paypa1-secure-login-desk.tk/verify to confirm your login!!! Act now!!!'
    WHEN 2 THEN 'Your invoice is ready, enable macros and open the attachment pay.exe. Wire transfer today.'
    WHEN 3 THEN 'See https://bit.ly/x9 and http://shop.example.com:8080/a and https://a.b.c.d.example.org/x%20y?next=https%3A%2F%2Fz.example.com.'
    WHEN 4 THEN concat('Quarterly notes are at ', coalesce(p.url, concat('https://files.example.com/', CAST(d.doc_id AS STRING))))
    WHEN 5 THEN 'CONTACT apple support at help.desk@gmail.com NOW TODAY PLEASE HURRY ABOUT YOUR TAXES'
    WHEN 6 THEN 'Releases: https://example.org/1 https://example.org/2 https://example.org/3 https://example.org/4, https://example.org/1.'
    WHEN 7 THEN 'Win $$$$$ in the lottery??? Why wait??? Claim bitcoin'
    WHEN 8 THEN 'Mirrors: https://paypal.com.secure-verify.xyz/a https://bucket.s3.us-east-2.amazonaws.com/f https://xn--pple-43d.example.net/'
    WHEN 9 THEN repeat('QUJD', 30)
    WHEN 10 THEN 'Meeting moved to 12/16/2024; see server 172.16.5.9 (build 2024-03-01).'
    ELSE concat('Reminder from ', coalesce(p.url, 'https://user@mail.example.com/inbox'), ' http://host.example.com:27000To/x http://[broken/y http:///none') END AS lure
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
 LEFT JOIN pages p ON p.page_id = d.doc_id) q""",
    "scored": """
SELECT l.doc_id, d.source, d.lang, l.toxic AS label, CAST(l.doc_id % 5 AS INT) AS fold,
  CAST(round(0.35 * l.toxic + 0.65 * ((l.doc_id * 7919 + 13) % 1000) / 1000.0, 6) AS DOUBLE) AS score_a,
  CAST(round(0.45 * l.toxic + 0.55 * ((l.doc_id * 104729 + 7) % 1000) / 1000.0, 6) AS DOUBLE) AS score_b
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "reply_mail": """
SELECT conv_id * 1000 + turn AS mail_id,
  CASE WHEN prev IS NULL THEN concat('Subject: Topic ', CAST(conv_id AS STRING), chr(10), chr(10), body)
       WHEN CAST(turn % 3 AS INT) = 1 THEN concat('Subject: Re: Topic ', CAST(conv_id AS STRING), chr(10), chr(10), body, chr(10), chr(10),
            'On Mon, Jan 6, 2025 at 9:00 AM Kim <kim@example.org> wrote:', chr(10), '> ', prev)
       WHEN CAST(turn % 3 AS INT) = 2 THEN concat('Subject: Fwd: Re: Topic ', CAST(conv_id AS STRING), chr(10), chr(10), body, chr(10),
            '-----Original Message-----', chr(10), 'From: Kim', chr(10), 'Sent: 2025-01-06', chr(10), 'To: All', chr(10), chr(10), prev)
       ELSE concat('Subject: Re: Topic ', CAST(conv_id AS STRING), chr(10), chr(10), '> ', prev) END AS text
FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS body,
        replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), chr(10), ' ') AS prev
      FROM conversations) q""",
    "mail_headers": """
SELECT doc_id, concat(
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'From: Shop <news@mail.shop.example.co.uk>' WHEN 1 THEN 'From: PayPal <service@gmail.com>'
    WHEN 2 THEN 'From: a@paypal-secure.example' ELSE 'From: Lists <bot@lists.example.org>' END, chr(10),
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('Return-Path: <bounce@em.shop.example.co.uk>', chr(10))
    WHEN 1 THEN concat('Return-Path: <x@bulk.sender.example>', chr(10)) ELSE '' END,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('DKIM-Signature: v=1; a=rsa-sha256; d=shop.example.co.uk; s=k1; b=abc', chr(10))
    WHEN 1 THEN concat('DKIM-Signature: v=1; d=sendgrid.net; s=s1; b=abc', chr(10)) WHEN 2 THEN concat('DKIM-Signature: v=1; d=paypal-secure.example; b=q', chr(10)) ELSE '' END,
  CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('Authentication-Results: mx.test; spf=softfail; dkim=pass; dmarc=fail', chr(10))
    WHEN 2 THEN concat('Authentication-Results: mx.test; spf=pass', chr(10), 'Authentication-Results: older.test; spf=fail; dmarc=fail', chr(10))
    ELSE concat('Authentication-Results: mx.test; spf=pass smtp.mailfrom=x; dkim=pass; dmarc=pass', chr(10)) END,
  CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN concat('Reply-To: help@evil.example', chr(10)) WHEN 1 THEN concat('Reply-To: bot@lists.example.org', chr(10)) ELSE '' END,
  CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('X-Apple-Movetofolder: Junk', chr(10)) ELSE concat('X-Apple-Movetofolder: INBOX', chr(10)) END,
  'To: user', CAST(doc_id % 97 AS STRING), '@example.net', chr(10)) AS header_block
FROM documents""",
    "html_mail": """
SELECT page_id, concat(html, CASE CAST(page_id % 6 AS INT)
  WHEN 0 THEN '<a href="http://evil.example/a">https://www.paypal.com/signin</a><form action="x"><input type="password"></form>'
  WHEN 1 THEN '<div style="display:none">This preheader text stays hidden from view</div><img src="a.png">'
  WHEN 2 THEN '<a href="https://shop.example/x">shop.example</a><meta http-equiv="refresh" content="0">'
  WHEN 3 THEN '<a href="javascript:void(0)">open</a><a href="https://docs.example.org/y">dropbox file</a>'
  WHEN 4 THEN '<img src="b.png"><p hidden>nope</p>' ELSE '' END) AS html,
  CASE WHEN page_id % 2 = 0 THEN 'plain part' ELSE '' END AS plain
FROM pages""",
}

BASE_TABLES = ("documents", "labels", "pages", "conversations", "benchmark", "events")


HEAVY_TEXT = ("documents", "pages", "conversations")


class Tables:
    """Lazy access to the Parquet tables and the derived views of one scale-factor folder."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.folder = folder

    def table(self, name):
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet", spread=name in HEAVY_TEXT)

    def view(self, name):
        sql = VIEWS[name]
        used = {t: self.table(t) for t in BASE_TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
        return self.spark.sql(_with_placeholders(sql, used), **used)

    def __getattr__(self, name):
        if name in VIEWS:
            return self.view(name)
        return self.table(name)


def _with_placeholders(sql, used):
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def with_views(names, body, extra=()):
    """DuckDB text: the named views and any extra (name, sql) pairs as CTEs, then the body."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in extra]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
