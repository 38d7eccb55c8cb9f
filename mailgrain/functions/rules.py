"""The transparent rule engine: keyword, link, IP, subject, style, attachment and sender rules.

`with_rules` stages the work as a chain of projections, so Catalyst evaluates every shared piece
(lower-cased text, tokens, links) once and prunes whatever the caller does not select. There is no
shuffle: each mail is scored on its own.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from .base import WORD, WORD_EDGE_RIGHT, literal_array, points, present, ratio, total
from .text import subject_line
from .urls import extract_urls, inspect_domain, inspect_url, is_ip_host

RULE_COLUMNS = (
    "keyword_hits", "keyword_score", "urls", "url_score", "domain_warnings", "ips", "ip_score", "subject",
    "subject_score", "shouting_score", "punctuation_score", "attachment_score", "address_score",
    "blob_score", "many_links_score", "details", "score", "risk",
)


def keyword_hits(lowered: Column, keywords=lx.KEYWORDS) -> Column:
    """Map term -> count for the terms that occur: words by word boundary, phrases by substring.

    A text is only searched by pattern for terms it contains; a pattern that begins with the term skips most of the text."""
    terms = list(dict.fromkeys(k.lower() for k in keywords))
    counts = []
    for term in terms:
        edges = ""
        if " " not in term:
            edges = WORD_EDGE_RIGHT if re.search(r"\w$", term) else ""
            edges += f"(?<![{WORD}]{re.escape(term)})" if re.match(r"\w", term) else ""
        counts.append(F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(re.escape(term) + edges))).otherwise(0))
    every = F.map_from_arrays(literal_array(terms), F.array(*counts))
    return F.map_filter(every, lambda _, n: n > 0)


def text_ips(text: Column) -> Column:
    """Dotted quads that stand alone, distinct, in text order."""
    runs = F.regexp_extract_all(text, F.lit(r"[0-9.]+"), 0)
    return F.array_distinct(F.filter(runs, lambda r: r.rlike(rf"^(?:{lx.IP_OCTET}\.){{3}}{lx.IP_OCTET}$")))


def caps_ratio(text: Column) -> tuple[Column, Column]:
    """(number of words of at least four letters, share of them in capitals)."""
    words = F.regexp_count(text, F.lit(r"[A-Za-z]{4,}"))
    capital = F.regexp_count(text, F.lit(r"[A-Z](?<![A-Za-z].)[A-Z]{3,}+(?![A-Za-z])"))  # the letter first: cheaper than to look behind everywhere
    return words, ratio(capital, words)


def risk_level(score: Column) -> Column:
    out = None
    for floor, name in lx.RISK_BANDS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(lx.LOWEST_RISK)


def rule_verdict(score: Column) -> Column:
    return score >= lx.RULE_VERDICT_SCORE


def with_rules(df: DataFrame, text: str = "text", keywords=lx.KEYWORDS) -> DataFrame:
    """Add the rule columns (`RULE_COLUMNS`) to every row of `df`."""
    t = F.col(text)
    words, caps = caps_ratio(t)
    out = df.withColumns({
        "_low": F.lower(t),
        "_urls": extract_urls(t),
        "_text_ips": text_ips(t),
        "subject": subject_line(t),
        "_n_words": words,
        "_caps": caps,
    })
    low = F.col("_low")
    out = out.withColumns({
        "urls": F.transform("_urls", inspect_url),
        "_emails": F.when(~low.contains("@"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(low, F.lit(lx.EMAIL_PATTERN), 0)),
    })
    out = out.withColumns({
        "keyword_hits": keyword_hits(low, keywords),
        "_warnings": F.transform("urls", lambda u: F.struct(
            u["host"].alias("host"), inspect_domain(u["host"]).alias("messages"))),
        "_free": F.filter(F.col("_emails"), lambda e: F.get(F.split(e, "@"), F.lit(1)).isin(list(lx.FREE_MAIL_DOMAINS))),
    })

    hits = F.aggregate(F.map_values("keyword_hits"), F.lit(0), lambda a, b: a + b)
    warning_count = F.aggregate("_warnings", F.lit(0), lambda a, w: a + F.size(w["messages"]))
    link_points = F.aggregate("urls", F.lit(0), lambda a, u: a + u["scheme_score"] + u["issue_score"])
    ip_hosts = F.transform(F.filter("urls", lambda u: is_ip_host(u["host"])), lambda u: u["host"])

    subject = F.col("subject")
    letters = F.regexp_count(subject, F.lit(r"\p{L}"))
    capital_subject = (letters > 5) & (F.regexp_count(subject, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1)) > 0.7)
    loud_subject = subject.contains("!!!") | subject.contains("???")
    pressure = F.get(F.filter(literal_array(lx.PRESSURE_PHRASES), lambda p: F.contains(F.lower(subject), p)), F.lit(0))

    bangs = (F.regexp_count(t, F.lit("!!!")) >= 2) | (F.regexp_count(t, F.lit(r"\?\?\?")) >= 2)
    dollars = F.length(t) - F.length(F.replace(t, F.lit("$"), F.lit(""))) >= 5
    shouting = (F.col("_n_words") >= 3) & (F.col("_caps") > 0.35)
    risky = [(low.contains(x), f"Mentions risky attachment type: {x}", 18) for x in lx.RISKY_EXTENSIONS]
    risky += [(low.contains(x), f'Attachment bait phrase: "{x}"', 10) for x in lx.BAIT_PHRASES]
    from_free = lambda words: F.when(F.size("_free") > 0, low.rlike("|".join(words))).otherwise(False)  # the text is searched only then
    institution, brand_sender = from_free(lx.INSTITUTION_WORDS), from_free(lx.SENDER_BRAND_WORDS)
    blob = t.rlike(r"[A-Za-z0-9+/](?<![A-Za-z0-9+/].)[A-Za-z0-9+/]{79}")

    out = out.withColumns({
        "keyword_score": F.least(hits * lx.KEYWORD_POINTS, F.lit(lx.KEYWORD_CAP)),
        "url_score": link_points + warning_count * lx.DOMAIN_WARNING_POINTS,
        "domain_warnings": F.array_distinct(F.flatten(F.transform("_warnings", lambda w: F.transform(
            w["messages"], lambda m: F.concat(w["host"], F.lit(": "), m))))),
        "ips": F.array_distinct(F.concat("_text_ips", ip_hosts)),
        "ip_score": points(F.size("_text_ips") > 0, lx.TEXT_IP_POINTS),
        "_subject_caps": F.coalesce(capital_subject, F.lit(False)),
        "_subject_loud": F.coalesce(loud_subject, F.lit(False)),
        "_pressure": pressure,
        "shouting_score": points(shouting, 12),
        "punctuation_score": F.when(bangs, 8).when(dollars, 6).otherwise(0),
        "attachment_score": F.least(total([points(c, v) for c, _, v in risky]), F.lit(35)),
        "_attachment_notes": F.array_join(present(*[F.when(c, m) for c, m, _ in risky]), "; "),
        "_institution": institution,
        "_brand_sender": ~institution & brand_sender,
        "blob_score": points(blob, 10),
        "many_links_score": points(F.size("urls") >= 4, 12),
    })
    out = out.withColumns({
        "subject_score": points(F.col("_subject_caps"), 15) + points(F.col("_subject_loud"), 10)
        + points(F.col("_pressure").isNotNull(), 8),
        "address_score": F.least(F.when(F.col("_institution"), F.size("_free") * 12)
                                 .when(F.col("_brand_sender"), 8).otherwise(0), F.lit(25)),
        "details": F.concat(
            present(
                F.when(F.col("_subject_caps"), "Subject is mostly ALL CAPS"),
                F.when(F.col("_subject_loud"), "Subject has excessive punctuation"),
                F.when(F.col("_pressure").isNotNull(),
                       F.concat(F.lit('Subject contains pressure phrase: "'), F.col("_pressure"), F.lit('"'))),
                F.when(F.col("shouting_score") > 0, "Lots of ALL CAPS words in body"),
                F.when(F.col("punctuation_score") == 8, "Repeated !!! or ??? in message"),
                F.when(F.col("punctuation_score") == 6, "Many dollar signs (common in scam templates)"),
                F.when(F.col("attachment_score") > 0, F.col("_attachment_notes")),
            ),
            F.when(F.col("_institution"), F.transform("_free", lambda e: F.concat(
                F.lit("Free email domain but message mentions institution: "), e)))
            .otherwise(F.array().cast("array<string>")),
            present(
                F.when(F.col("_brand_sender"), "Brand name in text but sender-style email is free provider"),
                F.when(F.col("blob_score") > 0, "Long base64-like block found (could hide content)"),
                F.when(F.col("many_links_score") > 0, F.concat(
                    F.lit("Many links in one message ("), F.size("urls").cast("string"), F.lit(")"))),
            ),
        ),
    })
    parts = ["keyword_score", "url_score", "ip_score", "subject_score", "shouting_score", "punctuation_score",
             "attachment_score", "address_score", "blob_score", "many_links_score"]
    out = out.withColumn("score", total([F.col(p) for p in parts]))
    out = out.withColumn("risk", risk_level(F.col("score")))
    return out.select(*df.columns, *RULE_COLUMNS)
