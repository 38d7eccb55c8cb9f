"""Rule engine and features on hand-made mails."""

import math
import re

from pyspark.sql import functions as F

from mailgrain import lexicons as lx
from mailgrain.functions.features import feature_names, with_features, with_url_features
from mailgrain.functions.rules import caps_ratio, with_rules
from mailgrain.functions.urls import (brand_in_foreign_domain, host_of, inspect_url, is_free_hosting, is_ip_host, is_shortener,
                                      registered_domain)


def scored(rows, *texts):
    return with_rules(rows(texts)).orderBy("id").collect()


def values(spark, items, fn):
    df = spark.createDataFrame(list(enumerate(items)), "i int, v string")
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_plain_note_is_low(rows):
    (r,) = scored(rows, "Lunch at noon?")
    assert (r.score, r.risk, r.details, r.urls) == (0, "LOW", [], [])


def test_words_count_by_boundary_and_phrases_by_substring(rows):
    (r,) = scored(rows, "Clicked twice, click once. Wire transfer! accountant account_x gift cards")
    assert r.keyword_hits == {"click": 1, "wire transfer": 1, "gift card": 1}
    assert r.keyword_score == 24


def test_accented_letters_belong_to_words(rows):
    a, b = scored(rows, "éclick", "click é")
    assert a.keyword_hits == {} and b.keyword_hits == {"click": 1}


def test_keyword_cap(rows):
    (r,) = scored(rows, "verify " * 20)
    assert r.keyword_score == 45


def test_broken_port_is_flagged_not_fatal(rows):
    (r,) = scored(rows, "see http://mail.example.com:27000To/x.")
    (u,) = r.urls
    assert u.host == "mail.example.com" and "Invalid port in URL" in u.issues and u.issue_score == 8


def test_repeated_links_count_once_after_trimming(rows):
    (r,) = scored(rows, "https://a.example/1. https://a.example/1, https://a.example/2)")
    assert [u.url for u in r.urls] == ["https://a.example/1", "https://a.example/2"]


def test_inspection_table(spark):
    cases = {
        "http://10.0.0.1/x": 25, "https://u@h.example/": 15, "https://bit.ly/a": 10, "https://sub.t.co/a": 10, "https://t.com/": 0,
        "https://a12345.example/": 6, "https://h.example:8443/": 8, "https://h.example:443/": 0, "https://h.example:0/": 0,
        "https://h.example:/": 0, "https://h.example:99999/": 8, "https:///x": 10, "http://[bad/x": 10,
        "https://h.example/" + "p" * 90: 5, "https://" + "h" * 61 + ".example/": 8, "https://h.example/a;" + "p" * 90: 0,
    }
    got = values(spark, list(cases), lambda c: inspect_url(c)["issue_score"])
    assert dict(zip(cases, got)) == cases


def test_domain_points_per_link_but_warnings_distinct(rows):
    (r,) = scored(rows, "https://x.tk/1 https://x.tk/2")
    assert r.domain_warnings == ["x.tk: suspicious TLD (.tk)"] and r.url_score == 2 * (5 + 5)


def test_ip_needs_to_stand_alone(rows):
    a, b, c, d = scored(rows, "host 192.168.1.9 up", "version 1.2.3.4.5", "at 10.0.0.1.", "999.1.1.1")
    assert a.ips == ["192.168.1.9"] and a.ip_score == 20
    assert b.ips == c.ips == d.ips == []


def test_subject_rules(rows):
    a, b, c = scored(rows, "Subject: FINAL NOTICE!!!\n\nhi", "x\nsubject: calm", "Subject:\n\nbody")
    assert a.subject_score == 33 and a.subject == "FINAL NOTICE!!!"
    assert b.subject == "calm" and b.subject_score == 0
    assert c.subject == "" and c.subject_score == 0


def test_shouting_punctuation_attachments_blob(rows):
    a, b, c, d, e = scored(rows, "THIS MUST STOP", "a!!! b!!!", "$$$$$", "open the attachment now: run.exe", "Q" * 80)
    assert (a.shouting_score, b.punctuation_score, c.punctuation_score, d.attachment_score, e.blob_score) == (12, 8, 6, 28, 10)


def test_free_mail_rules(rows):
    a, b, c = scored(rows, "your bank: me@gmail.com you@gmail.com z@yahoo.com", "amazon offer a@gmail.com b@gmail.com", "a@gmail.com hello")
    assert (a.address_score, b.address_score, c.address_score) == (25, 8, 0)
    assert len(a.details) == 3 and len(b.details) == 1


def test_custom_keywords(rows):
    (r,) = with_rules(rows(["Budget meeting"]), keywords=["BUDGET"]).collect()
    assert r.keyword_hits == {"budget": 1}


def test_host_helpers(spark):
    assert values(spark, ["a.b.paypal.com", "x.amazon.co.uk", "localhost", ".", "a..b.com."], registered_domain) == [
        "paypal.com", "amazon.co.uk", "localhost", "", "b.com"]
    assert values(spark, ["paypal.com.evil.xyz", "pay.paypal.com", "purchase.example.org", "microsoft-verify.net", "login.live.com"], brand_in_foreign_domain) == [
        True, False, False, True, False]
    assert values(spark, ["x.github.io", "github.io", "mygithub.io", "b.s3.us-east-2.amazonaws.com", "s3-eu-west-1.amazonaws.com"], is_free_hosting) == [
        True, True, False, True, True]
    assert values(spark, ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3"], is_ip_host) == [True, False, True, False]
    assert values(spark, ["bit.ly", "x.bit.ly", "rabbit.ly"], is_shortener) == [True, True, False]
    assert values(spark, ["http://U@A.example:80/", "https://a:b@c.example/", "http://a@b@c.example"], host_of) == ["a.example", "c.example", "c.example"]


def test_many_clean_links_leave_fractions_alone(rows):
    links = " ".join(f"https://lists.example.org/{i}" for i in range(40))
    few, many = with_features(rows(["https://lists.example.org/0", links])).orderBy("id").collect()
    for name in ("http_url_fraction", "suspicious_url_fraction", "domain_warning_fraction", "max_url_issue_score"):
        assert few[name] == many[name] == 0.0
    assert math.isclose(many.url_count_log, math.log1p(40))


def test_feature_versions(rows):
    for version, size in ((1, 14), (2, 16), (3, 22), (4, 30)):
        df = with_features(rows(["Subject: hi\n\nshort"]), version)
        assert df.columns == ["id", "text"] + feature_names(version) and len(feature_names(version)) == size
        assert all(v is not None for v in df.first())


def test_url_features_skip_ip_hosts(rows):
    a, b = with_url_features(rows(["http://10.1.1.1/x%20y", "https://a-b.c.example.org/?u=https://z.example https://a-b.c.example.org/"])).orderBy("id").collect()
    assert list(a)[2:] == [0.0] * 8
    assert b.url_redirect_param == 1.0 and b.url_max_subdomain_depth == 0.5 and b.url_max_host_hyphens == 0.25
    assert math.isclose(b.url_distinct_domains_log, math.log1p(1))


def test_rule_patterns_by_brute_force(rows):
    """Keyword edges, capitals, base64 blocks and bait words on texts of many short pieces."""
    import random
    draw = random.Random(3)
    pieces = ["verify", "Verify", "verifyé", "_login", "login", "LOGIN", "ABCD", "ABCDe", "éABCD", "a@gmail.com", "bank", "A" * 79, "A" * 81, " ", ".", "/", "1", "see attached", "DocuSign", "document ready", "!!!", "$$$$$"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 7))) for _ in range(300)] + ["a\U0001f600verify\nABCD\nABCDEF"]
    out = with_rules(rows(texts)).select("id", "keyword_hits", "blob_score", "address_score").collect()
    lure = {r.id: r.lure_attachment_pretext for r in with_features(rows(texts), 3).select("id", "lure_attachment_pretext").collect()}
    caps = {r.id: r.c for r in rows(texts).select("id", caps_ratio(F.col("text"))[1].alias("c")).collect()}
    for r in out:
        text, low = texts[r.id], texts[r.id].lower()
        for term in ("verify", "login", "password"):
            assert r.keyword_hits.get(term, 0) == sum(t == term for t in re.split(r"[\W]+", low)), text
        assert (r.blob_score > 0) == bool(re.search(r"[A-Za-z0-9+/]{80,}={0,2}", text))
        n = len(re.findall(r"[A-Za-z]{4,}", text))
        assert caps[r.id] == (len(re.findall(r"(?<![A-Za-z])[A-Z]{4,}(?![A-Za-z])", text)) / n if n else 0.0), text
        assert abs(lure[r.id] - math.log1p(len(re.findall(lx.LURE_PATTERNS["attachment_pretext"], text, re.I | re.A)))) < 1e-12, text


def test_keyword_totals_count_every_text_once(spark):
    """No inferred filter repeats the counts of all keywords below the rows of the terms."""
    from mailgrain import catalog
    plan = catalog.QUERIES["j13_keyword_dimension"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 1
