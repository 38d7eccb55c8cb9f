"""Text, HTML, header and privacy functions; masks are checked against the standard library."""

import base64
import re
from urllib.parse import quote

from pyspark.sql import functions as F

from mailgrain import lexicons as lx
from mailgrain.functions import headers as hd
from mailgrain.functions import html as ht
from mailgrain.functions import privacy as pv
from mailgrain.functions import text as tx


def apply(rows, texts, fn):
    return [r.r for r in rows(texts).select("id", fn(F.col("text")).alias("r")).orderBy("id").collect()]


def test_reply_structure(rows):
    texts = [
        "Subject: Re: Fwd: plan\n\nFine by me.\n\nOn Monday Kim <k@x.example> wrote:\n> old text\n> more",
        "> everything\n> is quoted",
        "From: me\nTo: you\nreal body",
        "Body\n-----Original Message-----\nFrom: a\nSent: b\nTo: c\n\nforwarded words stay",
        "a\nDate: today\nb",
    ]
    assert apply(rows, texts, tx.strip_reply_structure) == [
        "Subject: plan\n\nFine by me.", "> everything\nis quoted", "From: me\nTo: you\nreal body",
        "Body\n\nforwarded words stay", "a\nDate: today\nb"]


def test_dates(rows):
    assert apply(rows, ["on 2024-03-01 and 12/16/24 in 2023", "id 120241 x2024x"], tx.mask_dates) == [
        "on  datetoken  and  datetoken  in  yeartoken ", "id 120241 x2024x"]


def test_normalisation(rows):
    assert apply(rows, ["Subject: Hi\nSee https://a.example/x now"], tx.model_tokens_text) == ["  hi\nsee  urltoken  now"]
    assert apply(rows, ["<b>A.B</b> &amp; <x"], tx.format_normalised_text) == ["a . b x"]
    assert apply(rows, [" a \t b\r\n \n\n c "], tx.clean_whitespace) == ["a b \n\n c"]


def test_content_key_ignores_case_and_blanks(rows):
    a, b, c = apply(rows, ["A  b\nC", "a B c ", "a b d"], tx.content_key)
    assert a == b != c


def test_language(rows):
    texts = ["the cat and you are in this house with our dog", "le chat et la maison dans une ville avec nous", "zzz qqq"]
    out = tx.with_language_ratios(rows(texts)).orderBy("id").collect()
    assert [r.english for r in out] == [True, False, False]


def test_summary_never_shows_the_body(rows):
    (s,) = apply(rows, ["Subject: mail bob@x.example at www.y.example\n\nsecret https://z.example"], tx.public_summary)
    assert s == "Subject: mail <email> at <link> [body: 24 chars, 1 links]"


def test_html_exact_and_native_agree_on_plain_markup(spark):
    html = ['<p>Hello <b>you</b></p><a href="https://x.example/a">go</a><br></br>', "<style>p{}</style><div>A &amp; B</div><script>x()</script>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "id int, html string")
    out = df.select("id", ht.html_text(F.col("html")).alias("e"), ht.html_text_native(F.col("html")).alias("n")).orderBy("id").collect()
    assert [r.e for r in out] == [r.n for r in out]
    assert out[0].e.startswith("Hello you\n https://x.example/a go")


def test_html_signals(spark):
    html = [
        '<div style="display:none">This text is hidden from everybody</div><img src=x>',
        '<a href="http://evil.example/a">www.paypal.com</a><form><input type=password></form>',
        '<a href="https://shop.example/x">shop.example</a><meta http-equiv="refresh">',
        '<a href="https://docs.example.org/">your dropbox file</a><a href="javascript:x">y</a>',
    ]
    df = spark.createDataFrame([(i, h, "") for i, h in enumerate(html)], "id int, html string, plain string")
    a, b, c, d = ht.with_html_signals(df).orderBy("id").collect()
    assert a.hidden_text and a.image_heavy and a.html_only
    assert b.link_text_domain_mismatch and b.form and b.password_input and not b.hidden_text
    assert c.meta_refresh and not c.link_text_domain_mismatch
    assert d.brand_text_foreign_link and d.script_or_data_link


BLOCK = ("From: Shop <n@mail.shop.example.co.uk>\nReturn-Path: <b@other.example>\nDKIM-Signature: v=1;\n d=shop.example.co.uk; s=a\n"
         "Authentication-Results: mx; spf=pass; dmarc=fail\nAuthentication-Results: old; dmarc=pass; dkim=pass\nReply-To: a@x.example, b@shop.example.co.uk\nTo: Al <al.long@x.example>\n")


def test_header_signals(spark):
    df = spark.createDataFrame([(BLOCK,), ("From: a@b.example\n",)], "header_block string")
    a, b = hd.with_header_signals(df).orderBy(F.length("header_block").desc()).collect()
    assert (a.recorded_spf, a.recorded_dkim, a.recorded_dmarc) == ("pass", "pass", "fail")
    assert not a.dkim_not_aligned and a.return_path_not_aligned and a.reply_to_other_domain and not a.no_auth_results
    assert b.no_auth_results and b.dmarc_not_pass is None and b.dkim_not_aligned and not b.reply_to_other_domain


def test_recipient_variants(spark):
    df = spark.createDataFrame([(BLOCK,)], "header_block string")
    got = set(df.select(pv.recipient_variants(F.col("header_block")).alias("v")).first().v)
    a = "al.long@x.example"
    code = base64.b64encode(a.encode()).decode().rstrip("=")
    assert got == {a, quote(a, safe=""), quote(quote(a, safe=""), safe=""), code, code.replace("+", "-").replace("/", "_"), "al.long"}


def test_number_masks_match_the_standard_library(rows):
    texts = ["call +90 532 123 45 67 or 4111-1111-1111-1111", "id 1234567890123 https://a.example/1234567890123 x", "**** 1234 and +1 (415) 555-2671 ok", "12345 stays"]

    def brute(text):
        parts, last = [], 0
        mask = lambda s: re.sub(lx.LONG_NUMBER_PATTERN, "", re.sub(lx.CARD_PATTERN, "", re.sub(lx.PHONE_PATTERN, "", s)))
        for m in re.finditer(lx.URL_PATTERN, text, re.I):
            parts += [mask(text[last:m.start()]), m.group(0)]
            last = m.end()
        return "".join(parts + [mask(text[last:])])

    assert apply(rows, texts, pv.mask_numbers) == [brute(x) for x in texts]


def test_redaction_keeps_longer_words(rows):
    assert apply(rows, ["Efe and EFE, Efes stays"], lambda c: pv.redact(c, ["efe"])) == [" and , Efes stays"]


def test_turkish_variants(spark):
    (r,) = spark.sql("SELECT 'ispir' AS t").select(tx.case_variants(F.col("t")).alias("v")).collect()
    assert {"ispir", "ISPIR", "İSPİR", "İspir"} <= set(r.v)


def test_html_text_of_broken_markup(spark):
    cases = {
        "a &lt; b &amp;&nbsp;c &#8364;&#x1F600; &bogus; &copy d": "a < b &\xa0c €\U0001f600 &bogus; \xa9 d",
        "<p>one<p>two</div>three": "onetwo\nthree",
        "x<br/>y<br>z": "x\nyz",
        "<script>if (a < b) {}</script>kept<style>p > a {}": "kept",
        "1 < 2 and <3 <!-- <p>no</p> -->done": "1 < 2 and <3 done",
        "<a title='say \"x > y\"' HREF=http://h.example/?a=1&amp;b=2>t</a>": " http://h.example/?a=1&b=2 t",
        "<a href=\"mailto:x\">t</a><!DOCTYPE html><?php ?>": "t",
        "&#0;&#x80;&#55296;": "�€�",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()) + [(None, None)], "html string, due string")
    for r in df.select("html", "due", ht.html_text(F.col("html")).alias("t")).collect():
        assert r.t == r.due, r.html


def test_hidden_text_follows_the_open_elements(spark):
    cases = {
        "<div hidden><p>12345<p>678</div>90": (8, 2),  # unclosed elements end with their parent
        "<div><span style='DISPLAY : none'>123</div>4567": (3, 4),
        "<p hidden>12</b>34</p>5": (4, 1),  # a stray end tag is ignored
        "<input hidden><br hidden>1234": (0, 4),  # void elements hold nothing
        "<div hidden/>12": (0, 2),
        "<div hidden>1<div>2</div>3</div>4": (3, 1),
        "<div hidden>a<script>bbbb</script> c </div>": (2, 0),
        "<b title='style hidden'>12</b>": (0, 2),
    }
    df = spark.createDataFrame([(h, *due) for h, due in cases.items()], "html string, hidden int, visible int")
    for r in df.withColumn("c", ht.shown_chars(ht.pieces(F.col("html")))).collect():
        assert (r.c.hidden, r.c.visible) == (r.hidden, r.visible), r.html


def test_links_of_broken_markup(spark):
    cases = {
        '<a href="x">one <b>two</b></a>': [("x", "one two")],
        "<a href=x>lost<a href=' y '>kept</a></a>": [("y", "kept")],
        "<a name=n>t</a><a href=z>open": [("", "t")],
        "<abbr>no</abbr><a href=q/>": [("q/", "")] ,
    }
    df = spark.createDataFrame([(h,) for h in cases], "html string")
    for r in df.withColumn("a", ht.anchors(ht.pieces(F.col("html")))).collect():
        assert [tuple(x) for x in r.a] == cases[r.html], r.html
