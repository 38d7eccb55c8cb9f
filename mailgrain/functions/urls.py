"""Link extraction, link inspection and host tests as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .base import flag, let, points, present, ratio, total
from .text import JAVA_URL

_OCTET = r"(?:\+?0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|-0+)"
# characters whose compatibility form holds one of / ? # @ : make an authority invalid
_AMBIGUOUS = (r"[⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫"
              r"＃／：？＠]")


def raw_urls(text: Column) -> Column:
    """Links in text order, trailing punctuation removed, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(JAVA_URL), 0),
                       lambda u: F.regexp_replace(u, lx.URL_TRAILING, ""))


def extract_urls(text: Column) -> Column:
    """Distinct links, first occurrence order."""
    return F.array_distinct(raw_urls(text))


def is_ip_host(host: Column) -> Column:
    return host.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)


def _malformed(authority: Column) -> Column:
    return authority.contains("[") | authority.rlike(_AMBIGUOUS)


def _host(authority: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(authority, r"^.*@", ""), ":", 1))


def host_of(url: Column) -> Column:
    """Lower-case host; empty for a link without one or one that cannot be parsed."""
    authority = _authority(url)
    return F.when(_malformed(authority), "").otherwise(_host(authority))


def _same_or_below(names) -> str:
    """One pattern for "the host is one of the names or lies below one of them"."""
    return r"(?:^|\.)(?:" + "|".join(re.escape(n) for n in names) + r")\z"


def is_shortener(host: Column) -> Column:
    return host.rlike(_same_or_below(lx.SHORTENERS))


def is_free_hosting(host: Column) -> Column:
    return host.rlike(lx.REGIONAL_BUCKET_PATTERN) | host.rlike(_same_or_below(lx.FREE_HOSTING))


def registered_domain(host: Column) -> Column:
    """Last two labels, or three below a two-letter country code and a second-level label."""
    labels = F.filter(F.split(F.lower(host), r"\.", -1), lambda p: p != "")

    def pick(p):
        second = F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit(""))
        three = ((F.size(p) >= 3) & (F.length(F.try_element_at(p, F.lit(-1))) == 2)
                 & second.isin(list(lx.SECOND_LEVEL_LABELS)))
        keep = F.when(three, F.lit(3)).otherwise(F.least(F.size(p), F.lit(2)))
        return F.when(F.size(p) == 0, F.lit("")).otherwise(
            F.array_join(F.slice(p, F.greatest(F.size(p) - keep + 1, F.lit(1)), keep), "."))

    return let(labels, pick)


_BRANDS = "map({})".format(", ".join(
    "'{}', array({})".format(brand, ", ".join(f"'{d}'" for d in owned)) for brand, owned in lx.BRAND_DOMAINS.items()))


def _foreign_brand(tokens: Column, registered: Column) -> Column:
    """Some token is a brand that neither names nor owns the registered domain (one folded map literal)."""
    brands = F.expr(_BRANDS)
    return F.exists(tokens, lambda token: (token != F.substring_index(registered, ".", 1))
                    & F.coalesce(~F.array_contains(F.try_element_at(brands, token), registered), F.lit(False)))


def brand_in_foreign_domain(host: Column) -> Column:
    """A brand is one of the host's tokens although the registered domain is not the brand's."""
    return let(registered_domain(host), lambda reg: _foreign_brand(F.split(F.lower(host), r"[.-]", -1), reg))


def brand_text_foreign_link(anchor_text: Column, href: Column) -> Column:
    """A brand is named in the anchor text and the link leads to somebody else's domain."""
    target = any_host(href)
    words = F.filter(F.split(F.lower(anchor_text), r"[^a-z0-9]+", -1), lambda w: w != "")
    return let(F.struct(words.alias("tokens"), registered_domain(target).alias("reg"), target.alias("host")),
               lambda s: (s["host"] != "") & F.lower(href).startswith("http") & _foreign_brand(s["tokens"], s["reg"]))


def any_host(address: Column) -> Column:
    """Host of an address with or without a scheme."""
    return host_of(F.when(address.contains("://"), address).otherwise(F.concat(F.lit("http://"), address)))


def inspect_url(url: Column) -> Column:
    """Parse and score one link: url, scheme, host, scheme_score, issues, issue_score."""
    authority = _authority(url)
    after_user = F.regexp_replace(authority, r"^.*@", "")
    parsed = F.struct(
        url.alias("url"),
        F.lower(F.regexp_extract(url, r"^([a-zA-Z]+):", 1)).alias("scheme"),
        _malformed(authority).alias("malformed"),
        F.lower(F.substring_index(after_user, ":", 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(after_user, r":(.*)$", 1), r"^0+(?=.)", "").alias("port"),
        F.length(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")).alias("path_length"),
    )

    def score(p):
        usable = ~p["malformed"] & (p["host"] != "")
        number = F.when(p["port"].rlike(r"^[0-9]{1,5}$"), p["port"]).try_cast("int")
        bad_port = (p["port"] != "") & (number.isNull() | (number > 65535))
        odd_port = (p["port"] != "") & ~bad_port & ~number.isin(0, 80, 443)
        plain = ~p["malformed"] & (p["scheme"] == "http")
        checks = [
            (p["malformed"], F.lit("Malformed URL"), 10),
            (plain, F.lit("Uses HTTP (unencrypted)"), 0),
            (~p["malformed"] & (p["host"] == ""), F.lit("Missing hostname"), 10),
            (usable & is_ip_host(p["host"]), F.lit("URL points to IP address instead of domain"), 25),
            (usable & p["url"].contains("@"), F.lit("URL contains @ (possible credential hiding)"), 15),
            (usable & is_shortener(p["host"]), F.lit("URL shortener detected"), 10),
            (usable & (F.length(p["host"]) > 60), F.lit("Unusually long hostname"), 8),
            (usable & p["host"].rlike(r"[0-9]{4,}"), F.lit("Hostname contains long digit sequence"), 6),
            (usable & bad_port, F.lit("Invalid port in URL"), 8),
            (usable & odd_port, F.concat(F.lit("Non-standard port: "), p["port"]), 8),
            (usable & (p["path_length"] > 80), F.lit("Very long URL path"), 5),
        ]
        return F.struct(
            p["url"].alias("url"),
            F.when(p["malformed"], "").otherwise(p["scheme"]).alias("scheme"),
            F.when(p["malformed"], "").otherwise(p["host"]).alias("host"),
            F.when(p["malformed"], lx.MALFORMED_POINTS).when(plain, lx.HTTP_POINTS)
            .otherwise(lx.HTTPS_POINTS).alias("scheme_score"),
            present(*[F.when(cond, name) for cond, name, _ in checks]).alias("issues"),
            total([points(cond, value) for cond, _, value in checks if value]).alias("issue_score"),
        )

    return let(parsed, score)


def inspect_domain(host: Column) -> Column:
    """Warnings about the name itself; none for empty and IP hosts."""
    last = F.substring_index(host, ".", -1)
    dotted = host.contains(".")
    cheap = dotted & last.isin(list(lx.CHEAP_TLDS))
    money = host.contains("bank") | host.contains("paypal") | host.contains("secure")
    warnings = present(
        F.when(cheap, F.concat(F.lit("suspicious TLD (."), last, F.lit(")"))),
        F.when(F.length(host) - F.length(F.translate(host, ".", "")) >= 4, "many subdomains (possible obfuscation)"),
        F.when(F.length(host) - F.length(F.translate(host, "-", "")) >= 3, "many hyphens in domain"),
        F.when(host.rlike(lx.TYPO_BRAND_PATTERN), "possible brand typosquatting"),
        F.when(money & cheap, "financial keyword on cheap TLD"),
    )
    return F.when((host != "") & ~is_ip_host(host), warnings).otherwise(F.array().cast("array<string>"))


def url_features(urls: Column) -> list[Column]:
    """The eight link features from the link array with repeats; IP hosts are left out."""
    pairs = F.filter(F.transform(urls, lambda u: F.struct(u.alias("url"), host_of(u).alias("host"))),
                     lambda p: (p["host"] != "") & ~is_ip_host(p["host"]))

    def summarise(p):
        hosts = F.transform(F.array_distinct(F.transform(p, lambda x: x["host"])), lambda h: F.struct(
            h.alias("host"), registered_domain(h).alias("reg"), is_free_hosting(h).alias("free"),
            brand_in_foreign_domain(h).alias("brand")))

        def build(hs):
            hyphens = F.array_max(F.transform(hs, lambda h: F.length(h["host"]) - F.length(F.translate(h["host"], "-", ""))))
            depth = F.array_max(F.transform(hs, lambda h: F.greatest(F.lit(0), _dots(h["host"]) - _dots(h["reg"]))))
            zero = F.lit(0)
            return F.struct(
                ratio(F.size(F.filter(hs, lambda h: h["free"])), F.size(hs)).alias(lx.URL_FEATURES[0]),
                flag(F.exists(p, lambda x: x["url"].rlike(lx.REDIRECT_PATTERN))).alias(lx.URL_FEATURES[1]),
                flag(F.exists(p, lambda x: x["url"].rlike(lx.PERCENT_PATTERN))).alias(lx.URL_FEATURES[2]),
                (F.least(F.coalesce(hyphens, zero), F.lit(4)) / 4.0).alias(lx.URL_FEATURES[3]),
                (F.least(F.coalesce(depth, zero), F.lit(4)) / 4.0).alias(lx.URL_FEATURES[4]),
                flag(F.exists(hs, lambda h: h["brand"])).alias(lx.URL_FEATURES[5]),
                flag(F.exists(hs, lambda h: h["host"].contains("xn--"))).alias(lx.URL_FEATURES[6]),
                F.log1p(F.size(F.array_distinct(F.transform(hs, lambda h: h["reg"])))).alias(lx.URL_FEATURES[7]),
            )

        return let(hosts, build)

    return let(pairs, summarise)


def _dots(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, ".", ""))
