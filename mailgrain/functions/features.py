"""Fixed-order feature vectors in four schema versions, built on the rule columns."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..operators.joins import one_row
from .base import flag, ratio, strip, unicode_words
from .rules import caps_ratio, with_rules
from .urls import is_ip_host, is_shortener, raw_urls, url_features


def feature_names(version: int = 2) -> list[str]:
    if version == 1:
        return list(lx.FEATURES_V1)
    names = list(lx.FEATURES_V2)
    if version >= 3:
        names += lx.LURE_FEATURES
    if version >= 4:
        names += lx.URL_FEATURES
    return names


def lure_columns(text: Column) -> dict[str, Column]:
    """Counts of five bait patterns on a log scale and the short-body flag."""
    gap = F.locate("\n\n", text)
    body = F.when(text.startswith("Subject:") & (gap > 0), F.substring(text, gap + 2, F.length(text))).otherwise(text)
    out = {f"lure_{name}": F.log1p(F.regexp_count(text, F.lit("(?i)" + unicode_words(pattern))))
           for name, pattern in lx.LURE_PATTERNS.items()}
    needed = F.lower(text)  # every bait of this pattern holds one of the words
    out["lure_attachment_pretext"] = F.when(reduce(or_, [needed.contains(w) for w in lx.ATTACHMENT_WORDS]), out["lure_attachment_pretext"]).when(text.isNotNull(), 0.0)
    out["short_body"] = flag(F.length(strip(body)) < lx.SHORT_BODY_CHARS)
    return out


def _bounded_columns(text: Column) -> dict[str, Column]:
    hosts = F.array_distinct(F.filter(F.transform("urls", lambda u: u["host"]), lambda h: h != ""))
    warned = F.array_distinct(F.transform("domain_warnings", lambda w: F.substring_index(w, ":", 1)))
    hits = F.aggregate(F.map_values("keyword_hits"), F.lit(0), lambda a, b: a + b)
    n = F.size("urls")
    bangs = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return {
        "rule_score_log": F.log1p("score"),
        "keyword_score": F.col("keyword_score").cast("double"),
        "keyword_hits_log": F.log1p(hits),
        "has_url": flag(n > 0),
        "url_count_log": F.log1p(n),
        "http_url_fraction": ratio(F.size(F.filter("urls", lambda u: u["scheme"] == "http")), n),
        "suspicious_url_fraction": ratio(F.size(F.filter("urls", lambda u: u["issue_score"] > 0)), n),
        "max_url_issue_score": F.coalesce(F.array_max(F.transform("urls", lambda u: u["issue_score"])), F.lit(0)).cast("double"),
        "ip_url": flag(F.exists("urls", lambda u: is_ip_host(u["host"]))),
        "shortener_url": flag(F.exists("urls", lambda u: is_shortener(u["host"]))),
        "domain_warning_fraction": ratio(F.size(warned), F.size(hosts)),
        "ip_in_text": flag(F.size(F.array_except("ips", hosts)) > 0),
        "detail_count": F.size("details").cast("double"),
        "text_length_log": F.log1p(F.length(text)),
        "caps_word_ratio": caps_ratio(text)[1],
        "exclamation_log": F.log1p(bangs),
    }


def _raw_columns(text: Column) -> dict[str, Column]:
    hits = F.aggregate(F.map_values("keyword_hits"), F.lit(0), lambda a, b: a + b)
    bangs = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    values = {
        "rule_score": F.col("score"),
        "keyword_score": F.col("keyword_score"),
        "keyword_hit_count": hits,
        "url_score": F.col("url_score"),
        "url_count": F.size("urls"),
        "http_url_count": F.size(F.filter("urls", lambda u: u["scheme"] == "http")),
        "url_issue_count": F.aggregate("urls", F.lit(0), lambda a, u: a + F.size(u["issues"])),
        "ip_count": F.size("ips"),
        "domain_warning_count": F.size("domain_warnings"),
        "detail_count": F.size("details"),
        "text_length_log": F.log1p(F.length(text)),
        "caps_word_ratio": caps_ratio(text)[1],
        "exclamation_count": bangs,
        "has_subject": flag(F.coalesce(F.col("subject") != "", F.lit(False))),
    }
    return {k: v.cast("double") for k, v in values.items()}


def with_features(df: DataFrame, version: int = 2, text: str = "text", keywords=lx.KEYWORDS) -> DataFrame:
    """Keep the columns of `df` and add the features of one schema version as doubles."""
    if version not in (1, 2, 3, 4):
        raise ValueError(f"unknown feature version: {version}")
    t = F.col(text)
    scored = with_rules(df, text, keywords)
    if version == 1:
        return scored.select(*df.columns, *[v.alias(k) for k, v in _raw_columns(t).items()])
    columns = _bounded_columns(t)
    if version >= 3:
        columns.update(lure_columns(t))
    if version >= 4:
        scored = scored.withColumn("_u", url_features(raw_urls(t)))
        columns.update({name: F.col(f"_u.{name}") for name in lx.URL_FEATURES})
    return scored.select(*df.columns, *[columns[name].alias(name) for name in feature_names(version)])


def with_url_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the link features: no rule column is computed."""
    out = df.withColumn("_u", url_features(raw_urls(F.col(text))))
    return out.select(*df.columns, *[F.col(f"_u.{n}").alias(n) for n in lx.URL_FEATURES])


def standardise_and_clip(df: DataFrame, names, limit: float = lx.FEATURE_CLIP, stats: dict | None = None) -> DataFrame:
    """Centre and scale by population deviation, then clip.

    Without `stats` the moments come from `df` itself: one aggregation read as a scalar subquery. A fitted model
    passes its stored moments (two numbers per feature) as literals.
    """
    keep = [c for c in df.columns if c not in names]
    if stats is None:
        row = one_row(scaling_statistics(df, names))
        stats = {f"_{kind}_{n}": row[f"_{kind}_{n}"] for kind in ("mean", "sd") for n in names}

    def scaled(n):
        mean, sd = (x if isinstance(x, Column) else F.lit(float(x)) for x in (stats[f"_mean_{n}"], stats[f"_sd_{n}"]))
        z = (F.col(n) - mean) / F.when(sd == 0, 1.0).otherwise(sd)
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), z)).alias(n)

    return df.select(*keep, *[scaled(n) for n in names])


def scaling_statistics(df: DataFrame, names) -> DataFrame:
    return df.agg(*[F.avg(n).alias(f"_mean_{n}") for n in names],
                  *[F.stddev_pop(n).alias(f"_sd_{n}") for n in names])
