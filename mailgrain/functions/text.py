"""Text normalisation, cleaning and language test as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from .base import (LINE_BREAKS, SPACE, WORD, collapse, let, literal_array, strip, unicode_space,
                   unicode_words)

JAVA_URL = "(?i)" + unicode_space(lx.URL_PATTERN)
SUBJECT_LABEL = r"(?imd)^subject:"


def clean_whitespace(c: Column) -> Column:
    blanks = F.regexp_replace(c, r"[ \t\r\f\x0b]+", " ")
    return strip(F.regexp_replace(blanks, rf"\n[{SPACE}]*\n+", "\n\n"))


def cut(c: Column, limit: int | None = None) -> Column:
    """Whole text, unless the caller sets a limit."""
    return c if limit is None else F.substring(c, 1, limit)


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, JAVA_URL, " URLTOKEN ")


def model_tokens_text(c: Column) -> Column:
    """Text as the term features see it: links masked, subject label dropped, lower case."""
    return F.lower(F.regexp_replace(mask_urls(c), SUBJECT_LABEL, " "))


def format_normalised_text(c: Column) -> Column:
    """One layout for every corpus: no tags, entities or labels, spaced punctuation, single blanks."""
    no_tags = F.regexp_replace(mask_urls(c), lx.TAG_PATTERN, " ")
    no_entities = F.regexp_replace(no_tags, lx.ENTITY_PATTERN, " ")
    plain = F.translate(F.regexp_replace(no_entities, SUBJECT_LABEL, " "), "<>", "  ")
    return F.lower(collapse(F.regexp_replace(plain, rf"([^{WORD}{SPACE}])", " $1 ")))


def mask_dates(c: Column) -> Column:
    for pattern, token in ((lx.ISO_DATE_PATTERN, " datetoken "),
                           (lx.NUMERIC_DATE_PATTERN, " datetoken "),
                           (lx.YEAR_PATTERN, " yeartoken ")):
        c = F.regexp_replace(c, unicode_space(unicode_words(pattern)), token)
    return c


def strip_reply_structure(c: Column) -> Column:
    """Drop quoted replies, attribution lines, forwarded header runs and Re:/Fwd: prefixes."""
    quote = unicode_space(lx.QUOTE_LINE_PATTERN)
    wrote = unicode_space(lx.WROTE_PATTERN).replace("$", r"\z")
    header = unicode_space(lx.HEADER_LINE_PATTERN)

    def describe(line, i):
        return F.struct(
            line.alias("line"),
            line.rlike(quote).alias("quoted"),
            ((F.length(line) <= lx.WROTE_MAX_CHARS) & line.rlike(wrote)).alias("wrote"),
            line.rlike(rf"^[{SPACE}]*On ").alias("opens"),
            ((i > 0) & line.rlike(header)).alias("header"),
        )

    def kept_lines(rows):
        def keep(row, i):
            after = F.get(rows, i + 1)
            before_header = F.when(i > 0, F.get(rows, i - 1)["header"])
            attribution = row["wrote"] & ~row["quoted"]
            next_attribution = F.coalesce(after["wrote"] & ~after["quoted"], F.lit(False))
            in_run = row["header"] & (F.coalesce(before_header, F.lit(False))
                                      | F.coalesce(after["header"], F.lit(False)))
            return ~(row["quoted"] | attribution | (row["opens"] & next_attribution) | in_run)

        return F.transform(F.filter(rows, keep), lambda row: row["line"])

    def finish(rows):
        def choose(kept):
            labelled = F.get(rows, F.lit(0))["line"].rlike(rf"(?i)^[{SPACE}]*subject:")
            body = F.when(labelled, F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(1)))).otherwise(kept)
            unquoted = F.transform(rows, lambda row, i: F.when(i == 0, row["line"]).otherwise(
                F.regexp_replace(row["line"], rf"^[{SPACE}]*(?:>[{SPACE}]*)+", "")))
            empty = strip(F.array_join(body, "")) == ""
            return F.array_join(F.when(empty, unquoted).otherwise(kept), "\n")

        return let(kept_lines(rows), choose)

    separated = F.regexp_replace(c, unicode_space(lx.SEPARATOR_PATTERN), " ")
    lines = F.split(separated, "\n", -1)
    no_prefix = F.transform(lines, lambda line, i: F.when(
        i == 0, F.regexp_replace(line, unicode_space(lx.REPLY_PREFIX_PATTERN), "$1")).otherwise(line))
    joined = let(F.transform(no_prefix, describe), finish)
    return F.regexp_replace(joined, rf"[{SPACE}]+\z", "")


def clean_text(c: Column, reply: bool = True, dates: bool = True) -> Column:
    if reply:
        c = strip_reply_structure(c)
    return mask_dates(c) if dates else c


def subject_line(c: Column) -> Column:
    """Text after the first line-initial "subject:"; null when there is no such line."""
    pattern = rf"(?i)(?:\A|[{LINE_BREAKS}])subject:([^{LINE_BREAKS}]*)"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def language_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nl}\p{No}]+", -1), lambda w: w != "")


def _is_in(words):
    return lambda w: w.isin(list(words))


def with_language_ratios(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one `ratio_<lang>` column per stop-word list and the `english` verdict."""
    staged = df.withColumn("_tokens", language_tokens(F.col(text)))
    n = F.greatest(F.size("_tokens"), F.lit(1))
    staged = staged.withColumns({
        f"ratio_{lang}": F.size(F.filter("_tokens", _is_in(words))) / n
        for lang, words in lx.STOP_WORDS.items()
    })
    others = [F.col(f"ratio_{lang}") for lang in lx.STOP_WORDS if lang != "en"]
    return staged.withColumn(
        "english", (F.col("ratio_en") >= lx.ENGLISH_MIN_RATIO) & (F.col("ratio_en") > F.greatest(*others))
    ).drop("_tokens")


def strip_list_tags(c: Column) -> Column:
    """Drop a list tag after the first "Subject: <tag> " of the mail."""
    for tag in lx.LIST_TAGS:
        marker = f"Subject: {tag} "
        at = F.locate(marker, c)
        c = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at + 8),
                                    F.substring(c, at + len(marker), F.length(c)))).otherwise(c)
    return c


def content_key(c: Column) -> Column:
    """md5 of the lower-cased, blank-collapsed text."""
    return F.md5(collapse(F.lower(c)))


def source_from_file_name(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.get(F.split(c, r"-20\d\d-", -1), F.lit(0)))


def project_and_list(c: Column, prefix: str) -> Column:
    """First two dash-separated parts of a file name."""
    return F.concat(F.lit(prefix), F.array_join(F.slice(F.split(c, "-", -1), 1, 2), "-"))


def corpus_of(source: Column, label: Column) -> Column:
    return (F.when((source == "kaggle") & (label == 1), "Kaggle phishing")
            .when(source == "kaggle", "Kaggle legitimate")
            .when(source.startswith("spamassassin"), "SpamAssassin ham")
            .when(source.startswith("nazario"), "Nazario 2019–2024")
            .otherwise("Mailing lists 2024"))


def link_class(c: Column) -> Column:
    return (F.when(c.rlike(rf"(?i)https?://[^{SPACE}]"), "real link")
            .when(c.rlike(lx.PLACEHOLDER_PATTERN), "placeholder only")
            .otherwise("no link"))


def mask_addresses(c: Column) -> Column:
    """Mask addresses, then links, of a subject line."""
    return F.regexp_replace(F.regexp_replace(c, lx.SUMMARY_EMAIL_PATTERN, "<email>"),
                            unicode_space(lx.SUMMARY_URL_PATTERN), "<link>")


def public_summary(c: Column) -> Column:
    """Masked subject, body length and link count; never the body itself."""
    labelled = c.startswith("Subject:")
    gap = F.locate("\n\n", c)
    head = F.when(gap > 0, F.substring(c, F.lit(1), gap - 1)).otherwise(c)
    body = F.when(~labelled, c).when(gap > 0, F.substring(c, gap + 2, F.length(c))).otherwise("")
    subject = mask_addresses(F.when(labelled, strip(F.substring(head, F.lit(9), F.length(head)))).otherwise(""))
    limit = lx.SUMMARY_SUBJECT_CHARS
    short = F.when(F.length(subject) > limit, F.concat(
        F.regexp_replace(F.substring(subject, 1, limit), rf"[{SPACE}]+\z", ""), F.lit("…"))).otherwise(subject)
    links = F.regexp_count(body, F.lit(unicode_space(lx.SUMMARY_URL_PATTERN)))
    return F.concat(F.lit("Subject: "), F.when(short == "", "(none)").otherwise(short), F.lit(" [body: "),
                    F.length(strip(body)).cast("string"), F.lit(" chars, "), links.cast("string"), F.lit(" links]"))


def compose_mail_text(subject: Column, body: Column) -> Column:
    """Subject and body in the layout the models are trained on."""
    titled = strip(F.coalesce(subject, F.lit("")))
    text = F.when(titled != "", F.concat(F.lit("Subject: "), titled, F.lit("\n\n"), body)).otherwise(body)
    return cut(clean_whitespace(text))


def normalised_label(c: Column) -> Column:
    """Label synonyms to 1 or 0, null for anything else."""
    word = F.lower(strip(c))
    return (F.when(word.isin(list(lx.POSITIVE_LABELS)), F.lit(1))
            .when(word.isin(list(lx.NEGATIVE_LABELS)), F.lit(0)))


def case_variants(term: Column) -> Column:
    """Spellings of a term under plain and Turkish upper and lower casing."""
    upper = F.upper(F.translate(term, "iı", "İI"))
    lower = F.lower(F.translate(term, "İI", "iı"))
    first = F.upper(F.translate(F.substring(lower, 1, 1), "i", "İ"))
    return F.array_distinct(F.array(
        term, F.lower(term), F.upper(term), F.initcap(term), upper, lower,
        F.concat(first, F.substring(lower, F.lit(2), F.length(lower)))))


def append_templates(df: DataFrame, templates=None, text: str = "text") -> DataFrame:
    """One row per mail and template, the template text appended (a fixed list of six by default)."""
    items = (templates or lx.APPEND_TEMPLATES).items()
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("suffix")) for k, v in items])
    return (df.withColumn("_t", F.explode(rows))
            .withColumn("template", F.col("_t.template"))
            .withColumn(text, F.concat(F.col(text), F.col("_t.suffix")))
            .drop("_t"))


def has_mail_headers(header_block: Column) -> Column:
    """True when any well-known header name opens a line of the header block."""
    head = F.get(F.split(header_block, r"\r?\n\r?\n", 2), F.lit(0))
    names = F.transform(F.regexp_extract_all(head, F.lit(r"(?m)^([!-9;-~]+):"), 1), lambda n: F.lower(n))
    return F.arrays_overlap(names, literal_array(lx.MAIL_HEADER_NAMES))


def strip_recipient(c: Column) -> Column:
    pattern = lx.RECIPIENT_PATTERN.replace(r"\bmonkey\b", rf"(?<![{WORD}])monkey(?![{WORD}])")
    return F.regexp_replace(c, pattern, "")


def strip_anonymiser(c: Column) -> Column:
    return F.regexp_replace(c, lx.ANONYMISER_PATTERN, "")
