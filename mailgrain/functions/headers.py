"""Header values and sender-authentication signals from a raw header block."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from .base import SPACE, WORD, collapse
from .urls import brand_in_foreign_domain, registered_domain

SIGNALS = (
    "no_auth_results", "spf_not_pass", "dkim_not_pass", "dmarc_not_pass", "no_dkim_signature", "dkim_not_aligned",
    "return_path_not_aligned", "reply_to_other_domain", "from_freemail",
)


def header_values(block: Column, name: str) -> Column:
    """Every value of a header, in order, folded lines joined by one blank."""
    pattern = rf"(?im)^{name}:[ \t]*([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*)"
    return F.transform(F.regexp_extract_all(block, F.lit(pattern), 1), lambda v: F.regexp_replace(v, r"\r?\n[ \t]+", " "))


def header_value(block: Column, name: str) -> Column:
    return F.coalesce(F.get(header_values(block, name), F.lit(0)), F.lit(""))


def address_of(value: Column) -> Column:
    """The address of a single-mailbox header: inside angle brackets, else the bare one."""
    inside = F.regexp_extract(value, r"<([^<>]*)>", 1)
    bare = F.regexp_extract(value, rf'([^{SPACE}<>,;"]+@[^{SPACE}<>,;"]+)', 1)
    return F.when(inside.contains("@"), inside).otherwise(bare)


def address_host(value: Column) -> Column:
    """Full lower-case host of the header's address; empty without one."""
    address = address_of(value)
    host = F.regexp_replace(F.substring_index(address, "@", -1), r"^[>. ]+|[>. ]+$", "")
    return F.when(address.contains("@"), F.lower(host)).otherwise("")


def address_domains(values: Column) -> Column:
    """Registered domains of all addresses in a list of header values."""
    found = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(
        v, F.lit(rf'[^{SPACE}<>,;"@]+@([^{SPACE}<>,;"@]+)'), 1)))
    return F.transform(found, registered_domain)


def recorded_result(auth_headers: Column, mechanism: str) -> Column:
    """Result of the first header that reports the mechanism; null when none does."""
    pattern = rf"(?i)(?<![{WORD}]){mechanism}[{SPACE}]*=[{SPACE}]*([a-z]+)"
    joined = F.array_join(auth_headers, "\n")
    return F.when(joined.rlike(pattern), F.lower(F.regexp_extract(joined, pattern, 1)))


def sender_domain(from_value: Column) -> Column:
    return registered_domain(F.regexp_extract(from_value, r"@([A-Za-z0-9.-]+)", 1))


def with_header_signals(df: DataFrame, block: str = "header_block") -> DataFrame:
    """Add the nine nullable signals, the recorded results and the From host."""
    b = F.col(block)
    staged = df.withColumns({
        "_auth": header_values(b, "Authentication-Results"),
        "_dkim": header_values(b, "DKIM-Signature"),
        "_reply": address_domains(header_values(b, "Reply-To")),
        "from_host": address_host(header_value(b, "From")),
        "_return": registered_domain(address_host(header_value(b, "Return-Path"))),
    }).withColumns({
        "_from": registered_domain(F.col("from_host")),
        "_signed": F.transform("_dkim", lambda s: registered_domain(F.lower(F.regexp_extract(
            collapse(s), rf"(?:^|;)[{SPACE}]*d[{SPACE}]*=[{SPACE}]*([A-Za-z0-9.-]+)", 1)))),
        **{f"recorded_{m}": recorded_result(F.col("_auth"), m) for m in lx.AUTH_MECHANISMS},
    })
    sender = F.col("_from")
    known = sender != ""
    columns = {
        "no_auth_results": F.size("_auth") == 0,
        **{f"{m}_not_pass": F.col(f"recorded_{m}") != "pass" for m in lx.AUTH_MECHANISMS},
        "no_dkim_signature": F.size("_dkim") == 0,
        "dkim_not_aligned": known & ~F.array_contains("_signed", sender),
        "return_path_not_aligned": known & (F.col("_return") != "") & (F.col("_return") != sender),
        "reply_to_other_domain": known & F.exists("_reply", lambda d: d != F.col("_from")),
        "from_freemail": sender.isin(list(lx.SENDER_FREE_MAIL)),
    }
    return staged.select(*df.columns, "from_host", *[f"recorded_{m}" for m in lx.AUTH_MECHANISMS],
                         *[columns[s].alias(s) for s in SIGNALS])


def verified_sender() -> Column:
    """DMARC recorded as passed and a DKIM signature of the From domain."""
    return F.coalesce(~F.col("dmarc_not_pass"), F.lit(False)) & ~F.col("dkim_not_aligned")


def suspicious_sender(free_hosting_fraction: Column) -> Column:
    """Signs that keep a verified sender from being relieved."""
    host = F.col("from_host")
    return (((host != "") & brand_in_foreign_domain(host)) | host.contains("xn--")
            | (free_hosting_fraction > 0) | F.col("reply_to_other_domain"))


def in_inbox(block: Column, require_dmarc: bool = True) -> Column:
    """Delivered to the inbox by the provider and, unless switched off, DMARC passed."""
    placed = F.upper(F.trim(header_value(block, "X-Apple-Movetofolder"))) == "INBOX"
    if not require_dmarc:
        return placed
    auth = F.lower(F.array_join(header_values(block, "Authentication-Results"), " "))
    return placed & auth.rlike(rf"dmarc=pass(?![{WORD}])")
