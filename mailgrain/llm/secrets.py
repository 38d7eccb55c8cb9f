"""Secret scans with a battery of randomness tests, on built-in functions only.

Base rules (fixed by contract) find assignments, access keys and hex runs. The battery adds long unbroken runs that
look like draws from an encoding's alphabet. For each candidate of at least `least` characters:

* encoding: hex, base32, alnum or base64 by the characters it uses;
* chi-squared uniformity over eight equal slices of the alphabet, and over the classes upper, lower, digit, other;
* Wald-Wolfowitz runs below and above the middle of the alphabet;
* lag-one serial correlation of the symbols' places.

The four p-values (normal approximations) combine by Bonferroni into one p-value of "drawn at random". Natural words
fail it clearly, so "not random" is the discovery: per encoding and length band (powers of two) Benjamini-Hochberg at
rate `q` over all candidates of the corpus decides which are rejected. What is not rejected counts as a secret, so at
most a share `q` of the dismissals in a band are true random strings, whatever the lengths in the corpus. The table
of p-value bins is bounded (4 encodings, 31 bands, 301 bins) and yields one threshold per encoding and band.

One narrow pass over the texts writes spans and p-values; nothing is shuffled but bin counts. Positions are code
points. Null text is empty: no spans. Rows are independent, so repeated rows repeat their result; other columns are
ignored; an empty table gives an empty result.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from .common import written

# Fixed values of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the greedy runs of 20 characters and more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

_RUN = "A-Za-z0-9+/_-"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabet of each encoding, in the order of its values.
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "alnum": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/"}
_MARK, _OTHER = "\ue000", "\ue001"  # a mark around matches; in texts it is first replaced by a character that no rule knows
_BINS = 300


def _running_ends(lengths: Column, block: int = 128) -> Column:
    """Running sums of an array. Only the sums of whole blocks are gathered by a growing array; inside a block they are added up anew."""

    def sums(x):
        add = lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda i: add(F.slice(x, i * block + 1, block)))
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return let(before, lambda b: F.transform(x, lambda _, i: F.get(b, F.floor(i / block).cast("int")) + add(F.slice(x, i - i % block + 1, i % block + 1))))

    return let(lengths, sums)


def _pieces(text: Column, pattern: str, then) -> Column:
    """`then(match, start, end)` for each non-overlapping match, leftmost first, as an array; nulls drop out."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")

    def walk(parts):
        return let(_running_ends(F.transform(parts, F.length)), lambda e: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1), lambda i: then(F.get(parts, i), F.get(e, i - 1), F.get(e, i))))

    return F.when(F.rlike(text, F.lit(pattern)), F.filter(let(F.split(marked, _MARK), walk), lambda x: x.isNotNull()))


def _span(rank: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_CANDIDATES = "array<struct<start:int,end:int,encoding:string,band:int,bin:int>>"


def base_spans(text: Column) -> Column:
    """Spans of the base rules, by start, then kind as listed."""
    assign = _pieces(text, ASSIGN, lambda m, a, b: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, _span(0, "assign", a, b)))
    rest = [_pieces(text, p, lambda m, a, b, r=r, k=k: _span(r, k, a, b)) for r, k, p in ((1, "access", ACCESS), (2, "hex", HEX))]
    return F.array_sort(F.concat(*[F.coalesce(x.cast(_SPANS), F.array().cast(_SPANS)) for x in (assign, *rest)]))


def _upper_tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation of the normal distribution."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(690.0), 1.5976 * z + 0.070565 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _upper_tail(F.abs(z)))


def _chi_squared_tail(x: Column, df: int) -> Column:
    """Wilson-Hilferty."""
    return _upper_tail((F.pow(x / df, F.lit(1.0 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _battery(value: Column, encoding: str) -> Column:
    """Combined p-value of `value` as random symbols of the encoding."""
    alphabet = ALPHABETS[encoding]
    k = len(alphabet)
    shown = F.lower(value) if encoding == "hex" else F.translate(value, "_-", "/+") if encoding == "base64" else value

    def tests(x):
        n = F.size(x).cast("double")
        total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
        count = lambda f: total(lambda v: F.when(f(v), 1.0).otherwise(0.0))
        slices = [round(i * k / 8) for i in range(9)]
        fit = lambda cells: sum((F.pow(count(f) - n * share, F.lit(2.0)) / (n * share) for f, share in cells), F.lit(0.0))
        even = _chi_squared_tail(fit([(lambda v, a=a, b=b: (v >= a) & (v < b), (b - a) / k) for a, b in zip(slices, slices[1:])]), 7)
        classes = [(lambda v, s=s: F.array_contains(F.lit(s), v), len(s) / k) for s in (
            [i for i, c in enumerate(alphabet) if c in group] for group in (_UPPER, _LOWER, _DIGITS, "+/")) if s]
        classed = _chi_squared_tail(fit(classes), len(classes) - 1)
        low = count(lambda v: v < k // 2)
        high = n - low
        pairs = F.sequence(F.lit(0), F.size(x) - 2)
        runs = 1.0 + F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.when((F.get(x, i) < k // 2) != (F.get(x, i + 1) < k // 2), 1.0).otherwise(0.0))
        due = 2.0 * low * high / n + 1.0
        spread = (due - 1.0) * (due - 2.0) / (n - 1.0)
        runs_p = F.when((low > 0) & (high > 0) & (spread > 0), _two_sided((runs - due) / F.sqrt(spread))).otherwise(F.lit(0.0))
        mean = total(lambda v: v.cast("double")) / n
        power = let(mean, lambda m: total(lambda v: (v - m) * (v - m)))
        lagged = let(mean, lambda m: F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (F.get(x, i) - m) * (F.get(x, i + 1) - m)))
        serial_p = F.coalesce(_two_sided((F.try_divide(lagged, power) + 1.0 / n) * F.sqrt(n)), F.lit(0.0))
        return F.least(F.lit(1.0), 4.0 * F.least(even, classed, runs_p, serial_p))

    return let(F.transform(F.split(F.rtrim(shown, F.lit("=")), ""), lambda c: F.instr(F.lit(alphabet), c) - 1), tests)


def candidates(text: Column, least: int = 20) -> Column:
    """Runs of at least `least` characters (hex: 24) with encoding, length band and p-value bin (tenths of -log10 p)."""
    pattern = rf"(?<![{_RUN}])[{_RUN}]{{{least},}}={{0,2}}"

    def judged(m, a, b):
        encoding = (F.when(m.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(m.rlike(r"^[A-Z2-7]+=*$"), "base32")
                    .when(m.rlike(r"^[A-Za-z0-9]+=*$"), "alnum").otherwise("base64"))

        def made(e):
            p = F.lit(None).cast("double")
            for name in ALPHABETS:
                p = F.when(e == name, _battery(m, name)).otherwise(p)
            tenths = F.floor(F.least(F.lit(float(_BINS)), -10.0 * F.log10(F.greatest(p, F.lit(1e-35))))).cast("int")
            return F.struct(a.alias("start"), b.alias("end"), e.alias("encoding"), F.floor(F.log2(F.length(m))).cast("int").alias("band"), tenths.alias("bin"))

        return F.when((F.length(m) >= 24) | (encoding != "hex"), let(encoding, made))

    return F.coalesce(_pieces(text, pattern, judged).cast(_CANDIDATES), F.array().cast(_CANDIDATES))


def _thresholds(scanned: DataFrame, q: float):
    """(encoding, band) -> lowest bin that is rejected: a bin's largest p is 10^(-bin/10)."""
    counts = scanned.select(F.explode("found").alias("c")).groupBy("c.encoding", "c.band", "c.bin").count().collect()
    by = {}
    for r in counts:
        by.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["count"]
    out = {}
    for key, bins in by.items():
        m, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):  # from the smallest p-values
            seen += bins[b]
            if 10 ** (-b / 10) <= q * seen / m:
                out[key] = b
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05, least: int = 20) -> DataFrame:
    """(id_col, h, base, spans): base spans and all spans of every row; h is the hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = written(docs.select(id_col, F.xxhash64(F.col(text_col)).alias("h"), base_spans(text).alias("base"), candidates(text, least).alias("found")), "secrets")
    limits = _thresholds(scanned, q)
    keys = F.create_map(*[F.lit(x) for (e, b), v in sorted(limits.items()) for x in (f"{e}:{b}", v)]) if limits else None

    def random(c):
        lowest = F.lit(None).cast("int") if keys is None else F.try_element_at(keys, F.concat(c["encoding"], F.lit(":"), c["band"].cast("string")))
        clear = ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return clear & (lowest.isNull() | (c["bin"] < lowest))

    added = F.transform(F.filter("found", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.concat(F.lit("random_"), c["encoding"]).alias("kind")))
    return scanned.select(id_col, "h", "base", F.array_sort(F.concat("base", added.cast(_SPANS))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """`text` with every span (merged where they overlap) replaced by `mask`."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
