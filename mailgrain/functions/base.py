"""Small building blocks shared by the column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as one Java character class body; Java's own \s only knows ASCII.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"  # the characters of SPACE
WORD = r"\p{L}\p{N}_"
WORD_EDGE_LEFT = rf"(?<![{WORD}])"
WORD_EDGE_RIGHT = rf"(?![{WORD}])"
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def unicode_space(pattern: str) -> str:
    """Widen \\s and \\S of a fixed pattern to Unicode white space for Java."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
    return "".join(out)


def unicode_words(pattern: str) -> str:
    """Replace \\b in a pattern that starts and ends with it by explicit Unicode word edges."""
    if pattern.startswith(r"\b"):
        pattern = WORD_EDGE_LEFT + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + WORD_EDGE_RIGHT
    return pattern


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body` (a one-element transform acts as the binding)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def settled(df, *names):
    """Columns `names` as values: a condition on them is not pushed below and does not evaluate their expressions a second time."""
    row = F.explode_outer(F.array(F.struct(*[F.col(n) for n in names]))).alias("_row")
    return df.select(*[F.col(c) for c in df.columns if c not in names], row).select(*[F.col(f"_row.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def present(*columns: Column) -> Column:
    """Array of the given columns without nulls."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def points(condition: Column, value) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0))


def total(columns) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero-safe division: 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
