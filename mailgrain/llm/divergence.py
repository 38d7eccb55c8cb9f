"""Quality rules by distribution divergence.

References: for every language, over all texts labelled with it, the histogram of character classes (14 classes of
ASCII characters and lead bytes) and the words that make up at least one in 1,000 of its words, with their shares
(at most 1,000 words a language by that rule). A language needs 10,000 words, so that such a word is expected ten times,
or one in 1,000 of all words in a smaller table; how large the other languages are does not matter beyond that. The
references are broadcast: at most 1,000 words for each language with 10,000 words.

Verdict: a document labelled with a language that has no reference is left to the base rules. Every other one is compared
with every reference; its distance is the smallest over the languages of

* the Jensen-Shannon distance (base 2) of character classes, guarded by at least `least_chars` characters in words;
* the Jensen-Shannon distance of common-word shares (all other words are one bin), guarded by `least_words` words.

Short documents differ by chance alone: the distance allowed is sqrt(limit^2 + bins / (8 ln 2 * n)), the second term
being the divergence to expect from n draws of the reference. A document fails beyond it on either histogram.

The base rules count words `[^\\x20\\x09-\\x0D]+`, their code points, symbols, repeated lines and words in repeated
five-word windows; a failed base rule fails the document. Null text is empty and fails (no words). Rows with a null
lang are judged but teach nothing; without any reference only the base rules judge. Repeated rows each count; other
columns are ignored; an empty table gives an empty result.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CLASSES = 14
_FLUSH = 300_000


def _byte_classes():
    """Class of each UTF-8 byte; continuation bytes get the last one, which is left out."""
    t = np.full(256, CLASSES, np.int64)
    for b in range(128):
        c = chr(b)
        t[b] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 5 if c in ".,;:!?" else
                6 if c in "'\"()-" else 7 if c in SYMBOLS else 8 if c.isprintable() else 9)
    t[0xC2], t[0xC3:0xCC], t[0xCC:0xE0], t[0xE0:0xF8] = 10, 11, 12, 13
    return t


_CLASS = _byte_classes()


def class_counts(text: str):
    """Characters of `text` per class."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return np.bincount(_CLASS, raw, minlength=CLASSES + 1)[:CLASSES]


def measures(text: str):
    """(words as places in a vocabulary, vocabulary, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = WORDS.findall(text)
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    seen, repeats = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                repeats += 1
            elif WORDS.search(line):
                seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return ids, known, chars, sum(map(text.count, SYMBOLS)), repeats, repeated(ids, words)


def repeated(ids, words, width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0  # equal windows would have equal hashes
    found, suspects = {}, np.flatnonzero(np.isin(mixed, twice))
    for i in suspects.tolist():  # compare the windows themselves
        found.setdefault(tuple(words[i:i + width]), []).append(i)
    hit = np.zeros(len(ids) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            np.add.at(hit, at, 1)
            np.subtract.at(hit, np.array(at) + width, 1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 0.001, least: int = 10_000):
    """{lang: (class shares, {word: share})}; see the module text."""

    def run(batches):
        kinds, words, n = {}, {}, 0

        def rows():
            for lang, own in words.items():
                if own:
                    yield arrow_rows(["lang", "kind", "word", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()], [[lang] * len(own), [-1] * len(own), [*own], [*own.values()]])
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                kinds[lang] = kinds.get(lang, 0) + class_counts(text)
                own = words.setdefault(lang, {})
                n -= len(own)
                for w in WORDS.findall(text):
                    own[w] = own.get(w, 0) + 1
                n += len(own)
                if n > _FLUSH:
                    yield from rows()
                    words, n = {}, 0
        yield from rows()
        for lang, c in kinds.items():
            yield arrow_rows(["lang", "kind", "word", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()], [[lang] * CLASSES, range(CLASSES), [None] * CLASSES, c.astype(np.int64)])

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col), F.col(text_col))
    counts = written(labelled.mapInArrow(run, "lang string, kind int, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "references")
    totals = counts.where("kind < 0").groupBy("lang").agg(F.sum("n").alias("total"))
    all_words = sum(r["total"] for r in totals.where("total > 0").groupBy().agg(F.sum("total").alias("total")).collect() if r["total"])
    taught = totals.where(F.col("total") >= min(least, share * all_words))
    common = counts.join(taught, "lang").where((F.col("kind") >= 0) | (F.col("n") >= share * F.col("total")))
    out = {}
    for r in common.collect():  # at most 1/share words and 14 classes for each language
        kinds, words = out.setdefault(r["lang"], (np.zeros(CLASSES), {}))
        if r["kind"] >= 0:
            kinds[r["kind"]] = r["n"]
        else:
            words[r["word"]] = r["n"] / r["total"]
    return {lang: (kinds / max(kinds.sum(), 1), words) for lang, (kinds, words) in sorted(out.items())}


def distance(p, q) -> float:
    """Jensen-Shannon distance (base 2) of two histograms given as shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(d / 2, 0.0))


class Judge:
    """Compares one document with all references."""

    def __init__(self, refs, class_limit, word_limit, least_chars, least_words):
        self.refs = [(lang, kinds, [*words], np.array([*words.values(), max(0.0, 1 - sum(words.values()))])) for lang, (kinds, words) in refs.items()]
        self.langs = frozenset(refs)
        self.class_limit, self.word_limit, self.least_chars, self.least_words = class_limit, word_limit, least_chars, least_words

    def __call__(self, text, ids, known, chars, lang=None):
        """(class distance, word distance, passes); distances are NaN below their guard or if `lang` has no reference."""
        by_class = by_word = math.nan
        ok = True
        if lang is not None and lang not in self.langs:
            return by_class, by_word, ok
        if chars >= self.least_chars and self.refs:
            kinds = class_counts(text)
            n = kinds.sum()
            by_class = min(distance(kinds / n, ref) for _, ref, _, _ in self.refs)
            ok = by_class <= math.sqrt(self.class_limit ** 2 + CLASSES / (8 * math.log(2) * n))
        if len(ids) >= self.least_words and self.refs:
            counts, n = np.bincount(ids, minlength=len(known)), len(ids)
            best = None
            for _, _, words, ref in self.refs:
                own = np.array([counts[known[w]] if w in known else 0 for w in words] + [0], float)
                own[-1] = n - own.sum()
                d = distance(own / n, ref)
                excess = d ** 2 - len(ref) / (8 * math.log(2) * n)
                if best is None or excess < best[0]:
                    best = excess, d
            by_word = best[1]
            ok = ok and best[0] <= self.word_limit ** 2
        return by_class, by_word, ok


def judged(docs: DataFrame, refs=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = 0.3,
           word_limit: float = 0.3, least_chars: int = 200, least_words: int = 60) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance)."""
    refs = references(docs, text_col, lang_col) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]

    def run(batches):
        judge = Judge(shared.value, class_limit, word_limit, least_chars, least_words)
        for b in batches:
            rows = []
            for t, lang in zip(b.column(1), b.column(2).to_pylist()):
                text = t.as_py() or ""
                ids, known, chars, symbols, lines, again = measures(text)
                n = len(ids)
                failed = n < 10 or 100 * again > 20 * n
                by_class, by_word, ok = judge(text, ids, known, chars, lang)
                rows.append((n, chars, symbols, lines, again, failed, ok and not failed, by_class, by_word))
            types = [b.schema.field(0).type] + [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield arrow_rows([id_col, *names], types, [b.column(0), *(zip(*rows) if rows else [[]] * len(names))])

    kept = docs.select(id_col, text_col, F.col(lang_col).cast("string").alias("__lang"))
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
