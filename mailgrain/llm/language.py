"""Language identification: interpolated Kneser-Ney character 4-gram models, one per language.

Training counts the 4-grams of every labelled text, per partition in Arrow batches, then with one shuffle of counts.
Text becomes a stream of lower-case letters with one break between words; the `letters` most frequent letters of the
corpus get symbols of their own, all others one of 8 symbols by script block, so 64 symbols bound the model by 64^4
entries whatever the corpus holds, and that bound is what makes it safe to broadcast.

The models sit in one sorted array of 4-gram keys with a row of log-probabilities per language; unseen 4-grams fall
back to the interpolated trigram part. A text goes to the language of the lowest cross-entropy per symbol. `score`
is that language's share under equal priors, with the evidence of at most `evidence` symbols. Rejection is calibrated
on the training counts: a text of n symbols is rejected if its cross-entropy exceeds the language's own mean by more
than `slack` nats plus `z` standard errors for n.

Null text and text without letters: `und`, score 0, rejected. Null lang rows are not learned; null ids are neither
held out nor learned. If there is nothing to learn from, all texts are `und`. Repeated rows count as often as they
occur; other columns are ignored (or passed through by `identified`); an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

BITS = 6
SYMBOLS = 1 << BITS
#: Script blocks of rare letters: symbols 1 to 8 (Latin, Greek, Cyrillic, Semitic, Indic, Kana and Hangul, Han, rest).
_BLOCKS = ((0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0780, 4), (0x1100, 5), (0x1200, 6), (0x2E80, 8), (0x3400, 6), (0xA000, 7), (0xAC00, 8), (0xD7B0, 6), (0x110000, 8))
_SLICE = 1 << 20
_tables = {}


def _lower_letters():
    """Code point -> lower-case letter, 0 for anything else."""
    if "lower" not in _tables:
        t = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _tables["lower"] = t
    return _tables["lower"]


def letter_stream(text: str):
    """Lower-case letters as code points with single zeros between words and one before and after."""
    points = _lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0)
    out = points[keep]
    return out[:0] if len(out) < 3 else out


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over columns lang, text; a gram packs the low 16 bits of four code points."""

    def run(batches):
        kept = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            by = {}
            for lang, text in zip(langs, b.column(1)):
                by.setdefault(lang, []).append(text.as_py())
            for lang, texts in by.items():
                pile, size = [], 0
                for text in texts:
                    pile.append(text)
                    size += len(text)
                    if size >= _SLICE:
                        _add(kept, lang, "\n".join(pile))
                        pile, size = [], 0
                _add(kept, lang, "\n".join(pile))
        for lang, (grams, n) in kept.items():
            for i in range(0, len(grams), 100_000):
                g = grams[i:i + 100_000]
                yield arrow_rows(["lang", "gram", "n"], [pa.string(), pa.int64(), pa.int64()], [[lang] * len(g), g.view(np.int64), n[i:i + 100_000]])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _add(kept, lang, text):
    for i in range(0, len(text), 4 * _SLICE):  # very long texts in slices; three letters of overlap keep every gram
        s = letter_stream(text[max(0, i - 3):i + 4 * _SLICE]).astype(np.uint64) & np.uint64(0xFFFF)
        if len(s) < 4:
            continue
        sixteen = np.uint64(16)
        g = ((s[:-3] << sixteen | s[1:-2]) << sixteen | s[2:-1]) << sixteen | s[3:]
        g, n = np.unique(g, return_counts=True)
        if lang in kept:
            old, m = kept[lang]
            g, at = np.unique(np.concatenate([old, g]), return_inverse=True)
            n = np.bincount(at, np.concatenate([m, n])).astype(np.int64)
        kept[lang] = g, n.astype(np.int64)


class Model:
    """Log-probabilities per language; see the module text. `symbol` maps code points (low 16 bits) to symbols."""

    def __init__(self, symbol, langs, counts):
        """counts: per language a pair (sorted 4-gram codes, counts)."""
        self.symbol, self.langs = symbol, langs
        self.keys = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, np.uint32)
        self.seen = np.zeros((len(self.keys), len(langs)), np.float32)
        self.low = np.zeros((SYMBOLS ** 3, len(langs)), np.float32)  # log p of a symbol after two
        self.back = np.zeros((SYMBOLS ** 3, len(langs)), np.float32)  # log weight of that part after three
        self.mean, self.spread = np.zeros(len(langs)), np.zeros(len(langs))
        for j, (codes, n) in enumerate(counts):
            self._fit(j, codes.astype(np.int64), n.astype(np.float64))

    @staticmethod
    def _discount(n):
        once, twice = (n == 1).sum(), (n == 2).sum()
        return once / (once + 2 * twice) if once and twice else 0.75

    def _fit(self, j, codes, n):
        S = SYMBOLS
        # distinct left neighbours: of trigrams by 4-gram types, of bigrams by trigram types, of symbols by bigram types
        tri = np.bincount(codes % S ** 3, minlength=S ** 3).astype(float)
        two = np.bincount(np.flatnonzero(tri) % S ** 2, minlength=S ** 2).astype(float)
        one = np.bincount(np.flatnonzero(two) % S, minlength=S).astype(float)
        d1, d2, d3, d4 = (self._discount(x) for x in (one[one > 0], two[two > 0], tri[tri > 0], n))
        p1 = np.maximum(one - d1, 0) / one.sum() + d1 * (one > 0).sum() / one.sum() / S
        p2 = self._mix(two.reshape(S, S), d2, p1)
        p3 = self._mix(tri.reshape(S, S, S), d3, p2)
        context = np.bincount(codes // S, weights=n, minlength=S ** 3)
        kinds = np.bincount(codes // S, minlength=S ** 3)
        weight = np.where(context > 0, d4 * kinds / np.maximum(context, 1), 1.0)
        p3 = p3.ravel()
        self.low[:, j], self.back[:, j] = np.log(p3), np.log(weight)
        keys = self.keys.astype(np.int64)
        mine = np.searchsorted(codes, keys)
        count = np.where(codes[np.minimum(mine, len(codes) - 1)] == keys, n[np.minimum(mine, len(codes) - 1)], 0.0)
        ahead = keys // S
        p4 = np.maximum(count - d4, 0) / np.maximum(context[ahead], 1) + weight[ahead] * p3[keys % S ** 3]
        self.seen[:, j] = np.log(p4)
        bits = -self.seen[np.searchsorted(keys, codes), j]
        self.mean[j] = (bits * n).sum() / n.sum()
        self.spread[j] = np.sqrt((bits ** 2 * n).sum() / n.sum() - self.mean[j] ** 2)

    @staticmethod
    def _mix(count, d, lower):
        """Interpolated Kneser-Ney: `count[..., w]` with `lower[..., w]` one context symbol shorter."""
        total = count.sum(-1, keepdims=True)
        kinds = (count > 0).sum(-1, keepdims=True)
        return np.where(total > 0, (np.maximum(count - d, 0) + d * kinds * lower) / np.maximum(total, 1), lower)

    def codes(self, text: str):
        s = self.symbol[letter_stream(text) & 0xFFFF].astype(np.uint32)
        b = np.uint32(BITS)
        return (((s[:-3] << b | s[1:-2]) << b | s[2:-1]) << b | s[3:]) if len(s) > 3 else None

    def logs(self, codes):
        """(n, L): log p of every code in every language."""
        at = np.searchsorted(self.keys, codes)
        at[at == len(self.keys)] = 0
        out = self.seen[at]
        new = np.flatnonzero(self.keys[at] != codes)
        if len(new):
            c = codes[new]
            out[new] = self.back[c >> np.uint32(BITS)] + self.low[c & np.uint32(SYMBOLS ** 3 - 1)]
        return out


def _entropies(model, texts):
    """(n, L) nats per symbol and (n,) symbols of each text."""
    sums, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    pile, owner, size = [], [], 0

    def settle():
        if pile:
            logs = model.logs(np.concatenate(pile))
            starts = np.cumsum([0] + [len(p) for p in pile[:-1]])
            np.subtract.at(sums, owner, np.add.reduceat(logs, starts, axis=0, dtype=np.float64))

    for i, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), 4 * _SLICE):
            codes = model.codes(text[max(0, at - 3):at + 4 * _SLICE])
            if codes is None or not len(codes):
                continue
            n[i] += len(codes)
            pile.append(codes)
            owner.append(i)
            size += len(codes)
            if size >= _SLICE:
                settle()
                pile, owner, size = [], [], 0
    settle()
    return sums / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", letters: int = 55) -> Model:
    """Fit on all labelled texts that are not held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    grams = written(gram_counts(labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))), "grams")
    last = F.col("gram").bitwiseAND(0xFFFF)
    frequent = grams.groupBy(last.alias("letter")).agg(F.sum("n").alias("n")).where("letter > 0").orderBy(F.desc("n"), "letter").limit(letters).collect()
    symbol = np.zeros(1 << 16, np.uint8)
    begin = 1
    for end, block in _BLOCKS:
        symbol[begin:min(end, 1 << 16)] = block
        begin = end
    for i, r in enumerate(frequent):
        symbol[r["letter"]] = 9 + i

    def recode(batches):
        for b in batches:
            g = b.column("gram").to_numpy().view(np.uint64)
            code = np.zeros(len(g), np.int64)
            for shift in (48, 32, 16, 0):
                code = code << BITS | symbol[(g >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64)]
            yield arrow_rows(["lang", "code", "n"], [pa.string(), pa.int64(), pa.int64()], [b.column("lang"), code, b.column("n")])

    coded = grams.mapInArrow(recode, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = coded.toArrow()  # at most 64^4 rows per language
    lang, code, n = (table.column(c).to_numpy() for c in ("lang", "code", "n"))
    langs = sorted(set(lang))
    counts = []
    for x in langs:
        mine = lang == x
        order = np.argsort(code[mine])
        counts.append((code[mine][order].astype(np.uint32), n[mine][order]))
    return Model(symbol, langs, counts)


def identified(docs: DataFrame, model: Model, text_col: str = "text", evidence: int = 60, slack: float = 1.0, z: float = 6.0) -> DataFrame:
    """`docs` with the columns __lang_pred, __score, __entropy and __rejected."""
    from pyspark.sql.types import StructType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = StructType().add("__lang_pred", "string").add("__score", "double").add("__entropy", "double").add("__rejected", "boolean")
    names = docs.columns
    where = names.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(where).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
            if m.langs:
                h, n = _entropies(m, texts)
                best = h.argmin(axis=1)
                h_best = h[np.arange(len(texts)), best]
                share = 1 / np.exp((h_best[:, None] - h) * np.minimum(n, evidence)[:, None]).sum(axis=1)
                known = np.array([_has_letter(t) if k == 0 else True for t, k in zip(texts, n)], bool)
                limit = m.mean[best] + slack + z * m.spread[best] / np.sqrt(np.maximum(n, 1))
                lang = [m.langs[i] if ok else "und" for i, ok in zip(best, known)]
                score = np.where(known, share, 0.0)
                entropy = np.where(known, h_best, np.nan)
                rejected = ~known | (h_best > limit)
            yield arrow_rows([*names, "__lang_pred", "__score", "__entropy", "__rejected"],
                             [*(f.type for f in b.schema), pa.string(), pa.float64(), pa.float64(), pa.bool_()], [*b.columns, lang, score, entropy, rejected])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def _has_letter(text) -> bool:
    return bool(text) and len(letter_stream(text)) > 2


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, held_out, lang_pred, score, cross_entropy, rejected), one row per row of `docs`."""
    made = identified(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text", **options)
    return made.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"),
                       F.col("__score").alias("score"), F.col("__entropy").alias("cross_entropy"), F.col("__rejected").alias("rejected"))
