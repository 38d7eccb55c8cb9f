"""Edit-aware token counts: a segment tree of pre-token groups per document.

A leaf holds up to `LEAF` pieces between blanks (or pre-tokens, where blanks are irregular); every node holds the characters and tokens below it. An edit finds its leaves by
descending on characters, goes back far enough for the splitting rule's look-ahead (`CONTEXT` characters), splits and
encodes that region anew together with the leaf behind it, and takes in one more leaf at a time until a pre-token ends
exactly where an old leaf ended; from there on all old pre-tokens stay as they were, since the splitting rule looks at
nothing behind its position. Only the sums above the touched leaves change. The count therefore equals that of
encoding the edited text from scratch.

Trees travel as two integer arrays (heap order, root at 1) beside the text, so counts can be kept with documents and
updated where the documents lie: no shuffle. Null text is empty (a tree of one empty leaf, 0 tokens); null edits are
none. Edits hold start, length (code points of the old text) and the new text; they are taken in order of start;
parts beyond the text are cut off and an edit that begins inside an earlier one is refused with ValueError. Repeated
rows repeat their result; other columns are ignored; an empty table gives an empty result.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows
from .encoding import encoder, vocabulary

LEAF = 16
CONTEXT = 3
NEAR = 120  # characters between edits that are taken as one region

_SYMBOLS = re.compile(r"([#*$%&|<>])\1+")


class TokenTree:
    """Sums of characters and tokens over a document's leaves; `leaves` holds their texts."""

    def __init__(self, enc, text: str, chars=None, tokens=None):
        self.enc, self.source = enc, text
        if chars is None:
            pieces = enc.blank_pieces(text) if enc.is_plain(text) else None
            if pieces:  # whole pieces between blanks are counted at once
                sizes = [self.count(enc.pre_tokens(pieces[0])), *enc.sizes(pieces[1:])]
                self.leaves = [" ".join(pieces[i:i + LEAF]) for i in range(0, len(pieces), LEAF)]
                self.leaves[1:] = [" " + x for x in self.leaves[1:]]
                tokens = [sum(sizes[i:i + LEAF]) for i in range(0, len(sizes), LEAF)]
            else:
                words = enc.pre_tokens(text)
                groups = [words[i:i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
                self.leaves = ["".join(g) for g in groups]
                tokens = [*map(self.count, groups)]
            n = len(self.leaves)
            self.size = 1 << (n - 1).bit_length()
            self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
            self.chars[self.size:self.size + n] = map(len, self.leaves)
            self.tokens[self.size:self.size + n] = tokens
            for i in range(self.size - 1, 0, -1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        else:
            self.size, self.chars, self.tokens, self.leaves = len(chars) // 2, list(chars), list(tokens), []
            at = 0
            for n in self.chars[self.size:]:
                self.leaves.append(text[at:at + n])
                at += n
        self.encoded = 0

    def count(self, words) -> int:
        kept, word = self.enc.words, self.enc.word
        return sum([len(kept[w]) if w in kept else len(word(w)) for w in words]) // 4

    def find(self, at: int):
        """(leaf, its first character) for the character at `at`; the last non-empty leaf beyond the end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def put(self, leaf: int, text: str, tokens: int):
        self.leaves[leaf] = text
        i = leaf + self.size
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, length: int, text: str):
        """Replace `length` characters at `start` by `text`."""
        low, begin = self.find(max(0, start - CONTEXT))
        high = max(low, self.find(max(start, start + length - 1))[0])
        last = len(self.leaves) - 1
        old = "".join(self.leaves[low:high + 1])
        new = old[:start - begin] + text + old[start - begin + length:]
        while True:
            behind = high + 1
            while behind <= last and not self.leaves[behind]:
                behind += 1
            ahead = self.leaves[behind] if behind <= last else ""
            words, at = [], 0
            for w in self.enc.pre_tokens(new + ahead):
                if at >= len(new):
                    break
                words.append(w)
                at += len(w)
            if at == len(new):
                break
            new, high = new + ahead, behind
        self.encoded += len(words)
        leaves = high - low + 1
        share = max(1, -(-len(words) // leaves))
        for k in range(leaves):
            part = words[k * share:(k + 1) * share]
            self.put(low + k, "".join(part), self.count(part))

    def apply(self, edits):
        """Edits in old coordinates; applied from the right, so that places to the left stay valid."""
        total = self.chars[1]
        edits = sorted((max(0, s), n, t or "") for s, n, t in edits if s < total or s == total)
        for (s, n, _), (following, _, _) in zip(edits, edits[1:]):
            if s + n > following:
                raise ValueError("edits overlap")
        runs = []
        for s, n, t in edits:
            n = min(n, total - s)
            if runs and s - (runs[-1][0] + runs[-1][1]) <= NEAR:  # near edits share their leaves: one region for both
                first, m, parts = runs[-1]
                parts += [self.source[first + m:s], t]
                runs[-1] = first, s + n - first, parts
            else:
                runs.append((s, n, [t]))
        for s, n, parts in reversed(runs):
            self.edit(s, n, "".join(parts))
        return len(edits)

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def cleaning_edits(text: str):
    """Edits of a cleaning pass: runs of one symbol go, a line that repeats an earlier line goes with its line break."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line in seen and line.strip():
            out.append((at - 1, len(line) + 1, ""))
        else:
            seen.add(line)
            out += [(at + m.start(), m.end() - m.start(), "") for m in _SYMBOLS.finditer(line)]
        at += len(line) + 1
    return out


def with_trees(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, chars, tokens): every document with its tree."""
    path = tokenizer or vocabulary("byte_bpe_50k.json")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            trees = [TokenTree(enc, t.as_py() or "") for t in b.column(1)]
            ints = pa.list_(pa.int32())
            yield arrow_rows([id_col, "text", "chars", "tokens"], [b.schema.field(0).type, pa.string(), ints, ints],
                             [b.column(0), b.column(1), [t.chars for t in trees], [t.tokens for t in trees]])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, text string, chars array<int>, tokens array<int>")


def edited(trees: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", edits_col: str | None = None, texts: bool = False) -> DataFrame:
    """Apply the edits in `edits_col` (array<struct<start, length, text>>; none: a cleaning pass) to rows of `with_trees`.

    (id_col, n_tokens, n_edits, n_tokens_after, n_encoded), and with `texts` the new text and tree. `n_encoded` counts
    the pre-tokens that were encoded again."""
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    names = [id_col, "n_tokens", "n_edits", "n_tokens_after", "n_encoded"] + ["text", "chars", "tokens"] * texts

    def run(batches):
        enc = encoder(path)
        ints = pa.list_(pa.int32())
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                tree = TokenTree(enc, text, b.column(2)[i].values.to_pylist(), b.column(3)[i].values.to_pylist())
                before = tree.tokens[1]
                edits = cleaning_edits(text) if edits_col is None else [(e["start"], e["length"], e["text"]) for e in b.column(4)[i].as_py() or ()]
                n = tree.apply(edits)
                rows.append((before, n, tree.tokens[1], tree.encoded) + ((tree.text, tree.chars, tree.tokens) if texts else ()))
            types = [b.schema.field(0).type] + [pa.int64()] * 4 + [pa.string(), ints, ints] * texts
            yield arrow_rows(names, types, [b.column(0), *(zip(*rows) if rows else [[]] * (len(names) - 1))])

    kept = trees.select(id_col, "text", "chars", "tokens", *([edits_col] if edits_col else []))
    schema = f"`{id_col}` {dict(kept.dtypes)[id_col]}, n_tokens long, n_edits long, n_tokens_after long, n_encoded long"
    return kept.mapInArrow(run, schema + ", text string, chars array<int>, tokens array<int>" * texts)
