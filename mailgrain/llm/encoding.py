"""Token ids of whole texts with a vocabulary file of the `tokenizers` library.

The library's full pipeline costs about 1 µs per byte, nearly all of it in normalising and splitting. Pieces between
blanks repeat a lot, and neither of the two splitting rules below looks across such a border, so an encoder keeps
the ids of the pieces it has seen (bounded, per Python worker) and asks the file's BPE model only for new ones.
Texts with characters outside the checked range, odd blanks, or files with other rules go through the library's
full `encode`; so the result always equals it (tests/llm/test_encoding.py).
"""

import gc
import json
import re
import unicodedata
from array import array
from contextlib import contextmanager
from operator import attrgetter

import numpy as np

_ID = attrgetter("id")
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įĲ-ſ]*")
_LETTERS = "".join(chr(i) for i in range(0xA1, 0x180) if unicodedata.category(chr(i))[0] == "L")
_NUMBERS = "".join(chr(i) for i in range(0xA1, 0x180) if unicodedata.category(chr(i))[0] == "N")
_CLASSES = dict(L=f"A-Za-z{_LETTERS}", N=f"0-9{_NUMBERS}", S="\t\n\r ")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(**_CLASSES))
_BYTES = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(**_CLASSES))


def _byte_characters():
    """The printable character that stands for each byte in byte-level vocabularies."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class _Known(dict):
    """Ids by piece; a new piece is encoded when it is first looked up."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece):
        got = self[piece] = self.encode(piece)
        return got


class Encoder:
    """`ids(text)`: little-endian unsigned 32-bit ids as bytes; strings of special tokens are ordinary text."""

    def __init__(self, path: str, most_kept: int = 500_000):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.model = self.full.model
        with open(path) as f:
            spec = json.load(f)
        before, rule = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in (before or {}).get("normalizers", [])]
        split = [x.get("type") for x in rule.get("pretokenizers", [])]
        self.kind = None
        if before is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space"):
            self.kind = "bytes"
        elif steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] and not rule["pretokenizers"][1]["use_regex"]:
            self.kind = "words"
        self.most_kept = most_kept
        self.kept, self.words = _Known(self._piece), _Known(self._tokens)
        self.as_bytes = str.maketrans({chr(k): v for k, v in _byte_characters().items()})

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without inner blanks (kind bytes: with one blank before it)."""
        if self.kind == "words":
            piece = piece.lower()
            if piece.isalpha():
                return self._tokens(piece)
            parts = _WORDS.findall(piece)
        elif piece.isalpha():
            return self._tokens(" " + piece)
        elif piece[-1] in ".," and piece[:-1].isalpha():  # a word and the mark that ends it
            return self.kept[piece[:-1]] + self.words[piece[-1]]
        else:
            parts = _BYTES.findall(" " + piece)
        return b"".join(map(self.words.__getitem__, parts))

    def _tokens(self, w: str) -> bytes:
        if w.isascii() and w.isprintable():
            s = w.replace(" ", "\u0120")  # the only one of these characters that has another one standing for it
        else:
            s = w.encode().decode("latin-1").translate(self.as_bytes)
        return array("I", map(_ID, self.model.tokenize(s))).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of one pre-token."""
        if len(self.words) > self.most_kept:
            self.words.clear()
        return self.words[w]

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind is None or not (text.isascii() and text.isprintable()) and not _PLAIN.fullmatch(text):
            return self.whole(text)
        for known in (self.kept, self.words):
            if len(known) > self.most_kept:
                known.clear()
        if self.kind == "words":
            return b"".join(map(self.kept.__getitem__, text.split()))
        pieces = self.blank_pieces(text)
        if pieces is None:
            return b"".join(map(self.words.__getitem__, _BYTES.findall(text)))
        first = b"".join(map(self.words.__getitem__, _BYTES.findall(pieces[0])))  # no blank before it
        return first + b"".join(map(self.kept.__getitem__, pieces[1:]))

    @staticmethod
    def blank_pieces(text: str):
        """Pieces between single blanks, if pre-tokens begin at every blank; else None. Takes plain text only."""
        pieces = text.split(" ")
        if not all(pieces) or "\n " in text or " \n" in text or "\t" in text or "\r" in text:
            return None
        return pieces

    def is_plain(self, text: str) -> bool:
        return self.kind == "bytes" and _PLAIN.fullmatch(text) is not None

    def sizes(self, pieces):
        """Number of ids of pieces that follow a blank."""
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        return [len(self.kept[p]) // 4 for p in pieces]

    def pre_tokens(self, text: str):
        """The splitting rule of kind bytes, on any text (falls back to the library's own splitter)."""
        if self.kind == "bytes" and _PLAIN.fullmatch(text):
            return _BYTES.findall(text)
        spans = self.full.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]


_ENCODERS = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@contextmanager
def no_collections():
    """No searches for reference cycles while texts are encoded: each new piece makes a list of tokens, none of them cyclic."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
