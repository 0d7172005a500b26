"""Encoding of whole texts with the BPE models of the tokenizers library, word by word.

Library calls on whole texts spend most of their time on offsets and Unicode
splitting.  Both vocabularies used here split a text before every single space
that a non-space follows, and around single newlines, so a text can be cut there
with ``str.split`` and every piece encoded alone.  Pieces of plain Latin letters,
digits and punctuation are split by an equivalent ``re`` pattern and given to the
library's BPE model; any other piece goes to the library whole; and a text with
runs of white space, where such cuts could matter, goes there undivided.  Results
equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
import struct

from tokenizers import Tokenizer

from quire.llm.common import hold

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters on which ``re`` and the library are known to agree.
_UNSAFE = re.compile(rf"[^!-~{_LETTERS}]|<\|")
_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+")
_LOWERED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: What a byte-level vocabulary has for a space, and marks that are words of their own after a word.
_SPACE, _MARKS = byte_alphabet()[32], tuple(",.;:!?")


#: How the two known vocabularies split a text, as their files say it.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def splitting(path: str) -> str:
    """How a vocabulary file of the tokenizers library splits texts: "spaced" (byte-level, spaces belong to words) or "lowered" (lower case, no white space).

    Any other normalizer, splitting or model raises a ValueError, as do special tokens
    that look at what is around them: the cuts made here aren't known to be right for those.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    plain = lambda x: {k: v for k, v in (x or {}).items() if k != "trim_offsets"}
    before, normal, model = told.get("pre_tokenizer"), told.get("normalizer"), told.get("model") or {}
    alone = all(not x[k] for x in told.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if alone and all(model.get(k) == v for k, v in _MODEL.items()):
        if normal is None and plain(before) == _BYTES and not model.get("end_of_word_suffix"):
            return "spaced"
        steps = [plain(x) for x in (before or {}).get("pretokenizers", [])]
        if (normal or {}).get("normalizers") == _NORMAL and steps == [_SPLIT, _BYTES | {"use_regex": False}]:
            return "lowered"
    raise ValueError(f"{path}: texts of this vocabulary can't be cut into words here; use the tokenizers library on whole texts")


class Generations(dict):
    """A cache of bounded size: entries not met during a whole generation are forgotten.

    Hits cost one dictionary look-up.  ``turn()`` is called between texts.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    path: vocabulary file of the tokenizers library.  most: entries that a cache
    generation holds, of about 200 bytes each; there are two generations.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.lowers = splitting(path) == "lowered"
        # one character per byte, as bytes.decode("latin-1") gives them
        self.printable = dict(enumerate(byte_alphabet()))
        self.pieces = Generations(self._piece, most)
        self.newline = self._library("\n")

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of what the vocabulary's splitting leaves together."""
        return self._ids(word.encode().decode("latin-1").translate(self.printable))

    def _ids(self, printable: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(printable)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes | None:
        if self.lowers:
            if not piece:
                return b""
            if _UNSAFE.search(piece):
                return self._library(piece)
            if (lowered := piece.lower()).isalpha():
                return self._ids(lowered) if lowered.isascii() else self._word(lowered)
            if lowered[-1] in _MARKS and lowered[:-1].isalpha():
                return self.pieces[lowered[:-1]] + self.pieces[lowered[-1]]
            words = _LOWERED.findall(lowered)
            return self._word(lowered) if words == [lowered] else b"".join([self.pieces[w] for w in words])
        if piece.isascii():  # the common ones: a word, or one with a mark after it
            if piece.isalpha():
                return self._ids(_SPACE + piece)
            if piece[-1:] in _MARKS and piece[:-1].isalpha():
                return self.pieces[piece[:-1]] + self.pieces["\0" + piece[-1]]
        if piece == "\n":
            return self.newline
        glued = piece[:1] == "\0"
        body = piece[1:] if glued else piece
        if not body or body[0].isspace() or body[-1].isspace():
            return None  # white space in a row: this text is not cut
        text = body if glued else " " + body
        if _UNSAFE.search(body):
            return self._library(text)
        if body.isalpha():
            return self._word(text)
        words = _SPACED.findall(text)
        if words == [text]:
            return self._word(text)
        return b"".join([self.pieces[w[1:] if w[0] == " " else "\0" + w] for w in words])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "\0" in text:
            return self._library(text)
        if self.lowers:
            out = b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        else:
            parts = ("\0" + text.replace("\n", " \n \0")).split(" ")
            if parts[-1] == "\0":
                parts.pop()
            try:
                out = b"".join(map(self.pieces.__getitem__, parts))
            except TypeError:
                out = self._library(text)
        self.pieces.turn()
        return out


_MADE: dict[str, WordEncoder] = {}


def encoder(path: str, most: int = 600_000) -> WordEncoder:
    """The encoder of this Python worker, whose caches outlive tasks."""
    hold("words", _MADE.clear)
    if path not in _MADE:
        _MADE[path] = WordEncoder(path, most)
    return _MADE[path]


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: a path is taken as it is, a bare name is looked up in public_tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
