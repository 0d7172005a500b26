"""Exact token counts at every prefix of a text.

A text's steps say by how much each further character changes the number of tokens of
what has been read so far; their running sum is the count of every prefix, so budget and
truncation questions need no more encoding.  Counts are those of the tokenizers library for the
prefix as a text of its own.

Within a word (what the vocabulary's splitting leaves together) steps come from dynamic
programming: the encoding of a prefix ends with the one token that may follow the
encoding of what is before it, and two tokens may follow each other if their joint text is encoded
as just these two.  So a prefix's last token and count follow from those of shorter prefixes.

Words are independent of each other but for these cases, which are looked after:

* a run of white space gives its last character to what follows, but a prefix
  that ends within the run has all of it as one word;
* 're, 've and 'll are words, though their first two characters are not;
* a special token counts one, though its characters are ordinary ones until it is complete.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quire.llm.common import hold, materialize
from quire.llm.words import _MARKS, _SPACED, _UNSAFE, Generations, byte_alphabet, splitting, vocabulary

#: Entries of a generation of each cache, rows that are answered together.
CACHED, ROWS = 300_000, 500
#: Characters at the start of words whose prefixes are kept.
HEAD = 6
_LATE = ("'re", "'ve", "'ll")
#: What the vocabulary's splitting takes as white space.
_SPACE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
STEPS = "doc_id long, n_bytes long, steps binary"


class PrefixCounter:
    """Steps of whole texts, as little-endian 16-bit integers, one for each character."""

    def __init__(self, path: str, most: int = CACHED):
        if splitting(path) != "spaced":
            raise ValueError(f"{path}: prefixes are counted for byte-level vocabularies without a normalizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        ends: dict[str, set[int]] = {}
        for token in self.vocab:
            ends.setdefault(token[-2:], {1}).add(len(token))
        # of the tokens that end with the same two characters
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.printable = dict(enumerate(byte_alphabet()))
        self.follows = Generations(self._follows, most)
        self.heads = Generations(self._run, most)
        self.words = Generations(self._word, most)
        self.pieces = Generations(self._piece, most)

    def _follows(self, pair: tuple[str, str]) -> bool:
        """Whether the encoding of these two tokens' text is these two; the first may be none."""
        return [x.value for x in self.model.tokenize("".join(pair))] == [x for x in pair if x]

    def counts(self, word: str) -> list[int]:
        """How many tokens each prefix of a word of byte characters has, from the empty one on."""
        return self._run(word)[1]

    def _run(self, word: str) -> tuple[list[str], list[int]]:
        """The last token and the count of each prefix; words that begin alike share those of their first characters."""
        vocab, follows, lengths = self.vocab, self.follows, self.lengths
        last, count = map(list, self.heads[word[:HEAD]]) if len(word) > HEAD else ([""], [0])
        for i in range(len(count), len(word) + 1):
            for n in lengths.get(word[i - 2 : i] if i > 1 else word[0], (1,)):  # longest first
                if n > i:
                    continue
                token, before = word[i - n : i], last[i - n]
                if token in vocab and follows[before, token]:
                    last.append(token)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends the prefix {word[:i]!r}")
        return last, count

    def _word(self, word: str) -> list[int]:
        """Counts after each character of a word of text."""
        if word.isascii():
            return self.counts(word.translate(self.printable))[1:]
        count = self.counts(word.encode().decode("latin-1").translate(self.printable))
        return [count[i] for i in accumulate([len(c.encode()) for c in word])]

    def _prefixes(self, words: list[str]) -> list[int]:
        """Counts after each character of a text, from the words that the whole of it is split into."""
        out, base, k = [], 0, 0
        while k < len(words):
            word, following = words[k], words[k + 1] if k + 1 < len(words) else ""
            if following and following[0] in _SPACE and _SPACE.issuperset(word):
                # the run's last character is a word of its own or begins the next one: prefixes that end within the run have all of it
                run, rest = self.words[word + following[0]], self.words[following]
                out += [base + x for x in run]
                base += run[-2]
                out += [base + x for x in rest[1:]]
                base += rest[-1]
                k += 2
                continue
            found = self.words[word]
            if word in _LATE:
                found = [1, 1 + self.words[word[1]][0], found[-1]]
            out += [base + x for x in found]
            base += found[-1]
            k += 1
        return out

    def _general(self, text: str) -> list[int]:
        """Counts after each character of any text."""
        out, base, at = [], 0, 0
        for found in [*self.special.finditer(text), None]:
            end = found.start() if found else len(text)
            ordinary = text[at : found.end() - 1 if found else end]
            counts = self._prefixes([ordinary[a:b] for _, (a, b) in self.split(ordinary)])
            out += [base + x for x in counts]
            if found:
                base += (counts[end - at - 1] if end > at else 0) + 1
                out.append(base)
                at = found.end()
        return out

    def _piece(self, piece: str) -> bytes | None:
        """Steps of what stands between single spaces, with the space before it; none where that can't be taken alone."""
        if piece == "\n":
            return _packed(self.words["\n"])
        glued = piece[:1] == "\0"
        body = piece[1:] if glued else piece
        if glued and not body:
            return b""
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        text = body if glued else " " + body
        if body[-1] in _MARKS and body[:-1].isalpha() and body.isascii():
            return self.pieces["\0" + body[:-1] if glued else body[:-1]] + self.pieces["\0" + body[-1]]
        if _UNSAFE.search(body):
            return _packed(self._general(text))
        return _packed(self._word(text) if body.isalpha() else self._prefixes(_SPACED.findall(text)))

    def steps(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = None
        if "\0" not in text and "\n\n" not in text and "\n " not in text and " \n" not in text and not text[0].isspace() and not text[-1].isspace():
            try:
                out = b"".join(map(self.pieces.__getitem__, ("\0" + text.replace("\n", " \n \0")).split(" ")))
            except TypeError:
                out = None
        if out is None:
            out = _packed(self._general(text))
        for cache in (self.follows, self.heads, self.words, self.pieces):
            cache.turn()
        return out


def _packed(counts: list[int]) -> bytes:
    """Steps of counts; an OverflowError if a character changes the number by more than 16 bits hold."""
    steps = array("h", map(sub, counts, chain((0,), counts)))
    if sys.byteorder == "big":
        steps.byteswap()
    return steps.tobytes()


def counts(steps: bytes) -> np.ndarray:
    """How many tokens the prefixes of 1, 2, ... characters have."""
    return np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64) if len(steps) else np.zeros(0, np.int64)


def longest(counted: np.ndarray, budget: int) -> int:
    """The characters of the longest prefix of at most so many tokens."""
    fits = np.flatnonzero(counted <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_MADE: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    hold("prefix", _MADE.clear)
    if path not in _MADE:
        _MADE[path] = PrefixCounter(path)
    return _MADE[path]


def steps(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and steps of every row; a null text is an empty one, and that has no steps.

    Null and repeated ids are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _counter(path)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                size = pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)
                found = pa.array([made.steps(x) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), size, found], names=["doc_id", "n_bytes", "steps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, STEPS)


def answers(stored: DataFrame, limits: list[int]) -> DataFrame:
    """doc_id, n_bytes, n_tokens and fits (for each limit the characters of the longest prefix of at most so many tokens), from stored steps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, fits = [], []
            for x in batch.column(2):
                counted = counts(x.as_buffer() or b"")
                total.append(int(counted[-1]) if len(counted) else 0)
                fits.append([longest(counted, n) for n in limits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(fits, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_tokens", "fits"])

    return stored.select("doc_id", "n_bytes", "steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fits array<long>")


def count_tokens(docs: DataFrame, vocab: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit) and limit_chars (of the longest prefix within it) of every row.

    The steps are stored in the shared folder, and the answers come from what is read back.
    """
    stored = materialize(steps(docs, vocab, id_col, text_col), "prefixes")
    found = answers(stored, [limit])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("fits")[0].alias("limit_chars"))


def slices(steps_: bytes, budget: int) -> list[tuple[int, int]]:
    """A text cut from its start, without encoding, into parts (first character, one after the last) of at most budget of its own tokens by the text's counts.

    A part ends where its text's count has grown by the budget at most.
    """
    counted, at = np.append(0, counts(steps_)), 0
    cuts = [0]
    while at < len(counted) - 1:
        fits = np.flatnonzero(counted[at + 1 :] <= counted[at] + budget)
        at = at + 1 + int(fits[-1]) if len(fits) else at + 1
        cuts.append(at)
    return list(pairwise(cuts))


def truncated(docs: DataFrame, vocab: str, limit: int, text_col: str = "text", out: str = "truncated") -> DataFrame:
    """docs with the longest prefix of each text that has at most limit tokens, in the column out; null stays null."""
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _counter(path)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                cut = [None if x is None else x[: longest(counts(made.steps(x)), limit)] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cut, pa.string())], names=[*part.schema.names, out])

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.StringType())]))
