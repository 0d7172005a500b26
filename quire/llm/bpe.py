"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie end to end in one symbol array with links to the
next and previous live symbol.  The index maps each mergeable pair to all its
positions in the batch.  Active ranks are taken in ascending order; one rank is
applied at all its positions at once, and the pairs that a merge makes are entered
in the lists of their own ranks.  Words and their results are kept between batches
in a cache of bounded size.

Results equal the tokenizers library's encode(text, add_special_tokens=False) and
decode(ids, skip_special_tokens=False) without truncation and padding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hold
from quire.llm.words import byte_alphabet, vocabulary

#: How byte-level vocabularies split a text; fixed by their format.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_NONE = np.int32(-1)
_MESSY = re.compile(r"\s\s")


class PairIndex:
    """Merges all words of a batch together, rank by rank."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        """pairs: left << 32 | right in ascending order of rank; merged: the id that each makes."""
        self.order = np.argsort(pairs, kind="stable")
        self.sorted, self.pairs, self.merged = pairs[self.order], pairs, merged

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], -1)

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: initial ids of all words; ends: where each word ends.  Returns the ids and their ends."""
        n = len(symbols)
        symbols, alive = symbols.astype(np.int32), np.ones(n, bool)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = _NONE
        before[np.concatenate(([0], ends[:-1]))] = _NONE
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Adds the pairs that begin at these positions to the lists of their ranks."""
            rank = self.ranks(symbols[at], symbols[after[at]])
            known = rank >= 0
            rank, at = rank[known], at[known]
            if not len(at):
                return
            if len(at) == 1:
                groups = ((int(rank[0]), at),)
            else:
                by = np.argsort(rank, kind="stable")
                rank, at = rank[by], at[by]
                edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate(([0], edges))].tolist(), np.split(at, edges), strict=True)
            for r, positions in groups:
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after != _NONE).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = int(self.pairs[r] >> 32), int(self.pairs[r] & 0xFFFFFFFF)
            following = after[at]
            live = alive[at] & (symbols[at] == left) & (following != _NONE)
            live[live] = symbols[following[live]] == right
            at, following = at[live], following[live]
            if left == right and len(at) > 1:
                # in a run of one symbol every second pair overlaps the one before it
                at.sort()
                following = after[at]
                fresh = np.concatenate(([True], at[1:] != following[:-1]))
                place = np.arange(len(at))
                keep = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
                at, following = at[keep], following[keep]
            if not len(at):
                continue
            symbols[at] = self.merged[r]
            alive[following] = False
            beyond = after[following]
            after[at] = beyond
            inner = beyond != _NONE
            before[beyond[inner]] = at[inner]
            front = before[at]
            enter(np.concatenate((front[front != _NONE], at[inner])) if len(at) == 1 else np.unique(np.concatenate((front[front != _NONE], at[inner]))))
        return symbols[alive], np.cumsum(alive)[ends - 1]


class Codec:
    """A byte-level vocabulary; encodes and decodes batches of whole texts."""

    def __init__(self, path: str, most: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        back = {c: b for b, c in enumerate(alphabet)}
        self.initial = np.array([vocab[c] for c in alphabet], np.int32)
        self.index = PairIndex(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64), np.array([vocab[a + b] for a, b in merges], np.int32))
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of.update({i: content.encode() for content, i in self.special.items()})
        self.text_of = {i: b"%d" % i for i in self.bytes_of}
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most, self.pieces = most, {}

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand as words of their own, before any splitting."""
        if any(x in text for x in self.special):
            return list(chain.from_iterable([x] if x in self.special else SPLIT.findall(x) for x in self.between.split(text)))
        return SPLIT.findall(text)

    def cut(self, text: str | None) -> list[str]:
        """Pieces of a text that can be split alone.

        A word begins at every space, and around every newline, with no other
        white space beside it.  A piece that begins with NUL stands as it is,
        any other but the newline has a space before it.
        """
        if not text:
            return []
        if "\0" in text or _MESSY.search(text):
            return ["\0" + x for x in self.split(text)]
        return ("\0" + text.replace("\n", " \n \0")).split(" ")

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of these words, all merged together."""
        raw, out, low = [x.encode() for x in words], {}, 0
        ids, ends = self.index.merge(self.initial[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([len(x) for x in raw]))
        ids = ids.tolist()
        for word, end in zip(words, ends.tolist(), strict=True):
            out[word], low = tuple(ids[low:end]), end
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; None is the empty text."""
        if len(self.pieces) > self.most:
            self.pieces.clear()
        known, met = self.pieces, set()
        for text in texts:
            met.update(self.cut(text))
        new = {}
        for piece in met.difference(known):
            word = piece if piece == "\n" else piece[1:] if piece[:1] == "\0" else " " + piece
            new[piece] = [word] if piece.isalpha() else self.split(word)
        words = {i: (n,) for i, n in self.special.items()}
        if unknown := sorted(set(chain.from_iterable(new.values())).difference(words)):
            words |= self.learn(unknown)
        for piece, parts in new.items():
            known[piece] = words[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(words.__getitem__, parts)))
        del met, new, words
        for text in texts:
            yield list(chain.from_iterable(map(known.__getitem__, self.cut(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_MADE: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    hold("bpe", _MADE.clear)
    if path not in _MADE:
        _MADE[path] = Codec(path)
    return _MADE[path]


def _blocks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each."""
    sizes = [len(x) if x else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()]
    low = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    yield batch.slice(low)


def round_trip(docs: DataFrame, vocab: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of each row.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the text
    decoded from those ids.  Null and empty texts have no ids and decode to the
    empty text.  Every row gives one; repeated rows give equal ones.
    """
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            for part in _blocks(batch, 1, block_bytes):
                counts, digests, back, streams, texts = [], [], [], [], []
                for ids in made.encode(part.column(1).to_pylist()):
                    decoded = made.decode(ids)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(b",".join(map(made.text_of.__getitem__, ids))).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        streams.append(ids)
                        texts.append(decoded)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    columns += [pa.array(streams, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] * with_ids)])

    spec = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spec)
