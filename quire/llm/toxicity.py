"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on ordinary and on toxic text.  A text is
cut into overlapping windows; each is compressed with the ordinary dictionary and with
the ordinary one followed by the toxic one.  A window's distance is how many bytes
the toxic dictionary saves.  Distances below a threshold don't count; a document's score comes
from the largest of the others, their sum, and the number of its windows.  Threshold
and score are calibrated on labelled texts that the dictionaries weren't trained on.

Toxic texts are marked as wholes, though most of what is in them is like any other text.
What the toxic dictionary is trained on are therefore the stretches that set them apart:

1. For every GRAM-byte string of a toxic text it's counted in how many toxic and ordinary texts
   it occurs.  What stands in a text in the same 16 bytes as in an earlier one is taken
   for a copied passage and counts once.
2. Strings of equally many texts are taken together.  If labels had nothing to do with them, so
   many or more of a string's texts would be toxic with a binomial probability.  Strings
   are taken as long as the expected number of those that got there by chance is at most FALSE_SHARE of
   those that did (Benjamini and Hochberg's rule within each frequency).  So wording in a handful of toxic
   texts counts if strings as rare as that are seldom in toxic texts alone.
3. Runs of such strings are the stretches; zstandard trains the dictionary on them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import held_out, hold, trim

#: Literals of so short a block are stored as they are, so a window's length is a count of bytes.
WINDOW, STRIDE = 62, 46
#: Bounds of training: labelled texts of each class, and bytes of the texts of a class, which are taken whole as long as they fit.
TOXIC_TEXTS, ORDINARY_TEXTS, TOXIC_LEARNT, ORDINARY_LEARNT = 1600, 6400, 8 << 20, 32 << 20
#: Bytes of the ordinary dictionary and of the toxic one.
ORDINARY_BYTES, TOXIC_BYTES = 112_640, 16_384
#: Bytes of a string and of a match, toxic texts that must have a string, how many times its share of ordinary texts its share of toxic ones is, the share of false strings.
GRAM, LEAST_TEXTS, TIMES, FALSE_SHARE = 6, 3, 40, 0.02
PREDICT = 0.3
#: A window can't save more bytes than this; thresholds that calibration tries.
MOST, THRESHOLDS = WINDOW + 16, range(2, 25)


def clean(text: str | None) -> bytes:
    """Lower case, with single spaces between words and around them, so that a word looks the same wherever it stands."""
    return b" " + b" ".join(text.lower().encode().split()) + b" " if text else b""


def windows(raw: bytes) -> list[bytes]:
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STRIDE), STRIDE)]


def grams(raw: bytes, size: int = GRAM) -> np.ndarray:
    """At every position the number that the next size bytes make, up to eight."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(b) - size + 1), np.int64)
    for k in range(size if len(out) else 0):
        out = out << 8 | b[k : k + len(out)]
    return out


def _contexts(raw: bytes) -> np.ndarray:
    """For every GRAM-byte string a hash of the 16 bytes around it."""
    n, eight = max(0, len(raw) - GRAM + 1), grams(bytes(5) + raw + bytes(16), 8)
    return eight[:n] * 0x5851F42D4C957F2D + (eight[8 : 8 + n] ^ eight[8 : 8 + n] >> 29) * 0x14057B7EF767814F


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of cleaned texts, and how many texts have each in a context that no earlier text has."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    contexts, at = np.empty(sum(max(0, len(x) - GRAM + 1) for x in texts), np.int64), 0
    for x in texts:
        mine = _contexts(x)
        contexts[at : at + len(mine)] = mine
        at += len(mine)
    first = np.zeros(len(contexts), bool)
    for part in range(8):  # an eighth of the memory at a time
        at = np.flatnonzero(contexts & 7 == part)
        first[at[np.unique(contexts[at], return_index=True)[1]]] = True
    del contexts
    found, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, len(texts), 200):  # what texts have in common is added up before the next ones come
        sets = [found]
        for x in texts[low : low + 200]:
            mine = grams(x)
            sets.append(np.unique(mine[first[at : at + len(mine)]]))
            at += len(mine)
        weights = np.concatenate([counts, np.ones(sum(map(len, sets[1:])), np.int64)])
        found, which = np.unique(np.concatenate(sets), return_inverse=True)
        counts = np.bincount(which, weights, len(found)).astype(np.int64)
    return found, counts


def _by_chance(there: int, n: int, p: float) -> float:
    """The probability that so many or more of n texts are toxic, where each is with probability p."""
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    return min(1.0, sum(math.exp(log(j)) for j in range(there, n + 1)))


def apart(toxic: list[bytes], ordinary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings that set toxic texts apart, sorted, and how many toxic texts have each."""
    found, there = _counted(toxic)
    total = there.copy()
    for raw in ordinary if len(found) else []:
        mine = np.unique(grams(raw))
        at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
        total[at[found[at] == mine]] += 1
    p, kept = len(toxic) / (len(toxic) + max(1, len(ordinary))), []
    for n in np.unique(total[there >= LEAST_TEXTS]).tolist():
        here = np.flatnonzero(total == n)
        # with those of n texts that no toxic one has
        of_n = len(here) / (1 - (1 - p) ** n)
        times, how_many = np.unique(there[here], return_counts=True)
        reach = np.cumsum(how_many[::-1])[::-1]  # strings with so many toxic texts or more
        for k, m in zip(times.tolist(), reach.tolist(), strict=True):
            if k >= LEAST_TEXTS and k * (1 - p) >= TIMES * (n - k) * p and _by_chance(k, n, p) * of_n <= FALSE_SHARE * m:
                kept.append(here[there[here] >= k])
                break
    kept = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    return found[kept], there[kept]


def stretches(toxic: list[bytes], strings: np.ndarray, there: np.ndarray) -> list[bytes]:
    """Runs of the strings in cleaned texts, as often as texts have them, in the order of their bytes.

    In a run only strings count that at least half as many texts have as the most frequent one:
    the others are its edge with what happened to stand next to it.
    """
    found: list[bytes] = []
    for raw in toxic if len(strings) else []:
        g = grams(raw)
        at = np.minimum(np.searchsorted(strings, g), len(strings) - 1)
        count = np.where(strings[at] == g, there[at], 0)
        mine = np.zeros(len(g), bool)
        for a, b in _runs(count > 0):
            mine[a:b] = 2 * count[a:b] >= count[a:b].max()
        found += {raw[a : b + GRAM - 1] for a, b in _runs(mine)}
    return sorted(found)


def _runs(mine: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses windows with a dictionary's content; frames have no field that isn't needed."""
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=GRAM, target_length=24,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=parameters)


def literals(frame: bytes, window: bytes) -> bytes:
    """The bytes of a window that its frame of a compressor() holds as literals: what its dictionary doesn't explain.

    Two bytes of frame header, three of block header, then the literals section.
    """
    if frame[2] >> 1 & 3 != 2:  # a block that isn't compressed
        return window
    kind, long = frame[5] & 3, frame[5] >> 2 & 1
    if kind:
        return b""
    size, at = ((frame[5] | frame[6] << 8) >> 4, 7) if long else (frame[5] >> 3, 6)
    return frame[at : at + size]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained by zstandard; empty without samples.  Samples are gone through again until they are enough for zstandard."""
    samples = [x for x in samples if len(x) > 8]
    if not samples:
        return b""
    turns = 1
    while True:
        try:
            return zstandard.train_dictionary(size, samples * turns, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            if turns >= 1024:  # all samples are one byte over and over
                return b""
            turns *= 2


def toxic_dictionary(found: list[bytes]) -> bytes:
    """Trained on stretches, in turns, the more often the more texts have them; those whose strings more frequent ones have are left out.

    Stretches are shorter than zstandard's samples, so each is repeated; it holds the
    last quarter of the samples back, so there are several turns.
    """
    turns, covered = {}, set()
    for x, n in sorted(Counter(found).items(), key=lambda c: (-c[1], c[0])):
        if not covered.issuperset(mine := grams(x).tolist()):
            covered.update(mine)
            turns[x] = 8 * n.bit_length()
    samples = [x * (128 // len(x) + 1) for turn in range(max(turns.values(), default=0)) for x in sorted(turns) if turns[x] > turn]
    return trained(samples, TOXIC_BYTES, 32)


@dataclass
class Model:
    """Dictionaries, and the weights of a logistic calibration; see fit()."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)
    threshold: int = THRESHOLDS[0]
    _made: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def distances(self, cut: list[bytes]) -> np.ndarray:
        """How many bytes the toxic dictionary saves in each window."""
        if not self.toxic:
            return np.zeros(len(cut), np.int64)
        if self._made is None:
            # the ordinary dictionary stands at the same distance from the window in both
            self._made = tuple(compressor(self.ordinary + x.rjust(TOXIC_BYTES, b"\0")).compress for x in (b"", self.toxic))
        plain, toxic = (np.fromiter(map(len, map(c, cut)), np.int64, len(cut)) for c in self._made)
        return plain - toxic

    def spectra(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """How many windows of each text have each distance, from 0 (and below) to MOST."""
        # all windows go through one compressor before the next, whose tables then stay in the processor's cache
        found = np.clip(self.distances([w for x in texts for w in x]), 0, MOST)
        return [np.bincount(x, minlength=MOST + 1) for x in np.split(found, np.cumsum([len(x) for x in texts])[:-1])] if texts else []

    def scores(self, texts: list[str | None], block: int = 1 << 20) -> Iterator[tuple[float, int]]:
        """Of each whole text, 0 to 1, the calibrated chance that it's toxic; and the largest distance that counts.  block: characters taken together."""
        weights = np.array(self.weights)
        for spectra in self._blocks([clean(t) for t in texts], block):
            x = np.array([_features(c, self.threshold) for c in spectra])
            yield from zip(_chance(x, weights).tolist(), np.rint(x[:, 1] * 8).astype(int).tolist(), strict=True)

    def _blocks(self, texts: list[bytes], block: int = 1 << 20) -> Iterator[list[np.ndarray]]:
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size < block):
                size, high = size + len(texts[high]), high + 1
            yield self.spectra([windows(t) for t in texts[low:high]])
            low = high

    def score(self, text: str | None) -> tuple[float, int]:
        return next(self.scores([text]))


def _features(counts: np.ndarray, threshold: int) -> tuple[float, float, float, float]:
    high = np.flatnonzero(counts[threshold:]) + threshold
    most, total = (int(high[-1]), int((counts[high] * high).sum())) if len(high) else (0, 0)
    return 1.0, most / 8, float(np.log1p(total)), float(np.log1p(counts.sum()))


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit(samples: list[tuple[str, int]]) -> Model:
    """samples: (text, 1 if toxic); equal samples in any order give equal models.

    Every fourth text of a class calibrates dictionaries that the others train; the
    toxic dictionary is then trained on all toxic texts.  Texts that are equal once
    cleaned count once, and empty ones not at all.  Without texts of both classes, or
    without anything that sets toxic ones apart, all scores are equal and low.
    """
    by = {y: sorted({clean(t) for t, z in samples if t and z == y} - {b"", b"  "}, key=lambda x: (zlib.crc32(x), x)) for y in (0, 1)}
    if not by[0] or not by[1]:
        return Model()
    training = {y: [x for i, x in enumerate(v) if i % 4] for y, v in by.items()}
    rest = [(x, float(y)) for y, v in by.items() for x in v[::4]]
    model = Model(trained(training[0] or by[0], ORDINARY_BYTES, 16), toxic_dictionary(stretches(training[1], *apart(training[1], training[0]))))
    spectra, truth = [c for block in model._blocks([x for x, _ in rest]) for c in block], np.array([y for _, y in rest])
    best = -np.inf
    for threshold in THRESHOLDS:
        x = np.array([_features(c, threshold) for c in spectra])
        w = _logistic(x, truth)
        p = np.clip(_chance(x, w), 1e-6, 1 - 1e-6)
        likely = float((truth * np.log(p) + (1 - truth) * np.log(1 - p)).sum())
        if likely > best:
            best, model.threshold, model.weights = likely, threshold, tuple(map(float, w))
    return Model(model.ordinary, toxic_dictionary(stretches(by[1], *apart(by[1], by[0]))), model.weights, model.threshold)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; both classes weigh as in the sample."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.02] + [1] * (x.shape[1] - 1))
    for _ in range(steps):
        p = _chance(x, w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, toxic_texts: int = TOXIC_TEXTS, ordinary_texts: int = ORDINARY_TEXTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled texts that may be learnt from: toxic_texts and ordinary_texts at most, drawn by a hash of the id.

    Texts are whole.  In the order of that hash they are taken until TOXIC_LEARNT and
    ORDINARY_LEARNT bytes are reached, and the one that reaches them is the last: the bound of rows
    for long texts, which the driver holds.  Only the ids that were drawn are broadcast, so
    no other text is shuffled.  An id that occurs in several rows counts with one of its texts,
    the one with the smallest hash; null ids and labels other than 0 and 1 aren't learnt from.
    """
    may = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    drawn = None
    for y, most in ((0, ordinary_texts), (1, toxic_texts)):
        one = may.filter((F.col("y") == y) & F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = one if drawn is None else drawn.unionByName(one)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = text.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0)))
    taken = before.filter(F.col("before") < F.when(F.col("y") == 1, TOXIC_LEARNT).otherwise(ORDINARY_LEARNT)).select("text", "y")
    model = fit([(r["text"], r["y"]) for r in taken.toLocalIterator()])
    trim()
    return model


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = PREDICT) -> DataFrame:
    """doc_id, held_out, score, predicted, and distance (the largest that counts, in bytes) for every row, from its whole text alone.

    Null and empty texts have no distance and the score of that; every row gives one, so
    repeated rows and null ids do too; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of 130 kilobytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", lambda: None)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = [*shared.value.scores(part.column(2).to_pylist())]
                scores = np.array([x for x, _ in found], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array([x for _, x in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted", "distance"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, distance int")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = PREDICT, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", lambda: None)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                yield part.filter(pa.array([x < threshold for x, _ in shared.value.scores(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
