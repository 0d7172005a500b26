"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams of one to three bytes (a blended
spectrum) that are present in both, among those of a fixed set, divided by the roots
of how many each has.  Nystroem landmarks - training texts - stand for the feature
space, and kernel ridge regression, one language against the rest, gives a weight to
each landmark.

Scoring a batch is one matrix product: presence of n-grams [texts, n-grams] times
the landmarks' presence [n-grams, landmarks] gives the kernel's counts, times the weights
[landmarks, languages] the scores.  The last two don't depend on the batch and are
multiplied once; the texts' own norms are divided out of the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import held_out, hold, materialize, trim

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bounds of training: texts of each language, texts of all languages together, landmarks (one for each language at least), n-grams.
PER_LANGUAGE, TEXTS, LANDMARKS, GRAMS = 400, 3200, 320, 6000
#: Languages that are learnt at most; each has one text at least, whatever TEXTS says.
LANGUAGES = 1000
RIDGE, SHARPNESS = 1e-3, 8.0


def codes(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers below 2**24 of the n-grams at each position, the three lengths told apart by leading zero bytes."""
    wide = raw.astype(np.int32)
    yield wide
    two = wide[:-1] << 8 | wide[1:]
    yield two
    yield two[:-1] << 8 | wide[2:]


def prepare(text: str) -> bytes:
    """Lower case between spaces; NUL, which the codes use, becomes a space."""
    return b" " + text.lower().encode().replace(b"\0", b" ") + b" "


def spectrum(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a whole text."""
    raw, found = np.frombuffer(prepare(text), np.uint8), np.zeros(0, np.int32)
    for low in range(0, len(raw), 1 << 20):  # two bytes more, for the n-grams across
        found = np.unique(np.concatenate([found, *codes(raw[low : low + (1 << 20) + 2])]))
    return found


class Model:
    """Weights of n-grams for each language, and the landmarks' places among the samples; see fit()."""

    def __init__(self, languages: list[str], grams: np.ndarray, weights: np.ndarray, landmarks: np.ndarray | None = None):
        self.languages, self.grams, self.weights, self.landmarks = languages, grams, weights, landmarks
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def table(self) -> np.ndarray:
        """The column of each n-gram; the last column is that of all others."""
        if self._table is None:
            self._table = np.full(1 << 24, len(self.grams), np.int16)
            self._table[self.grams] = np.arange(len(self.grams), dtype=np.int16)
        return self._table

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """[texts, n-grams] of zeros and ones, as float32."""
        table, out = self.table(), np.zeros((len(texts), len(self.grams) + 1), np.bool_)
        for row, text in zip(out, texts, strict=True):
            for low in range(0, len(text), 1 << 20):  # two bytes more, for the n-grams across
                for code in codes(np.frombuffer(text[low : low + (1 << 20) + 2], np.uint8)):
                    row[table[code]] = True
        return out[:, :-1].astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """[texts, languages]: the ridge regressions' outputs."""
        there = self.presence(texts)
        norm = np.sqrt(np.maximum(1, there.sum(axis=1)))
        return (there @ self.weights) / norm[:, None]

    def predict(self, texts: list[str | None], rows: int = 256) -> tuple[list[str], list[float]]:
        """Languages and their probabilities, a softmax of the outputs; UNKNOWN and 0 without letters."""
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, x in enumerate(texts) if x and LETTER.search(x)]
        if not self.languages:
            return names, sure
        for low in range(0, len(known), rows):
            at = known[low : low + rows]
            out = self.scores([prepare(texts[i]) for i in at]) * SHARPNESS
            chance = np.exp(out - out.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            for i, best, p in zip(at, chance.argmax(axis=1).tolist(), chance.max(axis=1).tolist(), strict=True):
                names[i], sure[i] = self.languages[best], float(p)
        return names, sure


def fit(samples: list[tuple[np.ndarray, str]]) -> Model:
    """samples: (spectrum of a whole text, language).  Equal samples in any order give equal models."""
    samples = sorted({(x.astype("<i4").tobytes(), y) for x, y in samples})
    languages = sorted({y for _, y in samples})
    if not samples:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    sets = [np.frombuffer(x, "<i4") for x, _ in samples]
    target = np.array([[1.0 if y == name else -1.0 for name in languages] for _, y in samples])
    counts = np.zeros(1 << 24, np.int32)
    for x in sets:
        counts[x] += 1
    found = np.flatnonzero(counts)
    grams = np.sort(found[np.argsort(-counts[found], kind="stable")][:GRAMS])
    there = np.zeros((len(sets), len(grams)))
    for row, x in zip(there, sets, strict=True):
        row[np.isin(grams, x, assume_unique=True)] = 1
    there /= np.sqrt(np.maximum(1, there.sum(axis=1)))[:, None]
    # landmarks: as many of each language, evenly over the sorted samples
    share = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([at[np.unique(np.linspace(0, len(at) - 1, min(share, len(at))).astype(int))] for at in (np.flatnonzero(target[:, k] > 0) for k in range(len(languages)))])
    marks = there[chosen]
    between = marks @ marks.T
    value, vector = np.linalg.eigh(between)
    kept = value > value.max() * 1e-9
    root = vector[:, kept] / np.sqrt(value[kept])  # K(landmarks, landmarks) ** -1/2 on its range
    feature = there @ marks.T @ root
    weigh = 1 / (target > 0).sum(axis=0)  # each language counts as much as all others together
    out = np.zeros((feature.shape[1], len(languages)))
    for k in range(len(languages)):
        w = np.where(target[:, k] > 0, weigh[k], 1 / max(1, (target[:, k] < 0).sum()))
        out[:, k] = np.linalg.solve((feature.T * w) @ feature + RIDGE * np.eye(feature.shape[1]), (feature.T * w) @ target[:, k])
    return Model(languages, grams, (marks.T @ root @ out).astype(np.float32), chosen)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spectrum(x).astype("<i4").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["lang", "found"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, texts: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from per_language texts of each language, fewer where that were more than texts altogether, but one of each at least.

    Texts with a letter are drawn by a hash of the id and the text, and are whole:
    executors make their spectra, and the driver gets those.  Rows held out, and rows
    without a language, aren't read; null ids may be learnt from; equal rows count once.
    More than LANGUAGES languages raise a ValueError, as labels then aren't languages.
    """
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull())
    counts = materialize(known.groupBy(F.col(lang_col).alias("lang")).count(), "languages")  # a row for each language; reads no text
    may = known.filter(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)).alias("at"))
    languages = counts.count()
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages, of which at most {LANGUAGES} are learnt")
    each = max(1, min(per_language, texts // max(1, languages)))
    # about twice as many as are wanted, so that no language's texts are all ranked by one task
    some = may.join(counts, "lang").filter(F.col("at") < F.lit(2 * each + 20) * F.lit(1 << 40) / F.col("count"))
    order = Window.partitionBy("lang").orderBy("at", "text")
    drawn = some.dropDuplicates(["lang", "at"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("lang", "text")
    rows = drawn.mapInArrow(_spectra, "lang string, found binary").collect()
    model = fit([(np.frombuffer(r["found"], "<i4"), r["lang"]) for r in rows])
    del rows
    trim()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its whole text alone.

    Null texts and texts without a letter are UNKNOWN with score 0, and all texts are where nothing was
    learnt; every row gives one, so repeated rows and null ids do; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # GRAMS numbers for each of LANGUAGES languages at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid", lambda: None)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                names, sure = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at least least."""
    spark, schema = docs.sparkSession, docs.schema
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid", lambda: None)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                names, sure = shared.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, sure, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
