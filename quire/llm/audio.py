"""Media columns: 8-bit audio stored losslessly, and features computed from the stored bytes.

Media is a RIFF/WAVE file of unsigned 8-bit mono samples.  Features are those of a
speech front end: a polyphase FIR filter resamples to the analysis rate, overlapped
Hann windows and a mel filterbank give log energies, and two thresholds with
hysteresis cut the signal into segments of high energy.  They're stored as an Arrow
stream with one row per patch: a fixed-shape tensor [FRAMES, MELS], the patch's time
span, and the part of it that lies in segments; beside it the segments' time spans.

Log energies are rounded to steps of STEP before anything is made of them, and tensors
hold half floats, which such values fit: processors that add up in another order seldom
come to another value.

Defined cases: null and empty texts are one unit of spaces; every row is stored and
has its features, so repeated rows and rows with null ids do too, and equal texts
have equal values; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize

RATE, UP, DOWN, TAPS = 16_000, 1, 2, 16
SIZE, HOP, MELS, FRAMES = 256, 128, 24, 32
#: Log energy above the quietest frames at which a segment begins, and below which it ends.
BEGIN, END = 0.9, 0.45
STEP = 1 / 32
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wave(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples."""
    pad = len(samples) & 1
    return _HEADER.pack(b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def samples(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAVE file and its rate; chunks that aren't known are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("a WAVE file without samples")


@cache
def _phases(up: int, down: int) -> np.ndarray:
    """The polyphase branches of a windowed-sinc low-pass filter: [up, taps]."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * np.hamming(n)
    return (h / h.sum() * up).reshape(TAPS, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Only the outputs that are kept are computed, each from one branch of the filter."""
    branches = _phases(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x, np.zeros(down, np.float32)))
    if up == 1:
        return np.lib.stride_tricks.as_strided(padded, (n, TAPS), (padded.strides[0] * down, padded.strides[0])) @ branches[0]
    out = np.empty(n, np.float32)
    for phase in range(up):  # outputs k with k * down % up == phase
        k = np.flatnonzero(np.arange(n) * down % up == phase)
        if len(k):
            out[k] = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[k * down // up] @ branches[phase]
    return out


@cache
def _filterbank(rate: float) -> np.ndarray:
    """Triangles at equal distances on the mel scale: [SIZE // 2 + 1, MELS]."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1) / rate * SIZE
    bins = np.arange(SIZE // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = np.hanning(SIZE + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """[frames, MELS]; the end is padded with zeros to a whole window."""
    frames = max(1, -(-max(0, len(x) - SIZE) // HOP) + 1)
    x = np.concatenate((x, np.zeros((frames - 1) * HOP + SIZE - len(x), np.float32)))
    out = np.empty((frames, MELS), np.float32)
    for low in range(0, frames, 4096):  # bounded memory for any length
        n = min(4096, frames - low)
        windows = np.lib.stride_tricks.as_strided(x[low * HOP :], (n, SIZE), (HOP * 4, 4)) * _HANN
        spectrum = np.fft.rfft(windows)
        out[low : low + n] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _filterbank(rate)
    return np.round(np.log(out + np.float32(1e-6)) / STEP) * np.float32(STEP)


def segments(energy: np.ndarray, begin: float = BEGIN, end: float = END) -> list[tuple[int, int]]:
    """Frame ranges of high energy: entered above begin, left below end, both above the 10th percentile."""
    level = energy - np.partition(energy, len(energy) // 10)[len(energy) // 10]
    state = np.where(level >= begin, 1, np.where(level < end, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate(([False], (last >= 0) & (state[np.maximum(last, 0)] == 1), [False]))
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [*zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


TENSOR = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])
SCHEMA = pa.schema([("patch", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64()), ("voiced", pa.float32())])


def features(media: bytes) -> tuple[pa.RecordBatch, list[tuple[float, float]]]:
    """Patches of log-mel energies with their time spans, and the spans of the segments."""
    raw, rate = samples(media)
    x = resample((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128)
    rate = rate * UP / DOWN
    mel = log_mel(x, rate)
    spans = segments(mel.mean(axis=1))
    n = -(-len(mel) // FRAMES)
    padded = np.full((n * FRAMES, MELS), round(float(np.log(1e-6)) / STEP) * STEP, np.float16)
    padded[: len(mel)] = mel
    inside = np.zeros(n * FRAMES, np.float32)
    for a, b in spans:
        inside[a:b] = 1
    second = HOP / rate
    begins = np.arange(n) * FRAMES * second
    ends = np.minimum(begins + FRAMES * second, len(raw) / RATE)
    patches = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), FRAMES * MELS))
    return pa.RecordBatch.from_arrays([patches, pa.array(begins), pa.array(ends), pa.array(inside.reshape(n, FRAMES).mean(axis=1))], schema=SCHEMA), [(a * second, b * second) for a, b in spans]


def stream(batch: pa.RecordBatch) -> bytes:
    """The Arrow stream in which patches are kept."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def payload(text: str | None, unit: int = 192) -> tuple[bytes, int]:
    """The text in UTF-8 with spaces up to a positive multiple of unit bytes, and the bytes it has without them."""
    raw = (text or "").encode()
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every whole text as audio to the shared folder: doc_id, n_bytes, media.

    Null and empty texts are one unit of spaces.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                made = [payload(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([wave(x) for x, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, patches binary, segments array<struct<start_s:double,end_s:double>>"


def extract(stored: DataFrame) -> DataFrame:
    """Reads media back and stores its features in the shared folder: doc_id, n_bytes, digests of the samples and of the media as they were read, patches (Arrow stream) and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), spans_of]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "patches", "segments"]
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                rows = []
                for doc_id, n, media in zip(*(c.to_pylist() for c in batch.slice(low, 200).columns), strict=True):
                    raw, _ = samples(media)
                    patches, spans = features(media)
                    rows.append((doc_id, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), stream(patches), [{"start_s": a, "end_s": b} for a, b in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return materialize(stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES), "features")


def digests(extracted: DataFrame) -> DataFrame:
    """The digests of extract(), and feature, which names the tensors and segments as they're read back and a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for patches, spans in zip(batch.column("patches").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                table = pa.ipc.open_stream(patches).read_all()
                if table.schema.field("patch").type != TENSOR:
                    raise ValueError("stored patches aren't tensors of the shape they should have")
                h = hashlib.sha256(patches)
                for x in spans:
                    h.update(struct.pack("<dd", x["start_s"], x["end_s"]))
                found.append(f"patches={table.num_rows}x{FRAMES}x{MELS};segments={len(spans)};sha256={h.hexdigest()}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(found, pa.string())], names=[*batch.schema.names[:7], "feature"])

    return extracted.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
