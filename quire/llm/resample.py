"""Importance resampling towards a target distribution.

Texts become bags of hashed features: runs of one and of two words, each counted in the
bucket of its CRC-32.  A bucket's gain is the log ratio of its shares in the target and
in the documents; a document's weight is the mean gain of its features, and its score the
weight with Gumbel noise from its id, so that the highest scores are a draw without replacement
in proportion to the weights.

1. Tasks count buckets in one array each; the sums are BUCKETS rows, whatever the input.
2. With the gains as an array, tasks score texts: features are hashed for all words of a
   block at once, the hash of a pair being put together from those of its words.
3. The k-th key in order of score (descending), id and row is found by radix selection: a
   histogram of one digit at a time over the rows that share the digits so far, of
   1 << DIGIT rows at most.  Nothing is sorted for that, and equal scores, ids and
   rows with the same id are only more digits.
4. Rows up to that key, and only they, are range-sorted and ranked by their partition's
   offset and their place in it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

BUCKETS = 10_000
#: Bits of a digit of the radix selection, bytes of text that are hashed at once, lengths that have a table of their own.
DIGIT, BLOCK, LENGTHS = 14, 1 << 22, 64
#: Lower-cases A-Z, and turns what isn't in words ([^\x00-\x2F\x3A-\x60\x7B-\x7F] of the lower-cased text) into spaces.
_CLEAN = bytes(b if b > 0x7F or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in bytes(range(256)).lower())
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of single bytes, and for each length what every byte of a CRC-32 becomes after so many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    after = np.empty((LENGTHS + 1, 4, 256), np.uint32)
    after[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LENGTHS):
        after[n + 1] = step[after[n] & 255] ^ after[n] >> 8
    return step, after


_STEP, _AFTER = _crc_tables()


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts one after another, from those of both and the second's length."""
    first, length = first.copy(), length.copy()
    while True:
        n = np.minimum(length, LENGTHS)
        first = _AFTER[n, 0, first & 255] ^ _AFTER[n, 1, first >> 8 & 255] ^ _AFTER[n, 2, first >> 16 & 255] ^ _AFTER[n, 3, first >> 24]
        length -= n
        if not length.any():
            return first ^ second


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every word of the texts, of every word with its successor (nonsense for a text's last), and each text's number of words."""
    cut = [t.encode().translate(_CLEAN).split() if t else [] for t in texts]
    count = np.fromiter(map(len, cut), np.int64, len(cut))
    coded = pa.array([w for x in cut for w in x], pa.binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy()
    words = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[which]
    lengths = np.fromiter(map(len, known), np.int64, len(known))[which]
    inverted = ~words
    spaced = ~(_STEP[(inverted ^ 32) & 255] ^ inverted >> 8)
    return words, np.append(joined(spaced[:-1], words[1:], lengths[1:]), np.uint32(0))[: len(words)], count


def _blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in runs of about BLOCK bytes."""
    held, size = [], 0
    for t in texts:
        t = t.as_py()
        held.append(t)
        size += len(t or "") + 8
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _blocks(batch.column(0)):
                words, pairs, count = hashed(texts)
                inner = np.ones(len(words), bool)
                inner[np.cumsum(count[count > 0]) - 1] = False  # a text's last word has no successor
                for x in (words, pairs[inner]):
                    sums += np.bincount(x % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    tasks = rows.select(text_col).mapInArrow(_counts(buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in tasks.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of shares), each bucket counted once more than it occurs."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((int(y) + 1) * (s + n)) / float((int(x) + 1) * (t + n)))) for x, y in zip(source, target, strict=True)], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """floor(1000 * a Gumbel variate) that the id gives."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(texts: list[str | None], gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and floored mean gain of each text."""
    words, pairs, count = hashed(texts)
    n = np.uint32(len(gain))
    one, two = gain[words % n], gain[pairs % n]
    ends = np.cumsum(count)
    two[ends[count > 0] - 1] = 0
    sums = np.append(0, np.cumsum(one + two))
    features = np.maximum(2 * count - 1, 0)
    return count, features, (sums[ends] - sums[ends - count]) // np.maximum(features, 1)


def score(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row; the score of a null id is null."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for texts in _blocks(batch.column(1)):
                ids = batch.column(0).slice(low, len(texts))
                low += len(texts)
                words, features, weight = weigh(texts, shared.value)
                scores = [None if i is None else int(w) + noise(i, seed) for i, w in zip(ids.to_pylist(), weight, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(features), pa.array(weight), pa.array(scores, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCORED)


def up_to(rows: DataFrame, keys: list[str], k: int) -> Column:
    """The condition that holds for the k smallest rows in the order of keys (long columns without nulls, unique together).

    Radix selection: each pass counts one digit of one key among the rows that share
    the digits found so far, and starts at the first digit where these differ.
    """
    if k <= 0:
        return F.lit(False)
    sign = 1 << 63
    as_long = lambda u: F.lit(u - sign)  # noqa: E731  the value whose unsigned form is u
    taken, same = F.lit(False), F.lit(True)
    for name in keys:
        here = rows.filter(same)
        low, high, n = here.agg(F.min(name), F.max(name), F.count("*")).first()
        if n == k:
            return taken | same
        low, high = low + sign, high + sign
        bits, prefix = (low ^ high).bit_length(), low
        while bits:
            shift = max(0, bits - DIGIT)
            prefix = prefix >> bits << bits
            within = F.col(name).between(as_long(prefix), as_long(prefix + (1 << bits) - 1))
            digit = F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(-sign)), shift).bitwiseAND(F.lit((1 << (bits - shift)) - 1).cast("long"))
            counted = sorted((r["digit"], r["count"]) for r in here.filter(within).groupBy(digit.alias("digit")).count().collect())
            for d, n in counted:
                if k <= n:
                    break
                k -= n
            prefix, bits = prefix | d << shift, shift
            if n == k:  # all rows that begin with these digits
                return taken | same & (F.col(name) <= as_long(prefix + (1 << bits) - 1))
        taken, same = taken | same & (F.col(name) < as_long(prefix)), same & (F.col(name) == as_long(prefix))
    return taken | same


def ranked(rows: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the order of keys: range-sorted, then each partition's offset and the place in it."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "ranked")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("pos").alias("first"))  # one row for each partition
    offsets = parts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ordered.join(F.broadcast(offsets), "part").withColumn(rank, F.col("before") + F.col("pos") - F.col("first") + 1).drop("part", "pos", "first", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank, from 1, of those that are drawn, else null.

    Of the rows with at least so many words, percent in a hundred (rounded down) with the highest
    scores are drawn, ties to smaller ids.  Null and empty texts have no features and
    weight 0.  Rows without an id count in the buckets, have no score and are never
    drawn nor counted among those to draw from; rows that repeat an id are drawn each for
    itself.  Without target texts gains come from the documents alone; an empty table gives no rows; other
    columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = materialize(score(docs, gain, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("descending", -F.col("score")), "scored")
    may = F.col("score").isNotNull() & (F.col("n_words") >= least)
    keys = ["descending", "doc_id", "row"]
    wanted = percent * rows.filter(may).count() // 100
    drawn = F.coalesce(may & up_to(rows.filter(may), keys, wanted), F.lit(False))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked(rows.filter(drawn), keys).select(*out, "rank").unionByName(rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs with all their columns and their rank in the column draw_rank; ids must be unique."""
    found = resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("draw_id"), F.col("rank").alias("draw_rank"))
    return docs.join(found, docs[id_col] == found["draw_id"]).drop("draw_id")
