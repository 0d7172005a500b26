"""Token-ID output as a content-addressed store.

Every text becomes a stream of token ids, closed by an end id.  A rolling hash over
the ids cuts the stream into chunks; each distinct chunk is stored once under its
SHA-256; a document is a recipe, the list of its chunks, with a Merkle root over their
digests.  A manifest has the counts and one Merkle root of each range of recipes, over
their ids, places and roots, and one over all ranges.  Readers hold the recipes as they
are read against the manifest, recipes against their roots, and chunks against their
addresses, and raise where anything is lost, repeated, swapped or altered.

Layout below the store's folder, all Parquet:

    chunks/     digest, ids (unsigned 16- or 32-bit little-endian), n
    recipes/    in ascending doc_id order: part, pos, doc_id, start, n_tokens, digests, lengths, root
    manifest/   part, documents, tokens, first and last doc_id, root; part -1: the whole

Defined cases: a null or empty text has the end id alone; doc_ids may repeat or be
null, and then each row is a document of its own, null ids first and equal ids in
the order of their content; an empty table gives an empty store; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import delete, discard, fresh_dir, materialize
from quire.llm.words import encoder, vocabulary

#: Ids that the rolling hash sees, a power of two; no chunk but a document's last is shorter.
WINDOW = 16
SHORTEST, MEAN, LONGEST = 64, 512, 4096
CHUNK = "digest binary, n long, ids binary"
RECIPE = "part int, pos long, doc_id long, start long, n_tokens long, digests array<binary>, lengths array<int>, root binary"
MANIFEST = "part long, tokens long, documents long, first long, last long, root binary"
_GEAR = np.random.default_rng(20240601).integers(0, 2**64, 1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray, starts: list[int], shortest: int = SHORTEST, mean: int = MEAN, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of documents that begin at starts and lie end to end in ids.

    The hash at an id covers it and the WINDOW - 1 before it.  A chunk ends where
    the hash falls below 2**64 / mean, not before shortest and at most at longest
    ids, and at the document's end; so equal passages give equal chunks wherever
    they stand.
    """
    rolling, seen = _GEAR[ids & 0xFFFF], 1
    while seen < WINDOW:  # what covers so many ids, and the same further back, cover twice as many
        older = rolling[:-seen] << np.uint64(3 * seen)
        rolling[seen:] += older
        seen *= 2
    rolling ^= rolling >> np.uint64(29)
    rolling *= np.uint64(0xBF58476D1CE4E5B9)
    marks = (np.flatnonzero(rolling < np.uint64(2**64 // mean)) + 1).tolist()
    out, at = [], 0
    for begin, end in zip(starts, [*starts[1:], len(ids)], strict=True):
        last = begin
        while at < len(marks) and marks[at] <= begin:
            at += 1
        while at < len(marks) and marks[at] < end:
            mark, at = marks[at], at + 1
            while mark - last > longest:
                last += longest
                out.append(last)
            if mark - last >= shortest:
                out.append(mark)
                last = mark
        while end - last > longest:
            last += longest
            out.append(last)
        out.append(end)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree over digests; a lone node moves up unchanged."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(paired) * 2 :]
    return level[0]


def _encode(vocab: str, end_id: int, wide: bool):
    """Rows of kind document (with digests) and kind chunk (with ids), the latter once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end = encoder(vocab), np.array([end_id], "<u4").tobytes()
        seen: set[bytes] = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                streams = [made.encode(x) + end for x in part.column(1).to_pylist()]
                ids = np.frombuffer(b"".join(streams), "<u4")
                lengths = [len(x) // 4 for x in streams]
                del streams
                starts = (np.cumsum(lengths) - lengths).tolist()
                if not wide and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids beyond 65,535 need a wide store")
                stored = ids if wide else ids.astype("<u2")
                size, raw = stored.itemsize, memoryview(stored).cast("B")
                digests, sizes, new, bodies, counts, begin, at = [], [], [], [], [], 0, 0
                ends = cuts(ids, starts)
                for document, length in zip(starts, lengths, strict=True):
                    mine, chunk_sizes = [], []
                    while begin < document + length:
                        end_at = ends[at]
                        at += 1
                        body = raw[begin * size : end_at * size]
                        digest = hashlib.sha256(body).digest()
                        mine.append(digest)
                        chunk_sizes.append(end_at - begin)
                        if digest not in seen:
                            seen.add(digest)
                            new.append(digest)
                            bodies.append(bytes(body))
                            counts.append(end_at - begin)
                        begin = end_at
                    digests.append(mine)
                    sizes.append(chunk_sizes)
                n, m = part.num_rows, len(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column(0), pa.nulls(m, pa.int64())]),
                        pa.array([*lengths, *counts], pa.int64()),
                        pa.array([*digests, *[None] * m], pa.list_(pa.binary())),
                        pa.array([*sizes, *[None] * m], pa.list_(pa.int32())),
                        pa.array([*map(merkle, digests), *new], pa.binary()),
                        pa.array([*[None] * n, *bodies], pa.binary()),
                    ],
                    names=["doc_id", "n", "digests", "lengths", "digest", "ids"],
                )
                if len(seen) > 1_000_000:
                    seen.clear()  # a chunk may then be sent again; it's still stored once

    return run


def write(docs: DataFrame, path: str, vocab: str, end_id: int = 0, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the store to path.

    wide: ids of 32 bits, for vocabularies of more than 65,536 ids.  Chunks are
    deduplicated by digest, after each task has sent its own once; recipes are
    range-sorted by id, and their starts are sums within a range plus the sum of
    the ranges before it, so no task holds more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _encode(vocabulary(vocab), end_id, wide), "doc_id long, n long, digests array<binary>, lengths array<int>, digest binary, ids binary"
    )
    staged = fresh_dir(spark, "encoded")
    rows.withColumn("kind", F.when(F.col("ids").isNull(), "document").otherwise("chunk")).write.option("compression", "zstd").parquet(staged)
    every = spark.read.schema("doc_id long, n long, digests array<binary>, lengths array<int>, digest binary, ids binary, kind string").parquet(staged)
    # chunks are shuffled once, by digest, after each task has dropped its own repeats
    chunk = every.filter("kind = 'chunk'").select("digest", "n", "ids")
    chunk.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipe = every.filter("kind = 'document'").select("doc_id", F.col("n").alias("n_tokens"), "digests", "lengths", F.col("digest").alias("root"))
    ordered = recipe.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "recipes")
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # one row for each range: bounded by the number of partitions
    before = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    placed = ordered.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(running, F.lit(0))).drop("before")
    placed.sortWithinPartitions("part", "pos").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.schema(RECIPE).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    delete(staged)
    discard(ordered)


def _roots(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merkle([x for _, x in sorted((y["pos"], y["root"]) for y in v)]) for v in batch.column(1).to_pylist()], pa.binary())], names=["key", "root"])


def _manifest(recipes: DataFrame, fan: int = 4096) -> DataFrame:
    """One root per range, from the leaves of its recipes in blocks of fan, and one over all ranges; with what they count."""
    spec = "key long, root binary"

    def tree(leaves: DataFrame, key) -> DataFrame:
        return leaves.groupBy(key.alias("key")).agg(F.collect_list(F.struct("pos", "root")).alias("nodes")).mapInArrow(_roots, spec)

    leaf = F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string"), F.col("n_tokens").cast("string"), F.hex("root")), 256))
    block = (F.col("part").cast("long") * (1 << 32)) + F.floor((F.col("pos") % (1 << 33)) / fan)
    blocks = tree(recipes.select("part", "pos", leaf.alias("root")), block)
    ranges = tree(blocks.select((F.floor(F.col("key") / (1 << 32))).alias("part"), F.col("key").alias("pos"), "root"), F.col("part"))
    whole = tree(ranges.select(F.lit(-1).alias("part"), F.col("key").alias("pos"), "root"), F.col("part").cast("long"))
    parts = recipes.groupBy(F.col("part").cast("long").alias("key")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    total = parts.agg(F.lit(-1).cast("long").alias("key"), F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), F.min("first").alias("first"), F.max("last").alias("last"))
    return parts.unionByName(total).join(ranges.unionByName(whole), "key").withColumnRenamed("key", "part")


def verify(spark: SparkSession, path: str) -> None:
    """Raises where the store's recipes aren't those that its manifest names.

    Counts and roots are made anew from the recipes as they are read; of the
    comparison, which has a row for each range, one that differs goes to the driver.
    """
    found, kept = _manifest(spark.read.schema(RECIPE).parquet(f"{path}/recipes")), spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    both = found.alias("a").join(kept.alias("b"), F.col("a.part") == F.col("b.part"), "full")
    same = F.lit(True)
    for c in ("part", "tokens", "documents", "first", "last", "root"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    wrong = both.filter(~same).select(F.coalesce("a.part", "b.part").alias("part")).head()
    if wrong is not None:
        raise ValueError(f"the recipes of range {wrong['part']} aren't those of the manifest")


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1))
    return out


def shifted(crc: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What a CRC-32 contributes to that of a text in which so many bytes follow; the contributions' XOR is the whole text's."""
    crc, left = crc.astype(np.uint32), bytes_after.astype(np.int64).copy()
    power = np.uint32(1 << 23)  # x**8
    while left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            crc[odd] = _times(crc[odd], np.full(len(odd), power, np.uint32))
        left >>= 1
        power = _times(np.array([power], np.uint32), np.array([power], np.uint32))[0]
    return crc


def _verify_chunks(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for digest, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_buffer()
                if hashlib.sha256(body).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't have the content of its address")
                crcs.append(zlib.crc32(body if wide else np.frombuffer(body, "<u2").astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array([len(x.as_buffer()) // (4 if wide else 2) for x in batch.column(1)], pa.int64())], names=["digest", "crc", "n"])

    return run


def _open_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a recipe, with the number of ids that follow it."""
    for batch in batches:
        places, uses, sizes, after = [], [], [], []
        for pos, root, digests, lengths, n in zip(*(batch.column(x).to_pylist() for x in ("pos", "root", "digests", "lengths", "n_tokens")), strict=True):
            if merkle(digests) != root or len(lengths) != len(digests) or sum(lengths) != n:
                raise ValueError(f"a recipe doesn't have the root {root.hex()} or its number of ids")
            places += [pos] * len(digests)
            uses += digests
            sizes += lengths
            after += (n - np.cumsum(lengths)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(uses, pa.binary()), pa.array(sizes, pa.int64()), pa.array(after, pa.int64())], names=["pos", "digest", "length", "after"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column("crc").null_count or not batch.column("n").equals(batch.column("length")):
            raise ValueError("a recipe names a chunk that isn't stored, or one of another length")
        crc, after = (batch.column(x).to_numpy() for x in ("crc", "after"))
        yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(shifted(crc, 4 * after).astype(np.int64)), batch.column("n")], names=["pos", "term", "n"])


def read_digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Reads a store back and verifies it: doc_id, start, n_tokens, ids_crc32 of each document.

    The recipes are held against the manifest and their Merkle roots, and every
    stored chunk is read and held against its address.  The CRC-32 of a document comes
    from those of its chunks as they were read: each is shifted by the bytes that
    follow it and they are XORed, so that chunk bytes needn't be shuffled to their documents.
    """
    verify(spark, path)
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(_verify_chunks(wide), "digest binary, crc long, n long")
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    uses = recipes.select("pos", "root", "digests", "lengths", "n_tokens").mapInArrow(_open_recipes, "pos long, digest binary, length long, after long")
    terms = uses.join(chunks, "digest", "left").select("pos", "length", "after", "crc", "n").mapInArrow(_terms, "pos long, term long, n long")
    sums = terms.groupBy("pos").agg(F.bit_xor("term").alias("ids_crc32"), F.sum("n").alias("n_tokens"))
    return recipes.select("pos", "doc_id", "start").join(sums, "pos").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Reconstructs the id streams: doc_id, start, ids as array<int>; verifies all that read_digests() does."""
    verify(spark, path)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, chunks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                chunks.sort(key=lambda x: x["i"])
                if merkle([x["digest"] for x in chunks]) != root:
                    raise ValueError(f"a recipe doesn't have the root {root.hex()}")
                for x in chunks:
                    if x["ids"] is None or hashlib.sha256(x["ids"]).digest() != x["digest"]:
                        raise ValueError(f"chunk {x['digest'].hex()} isn't stored, or doesn't have the content of its address")
                out.append(np.frombuffer(b"".join(x["ids"] for x in chunks), "<u4" if wide else "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return _with_bodies(spark, path).mapInArrow(join, "doc_id long, start long, ids array<int>")


def _with_bodies(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    uses = recipes.select("pos", "doc_id", "start", "root", F.posexplode("digests").alias("i", "digest")).join(spark.read.schema(CHUNK).parquet(f"{path}/chunks"), "digest", "left")
    return uses.groupBy("pos", "doc_id", "start", "root").agg(F.collect_list(F.struct("i", "digest", "ids")).alias("chunks")).select("doc_id", "start", "root", "chunks")
