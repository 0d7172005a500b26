"""Best-fit packing of documents into sequences of a fixed token budget.

Documents longer than the budget are cut into pieces of the full budget, of which
only the last may be shorter.  Pieces are placed by bulk-synchronous best-fit, longest
first:

1. Pieces are range-sorted by length, gaps (sequences with room) by size.  Both are
   whole numbers up to the budget, so pieces and gaps are runs of equal values: a run
   is its value, its first rank, and how many there are.  A piece of more than half
   the budget has a sequence of its own; as many empty ones are opened as the others need
   at least beyond what is left in those.
2. In each round the runs are dealt to tasks by the range of their values; a gap goes to
   the highest range, not above its own, where pieces wait.  Every task sweeps its
   pieces downwards and gives each run the smallest gap that holds it (its
   successor).
3. Where a run has more pieces than the gap's run has places, pieces win by rank, and
   the rest go on to the next larger gaps.
4. Gaps that were used shrink, and what no piece of a range fits goes to lower ranges in
   the next round.  When gaps are used up and pieces wait, more sequences are opened.

A round is one job over the runs, of which there are a few for each length, whatever the
number of documents; the driver sees sums for each range alone.  Ranks come from the
distributed range sort, and each piece finds its sequence by the run its rank is in.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize
from quire.llm.words import encoder, vocabulary

#: Pieces of texts that a generation of the encoder's cache holds.
CACHED = 200_000
#: Ranges of values up to half the budget, which are the tasks of a round.
RANGES = 8
PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Runs: pieces that wait (value: length, first: rank), gaps (size, sequence; top: the highest range they may still go to),
#: and pieces that were placed (length, rank; each: how many a sequence takes, sequence: the first, size: of the gap).
WAITING, GAP, PLACED = 0, 1, 2
RUN = "kind int, value long, first long, n long, top long, each long, sequence long, size long"


def _pieces(vocab: str, budget: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end = encoder(vocab, CACHED), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part, out = batch.slice(low, 2000), [[] for _ in range(7)]
                for doc_id, row, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = made.encode(text) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * budget)):
                        body = ids[at : at + 4 * budget]
                        for column, value in zip(out, (doc_id, row, piece, at // 4, len(body) // 4, zlib.crc32(body), body if with_ids else None), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """The successor sweep of one range.

    pieces: (length, rank, n); gaps: (size, first sequence, n).  Returns the placed
    runs (length, rank, n, each, sequence, size): pieces with ranks from rank on go to
    sequences from sequence on, each of them to one; the pieces that wait on; and the gaps as they are now.
    """
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []

    def add(size: int, first: int, n: int) -> None:
        if n and size:
            if not by[size]:
                bisect.insort(sizes, size)
            by[size].append((first, n))

    for size, first, n in sorted(gaps, key=lambda g: (g[0], -g[1])):
        add(size, first, n)
    placed, left = [], []
    for length, rank, n in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while n:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                left.append((length, rank, n))
                break
            size = sizes[at]
            first, there = by[size].pop()
            if not by[size]:
                sizes.pop(at)
            each = size // length  # a gap that was just used is the smallest that fits
            used, rest = min(there, n // each), n % each if n // each < there else 0
            if used:
                placed.append((length, rank, used * each, each, first, size))
                add(size - each * length, first, used)
                rank, n = rank + used * each, n - used * each
            if rest and used < there:
                placed.append((length, rank, rest, rest, first + used, size))
                add(size - rest * length, first + used, 1)
                rank, n, used = rank + rest, n - rest, used + 1
            add(size, first + used, there - used)
    return placed, left, [(size, first, n) for size in sizes for first, n in by[size]]


def _swept(key: tuple[pa.Scalar, ...], runs: pa.Table) -> pa.Table:
    rows = runs.to_pylist()
    mine = lambda kind: [(r["value"], r["first"], r["n"]) for r in rows if r["kind"] == kind]
    placed, left, gaps = sweep(mine(WAITING), mine(GAP))
    below = key[0].as_py() - 1
    out = [(PLACED, length, rank, n, None, each, sequence, size) for length, rank, n, each, sequence, size in placed]
    out += [(WAITING, length, rank, n, None, None, None, None) for length, rank, n in left]
    out += [(GAP, size, first, n, below, None, None, None) for size, first, n in gaps]
    kinds = [pa.int32(), *[pa.int64()] * 7]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=["kind", "value", "first", "n", "top", "each", "sequence", "size"])


def place(counts: DataFrame, budget: int) -> tuple[DataFrame, int]:
    """The placed runs (see RUN) of counts (length, n: pieces of each length up to budget), and how many sequences they fill."""
    spark = counts.sparkSession
    width = -(-budget // (2 * RANGES))
    range_of = lambda c: F.least(F.floor((c - 1) / width), F.lit(RANGES - 1))
    none = lambda *names: [F.lit(None).cast("long").alias(x) for x in names]
    counts = counts.select(F.col("length").cast("long").alias("value"), F.col("n").cast("long"))
    # sequences of their own: one row for each length, so a window over all of them is small
    alone = counts.filter(2 * F.col("value") > budget).withColumn("sequence", F.sum("n").over(Window.orderBy(F.col("value").desc())) - F.col("n"))
    placed = [materialize(alone.select(F.lit(PLACED).alias("kind"), "value", F.lit(0).cast("long").alias("first"), "n", *none("top"), F.lit(1).cast("long").alias("each"), "sequence", F.lit(budget).cast("long").alias("size")), "alone")]
    waiting = counts.filter(2 * F.col("value") <= budget).select(F.lit(WAITING).alias("kind"), "value", F.lit(0).cast("long").alias("first"), "n", *none("top", "each", "sequence", "size"))
    gaps = placed[0].filter(F.col("value") < budget).select(F.lit(GAP).alias("kind"), (budget - F.col("value")).alias("value"), F.col("sequence").alias("first"), "n", F.lit(RANGES).cast("long").alias("top"), *none("each", "sequence", "size"))
    state = materialize(waiting.unionByName(gaps), "runs")
    opened = placed[0].agg(F.sum("n")).first()[0] or 0
    while True:
        # at most two rows for each range
        sums = state.groupBy("kind", range_of(F.col("value")).alias("range")).agg(F.sum(F.col("value") * F.col("n")).alias("tokens")).collect()
        ranges = sorted(r["range"] for r in sums if r["kind"] == WAITING)
        if not ranges:
            break
        wanted, room = (sum(r["tokens"] for r in sums if r["kind"] == k) for k in (WAITING, GAP))
        more = max(0, -(-(wanted - room) // budget))
        if more or not room:
            more = max(1, more)
            state = state.unionByName(spark.createDataFrame([(GAP, budget, opened, more, RANGES, None, None, None)], RUN))
            opened += more
        fits = F.array_max(F.filter(F.array(*[F.lit(x).cast("long") for x in ranges]), lambda x: x <= F.least(range_of(F.col("value")), F.col("top"))))
        dealt = state.withColumn("range", F.when(F.col("kind") == WAITING, range_of(F.col("value"))).otherwise(fits))
        done = dealt.filter("range IS NOT NULL").select("range", *state.columns).groupBy("range").applyInArrow(_swept, RUN)
        # gaps that no waiting piece fits are closed; empty sequences are kept, to be counted
        out = materialize(done.unionByName(dealt.filter(F.col("range").isNull() & (F.col("value") == budget)).drop("range")), "runs")
        placed.append(out.filter(F.col("kind") == PLACED))
        state = out.filter(F.col("kind") != PLACED)
    empty = state.filter((F.col("kind") == GAP) & (F.col("value") == budget)).agg(F.sum("n")).first()[0] or 0
    every = placed[0]
    for x in placed[1:]:
        every = every.unionByName(x)
    return every, opened - empty


def pack(docs: DataFrame, vocab: str, budget: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The ids of a document are those of the vocabulary plus end_id.  A null or empty
    text has the end id alone; repeated or null doc_ids are documents of their own;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(_pieces(vocabulary(vocab), budget, end_id, with_ids), PIECE)
    pieces = materialize(pieces if with_ids else pieces.drop("ids"), "pieces")
    # range-sorted once; a place in the order is (partition, place in it)
    keys = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("row")]
    ordered = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "ordered")
    # the order is by length, so there are at most budget + partitions rows
    table = materialize(ordered.groupBy("length", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first")), "lengths")
    runs, _ = place(table.groupBy("length").agg(F.sum("n").alias("n")), budget)
    rank_of = Window.partitionBy("length").orderBy("part")
    before = table.withColumn("before", F.sum("n").over(rank_of) - F.col("n")).select("length", "part", F.col("first").alias("start_pos"), "before")
    ranked = ordered.join(F.broadcast(before), ["length", "part"]).withColumn("rank", F.col("before") + F.col("pos") - F.col("start_pos"))
    # runs are as many as the rounds make of the lengths, not as the documents: one array for each length
    by_length = runs.groupBy(F.col("value").alias("length")).agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "each", (F.lit(budget) - F.col("size")).alias("offset")))).alias("runs"))
    run = F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("rank")), -1)
    out = ranked.join(F.broadcast(by_length), "length").withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.first"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.floor(F.col("nth") / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + F.col("nth") % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
