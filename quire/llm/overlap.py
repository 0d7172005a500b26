"""Interval overlap join with Allen's relations, aggregated for each left row.

relations() pairs the intervals of two tables that have a key and share a slot, and
returns what each left row has of each relation.  No pair leaves a task:

1. Equal intervals of a key are one class with a weight, so that what is compared is
   bounded by the slots of a key and not by its rows.
2. A key whose classes exceed CLASSES on a side is split: each side is dealt over parts
   by a hash of the interval, and every part of one side meets every part of the other
   in one cell.  Other keys are one cell.
3. Cells are dealt to tasks by key and part, and a task takes them in blocks of about
   BLOCK classes, which bounds its memory.  A block is joined by IEJoin in numpy: the right
   side has an order by end within its key (the bits of the bitmap) and an order by start, and a
   permutation leads from one to the other.  Left classes are visited by their end; bits
   of right classes that start until then are set; an offset array says where in a
   key's bits those begin that end late enough.  Set bits from there on are the overlaps.
4. Sums of a class and relation from all cells are added, and left rows find their class's.

click_sessions() and sale_intervals() make the two sides from clicks and from sales with
their lines.  Sessions are put together from bins as long as the gap: clicks of a bin belong
to one session, and bins are aggregated before any shuffle, so that a client with a
third of all clicks is at most a row for each bin of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialize

#: Classes of one side in a cell, classes of a block, pairs that are expanded at once.
CLASSES, BLOCK, PAIRS = 16_384, 32_768, 1 << 20
#: The end of an interval that is open; larger than any slot.
OPEN = 1 << 40
#: By how the left interval starts (earlier, equally, later) and, within that, ends.
RELATIONS = ["overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by"]
FOUND = "key long, start long, stop long, relation int, n_pairs long, overlap_slots long, tags long"


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970; of timestamps without a zone as if they were UTC, whatever the session's zone is."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        clock = F.hour(c).cast("long") * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + clock * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return F.unix_micros(c)


def floored(value: Column, by: int) -> Column:
    """Floor of whole numbers divided by another, without doubles."""
    by = F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, by), by)


def click_sessions(clicks: DataFrame, gap_s: int = 900, slot_s: int = 21_600, key_col: str = "client_id", ts_col: str = "ts", kind_col: str = "kind", opens: str = "error") -> DataFrame:
    """key, start and stop (slots; stop null: open), first_us, last_us: sessions of clicks that are at most gap_s apart.

    A session is open if a click at its last time has the kind opens.  Clicks with a null
    key or time take no part, a null kind opens nothing, repeated clicks change nothing;
    an empty table gives no rows; other columns are ignored.
    """
    us, gap = micros(clicks, ts_col), gap_s * 1_000_000
    rows = clicks.select(F.col(key_col).cast("long").alias("key"), us.alias("us"), F.coalesce(F.col(kind_col) == opens, F.lit(False)).cast("long").alias("opens")).filter("key IS NOT NULL AND us IS NOT NULL")
    # the last time and whether it opens are one number, so that its maximum is aggregated by hash
    bins = rows.groupBy("key", floored(F.col("us"), gap).alias("bin")).agg(F.min("us").alias("first_us"), F.max(F.col("us") * 2 + F.col("opens")).alias("last"))
    order = Window.partitionBy("key").orderBy("bin")
    before = F.lag("last").over(order)
    begins = F.coalesce((F.col("first_us") - F.shiftright(before, 1) > gap).cast("long"), F.lit(1).cast("long"))
    numbered = bins.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("key", "session").agg(F.min("first_us").alias("first_us"), F.max("last").alias("last"))
    slot = slot_s * 1_000_000
    last = F.shiftright("last", 1)
    return found.select("key", floored(F.col("first_us"), slot).alias("start"), F.when(F.col("last") % 2 == 0, floored(last, slot)).alias("stop"), "first_us", last.alias("last_us"))


def sale_intervals(sales: DataFrame, lines: DataFrame, slot_s: int = 21_600, opens: str = "open") -> DataFrame:
    """id (sale_id), key (client_id), start and stop (slots; stop null: open) of every sale with a client and a time.

    A sale runs through the latest of its own time and its lines' shipped_at.  Lines are
    aggregated before the join, so a sale with most of all lines is one row for each task.  A
    sale without lines, or with lines of null times, ends as it begins.
    """
    shipped = lines.filter("sale_id IS NOT NULL AND shipped_at IS NOT NULL").groupBy("sale_id").agg(F.max(micros(lines, "shipped_at")).alias("shipped"))
    rows = sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", F.col("client_id").cast("long").alias("key"), micros(sales, "sold_at").alias("sold"), F.coalesce(F.col("status") == opens, F.lit(False)).alias("open"))
    slot = slot_s * 1_000_000
    ended = floored(F.greatest("sold", "shipped"), slot)
    return rows.join(shipped, "sale_id", "left").select(F.col("sale_id").cast("long").alias("id"), "key", floored(F.col("sold"), slot).alias("start"), F.when(~F.col("open"), ended).alias("stop"))


def iejoin(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left, right) of intervals (group, start, stop) that share a slot of their group, at most about PAIRS at once."""
    (lg, ls, le), (rg, rs, re) = left, right
    if not len(lg) or not len(rg):
        return
    values = np.unique(np.concatenate((ls, re)))
    width = len(values) + 1
    by_end = np.lexsort((re, rg))  # bits of the bitmap
    by_start = np.argsort(rs, kind="stable")
    place = np.empty(len(rg), np.int64)
    place[by_end] = np.arange(len(rg))
    permutation = place[by_start]
    ends = rg[by_end] * width + np.searchsorted(values, re[by_end])
    offset = np.searchsorted(ends, lg * width + np.searchsorted(values, ls))
    limit = np.searchsorted(ends, (lg + 1) * width)
    visits = np.argsort(le, kind="stable")
    stops, first = np.unique(le[visits], return_index=True)
    until = np.searchsorted(rs[by_start], stops, side="right")
    bitmap, done = np.zeros(len(rg), bool), 0
    for now, low, high in zip(until.tolist(), first.tolist(), [*first[1:].tolist(), len(visits)], strict=True):
        bitmap[permutation[done:now]] = True
        done = now
        rows, ones = visits[low:high], np.flatnonzero(bitmap)
        begin = np.searchsorted(ones, offset[rows])
        count = np.searchsorted(ones, limit[rows]) - begin
        rows, begin, count = rows[count > 0], begin[count > 0], count[count > 0]
        total = np.cumsum(count)
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            n = count[at:upto]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(rows[at:upto], n), by_end[ones[np.repeat(begin[at:upto], n) + within]]
            at = upto


def _block(rows: pa.Table) -> pa.RecordBatch:
    """Sums for each left class and relation of whole cells."""
    key, cell, side, start, stop, n, tags = (c.to_numpy() for c in rows.columns)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    group = np.cumsum(new) - 1
    at = [np.flatnonzero(side == s) for s in (0, 1)]
    left, right = ((group[x], start[x], stop[x]) for x in at)
    sums = np.zeros((3, len(at[0]) * len(RELATIONS)), np.int64)
    for i, j in iejoin(left, right):
        a, b, c, d = left[1][i], right[1][j], left[2][i], right[2][j]
        where = i * len(RELATIONS) + 3 * (np.sign(a - b) + 1) + np.sign(c - d) + 1
        weight = n[at[1][j]]
        shared = np.where((c == OPEN) & (d == OPEN), 0, np.minimum(c, d) - np.maximum(a, b) + 1)
        for out, what in zip(sums, (weight, shared * weight, tags[at[1][j]]), strict=True):
            np.add.at(out, where, what)
    hit = np.flatnonzero(sums[0])
    row, relation = at[0][hit // len(RELATIONS)], (hit % len(RELATIONS)).astype(np.int32)
    endless = (stop[row] == OPEN) & (relation % 3 == 1)
    columns = [key[row], start[row], stop[row], relation, sums[0][hit], pa.array(sums[1][hit], mask=endless), sums[2][hit]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "start", "stop", "relation", "n_pairs", "overlap_slots", "tags"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins a partition that is sorted by key and cell, in blocks of whole cells."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key, cell = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
        if cut:
            yield _block(rows.slice(0, cut))
        held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
    if size:
        yield _block(pa.Table.from_batches(held).combine_chunks())


def relations(left: DataFrame, right: DataFrame, classes: int = CLASSES) -> DataFrame:
    """id, relation, n_pairs, overlap_slots and tags for each left id and relation it has to right intervals of its key.

    left: id, key, start, stop (longs); right: key, start, stop, tag.  start and stop are
    slots, both inclusive; a null stop is infinite, and infinite stops are equal.
    overlap_slots is the sum of shared slots (null if both are infinite), tags the
    sum of the right rows' tags.  Rows with a null key or start, or that stop before they start, take
    no part; rows that repeat an id count together, and so do those without one; repeated
    right rows count each.  Rows without partners, and empty tables, give none.
    """
    real = "key IS NOT NULL AND start IS NOT NULL AND stop >= start"
    ended = F.coalesce(F.col("stop"), F.lit(OPEN)).alias("stop")
    long = lambda x: F.col(x).cast("long").alias(x)
    rows = materialize(left.select(long("id"), long("key"), long("start"), ended).filter(real), "left")
    weighted = right.select(long("key"), long("start"), ended, "tag").filter(real).groupBy("key", "start", "stop").agg(F.count("*").alias("n"), F.coalesce(F.sum("tag"), F.lit(0)).cast("long").alias("tags"))
    sides = [rows.select("key", "start", "stop").distinct().select("key", F.lit(0).alias("side"), "start", "stop", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("tags")), weighted.select("key", F.lit(1).alias("side"), "start", "stop", "n", "tags")]
    both = materialize(sides[0].unionByName(sides[1]), "classes")
    parts = lambda s: F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("side") == s, 1)) / classes).cast("int"))
    large = both.groupBy("key").agg(parts(0).alias("p"), parts(1).alias("q")).filter("p > 1 OR q > 1")
    # the parts of this side, by the interval, and all parts of the other
    own = F.pmod(F.xxhash64("start", "stop"), F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p")) - 1))
    split = both.join(large, "key", "left").na.fill(1, ["p", "q"]).withColumn("own", own).withColumn("other", other)
    cells = split.withColumn("cell", F.when(F.col("side") == 0, F.col("own") * F.col("q") + F.col("other")).otherwise(F.col("other") * F.col("q") + F.col("own")))
    dealt = cells.select("key", F.col("cell").cast("long"), F.col("side"), "start", "stop", "n", "tags").repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = dealt.mapInArrow(_joined, FOUND).repartition("key", "start", "stop")
    summed = found.groupBy("key", "start", "stop", "relation").agg(*[F.sum(x).alias(x) for x in ("n_pairs", "overlap_slots", "tags")])
    out = rows.join(summed, ["key", "start", "stop"]).groupBy("id", "relation").agg(*[F.sum(x).alias(x) for x in ("n_pairs", "overlap_slots", "tags")])
    name = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("relation") + 1)
    return out.select("id", name.alias("relation"), "n_pairs", "overlap_slots", "tags")


def sales_in_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots, sessions_crc: sales against the click sessions of their clients."""
    sessions = click_sessions(clicks).withColumn("tag", F.crc32(F.col("first_us").cast("string")))
    return relations(sale_intervals(sales, lines), sessions).withColumnsRenamed({"id": "sale_id", "tags": "sessions_crc"})
