"""Near-duplicate detection with b-bit MinHash, confirmed on full shingle sets.

1. Every document's set of word shingles gives MINIMA minima.  Bands of minima are hashed to keys; of the minima only the low BITS bits are kept, packed into
   longs.  Documents with equal sets form a class, which goes on as one.
2. Classes that share a band key are candidates.  The similarity of a candidate pair
   is estimated from the number of equal BITS-bit fields, corrected for fields that
   are equal by chance, and pairs below the threshold less MARGIN are left out.
3. The estimated links' components are families.  Within each family pairs are confirmed
   on their full sets.
4. The confirmed links' components are the result.

Large buckets and families are connected in three steps.  Every member goes to one
block, which connects what it holds.  One representative of each part that came of that meets
those of the other blocks, which usually joins the parts.  Only where a bucket
or family is still in several parts do its members meet again: those of its largest part
stay in their blocks, and the others visit all of them, a block of visitors at a time.  So
every pair whose link could join two parts is compared.  A member of a connected group is
shipped once, or twice if it's a representative; only the rows of visitors, and of hosts for
each block of visitors, are more.

No task holds more than two blocks, and none emits more links than rows it holds.  Shingles are 64-bit hashes.  Bands have as many rows as leave a pair at the threshold without a shared
band with a probability of MISS at most: 6 at 0.85, 5 at 0.8.

Defined cases: documents without words (null and empty texts too) have the empty set
and are linked with nothing; with fewer words than a shingle has, the whole sequence is
the one shingle; repeated rows with one id count as one document whose component is
found from each of them; rows with a null id are their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, hold, materialize
from quire.llm.words import Generations

MINIMA, BITS, MARGIN = 192, 4, 0.14
#: The chance that a pair at the threshold shares no band.
MISS = 5e-7
_LONGS = MINIMA * BITS // 64
#: Buckets up to this size emit their pairs; larger ones, and families, go in blocks of BLOCK.
SMALL, BLOCK = 16, 384
_rng = np.random.default_rng(7)
_A, _B = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1), _rng.integers(0, 2**32, MINIMA, dtype=np.uint32))
_WORD = (_rng.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)).tolist()
_KEY = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_words = Generations(xxhash.xxh64_intdigest, 120_000)


def _forget() -> None:
    _words.clear()
    _words.old = {}


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone change, and ASCII white space alone divides
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    _words.turn()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(hashes.tobytes(), seed=len(words))], np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += _mix(hashes[k : k + n] * np.uint64(_WORD[k % 8])) * np.uint64(2 * k + 1)
    return np.unique(_mix(out))


def rows_for(percent: int) -> int:
    """Minima of a band: as many as MISS allows."""
    return max([1, *(r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISS)])


def signature(found: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed low bits of the minima, and the keys of the bands."""
    low, best = found.astype(np.uint32), None
    for at in range(0, len(low), 4096):
        part = (low[at : at + 4096, None] * _A + _B).min(axis=0)
        best = part if best is None else np.minimum(best, part)
    fields = (best & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(_LONGS, -1)
    packed = (fields << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    bands = MINIMA // rows
    keys = _mix(_mix(best.astype(np.uint64) * _KEY)[: bands * rows].reshape(bands, rows).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    return packed.view(np.int64), keys.view(np.int64)


def _sign(size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _forget)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                counts, classes, bits, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, size)
                    counts.append(len(found))
                    if len(found):
                        packed, bands = signature(found, rows)
                        classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        bits.append(packed)
                        keys.append(bands)
                    else:
                        classes.append(None)
                        bits.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "class", "bits", "bands"])

    return run


def estimate(equal: Column | np.ndarray | float):
    """Similarity from the number of equal fields, less those that are equal by chance."""
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def _equal(a: str, b: str) -> Column:
    """How many fields of two packed signatures are equal."""
    ones = int.from_bytes(np.full(8, 0x11, np.uint8).tobytes(), "little")

    def differ(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))

    return F.lit(MINIMA) - sum((differ(i) for i in range(1, _LONGS)), differ(0))


def _equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)]: equal fields of packed signatures."""
    out = np.full((len(a), len(b)), MINIMA, np.int32)
    for i in range(_LONGS):
        x = a[:, i, None] ^ b[None, :, i]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        out -= np.bitwise_count(x & np.uint64(0x1111111111111111))
    return out


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _bits(rows: pa.Table) -> np.ndarray:
    return rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _LONGS)


def _confirms(mine: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two full sets are as similar as is asked."""
    small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


#: What a task of a block returns: the part of each of its members (least of its nodes), or links between parts.
PARTS, LINKS = "grp long, rep long, part long", "a long, b long"


def _connect(forest: _Forest, near: np.ndarray, rows: int, columns: int, sets: list[np.ndarray], percent: int | None) -> list[tuple[int, int]]:
    """Joins what is near, and with percent confirmed on its sets; the links that did.  near's rows and columns begin at these members."""
    links = []
    for x, y in zip(*(i.tolist() for i in np.nonzero(near)), strict=True):
        x, y = x + rows, y + columns
        if forest.root(x) != forest.root(y) and (percent is None or _confirms(sets[x], sets[y], percent)):
            forest.join(x, y)
            links.append((x, y))
    return links


def _sets_of(rows: pa.Table, percent: int | None) -> list[np.ndarray]:
    return [] if percent is None else [np.frombuffer(x, np.uint64) for x in rows.column("found").to_pylist()]


def _within(least: float, percent: int | None):
    """Connects the members of a block: grp, rep, and the part of each."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        bits, ids = _bits(rows), rows.column("rep").to_pylist()
        forest, first = _Forest(len(ids)), [x for x in range(len(ids)) if not x or ids[x - 1] != ids[x]]
        for x in set(range(len(ids))).difference(first):  # one id with several texts
            forest.join(x - 1, x)
        _connect(forest, np.triu(estimate(_equal_fields(bits, bits)) >= least, 1), 0, 0, _sets_of(rows, percent), percent)
        return pa.table({"grp": rows.column("grp").take(pa.array(first, pa.int64())), "rep": pa.array([ids[x] for x in first], pa.int64()), "part": pa.array([ids[forest.root(x)] for x in first], pa.int64())})

    return run


def _visits(least: float, percent: int | None):
    """Compares visitors with the members of a block that are of other parts: a, b of the links that join parts."""

    def run(rows: pa.Table) -> pa.Table:
        rows = pa.concat_tables([rows.filter(rows.column("visits")), rows.filter(pa.compute.invert(rows.column("visits")))])
        first, bits, sets = sum(rows.column("visits").to_pylist()), _bits(rows), _sets_of(rows, percent)
        parts, ids = rows.column("part").to_pylist(), rows.column("rep").to_pylist()
        forest, seen = _Forest(len(ids)), {}
        for x, part in enumerate(parts):
            forest.join(x, seen.setdefault(part, x))
        near = estimate(_equal_fields(bits[:first], bits[first:])) >= least
        out = _connect(forest, near, 0, first, sets, percent)
        return pa.table({"a": pa.array([min(ids[x], ids[y]) for x, y in out], pa.int64()), "b": pa.array([max(ids[x], ids[y]) for x, y in out], pa.int64())})

    return run


def connected(held: DataFrame, least: float, percent: int | None = None) -> DataFrame:
    """a, b: links that connect what is connected within each group.

    held: grp, rep, size (of the group), bits, and found if percent is given; a written table.
    """
    blocks, columns = F.ceil(F.col("size") / BLOCK), [c for c in held.columns if c != "size"]
    mine = held.withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
    parts = materialize(mine.select("block", *columns).groupBy("grp", "block").applyInArrow(_within(least, percent), PARTS), "parts")
    links = parts.filter("rep <> part").select(F.col("part").alias("a"), F.col("rep").alias("b"))
    # representatives of the parts of groups with several blocks
    several = held.filter(blocks > 1).select("grp").distinct()
    chosen = parts.filter("rep = part").join(several, "grp").select("grp", "rep")
    number = chosen.groupBy("grp").agg(F.count("*").alias("parts"))
    met = held.join(chosen, ["grp", "rep"]).join(number, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("parts") / BLOCK)))
    joined = materialize(met.select("block", *columns).groupBy("grp", "block").applyInArrow(_within(least, percent), PARTS), "parts")
    links = links.unionByName(joined.filter("rep <> part").select(F.col("part").alias("a"), F.col("rep").alias("b")))
    # every member's part after that, and the largest of each group that is still in several
    now = parts.join(joined.select("grp", F.col("rep").alias("part"), F.col("part").alias("joined")), ["grp", "part"]).select("grp", "rep", F.col("joined").alias("part"))
    sizes = now.groupBy("grp", "part").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("left"), (F.sum("n") - F.max("n")).alias("visitors")).filter("`left` > 1")
    apart = materialize(now.join(apart, "grp").select("grp", "rep", "part", "largest", F.ceil(F.col("visitors") / BLOCK).alias("turns")), "apart")
    if apart.isEmpty():
        return links
    again = held.join(apart, ["grp", "rep"])
    # a task has a block and a turn of visitors: hosts are there once for each turn, visitors once for each block
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    hosts = again.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("turn", each(F.col("turns"))).withColumn("visits", F.lit(False))
    visitors = again.filter("part <> largest").withColumn("turn", F.pmod(F.xxhash64("rep"), F.col("turns"))).withColumn("block", each(blocks)).withColumn("visits", F.lit(True))
    both = hosts.unionByName(visitors).select("block", "turn", *columns, "part", "visits")
    return links.unionByName(both.groupBy("grp", "block", "turn").applyInArrow(_visits(least, percent), LINKS))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of the links a, b.

    Each round maps every node to the smallest of its neighbours and itself, and
    contracts the links along that map, so at least half of a component's nodes go;
    rounds are as many as the logarithm of the longest path at most.
    """
    links = materialize(links.filter("a <> b").distinct(), "links")
    every: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("next")), "step")
        if every is None:
            now = step.withColumnRenamed("next", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "next")
            now = every.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        now = materialize(now, "roots")
        half = materialize(links.join(step.select(F.col("node").alias("a"), F.col("next").alias("x")), "a").select("x", "b"), "half")
        two = half.join(step.select(F.col("node").alias("b"), F.col("next").alias("y")), "b")
        rest = materialize(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        discard(links, step, half, every)
        links, every = rest, now
    if every is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return every


#: Bits of a map of ids, which bounds its broadcast (2**17 rows), and the most ids for which it leaves enough of the others out.
_MAP_BITS, _MAP_IDS = 23, 1 << 20


def bit_map(ids: DataFrame, column: str) -> DataFrame:
    """word, bits: a map in which the hashes of the ids are marked."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << _MAP_BITS))
    rows = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    return materialize(rows.agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")), "bit-map")


def marked(docs: DataFrame, marks: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose id may be marked - all that are, and a few that aren't - or with left_anti the others."""
    at = F.pmod(F.xxhash64(docs[id_col].cast("long")), F.lit(1 << _MAP_BITS))
    bit = F.getbit(marks["bits"], (at % 64).cast("int"))
    return docs.join(F.broadcast(marks), (F.shiftright(at, 6) == marks["word"]) & (bit == 1), how)


def of_ids(docs: DataFrame, ids: DataFrame, column: str, id_col: str) -> DataFrame:
    """The rows of docs with one of the ids (a written table), and perhaps others: by a map of the ids, or if they're many by a join on them."""
    if ids.count() <= _MAP_IDS:
        return marked(docs, bit_map(ids, column), id_col)
    return docs.join(ids.select(F.col(column).alias("_id")).distinct(), docs[id_col].cast("long") == F.col("_id"), "left_semi")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("neardup", _forget)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x, size).tobytes() for x in part.column(1).to_pylist()], pa.binary())], names=["rep", "found"])

    return run


def detect(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    size: words of a shingle.  percent: documents are linked whose intersection is at
    least that many hundredths of their union.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(_sign(size, rows_for(percent)), "doc_id long, n long, class binary, bits array<long>, bands array<long>"), "signed")
    classes = signed.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    families = _families(classes, percent / 100 - MARGIN)
    links = _confirmed(rows, classes, families, size, percent)
    root = components(links).withColumnRenamed("node", "rep")
    named = materialize(classes.select("class", "rep").join(root, "rep", "left").select("class", F.coalesce("root", "rep").alias("component_id")), "named")
    out = signed.select("doc_id", "n", "class").join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def _families(classes: DataFrame, least: float) -> DataFrame:
    """node, root: components of candidate pairs whose estimated similarity is at least least."""
    keys = classes.select("rep", F.explode("bands").alias("key"))
    several = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    held = materialize(keys.join(several, "key"), "held")
    small = held.filter(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    pairs = F.flatten(F.transform("reps", lambda x, i: F.transform(F.slice("reps", i + 2, F.size("reps")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = materialize(small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    bits = classes.select("rep", "bits")
    half = materialize(pairs.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a")), "a"), "half")
    near = half.join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("bits_b")), "b").filter(estimate(_equal("bits_a", "bits_b")) >= least).select("a", "b")
    large = held.filter(F.col("size") > SMALL).withColumnRenamed("key", "grp")
    large = materialize(large.join(bits, "rep").select("grp", "rep", "size", "bits"), "large")
    out = components(near.unionByName(connected(large, least)))
    discard(several, held, pairs, half, large)
    return out


def _confirmed(rows: DataFrame, classes: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of a family, enough of them to connect what is connected."""
    sets = of_ids(rows, families, "node", "doc_id").mapInArrow(_sets(size), "rep long, found binary")
    sizes = materialize(families.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = materialize(families.withColumnRenamed("node", "rep").withColumnRenamed("root", "grp").join(sizes.withColumnRenamed("root", "grp"), "grp"), "members")
    # a repeated id may have several texts; those of other classes than the representative's don't matter
    found = members.join(sets.dropDuplicates(["rep", "found"]), "rep")
    held = materialize(found.join(classes.select("rep", "bits"), "rep").select("grp", "rep", "size", "bits", "found"), "sets")
    return connected(held, percent / 100 - MARGIN, percent)


def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay when one document of each component does.

    Rows with one id and null ids stay or go with their texts' components; rows
    that have one id and equal texts stay or go together.  Only rows that may have
    to go meet the result; the others pass straight from the scan.
    """
    gone = materialize(detect(docs, size, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() > _MAP_IDS:
        return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    marks = bit_map(gone, "_gone")
    met = marked(docs, marks, id_col)
    met = met.join(gone, met[id_col].cast("long") == gone["_gone"], "left_anti")
    return marked(docs, marks, id_col, "left_anti").unionByName(met)
