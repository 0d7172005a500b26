"""Exact top-k search by inner product with a KD-tree in every shard.

The top of one KD-tree, with median splits of a bounded sample, deals all vectors into leaves; a
leaf with more rows than a shard may have is dealt into several shards.  Each shard
holds a KD-tree with median splits along the widest side and tight bounding boxes.  A
query visits nodes best first: the largest inner product that any point of a box can
have bounds what lies below, and the search of a shard ends when that bound falls below
the k-th best score so far.

Each query first searches one shard, of the leaf whose middle scores best.  Its k-th
best there is passed on, and only leaves whose box may hold something better get the
query: other pairs of a query and a leaf are left out before anything is shuffled.

Queries go to shards in blocks; a task holds one shard and one block, both bounded.
A scan in blocks is what a search without an index would do; boxes cut it down where
the data allow.

Defined cases: vectors that are null, hold a null or non-finite component, or have one
that isn't finite after scaling, take no part; only vectors of one length are compared;
rows with the query's own id are no candidates; equal scores go to the smaller id; repeated
rows count as often as they occur as candidates and once as queries; where a query's id has several
vectors, each candidate has its best score with any of them, once (and an id that several candidates
have its best, second best and so on); null ids take no part; scores beyond a long are clamped to
it, before they are compared; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

LEAF = 96
#: Bounds of the top tree: leaves for each length of vector, and bytes of the sample that its medians come from.
LEAVES, SAMPLE_BYTES = 1024, 32 << 20
_LONG = 2**63 - 1


class Tree:
    """A KD-tree over integer vectors; ids break ties."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.first, self.span, self.children = [], [], [], [], []
        self._split(0, len(ids), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, begin: int, end: int, leaf: int) -> int:
        me, mine = len(self.span), self.points[begin:end]
        low, high = mine.min(axis=0), mine.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.first.append(int(self.ids[begin:end].min()))
        self.span.append((begin, end))
        self.children.append(None)
        if end - begin > leaf:
            side, middle = int(np.argmax(high - low)), (end - begin) // 2
            # a box without extent is split by id, so that ties can be cut off by the smallest id
            key = mine[:, side] if high[side] > low[side] else self.ids[begin:end]
            order = np.argpartition(key, middle)
            self.points[begin:end], self.ids[begin:end] = mine[order], self.ids[begin:end][order]
            self.children[me] = (self._split(begin, begin + middle, leaf), self._split(begin + middle, end, leaf))
        return me

    def search(self, queries: np.ndarray, own: list[int], k: int, known: list[tuple[int, int] | None]) -> Iterator[list[tuple[int, int]]]:
        """For each query the (score, id) pairs among its k best that beat what is known.

        known: a score and id that k candidates elsewhere reach at least, or None.
        """
        if max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * np.abs(queries).max(initial=0) * queries.shape[1] >= 2**53:
            exact = lambda x: np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)
            points, low, high, queries = exact(self.points), exact(self.low), exact(self.high), exact(queries)
        else:
            points, low, high = self.points, self.low, self.high
        zero = queries * 0
        bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T  # exact, unlike _bounds()
        for q, me, beat, bound in zip(queries, own, known, bounds.tolist(), strict=True):
            best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
            worst = (beat[0], -beat[1]) if beat else None
            queue = [(-bound[0], 0)]
            while queue:
                most, node = heapq.heappop(queue)
                if worst is not None and -most < worst[0]:
                    break
                if worst is not None and -most == worst[0] and self.first[node] > -worst[1]:
                    continue
                if self.children[node]:
                    for child in self.children[node]:
                        if worst is None or bound[child] >= worst[0]:
                            heapq.heappush(queue, (-bound[child], child))
                    continue
                begin, end = self.span[node]
                scores = points[begin:end] @ q
                at = np.arange(end - begin) if worst is None else np.flatnonzero(scores >= worst[0])
                for score, i in zip(scores[at].tolist(), self.ids[begin:end][at].tolist(), strict=True):
                    found = (max(-_LONG - 1, min(_LONG, int(score))), -i)
                    if i == me or worst is not None and found <= worst and (len(best) == k or beat and found < (beat[0], -beat[1])):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                    if len(best) == k and (worst is None or best[0] > worst):
                        worst = best[0]
            yield [(s, -i) for s, i in best]


def _scaled(column: Column, scale: int) -> Column:
    """Every component times scale as doubles, or null for a vector that takes no part."""
    whole = F.transform(column, lambda x: x.cast("double") * scale)
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(column.isNotNull() & ~bad, whole)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        values, offsets = v.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))))
        raw = np.floor(values).astype("<f8")
        blobs = [raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets).astype(np.int32)), pa.array(blobs, pa.binary())], names=["id", "dim", "v"])


def vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, dim, v (little-endian doubles that hold the integers)."""
    picked = rows.select(F.col(id_col).cast("long").alias("id"), _scaled(F.col(vector_col), scale).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    return picked.mapInArrow(_packed, "id long, dim int, v binary")


class Top:
    """The splits of the top tree of vectors of one length: in heap order a side and a value, beyond which a vector goes right."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, int(leaves - 1).bit_length())
        self.sides, self.values = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
        held = {0: points}
        for node in range(len(self.sides)):
            mine = held.pop(node, points[:0])
            if len(mine) > 1:
                side = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
                value = float(np.sort(mine[:, side])[(len(mine) - 1) // 2])
                beyond = mine[:, side] > value
                self.sides[node], self.values[node] = side, value
                held[2 * node + 1], held[2 * node + 2] = mine[~beyond], mine[beyond]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.sides[at]] > self.values[at])
        return at - len(self.sides)


def _points(blobs: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<f8").reshape(len(blobs), dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    for dim in pa.compute.unique(batch.column("dim")).to_pylist():
        yield dim, batch.filter(pa.compute.equal(batch.column("dim"), dim))


def _deal(tops: dict[int, Top]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                leaf = tops[dim].leaf(_points(part.column("v"), dim)) if dim in tops else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("id", "dim", "v")), pa.array(leaf)], names=["id", "dim", "v", "leaf"])

    return run


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    dim, leaf, shard = (x.as_py() for x in key)
    tree = Tree(rows.column("id").to_numpy().copy(), _points(rows.column("v"), dim).copy())
    low, high = (pa.array([x.tolist()], pa.list_(pa.float64())) for x in (tree.low[0], tree.high[0]))
    return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": pa.array([leaf], pa.int64()), "shard": pa.array([shard], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "low": low, "high": high})


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[queries, boxes]: the largest inner product that a point of each box can have."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _route(boxes: dict[int, tuple], home: bool):
    """The leaves that a query goes to: with home the one whose middle scores best, else all others that may hold something as good as what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                if dim not in boxes:
                    continue
                leaves, low, high = boxes[dim]
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    q = _points(some.column("v"), dim)
                    if home:
                        goes = np.zeros((len(q), len(leaves)), bool)
                        goes[np.arange(len(q)), np.argmax(q @ (low + high).T, axis=1)] = True
                    else:
                        bound = _bounds(q, low, high)
                        known = some.column("score").to_pylist()
                        least = np.array([-np.inf if x is None or abs(x) >= _LONG - 1 else x for x in known], float)
                        # rounding of sums of large products must not leave a box out
                        slack = 1 + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
                        goes = (bound + slack >= least[:, None]) & (leaves[None, :] != np.array(some.column("home").to_pylist())[:, None])
                    row, leaf = np.nonzero(goes)
                    taken = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves[leaf], pa.int64())], names=[*some.schema.names, "leaf"])

    return run


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]
        if trees.num_rows and queries.num_rows:
            row, own, known = queries.column("q").to_pylist(), queries.column("id").to_pylist(), [*zip(queries.column("score").to_pylist(), queries.column("last").to_pylist(), strict=True)]
            points = np.frombuffer(b"".join(queries.column("v").to_pylist()), "<f8").reshape(queries.num_rows, key[0].as_py())
            for blob in trees.column("tree").to_pylist():
                for q, query, found in zip(row, own, pickle.loads(blob).search(points, own, k, [x if x[0] is not None else None for x in known]), strict=True):  # noqa: S301  written by _build
                    for score, i in found:
                        for column, value in zip(out, (q, query, i, score), strict=True):
                            column.append(value)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("q", "query_id", "id", "score"), out, strict=True)})

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shard_rows: int = 4096, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k best candidates of every query, exactly.

    shard_rows and block_rows bound what a task holds.  Trees are built once and
    written to the shared folder.
    """
    points = materialize(vectors(candidates, id_col, vector_col, scale), "vectors")
    asked = vectors(queries, id_col, vector_col, scale).dropDuplicates(["id", "v"])
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "queries")  # the row that is searched for; its id says which candidate is left out
    blocks = max(1, -(-asked.count() // block_rows))
    # a row for each length of vector; its sample is drawn by a hash, bounded in bytes
    lengths = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    tops: dict[int, Top] = {}
    for dim, n in lengths.items():
        leaves = min(LEAVES, -(-n // shard_rows))
        if leaves > 1:
            most = max(leaves, SAMPLE_BYTES // (8 * max(1, dim)))
            drawn = points.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("v", "id"), F.lit(1 << 30)) < min(1 << 30, 2 * most * (1 << 30) // n))).limit(2 * most).select("v").collect()
            tops[dim] = Top(np.array([np.frombuffer(r["v"], "<f8") for r in drawn]).reshape(len(drawn), dim), leaves)
    dealt = materialize(points.mapInArrow(_deal(tops), "id long, dim int, v binary, leaf long"), "dealt")
    counts = dealt.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))  # LEAVES rows for each length
    counts = materialize(counts, "leaves")
    # within a leaf rows, not ids or vectors, are dealt out: no value can fill a shard
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("shards"))
    trees = dealt.join(F.broadcast(counts), ["dim", "leaf"]).withColumn("shard", shard).select("dim", "leaf", "shard", "id", "v")
    trees = materialize(trees.groupBy("dim", "leaf", "shard").applyInArrow(_build, "dim int, leaf long, shard long, tree binary, low array<double>, high array<double>"), "trees")

    # the tight boxes of the leaves: at most LEAVES for each length
    def extreme(column: str, least: bool) -> Column:
        def pick(a: Column, b: Column) -> Column:
            return F.zip_with(a, b, lambda x, y: F.least(x, y) if least else F.greatest(x, y))

        return F.reduce(F.collect_list(column), F.lit(None).cast("array<double>"), lambda a, b: F.coalesce(pick(a, b), b))

    boxes: dict[int, tuple] = {}
    found = trees.groupBy("dim", "leaf").agg(extreme("low", True).alias("low"), extreme("high", False).alias("high")).collect()
    for dim in {r["dim"] for r in found}:
        mine = sorted((r["leaf"], r["low"], r["high"]) for r in found if r["dim"] == dim)
        boxes[dim] = (np.array([x[0] for x in mine]), np.array([x[1] for x in mine]).reshape(len(mine), dim), np.array([x[2] for x in mine]).reshape(len(mine), dim))
    spec, keys = "q long, query_id long, id long, score long", ["dim", "leaf", "shard", "block"]

    def searched(wanted: DataFrame) -> DataFrame:
        """wanted: queries with what they go to (a written table); trees go to blocks that want them alone."""
        where = wanted.select(*[F.col(c).alias(c) for c in keys]).distinct()
        return trees.drop("low", "high").join(where, keys[:3]).groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_search(k), spec)

    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks))
    unknown = [F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("last")]
    home = asked.select("id", "dim", "v", "q").mapInArrow(_route(boxes, True), "id long, dim int, v binary, q long, leaf long")
    home = home.join(F.broadcast(counts), ["dim", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("v", "id"), F.col("shards")))
    home = materialize(home.select("id", "q", "dim", "v", "leaf", "shard", "shards", block.alias("block"), *unknown), "home")
    best = materialize(searched(home.drop("shards")), "best")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    kth = best.withColumn("rank", place("q")).filter(F.col("rank") == k).select("q", "score", F.col("id").alias("last"))
    known = home.drop("score", "last").join(kth, "q", "left")
    # the other shards of the leaf that was searched, and the other leaves that may hold something better
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    rest = known.withColumn("other", each).filter("other <> shard").select("id", "q", "dim", "v", "leaf", F.col("other").alias("shard"), "block", "score", "last")
    away = known.select("id", "dim", "v", "q", "score", "last", F.col("leaf").alias("home")).mapInArrow(_route(boxes, False), "id long, dim int, v binary, q long, score long, last long, home long, leaf long")
    away = away.join(F.broadcast(counts), ["dim", "leaf"]).withColumn("shard", each).select("id", "q", "dim", "v", "leaf", "shard", block.alias("block"), "score", "last")
    others = materialize(rest.unionByName(away), "others")
    every = best.unionByName(searched(others)).withColumn("rank", place("q")).filter(F.col("rank") <= k)
    # vectors of one id: a candidate counts with the best of them
    every = every.withColumn("nth", place("q", "id")).groupBy("query_id", "id", "nth").agg(F.max("score").alias("score"))
    return every.withColumn("rank", place("query_id")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
