"""The interval join and its sides, held against plain versions."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import overlap

EPOCH, CLICKS = datetime(1970, 1, 1), "client_id long, ts timestamp_ntz, kind string, key string, tag string"
SALES, LINES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, start string", "sale_id long, shipped_at timestamp_ntz, id string"
us = lambda t: (t - EPOCH) // timedelta(microseconds=1)


def related(a, b, c, d):
    """Relation of [a, b] to [c, d], where infinite ends are equal."""
    order = lambda x, y: (x > y) - (x < y)
    return overlap.RELATIONS[3 * (order(a, c) + 1) + order(b, d) + 1]


def plain(left, right):
    """Sums of (id, key, start, stop) against (key, start, stop, tag)."""
    out = defaultdict(lambda: [0, None, 0])
    for i, k, a, b in left:
        for k2, c, d, tag in right:
            if k is None or k != k2 or a is None or c is None:
                continue
            e, f = (float("inf") if x is None else x for x in (b, d))
            if e < a or f < c or a > f or c > e:
                continue
            s = out[i, related(a, e, c, f)]
            s[0] += 1
            s[2] += tag or 0
            if min(e, f) < float("inf"):
                s[1] = (s[1] or 0) + min(e, f) - max(a, c) + 1
    return {k: tuple(v) for k, v in out.items()}


def intervals(rnd, n, keys, span):
    for _ in range(n):
        start = rnd.choice([None, *range(span)]) if rnd.random() < 0.1 else rnd.randrange(span)
        stop = None if rnd.random() < 0.2 else (start or 0) + rnd.choice([-1, 0, 0, 1, 2, 5, span])
        yield rnd.choice(keys), start, stop


@pytest.mark.parametrize("classes", [16_384, 7, 1])
def test_relations(spark, classes):
    rnd = random.Random(classes)
    left = [(rnd.choice([None, *range(60)]), *x) for x in intervals(rnd, 250, [None, 1, 1, 1, -2, 3], 9)]
    right = [(*x, rnd.choice([None, 5, 1 << 31])) for x in intervals(rnd, 200, [None, 1, 1, -2, 4], 9)]
    right += right[:20]
    rows = spark.createDataFrame(left, "id long, key long, start long, stop long").withColumn("relation", F.lit("clash")).withColumn("n", F.lit("x")).repartition(3)
    other = spark.createDataFrame(right, "key long, start long, stop long, tag long").withColumn("side", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in overlap.relations(rows, other, classes=classes).collect()]
    assert len({r[:2] for r in got}) == len(got)
    assert {r[:2]: r[2:] for r in got} == plain(left, right)


@pytest.mark.parametrize("pairs", [1, 5, 1 << 20])
def test_iejoin(monkeypatch, pairs):
    monkeypatch.setattr(overlap, "PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    for n, m in ((0, 5), (5, 0), (1, 1), (60, 40)):
        make = lambda k: (np.sort(rng.integers(0, 3, k)), s := rng.integers(-5, 9, k), s + rng.choice([0, 1, 3, overlap.OPEN], k))
        a, b = make(n), make(m)
        got = [p for i, j in overlap.iejoin(a, b) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = {(i, j) for i in range(n) for j in range(m) if a[0][i] == b[0][j] and a[1][i] <= b[2][j] and b[1][j] <= a[2][i]}
        assert len(got) == len(want) and set(got) == want


def test_blocks_are_whole_cells(monkeypatch):
    """Batches of any size give what one gives."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 300
    key, cell = np.sort(rng.integers(0, 6, n)), np.zeros(n, np.int64)
    start = rng.integers(0, 20, n)
    names = ["key", "cell", "side", "start", "stop", "n", "tags"]
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, cell, rng.integers(0, 2, n).astype(np.int32), start, start + rng.integers(0, 5, n), np.ones(n, np.int64), rng.integers(0, 9, n))], names=names)
    collect = lambda parts: sorted(tuple(r.values()) for b in overlap._joined(iter(parts)) for r in b.to_pylist())
    want = collect([table])
    for block, step in ((1, 7), (40, 13), (1000, 50)):
        monkeypatch.setattr(overlap, "BLOCK", block)
        assert collect([table.slice(i, step) for i in range(0, n, step)]) == want
    assert collect([]) == []


def shop(seed):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    at = lambda: base + timedelta(seconds=rnd.choice([0, 60, 900, 901, 1800]) + rnd.randrange(0, 40) * 3000, microseconds=rnd.choice([0, 0, 1, 999_999]))
    clicks = [(rnd.choice([None, 1, 1, 2, 3]), None if rnd.random() < 0.05 else at(), rnd.choice([None, "view", "error", "click"]), "x", "y") for _ in range(250)]
    clicks += clicks[:30] + [(9, datetime(1969, 12, 31, 23, 59, 59, 5), "view", "", ""), (9, datetime(1970, 1, 1, 0, 14, 59, 5), "error", "", ""), (9, datetime(1970, 1, 1, 0, 29, 59, 6), "view", "", "")]
    sales = [(i, rnd.choice([None, 1, 1, 2, 5]), rnd.choice([None, "open", "done"]), None if rnd.random() < 0.05 else at(), "z") for i in range(80)] + [(100, 9, "done", datetime(1969, 12, 31), "")]
    sales += [sales[0], (None, 1, "done", base, "z")]
    lines = [(rnd.choice([None, *range(40)]), None if rnd.random() < 0.2 else at(), "w") for _ in range(120)] + [(100, datetime(1970, 1, 1), "")]
    return sales, lines, clicks


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_query(spark, zone):
    sales, lines, clicks = shop(3)
    by = defaultdict(list)
    for client, ts, kind, *_ in clicks:
        if client is not None and ts is not None:
            by[client].append((ts, kind == "error"))
    right, slot = [], 21_600_000_000
    for client, rows in by.items():
        rows.sort()
        groups = [[rows[0]]]
        for r in rows[1:]:
            if r[0] - groups[-1][-1][0] > timedelta(minutes=15):
                groups.append([])
            groups[-1].append(r)
        for g in groups:
            last = g[-1][0]
            right.append((client, us(g[0][0]) // slot, None if any(e for t, e in g if t == last) else us(last) // slot, zlib.crc32(str(us(g[0][0])).encode())))
    left = []
    for sale, client, status, sold, _ in sales:
        if client is not None and sold is not None:
            last = max([sold, *(t for s, t, _ in lines if s == sale and sale is not None and t is not None)])
            left.append((sale, client, us(sold) // slot, None if status == "open" else us(last) // slot))
    frames = [spark.createDataFrame(x, s).repartition(3) for x, s in ((sales, SALES), (lines, LINES), (clicks, CLICKS))]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = overlap.sales_in_sessions(*frames)
        assert got.columns == ["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"]
        assert {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()} == plain(left, right)
        for i in range(3):  # no lines change ends only
            some = overlap.sales_in_sessions(*[f.limit(0) if i == j else f for j, f in enumerate(frames)]).count()
            assert (some > 0) == (i == 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
