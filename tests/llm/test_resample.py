"""Importance resampling, held against a plain version; radix selection and ranks against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_exact import ODD, documents, fuzz

from quire.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def plain(docs, target, percent, least, seed, buckets):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))
    s, t = count(x for _, x in docs), count(target)
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((-r[3], r[0], k) for k, (r, d) in enumerate(zip(rows, docs, strict=True)) if r[0] is not None and len(words(d[1])) >= least)
    for rank, (*_, k) in enumerate(may[: percent * len(may) // 100], 1):
        rows[k][4] = rank
    return rows


def test_hashes():
    rnd = random.Random(0)
    texts = [*ODD, *fuzz(3, 300), "w" * 200 + " " + "v" * 65 + " x " + "y" * 64, *(" ".join("ab" * rnd.randint(0, 90) for _ in range(9)) for _ in range(40))]
    first, pairs, count = resample.hashed(texts)
    at = 0
    for text, n in zip(texts, count.tolist(), strict=True):
        w = words(text)
        assert len(w) == n
        assert first[at : at + n].tolist() == [zlib.crc32(x.encode()) for x in w]
        assert pairs[at : at + max(0, n - 1)].tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:], strict=False)]
        at += n
    assert [len(x) for x in resample.hashed([])] == [len(x) for x in resample.hashed([None, ""])[:2]] + [0] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_up_to(spark, seed):
    rnd = random.Random(seed)
    wide = [[0, 1, 5], [-(1 << 63), (1 << 63) - 1, 0, -1, 7], [rnd.randrange(-(1 << 40), 1 << 40) for _ in range(300)]][seed]
    rows = [(rnd.choice(wide), rnd.choice([-3, -1, 0, 2, 1 << 50]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, row long").repartition(3).cache()
    order = sorted(rows)
    for k in (0, 1, 2, 137, 299, 300):
        assert sorted(map(tuple, df.filter(resample.up_to(df, ["a", "b", "row"], k)).collect())) == order[:k]
    assert [tuple(r)[:3] for r in sorted(resample.ranked(df, ["a", "b", "row"]).collect(), key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in resample.ranked(df, ["a", "b", "row"]).collect()) == list(range(1, 301))


def test_query(spark):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(["alpha", "Beta", "gamma,", "délta", "x1", "Ω"]) for _ in range(n))
    texts = [*ODD, *(say(rnd.randint(0, 40)) for _ in range(80))]
    docs, target = list(enumerate(texts)), [say(30), None, "", "alpha alpha beta"]
    target_rows = spark.createDataFrame([(x,) for x in target], "text string").withColumn("bucket", F.lit("clash"))
    rows = documents(spark, texts, True).withColumn("rank", F.lit("clash")).withColumn("weight", F.lit("clash"))
    got = resample.resample(rows, target_rows, percent=25, least=20, buckets=50)
    assert sorted(map(list, got.collect()), key=lambda r: r[0]) == plain(docs, target, 25, 20, 7, 50)
    drawn = resample.draw(documents(spark, texts), target_rows, percent=25, least=20, buckets=50)
    assert {(r["doc_id"], r["text"]) for r in drawn.collect()} == {(r[0], texts[r[0]]) for r in plain(docs, target, 25, 20, 7, 50) if r[4]}
    assert resample.resample(rows.limit(0), target_rows).count() == 0
    assert [list(r) for r in resample.resample(rows, target_rows.limit(0), percent=0, buckets=50).orderBy("doc_id").collect()] == plain(docs, [], 0, 20, 7, 50)
    every = resample.resample(rows, target_rows, percent=100, least=0, buckets=50)
    assert sorted(r["rank"] for r in every.collect()) == list(range(1, len(texts) + 1))


def test_repeated_and_null_ids(spark):
    text = "one two three " * 10
    docs = [(None, text), (None, "x"), (3, text), (3, text), (3, text), (4, "short"), (5, text)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(text,)], "text string"), percent=50, buckets=100)
    want = plain(docs, [text], 50, 20, 7, 100)
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(map(list, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in want) == 2


def test_gains_floor():
    s, t = np.array([0, 5, 1 << 40]), np.array([3, 0, 7])
    n, m = s.sum() + 3, t.sum() + 3
    assert resample.gains(s, t).tolist() == [math.floor(1000 * math.log((y + 1) * n / ((x + 1) * m))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
