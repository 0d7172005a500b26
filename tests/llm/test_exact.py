"""Operators with exact results, held against plain versions; nulls, empty tables, repeats, ties and clashing columns."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import audio, bpe, neardup, packing, pii, tokenstore, topk, warc
from quire.llm.common import fresh_dir
from quire.llm.words import WordEncoder, vocabulary

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", None, "a", " ", "\n", "a\n\nb  c", "été <|endoftext|> ok", "中文 und 😀́x", "\0 nul", "x" * 3000, "It's 12,345.67 we'll\tsee ", "ŀİſß ª²", "the the the " * 400, "a\r\nb\x0b\x0c\x1c\x85\xa0c"]


def documents(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    if extra:  # names that results have too
        for c in ("n", "score", "start", "component_id", "spans", "kept", "length", "piece", "bits", "class", "row", "media"):
            rows = rows.withColumn(c, F.lit("clash"))
    return rows.repartition(3)


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def fuzz(seed, n, alphabet=None):
    rnd = random.Random(seed)
    alphabet = alphabet or list(" \n\t'<|>09azAZéßñ\xa0\x85\x1c　中،́İſªº²'st.,!-_\r") + ["'ll", "<|endoftext|>", "<|startoftext|>", " the", "ing"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_word_encoder_is_the_library(name):
    made, ids = WordEncoder(vocabulary(name), most=50), library(name)
    for text in [*ODD, *fuzz(1, 4000)]:
        assert np.frombuffer(made.encode(text), "<u4").tolist() == ids(text), text


def test_pair_index_is_the_library():
    made, ids = bpe.Codec(vocabulary(BYTE)), library(BYTE)
    texts = [*ODD, *fuzz(2, 4000), "aaaa" * 500, "abab" * 300]
    for text, found in zip(texts, made.encode(texts), strict=True):
        assert found == ids(text), text
        assert made.decode(found) == (text or "")


def test_bpe_query(spark):
    ids, tokenizer = library(BYTE), Tokenizer.from_file(vocabulary(BYTE))
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, ODD, True), BYTE).collect()}
    for i, text in enumerate(ODD):
        want = ids(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark, ODD).limit(0), BYTE).count() == 0


def test_cuts_are_local():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 9000).astype(np.uint32), rng.integers(0, 50_000, 300).astype(np.uint32)
    ends = tokenstore.cuts(np.concatenate((a, b, a)), [0, len(a) + 37])
    assert ends[-1] == 2 * len(a) + len(b) and len(a) + 37 in ends
    sizes = np.diff([0, *ends])
    assert sizes.max() <= tokenstore.LONGEST and sizes.min() > 0
    parts = lambda x: {bytes(y.tobytes()) for y in np.split(x, tokenstore.cuts(x, [0])[:-1])}
    assert len(parts(a) & parts(np.concatenate((b, a)))) >= len(parts(a)) - 3


def test_crc_of_parts():
    rnd = random.Random(3)
    for _ in range(50):
        parts = [rnd.randbytes(rnd.randint(0, 3000)) for _ in range(rnd.randint(1, 6))]
        after = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
        terms = tokenstore.shifted(np.array([zlib.crc32(p) for p in parts]), np.array(after))
        assert int(np.bitwise_xor.reduce(terms)) == zlib.crc32(b"".join(parts))


def damaged(spark, path):
    """Whatever file of a store is lost, repeated or swapped, both readers raise."""
    import shutil
    from pathlib import Path

    def fails(what, change):
        other = fresh_dir(spark, "test-store")
        shutil.copytree(path, other)
        change(Path(other))
        for read in (tokenstore.read_digests, tokenstore.read_documents):
            with pytest.raises(Exception, match=what):
                read(spark, other).collect()

    files = lambda root, kind: sorted((root / kind).glob("*.parquet"))
    fails("manifest", lambda root: files(root, "recipes")[-1].unlink())
    fails("manifest", lambda root: shutil.copy(files(root, "recipes")[0], root / "recipes" / "again.parquet"))
    fails("stored", lambda root: files(root, "chunks")[-1].unlink())

    def swap(root):
        rows = spark.read.parquet(f"{root}/recipes").orderBy("pos").collect()
        ids = [r["doc_id"] for r in rows]
        ids[0], ids[1] = ids[1], ids[0]
        out = spark.createDataFrame([(*r[:], i) for r, i in zip(rows, ids, strict=True)], spark.read.parquet(f"{root}/recipes").schema.add("swapped", "long"))
        out.withColumn("doc_id", F.col("swapped")).drop("swapped").write.parquet(f"{root}/changed")
        shutil.rmtree(root / "recipes")
        (root / "changed").rename(root / "recipes")

    fails("manifest", swap)


def test_narrow_stores_refuse_wide_ids(spark, monkeypatch):
    made = tokenstore._encode(vocabulary(BYTE), 70_000, False)
    import pyarrow as pa

    with pytest.raises(ValueError, match="wide"):
        next(made(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})])))


def test_token_store(spark):
    texts = [*ODD, *fuzz(4, 40), *["the same long text, again and again. " * 300] * 5, " ".join(fuzz(5, 900))]
    path, ids = fresh_dir(spark, "test-store"), library(BYTE)
    tokenstore.write(documents(spark, texts, True), path, BYTE)
    got, at = {r["doc_id"]: r for r in tokenstore.read_digests(spark, path).collect()}, 0
    for i, text in enumerate(texts):
        want = [*ids(text), 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        at += len(want)
    back = {r["doc_id"]: r["ids"] for r in tokenstore.read_documents(spark, path).collect()}
    assert all([x & 0xFFFF for x in back[i]] == [*ids(t), 0] for i, t in enumerate(texts))
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    whole = spark.read.parquet(f"{path}/manifest").filter("part = -1").first()
    assert (whole["documents"], whole["tokens"]) == (len(texts), at)
    damaged(spark, path)
    odd = spark.createDataFrame([(2, "twice"), (2, "twice"), (None, "no id"), (1, "x" * 200_000)], "doc_id long, text string")
    path = fresh_dir(spark, "test-store")
    tokenstore.write(odd, path, BYTE)
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokenstore.read_digests(spark, path).collect())
    sizes = [len(ids(x)) + 1 for x in ("no id", "x" * 200_000, "twice", "twice")]
    assert [(r[0], r[2]) for r in rows] == [(sum(sizes[:k]), n) for k, n in enumerate(sizes)] and [r[1] for r in rows] == [None, 1, 2, 2]
    empty = fresh_dir(spark, "test-store")
    tokenstore.write(documents(spark, ODD).limit(0), empty, BYTE)
    assert tokenstore.read_digests(spark, empty).count() == 0


def decreasing(lengths, budget):
    import bisect

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else budget
        n += gap == budget
        bisect.insort(gaps, gap - x)
    return n


def placed_well(runs, lengths, budget):
    """Every piece is placed once, sequences have no holes and aren't overfull; returns how many there are."""
    placed, where = defaultdict(list), defaultdict(list)
    for length, rank, n, each, sequence, size in runs:
        placed[length].append((rank, n))
        for k in range(n):
            where[sequence + k // each].append((budget - size + k % each * length, length))
    for length, spans in placed.items():
        assert [r for r, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()][:-1]
        assert sum(n for _, n in spans) == Counter(lengths)[length]
    assert sum(n for spans in placed.values() for _, n in spans) == len(lengths)
    for spans in where.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= budget
    return len(where)


def test_sweep_is_best_fit_decreasing():
    """One range that holds everything, with as many empty sequences as best-fit decreasing opens."""
    rnd = random.Random(5)
    for _ in range(200):
        budget = rnd.choice([10, 64, 2048])
        lengths = [rnd.randint(1, budget - 1 if rnd.random() < 0.8 else max(1, budget // 8)) for _ in range(rnd.randint(0, 300))]
        want = decreasing(lengths, budget)
        runs, left, _ = packing.sweep([(k, 0, n) for k, n in Counter(lengths).items()], [(budget, 0, want)])
        assert not left and placed_well(runs, lengths, budget) == want


@pytest.mark.parametrize(("budget", "low", "high"), [(64, 1, 64), (2048, 1, 2048), (2048, 500, 700), (100, 3, 30)])
def test_rounds_use_no_more_sequences(spark, budget, low, high):
    rnd = random.Random(budget + low)
    lengths = [rnd.randint(low, high) for _ in range(3000)]
    runs, opened = packing.place(spark.createDataFrame([*Counter(lengths).items()], "length long, n long"), budget)
    rows = [(r["value"], r["first"], r["n"], r["each"], r["sequence"], r["size"]) for r in runs.collect()]
    assert placed_well(rows, lengths, budget) == opened <= decreasing(lengths, budget)


def test_packing(spark):
    texts, ids = [*ODD, *fuzz(6, 60), "many words " * 3000, "many words " * 3000], library(WORD)
    rows = packing.pack(documents(spark, texts, True), WORD, budget=64).collect()
    want = {}
    for i, text in enumerate(texts):
        stream = [*ids(text), 0]
        for p, at in enumerate(range(0, len(stream), 64)):
            want[i, p] = (at, len(stream[at : at + 64]), zlib.crc32(struct.pack(f"<{len(stream[at : at + 64])}I", *stream[at : at + 64])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    where = defaultdict(list)
    for r in rows:
        where[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in where.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 64
    assert len(where) == decreasing([x[1] for x in want.values()], 64)
    assert packing.pack(documents(spark, ODD).limit(0), WORD).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # ties
    rows += [(5000, None), (5100, [float("nan")] * 8), (5200, [None] * 8), (5300, [1.0, 2.0]), (5400, [1e30] * 8), (None, [1.0] * 8)]
    schema = "vec_id long, embedding array<float>, score string"
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    got = defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), shard_rows=128, block_rows=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in usable if i % 100 == 0]:
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(usable[q], v, strict=True)))), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
        assert sorted(got.pop(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert not got
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    # finite, but not after scaling
    wide = spark.createDataFrame([(1, [1e308, 1.0]), (2, [1.0, 2.0]), (3, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in topk.top_k(wide, wide).collect()) == [(2, 3), (3, 2)]


def test_top_k_leaves_out_leaves(spark, monkeypatch):
    """Clustered vectors: most pairs of a query and a leaf aren't searched; a hot vector's leaf has many shards."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 6)) * 10
    rows = [(i, (centres[i % 16] + rng.normal(size=6) * 0.1).tolist()) for i in range(1600)] + [(5000 + i, centres[3].tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs, real = [], topk.materialize

    def counting(frame, label):
        out = real(frame, label)
        if label in ("others", "trees"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(topk, "materialize", counting)
    asked = df.filter("vec_id % 100 = 0")
    got = defaultdict(list)
    for r in topk.top_k(df, asked, shard_rows=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    for q in [i for i, _ in rows if i % 100 == 0]:
        scored = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    shards, searched = pairs
    assert shards >= 30 and searched < len(got) * shards / 3


def test_warc(spark):
    big = "x" * 1200
    pages = [(1, "http://a/é b\n", big), (7, None, big), (3, "http://a", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "é" * 600), (9, "u", "é" * 600), (9, "v", "é" * 600), (None, "n", big)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, kind string").repartition(3)
    folder = fresh_dir(spark, "test-warc")
    warc.write(df, folder, roll_bytes=500)
    rows = warc.read(spark, folder, with_payload=True).collect()
    assert len(rows) == len(pages)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    assert got == sorted([(1, 1200, "revisit", 7), (7, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 1200, "revisit", 9), (9, 1200, "response", None), (9, 1200, "response", None), (-1, 1200, "revisit", 7)])
    for r in rows:
        if r["payload"] is not None:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    again = fresh_dir(spark, "test-warc")
    warc.write(df, again, roll_bytes=500)
    files = lambda f: sorted((r["file"], r["sha256"]) for r in spark.read.parquet(f"{f}/manifest").collect())
    assert files(folder) == files(again)
    # neither the layout of the input nor the number of ranges changes a byte
    more = spark.createDataFrame([(i, f"http://a/{i}", "y" * (i * 37 % 1500) if i != 17 else "z" * 300_000) for i in range(300)] + [(5, "again", "y" * 1200)] * 3, "page_id long, url string, html string")
    seen = set()
    for shuffles, layout in (("2", 1), ("5", 7)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            made = fresh_dir(spark, "test-warc")
            warc.write(more.repartition(layout), made, roll_bytes=4000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        seen.add(tuple(files(made)))
        sizes = [r["bytes"] for r in spark.read.parquet(f"{made}/manifest").orderBy("file").collect()]
        assert len(sizes) > 5 and max(sizes[:-1]) > 3000 and warc.read(spark, made).count() == 303
        from pathlib import Path

        assert not [x for x in Path(made).iterdir() if x.name.startswith("_")]
    assert len(seen) == 1
    empty = fresh_dir(spark, "test-warc")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_notices_damage():
    raw = warc.record(1, "u", b"payload", None)
    headers, block = warc.parse(raw)
    assert block.endswith(b"payload") and headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r", b"paYload\r"))


def plain_features(samples):
    """Log-mel patches and segments of 8-bit samples at 16 kHz, written out without vectors."""
    import cmath
    import math

    x = [(b - 128) / 128 for b in samples]
    taps = [math.sin(math.pi * (t - 7.5) / 2) / (math.pi * (t - 7.5) / 2) * (0.54 - 0.46 * math.cos(2 * math.pi * t / 15)) for t in range(16)]
    taps = [h / sum(taps) for h in taps]
    half = [sum(taps[k] * x[n - k] for k in range(16) if n - k >= 0) for n in range(0, len(x), 2)]
    frames = max(1, -(-max(0, len(half) - 256) // 128) + 1)
    half += [0.0] * ((frames - 1) * 128 + 256 - len(half))
    top = 2595 * math.log10(1 + 4000 / 700)
    edges = [700 * (10 ** (top * k / 25 / 2595) - 1) / 8000 * 256 for k in range(26)]
    mel = []
    for f in range(frames):
        window = [half[128 * f + n] * (0.5 - 0.5 * math.cos(2 * math.pi * n / 256)) for n in range(256)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * n / 256) for n, v in enumerate(window))) ** 2 for k in range(129)]
        row = []
        for m in range(24):
            a, b, c = edges[m : m + 3]
            row.append(math.log(sum(p * max(0, min((k - a) / (b - a), (c - k) / (c - b))) for k, p in enumerate(power)) + 1e-6))
        mel.append(row)
    return mel


def test_features_against_a_plain_version():
    import pyarrow as pa

    rnd = random.Random(3)
    raw = bytes(rnd.choice(b"The quick brown fox, 0123") if (i // 700) % 2 else 128 for i in range(192 * 12))
    batch, spans = audio.features(audio.wave(raw))
    got = np.array(batch.column(0).storage.flatten()).reshape(-1, audio.MELS).astype(float)
    want = np.array(plain_features(raw))
    # a rounded value may lie a step further where the plain one is between two steps
    assert np.abs(got[: len(want)] - want).max() <= 0.75 * audio.STEP + 2e-3 and (got[len(want) :] == got[-1]).all()
    energy = got[: len(want)].mean(axis=1)
    level, on, plain = energy - sorted(energy)[len(energy) // 10], False, []
    for i, e in enumerate(level):
        if not on and e >= audio.BEGIN:
            on, begin = True, i
        elif on and e < audio.END:
            on = False
            plain.append((begin, i))
    if on:
        plain.append((begin, len(level)))
    assert plain and spans == [(a * 128 / 8000, b * 128 / 8000) for a, b in plain]
    seconds = [(r["start_s"], r["end_s"]) for r in batch.drop_columns(["patch"]).to_pylist()]
    assert seconds == [(k * 32 * 128 / 8000, min((k + 1) * 32 * 128 / 8000, len(raw) / 16000)) for k in range(len(seconds))]
    assert batch.schema.field("patch").type == pa.fixed_shape_tensor(pa.float16(), [32, 24])


def test_media(spark):
    import pyarrow as pa

    texts = [*ODD, *fuzz(7, 20), "same", "same", "loud " * 2000, "long " * 100_000]
    docs = documents(spark, texts, True)
    docs = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    stored = audio.store(docs)
    extracted = audio.extract(stored)
    every = audio.digests(extracted).collect()
    rows = {r["doc_id"]: r for r in every}
    assert len(every) == len(texts) + 2 and rows[None]["feature"] == rows[4]["feature"] and len({r["feature"] for r in every if r["doc_id"] == 3}) == 1
    media = {r["doc_id"]: r["media"] for r in stored.collect()}
    kept = {r["doc_id"]: r for r in extracted.collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert audio.samples(media[i])[0] == padded
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        # the query's feature is that of the tensors and spans that are stored
        patches, spans = kept[i]["patches"], [struct.pack("<dd", *x) for x in kept[i]["segments"]]
        n = pa.ipc.open_stream(patches).read_all().num_rows
        assert r["feature"] == f"patches={n}x32x24;segments={len(spans)};sha256={hashlib.sha256(patches + b''.join(spans)).hexdigest()}"
        assert patches == audio.stream(audio.features(media[i])[0])
    assert rows[len(texts) - 4]["feature"] == rows[len(texts) - 3]["feature"]
    patches = pa.ipc.open_stream(kept[len(texts) - 2]["patches"]).read_all()
    assert patches.schema.field("patch").type == audio.TENSOR and patches.num_rows == -(-audio.log_mel(np.zeros(5000, np.float32), 8000).shape[0] // audio.FRAMES)
    assert audio.digests(audio.extract(audio.store(documents(spark, ODD).limit(0)))).count() == 0


def test_resampling_and_segments():
    x = np.random.default_rng(0).normal(size=1000).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        h = audio._phases(up, down)[:, ::-1].T.reshape(-1)
        full = np.zeros(len(x) * up)
        full[::up] = x
        want = np.convolve(full, h)[: len(full)][::down]
        assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)
    energy = np.array([0, 0, 1, 0.6, 0.5, 0.3, 0, 0.6, 0, 2, 2], np.float32)
    assert audio.segments(energy) == [(2, 5), (9, 11)]
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000).astype(np.float32)
    assert audio.log_mel(tone, 8000).mean(axis=0).argmax() == audio._filterbank(8000)[round(1000 / 8000 * audio.SIZE)].argmax()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii(spark):
    alphabet = list("ab1234567890@.-+ ()_%\x01\n😀é,") + ["4111 1111 1111 1111", "a@b.co", "+1 212-555-0147", "10.0.0.1", "256.1.1.1", "0001.2.3.4", "GB82 WEST 1234 5698 7654 32", "iban ", "123-45-6789", "ssn: "]
    texts = [*ODD, *fuzz(8, 1500, alphabet), "x@y.z_w@q.r", "a@b@c.com", "1" * 300, "a." * 300 + "@" + "b." * 100]
    got = {r["doc_id"]: r for r in pii.summarise(pii.find(documents(spark, texts, True))).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(got[i]["spans"].split(",")) and all(got[i][f"n_{k}"] == sum(x.startswith(k) for x in want) for k in PATTERNS)


def test_pii_added_kinds_and_long_texts(spark):
    texts = ["my iban: GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "ssn: 123-45-6789", "no 123-45-6789", "a" * 100_000 + "@", "x@" + "b.c" * 40_000, "+" + "(" * 50_000, "1." * 60_000]
    got = {r["doc_id"]: r["spans"] for r in pii.summarise(pii.find(documents(spark, texts))).collect()}
    assert [got[i] for i in range(4)] == ["iban:9:36", "", "ssn:5:16", ""] and got[5].startswith("email:0:")


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 212-555-0147!", 32, "k"), (2, None, 0, None), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, spans_of string")
    rows = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert rows[1]["text"] == "mail [EMAIL] or [PHONE]!" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert (rows[2]["text"], rows[3]["text"], rows[3]["n_chars"]) == (None, "clean", 5) and pii.redact(docs).columns == docs.columns


def test_redaction_of_clashing_names_and_odd_rows(spark):
    names = ["spans", "_text", "_parts_email", "row", "some", "blocks", "done", "cleaned", "_starts_ip", "a.b", "t`x"]
    docs = spark.createDataFrame([(1, "a@b.co", 6, *names), (1, "a@b.co", 6, *names), (None, "+1 212-555-0147 and a@b.co", None, *names)], ["doc_id", "text", "n_chars", *names])
    rows = pii.redact(docs).collect()
    assert sorted(r["text"] for r in rows) == ["[EMAIL]", "[EMAIL]", "[PHONE] and [EMAIL]"] and all(r[c] == c for r in rows for c in names)
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0
    got = pii.summarise(pii.find(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_phone"]) for r in got) == [(0, 1, 1), (1, 1, 0), (1, 1, 0)]
    assert pii.summarise(pii.find(docs.limit(0))).count() == 0


def test_redaction_against_a_plain_version(spark):
    pieces = ["4111 1111 1111 1111", "a@b.co", "+1 212-555-0147", "10.0.0.1", "😀", "é", " ", "-", "word " * 300, "\n", "1.2.3.4@x.y", "+10.0.0.12.14"]
    texts = [*fuzz(12, 300, pieces), "a@b.co " * 2000]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, texts)).collect()}
    for r in pii.redact(documents(spark, texts)).collect():
        text, at, out = texts[r["doc_id"]], 0, []
        for x in spans[r["doc_id"]]:
            if x["start"] >= at:
                out += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
            at = max(at, x["end"])
        assert r["text"] == "".join([*out, text[at:]])


def test_many_matches_cost_little(spark):
    import time

    took = {}
    for n in (1_000, 32_000):
        docs = documents(spark, ["someone@example.org, " * n])
        began = time.time()
        row = pii.summarise(pii.find(docs)).first()
        assert row["n_email"] == n and row["spans"].endswith(f"email:{21 * n - 21}:{21 * n - 2}") and len(pii.redact(docs).first()["text"]) == 9 * n
        took[n] = time.time() - began
    assert took[32_000] < 15  # ways that are quadratic in the matches took more than 30


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(500)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = [None, "", " \n ", "one", "One", "two words", "two  WORDS", "three small words"]
    for edits in [0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 10, 14] * 6:  # a family around the threshold, larger than a small bucket
        t = base[:]
        for _ in range(edits):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent, monkeypatch):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.detect(documents(spark, texts, True), size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, size, percent)


def test_near_duplicate_edge_rows(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    assert neardup.detect(spark.createDataFrame([(8, long), (9, long + " end")], "doc_id long, text string"), 3, 85).filter("component_id = 8").count() == 2
    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (2, "a b c d", "z"), (3, None, "n")], "doc_id long, text string, n string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in neardup.detect(docs, 3, 85).collect())
    assert got == [(-1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = neardup.drop_copies(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 1, 3]
    assert neardup.detect(docs.limit(0), 3, 85).count() == 0


def held_sets(spark, sets, size=3):
    """Members of one group, as connected() takes them."""
    rows = []
    for i, words in enumerate(sets):
        found = neardup.shingles(" ".join(words), size)
        packed, _ = neardup.signature(found, 6)
        rows.append((7, i, len(sets), packed.tolist(), found.tobytes()))
    return spark.createDataFrame(rows, "grp long, rep long, size long, bits array<long>, found binary").repartition(3)


@pytest.mark.parametrize("block", [8, 40])
def test_blocks_connect_what_is_connected(spark, block, monkeypatch):
    """Chains and loose parts of one group, in blocks so small that links go through all three steps."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    base, texts = [rnd.choice(words) for _ in range(60)], []
    for k in range(150):  # neighbours differ in a word, those far apart in many
        if k % 25 == 0:
            base = [rnd.choice(words) for _ in range(60)]
        base = base[:]
        base[rnd.randrange(60)] = rnd.choice(words)
        texts.append(base)
    order = list(range(150))
    rnd.shuffle(order)
    texts = [texts[k] for k in order]
    links = neardup.connected(held_sets(spark, texts), 0.5, 85)
    roots = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    want = [root for _, root in brute_components([" ".join(t) for t in texts], 3, 85)]
    assert [roots.get(i, i) for i in range(150)] == want and 6 <= len(set(want)) < 60


def test_rows_of_a_large_family_grow_with_its_members(spark, monkeypatch):
    """A connected family of many blocks: nobody visits, and every member is shipped once, or twice as a representative."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    shipped, real = [], neardup._within
    counted = spark.sparkContext.accumulator(0)

    def counting(least, percent):
        run = real(least, percent)

        def each(rows):
            counted.add(rows.num_rows)
            return run(rows)

        return each

    monkeypatch.setattr(neardup, "_within", counting)
    monkeypatch.setattr(neardup, "_visits", lambda *_: shipped.append(1))
    base = [f"w{k}" for k in range(200)]
    texts = [[*base, f"y{i}"] for i in range(1000)]
    links = neardup.connected(held_sets(spark, texts), 0.5, 85)
    assert links.count() >= 999 and not shipped and 1000 <= counted.value <= 1000 + 2 * 1000 // 32 + 64


def test_many_ids_are_joined_instead_of_mapped(spark, monkeypatch):
    texts = near_copies()[:60]
    want = [(r["doc_id"], r["component_id"]) for r in neardup.detect(documents(spark, texts), 3, 85).orderBy("doc_id").collect()]
    kept = sorted(r["doc_id"] for r in neardup.drop_copies(documents(spark, texts), 3, 85).collect())
    monkeypatch.setattr(neardup, "_MAP_IDS", 0)
    assert want == [(r["doc_id"], r["component_id"]) for r in neardup.detect(documents(spark, texts), 3, 85).orderBy("doc_id").collect()]
    assert kept == sorted(r["doc_id"] for r in neardup.drop_copies(documents(spark, texts), 3, 85).collect())


def test_pii_sql_agrees(spark):
    """The SQL with the plain patterns, on texts made of pieces of personal data."""
    import duckdb
    import pyarrow as pa

    pieces = ["4111 1111 1111 1111", "a@b.co", "+1 212-555-0147", "10.0.0.1", "00255.1.2.3.4", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", " iban ", "123-45-6789", "ssn ", "bank", "example", "_", "é", ".", " ", "-", "12", "A", "card", "\x01"]
    texts = [*ODD[:8], *fuzz(10, 1200, pieces)]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}))
    want = c.sql(pii.sql())
    columns = want.columns
    got = pii.summarise(pii.find(documents(spark, texts))).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum("iban" in r["spans"] for r in got) > 5 and sum("ssn" in r["spans"] for r in got) > 5
