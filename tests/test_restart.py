"""Restart points of compressed dumps: what tasks read from them is what one stream gives."""

import gzip
import io
import random
import zlib

import pytest

from quire.sources import dblp, restart


def text(n, seed=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    return b"".join(rnd.choice(words).encode() + b" " for _ in range(n // 6))


def member(raw, level=6, strategy=zlib.Z_DEFAULT_STRATEGY, memory=8):
    made = zlib.compressobj(level, zlib.DEFLATED, 31, memory, strategy)
    return made.compress(raw) + made.flush()


RAW = text(1_500_000)
FILES = {
    "plain levels": member(RAW),
    "fast": member(RAW, 1),
    "huffman only": member(RAW[:300_000], 6, zlib.Z_HUFFMAN_ONLY),
    "fixed codes": member(RAW[:300_000], 6, zlib.Z_FIXED),
    "stored": member(RAW[:300_000], 0),
    "random": member(random.Random(1).randbytes(300_000)),
    "members": b"".join(member(RAW[i : i + 90_000]) for i in range(0, 450_000, 90_000)),
    "members and padding": member(RAW[:200_000]) + b"\0" * 700 + member(RAW[200_000:700_000]) + b"\0" * 600_000 + member(b"x"),
    "repeats": member(b"the same line\n" * 200_000),
    "empty members": member(b"") + member(b"") + member(RAW[:1000]),
    "empty": member(b""),
}


@pytest.mark.parametrize("name", FILES)
def test_points(name):
    raw = FILES[name]
    whole = gzip.decompress(raw)
    for every in (1, 30_000, 200_000):
        if every == 1 and len(raw) > 200_000 and "members" not in name:
            continue  # a point for each block is tried below
        found = [*restart.points(io.BytesIO(raw), every)]
        assert found[0][:4] == (0, -1, 0, b"")
        assert [p.out for p in found] == sorted(p.out for p in found)
        for p in found:
            assert b"".join(restart.read(io.BytesIO(raw), p)) == whole[p.out :]
    if name in ("plain levels", "fast"):
        assert len([*restart.points(io.BytesIO(raw), 30_000)]) >= len(raw) // 90_000
    if name.startswith("members"):
        assert sum(p.bit < 0 for p in restart.points(io.BytesIO(raw), 30_000)) == {"members": 5, "members and padding": 3}[name]


def test_broken_files():
    with pytest.raises(EOFError):
        list(restart.points(io.BytesIO(FILES["fast"][:-9]), 30_000))
    broken = bytearray(FILES["fast"])
    broken[-6] ^= 1  # the checksum
    with pytest.raises(zlib.error):
        list(restart.points(io.BytesIO(bytes(broken)), 30_000))


def dump(n, seed=0):
    rnd = random.Random(seed)
    out = ['<?xml version="1.0" encoding="ISO-8859-1"?>\n<dblp>\n']
    for i in range(n):
        kind = rnd.choice(["article", "www", "book"])
        if i % 97 == 0:
            out.append(f'<{kind} key="empty/{i}" mdate="2020-01-01"/>\n')
        title = " ".join(rnd.choice(["flow", "étude", "of &amp; on", "<i>x</i>", "graphs"]) for _ in range(rnd.choice([1, 4, 4, 4000 if i % 50 == 0 else 9])))
        out.append(f'<{kind} key="k/{i}" mdate="20{i % 90 + 10}-01-01">\n<author orcid="{i}">N. {i}</author><title>{title}.</title>\n<booktitle>B</booktitle></{kind}>\n')
    return ("".join(out) + "</dblp>\n").encode("iso-8859-1")


def test_ranges_read_each_record_once(spark, tmp_path):
    first, second = dump(1500), dump(300, 1)
    (tmp_path / "a.xml.gz").write_bytes(member(first, memory=1))  # small blocks
    (tmp_path / "b.xml").write_bytes(second)
    (tmp_path / "c.xml.gz").write_bytes(b"".join(member(second[i : i + 20_000]) for i in range(0, len(second), 20_000)))
    (tmp_path / "d.xml").write_bytes(b"")
    want = sorted([*dblp.stream(io.BytesIO(first)), *dblp.stream(io.BytesIO(second)), *dblp.stream(io.BytesIO(second))])
    assert len([r for r in want if r[4] == ""]) == 1500 + 16 + 2 * (300 + 4)
    for every in (2_000, 1 << 24):
        ranges = dblp.ranges(spark, str(tmp_path), every)
        got = dblp.read(spark, str(tmp_path), every=every)
        assert sorted(map(tuple, got.collect())) == want
        if every == 2_000:
            assert ranges.filter("path LIKE '%a.xml.gz'").count() > 10
            assert got.rdd.getNumPartitions() == ranges.count()
            keys = dblp.read(spark, str(tmp_path), keys_only=True, every=every)
            assert sorted(map(tuple, keys.collect())) == sorted(r for r in want if r[4] == "")
