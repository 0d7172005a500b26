"""Deterministic sharded WARC writer, and a reader that verifies.

Records are range-sorted by page id and payload digest, and compressed to one gzip member
each.  Every range's members are written to a segment; file k then gets the members
that begin in the k-th ``roll_bytes`` of the compressed stream of all ranges, whichever
segments they are in.  Headers, record ids and digests are made anew from the page id and
the payload.  So the files depend on the records and on roll_bytes alone, not on
the number or the bounds of the ranges.

Segments and files are written under temporary names of their task attempts and renamed
when whole; the table of segments and the manifest name those that count, so a task that
is lost and run again leaves no double.  Files are reached through pyarrow's file
systems, by the URI of a folder that driver and executors share.

Of the records with equal payloads of at least ``least`` bytes the one with the
largest page id is a response and the others are revisits that refer to it; smaller
payloads are always responses.

Defined cases: null html is an empty payload; rows with one page id are records of
their own, and if that id is the largest of its payload, all of them are responses;
null ids come first and never stand for others; a null URL is that of the page id;
an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, materialize

#: Members of a file begin in one stretch of roll_bytes, so it may be longer than that by its last member.
MANIFEST = "file string, bytes long, sha256 string, records long, first_id long, last_id long"
#: The date of every record: contents alone decide the bytes of a file.
DATE = "2000-01-01T00:00:00Z"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark takes it from, so that executors write where its readers look."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    return re.sub(r"\Afile:/+", "file:///", at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString())


def _fold(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed.  A revisit has the HTTP headers of its payload alone."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda h: "sha1:" + base64.b32encode(bytes.fromhex(h)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or f'urn:page:{page_id}', safe=chr(37) + ':/?#[]@!$&()*+,;=~')}",
        f"WARC-Payload-Digest: {name(digest)}",
        f"WARC-Block-Digest: {name(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        *([] if page_id is None else [f"Page-ID: {page_id}"]),
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file being written under a temporary name; its own name may have the digest of what it holds."""

    def __init__(self, store: fs.FileSystem, root: str):
        self.store, self.root = store, root
        self.temporary = f"{root}/_temporary-{uuid.uuid4().hex}"
        self.out, self.hash, self.size = store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0

    def add(self, body: bytes) -> None:
        self.out.write(body)
        self.hash.update(body)
        self.size += len(body)

    def commit(self, name: str) -> None:
        self.out.close()
        self.store.move(self.temporary, f"{self.root}/{name}")


def member(body: bytes) -> bytes:
    """One gzip member, without time or name in its header."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


SEGMENT = "part int, segment string, at long, bytes long, page_id long"


def _segments(folder: str):
    """Writes the members of a partition to one segment; a row for each record, where it begins and how long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, name = TaskContext.get().partitionId(), None, f"_segment-{uuid.uuid4().hex}"
        group, refers, index = None, None, ([], [], [])
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                for page_id, kind, digest, to, url, html in zip(*(c.to_pylist() for c in batch.slice(low, 500).columns), strict=True):
                    if (page_id, digest) != group:
                        group, refers = (page_id, digest), None
                    if kind == 0:  # what a payload of this page refers to stands before its records
                        refers = to
                        continue
                    if out is None:
                        out = _File(*_fold(folder))
                    body = member(record(page_id, url, (html or "").encode(), refers))
                    for column, value in zip(index, (out.size, len(body), page_id), strict=True):
                        column.append(value)
                    out.add(body)
        if out is not None:
            out.commit(name)
            n = len(index[0])
            for low in range(0, n, 10_000):
                rows = [pa.array(x[low : low + 10_000], pa.int64()) for x in index]
                m = len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([name] * m, pa.string()), *rows], names=["part", "segment", "at", "bytes", "page_id"])

    return run


def _assemble(folder: str):
    """Puts files together from stretches of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fold(folder)
        for batch in batches:
            for number, stretches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, name = _File(store, root), f"{number:08d}.warc.gz"
                stretches.sort(key=lambda x: x["part"])
                for x in stretches:
                    with store.open_input_file(f"{root}/{x['segment']}") as source:
                        source.seek(x["begin"])
                        left = x["end"] - x["begin"]
                        while left:
                            body = source.read(min(left, 1 << 22))
                            if not body:
                                raise ValueError(f"{x['segment']} isn't whole")
                            out.add(body)
                            left -= len(body)
                out.commit(name)
                row = (name, out.size, out.hash.hexdigest(), sum(x["records"] for x in stretches), stretches[0]["first_id"], stretches[-1]["last_id"])
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["file", "bytes", "sha256", "records", "first_id", "last_id"])

    return run


def write(pages: DataFrame, folder: str, least: int = 1000, roll_bytes: int = 64_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the files and then folder/manifest (Parquet), which is the commit.

    Payloads are shuffled once, to their range.  What refers to what is found on
    digests alone and meets the payloads there, as rows that sort before them.
    """
    folder = _qualified(pages.sparkSession, folder)
    store, root = _fold(folder)
    store.create_dir(root, recursive=True)
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(F.encode(text, "UTF-8")).alias("digest"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    small = materialize(pages.filter(F.octet_length(text) >= least).select(F.col(id_col).cast("long").alias("page_id"), F.sha1(F.encode(text, "UTF-8")).alias("digest")), "digests")
    largest = materialize(small.groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).filter("n > 1 AND to IS NOT NULL").drop("n"), "largest")
    notes = small.join(largest, "digest").filter("page_id < to OR page_id IS NULL").distinct()
    both = notes.select("page_id", F.lit(0).alias("kind"), "digest", "to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).unionByName(
        rows.select("page_id", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("to"), "url", "html")
    )
    # a page's records with one payload are in one range, whatever their number of rows elsewhere
    keys = [F.col("page_id").asc_nulls_first(), F.col("digest")]
    ordered = both.repartitionByRange(*keys).sortWithinPartitions(*keys, "kind", F.col("url").asc_nulls_first())
    index = materialize(ordered.mapInArrow(_segments(folder), SEGMENT), "segments")
    # one row for each range
    parts = index.groupBy("part").agg(F.sum("bytes").alias("total"))
    base = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = index.join(F.broadcast(base), "part").withColumn("number", F.floor((F.col("base") + F.col("at")) / F.lit(roll_bytes)).cast("long"))
    stretch = placed.groupBy("number", "part", "segment").agg(
        F.min("at").alias("begin"), F.max(F.col("at") + F.col("bytes")).alias("end"), F.count("*").alias("records"), F.min_by("page_id", "at").alias("first_id"), F.max_by("page_id", "at").alias("last_id")
    )
    whole = stretch.groupBy("number").agg(F.collect_list(F.struct("part", "segment", "begin", "end", "records", "first_id", "last_id")).alias("stretches"))
    numbered = whole.withColumn("file", F.row_number().over(Window.orderBy("number")) - 1).select(F.col("file").cast("long"), "stretches")  # one row for each file
    numbered = materialize(numbered, "files")
    files = max(1, numbered.count())
    numbered.repartition(min(files, 20_000), "file").mapInArrow(_assemble(folder), MANIFEST).write.parquet(f"{folder}/manifest")
    for left in store.get_file_info(fs.FileSelector(root)):  # segments, and what attempts that were lost left behind
        if left.base_name.startswith(("_temporary-", "_segment-")):
            store.delete_file(left.path)
    discard(small, largest, index, numbered)


def members(stream) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one at a time."""
    held, unpacker, out = b"", zlib.decompressobj(31), []
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                break
        out.append(unpacker.decompress(held))
        held = b""
        if unpacker.eof:
            held, done = unpacker.unused_data, b"".join(out)
            unpacker, out = zlib.decompressobj(31), []
            yield done
    if any(out):
        raise ValueError("a member isn't whole")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the block, of one record; digests are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers['warc-record-id']} isn't whole")
    if _hex(headers["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise ValueError(f"{headers['warc-record-id']} doesn't have its digest")
    return headers, block


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _read(folder: str, with_payload: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fold(folder)
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        headers, block = parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, kind = _hex(headers["warc-payload-digest"]), headers["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{headers['warc-record-id']} doesn't have its payload")
                        page, to = headers.get("page-id"), headers.get("refers-to-page-id")
                        rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, headers["warc-target-uri"], payload if with_payload and kind == "response" else None))
                        seen += 1
                        if len(rows) >= 500:
                            yield made(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{file} has {seen} records; the manifest says {records}")
                if rows:
                    yield made(rows)

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads the files of the manifest back, each in one piece: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Digests of blocks and payloads are verified.  Size and digest of a revisit are
    those of the payload it stands for, from its headers.
    """
    folder = _qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = max(1, manifest.count())
    dealt = manifest.repartition(min(files, 20_000), "file")
    return dealt.mapInArrow(_read(folder, with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
