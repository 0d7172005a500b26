"""Bibliographic dumps in XML, manifests and nested records.

A dump is read by many tasks, compressed or not: ranges() finds places where reading can
start (see restart), and a task yields the records that begin in its range, reading on
until the last of them is whole.  It holds one block and the record that isn't whole yet.
Bodies are skipped where only keys are wanted.
"""

from __future__ import annotations

import html
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.normalise import title_hash
from quire.scratch import materialize
from quire.sources import restart

#: Elements that are records; fixed values of the format.
RECORDS = ["article", "inproceedings", "proceedings", "book", "incollection", "inbook", "phdthesis", "mastersthesis", "www", "data", "misc"]
MANY = {"ee", "url", "cite", "note"}
SCHEMA = "record_key string, entrytype string, mdate string, publtype string, field string, value string, orcid string, pos int"
_OPEN = re.compile(rf"<({'|'.join(RECORDS)})\b([^>]*)>")
_ATTRIBUTE = re.compile(r'([\w-]+)\s*=\s*"([^"]*)"')
_CHILD = re.compile(r"<([a-z]+)((?:\s+[\w-]+\s*=\s*\"[^\"]*\")*)\s*(?:/>|>(.*?)</\1>)", re.DOTALL)


def records(text: str, keys_only: bool = False) -> Iterator[tuple]:
    """Rows of a document: one for the record itself (field ''), and one for each child.  Inline markup in titles stays."""
    at = 0
    while m := _OPEN.search(text, at):
        kind, attributes = m.group(1), dict(_ATTRIBUTE.findall(m.group(2)))
        head = (attributes.get("key", ""), kind, attributes.get("mdate", ""), attributes.get("publtype", ""))
        yield (*head, "", "", "", 0)
        end = text.find(f"</{kind}>", m.end())
        end = len(text) if end < 0 else end
        if not keys_only and not m.group(2).endswith("/"):
            for pos, child in enumerate(_CHILD.finditer(text, m.end(), end), 1):
                own = dict(_ATTRIBUTE.findall(child.group(2)))
                value = html.unescape(child.group(3) or "").strip()
                if child.group(1) in ("title", "booktitle"):
                    value = value.removesuffix(".")
                yield (*head, child.group(1), value, own.get("orcid", ""), pos)
        at = end


def owned(blocks: Iterator[bytes], start: int = 0, stop: float = float("inf"), keys_only: bool = False) -> Iterator[tuple]:
    """Rows of the records that begin before stop, in XML in ISO-8859-1 that comes in blocks, the first at the offset start."""
    held, at, ended = "", start, False
    while not ended:
        raw = next(blocks, None)
        ended = raw is None
        held += (raw or b"").decode("iso-8859-1")
        done = 0
        while m := _OPEN.search(held, done):
            if at + m.start() >= stop:
                return
            end, close = m.end(), f"</{m.group(1)}>"
            if not m.group(2).endswith("/"):
                found = held.find(close, m.end())
                if found < 0 and not ended:
                    break
                end = len(held) if found < 0 else found + len(close)
            yield from records(held[m.start() : end], keys_only)
            done = end
        # what may be part of a tag or of a record stays
        done = m.start() if m else max(done, held.rfind("<") if held.rfind(">") < held.rfind("<") else len(held))
        at, held = at + done, held[done:]
        if at >= stop and not m:
            return


def _from(source, block: int = restart.BLOCK) -> Iterator[bytes]:
    """The blocks of a seekable binary stream, compressed or not, from its start."""
    source.seek(0)
    head = source.read(2)
    if head == b"\x1f\x8b":
        yield from restart.read(source, restart.Point(0, -1, 0, b""))
    else:
        yield head
        yield from iter(lambda: source.read(block), b"")


def stream(source, keys_only: bool = False, block: int = restart.BLOCK) -> Iterator[tuple]:
    """Rows of a seekable binary stream of XML in ISO-8859-1, compressed or not."""
    yield from owned(_from(source, block), keys_only=keys_only)


def _batches(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.string()] * 7 + [pa.int32()], [x.split()[0] for x in SCHEMA.split(", ")]
    while held := [*itertools.islice(rows, size)]:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def parse(contents: DataFrame, keys_only: bool = False) -> DataFrame:
    """contents has one binary column, content: XML in ISO-8859-1, compressed or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield from _batches(stream(io.BytesIO(raw), keys_only))

    return contents.select("content").mapInArrow(run, SCHEMA)


RANGES = "path string, at long, bit int, start long, stop long, window binary, following long"
#: Ranges into which a dump is taken apart, about, as long as they aren't longer than LONGEST: each is a task, opens its file, and has a window.
MOST, LONGEST = 256, 64 << 20


def _opened(name: str):
    store, at = fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", name))
    return store.open_input_file(at)


def ranges(spark: SparkSession, path: str, every: int = 16 << 20) -> DataFrame:
    """Places in the files of path where reading can start, about every so many bytes: RANGES, bit null where a file isn't compressed.

    One task goes through each file; start and stop are offsets in what it puts out,
    stop null at its end.  An empty file has no range.  In a large dump places are
    further apart than asked, so that their number doesn't grow with it: see MOST.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names and sizes alone: contents aren't loaded
    every = max(every, min(LONGEST, (files.agg(F.sum("length")).first()[0] or 0) // MOST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as source:
                    size, head = source.size(), source.read(2)
                    if head == b"\x1f\x8b":
                        found = restart.points(source, every)
                    else:
                        found = (restart.Point(x, None, x, b"") for x in range(0, size, every))
                    rows = [(name, p.at, p.bit, p.out, q and q.out, p.window, p.following) for p, q in itertools.pairwise([*found, None])]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in RANGES.split(", ")])

    return files.select("path").mapInArrow(run, RANGES)


def read(spark: SparkSession, path: str, keys_only: bool = False, every: int = 16 << 20) -> DataFrame:
    """Rows of all files of path, compressed or not and of any size, each range of about every bytes by a task of its own.

    The ranges are a table in the shared folder, so a lost task reads its own again and no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, bit, start, stop, window, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(name) as source:
                    if bit is None:
                        source.seek(at)
                        blocks = iter(lambda s=source: s.read(restart.BLOCK), b"")
                    else:
                        blocks = restart.read(source, restart.Point(at, bit, start, window, following))
                    yield from _batches(owned(blocks, start, float("inf") if stop is None else stop, keys_only))

    found = materialize(ranges(spark, path, every), "ranges")
    return found.repartitionByRange(max(1, found.count()), "path", "start").mapInArrow(run, SCHEMA)


def manifest(rows: DataFrame) -> DataFrame:
    """record_key, mdate; of a key that occurs twice the last date."""
    return rows.filter("field = ''").groupBy("record_key").agg(F.max("mdate").alias("mdate"))


def persons(rows: DataFrame) -> DataFrame:
    """person, names, canonical, orcid of homepage records; orcid from the attribute first, else from a URL."""
    home = rows.filter((F.col("entrytype") == "www") & F.startswith("record_key", F.lit("homepages/")))
    names = F.array_sort(F.collect_list(F.when(F.col("field") == "author", F.struct("pos", "value"))))
    attribute = F.max(F.when(F.col("field") == "author", F.nullif("orcid", F.lit(""))))
    by_url = F.min(F.when(F.col("field") == "url", F.nullif(F.regexp_extract("value", r"orcid\.org/([0-9X-]{19})", 1), F.lit(""))))
    per = home.groupBy(F.col("record_key").alias("person")).agg(names.alias("n"), F.coalesce(attribute, by_url, F.lit("")).alias("orcid"))
    return per.filter(F.size("n") > 0).select("person", F.transform("n", lambda x: x["value"]).alias("names"), F.get("n", F.lit(0))["value"].alias("canonical"), "orcid")


def redirects(rows: DataFrame) -> DataFrame:
    """old, new of homepage records that have a crossref alone."""
    home = rows.filter((F.col("entrytype") == "www") & F.startswith("record_key", F.lit("homepages/")) & (F.col("field") != ""))
    per = home.groupBy(F.col("record_key").alias("old")).agg(F.max(F.when(F.col("field") == "crossref", F.col("value"))).alias("new"), F.count_if(F.col("field") == "author").alias("n"))
    return per.filter("new IS NOT NULL AND n = 0").select("old", "new")


def children(rows: DataFrame) -> DataFrame:
    """parent, child of crossrefs."""
    return rows.filter("field = 'crossref'").select(F.col("value").alias("parent"), F.col("record_key").alias("child")).distinct()


def identifiers(rows: DataFrame) -> DataFrame:
    """record_key, doi, url: the first ee that is a DOI, and the first other one that is a web address."""
    ee = rows.filter("field = 'ee'")
    doi = F.regexp_extract("value", r"(?i)\Ahttps?://(?:dx\.)?doi\.org/(.+)\z", 1)
    is_doi, is_web = doi != "", (doi == "") & F.col("value").rlike(r"(?i)\Ahttps?://")
    found = ee.groupBy("record_key").agg(F.min(F.when(is_doi, F.struct(F.col("pos"), doi.alias("v")))).alias("d"), F.min(F.when(is_web, F.struct(F.col("pos"), F.col("value").alias("v")))).alias("u"))
    return found.select("record_key", F.coalesce("d.v", F.lit("")).alias("doi"), F.coalesce("u.v", F.lit("")).alias("url"))


#: One record as it's kept in JSON.
JSON = "entrytype string, mdate string, publtype string, fields map<string,string>, authors array<struct<name:string,orcid:string>>, editors array<struct<name:string,orcid:string>>, multi map<string,array<string>>"


def nested(rows: DataFrame) -> DataFrame:
    """record_key and the nested record of the JSON store, with one shuffle."""
    person = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", F.struct(F.col("value").alias("name"), "orcid").alias("p"))))), lambda x: x["p"])
    many = F.col("field").isin(*MANY)
    single = F.array_sort(F.collect_list(F.when(~many & ~F.col("field").isin("", "author", "editor"), F.struct("field", "value"))))
    lists = F.array_sort(F.collect_list(F.when(many, F.struct("field", "pos", "value"))))
    per = rows.groupBy("record_key").agg(F.max("entrytype").alias("entrytype"), F.max("mdate").alias("mdate"), F.max("publtype").alias("publtype"), single.alias("s"), person("author").alias("authors"), person("editor").alias("editors"), lists.alias("m"))
    first = F.map_from_entries(F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1)["field"] != x["field"])))
    names = F.array_distinct(F.transform("m", lambda x: x["field"]))
    return per.select("record_key", "entrytype", "mdate", "publtype", first.alias("fields"), "authors", "editors", F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(F.filter("m", lambda x: x["field"] == n), lambda x: x["value"])))).alias("multi"))


def write_json(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Partitioned by a hash of the key, so that a point look-up reads one of so many parts.  Where there are fewer buckets than tasks should be, several tasks write one."""
    each = -(-4 * rows.sparkSession.sparkContext.defaultParallelism // buckets)
    rest = F.pmod(F.xxhash64("record_key", F.lit(1)), F.lit(each)).cast("int")
    dealt = nested(rows).withColumn("bucket", F.pmod(F.xxhash64("record_key"), F.lit(buckets)).cast("int")).repartition(buckets * each, "bucket", rest)
    dealt.write.partitionBy("bucket").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_key string, " + JSON).json(path)


def look_up(spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """The records of some keys: only their parts are read."""
    rows = spark.read.schema("record_key string, " + JSON + ", bucket int").json(path)
    wanted = spark.createDataFrame([(k,) for k in keys], "record_key string").select("record_key", F.pmod(F.xxhash64("record_key"), F.lit(buckets)).cast("int").alias("bucket"))
    parts = sorted({r["bucket"] for r in wanted.collect()})  # as many as the keys that were asked for
    return rows.filter(F.col("bucket").isin(parts)).join(F.broadcast(wanted.select("record_key").distinct()), "record_key", "left_semi").drop("bucket")


# --- the title index


def title_links(rows: DataFrame) -> DataFrame:
    """hash, record_key of every title and booktitle: the index under which records are found by title."""
    titles = rows.filter(F.col("field").isin("title", "booktitle")).select(title_hash(F.col("value")).alias("hash"), "record_key")
    return titles.filter("hash <> ''").distinct()


def write_title_links(links: DataFrame, path: str) -> None:
    """Lines hash;record_key, in folders by the first two digits of the hash.  A folder of many lines is written by several tasks, each a range of them."""
    lines = links.select(F.substring("hash", 1, 2).alias("part"), F.concat_ws(";", "hash", "record_key").alias("value"))
    lines.repartitionByRange("part", "value").sortWithinPartitions("part", "value").write.partitionBy("part").text(path)


def read_title_links(spark: SparkSession, path: str, hashes: list[str] | None = None) -> DataFrame:
    """hash, record_key; of some hashes only, from their folders alone."""
    lines = spark.read.option("basePath", path).schema("value string, part string").text(path)
    if hashes is not None:
        lines = lines.filter(F.col("part").isin(sorted({h[:2] for h in hashes})))
    out = lines.select(F.substring_index("value", ";", 1).alias("hash"), F.regexp_replace("value", r"\A[^;]*;", "").alias("record_key"))
    return out if hashes is None else out.filter(F.col("hash").isin(hashes))
