"""BibTeX files: a scan to rows (entry_key, entrytype, field, value, pos) and a sink.

A file is split into entries with one pass over its characters, in a Python scalar
table function over whole files, because braces and quotes nest; everything after is
DataFrame work.  Errors don't stop a file: they're rows of field '_error', and reading goes
on from the next entry after the place where the error was met, so nothing that was read as part of
a broken entry is read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, entry_key string, entrytype string, field string, value string, pos long"
_NAME = re.compile(r"[^\s{}(),=#\"%]+")
#: Month macros that every style knows; fixed values.
MACROS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "January February March April May June July August September October November December".split(), strict=True))


_BEGIN = re.compile(r"@\s*[A-Za-z]+\s*[{(]")


class BibError(ValueError):
    pass


class _Reader:
    """Recursive descent over one text."""

    def __init__(self, text: str):
        self.text, self.at, self.macros = text, 0, dict(MACROS)

    def space(self) -> None:
        while self.at < len(self.text) and (self.text[self.at].isspace() or self.text[self.at] == "%"):
            if self.text[self.at] == "%":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                self.at += 1

    def take(self, c: str) -> None:
        self.space()
        if self.text[self.at : self.at + 1] != c:
            raise BibError(f"{c!r} is missing at {self.at}")
        self.at += 1

    def name(self) -> str:
        self.space()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise BibError(f"a name is missing at {self.at}")
        self.at = m.end()
        return m.group()

    def enclosed(self, close: str) -> str:
        """Up to the closing mark outside braces, which is consumed."""
        begin, depth = self.at, 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == close and depth == 0:
                self.at += 1
                return self.text[begin : self.at - 1]
            depth += (c == "{") - (c == "}")
            if c == "\\":
                self.at += 1
            self.at += 1
        raise BibError(f"not closed: what begins at {begin}")

    def value(self) -> str:
        parts = []
        while True:
            self.space()
            c = self.text[self.at : self.at + 1]
            if c in ("{", '"') and c:
                self.at += 1
                parts.append(self.enclosed("}" if c == "{" else '"'))
            else:
                word = self.name()
                parts.append(word if word.isdigit() else self.macros.get(word.lower(), word))
            self.space()
            if self.text[self.at : self.at + 1] != "#":
                return re.sub(r"\s+", " ", "".join(parts)).strip()
            self.at += 1

    def fields(self, close: str) -> Iterator[tuple[str, str]]:
        while True:
            self.space()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] == close:
                self.at += 1
                return
            else:
                name = self.name().lower()
                self.take("=")
                yield name, self.value()

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        pos, failed = 0, False
        while True:
            start = self.text.find("@", self.at)
            if failed:  # an address in what's left of a broken entry isn't an entry
                m = _BEGIN.search(self.text, self.at)
                start, failed = m.start() if m else -1, False
            if start < 0:
                return
            self.at = start + 1
            try:
                kind = self.name().lower()
                self.space()
                opened = self.text[self.at : self.at + 1]
                if opened not in ("{", "(") or not opened:
                    raise BibError(f"no entry at {start}")
                self.at += 1
                close = "}" if opened == "{" else ")"
                if kind in ("comment", "preamble"):
                    body = self.enclosed(close)
                    if kind == "comment":
                        yield "", "comment", "_comment", body, pos
                elif kind == "string":
                    for name, value in self.fields(close):
                        self.macros[name] = value
                else:
                    key = self.name()
                    made = [*self.fields(close)]
                    yield key, kind, "entrytype", kind, pos
                    for name, value in made:
                        yield key, kind, name, value, pos
                pos += 1
            except BibError as e:
                yield "", "", "_error", str(e), pos
                failed = True


def parse(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of every text; a text is one task's row, so many files are many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(p, *r) for r in _Reader(t or "").rows()]
                columns = [*zip(*rows, strict=True)] or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns[:5]] + [pa.array(columns[5], pa.int64())], names=["path", "entry_key", "entrytype", "field", "value", "pos"])

    return texts.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse(files.select("path", F.decode("content", "UTF-8").alias("text")))


def rendered(entries: DataFrame) -> DataFrame:
    """entry_key, bibtex of (entry_key, field, value): type and key first, fields in order of their names; empty ones are left out."""
    rows = entries.filter((F.col("value") != "") & ~F.startswith("field", F.lit("_")))
    line: Column = F.concat(F.lit("  "), F.col("field"), F.lit(" = {"), F.col("value"), F.lit("}"))
    per = rows.groupBy("entry_key").agg(F.max(F.when(F.col("field") == "entrytype", F.col("value"))).alias("type"), F.array_sort(F.collect_list(F.when(F.col("field") != "entrytype", line))).alias("lines"))
    return per.filter("type IS NOT NULL").select("entry_key", F.concat(F.lit("@"), F.col("type"), F.lit("{"), F.col("entry_key"), F.lit(",\n"), F.array_join("lines", ",\n"), F.lit("\n}\n")).alias("bibtex"))


def write(entries: DataFrame, path: str) -> None:
    """A folder of text files, entries in order of their keys."""
    rendered(entries).repartitionByRange("entry_key").sortWithinPartitions("entry_key").select(F.concat(F.col("bibtex")).alias("value")).write.text(path)


# --- line formats


def keys_file(lines: DataFrame) -> DataFrame:
    """local, canonical of lines 'local;canonical' or 'canonical'; # begins a comment."""
    clean = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(clean, ";")
    return lines.select(parts.alias("p"), clean.alias("c")).filter("c <> ''").select(F.trim(F.get("p", F.lit(0))).alias("local"), F.trim(F.coalesce(F.get("p", F.lit(1)), F.get("p", F.lit(0)))).alias("canonical"))


def watch_file(lines: DataFrame) -> DataFrame:
    """kind, value, comment of lines 'name "value"; # comment' (also orcid and contributor)."""
    pattern = r'\A\s*(name|orcid|contributor)\s+"([^"]*)"\s*;?\s*(?:#\s*(.*?))?\s*\z'
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.filter(F.col("value").rlike(pattern)).select(part(1).alias("kind"), part(2).alias("value"), part(3).alias("comment"))


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """Quoted rows; rows of another width or type go to _corrupt_record instead of failing the scan."""
    return spark.read.schema(schema + ", _corrupt_record string").option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(rows: DataFrame, path: str, order: list[str], sep: str = ";") -> None:
    """Quoted rows in one global order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path)
