r"""TeX text: case protection of titles, accents, escapes, and hyphenation.

Only the title tokeniser needs state from token to token; it's an Arrow-batched UDF over
distinct titles.  The rest are JVM expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: TeX accents and the combining characters they stand for; fixed values.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "c": "\u0327", "k": "\u0328"}
#: TeX letters; fixed values.
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "ı"}
_SINGLE = set("():;.,!?")
_MARKS = set("!?:;.")
_ACRONYM = re.compile(r"(?:[A-Z]\.){2,}")


def _tokens(title: str) -> list[str]:
    """Words, groups and singletons; a group in braces belongs to its word, whatever it holds."""
    out, word, depth = [], "", 0

    def close() -> None:
        nonlocal word
        if word:
            out.append(word)
            word = ""

    i = 0
    while i < len(title):
        c = title[i]
        if depth == 0 and c == " ":
            close()
            if out and out[-1] != " ":
                out.append(" ")
        elif depth == 0 and not word and (m := _ACRONYM.match(title, i)):
            word, i = m.group(), m.end() - 1
        elif depth == 0 and c in _SINGLE:
            close()
            out.append(c)
        elif c == "\\" and i + 1 < len(title):
            word += title[i : i + 2]
            i += 1
        else:
            depth += (c == "{") - (c == "}" and depth > 0)
            word += c
        i += 1
    close()
    return out[:-1] if out and out[-1] == " " else out


def _needs_braces(word: str, after_mark: bool) -> bool:
    bare = re.sub(r"\{[^{}]*\}", "", word)
    if re.search(r"\\(?!&)", bare) or _ACRONYM.fullmatch(bare):
        return True
    core = re.sub(r"^[`'\"]+|[`'\"]+$", "", bare)
    parts = [p for p in re.split(r"-+", core) if p]
    inside = any(re.search(r"[A-Za-z0-9][A-Z]", p) for p in parts) if core[:1].isupper() and "-" in core else bool(re.search(r"[A-Za-z0-9-][A-Z]", core))
    first = core[:1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and core != ""
    return inside or (first and (after_mark or bool(re.search(r"[0-9+]", core[1:]))))


def protect(title: str | None) -> str | None:
    """Braces around what must keep its case: capitals inside words or after a subtitle mark, acronyms, TeX commands."""
    if not title:
        return title
    out, mark, spaced = [], False, False
    for token in _tokens(title):
        if token == " ":
            spaced = mark
        elif token in _SINGLE:
            mark, spaced = token in _MARKS, False
        elif re.fullmatch(r"-+", token):
            mark = True
        else:
            lead, tail = re.match(r"[`'\"]*", token).group(), re.search(r"(?<![`'\"])[`'\"]*$", token).group()
            core = token[len(lead) : len(token) - len(tail)] if len(lead) < len(token) else token
            if core and core != token[:0] and not (core[0] == "{" and core[-1] == "}") and _needs_braces(core, mark and spaced):
                token = f"{lead}{{{core}}}{tail}"
            mark = spaced = False
        out.append(token)
    return "".join(out)


def protected(rows: DataFrame, column: str, out: str = "protected") -> DataFrame:
    """Adds the protected form; every distinct title goes through Python once."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([protect(x) for x in batch.column(0).to_pylist()], pa.string())], names=["_title", out])

    made = rows.select(F.col(column).alias("_title")).distinct().mapInArrow(run, f"_title string, {out} string")
    return rows.join(made, rows[column].eqNullSafe(made["_title"]), "left").drop("_title")


def to_unicode(x: Column) -> Column:
    """Accents and letters of TeX as Unicode, composed."""
    value = F.coalesce(x, F.lit(""))
    for name, letter in sorted(LETTERS.items(), key=lambda p: -len(p[0])):
        value = F.regexp_replace(value, rf"\{{\\{name}\}}|\\{name}(?:\{{\}}|(?![A-Za-z])\s?)", letter)
    for accent, combining in ACCENTS.items():
        gap = r"\s*" if not accent.isalpha() else r"(?:\s+|(?=\{))"
        command = "\\\\" + re.escape(accent)
        value = F.regexp_replace(value, rf"\{{{command}{gap}\{{?([A-Za-zı])\}}?\}}|{command}{gap}\{{?([A-Za-zı])\}}?", f"$1$2{combining}")
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), _COMPOSED, value)


#: What composition has for a base letter and an accent, from the Unicode tables.
_COMPOSED = [(base + mark, whole) for base in "AEIOUYaeiouyCNSZLRTDcnszlrtdgGkKhHjJwWı" for mark in ACCENTS.values() if len(whole := unicodedata.normalize("NFC", ("i" if base == "ı" else base) + mark)) == 1]


def unescape(x: Column) -> Column:
    r"""\unicode{N}, decimal or 0x hexadecimal, as the character."""
    parts = F.split(F.coalesce(x, F.lit("")), r"\\unicode\{")

    def one(p: Column, i: Column) -> Column:
        number = F.regexp_extract(p, r"\A(0x[0-9A-Fa-f]+|[0-9]+)\}", 1)
        code = F.when(F.startswith(number, F.lit("0x")), F.conv(F.substr(number, F.lit(3)), 16, 10)).otherwise(number).try_cast("int")
        rest = F.substr(p, F.length(number) + 2)
        utf16 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return F.when(i == 0, p).when((number != "") & code.isNotNull() & (code < 0x110000), F.concat(F.decode(utf16, "UTF-32"), rest)).otherwise(F.concat(F.lit("\\unicode{"), p))

    return F.array_join(F.transform(parts, one), "")


def hyphenate(rows: DataFrame, column: str, words: DataFrame, key: str, out: str = "hyphenated") -> DataFrame:
    r"""Words that the dictionary (word, hinted) has get its hints, keeping a capital; runs of spaces become one.  Done with joins, so any dictionary size works."""
    parts = rows.select(key, F.posexplode(F.split(F.trim(F.col(column)), r"\s+")).alias("i", "w"))
    bare = F.lower(F.regexp_replace("w", r"\A\W+|\W+\z", ""))
    hinted = parts.withColumn("word", bare).join(words.select(F.lower("word").alias("word"), "hinted"), "word", "left")
    body = F.regexp_extract("w", r"\A(\W*)(.*?)(\W*)\z", 2)
    capital = F.when(F.substring(body, 1, 1) != F.lower(F.substring(body, 1, 1)), F.concat(F.upper(F.substring("hinted", 1, 1)), F.substr(F.col("hinted"), F.lit(2)))).otherwise(F.col("hinted"))
    done = F.when(F.col("hinted").isNull(), F.col("w")).otherwise(F.concat(F.regexp_extract("w", r"\A(\W*)", 1), capital, F.regexp_extract("w", r"\A\W*.*?(\W*)\z", 1)))
    per = hinted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", done.alias("w")))).alias("x"))
    return rows.join(per.select(key, F.array_join(F.transform("x", lambda y: y["w"]), " ").alias(out)), key, "left")


def location(x: Column, aliases: dict[str, str], countries: dict[str, str]) -> Column:
    """Parts between commas by their alias, and a country behind a state that stands alone at the end."""
    known = F.create_map(*[F.lit(y) for p in aliases.items() for y in p]) if aliases else F.create_map().cast("map<string,string>")
    of_state = F.create_map(*[F.lit(y) for p in countries.items() for y in p]) if countries else F.create_map().cast("map<string,string>")
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.coalesce(known[F.regexp_replace(F.trim(p), r"[{}]", "")], F.trim(p)))
    country = of_state[F.element_at(parts, -1)]
    return F.array_join(F.when(country.isNotNull(), F.concat(parts, F.array(country))).otherwise(parts), ", ")


def key_time(key: Column) -> Column:
    """The date in a key of the form prefix-YYYY-MM-DD-hh-mm-ss, '' if it has another form."""
    return F.regexp_extract(key, r"\A.+-([0-9]{4}-[0-9]{2}-[0-9]{2})-[0-9]{2}-[0-9]{2}-[0-9]{2}\z", 1)


def argument_keys(x: Column) -> Column:
    r"""Keys of an argument such as \cite{a, b}."""
    inner = F.regexp_replace(F.coalesce(x, F.lit("")), r"\\?cite\{|\}", "")
    return F.filter(F.transform(F.split(inner, ","), lambda y: F.trim(y)), lambda y: y != "")
