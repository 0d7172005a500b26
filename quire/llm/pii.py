"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, validators (digit counts, octet ranges, Luhn,
mod-97) confirm them, and words nearby raise or lower a span's score.  The four base
kinds are email, ip, card and phone; the method adds iban (confirmed by mod-97) and
ssn (which needs a word nearby that names it).  Base spans that are valid always
stay; added kinds need a score of at least ``least``.

Spans are code points, end exclusive.  Per kind, matches are leftmost and don't
overlap, a match that fails its validator is dropped and not tried again from a later
start; spans of different kinds may overlap.  Null and empty texts have no spans;
every row gives one, so repeated rows and null ids do too; an empty table gives no
rows; find() ignores other columns, redact() keeps them.

The patterns are those of the kinds with possessive quantifiers and with a
look-behind that lets a run of characters be tried only from its start (or from the
end of the last match): the matches are the same, and no text makes them quadratic.
Nor does the number of matches: their places come from sums over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
_LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # eleven more digits at least: shorter runs fail the validator anyway
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?!\w)",
    "ssn": r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)",
}
#: What a text must contain for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
NEAR = {
    "email": r"(?i)(?<!\w)(?:e-?mail|mail|contact|write)",
    "ip": r"(?i)(?<!\w)(?:ip|address|host|server|client)(?!\w)",
    "card": r"(?i)(?<!\w)(?:card|visa|mastercard|amex|credit|debit|payment)",
    "phone": r"(?i)(?<!\w)(?:phone|tel|call|fax|mobile|cell)",
    "iban": r"(?i)(?<!\w)(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"(?i)(?<!\w)(?:ssn|social security)",
}
AGAINST = r"(?i)(?<!\w)(?:example|sample|version|isbn|order no|invoice no|dummy)"
#: Score of a proposed span, what a checksum adds, what a word for it adds and one against it takes.
PROPOSED, CONFIRMED, WORD_FOR, WORD_AGAINST, REACH, LEAST = 0.4, 0.3, 0.3, -0.2, 40, 0.6
_MARK = "\x01"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    value = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    weigh = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, i: s + weigh(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN without spaces passes the ISO 7064 check."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    code = lambda i: F.ascii(F.substr(moved, i, F.lit(1)))
    step = lambda r, i: F.when(code(i) < 65, r * 10 + code(i) - 48).otherwise(r * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        significant = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(significant(x)) <= 3) & (F.coalesce(significant(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def _before(values: Column, start: Column | int, step, block: int = 64) -> Column:
    """For each element of a column of arrays what step makes of all elements before it, from start on.

    step must be associative with start as its neutral element.  Blocks are reduced
    first, then each element goes over its own block alone, so the cost is linear
    (but for a copy of one number for each pair of blocks).
    """
    zero = F.lit(start)
    part = lambda b, n: F.slice(values, (b * block + 1).cast("int"), n)
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(part(b, F.lit(block)), zero, step))
    # what stands before each block; an argument of transform, so that it's made once
    bounds = F.aggregate(blocks, F.array(zero), lambda done, x: F.array_append(done, step(F.element_at(done, -1), x)))
    return F.flatten(F.transform(bounds, lambda bound, b: F.transform(part(b, F.lit(block)), lambda _, j: F.aggregate(part(b, j), bound, step))))


SPANS = "array<struct<start:int,order:int,end:int,kind:string,score:double>>"


def _with_spans(rows: DataFrame, least: float) -> DataFrame:
    """rows (any columns, of which text is one) with spans; names that begin with an underscore are this function's own."""
    columns = rows.columns
    # the marks can't be part of any match, so any other character may stand for them
    clean = F.translate(F.coalesce("text", F.lit("")), _MARK, "\x02")
    marked = lambda k: F.when((F.contains("_text", F.lit(NEEDS[k])) if k in NEEDS else F.lit(True)) & F.col("_text").rlike(PATTERN[k]), F.split(F.regexp_replace("_text", PATTERN[k], f"{_MARK}$0{_MARK}"), _MARK))
    rows = rows.withColumn("_text", clean)
    rows = rows.select(*columns, *[marked(k).alias(f"_parts_{k}") for k in KINDS])
    rows = rows.select("*", *[F.transform(f"_parts_{k}", F.length).alias(f"_sizes_{k}") for k in KINDS])
    # every other part is a match; it starts after all that stands before it
    rows = rows.select("*", *[F.when(F.col(f"_sizes_{k}").isNotNull(), _before(F.col(f"_sizes_{k}"), 0, lambda s, x: s + x)).alias(f"_starts_{k}") for k in KINDS])

    def spans(order: int, kind: str) -> Column:
        parts, starts = F.col(f"_parts_{kind}"), F.col(f"_starts_{kind}")
        odd = F.filter(parts, lambda x, i: i % 2 == 1)

        def span(value: Column, i: Column) -> Column:
            start = F.get(starts, 2 * i + 1)
            around = F.concat(F.right(F.get(parts, 2 * i), F.lit(REACH)), F.lit(" | "), F.left(F.get(parts, 2 * i + 2), F.lit(REACH)))
            score = F.lit(PROPOSED) + F.lit(CONFIRMED if kind != "ssn" else 0.0) + F.when(around.rlike(NEAR[kind]), WORD_FOR).otherwise(0.0) + F.when(around.rlike(AGAINST), WORD_AGAINST).otherwise(0.0)
            return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"), F.when(_valid(kind, value), F.round(score, 2)).otherwise(-1.0).alias("score"))

        bound = 0.0 if kind in BASE else least
        return F.coalesce(F.filter(F.transform(odd, span), lambda x: x["score"] >= bound), F.array().cast(SPANS))

    found = rows.select(*columns, *[spans(i, k).alias(f"_spans_{k}") for i, k in enumerate(KINDS)])
    return found.select(*columns, F.array_sort(F.flatten(F.array(*[f"_spans_{k}" for k in KINDS]))).alias("spans"))


def find(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: array<struct<start, order, end, kind, score>> in ascending order."""
    return _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), least)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, least: float = LEAST, text_col: str = "text", length_col: str = "n_chars", block: int = 1024) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one.  All columns and rows stay, whatever their names.

    length_col, where docs have it, gets the new length of changed texts.  A null
    text stays null.  A stretch of text is taken from the blocks of so many characters
    that it lies in, so the cost is linear in the text and its spans.
    """
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    columns = docs.columns
    # columns of docs are in a struct, so that no name of theirs meets one made here
    found = _with_spans(docs.select(F.struct(*[named(c) for c in columns]).alias("row"), named(text_col).alias("text")), least)
    found = found.withColumn("some", F.size("spans") > 0)
    found = found.withColumn("blocks", F.when(F.col("some"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))))
    # a column, as it's used at every element
    found, ends = found.withColumn("ends", F.transform("spans", lambda x: x["end"])), F.col("ends")

    def stretch(begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / block).cast("int"), F.floor(end / block).cast("int")
        return F.substr(F.array_join(F.slice("blocks", first + 1, last - first + 1), ""), begin - first * block + 1, F.greatest(end - begin, F.lit(0)))

    def piece(x: Column, done: Column) -> Column:
        return F.when(x["start"] < done, F.lit("")).otherwise(F.concat(stretch(done, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))

    # where the text was left before each span; an argument of zip_with, so that it's made once
    before = _before(ends, 0, lambda a, b: F.greatest(a, b))
    rest = stretch(F.array_max(ends), F.length("text"))
    found = found.withColumn("cleaned", F.when(F.col("some"), F.concat(F.array_join(F.zip_with("spans", before, piece), ""), rest)).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)

    def final(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == text_col:
            return F.col("cleaned").alias(c)
        if c == length_col:
            return F.when(F.col("some"), F.length("cleaned").cast(kinds[c])).otherwise(old).alias(c)
        return old.alias(c)

    return found.select(*[final(c) for c in columns])


def _sql_kind(order: int, kind: str, pattern: str, valid: str, near: str, least: float) -> str:
    """Spans of one kind; a text is split at marks around each match, and the lengths before it give its place."""
    return f"""
        SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + length(v) AS e FROM (
            SELECT doc_id, parts[2 * i] AS v, list_sum(list_transform(parts[1:2 * i - 1], lambda x: length(x))) AS s,
                right(parts[2 * i - 1], {REACH}) || ' | ' || left(parts[2 * i + 1], {REACH}) AS around
            FROM (SELECT doc_id, parts, unnest(range(1, len(parts) // 2 + 1)) AS i
                FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d)))
        WHERE {valid} AND ({least} = 0 OR round({PROPOSED} + {0.0 if kind == 'ssn' else CONFIRMED} + CASE WHEN regexp_matches(around, '{near}') THEN {WORD_FOR} ELSE 0 END
            + CASE WHEN regexp_matches(around, '{AGAINST.replace("(?<!" + chr(92) + "w)", chr(92) + "b")}') THEN {WORD_AGAINST} ELSE 0 END, 2) >= {least})"""


def sql() -> str:
    """The same result in DuckDB's SQL, with the kinds' plain patterns."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    at = f"CAST({digits}[-i] AS INT)"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {at} ELSE {at} * 2 - CASE WHEN {at} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    moved = "(replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4])"
    step = "lambda r, c: CASE WHEN c < 65 THEN r * 10 + c - 48 ELSE r * 100 + c - 55 END % 97"
    mod_sql = f"list_reduce(list_prepend(0, list_transform(range(1, length({moved}) + 1), lambda i: ascii({moved}[i]))), {step}) = 1"
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sql}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", mod_sql),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true"),
    }
    word = lambda x: x.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")
    every = " UNION ALL ".join(_sql_kind(i, k, *plain[k], word(NEAR[k]), 0 if k in BASE else LEAST) for i, k in enumerate(KINDS))
    listed = "string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, o)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
        f AS ({every})
        SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (o < {len(BASE)}), '')) AS base_sha256, coalesce({listed}, '') AS spans
        FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id"""
