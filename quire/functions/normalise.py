"""Column functions that normalise field values.  All of them are JVM expressions; '' and null are both empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chain(x: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda v, s: F.regexp_replace(v, s[0], s[1]), steps, x)


def _empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


#: Fixed values of the title index: commands that are written out, in this order; characters that go; commands whose content stays.
INDEX_LETTERS = [
    ("\\c ", ""), ("\\k ", ""), ("\\v ", ""), ("\\r ", ""), ("\\H ", ""), ("\\AA", "aa"), ("\\AE", "ae"), ("\\OE", "oe"), ("\\aa", "aa"), ("\\ae", "ae"),
    ("\\oe", "oe"), ("\\i", "i"), ("\\ss", "s"), ("\\ell", "l"), ("\\&", "&"), ("\\vert", "|"),
]
INDEX_DROPPED = "{}()$~.,\"'`^*=!?_-:;/| "
INDEX_WRAPPERS = ["mathscr", "mathcal", "textit", "textbf", "mathbb", "mathbf", "mathit", "mathrm", "mbox", "hbox", "emph", "text"]


def _literal(x: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda v, s: F.replace(v, F.lit(s[0]), F.lit(s[1])), steps, x)


def title_index(x: Column, macros: dict[str, str] | None = None) -> Column:
    """The key under which titles are compared: braces, mathematics, punctuation and spaces go, commands leave what they wrap, letters are lower case.

    Other signs, as + and #, stay.  macros (command: text) are written out before
    wrappers go, longest first.  Wrappers are looked for until none is left, also those
    that only come about when others are removed.
    """
    raw = _empty(x)
    out = F.translate(_literal(F.regexp_replace(raw, r"\\unicode\{(?:x[0-9A-Fa-f]+|[0-9]+)\}", ""), *INDEX_LETTERS), INDEX_DROPPED, "")
    out = _literal(out, *[("\\" + k, v) for k, v in sorted((macros or {}).items(), key=lambda m: -len(m[0]))])
    # a round that changes the text takes a backslash or the word away, so there are at most as many rounds as of both
    count = lambda part: F.size(F.split(out, part))
    steps = [("\\backslash", "\\"), ("\\textbackslash", "\\"), *[("\\" + w, "") for w in INDEX_WRAPPERS]]
    out = F.reduce(F.sequence(F.lit(1), count(r"\\") + count("backslash")), out, lambda done, _: _literal(done, *steps))
    # without a backslash there's no command
    return F.lower(F.when(F.contains(raw, F.lit("\\")), _literal(out, ("\\", ""))).otherwise(F.translate(raw, INDEX_DROPPED, "")))


def title_hash(x: Column) -> Column:
    """md5 of the title index; '' for an empty one."""
    index = title_index(x)
    return F.when(index == "", "").otherwise(F.md5(index))


def number(x: Column) -> Column:
    """Ranges of digits get two dashes; other runs of dashes become one."""
    trimmed = F.trim(_empty(x))
    return F.when(trimmed.rlike(r"\A[0-9]+-+[0-9]+\z"), F.regexp_replace(trimmed, "-+", "--")).otherwise(F.regexp_replace(trimmed, "-+", "-"))


def doi(x: Column) -> Column:
    r"""Without doi: or a resolver's address, and with \_ and {_} as _."""
    bare = F.regexp_replace(F.trim(_empty(x)), r"\A(?:doi:\s*|https?://[a-z,.]*/)", "")
    return _literal(bare, ("\\_", "_"), ("{$", ""), ("$}", ""), ("{_}", "_"))


#: Addresses that are rewritten wherever they occur, with http and https; fixed values.
HOSTS = [
    ("arxiv.org/abs/", "doi.org/10.48550/arXiv."), ("dx.doi.org/", "doi.org/"), ("hdl.handle.net/", "doi.org/"), ("scholarspace.manoa.hawaii.edu/handle/", "doi.org/"), ("onlinelibrary.wiley.com/doi/", "doi.org/"),
    ("press.endocrine.org/doi/abs/", "doi.org/"), ("www.atsjournals.org/doi/abs/", "doi.org/"), ("www.computer.org/portal/web/csdl/doi/", "doi.org/"), ("www.mitpressjournals.org/doi/abs/", "doi.org/"),
    ("www.mitpressjournals.org/doi/", "doi.org/"), ("www.tandfonline.com/doi/abs/", "doi.org/"), ("doi.ieeecomputersociety.org/", "doi.org/"),
]
#: Addresses that only change from http to https; fixed values.
SECURE = ["ceur-ws.org/", "aisel.aisnet.org/", "doi.org/"]


def url(x: Column) -> Column:
    """Hosts that serve DOIs become https://doi.org/, arXiv abstracts their DOI; escaped underscores are plain."""
    clean = _literal(F.trim(_empty(x)), ("%5C", "_"), ("\\_", "_"), ("{$", ""), ("$}", ""))
    clean = _literal(clean, *[(f"http://{h}", f"https://{h}") for h in SECURE])
    return _literal(clean, *[(scheme + old, "https://" + new) for old, new in HOSTS for scheme in ("http://", "https://")])


def host(x: Column) -> Column:
    return F.lower(F.regexp_extract(_empty(x), r"\A[a-z]+://([^/:?#]+)", 1))


def _first_of_several(x: Column, label: str) -> Column:
    """The first of several numbers between commas and spaces, without its label."""
    return F.get(F.split(F.trim(F.replace(F.regexp_replace(_empty(x), label, ""), F.lit(","), F.lit(" "))), " "), F.lit(0))


def issn(x: Column) -> Column:
    """The first of several, without label, as NNNN-NNNC; the trimmed value if it has another shape."""
    bare = F.replace(_first_of_several(x, r"\A *ISSN:? *"), F.lit("-"), F.lit(""))
    return F.when(bare.rlike(r"\A[0-9]{7}[0-9,X]\z"), F.concat(F.left(bare, F.lit(4)), F.lit("-"), F.right(bare, F.lit(4)))).otherwise(F.trim(_empty(x)))


#: Nine or twelve digits, each perhaps with a dash after it, and the last one; fixed shape.
ISBN = r"\A(?:(?:[0-9]-?){3})?(?:[0-9]-?){9}[0-9,X]\z"


def isbn(x: Column) -> Column:
    """The first of several, without label; the trimmed value if it has another shape."""
    bare = _first_of_several(x, r"\A *(?:ISBN|isbn)-?(?:10|13)?:? *")
    return F.when(bare.rlike(ISBN), bare).otherwise(F.trim(_empty(x)))


def isbn_index(x: Column) -> Column:
    return F.replace(_empty(x), F.lit("-"), F.lit(""))


#: English month names and their short forms; fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}


def _iso(year: Column, month: Column, day: Column) -> Column:
    """A date as text, null if month or day is out of range."""
    return F.when(month.between(1, 12) & day.between(1, 31), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def date(x: Column) -> Column:
    """ISO dates stay; D.M.Y, M.D.Y, Y.M.D and English dates become ISO; others stay as they are.

    Of two numbers that may both be months the first is the month.
    """
    value = F.trim(_empty(x))
    parts = F.transform(F.split(value, r"\."), lambda y: F.trim(y))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    is_year = lambda y: y.rlike(r"\A[0-9]{4}\z")
    whole = lambda y: F.when(y.rlike(r"\A[+-]?[0-9]{1,9}\z"), y.try_cast("int"))
    last = is_year(at(2))
    year, one, two = F.when(last, at(2)).otherwise(at(0)), whole(F.when(last, at(0)).otherwise(at(1))), whole(F.when(last, at(1)).otherwise(at(2)))
    dotted = F.when((one > 12) & two.between(1, 12), _iso(year, two, one)).otherwise(_iso(year, one, two))
    dotted = F.when((F.size(parts) == 3) & (last | is_year(at(0))), dotted)
    words = F.filter(F.split(value, r"\s+"), lambda y: y != "")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    names = F.create_map(*[F.lit(y) for i, m in enumerate(MONTHS) for y in (m, i + 1)], *[F.lit(y) for p in SHORT_MONTHS.items() for y in p])
    month = lambda i: F.try_element_at(names, F.lower(word(i)))
    day = lambda i: whole(F.regexp_replace(word(i), r",+\z", ""))
    named = F.when(is_year(word(2)), F.coalesce(_iso(word(2), month(1), day(0)), _iso(word(2), month(0), day(1))))
    return F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), value).otherwise(F.coalesce(dotted, named, value))


def year(x: Column) -> Column:
    return F.trim(_empty(x))


def language_id(x: Column, default: str = "") -> Column:
    """The default language isn't named."""
    return F.when((F.lit(default) != "") & (_empty(x) == default), "").otherwise(_empty(x))


def pages(x: Column) -> Column:
    """Ranges between commas, without spaces: dashes collapse, equal ends become one page, a shared section prefix is dropped at the end; other shapes keep single dashes."""
    clean = F.regexp_replace(F.replace(F.trim(_empty(x)), F.lit(" "), F.lit("")), "-+", "-")

    def one(p: Column) -> Column:
        ends = F.split(p, "-")
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        first, second = F.split(a, ":"), F.split(b, ":")
        same = F.get(first, F.lit(0)) == F.get(second, F.lit(0))
        both = (F.size(first) == 2) & (F.size(second) == 2)
        return (
            F.when(F.size(ends) != 2, p).when(a == b, a)
            .when(both & same, F.concat(a, F.lit("--"), F.get(second, F.lit(1))))
            .when(both | ((F.size(first) <= 2) & (F.size(second) == 1)), F.concat(a, F.lit("--"), b))
            .otherwise(p)
        )

    return F.array_join(F.transform(F.split(clean, ","), one), ", ")


def group_list(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(_empty(x), ","), lambda y: F.trim(y)), lambda y: y != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), ", ")


def plain(x: Column) -> Column:
    """Trimmed; a value of braces alone is empty."""
    value = F.trim(_empty(x))
    return F.when(value.rlike(r"\A[{}\s]*\z"), "").otherwise(value)


#: field -> function; other fields are trimmed.
NORMALISERS = {"number": number, "doi": doi, "url": url, "issn": issn, "isbn": isbn, "date": date, "urldate": date, "year": year, "pages": pages, "groups": group_list}


def field_value(field: Column, value: Column) -> Column:
    """Dispatches on the field's name, as one expression."""
    out = None
    for name, f in NORMALISERS.items():
        out = F.when(field == name, f(value)) if out is None else out.when(field == name, f(value))
    return out.otherwise(plain(value))


# --- names


def split_names(x: Column) -> Column:
    """On ' and ' alone."""
    return F.filter(F.transform(F.split(_empty(x), r"\s+and\s+"), lambda y: F.trim(y)), lambda y: y != "")


def split_names_braced(x: Column) -> Column:
    """On ' and ' outside braces: pieces are joined again until their braces balance."""
    depth = lambda s: F.length(F.regexp_replace(s, r"[^{]", "")) - F.length(F.regexp_replace(s, r"[^}]", ""))

    def step(done: Column, piece: Column) -> Column:
        held = F.when(done["held"] == "", piece).otherwise(F.concat(done["held"], F.lit(" and "), piece))
        whole = depth(held) <= 0
        return F.struct(F.when(whole, F.concat(done["out"], F.array(held))).otherwise(done["out"]).alias("out"), F.when(whole, F.lit("")).otherwise(held).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    names = F.aggregate(F.split(_empty(x), r"\s+and\s+"), start, step, lambda d: F.when(d["held"] == "", d["out"]).otherwise(F.concat(d["out"], F.array(d["held"]))))
    return F.filter(F.transform(names, lambda y: F.trim(y)), lambda y: y != "")


def et_al(x: Column) -> Column:
    return F.regexp_replace(_empty(x), r"\s+(?:and\s+)?et\.?\s*al\.?\s*\z", " and others")


def first_last(x: Column) -> Column:
    """'Last, First' as 'First Last'; 'Last, Jr, First' as 'First Last Jr.'; other names stay."""
    parts = F.split(_empty(x), ",")
    at = lambda i: F.get(parts, F.lit(i))
    suffix = F.concat(F.regexp_replace(at(1), r"[ .]+\z", ""), F.lit("."))
    return F.when(F.size(parts) == 2, F.trim(F.concat(at(1), F.lit(" "), at(0)))).when(F.size(parts) == 3, F.trim(F.concat(at(2), F.lit(" "), at(0), suffix))).otherwise(F.trim(_empty(x)))


def compress_initials(x: Column) -> Column:
    """'Surname, A. B.' as 'Surname, A.B.'; names without a comma stay."""
    value = _empty(x)
    at = F.locate(", ", value)
    return F.when(at > 0, F.concat(F.substr(value, F.lit(1), at + 1), F.regexp_replace(F.substr(value, at + 2), r"\. (?=[A-Z]\.)", "."))).otherwise(value)


def forms(x: Column) -> Column:
    """Every form that inversion and compression reach, sorted."""
    once = F.array(x, compress_initials(x))
    return F.array_sort(F.array_distinct(F.concat(once, F.transform(once, first_last))))


def name_list(names: Column, editors: bool = False) -> Column:
    """'A', 'A and B', 'A, B, and C'; editors get (ed.) or (eds.)."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    text = F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.array_join(names, " and ")).otherwise(F.concat(head, F.lit(", and "), F.element_at(names, -1)))
    return F.concat(text, F.when(n == 0, "").when(n == 1, " (ed.)").otherwise(" (eds.)")) if editors else text


#: Words that keys leave out; fixed values.
STOP_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "by", "and", "or", "with", "from", "is", "are", "was", "were", "proceedings", "workshop", "conference", "symposium", "international", "annual"]


def keywords(x: Column) -> Column:
    """Letters a to z and digits of the index of a title's words, unique, in order; no stop words and none that begin with a digit."""
    raw, gaps = _empty(x), " :,./~("
    whole = F.filter(F.split(raw, f"[{gaps}]+"), lambda y: ~F.contains(y, F.lit("\\unicode{")))
    words = F.transform(whole, lambda y: F.regexp_replace(title_index(y), r"[^a-z0-9]", ""))
    # without a backslash there's no command, and the text is cleaned at once
    plain = F.split(F.regexp_replace(F.lower(raw), f"[^a-z0-9{gaps}]+", ""), f"[{gaps}]+")
    words = F.when(F.contains(raw, F.lit("\\")), words).otherwise(plain)
    return F.array_distinct(F.filter(words, lambda y: (y != "") & ~y.isin(STOP_WORDS) & ~y.rlike(r"\A[0-9]")))


def split_unbraced(x: Column) -> Column:
    """Tokens between spaces that no brace encloses."""
    depth = lambda s: F.length(F.regexp_replace(s, r"[^{]", "")) - F.length(F.regexp_replace(s, r"[^}]", ""))

    def step(done: Column, piece: Column) -> Column:
        held = F.when(done["open"], F.concat(done["held"], F.lit(" "), piece)).otherwise(piece)
        whole = depth(held) == 0
        return F.struct(F.when(whole, F.array_append(done["out"], held)).otherwise(done["out"]).alias("out"), held.alias("held"), (~whole).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(False).alias("open"))
    out = F.aggregate(F.split(_empty(x), " "), start, step, lambda d: F.when(d["open"], F.array_append(d["out"], d["held"])).otherwise(d["out"]))
    return F.filter(out, lambda y: y != "")


# --- keys, hashes and sources


def dblp_key(x: Column) -> Column:
    """With the prefix that marks keys of the dump."""
    return F.concat(F.lit("DBLP:"), F.regexp_replace(_empty(x), r"\ADBLP:", ""))


def bare_dblp_key(x: Column) -> Column:
    return F.regexp_replace(F.trim(_empty(x)), r"\ADBLP:", "")


def dblp_parent(x: Column) -> Column:
    """All of a key before its last slash."""
    return F.regexp_extract(_empty(x), r"\A(.*)/[^/]*\z", 1)


def person_hash(x: Column) -> Column:
    """md5 of a name or an identifier; '' for an empty one."""
    return F.when(_empty(x) == "", "").otherwise(F.md5(_empty(x)))


def key_source(x: Column) -> Column:
    """Where a challenging entry comes from, by its key."""
    return F.when(F.startswith(_empty(x), F.lit("DBLP:")), "dblp").otherwise("")


def clean_jr_date(x: Column) -> Column:
    """Without its zone, and with T for a space."""
    return F.replace(F.regexp_replace(_empty(x), r" \+.*\z", ""), F.lit(" "), F.lit("T"))


def repaired_bibtex(x: Column) -> Column:
    """Field values that are bare words get braces."""
    return F.regexp_replace(_empty(x), r"(=\s*)([A-Za-z][A-Za-z0-9_-]*)(\s*[,}])", "$1{$2}$3")


def stem(x: Column, extensions: tuple[str, ...] = (".bib", ".keys", ".select", ".csv", ".json")) -> Column:
    """A path without an extension that's known."""
    known = "|".join(e.replace(".", r"\.") for e in extensions)
    return F.regexp_replace(_empty(x), rf"(?:{known})\z", "")


def located(title: Column, aliases: dict[str, str]) -> Column:
    """Parts of a title between commas are replaced where they're aliases of places; the space around them stays."""
    names = F.create_map(*[F.lit(y) for p in aliases.items() for y in p]) if aliases else F.create_map().cast("map<string,string>")
    part = lambda y: F.concat(F.regexp_extract(y, r"\A(\s*)", 1), F.coalesce(F.try_element_at(names, F.trim(y)), F.trim(y)), F.when(F.trim(y) == "", "").otherwise(F.regexp_extract(y, r"(\s*)\z", 1)))
    return F.array_join(F.transform(F.split(_empty(title), ","), part), ",")


def shorten(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda v, r: F.replace(v, F.lit(r[0]), F.lit(r[1])), rules, _empty(x))


def orcid(x: Column) -> Column:
    return F.regexp_extract(_empty(x), r"([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])/?\s*\z", 1)


def jabref(x: Column) -> Column:
    return F.regexp_replace(_empty(x), r"([\\:;])", r"\\$1")


def to_html(x: Column) -> Column:
    """Emphasis, dashes and braces of TeX as HTML."""
    safe = F.replace(F.replace(F.replace(_empty(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _chain(safe, (r"\\(?:emph|textit)\{([^{}]*)\}", "<em>$1</em>"), (r"\\textbf\{([^{}]*)\}", "<strong>$1</strong>"), ("---", "&mdash;"), ("--", "&ndash;"), (r"[{}]", ""))


def fingerprint(entries: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """entry_key, fingerprint: md5 of the sorted non-empty field=value pairs joined by ';', without noise fields."""
    rows = entries.filter(F.col("value") != "")
    if noise:
        rows = rows.filter(~F.col("field").isin(noise))
    return rows.groupBy("entry_key").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "field", "value"))), ";")).alias("fingerprint"))
