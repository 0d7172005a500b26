"""Character maps, and a transducer that applies them in one pass.

Maps say what characters, entities, inline tags and macros become.  Each has built-in
values and a CSV file in a folder, which counts in place of them where it's there:

unicode_map.csv: code point (decimal), replacement; html_character_map.csv: entity,
replacement; html_commands_map.csv: tag, opening, closing; latex_indexer.csv: macro;
replacement.  Lines that begin with # are comments.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: TeX accents of combining marks, and whether the letter is in braces of its own; fixed values.
MARKS = {
    "̀": ("`", False), "́": ("'", False), "̂": ("^", False), "̃": ("~", False), "̈": ('"', False), "̇": (".", False),
    "̄": ("=", True), "̆": ("u", True), "̊": ("r", True), "̋": ("H", True), "̌": ("v", True), "̧": ("c", True), "̨": ("k", True),
}
#: Letters that are commands; fixed values.
COMMANDS = {"Å": "AA", "å": "aa", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Ð": "DH", "ð": "dh", "Đ": "DH", "đ": "dh", "Þ": "TH", "þ": "th", "ß": "ss", "ı": "i"}
#: Letters beyond Latin-1 that have a replacement, and Greek ones; fixed values.
EXTENDED = "ĀāĄąĆćČčĐđĒēĚěĜĝĞğİıĹĺĽľŁłŃńŇňŌōŐőŒœŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŸŹźŻżŽž"
GREEK = "ΔΠΣΦΨΩαβγδεθκλμνπρτω"
#: Replacements of other characters; fixed values.
OTHERS = {
    " ": " ", " ": " ", " ": " ", " ": " ", "　": " ", "­": "", "​": "", "‌": "", "‍": "", "‎": "", "⁠": "", "️": "",
    "‐": "-", "‑": "-", "−": "-", "‒": "--", "–": "--", "─": "--", "—": "---", "‘": "'", "’": "'", "“": "``", "”": "''",
    "、": ",", "，": ",", "．": ".", "：": ":", "；": ";", "！": "!", "？": "? ", "（": "(", "）": ")",
    "［": "{", "〕": "{", "］": "}", "〖": "}", "｝": "}", "｛": "{", "✱": "*", "❑": "*", "…": "...", "ａ": "a",
    "£": "{\\pounds}", "§": "\\S{}", "©": "{\\copyright}", "«": "{\\guillemotleft}", "¬": "\\(\\neg\\)", "®": "{\\textregistered}", "°": "\\(^\\circ\\)", "±": "\\(\\pm\\)", "²": "\\({}^{\\mbox{2}}\\)", "³": "\\({}^{\\mbox{3}}\\)",
    "´": "\\'{}", "µ": "\\(\\mu\\)", "·": "{\\cdot}", "»": "{\\guillemotright}", "¼": "{\\textonequarter}", "½": "{\\textonehalf}", "¾": "{\\textthreequarters}", "¿": "?", "×": "\\(\\times\\)",
    "ϵ": "\\varepsilon", "˜": "{\\~{}}", "̈": "", "‹": "\\guilsinglleft{}", "€": "{\\euro}", "ℋ": "\\(\\mathcal{H}\\)", "ℒ": "\\(\\mathcal{L}\\)", "ℓ": "\\(\\ell\\)", "™": "{\\texttrademark}",
    "↔": "\\(\\leftrightarrow\\)", "∃": "\\(\\exists\\)", "∗": "\\(\\ast\\)", "∞": "\\(\\infty\\)", "≠": "\\(\\neq\\)", "⊂": "\\(\\subset\\)", "⊥": "\\(\\perp\\)", "⋆": "\\(\\star\\)", "□": "\\(\\square\\)", "ﬁ": "fi",
    "С": "{\\cyrchar\\CYRS}", "\U0001d554": "", "\U0001f44d": "", "\U00020000": "",
}
#: Entities that aren't letters; fixed values.
ENTITIES = {
    "nbsp": " ", "ndash": "--", "mdash": "---", "lsquo": "'", "rsquo": "'", "ldquo": "``", "rdquo": "''", "hellip": "...", "bull": "\\textbullet{}", "dagger": "\\dag{}", "Dagger": "\\ddag{}", "trade": "{\\texttrademark}", "euro": "{\\euro}",
    "iexcl": "!", "cent": "\\textcent{}", "pound": "{\\pounds}", "curren": "\\textcurrency{}", "yen": "\\textyen{}", "sect": "\\S{}", "copy": "{\\copyright}", "reg": "{\\textregistered}", "laquo": "{\\guillemotleft}", "raquo": "{\\guillemotright}",
    "ordf": "\\textordfeminine{}", "ordm": "\\textordmasculine{}", "deg": "\\(^\\circ\\)", "micro": "\\(\\mu\\)", "para": "\\P{}", "middot": "{\\cdot}", "cedil": "{\\c{}}", "iquest": "?", "frac14": "{\\textonequarter}", "frac12": "{\\textonehalf}", "frac34": "{\\textthreequarters}",
    "minus": "-", "times": "\\(\\times\\)", "divide": "\\(\\div\\)", "plusmn": "\\(\\pm\\)", "sup2": "\\({}^{\\mbox{2}}\\)", "sup3": "\\({}^{\\mbox{3}}\\)", "prime": "\\({}'\\)", "Prime": "\\({}''\\)",
}
#: Inline tags with what opens and closes them, and macros of the title index; fixed values.
TAGS = {"i": ("{\\emph{", "}}"), "tt": ("{\\tt ", "}"), "sup": ("\\({}^{\\mbox{", "}}\\)"), "sub": ("\\({}_{\\mbox{", "}}\\)")}
MACROS = {"cyrchar": "", "CYRS": "c"}


def accented(letter: str, dotless: bool = False) -> str | None:
    """TeX of a Latin letter with an accent, or of one that's a command."""
    if letter in COMMANDS:
        return f"{{\\{COMMANDS[letter]}}}"
    parts = unicodedata.normalize("NFD", letter)
    if len(parts) != 2 or parts[1] not in MARKS:
        return None
    accent, braced = MARKS[parts[1]]
    base = "\\i" if dotless and parts[0] == "i" else parts[0]
    return f"{{\\{accent}{{{base}}}}}" if braced else f"{{\\{accent}{base}}}"


def greek(name: str) -> str:
    """TeX of a Greek letter by its English name; capitals that look like Latin ones are those."""
    latin = dict(zip("Alpha Beta Epsilon Zeta Eta Iota Kappa Mu Nu Omicron Rho Tau Chi omicron".split(), "ABEZHIKMNOPTXo", strict=True))
    return f"\\({latin.get(name) or chr(92) + {'epsilon': 'varepsilon'}.get(name, name)}\\)"


def _unicode_defaults() -> dict[str, str]:
    letters = [chr(x) for x in range(0xC0, 0x100) if chr(x) not in "×÷"] + list(EXTENDED)
    out = {x: accented(x) for x in letters}
    for x in GREEK:
        name = unicodedata.name(x).rsplit(" ", 1)[1].replace("LAMDA", "LAMBDA")
        out[x] = greek(name.capitalize() if "CAPITAL" in unicodedata.name(x) else name.lower())
    return out | OTHERS


def _entity_defaults() -> dict[str, str]:
    out = dict(ENTITIES)
    for name, code in name2codepoint.items():
        x = chr(code)
        if 0xC0 <= code < 0x100 and x not in "×÷" or name in ("OElig", "oelig", "Scaron", "scaron", "Yuml"):
            out[name] = accented(x, dotless=True)
        elif 0x391 <= code <= 0x3C9 and name != "sigmaf":
            out[name] = greek(name)
    return out


@dataclass(frozen=True)
class Maps:
    """characters: character -> text; entities: name -> text; tags: name -> (opening, closing); macros: command -> text."""

    characters: dict[str, str] = field(default_factory=_unicode_defaults)
    entities: dict[str, str] = field(default_factory=_entity_defaults)
    tags: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(TAGS))
    macros: dict[str, str] = field(default_factory=lambda: dict(MACROS))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Maps:
        """The maps of a folder; a file that isn't there leaves the built-in values.  Lines that can't be read are skipped."""
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).filter(F.substring_index("path", "/", -1).isin(*FILES)).select(F.substring_index("path", "/", -1), F.decode("content", "UTF-8")).collect()  # four small files
        return Maps(**{FILES[name][0]: FILES[name][1](text) for name, text in there})

    def save(self, folder: str) -> None:
        """Writes the four files to a local folder."""
        quoted = lambda x: '"' + x.replace('"', '""') + '"' if x != "" and (not x.strip() or any(c in x for c in '",\n')) else x
        lines = {
            "unicode_map.csv": [f"{ord(k)},{quoted(v)}" for k, v in self.characters.items()],
            "html_character_map.csv": [f"{k},{quoted(v)}" for k, v in self.entities.items()],
            "html_commands_map.csv": [f"{k},{quoted(a)},{quoted(b)}" for k, (a, b) in self.tags.items()],
            "latex_indexer.csv": [f"{k};{v}" for k, v in self.macros.items()],
        }
        for name, rows in lines.items():
            with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
                f.write("\n".join([f"# {name}", *rows]) + "\n")


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.startswith("#")]


def _pairs(text: str) -> list[list[str]]:
    return [r for x in _lines(text) for r in csv.reader(io.StringIO(x)) if len(r) >= 2]


def _characters(text: str) -> dict[str, str]:
    rows = [r for r in _pairs(text) if r[0].strip().isascii() and r[0].strip().isdigit() and int(r[0]) < 0x110000]
    return {chr(int(r[0])): r[1] for r in rows}


#: Files of a folder, the part of Maps that each is, and how it's read.
FILES: dict[str, tuple[str, Callable]] = {
    "unicode_map.csv": ("characters", _characters),
    "html_character_map.csv": ("entities", lambda text: {r[0].strip(): r[1] for r in _pairs(text)}),
    "html_commands_map.csv": ("tags", lambda text: {r[0].strip(): (r[1], r[2]) for r in _pairs(text) if len(r) >= 3}),
    "latex_indexer.csv": ("macros", lambda text: {k.strip(): v for k, s, v in (x.partition(";") for x in _lines(text)) if s}),
}


class Transducer:
    """Replaces every longest match of the table's keys, from left to right, and every other character by what otherwise() gives; what was written isn't read again."""

    def __init__(self, table: dict[str, str], otherwise: Callable[[str], str] | None = None, others: str = ""):
        self.table, self.otherwise = {k: v for k, v in table.items() if k}, otherwise
        parts = [re.escape(k) for k in sorted(self.table, key=lambda k: (-len(k), k))]
        self.pattern = re.compile("|".join([*parts, *([others] if others else [])]) or r"(?!)", re.DOTALL)

    def __call__(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.table[m[0]] if m[0] in self.table else self.otherwise(m[0]), text)


def _escape(c: str) -> str:
    return f"\\unicode{{{ord(c)}}}"


def to_tex(maps: Maps) -> Transducer:
    r"""Characters beyond ASCII by the map; others as \unicode{N}."""
    return Transducer(maps.characters, _escape, r"[^\x00-\x7f]")


def raw_to_latex(maps: Maps) -> Transducer:
    """A dump's value as TeX: entities, characters, tags, and a bare & with its backslash."""
    table = dict(maps.characters)
    table |= {f"&{k};": v for k, v in maps.entities.items()}
    table |= {f"<{k}>": a for k, (a, _) in maps.tags.items()} | {f"</{k}>": b for k, (_, b) in maps.tags.items()}
    return Transducer(table | {"&": "\\&"}, _escape, r"[^\x00-\x7f]")


def applied(x: Column, made: Transducer, touched: str) -> Column:
    """A transducer over a column, in Arrow batches; only values that match the pattern touched go to Python, and null is ''."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(made, na_action="ignore")

    value = F.coalesce(x, F.lit(""))
    return F.coalesce(run(F.when(value.rlike(touched), value)), value)


def unicode_to_tex(x: Column, maps: Maps | None = None) -> Column:
    return applied(x, to_tex(maps or Maps()), r"[^\x00-\x7f]")


def dblp_to_latex(x: Column, maps: Maps | None = None) -> Column:
    return applied(x, raw_to_latex(maps or Maps()), r"[^\x00-\x7f]|[&<]")
