"""The rule language and the selection language, compiled to column expressions.

Rules, one per line ('#' begins a comment):

    define <set> <word> <word> ...
    if <condition> then <action> [else if <condition> then <action> ...] [else <action>]

Conditions: ``type = x``, ``field <f> = "x"``, ``field <f> in <set>``, ``field <f> is empty``,
``field <f> < 5`` (also > <= >= for whole numbers), ``field <f> includes "x"``, ``in group "g"``, ``groups in <set>``, ``groups
several in <set>``, each with ``not`` before it, joined by ``and``.  Of the branches of a rule the first whose condition holds applies.  Actions: ``add group "g"``, ``remove group "g"``, ``warn "text"``.

Selections, one per line: ``group "glob"``, ``type "x"``, ``field "f" "text"``, ``key "k"``,
``name "n"``, ``orcid "o"``, ``contributor "id"``, ``has_pdf``, ``warnings``, ``watched``, ``dblp_waived``; the result is their union.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.relational import find_by_field, find_by_glob

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|(<=|>=|[=<>])|([^\s"=<>]+)')


def tokens(line: str) -> list[tuple[str, bool]]:
    """(text, quoted) of each word of a line, up to a comment."""
    out = []
    for m in _TOKEN.finditer(re.sub(r'#(?=(?:[^"]*"[^"]*")*[^"]*$).*', "", line)):
        quoted = m.group(1) is not None
        out.append((re.sub(r"\\(.)", r"\1", m.group(1)) if quoted else m.group(2) or m.group(3), quoted))
    return out


class RuleError(ValueError):
    pass


def _condition(words: list[tuple[str, bool]], sets: dict[str, list[str]], groups: Column) -> Column:
    text = [w for w, _ in words]
    if text[:1] == ["not"]:
        return ~_condition(words[1:], sets, groups)
    field = lambda f: F.coalesce(F.col("fields")[f], F.lit(""))
    match text:
        case ["type", "=", value]:
            return field("entrytype") == value
        case ["in", "group", name]:
            return F.array_contains(groups, name)
        case ["field", f, "is", "empty"]:
            return field(f) == ""
        case ["field", f, "includes", value]:
            return F.contains(field(f), F.lit(value))
        case ["groups", "in", name] if name in sets:
            return F.arrays_overlap(groups, F.array(*map(F.lit, sets[name])))
        case ["groups", "several", "in", name] if name in sets:
            return F.size(F.array_intersect(groups, F.array(*map(F.lit, sets[name])))) > 1
        case ["field", f, "=", value]:
            return field(f) == value
        case ["field", f, "in", name] if name in sets:
            return field(f).isin(*sets[name])
        case ["field", f, ("<" | ">" | "<=" | ">=") as op, value] if re.fullmatch(r"[+-]?\d+", value):
            number = F.when(field(f).rlike(r"\A[+-]?[0-9]+\z"), field(f).try_cast("int"))
            return F.coalesce({"<": number < int(value), ">": number > int(value), "<=": number <= int(value), ">=": number >= int(value)}[op], F.lit(False))
    raise RuleError(f"not a condition: {' '.join(text)}")


def _split(words: list[tuple[str, bool]], at: str) -> list[list[tuple[str, bool]]]:
    out: list[list[tuple[str, bool]]] = [[]]
    for w in words:
        if w == (at, False):
            out.append([])
        else:
            out[-1].append(w)
    return out


def _branches(words: list[tuple[str, bool]], line: str) -> list[tuple[list[tuple[str, bool]] | None, list[tuple[str, bool]]]]:
    """(condition, action) of 'condition then action [else if condition then action ...] [else action]'; the last condition may be None."""
    out, rest = [], words
    while rest:
        if ("then", False) not in rest:
            raise RuleError(f"no 'then': {line}")
        at = rest.index(("then", False))
        head, rest = rest[:at], rest[at + 1 :]
        end = rest.index(("else", False)) if ("else", False) in rest else len(rest)
        if ("then", False) in rest[:end]:
            raise RuleError(f"not one 'then': {line}")
        out.append((head, rest[:end]))
        rest = rest[end + 1 :]
        if rest[:1] == [("if", False)]:
            rest = rest[1:]
        elif rest:
            if ("then", False) in rest or ("else", False) in rest:
                raise RuleError(f"something follows the last 'else': {line}")
            out.append((None, rest))
            break
    return out


def apply_rules(records: DataFrame, script: str) -> DataFrame:
    """records: entry_key, fields (map), groups (array).  Returns entry_key, groups and warnings after all rules.

    Rules are folded from first to last, so what one does to the groups is seen by the next.
    """
    sets: dict[str, list[str]] = {}
    groups, warnings = F.col("groups"), F.array().cast("array<string>")
    out = records
    for line in script.splitlines():
        words = tokens(line)
        if not words:
            continue
        if words[0] == ("define", False):
            sets[words[1][0]] = [w for w, _ in words[2:]]
            continue
        if words[0] != ("if", False):
            raise RuleError(f"not a rule: {line}")
        # conditions see the groups as they are before the rule; of its branches one applies at most
        before, old = F.lit(False), groups
        for head, action in _branches(words[1:], line):
            when = ~before
            for part in _split(head, "and") if head is not None else []:
                when = when & _condition(part, sets, old)
            before = before | when
            match [w for w, _ in action]:
                case ["add", "group", name]:
                    groups = F.when(when, F.array_union(old, F.array(F.lit(name)))).otherwise(groups)
                case ["remove", "group", name]:
                    groups = F.when(when, F.array_remove(old, name)).otherwise(groups)
                case ["warn", text]:
                    warnings = F.when(when, F.concat(warnings, F.array(F.lit(text)))).otherwise(warnings)
                case _:
                    raise RuleError(f"not an action: {line}")
        # each rule is a projection of its own, or expressions would double with every rule
        out = out.select("entry_key", "fields", groups.alias("groups"), warnings.alias("warnings"))
        groups, warnings = F.col("groups"), F.col("warnings")
    return out.select("entry_key", F.array_sort(groups).alias("groups"), warnings.alias("warnings"))


def select(script: str, entries: DataFrame, groups: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """entry_key of everything that a selection names, each once.

    tables, for what needs them: roles (entry_key, contributor_id), contributors (id, name, orcid), names (id,
    name), files, warnings, watched and waived (entry_key).
    """
    t = tables or {}

    def entries_of(people: DataFrame) -> DataFrame:
        return t["roles"].join(people.select(F.col("id").alias("contributor_id")).distinct(), "contributor_id", "left_semi").select(F.col("entry_key").cast("string"))

    parts: list[DataFrame] = []
    for line in script.splitlines():
        words = [w for w, _ in tokens(line)]
        match words:
            case []:
                continue
            case ["group" | "groups", *patterns]:
                parts += [find_by_glob(groups, p).select(F.col("entry_key").cast("string")) for p in patterns]
            case ["type", *kinds]:
                parts.append(entries.filter((F.col("field") == "entrytype") & F.col("value").isin(*kinds)).select("entry_key"))
            case ["field", name, text]:
                parts.append(find_by_field(entries, name, text).select("entry_key"))
            case ["key", *keys]:
                parts.append(entries.filter(F.col("entry_key").isin(*keys)).select("entry_key"))
            case ["name", *names]:
                both = t["contributors"].select("id", "name")
                parts.append(entries_of((both.unionByName(t["names"].select("id", "name")) if "names" in t else both).filter(F.col("name").isin(*names))))
            case ["orcid", *orcids]:
                parts.append(entries_of(t["contributors"].filter(F.col("orcid").isin(*orcids))))
            case ["contributor", *ids]:
                parts.append(entries_of(t["contributors"].filter(F.col("id").cast("string").isin(*ids))))
            case ["has_pdf"]:
                parts.append(t["files"].select(F.col("entry_key").cast("string")))
            case ["warnings"]:
                parts.append(t["warnings"].select(F.col("entry_key").cast("string")))
            case ["watched"]:
                parts.append(t["watched"].select(F.col("entry_key").cast("string")))
            case ["dblp_waived"]:
                parts.append(t["waived"].select(F.col("entry_key").cast("string")))
            case _:
                raise RuleError(f"not a selection: {line}")
    if not parts:
        return entries.select("entry_key").limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def with_parents(keys: DataFrame, crossref: DataFrame) -> DataFrame:
    """keys and the parents (entry_key, parent) of those selected."""
    parents = crossref.join(keys, "entry_key", "left_semi").select(F.col("parent").alias("entry_key"))
    return keys.unionByName(parents).distinct()
