"""Upkeep of the library's tables: contributors and their roles, provenance, mappings, metadata, configuration, statistics.

Every change is a new table, or a map that one join applies.  Conflicts are rows, never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.normalise import doi as normal_doi
from quire.functions.normalise import et_al, first_last, isbn_index, split_names_braced, title_hash
from quire.operators.curation import garbled
from quire.operators.graph import flatten
from quire.operators.relational import is_isbn, live_keys
from quire.operators.store import cut, spread


def _value(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


# --- contributors


def correct_name(tables: dict[str, tuple[DataFrame, str]], wrong: str, right: str) -> dict[str, DataFrame]:
    """Every table with a spelling replaced in its name column; what became equal is one row."""
    return {k: rows.withColumn(column, F.when(F.col(column) == wrong, right).otherwise(F.col(column))).distinct() for k, (rows, column) in tables.items()}


def rewrite_roles(roles: DataFrame, values: DataFrame, names: DataFrame, role: str, prefix: str = "c") -> tuple[DataFrame, DataFrame]:
    """Roles after a field's values (entry_key, value) replaced them, and the contributors (id, name) that had to be made.

    names (id, name) resolves; of several ids for a name the smallest.  Garbled names are
    kept whole in braces.  Ids of new ones follow from the name, so a run can be repeated.
    """
    listed = values.select("entry_key", F.posexplode(split_names_braced(et_al(F.col("value")))).alias("p", "name"))
    listed = listed.withColumn("name", F.when((garbled(F.col("name")) != "") & ~F.startswith("name", F.lit("{")), F.concat(F.lit("{"), F.col("name"), F.lit("}"))).otherwise(F.col("name")))
    known = names.groupBy("name").agg(F.min("id").alias("id"))
    found = listed.join(known, "name", "left")
    made = F.concat(F.lit(prefix), F.substring(F.md5("name"), 1, 12))
    fresh = found.filter("id IS NULL").select(made.alias("id"), "name").distinct()
    rows = found.select("entry_key", F.lit(role).alias("role"), (F.col("p") + 1).cast("long").alias("position"), F.coalesce("id", made).alias("contributor_id"))
    kept = roles.join(values.select("entry_key", F.lit(role).alias("role")).distinct(), ["entry_key", "role"], "left_anti")
    return kept.select("entry_key", "role", "position", "contributor_id").unionByName(rows), fresh


def reassign_by_orcid(roles: DataFrame, evidence: DataFrame, orcids: DataFrame) -> DataFrame:
    """Roles where the ORCID that an entry names (entry_key, role, position, orcid) decides the contributor, if somebody has it (orcid, contributor_id)."""
    owner = orcids.groupBy("orcid").agg(F.min("contributor_id").alias("_owner"))
    told = evidence.filter(_value(F.col("orcid")) != "").join(owner, "orcid").groupBy("entry_key", "role", "position").agg(F.min("_owner").alias("_owner"))
    out = roles.join(told, ["entry_key", "role", "position"], "left")
    return out.withColumn("contributor_id", F.coalesce("_owner", "contributor_id")).select(*roles.columns)


def map_names(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """alias, canonical after changes of the same columns: an alias moves to its new canonical name, and what pointed at the alias goes along; an empty canonical deletes."""
    new = changes.groupBy("alias").agg(F.max("canonical").alias("_new"))
    moved = aliases.join(new.select(F.col("alias").alias("canonical"), "_new"), "canonical", "left").select("alias", F.coalesce(F.nullif("_new", F.lit("")), "canonical").alias("canonical"))
    kept = moved.join(new.select("alias"), "alias", "left_anti")
    return kept.select("alias", "canonical").unionByName(new.filter("_new <> ''").select("alias", F.col("_new").alias("canonical"))).filter("alias <> canonical").distinct()


def backfill_used_names(used: DataFrame, roles: DataFrame, contributors: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Used names (entry_key, role, position, contributor_id, name_used) with rows added for every role of contributors (contributor_id) that are now ambiguous; rows that are there stay."""
    missing = roles.join(ambiguous.select("contributor_id").distinct(), "contributor_id", "left_semi").join(used, ["entry_key", "role", "position"], "left_anti")
    made = missing.join(contributors.select(F.col("id").alias("contributor_id"), F.col("name").alias("name_used")), "contributor_id")
    return used.unionByName(made.select(*used.columns))


def resolve_argument(arguments: DataFrame, contributors: DataFrame, aliases: DataFrame) -> DataFrame:
    """argument, id: taken as an id, else a canonical name, else an alias (id, name); '' if nobody has it, or several have it by the first kind that fits."""
    one = lambda rows, at: rows.groupBy("argument").agg(F.when(F.min("id") == F.max("id"), F.min("id")).otherwise("").alias("id")).withColumn("at", F.lit(at))
    by_id = one(arguments.join(contributors.select(F.col("id").alias("argument"), "id"), "argument"), 1)
    by_name = one(arguments.join(contributors.select(F.col("name").alias("argument"), "id"), "argument"), 2)
    by_alias = one(arguments.join(aliases.select(F.col("name").alias("argument"), "id"), "argument"), 3)
    best = by_id.unionByName(by_name).unionByName(by_alias).groupBy("argument").agg(F.min_by("id", "at").alias("id"))
    return arguments.join(best, "argument", "left").select("argument", F.coalesce("id", F.lit("")).alias("id"))


# --- provenance and mappings

#: How much a source counts against another; fixed values.
PRIORITIES = {"": 0, "dblp": 100}


def lineage_priority(source: Column, priorities: dict[str, int] | None = None) -> Column:
    known = F.create_map(*[F.lit(y) for p in (priorities or PRIORITIES).items() for y in p])
    return F.coalesce(F.try_element_at(known, _value(source)), F.lit(0))


def current_lineage(entries: DataFrame, lineage: DataFrame) -> DataFrame:
    """entry_key, field, value, source, edited: provenance (entry_key, field, value, source, edited) counts only while the value is the one it was given for."""
    given = lineage.select("entry_key", "field", "value", "source", "edited")
    out = entries.select("entry_key", "field", "value").join(given, ["entry_key", "field", "value"], "left")
    return out.select("entry_key", "field", "value", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("edited").cast("int"), F.lit(0)).alias("edited"))


def changed_signatures(offered: DataFrame, signatures: DataFrame) -> DataFrame:
    """entry_key, field, source, value of offers whose signature isn't the one that was stored for their source."""
    stored = signatures.select("entry_key", "field", "source", F.col("signature").alias("_old"))
    out = offered.join(stored, ["entry_key", "field", "source"], "left")
    return out.filter(~F.coalesce(F.col("_old") == F.col("value"), F.lit(False))).select("entry_key", "field", "source", "value")


def add_doi_aliases(aliases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DOI aliases (doi, entry_key) with new ones, normalised; and conflicts (doi, entry_key, kept): DOIs that another entry has aren't overwritten."""
    clean = new.select(F.lower(normal_doi(F.col("doi"))).alias("doi"), "entry_key").filter("doi <> ''").groupBy("doi").agg(F.min("entry_key").alias("entry_key"))
    known = aliases.select("doi", F.col("entry_key").alias("kept"))
    conflicts = clean.join(known, "doi").filter("entry_key <> kept").select("doi", "entry_key", "kept")
    return aliases.select("doi", "entry_key").unionByName(clean.join(known, "doi", "left_anti").select("doi", "entry_key")), conflicts


#: Properties that go along when entries are merged; fixed values.
MOVED = ["pdf_confirmed_ok", "align_volume_waived", "align_edition_waived", "align_country_waived", "url_check_date", "url_check_status", "waived_double_pdf"]


def move_metadata(metadata: DataFrame, merges: DataFrame, moved: list[str] | None = None) -> DataFrame:
    """entry_key, property, value after entries (old) were merged (new): listed properties move unless the target has them, others of the source go."""
    out = metadata.join(merges.select(F.col("old").alias("entry_key"), "new"), "entry_key", "left")
    out = out.filter(F.col("new").isNull() | F.col("property").isin(moved or MOVED))
    rows = out.select(F.coalesce("new", "entry_key").alias("entry_key"), "property", "value", F.col("new").isNotNull().alias("from"), F.col("entry_key").alias("old"))
    return rows.groupBy("entry_key", "property").agg(F.min_by("value", F.struct("from", "old")).alias("value"))


def non_doubles_of_skipped(skipped: DataFrame) -> DataFrame:
    """name1, name2 of skipped pairs of lists (mine, theirs) that can be compared place by place: of one length, the names that differ."""
    a, b = split_names_braced(F.col("mine")), split_names_braced(F.col("theirs"))
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] != z["y"])
    rows = skipped.filter(F.size(a) == F.size(b)).select(F.explode(pairs).alias("z"))
    return rows.select(F.least("z.x", "z.y").alias("name1"), F.greatest("z.x", "z.y").alias("name2")).distinct()


def set_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value after changes; an empty value deletes."""
    kept = config.join(changes.select("key"), "key", "left_anti")
    return kept.select("key", "value").unionByName(changes.filter("value <> ''").select("key", "value"))


def visible(persisted: DataFrame, transient: DataFrame, key: list[str]) -> DataFrame:
    """Persisted rows with transient ones over them; only the former are ever written."""
    return persisted.join(transient.select(*key), key, "left_anti").select(*persisted.columns).unionByName(transient.select(*persisted.columns))


# --- checks that need several tables


def mapping_winners(mappings: DataFrame, entries: DataFrame, normalise=None) -> DataFrame:
    """entry_key, field, challenger, winner, verdict of an entry's mappings.

    deleted: the entry isn't live; redundant: the challenger is the current value once
    normalised; fixed: the winner isn't the current value, which takes its place.
    Mappings of empty fields, and those that are right, aren't returned.
    """
    normal = normalise or (lambda f, v: v)
    there = live_keys(entries).distinct().withColumn("_live", F.lit(True))
    now = entries.filter("value <> ''").select("entry_key", "field", F.col("value").alias("_now"))
    rows = mappings.join(there, "entry_key", "left").join(now, ["entry_key", "field"], "left")
    verdict = (
        F.when(F.col("_live").isNull(), "deleted").when(F.col("_now").isNull(), F.lit(None).cast("string"))
        .when(normal(F.col("field"), F.col("challenger")) == F.col("_now"), "redundant").when(F.col("winner") != F.col("_now"), "fixed")
    )
    out = rows.withColumn("verdict", verdict).filter("verdict IS NOT NULL")
    return out.select("entry_key", "field", "challenger", F.when(F.col("verdict") == "fixed", F.col("_now")).otherwise(F.col("winner")).alias("winner"), "verdict")


def valid_waivers(waived: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """key of waivers that still count: of live entries that aren't aliases and have no dblp value."""
    keyed = entries.filter("field = 'dblp' AND value <> ''").select(F.col("entry_key").alias("key"))
    live = live_keys(entries).select(F.col("entry_key").alias("key"))
    return waived.select("key").distinct().join(live, "key", "left_semi").join(keyed, "key", "left_anti").join(aliases.select(F.col("alias").alias("key")), "key", "left_anti")


def address_problems(states: DataFrame, countries: DataFrame, state_countries: DataFrame) -> DataFrame:
    """state, problem: canonical states (alias, canonical) that are aliases of countries (alias) too, and those without a country (state)."""
    names = states.select(F.col("canonical").alias("state")).distinct()
    both = names.join(countries.select(F.col("alias").alias("state")), "state", "left_semi").withColumn("problem", F.lit("is a country's name too"))
    none = names.join(state_countries.select("state"), "state", "left_anti").withColumn("problem", F.lit("has no country"))
    return both.unionByName(none)


def isbn_from_doi(children: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records after the ISBN that a DOI of a book holds went to its place: children, parents, and warnings (entry_key, parent, offered, present).

    Without a crossref the entry takes it.  With one it goes to a parent that has
    none, and the child's DOI goes; a parent with another one is a warning.  Of several
    children of a parent the smallest ISBN is offered.
    """
    offered = F.regexp_replace(F.col("doi"), r"\A10\.1007/", "")
    valid = F.startswith("doi", F.lit("10.1007/978-")) & is_isbn(offered)
    alone, has = _value(F.col("crossref")) == "", _value(F.col("isbn")) != ""
    up = children.filter(valid & ~alone).groupBy("crossref").agg(F.min(offered).alias("_up"))
    old = parents.select(F.col("entry_key").alias("crossref"), _value(F.col("isbn")).alias("_present"))
    rows = children.withColumn("_key", spread("crossref", "entry_key")).join(up.join(old, "crossref").withColumnRenamed("crossref", "_key"), "_key", "left")
    moved = valid & ~alone & (F.col("_present") == "") & (offered == F.col("_up"))
    wrong = rows.filter(valid & ~alone & (F.col("_present") != "") & (isbn_index(F.col("_present")) != isbn_index(offered)))
    below = rows.withColumn("isbn", F.when(valid & alone, offered).otherwise(F.col("isbn"))).withColumn("doi", F.when(moved, "").otherwise(F.col("doi")))
    above = parents.join(up.select(F.col("crossref").alias("entry_key"), "_up"), "entry_key", "left").withColumn("isbn", F.when(~has, F.coalesce("_up", F.lit(""))).otherwise(F.col("isbn")))
    return below.select(*children.columns), above.select(*parents.columns), wrong.select("entry_key", F.col("crossref").alias("parent"), offered.alias("offered"), F.col("_present").alias("present"))


#: What a type refers to; fixed values.
PARENT_TYPES = {"inproceedings": "proceedings", "incollection": "book", "inbook": "book"}


def split_bookish(records: DataFrame, prefix: str = "parent-") -> tuple[DataFrame, DataFrame]:
    """Records that name a book and refer to none get a crossref, and the parents (entry_key, entrytype, title, booktitle) that had to be made.

    A bookish record of that type and title takes the part; of several the smallest.
    Equal titles get one parent, whose key follows from type and title.
    """
    kinds = F.create_map(*[F.lit(y) for p in PARENT_TYPES.items() for y in p])
    kind = F.try_element_at(kinds, F.col("entrytype"))
    needs = (_value(F.col("crossref")) == "") & (_value(F.col("booktitle")) != "") & kind.isNotNull()
    index = title_hash(F.col("booktitle"))
    there = records.filter(F.col("entrytype").isin(*PARENT_TYPES.values())).groupBy(F.col("entrytype").alias("_kind"), title_hash(F.col("title")).alias("_index")).agg(F.min("entry_key").alias("_there"))
    rows = records.withColumn("_kind", F.when(needs, kind)).withColumn("_index", F.when(needs, index)).join(there, ["_kind", "_index"], "left")
    made = F.concat(F.lit(prefix), F.md5(F.concat_ws("|", "_kind", "_index")))
    out = rows.withColumn("crossref", F.when(needs, F.coalesce("_there", made)).otherwise(F.col("crossref")))
    new = rows.filter(needs & F.col("_there").isNull()).groupBy(made.alias("entry_key"), F.col("_kind").alias("entrytype")).agg(F.min("booktitle").alias("title"))
    return out.select(*records.columns), new.select("entry_key", "entrytype", "title", F.col("title").alias("booktitle"))


def aligned_title(title: Column, volume: Column, countries: dict[str, str] | None = None) -> Column:
    """A title without the volume that its record names, and with country names in their canonical form after a comma."""
    named = F.concat(F.lit(r"(?i)[,:;]?\s*\bvol(?:ume|\.)?\s+"), volume, F.lit(r"\b\.?"))
    out = F.when(_value(volume).rlike(r"\A[0-9IVXLC]+\z"), F.regexp_replace(title, named, "")).otherwise(title)
    for alias, canonical in (countries or {}).items():
        out = F.regexp_replace(out, rf"(?<=, ){alias}(?=\z|,)", canonical)
    return F.trim(out)


# --- statistics


def library_statistics(t: dict[str, DataFrame]) -> DataFrame:
    """metric, value: the 21 numbers of a library, as text.

    t: entries (entry_key, field, value), groups (group_name), files, contributors (id, name), names,
    used (name_used, contributor_id), field_mappings (source_field, target_field), superseded (field,
    triage_status), parents, waived, oldies, hints, non_double_entries, non_double_contributors,
    non_double_names, flags.  Every table is aggregated alone; the union has 21 rows.
    """
    one = lambda rows, name, value=None: rows.agg((F.count("*") if value is None else value).cast("long").alias("n")).select(F.lit(name).alias("metric"), F.col("n").cast("string").alias("value"))
    keyed = t["entries"].filter("field IN ('entrytype', 'dblp') AND value <> ''").groupBy("entry_key").agg(F.max((F.col("field") == "entrytype").cast("int")).alias("live"), F.max((F.col("field") == "dblp").cast("int")).alias("dblp"))
    live, linked = F.coalesce(F.sum("live"), F.lit(0)), F.coalesce(F.sum(F.col("live") * F.col("dblp")), F.lit(0))
    aliased = t["used"].join(t["contributors"].select(F.col("id").alias("contributor_id"), "name"), "contributor_id").filter("name_used <> name")
    same = F.col("source_field") == F.col("target_field")
    people = F.col("field").isin("author", "editor") & F.col("triage_status").isNull()
    percent = keyed.agg(F.when(live > 0, F.round(100.0 * linked / live)).otherwise(0.0).alias("n")).select(F.lit("dblp coverage").alias("metric"), F.concat(F.col("n").cast("long").cast("string"), F.lit("%")).alias("value"))
    rows = [
        one(keyed, "entries", live), one(t["groups"], "groups", F.count_distinct("group_name")), one(t["files"], "pdf files"), one(t["contributors"], "contributors"), one(t["names"], "contributor forms"),
        one(t["used"], "name spellings", F.count_distinct("name_used")), one(aliased, "aliases in entries"), one(t["field_mappings"], "mappings within a field", F.count_if(same)), one(t["field_mappings"], "mappings across fields", F.count_if(~same)),
        one(t["superseded"], "losing values"), one(t["superseded"], "losing values to triage", F.count_if(people)), percent, one(keyed, "dblp links", linked),
        one(t["parents"], "crossref overrides"), one(t["waived"], "waived children"), one(t["oldies"], "old keys"), one(t["hints"], "key hints"), one(t["non_double_entries"], "different entries"),
        one(t["non_double_contributors"], "different contributors"), one(t["non_double_names"], "different names"), one(t["flags"], "entry flags"),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def session_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """metric, change of numbers (metric, value) that differ between two snapshots, with their sign."""
    both = before.select("metric", F.col("value").try_cast("long").alias("a")).join(now.select("metric", F.col("value").try_cast("long").alias("b")), "metric")
    change = F.col("b") - F.col("a")
    return both.filter(change != 0).select("metric", F.concat(F.when(change > 0, "+").otherwise(""), change.cast("string")).alias("change"))


def newer_first(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows whose version is above that of the last checkpoint (key, version, done): what has to be made again."""
    return rows.filter(F.coalesce(F.col(version) > F.col("done"), F.lit(True))).select(key, version)


def drain(start: DataFrame, process, key: str) -> DataFrame:
    """Processes rows and then the rows that this added, until none is new: each key once.  process gives a round's new rows, of the same columns."""
    done = cut(start)
    front = done
    while not front.isEmpty():
        made = process(front).dropDuplicates([key])
        front = cut(made.join(done.select(key), key, "left_anti").select(*start.columns))
        done = cut(done.unionByName(front))
    return done


def cycle_paths(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, path of the cycles of single targets: a row for each cycle of any length, from its smallest node on, as text.

    Of several targets of a node the smallest counts.  List ranking by pointer doubling,
    in as many rounds as the logarithm of the nodes that don't end: doubled as often, what
    they lead to are the nodes of cycles, each of which has met the smallest of its own; then the
    cycles are cut there, and doubling again counts each node's steps to the end.
    """
    step = edges.filter(F.col(source) != F.col(target)).groupBy(F.col(source).alias("at")).agg(F.min(target).alias("to"))
    step = cut(step.join(flatten(edges, source, target).select(F.col(source).alias("at")), "at", "left_anti"))
    rounds = step.count().bit_length()
    now = step.withColumn("low", F.col("at"))  # low: the smallest of the nodes passed
    for _ in range(rounds):
        now = cut(now.join(now.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low")), "to").select("at", F.col("_to").alias("to"), F.least("low", "_low").alias("low")))
    ring = step.join(now.select(F.col("to").alias("at")).distinct(), "at", "left_semi").join(now.select("at", "low"), "at")
    last = F.col("to") == F.col("low")
    rank = cut(ring.select("at", "low", F.when(~last, F.col("to")).alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("left")))
    for _ in range(rounds):
        further = rank.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        rank = cut(rank.join(further, "next", "left").select("at", "low", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    nodes = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("p"), "at"))), lambda x: x["at"].cast("string"))
    found = rank.groupBy(F.col("low").alias("node")).agg(F.array_join(nodes, " ").alias("path"))
    return found.unionByName(edges.filter(F.col(source) == F.col(target)).select(F.col(source).alias("node"), F.col(source).cast("string").alias("path")).distinct())


def author_breakdown(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """key, position, mine, theirs, decision of lists of names (key, mine, theirs) of one length, place by place.

    same: equal, or one in the other order; orcid: both names belong to one contributor
    of known (name, id); ask: neither.
    """
    a, b = split_names_braced(F.col("mine")), split_names_braced(F.col("theirs"))
    rows = pairs.filter(F.size(a) == F.size(b)).select("key", F.posexplode(F.arrays_zip(a.alias("x"), b.alias("y"))).alias("p", "z"))
    rows = rows.select("key", (F.col("p") + 1).cast("long").alias("position"), F.col("z.x").alias("mine"), F.col("z.y").alias("theirs"))
    ids = known.groupBy("name").agg(F.when(F.min("id") == F.max("id"), F.min("id")).alias("id"))
    rows = rows.join(ids.select(F.col("name").alias("mine"), F.col("id").alias("_a")), "mine", "left").join(ids.select(F.col("name").alias("theirs"), F.col("id").alias("_b")), "theirs", "left")
    same = (F.col("mine") == F.col("theirs")) | (first_last(F.col("mine")) == first_last(F.col("theirs")))
    decision = F.when(same, "same").when(F.col("_a") == F.col("_b"), "orcid").otherwise("ask")
    return rows.select("key", "position", "mine", "theirs", decision.alias("decision"))


def first_position(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds place, from 1, within each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
