"""Synchronisation of a file with the library: a plan of decisions, and its two phases.

Phase one takes what the file brings into the library, phase two writes the file and
the snapshot that the next run compares with.  Decisions are rows with a state, so a
person's answers are rows too; every step's result is a table in the run's folder, and a
run that was interrupted goes on with the steps that aren't there.

Modes: subset (both ways), pull (the file becomes the library's entries of a scope), follow (the
file's entries become the library's), harvest (what's new in the file goes to the library).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.normalise import fingerprint
from quire.operators.store import delete, upsert

MODES = ("subset", "pull", "follow", "harvest")
#: Decisions: states of a plan's rows.
READY, REVIEW = "ready", "needs-review"


def matched(source: DataFrame, snapshot: DataFrame, aliases: DataFrame) -> DataFrame:
    """output_key, entry_key of a file's entries (entry_key): by the snapshot's output keys, else by the aliases (alias, canonical), else as they are.

    A snapshot's key that has become an alias since then counts as what it stands for.
    """
    end = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    known = snapshot.groupBy("output_key").agg(F.min("entry_key").alias("_known"))
    rows = source.select(F.col("entry_key").alias("output_key")).distinct().join(known, "output_key", "left")
    rows = rows.withColumn("alias", F.coalesce("_known", "output_key")).join(end, "alias", "left")
    return rows.select("output_key", F.coalesce("canonical", "alias").alias("entry_key"))


def statuses(source: DataFrame, library: DataFrame, snapshot: DataFrame, scope: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """entry_key, status of every entry of the file, the library's scope and the snapshot, each (entry_key, fingerprint); scope has entry_key.

    unchanged, source-changed, library-changed, both-changed (and differ), new-in-source, new-in-library,
    deleted-in-source, deleted-in-library, out-of-scope (the library has it, the scope no longer), gone (on neither side).
    deleted (entry_key): entries that were deleted from the library on purpose, which aren't new.
    """
    pick = lambda df, n: df.groupBy("entry_key").agg(F.struct(F.min("fingerprint").alias("v")).alias(n))
    flag = lambda df, n: df.select("entry_key").distinct().withColumn(n, F.lit(True))
    rows = pick(source, "x").join(pick(library, "y"), "entry_key", "full").join(pick(snapshot, "b"), "entry_key", "full").join(flag(scope, "inside"), "entry_key", "left")
    rows = rows.join(flag(deleted, "buried"), "entry_key", "left") if deleted is not None else rows.withColumn("buried", F.lit(None).cast("boolean"))
    x, y, b = (F.col(n) for n in "xyb")
    inside = F.coalesce("inside", F.lit(False))
    same = lambda p, q: p["v"].eqNullSafe(q["v"])
    status = (
        F.when(y.isNull(), F.when(x.isNull(), "gone").when(b.isNotNull() | F.coalesce("buried", F.lit(False)), "deleted-in-library").otherwise("new-in-source"))
        .when(x.isNull(), F.when(~inside, "out-of-scope").when(b.isNull(), "new-in-library").otherwise("deleted-in-source"))
        .when(same(x, y), "unchanged")
        .when(b.isNull(), "both-changed")
        .when(same(b, y), "source-changed")
        .when(same(b, x), "library-changed")
        .otherwise("both-changed")
    )
    return rows.select("entry_key", status.alias("status"))


#: What each mode does with each status: take (file to library), write (library to file), remove (from the library), drop (from the file), keep, and what a person is asked, with what a trusted file gets.
_ACTIONS = {
    "subset": {"unchanged": "keep", "source-changed": "take", "library-changed": "write", "both-changed": "write?take", "new-in-source": "take", "new-in-library": "write", "deleted-in-source": "write?remove", "deleted-in-library": "drop", "out-of-scope": "drop", "gone": "drop"},
    "pull": {"new-in-source": "drop", "deleted-in-library": "drop", "out-of-scope": "drop", "gone": "drop", "unchanged": "keep"},
    "follow": {"new-in-source": "keep", "new-in-library": "drop", "deleted-in-source": "drop", "deleted-in-library": "drop", "out-of-scope": "drop", "gone": "drop", "unchanged": "keep"},
    "harvest": {"new-in-source": "take"},
}
_OTHERWISE = {"pull": "write", "follow": "write", "harvest": "keep"}


def plan(mode: str, source: DataFrame, library: DataFrame, snapshot: DataFrame, scope: DataFrame, deleted: DataFrame | None = None, trusted: bool = False) -> DataFrame:
    """entry_key, status, action, state.  Where both sides have a say, a file that isn't trusted leaves the action that loses nothing, for review."""
    if mode not in MODES:
        raise ValueError(f"{mode!r} is none of {MODES}")
    rows = statuses(source, library, snapshot, scope, deleted)
    action, state = F.lit(_OTHERWISE.get(mode, "keep")), F.lit(READY)
    for status, what in _ACTIONS[mode].items():
        careful, asked, sure = what.partition("?")
        here = F.col("status") == status
        action = F.when(here, sure if asked and trusted else careful).otherwise(action)
        state = F.when(here, REVIEW if asked and not trusted else READY).otherwise(state)
    return rows.select("entry_key", "status", action.alias("action"), state.alias("state"))


def decided(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The plan with a person's answers (entry_key, action): rows that wait for review get them."""
    told = answers.groupBy("entry_key").agg(F.min("action").alias("_answer"))
    waits = (F.col("state") == REVIEW) & F.col("_answer").isNotNull()
    joined = rows.join(told, "entry_key", "left")
    return joined.select("entry_key", "status", F.when(waits, F.col("_answer")).otherwise(F.col("action")).alias("action"), F.when(waits, READY).otherwise(F.col("state")).alias("state"))


def taken(library: DataFrame, source: DataFrame, rows: DataFrame) -> DataFrame:
    """Phase one: the library's entries (entry_key, field, value) after the plan's ready rows.  An entry that's taken is as the file has it; its other fields go."""
    ready = rows.filter(F.col("state") == READY)
    changed = ready.filter("action IN ('take', 'remove')").select("entry_key")
    kept = delete(library, changed, ["entry_key"])
    new = source.join(ready.filter("action = 'take'").select("entry_key"), "entry_key", "left_semi")
    return kept.unionByName(new.select("entry_key", "field", "value"))


def written(library: DataFrame, source: DataFrame, rows: DataFrame) -> DataFrame:
    """Phase two: the file's entries, from the library after phase one where it has them; what waits for review stays as the file has it."""
    ready = rows.filter(F.col("state") == READY)
    out = ready.filter("action IN ('write', 'take', 'keep')").select("entry_key")
    waiting = rows.filter(F.col("state") == REVIEW).select("entry_key")
    ours = library.join(out, "entry_key", "left_semi")
    alone = source.join(out.join(library.select("entry_key").distinct(), "entry_key", "left_anti").unionByName(waiting), "entry_key", "left_semi")
    return ours.select("entry_key", "field", "value").unionByName(alone.select("entry_key", "field", "value"))


def next_snapshot(snapshot: DataFrame, library: DataFrame, file: DataFrame, rows: DataFrame) -> DataFrame:
    """entry_key, fingerprint that the next run compares with: the written entries' that the library has, and as before of what waits for review."""
    waiting = rows.filter(F.col("state") == REVIEW).select("entry_key")
    now = fingerprint(file.join(library.select("entry_key").distinct(), "entry_key", "left_semi").join(waiting, "entry_key", "left_anti"))
    return now.select("entry_key", "fingerprint").unionByName(snapshot.join(waiting, "entry_key", "left_semi").select("entry_key", "fingerprint"))


class Run:
    """A synchronisation in a folder.  Each step is made once and read ever after, so what was decided on isn't decided again from tables that have changed meanwhile."""

    STEPS = ("plan", "decided", "library", "file", "snapshot")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def has(self, step: str) -> bool:
        """Whether a step was finished: its marker is written last."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{step}/_SUCCESS")
        return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.has(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")  # what an interrupted run left goes
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def go(self, mode: str, source: DataFrame, library: DataFrame, snapshot: DataFrame, scope: DataFrame, answers: DataFrame | None = None, deleted: DataFrame | None = None, trusted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """plan, library, file and snapshot after a run; source and library are (entry_key, field, value), snapshot is (entry_key, fingerprint).

        Once the plan is there, a run with answers goes on from it.
        """
        mark = lambda df: fingerprint(df).select("entry_key", "fingerprint")
        asked = self.step("plan", lambda: plan(mode, mark(source), mark(library), snapshot, scope, deleted, trusted))
        rows = self.step("decided", lambda: asked if answers is None else decided(asked, answers))
        ours = self.step("library", lambda: taken(library, source, rows))
        file = self.step("file", lambda: written(ours, source, rows))
        return rows, ours, file, self.step("snapshot", lambda: next_snapshot(snapshot, ours, file, rows))


def with_status(statuses_: DataFrame, changes: DataFrame) -> DataFrame:
    """The store of what was decided on a source's entries (source_key, status, fingerprint) after changes: one row for each key."""
    return upsert(statuses_, changes.select(*statuses_.columns), ["source_key"])


def still_waiting(source: DataFrame, statuses_: DataFrame) -> DataFrame:
    """Entries of a source (source_key, fingerprint) that weren't skipped or ignored with this very content."""
    past = statuses_.filter(F.col("status").isin("skip-content", "ignored")).select("source_key", "fingerprint")
    return source.join(past, ["source_key", "fingerprint"], "left_anti")
