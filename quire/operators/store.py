"""Tables as immutable snapshots.  Changes are expressed as the old rows that stay and the new ones; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.scratch import materialize


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder that the cluster shares and reads it back, which ends its lineage."""
    return materialize(df, "cut")


def spread(key: Column | str, row: Column | str) -> Column:
    """A join key under which empty and null keys have no partner: each gets a value of its own from row, so that they go to all tasks and not to one."""
    key, row = (F.col(x) if isinstance(x, str) else x for x in (key, row))
    return F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit("\0"), F.xxhash64(row).cast("string"))).otherwise(key)


def upsert(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Changed rows replace old ones of the same key; changes have one row for each key."""
    return old.join(changes, key, "left_anti").select(*changes.columns).unionByName(changes)


def insert_new(old: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is taken are ignored."""
    return old.unionByName(rows.join(old, key, "left_anti").select(*old.columns))


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys, key, "left_anti").select(*old.columns)


def coalesce_upsert(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Like upsert, but an empty new value keeps the old one."""
    rest = [c for c in old.columns if c not in key]
    joined = old.alias("o").join(changes.alias("n"), key, "full")
    filled = lambda x: F.when(x.cast("string") != "", x)
    return joined.select(*key, *[F.coalesce(filled(F.col(f"n.{c}")), F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in rest])


def correlated_update(rows: DataFrame, source: DataFrame, key: list[str], column: str) -> DataFrame:
    """column is taken from source where it has the key, and stays elsewhere."""
    new = source.select(*key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def set_where(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Rows whose column would change, with the new value: what a column-wise update writes."""
    return rows.withColumn("_new", value).filter(~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


def propagate(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rewrites ids by a map (old, new) after merges; one join for each table."""
    return rows.join(ids.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).select(*rows.columns)


def latest(events: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The last row of each key by version, with one row for each key from every task: a window would bring a key's rows together."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("x")).select(key, "x.*").select(*events.columns)


def changed(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of new whose key is new or whose version differs from the manifest's."""
    known = old.select(F.col(key), F.col(version).alias("_old"))
    return new.join(known, key, "left").filter(~F.col("_old").eqNullSafe(F.col(version))).select(*new.columns)


def vanished(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of old that new doesn't have."""
    return old.select(key).distinct().join(new, key, "left_anti")


def three_way(base: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, status of a table that changed on both sides since base.

    unchanged, left-changed, right-changed, both, same-change, new-left, new-right, new-both, deleted-left, deleted-right, deleted-both.
    """
    pick = lambda df, n: df.select(F.col(key), F.struct(F.col(value).alias("v")).alias(n))
    rows = pick(base, "b").join(pick(left, "l"), key, "full").join(pick(right, "r"), key, "full")
    b, x, y = (F.col(c) for c in "blr")
    same = lambda p, q: p["v"].eqNullSafe(q["v"])
    status = (
        F.when(b.isNull(), F.when(y.isNull(), "new-left").when(x.isNull(), "new-right").otherwise("new-both"))
        .when(x.isNull(), F.when(y.isNull(), "deleted-both").otherwise("deleted-left"))
        .when(y.isNull(), "deleted-right")
        .when(same(x, y), F.when(same(b, x), "unchanged").otherwise("same-change"))
        .when(same(b, x), "right-changed")
        .when(same(b, y), "left-changed")
        .otherwise("both")
    )
    return rows.select(key, status.alias("status"))


def merge_memberships(bib: DataFrame, db: DataFrame, snapshot: DataFrame, key: list[str]) -> DataFrame:
    """key, action for memberships that differ: add-to-db, remove-from-db, add-to-bib or remove-from-bib."""
    flag = lambda df, n: df.select(*key).distinct().withColumn(n, F.lit(True))
    rows = flag(bib, "b").join(flag(db, "d"), key, "full").join(flag(snapshot, "s"), key, "full")
    b, d, s = (F.coalesce(F.col(c), F.lit(False)) for c in "bds")
    action = F.when(b & ~d, F.when(s, "remove-from-bib").otherwise("add-to-db")).when(~b & d, F.when(s, "remove-from-db").otherwise("add-to-bib"))
    return rows.withColumn("action", action).filter("action IS NOT NULL").select(*key, "action")
