"""The engine's relations, derived from the driver's tables.

Adapters are projections of scans, so filters and column pruning reach the Parquet reader.  SQL holds the same relations for DuckDB, as common table expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines that a task sums up to roles.
LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_key, field, value: publications, from part.  Entries without a type aren't live.

    A union of one projection for each field: a filter on the field removes the other
    branches when the plan is made, and a scan reads the columns of those that stay.
    """
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    one = lambda rows, field, value: rows.select(key.cast("string").alias("entry_key"), F.lit(field).alias("field"), value.alias("value"))
    parts = [
        one(part, "title", F.col("p_name")),
        one(part.filter(key % 3 != 0), "dblp", F.col("p_brand")),
        one(part.filter(key % 7 != 0), "entrytype", F.lower("p_type")),
        one(part, "year", (F.col("p_size") + 1980).cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_key, role, position, contributor_id: from lineitem, one contributor for each position.

    Nearly every line is a role of its own, so lines are dealt by entry before they're summed up, over
    as many tasks as follow from their number: a task's memory doesn't grow with the
    input, and what is done by entry after that needs no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey")
    rows = lines.repartition(lines.count() // LINES + 1, "l_orderkey").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.min("l_suppkey").alias("contributor_id"))
    return rows.select(F.col("l_orderkey").alias("entry_key"), F.col("l_returnflag").alias("role"), F.col("l_linenumber").cast("long").alias("position"), "contributor_id")


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_name, entry_key: orders in the segment of their customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_key"), F.col("o_custkey").alias("c_custkey"))
    return orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("group_name")), "c_custkey").select("group_name", "entry_key")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias, canonical: each part stands for the one of half its number."""
    part = table(spark, sf_dir, "part").filter("p_partkey > 1")
    return part.select(F.col("p_partkey").cast("long").alias("alias"), F.expr("p_partkey div 2").cast("long").alias("canonical"))


SQL = {
    "e": """e AS (
        SELECT CAST(p_partkey AS VARCHAR) AS entry_key, 'title' AS field, p_name AS value FROM part
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'dblp', p_brand FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'entrytype', lower(p_type) FROM part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'year', CAST(p_size + 1980 AS VARCHAR) FROM part)""",
    "r": """r AS (
        SELECT l_orderkey AS entry_key, l_returnflag AS role, CAST(l_linenumber AS BIGINT) AS position, min(l_suppkey) AS contributor_id
        FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linenumber)""",
    "c": "c AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)",
    "g": "g AS (SELECT c_mktsegment AS group_name, o_orderkey AS entry_key FROM orders JOIN customer ON o_custkey = c_custkey)",
    "a": "a AS (SELECT CAST(p_partkey AS BIGINT) AS alias, CAST(p_partkey // 2 AS BIGINT) AS canonical FROM part WHERE p_partkey > 1)",
}


def with_sql(names: str, query: str, more: str = "", recursive: bool = False) -> str:
    """A DuckDB query over the named relations and further common table expressions."""
    parts = [*(SQL[n] for n in names.split()), *([more] if more else [])]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + query if parts else query
