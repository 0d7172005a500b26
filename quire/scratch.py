"""Intermediate tables in the folder that driver and executors share.

Writing a table and reading it back cuts the lineage, and what was written survives a
lost executor.  Tables are deleted by discard(), and what's left of a process's when it ends with
its session still running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where that's unset in a local session (as in tests) a temporary folder of
    this machine is made, once per process; on a cluster executors couldn't share that.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        root = _OWN["dir"]
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """The path of a folder that doesn't exist yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.unregister(_clear)
        atexit.register(_clear)  # after the session's own, so that it runs before them
    _MADE[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; the result's attribute path says where."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def delete(path: str) -> None:
    """Deletes a folder that fresh_dir() named, if it's still there."""
    spark = _MADE.pop(path, None)
    if spark is not None:
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables that materialize() wrote and that no result is read from any more."""
    for df in frames:
        if df is not None:
            delete(df.path)


def _clear() -> None:
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is not None:
            delete(path)
