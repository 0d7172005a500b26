"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.scratch import delete, discard, fresh_dir, materialize, shared_dir

__all__ = ["delete", "discard", "fresh_dir", "held_out", "hold", "materialize", "shared_dir", "table", "trim"]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose label may not be learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Registers a cache of this Python worker, and drops those of other operators.

    Workers outlive stages; without this, every stage's cache would stay in memory
    while the next ones fill theirs.  What was freed goes back to the system.
    """
    if owner not in _held:
        for other in _held.values():
            other()
        _held.clear()
        _held[owner] = drop
        trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
