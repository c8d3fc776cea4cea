"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut, use_checkpoints

#: A word: a maximal run of code points other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table (rows) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` stored, and marked for broadcast only if its counted rows are within ``limit``."""
    stored = cut(df)
    return F.broadcast(stored) if stored.count() <= limit else stored


def apart(df: DataFrame, **more: Column) -> DataFrame:
    """The columns of ``df`` named by their places (in_0, in_1, ...), and ``more``: no name of an operator can clash with one of ``df``."""
    return df.select("*", *more.values()).toDF(*[f"in_{k}" for k in range(len(df.columns))], *more)


def back(columns: list[str], without: Iterable[str] = ()) -> list[Column]:
    """What :func:`apart` renamed, under its names again, less the columns that an operator adds (whatever their case)."""
    added = {c.lower() for c in without}
    return [F.col(f"in_{k}").alias(c) for k, c in enumerate(columns) if c.lower() not in added]


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ddl(df: DataFrame, name: str) -> str:
    """A column's type as text, for the schema of a Python function."""
    return next(f.dataType.simpleString() for f in df.schema if f.name.lower() == name.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_bucket(digest: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of a digest, as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


#: Rows that a digest bucket is meant to hold.
BUCKET_ROWS = 1_000_000


def bucket_digits(rows: int) -> int:
    """Hex digits (3 at least) that cut ``rows`` rows into buckets of some ``BUCKET_ROWS``."""
    return max(3, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)))


_HELD: dict[object, object] = {}


def held(owner: object, make: Callable[[], object]) -> object:
    """The tables that a Python worker keeps for an operator from task to task.

    Workers outlive stages, so what another operator left goes first, back to the machine: a worker
    holds the tables of one operator at a time.
    """
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others do without
        if trim is not None:
            trim(0)
        _HELD[owner] = make()
    return _HELD[owner]


__all__ = ["BROADCAST_ROWS", "WORD", "apart", "back", "bucket_digits", "cut", "ddl", "held", "hex_bucket", "quoted", "small_side", "use_checkpoints", "word_count"]
