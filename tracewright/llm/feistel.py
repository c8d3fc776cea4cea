"""Sharding by a keyed permutation of global row numbers.

Rows get gapless global numbers in the order of ``md5(id:checksum:size)``. A generalised
Feistel network over ``[0, a) x [0, b)`` (``a * b >= n``, fewer than ``a``
spare points) permutes them; a number that lands on a spare point walks on
until it is back in range. ``shard = p % shards`` and ``slot = p // shards``,
so counts differ by at most one and any process that knows ``(n, shards,
seed)`` can compute the place of a row without the data (:func:`locate`).

The numbering never sorts the table in one task: rows fall into digest
buckets of some ``BUCKET_ROWS`` rows, bucket counts (a bounded table) give the offsets, and a window
numbers the rows inside each bucket. As the digest covers the text's checksum, an id that many rows
share is spread over the buckets too.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import back, bucket_digits, cut, ddl, hex_bucket, quoted

ROUNDS = 6
PRIME = (1 << 31) - 1
ADDED = ("size", "text_crc32", "shard", "slot")
#: Steps of a walk that are tried; a longer one raises an error (chance below n**-32).
MAX_WALK = 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int) -> int:
    """The place of row number ``x`` among ``n``; the columnar form is :func:`permuted`."""
    (a, b), keys = sides(n), round_keys(seed)
    while True:
        left, right = divmod(x, b)
        for r, key in enumerate(keys):
            add, times, then = key
            v = right if r % 2 == 0 else left
            t = (v + add) % PRIME * times % PRIME
            t = (t * t + then) % PRIME
            if r % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        x = left * b + right
        if x < n:
            return x


def locate(x: int, n: int, shards: int = 40, seed: int = 42) -> tuple[int, int]:
    """(shard, slot) of global row number ``x``."""
    p = permute(x, n, seed)
    return p % shards, p // shards


def permuted(x: Column, n: int, seed: int) -> Column:
    a, b = sides(n)
    keys = F.array(*[F.struct(F.lit(r).alias("r"), *[F.lit(k).cast("long").alias(c) for c, k in zip("ktd", key)]) for r, key in enumerate(round_keys(seed))])

    def one_round(s: Column, key: Column) -> Column:
        even = key["r"] % 2 == 0
        t = (F.when(even, s["right"]).otherwise(s["left"]) + key["k"]) % PRIME * key["t"] % PRIME
        t = (t * t + key["d"]) % PRIME
        return F.struct(
            F.when(even, (s["left"] + t) % a).otherwise(s["left"]).alias("left"),
            F.when(even, s["right"]).otherwise((s["right"] + t) % b).alias("right"),
        )

    def once(v: Column) -> Column:
        start = F.struct(((v - v % b) / b).cast("long").alias("left"), (v % b).alias("right"))
        return F.aggregate(keys, start, one_round, lambda s: s["left"] * b + s["right"])

    p = once(x)
    if spare := a * b - n:
        steps = F.sequence(F.lit(1), F.lit(min(spare, MAX_WALK)))
        p = F.aggregate(steps, p, lambda q, _: F.when(q < n, q).otherwise(once(q)))
    return F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def feistel_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``df`` with its shard and slot.

    Returns ``id_col``, size (UTF-8 bytes plus 16), text_crc32, shard, slot and
    the columns named in ``carry`` (less those named like an added one). Texts are taken whole, a null
    text counts as empty, a null id is numbered like the text "null". Repeated rows each get a slot of their own:
    rows equal in id, size and checksum stand in the order of a hash of what is carried, and rows equal in that too
    are interchangeable. An empty table gives no rows; other columns are ignored.
    """
    names = list(dict.fromkeys((id_col, *(c for c in carry if c.lower() not in ADDED))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary")).cast("long")
    key = F.concat_ws(":", F.coalesce(quoted(id_col).cast("string"), F.lit("null")), crc.cast("string"), size.cast("string"))
    hashable = [quoted(c) for c in names if not re.search("map<|variant", ddl(df, c))]
    total = df.count()
    digits = bucket_digits(total)
    rows = df.select(*[quoted(c) for c in names], size.alias("_size"), crc.alias("_crc"), F.unhex(F.md5(key)).alias("_digest"), hex_bucket(F.md5(key), digits).alias("_in"), F.xxhash64(*hashable).alias("_same"))
    rows = rows.toDF(*[f"in_{k}" for k in range(len(names))], "_size", "_crc", "_digest", "_in", "_same")
    if text_col.lower() not in {c.lower() for c in names}:
        rows = cut(rows)  # some bytes a row, so that texts are read once
    counts = cut(rows.groupBy(F.col("_in").alias("bucket")).agg(F.count("*").alias("n")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_in").orderBy("_digest", "_same")))
    # 16**digits offsets at most, one for a million rows: a proven bound, and beyond 16**4 of them joined by shuffling
    placed = numbered.join(F.broadcast(offsets) if digits <= 4 else offsets, F.col("_in") == F.col("_bucket"))
    place = permuted(F.col("_offset") + F.col("_row") - 1, max(total, 1), seed)
    return placed.withColumn("_place", place).select(
        *back(names),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 42) -> None:
    """Write every row with its shard and slot under ``path/shard=K``, in slot order within files. Input columns named like the added ones are replaced."""
    out = feistel_shards(df, id_col, text_col, shards, seed, carry=tuple(df.columns))
    files = F.floor(F.col("slot") / 100_000)
    out.repartition("shard", files).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
