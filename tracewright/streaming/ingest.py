"""Ingest as a stream: new rows are appended once, whatever is delivered again.

There is no cursor to miscount: a batch is anti-joined with the ids already
stored, and the stream's checkpoint remembers the files it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(batch: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows of ``batch`` whose key is not stored yet, one for each key; how many went in."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    if known is not None:
        fresh = fresh.join(known, key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Start appending ``stream`` to the table at ``path``; each run takes what is there and ends."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, time: str = "ts", key: str = "id", delay: str = "1 hour") -> DataFrame:
    """Rows once per key, with state bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def activity(rows: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; late rows beyond ``delay`` are dropped when streaming."""
    source = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return source.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), by, "n", "value")


def visits(rows: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Session windows: runs of rows of a user without a gap as long as ``gap``."""
    source = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return source.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
