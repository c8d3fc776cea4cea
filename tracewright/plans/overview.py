"""Analyzers that ask a model: classes of requests, classes of turns, overviews of sessions.

Each builds prompts as columns, sends them through the seam and reads the answers
back as columns; what is asked about is decided by plain operators before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import digest
from tracewright.plans.callers import Caller, answers, stub

REQUESTS, REQUEST_CHARS = 300, 400
WHOLE, SEGMENT, SEGMENTS = 12_000, 6_000, 12


def request_classes(turns: DataFrame, caller: Caller = stub) -> DataFrame:
    """(user_message_id, class): an open set of classes per request; the caller answers with lines "number: class, class" for a session's numbered requests."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_idx"))
    listed = turns.withColumn("n", nth).where(F.col("n") <= REQUESTS).withColumn("line", F.concat(F.col("n").cast("string"), F.lit(". "), digest.cut(F.col("user_text"), REQUEST_CHARS)))
    prompts = listed.groupBy(F.col("session_id").cast("string").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
    said = answers(prompts, caller).where("error is null").select("key", F.explode(F.split("answer", "\n")).alias("l"))
    read = said.select("key", F.regexp_extract("l", r"^\s*(\d+)\s*:", 1).try_cast("int").alias("n"), F.explode(F.split(F.regexp_replace("l", r"^\s*\d+\s*:", ""), ",")).alias("class"))
    return listed.withColumn("key", F.col("session_id").cast("string")).join(read.where("trim(class) <> ''"), ["key", "n"]).select("user_message_id", F.trim("class").alias("class")).distinct()


def classify_turns(turns: DataFrame, caller: Caller = stub) -> DataFrame:
    """(session_id, turn_idx, label, error) of selected turns."""
    key = F.concat_ws(":", "session_id", "turn_idx")
    prompts = turns.select(key.alias("key"), F.concat(F.lit("U: "), digest.cut(F.col("user_text"), 2000), F.lit("\nA: "), digest.cut(F.col("assistant_text"), 2000)).alias("prompt"))
    return turns.select("session_id", "turn_idx", key.alias("key")).join(answers(prompts, caller), "key").select("session_id", "turn_idx", F.col("answer").alias("label"), "error")


def overviews(lines: DataFrame, caller: Caller = stub) -> DataFrame:
    """(session_id, overview): a short digest is summed up as a whole, a long one by segments first."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", c))), lambda x: x[c]), "\n")
    whole = lines.groupBy("session_id").agg(joined("line").alias("text"))
    short = whole.where(F.length("text") <= WHOLE).select(F.col("session_id").cast("string").alias("key"), F.col("text").alias("prompt"))
    long_ = lines.join(whole.where(F.length("text") > WHOLE).select("session_id"), "session_id", "left_semi")
    parts = digest.packed(long_, SEGMENT, SEGMENTS).where("segment is not null").groupBy("session_id", "segment").agg(joined("line").alias("prompt"))
    mapped = answers(parts.select(F.concat_ws("#", "session_id", F.lpad(F.col("segment").cast("string"), 3, "0")).alias("key"), "prompt"), caller).where("error is null")
    reduced = mapped.groupBy(F.regexp_replace("key", r"#\d+$", "").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "answer"))), lambda x: x["answer"]), "\n").alias("prompt"))
    return answers(short.union(reduced), caller).select(F.col("key").alias("session_id"), F.col("answer").alias("overview"), "error")
