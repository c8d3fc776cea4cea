"""Digests of sessions: turns as text, packed into segments of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(text: Column, most: int) -> Column:
    """Text on one line, shortened with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def lines(turns: DataFrame, user: int = 300, assistant: int = 500) -> DataFrame:
    """One line of digest per turn."""
    mark = F.when(F.col("correction_type").isNotNull(), F.concat(F.lit(" ["), "correction_type", F.lit("]"))).otherwise("")
    body = F.concat(F.lit("#"), F.col("turn_idx").cast("string"), mark, F.lit(" U: "), cut(F.col("user_text"), user), F.lit(" A: "), cut(F.col("assistant_text"), assistant))
    return turns.select("session_id", "turn_idx", body.alias("line"))


def enriched(core: DataFrame, labels: DataFrame, signals: DataFrame, acts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Turns with all that is known of them: a model's label, signals of frustration, reply acts, tool evidence. What is missing stays null or empty.

    ``labels`` (user_message_id, label), ``signals`` (user_message_id, signal, weight), ``acts`` (user_message_id, acts), ``evidence`` as :func:`tracewright.operators.turns.evidence`.
    Signals are folded before the join, so each join is one row to one.
    """
    felt = signals.groupBy("user_message_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(-F.col("weight"), "signal"))), lambda x: x["signal"]).alias("signals"), F.round(F.sum("weight"), 6).alias("frustration"))
    out = core.join(labels.dropDuplicates(["user_message_id"]), "user_message_id", "left").join(felt, "user_message_id", "left").join(acts.dropDuplicates(["user_message_id"]), "user_message_id", "left")
    out = out.withColumns({"signals": F.coalesce("signals", F.array().cast("array<string>")), "frustration": F.coalesce("frustration", F.lit(0.0)), "acts": F.coalesce("acts", F.array().cast("array<string>"))})
    return out if evidence is None else out.join(evidence, ["session_id", "turn_idx"], "left")


def packed(digest: DataFrame, size: int = 6000, most: int = 12) -> DataFrame:
    """``digest`` with ``segment``: lines fill a segment greedily up to ``size`` characters; what lies beyond ``most`` segments has none.

    A session's lengths are one array of numbers, folded in the JVM.
    """
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", F.length("line").alias("n")))), lambda x: x["n"])
    start = F.struct(F.lit(0).alias("segment"), F.lit(0).alias("filled"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        fresh = (s["filled"] > 0) & (s["filled"] + n > size)
        segment = F.when(fresh, s["segment"] + 1).otherwise(s["segment"])
        return F.struct(segment.alias("segment"), F.when(fresh, n).otherwise(s["filled"] + n).alias("filled"), F.concat(s["out"], F.array(segment)).alias("out"))

    folded = digest.groupBy("session_id").agg(F.aggregate(lengths, start, step, lambda s: s["out"]).alias("_segments"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_idx"))
    out = digest.withColumn("_n", nth).join(folded, "session_id").withColumn("segment", F.element_at("_segments", F.col("_n")))
    return out.withColumn("segment", F.when(F.col("segment") < most, F.col("segment"))).drop("_n", "_segments")


def reply_acts(rows: DataFrame) -> DataFrame:
    """Distribution of users' reply acts per session from (session_id, turn_idx, acts): turns, turns with several acts, counts and shares by act."""
    turns = rows.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(F.size("acts") > 1).alias("multi"))
    acts = rows.select("session_id", F.explode(F.array_distinct("acts")).alias("act")).groupBy("session_id", "act").agg(F.count("*").alias("n"))
    return acts.join(turns, "session_id").withColumn("share", F.round(F.try_divide("n", "turns"), 6))
