"""Counts over sessions, messages and usage, each in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def message_stats(messages: DataFrame) -> DataFrame:
    """Messages and sessions by role, with a total row (role null): grouping sets in place of a scan for each figure."""
    empty = F.count_if(F.coalesce("content_text", F.lit("")) == "")
    return messages.groupingSets([[F.col("role")], []], "role").agg(F.count("*").alias("n_messages"), F.countDistinct("session_id").alias("n_sessions"), F.sum(F.length("content_text")).alias("n_chars"), empty.alias("n_empty"))


def token_stats(billed: DataFrame, source: str = "source") -> DataFrame:
    """Sums and rounded means by source and in total (null); ratios are null where the denominator is 0."""
    sums = billed.cube(source).agg(
        F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")], F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    )
    return sums.withColumns({
        "input_per_turn": F.round(F.try_divide("input", "turns")).cast("bigint"),
        "output_per_turn": F.round(F.try_divide("output", "turns")).cast("bigint"),
        "input_to_output": F.round(F.try_divide("input", "output"), 1),
    })


def group_sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def status_counts(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("status", "validation_status").agg(F.count("*").alias("n"))


def accounting(outcomes: DataFrame, examples: int = 3) -> DataFrame:
    """(analyzer_id, outcome, n, examples): counts of run outcomes with a few ids, the least ones.

    Ranked rows are cut off in each task before they are shuffled, so no group's ids meet.
    """
    by = ["analyzer_id", "outcome"]
    counts = outcomes.groupBy(*by).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("unit_id"))
    few = outcomes.where("unit_id is not null").select(*by, "unit_id").distinct().withColumn("_nth", nth).where(F.col("_nth") <= examples)
    few = few.groupBy(*by).agg(F.array_sort(F.collect_list("unit_id")).alias("_few"))
    same = [counts[c].eqNullSafe(few[c]) for c in by]
    return counts.join(few, same[0] & same[1], "left").select(*[counts[c] for c in by], "n", F.coalesce("_few", F.array().cast("array<string>")).alias("examples"))
