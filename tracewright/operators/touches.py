"""Files that a session touched, and what of their content the transcript captured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READS, WRITES = ("read", "cat", "view"), ("write", "create")


def path_of(arguments: Column) -> Column:
    """The path argument, under any of its names."""
    return F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in ("path", "file_path", "filePath", "file")])


def file_touches(stream: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, ord, tool, path, content): a write's content is its argument; a read's is the text of the
    result row, if that row holds this one result alone (else whose text it is cannot be told).
    """
    single = messages.where(F.size("tool_results") == 1).select(F.col("id").alias("result_message_id"), "content_text")
    touched = stream.select("session_id", "ord", "tool", path_of(F.col("arguments")).alias("path"), "arguments", "result_message_id", "is_error").where("path is not null")
    joined = touched.join(single, "result_message_id", "left")
    content = F.when(F.col("tool").isin(*WRITES), F.get_json_object("arguments", "$.content")).when(F.col("tool").isin(*READS) & ~F.coalesce("is_error", F.lit(False)), F.col("content_text"))
    return joined.select("session_id", "ord", "tool", "path", content.alias("content"))


def repeated_reads(stream: DataFrame, least: int = 2) -> DataFrame:
    """(session_id, path, n): paths read ``least`` times or more."""
    reads = stream.where(F.col("tool").isin(*READS)).select("session_id", path_of(F.col("arguments")).alias("path")).where("path is not null")
    return reads.groupBy("session_id", "path").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def read_amplification(results: DataFrame, billed: DataFrame) -> DataFrame:
    """(session_id, amplification): carry of what was read and run, per output token; null without output."""
    carried = results.where(F.col("tool").isin("read", "bash")).groupBy("session_id").agg(F.sum("carry").alias("carry"))
    output = billed.groupBy("session_id").agg(F.sum("output").alias("output"))
    return output.join(carried, "session_id", "left").select("session_id", F.round(F.try_divide(F.coalesce("carry", F.lit(0.0)), F.col("output"))).cast("bigint").alias("amplification"))


def skill_use(stream: DataFrame, results: DataFrame, tool: str = "skill", threshold: int = 50_000) -> DataFrame:
    """(session_id, skill, uses, tokens_after, heavy): skills, and the rounded tokens of the results that came after the first use."""
    used = stream.where(F.col("tool") == tool).select("session_id", "ord", F.coalesce(F.get_json_object("arguments", "$.name"), F.get_json_object("arguments", "$.skill")).alias("skill"), F.col("seq") if "seq" in stream.columns else F.col("ord").alias("seq")).where("skill is not null")
    first = used.groupBy("session_id", "skill").agg(F.count("*").alias("uses"), F.min("seq").alias("_first"))
    later = results.select("session_id", F.col("seq").alias("_seq"), F.round("tokens").cast("bigint").alias("_tokens"))
    joined = first.join(later, "session_id", "left").groupBy("session_id", "skill", "uses").agg(F.coalesce(F.sum(F.when(F.col("_seq") > F.col("_first"), F.col("_tokens"))), F.lit(0)).alias("tokens_after"))
    return joined.withColumn("heavy", F.col("tokens_after") >= threshold)
