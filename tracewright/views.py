"""The model's tables as seen in the shared star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; sessions are conversations. The lengths of answers stand in for what their tool calls did."""
    mine = lambda c: F.when((F.col("role") == "assistant") & F.col("text").isNotNull(), c).otherwise(0).cast("int")
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content_text"),
        mine(n % 3).alias("n_calls"), mine(F.when(n % 7 == 0, 1 + n % 4).otherwise(0)).alias("n_failures"), mine(n * 20).alias("result_bytes"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls; sessions are users. Views and clicks read; errors fail; purchases have a cost."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("view "), (F.get_json_object("props", "$.k").cast("int") % 2).cast("string"))).otherwise("").alias("subcommand"),
        (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("target"), F.get_json_object("props", "$.k").alias("args"),
        F.col("event_type").isin("view", "click").alias("read_only"), (F.col("event_type") == "error").alias("is_error"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("cost_usd"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as billed model calls; sessions are customers, their orders in time give the sequence."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_partkey").alias("provider_message_id"), F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("o_orderpriority").alias("marker"),
        F.col("l_quantity").cast("bigint").alias("input"), cents("l_discount").alias("output"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("bigint") * 3).otherwise(F.lit(0)).alias("cache_read"),
        cents("l_tax").alias("cache_write"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / 1e6).alias("cost_usd"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag").alias("id"),
    )


#: The same views for DuckDB.
SQL = {
    "messages": "SELECT conv_id || ':' || turn AS id, conv_id AS session_id, turn AS seq, role, text AS content_text, CASE WHEN role = 'assistant' AND text IS NOT NULL THEN length(text) % 3 ELSE 0 END AS n_calls, CASE WHEN role = 'assistant' AND length(text) % 7 = 0 THEN 1 + length(text) % 4 ELSE 0 END AS n_failures, CASE WHEN role = 'assistant' AND text IS NOT NULL THEN length(text) * 20 ELSE 0 END AS result_bytes FROM conversations",
    "calls": """SELECT user_id AS session_id, ts, event_id AS call_id, event_type AS tool, CASE WHEN event_type = 'view' THEN 'view ' || (json_extract_string(props, '$.k')::INT % 2) ELSE '' END AS subcommand, ((json_extract_string(props, '$.k')::INT) % 3)::VARCHAR AS target,
        json_extract_string(props, '$.k') AS args, event_type IN ('view', 'click') AS read_only, event_type = 'error' AS is_error, CASE WHEN event_type = 'purchase' THEN value END AS cost_usd FROM events""",
    "usage": """SELECT o_custkey AS session_id, o_orderdate AS ts, l_orderkey, l_linenumber, l_partkey, l_partkey AS provider_message_id, l_returnflag || l_linestatus AS model, o_orderpriority AS marker,
        l_quantity::BIGINT AS input, round(l_discount * 100)::BIGINT AS output, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT * 3 ELSE 0 END AS cache_read, round(l_tax * 100)::BIGINT AS cache_write,
        CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1e6 END AS cost_usd, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` (a select, or "name AS (...), ... SELECT") behind the views it reads."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {views}, {sql}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH {views} {sql}"
