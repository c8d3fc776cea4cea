"""Proposals that follow from results: (session_id, analyzer_id, title, severity, detail, confidence, cost_usd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, when: Column, analyzer: str, title: str, severity: str, detail: Column, confidence: float | Column = 0.7, cost: Column | None = None) -> DataFrame:
    value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return df.where(when).select("session_id", F.lit(analyzer).alias("analyzer_id"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), detail.alias("detail"), value.alias("confidence"), (cost if cost is not None else F.lit(None).cast("double")).alias("cost_usd"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cache(economy: DataFrame) -> DataFrame:
    """Of cache economy per session: repeated cold starts, expiry, broken prefixes, writes that are never read."""
    cold = F.col("n_cold_start") + F.col("n_cold_ttl") + F.col("n_cold_prefix")
    text = lambda n, what: F.concat(n.cast("string"), F.lit(what))
    return _all([
        _rows(economy, cold >= 2, "cache-economy", "Keep the prompt cache warm", "waste", text(cold, " cold calls"), 0.7, F.col("cold_cost_usd")),
        _rows(economy, F.col("n_cold_ttl") > 0, "cache-economy", "The cache expires between turns", "waste", text(F.col("n_cold_ttl"), " calls after the cache had expired")),
        _rows(economy, F.col("n_cold_prefix") > 0, "cache-economy", "The prompt's prefix changes", "waste", text(F.col("n_cold_prefix"), " calls missed a live cache")),
        _rows(economy, F.col("churn_tokens") > 0, "cache-economy", "Cached tokens are never read", "waste", text(F.col("churn_tokens"), " tokens written and not read")),
    ])


def compaction(cycles: DataFrame, results: DataFrame, never: float = 5e6) -> DataFrame:
    """Of compaction cycles: fired late or often; and sessions that carried much and never compacted."""
    carried = results.groupBy("session_id").agg(F.sum("carry").alias("carry")).join(cycles.select("session_id").distinct(), "session_id", "left_anti")
    return _all([
        _rows(cycles, F.col("fired_too_late"), "context-economy", "Compact earlier", "waste", F.concat(F.col("carry_avoided").cast("string"), F.lit(" token-turns carried"))),
        _rows(cycles, F.col("fired_too_often"), "context-economy", "Compact less often", "waste", F.concat(F.col("rebuild_tokens").cast("string"), F.lit(" tokens rebuilt"))),
        _rows(carried, F.col("carry") >= never, "context-economy", "Compact long sessions", "waste", F.concat(F.round("carry").cast("bigint").cast("string"), F.lit(" token-turns carried"))),
    ])


def failures(groups: DataFrame) -> DataFrame:
    """Of failure groups that are worth a proposal."""
    detail = F.concat(F.col("n_failures").cast("string"), F.lit(" failures of class "), "class_id")
    return _rows(groups, F.col("confidence").isNotNull(), "failure-modes", "Repeated failure", "friction", detail, F.col("confidence"), F.col("cost_usd"))


def chains(chain_rows: DataFrame, least: int = 3) -> DataFrame:
    """Of chains of revived runs."""
    return _rows(chain_rows, F.col("length") >= least, "revive-chains", "Runs are revived again and again", "waste", F.concat(F.col("redundant_spawns").cast("string"), F.lit(" redundant spawns")))


def models(mix: DataFrame, dominance: DataFrame, escalation: float = 0.3, min_turns: int = 20) -> DataFrame:
    """Of the model mix: a dominated model's cheaper peer, and models that are often out of their depth. These have no session."""
    cheaper = dominance.select(F.lit(None).cast("string").alias("session_id"), F.concat("model", F.lit(" is no better than "), "by").alias("d"))
    hard = mix.where(f"turns >= {min_turns}").select(F.lit(None).cast("string").alias("session_id"), "escalation_rate", "model")
    return _rows(cheaper, F.lit(True), "model-mix", "Use the cheaper model", "suggestion", F.col("d")).unionByName(
        _rows(hard, F.col("escalation_rate") >= escalation, "model-mix", "Escalate to a stronger model", "suggestion", F.col("model"))
    )
