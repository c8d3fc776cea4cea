"""Turns of a session and their friction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.patterns import LEADING, STRONG, WEAK, jvm, matched
from tracewright.schema import TURN_ROLES
from tracewright.sources.transcripts import preview


@dataclass(frozen=True)
class Friction:
    correction: float = 0.6
    failure: float = 0.25
    empty: float = 0.3
    waste: float = 0.15
    max_failures: int = 3
    waste_bytes: int = 20_000
    high: float = 0.5


def segments(messages: DataFrame, roles: tuple[str, ...] = TURN_ROLES) -> DataFrame:
    """``messages`` with ``turn_idx``, from 0; -1 before the first opening role. One shuffle by session, shared by what follows."""
    order = Window.partitionBy("session_id").orderBy("seq")
    return messages.withColumn("turn_idx", (F.sum(F.col("role").isin(*roles).cast("int")).over(order) - 1).cast("int"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """One row per turn: (session_id, turn_idx, user_message_id, user_text, assistant_text, n_calls, n_failures, result_bytes, message_ids, prior_user_text).

    Rows before the first turn are dropped; within a turn only its opening row and
    assistant and toolResult rows count. Assistant texts are joined by line feeds in order.
    """
    of = lambda c, when: F.array_sort(F.collect_list(F.when(when, F.struct("seq", F.col(c).alias("x")))))
    opens, speaks = F.col("role").isin(*TURN_ROLES), F.col("role") == "assistant"
    turns = (
        segments(messages)
        .where("turn_idx >= 0")
        .groupBy("session_id", "turn_idx")
        .agg(
            F.min_by(F.when(opens, F.col("id")), "seq").alias("user_message_id"),
            F.min_by(F.when(opens, F.col("content_text")), "seq").alias("user_text"),
            F.transform(of("content_text", speaks & F.col("content_text").isNotNull()), lambda x: x["x"]).alias("texts"),
            F.transform(of("id", opens | speaks | (F.col("role") == "toolResult")), lambda x: x["x"]).alias("message_ids"),
            *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_calls", "n_failures", "result_bytes")],
        )
    )
    prior = F.lag("user_text").over(Window.partitionBy("session_id").orderBy("turn_idx"))
    return turns.select("session_id", "turn_idx", "user_message_id", "user_text", F.array_join("texts", "\n").alias("assistant_text"), "n_calls", "n_failures", "result_bytes", "message_ids", prior.alias("prior_user_text"))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), lambda t: F.length(t) > 2))


def friction(turns: DataFrame, config: Friction = Friction()) -> DataFrame:
    """``turns`` with correction_type, correction_patterns, is_empty, waste_bytes, friction_score and high_signal."""
    text, prior = F.col("user_text"), F.col("prior_user_text")
    again = (F.length(text) <= 80) & (F.size(F.array_intersect(tokens(text), tokens(prior))) >= 2)
    marked = turns.withColumns({"_again": F.coalesce(again, F.lit(False)), "_strong": matched(text, STRONG), "_weak": matched(text, WEAK), "_lead": matched(text, LEADING)})
    kind = F.when(F.col("_again"), "repetition").when(F.size("_strong") > 0, "explicit").when(F.size("_weak") > 0, "implicit").when(F.size("_lead") > 0, "explicit")
    found = F.when(F.col("_again"), F.array().cast("array<string>")).when(F.size("_strong") > 0, F.col("_strong")).when(F.size("_weak") > 0, F.col("_weak")).otherwise(F.col("_lead"))
    marked = marked.withColumns({
        "correction_type": kind,
        "correction_patterns": F.coalesce(found, F.array().cast("array<string>")),
        "is_empty": (F.trim("assistant_text") == "") & (F.col("n_calls") == 0),
        "waste_bytes": F.greatest(F.lit(0).cast("bigint"), F.col("result_bytes") - config.waste_bytes),
    })
    score = (
        config.correction * F.col("correction_type").isNotNull().cast("int")
        + config.failure * F.least("n_failures", F.lit(config.max_failures))
        + config.empty * F.col("is_empty").cast("int")
        + config.waste * (F.col("result_bytes") > config.waste_bytes).cast("int")
    )
    marked = marked.withColumn("friction_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6))
    return marked.withColumn("high_signal", F.col("friction_score") >= config.high).drop("_again", "_strong", "_weak", "_lead")


REST, HEAD = 240, 300


def correction_text(turns: DataFrame) -> DataFrame:
    """:func:`friction` with ``correction_text``: what follows the first pattern found, or the pattern's own words; of a repetition and a leading refusal the text itself. ``REST`` characters at most."""
    text, first = F.col("user_text"), F.get("correction_patterns", F.lit(0))
    after = None
    for p in (*STRONG, *WEAK):
        hit = F.regexp_extract(text, f"(?s){jvm(p)}", 0)
        rest = F.trim(F.substr(text, F.instr(text, hit) + F.length(hit)))
        said = F.when(first == p, F.coalesce(F.nullif(rest, F.lit("")), hit))
        after = said if after is None else F.coalesce(after, said)
    return turns.withColumn("correction_text", F.when(F.col("correction_type").isNotNull(), F.substring(F.coalesce(after, text), 1, REST)))


def evidence(messages: DataFrame) -> DataFrame:
    """Per turn, in order: its calls as (tool, preview), the heads of its failed results as (tool, head), and the thinking of its answers.

    ``messages`` have tool_calls, tool_results and content_thinking. (session_id, turn_idx, action_trace, error_heads, thinking_text).
    """
    def listed(when: Column, what: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(when, F.struct("seq", what.alias("x")))))
        return F.transform(rows, lambda r: r["x"])

    calls = F.transform("tool_calls", lambda c: F.struct(c["name"].alias("tool"), preview(c["name"], c["arguments"]).alias("preview")))
    text = F.trim(F.coalesce("content_text", F.lit("")))
    head = F.when(F.length(text) > HEAD, F.concat(F.substring(text, 1, HEAD), F.lit("…"))).otherwise(F.nullif(text, F.lit("")))
    failed = F.transform(F.filter("tool_results", lambda r: r["isError"]), lambda r: F.struct(r["toolName"].alias("tool"), F.col("_head").alias("head")))
    rows = segments(messages).where("turn_idx >= 0").withColumn("_head", head).withColumns({"_calls": calls, "_failed": failed})
    speaks = F.col("role") == "assistant"
    return rows.groupBy("session_id", "turn_idx").agg(
        F.flatten(listed(speaks & F.col("_calls").isNotNull(), F.col("_calls"))).alias("action_trace"),
        F.flatten(listed((F.col("role") == "toolResult") & F.col("_failed").isNotNull(), F.col("_failed"))).alias("error_heads"),
        F.array_join(listed(speaks & F.col("content_thinking").isNotNull(), F.col("content_thinking")), "\n").alias("thinking_text"),
    )


def session_flags(turns: DataFrame) -> DataFrame:
    """Per session: turns, corrections, failing and high-signal turns, and the summary flags."""
    after = F.lead(F.struct("correction_type", "high_signal")).over(Window.partitionBy("session_id").orderBy("turn_idx"))
    clean = F.col("correction_type").isNotNull() & F.col("_next").isNotNull() & F.col("_next.correction_type").isNull() & ~F.col("_next.high_signal")
    out = turns.withColumn("_next", after).groupBy("session_id").agg(
        F.count("*").alias("n_turns"),
        F.count("correction_type").alias("n_corrections"),
        F.count_if(F.col("n_failures") > 0).alias("n_failing"),
        F.count_if("high_signal").alias("n_high"),
        F.coalesce(F.bool_or(clean), F.lit(False)).alias("clean_recovery"),
    )
    return out.withColumns({"completed_without_correction": F.col("n_corrections") == 0, "low_failure_density": F.col("n_failing") * 2 < F.col("n_turns")})


def smooth_siblings(flags: DataFrame, sessions: DataFrame, limit: int = 3) -> DataFrame:
    """(session_id, sibling_id, sibling_turns, rank): sessions of the same directory with two turns or more and neither corrections nor high signals, most turns first."""
    smooth = flags.where("n_turns >= 2 and n_corrections = 0 and n_high = 0").join(sessions.where("cwd <> ''"), "session_id").select("cwd", F.col("session_id").alias("sibling_id"), F.col("n_turns").alias("sibling_turns"))
    # a directory's best few suffice: one more than asked for, as a session is not its own sibling
    best = smooth.withColumn("_r", F.row_number().over(Window.partitionBy("cwd").orderBy(F.desc("sibling_turns"), "sibling_id"))).where(F.col("_r") <= limit + 1).drop("_r")
    pairs = sessions.where("cwd <> ''").join(best, "cwd").where("session_id <> sibling_id")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("sibling_turns"), "sibling_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("session_id", "sibling_id", "sibling_turns", "rank")
