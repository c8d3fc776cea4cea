"""The analyzers that need no model, as functions from frames to findings.

A finding is (session_id, unit, content_json, message_ids): ``unit`` tells a session's findings
apart, ``message_ids`` are what they rest on. All sessions are computed at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.detect import artifacts, pii, scan, tables
from tracewright.operators import advice, digest, economy, failures, lexicon, shell, touches, trajectory, turns
from tracewright.plans.registry import Analyzer
from tracewright.schema import COMPACTION_ROLES
from tracewright.session import cut
from tracewright.sources.transcripts import tool_stream

Frames = dict[str, DataFrame]


def findings(rows: DataFrame, unit: Column, ids: Column | None = None, leave: tuple[str, ...] = ()) -> DataFrame:
    body = [c for c in rows.columns if c not in ("session_id", *leave)]
    return rows.select("session_id", unit.cast("string").alias("unit"), F.to_json(F.struct(*body)).alias("content_json"), (F.lit(None).cast("array<string>") if ids is None else ids).alias("message_ids"))


def by_session(rows: DataFrame, ids: Column | None = None) -> DataFrame:
    return findings(rows, F.lit(""), ids)


# --- what the operators read, of the messages ---


def turn_rows(messages: DataFrame) -> DataFrame:
    """Messages with what their tool calls and results come to."""
    results = F.coalesce("tool_results", F.array().cast(messages.schema["tool_results"].dataType))
    return messages.withColumns({
        "n_calls": F.size(F.coalesce("tool_calls", F.array().cast(messages.schema["tool_calls"].dataType))),
        "n_failures": F.size(F.filter(results, lambda r: r["isError"])),
        "result_bytes": F.aggregate(results, F.lit(0).cast("bigint"), lambda n, r: n + r["textLength"]),
    })


def friction(messages: DataFrame) -> DataFrame:
    return turns.friction(turns.turn_pairs(turn_rows(messages)))


def billed(messages: DataFrame) -> DataFrame:
    """Rows in order with usage as columns; null where none is recorded."""
    kinds = (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_write", "cacheWrite"))
    return messages.select("session_id", "seq", "id", "role", F.col("timestamp").alias("ts"), *[F.col(f"usage.{b}").alias(a) for a, b in kinds], "cost_usd", "model", "provider_message_id")


def context_rows(messages: DataFrame) -> DataFrame:
    """As :func:`billed`, with what the context economy asks of a row."""
    results = F.col("tool_results")
    length = F.when((F.col("role") == "toolResult") & (F.size(results) > 0), F.aggregate(results, F.lit(0).cast("bigint"), lambda n, r: n + r["textLength"]))
    more = messages.select("id", (F.col("role").isin(*COMPACTION_ROLES)).alias("compaction"), ((F.col("role") == "assistant") & F.col("usage").isNotNull()).alias("billed"), length.alias("text_length"), F.nullif(F.get(results, F.lit(0))["toolName"], F.lit("")).alias("tool"))
    return billed(messages).join(more, "id")


def fields(messages: DataFrame) -> DataFrame:
    """(session_id, message_id, field, text) of every text of a message, the arguments of its calls among them."""
    calls = F.array_join(F.transform("tool_calls", lambda c: c["arguments"]), "\n")
    each = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("content_text", F.col("content_text")), ("content_thinking", F.col("content_thinking")), ("tool_calls", calls))])
    return messages.select("session_id", F.col("id").alias("message_id"), F.explode(each).alias("f")).select("session_id", "message_id", "f.field", "f.text").where("text is not null")


def failed(messages: DataFrame) -> DataFrame:
    """(session_id, axis, tool, failure, text, cost_usd) of failed turns and failed tool calls."""
    bad = messages.where((F.col("role") == "assistant") & failures.turn_failed(F.col("error_message"), F.col("stop_reason")))
    text = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.col("stop_reason"), F.lit(""))
    of_turns = bad.select("session_id", F.lit("turn").alias("axis"), F.lit("").alias("tool"), failures.turn_failure(text).alias("failure"), text.alias("text"), "cost_usd")
    stream = tool_stream(messages).where("is_error")
    said = messages.select(F.col("id").alias("result_message_id"), F.coalesce("content_text", F.lit("")).alias("text"))
    command = F.coalesce(F.get_json_object("arguments", "$.command"), F.lit(""))
    of_tools = stream.join(said, "result_message_id").select("session_id", F.lit("tool").alias("axis"), "tool", failures.tool_failure(F.col("text"), command).alias("failure"), "text", "cost_usd")
    return of_turns.union(of_tools)


def routed(messages: DataFrame) -> DataFrame:
    """Turns with their context, edits and route."""
    messages = cut(messages)  # five plans read them
    order = turns.segments(messages)
    seen = order.groupBy("session_id", "turn_idx").agg(F.coalesce(F.max(F.col("usage.input") + F.col("usage.cacheRead")), F.lit(0)).alias("context_tokens"))
    edits = tool_stream(messages).where(F.col("tool").isin("edit", "apply_patch", "apply")).groupBy(F.col("message_id").alias("id")).agg(F.sum(F.length("arguments")).alias("n"))
    edited = order.select("session_id", "turn_idx", "id").join(edits, "id").groupBy("session_id", "turn_idx").agg(F.sum("n").alias("edit_chars"))
    rows = friction(messages).join(seen, ["session_id", "turn_idx"], "left").join(edited, ["session_id", "turn_idx"], "left").na.fill(0, ["context_tokens", "edit_chars"])
    return trajectory.routing(rows, trajectory.signals(shell.calls(tool_stream(messages))))


# --- the analyzers ---


def turn_pair_core(f: Frames) -> DataFrame:
    rows = turns.correction_text(friction(f["messages"])).join(turns.evidence(f["messages"]), ["session_id", "turn_idx"], "left")
    return findings(rows, F.col("turn_idx"), F.col("message_ids"), ("message_ids", "assistant_text", "prior_user_text", "thinking_text"))


def lexicon_candidates(f: Frames) -> DataFrame:
    rows = lexicon.nominate(lexicon.term_counts(f["messages"])).groupBy("session_id", "distinct_terms", "total_words")
    return by_session(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))), lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"))).alias("terms")))


def tool_trajectory(f: Frames) -> DataFrame:
    rows = trajectory.signals(shell.calls(tool_stream(f["messages"])))
    return findings(rows, F.concat_ws(":", "pattern", "first_ord", F.element_at("call_ids", -1)), F.col("call_ids"), ("call_ids",))


def failure_modes(f: Frames) -> DataFrame:
    return findings(failures.groups(failed(f["messages"])), F.concat_ws(":", "axis", "class_id", "tool"))


def revive_chains(f: Frames) -> DataFrame:
    stream = tool_stream(f["messages"]).withColumn("call_id", F.col("message_id"))
    return findings(trajectory.chains(stream, F.col("subagent.status") == "revived"), F.col("first_ord"), F.col("call_ids"), ("call_ids",))


def context_economy(f: Frames) -> DataFrame:
    return findings(economy.context_economy(economy.carry(context_rows(f["messages"]))), F.col("tool"))


def cache_economy(f: Frames) -> DataFrame:
    return by_session(economy.cache_economy(economy.cache_classes(billed(f["messages"]).where("role = 'assistant'"))))


def routing_opportunity(f: Frames) -> DataFrame:
    rows = routed(f["messages"]).select("session_id", "turn_idx", "route", "n_calls", "context_tokens", "edit_chars", "friction_score", "message_ids")
    return findings(rows, F.col("turn_idx"), F.col("message_ids"), ("message_ids",))


def _leaks(family: str) -> Callable[[Frames], DataFrame]:
    def compute(f: Frames) -> DataFrame:
        rows = scan.gate(scan.scan(fields(f["messages"]))).where(F.col("family") == family)
        return findings(rows, F.concat_ws(":", "message_id", "field", "rule_id", "match_index"), F.array("message_id"))

    return compute


def secret_scanner(f: Frames) -> DataFrame:
    rows = artifacts.scan_artifacts(fields(f["messages"]))
    return findings(rows, F.concat_ws(":", "message_id", "field", "kind", "line", "name", "fingerprint"), F.array("message_id"))


def presidio(f: Frames) -> DataFrame:
    return findings(pii.find_pii(fields(f["messages"])), F.concat_ws(":", "message_id", "field", "recognizer", "match_index"), F.array("message_id"))


def piicatcher(f: Frames) -> DataFrame:
    rows = tables.best_classes(tables.column_profiles(fields(f["messages"])))
    return findings(rows, F.concat_ws(":", "message_id", "field", "line", "column"), F.array("message_id"))


def dataprofiler(f: Frames) -> DataFrame:
    """Tables in the files that a session read or wrote."""
    stream = tool_stream(f["messages"])
    touched = touches.file_touches(stream, f["messages"]).where("content is not null")
    rows = tables.column_profiles(touched.select("session_id", F.col("ord").cast("string").alias("message_id"), F.col("path").alias("field"), F.col("content").alias("text")))
    return findings(rows.withColumnsRenamed({"message_id": "ord", "field": "path"}), F.concat_ws(":", "ord", "path", "line", "column"))


def token_units(f: Frames) -> DataFrame:
    segments = economy.request_segments(billed(f["messages"]))
    return findings(segments, F.col("ordinal"), F.array_compact(F.array("user_message_id")))


def session_overview(f: Frames) -> DataFrame:
    """The digest of a session with its flags."""
    found = friction(f["messages"])
    lines = digest.packed(digest.lines(found)).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "line", "segment"))), lambda x: F.struct(x["line"].alias("line"), x["segment"].alias("segment"))).alias("digest"))
    return by_session(turns.session_flags(found).join(lines, "session_id"))


ANALYZERS = [
    Analyzer("turn-pair-core", "1.0", turn_pair_core), Analyzer("lexicon-candidates", "1.3", lexicon_candidates), Analyzer("tool-trajectory", "2.0", tool_trajectory),
    Analyzer("failure-modes", "1.1", failure_modes, advise=lambda f: advice.failures(failures.groups(failed(f["messages"])))),
    Analyzer("revive-chains", "1.0", revive_chains), Analyzer("context-economy", "2.0", context_economy),
    Analyzer("cache-economy", "1.0", cache_economy, advise=lambda f: advice.cache(economy.cache_economy(economy.cache_classes(billed(f["messages"]).where("role = 'assistant'"))))),
    Analyzer("routing-opportunity", "1.0", routing_opportunity, depends_on=("turn-pair-core", "tool-trajectory")),
    *[Analyzer(name, "1.0", _leaks(name)) for name in ("secret-leak", "gitleaks", "nosey-parker", "detect-secrets", "trufflehog")],
    Analyzer("secret-scanner", "1.0", secret_scanner), Analyzer("presidio", "1.0", presidio), Analyzer("piicatcher", "1.0", piicatcher), Analyzer("dataprofiler", "1.0", dataprofiler),
    Analyzer("token-units", "1.0", token_units), Analyzer("session-overview", "1.0", session_overview, depends_on=("turn-pair-core",)),
]
